"""plumbline: Spark-native analytics for judging how well answers are supported by their sources."""
