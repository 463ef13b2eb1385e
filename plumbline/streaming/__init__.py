"""Structured Streaming counterparts of overlapping windows, append-only logs and arriving shards (beyond the batch engine's operators)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def sliding_costs(events: DataFrame, size: str = "30 minutes", slide: str = "20 minutes", late: str = "1 hour") -> DataFrame:
    """Overlapping event-time windows with a watermark: count and sum of values per event type."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def first_arrivals(rows: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each key once, as shards arrive; state is kept for as long as rows may be late."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append_batches(rows: DataFrame, path: str, checkpoint: str):
    """Resumable append: each micro-batch is written once under its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Completeness(StatefulProcessor):
    """Which shards of a run have come. State per run: shards and their rows, how many there must be, and whether it has been told; all of it goes when the run's time is over."""

    def __init__(self, patience: float):
        self.patience = int(patience * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shards = handle.getMapState("shards", "shard long", "rows long")
        self.run = handle.getValueState("run", "expected long, rows long, told boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.run.get() if self.run.exists() else None
        expected, total, told = known or (0, 0, False)
        for pdf in rows:
            if known is None and not expected:  # the first arrival starts the clock
                self.handle.registerTimer(int(pdf["ts"].min().timestamp() * 1000) + self.patience)
            expected = max(expected, int(pdf["n_shards"].max()))
            for shard, n in zip(pdf["shard"].tolist(), pdf["n_rows"].tolist(), strict=True):
                if not self.shards.containsKey((shard,)):  # a shard that comes again counts once
                    self.shards.updateValue((shard,), (n,))
                    total += n
        there = sum(1 for _ in self.shards.keys())
        whole = there == expected and not told
        self.run.update((expected, total, told or whole))
        if whole:
            yield self._row(key, "complete", there, expected, total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        expected, total, told = self.run.get()
        if not told:
            yield self._row(key, "incomplete", sum(1 for _ in self.shards.keys()), expected, total)
        self.shards.clear()
        self.run.clear()

    @staticmethod
    def _row(key, state: str, there: int, expected: int, total: int) -> pd.DataFrame:
        return pd.DataFrame({"run": [key[0]], "state": [state], "n_there": [there], "n_shards": [expected], "n_rows": [total]})

    def close(self) -> None:
        pass


def complete_runs(shards: DataFrame, patience: float = 3600.0, late: str = "1 hour") -> DataFrame:
    """(run, state, n_there, n_shards, n_rows) of arriving rows (run, shard, n_shards, n_rows, ts): once per run, ``complete`` as soon as all its shards are there, or ``incomplete`` when the watermark has passed ``patience`` seconds after the first. Needs the state store that keeps maps and timers (RocksDB)."""
    keyed = shards.withWatermark("ts", late).groupBy("run")
    return keyed.transformWithStateInPandas(statefulProcessor=Completeness(patience), outputStructType="run string, state string, n_there long, n_shards long, n_rows long", outputMode="Append", timeMode="EventTime")
