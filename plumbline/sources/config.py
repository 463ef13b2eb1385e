"""Parameters of a run as one object, read from YAML or JSON."""

from __future__ import annotations

import dataclasses
import json


@dataclasses.dataclass(frozen=True)
class Config:
    """Reading window and overlap in tokens, answer limit, chunks, sample size per class, seed; scorers and datasets."""

    width: int = 1800
    overlap: int = 256
    answer: int = 256
    chunks: int = 5
    per_class: int = 300
    seed: int = 42
    models: tuple[str, ...] = ()
    datasets: tuple[str, ...] = ()

    def replaced(self, **values) -> Config:
        known = {f.name for f in dataclasses.fields(self)}
        if wrong := sorted(set(values) - known):
            raise ValueError(f"unknown parameters: {', '.join(wrong)}")
        return dataclasses.replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})

    @classmethod
    def read(cls, path: str) -> Config:
        """From ``params`` and the lists beside them; by the file's suffix YAML, which needs its package, or JSON. Other keys beside them are errors."""
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise ValueError("YAML needs the yaml package; JSON does not") from e
                held = yaml.safe_load(f) or {}
            else:
                held = json.load(f)
        return cls().replaced(**held.pop("params", {}), **held)
