"""Settings with defaults, from the environment and from the session."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Each is PARLANCE_<NAME> in the environment or spark.parlance.<name> in the session, which comes first."""

    chunk_size: int = 500
    chunk_overlap: int = 75
    frame_interval: float = 5.0
    max_frames: int = 200
    max_speakers: int = 10
    ocr_languages: str = "eng+hin+san"
    store: str = "knowledge_base"
    graph: str = ""
    model_key: str = ""

    def checked(self) -> Settings:
        """Itself, if it names a key for outside models; else an error."""
        if not self.model_key:
            raise ValueError("PARLANCE_MODEL_KEY or spark.parlance.model_key must be set for outside models")
        return self


def settings(spark: SparkSession | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    made = {}
    for f in fields(Settings):
        found = spark.conf.get(f"spark.parlance.{f.name}", None) if spark else None
        found = env.get(f"PARLANCE_{f.name.upper()}") if found is None else found
        if found is not None:
            made[f.name] = type(f.default)(found)
    return Settings(**made)
