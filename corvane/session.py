"""Session factory and settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass
class Settings:
    """Engine settings; each can come from the environment as CORVANE_<NAME>."""

    chunk_size: int = 500
    chunk_overlap: int = 50
    top_k: int = 5
    fetch_k: int = 20
    alpha: float = 0.5
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    min_similarity: float = 0.3
    date_weight: float = 0.2
    max_context_tokens: int = 4000
    max_file_bytes: int = 100 * 1024 * 1024

    @classmethod
    def from_env(cls) -> Settings:
        got = {f.name: os.environ.get(f"CORVANE_{f.name.upper()}") for f in fields(cls)}
        return cls(**{f.name: type(f.default)(got[f.name]) for f in fields(cls) if got[f.name] is not None})


def session(app: str = "corvane", cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session: UTC, adaptive execution, as many shuffle partitions as cores. On a cluster use its own session."""
    n = shuffle_partitions or (os.cpu_count() or 8 if cores == "*" else int(cores))
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", n).config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CORVANE_DRIVER_MEMORY", "8g")).config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
