"""Snapshots of selector state: tables by round with an ordered index list and a config guard."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def config_digest(config: dict) -> str:
    """sha256 of the configuration as canonical JSON."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def save_round(table: DataFrame, path: str, round_: int, config: dict, size: int) -> None:
    """State rows (with their pos, repeats kept) under the round, and one metadata row."""
    table.write.mode("overwrite").parquet(f"{path}/round={round_}/state")
    meta = table.sparkSession.createDataFrame([(round_, config_digest(config), size)], "round int, digest string, size long")
    meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/round={round_}/meta")


def load_round(spark: SparkSession, path: str, round_: int, config: dict, size: int) -> DataFrame:
    """The state of a round; another configuration or data set size is an error."""
    meta = spark.read.parquet(f"{path}/round={round_}/meta").first()
    if meta["digest"] != config_digest(config):
        raise ValueError("the configuration has changed")
    if meta["size"] != size:
        raise ValueError(f"the data set has {size} rows, the state {meta['size']}")
    state = spark.read.parquet(f"{path}/round={round_}/state")
    return state.orderBy(F.col("pos")) if "pos" in state.columns else state
