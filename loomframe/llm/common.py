"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only a session within one process (as in tests) may leave it unset and gets a folder of its own.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomframe-"))
    return sc.getCheckpointDir()


#: Bytes of rows that a checkpointed file of a table of known size may hold.
FILE_BYTES = 32 << 20


def in_tasks(df: DataFrame, rows: int, row_bytes: int = 64) -> DataFrame:
    """A table of at most `rows` rows of about `row_bytes` in tasks of up to FILE_BYTES, but at least as many as there are cores, instead of one per shuffle partition."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * row_bytes // FILE_BYTES)))


def cut(df: DataFrame, rows: int | None = None, row_bytes: int = 64) -> DataFrame:
    """Checkpoint into the shared folder; Spark's cleaner takes the files away.  A table of known size is written in few files, as by `in_tasks`."""
    shared_folder(df.sparkSession)
    return (df if rows is None else in_tasks(df, rows, row_bytes)).checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Write as Parquet into the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) mod `modulus` is `remainder`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash_below(share: Column, *of: Column) -> Column:
    """True for about `share` of the values of `of`, always the same ones; for all if it is 1 or more."""
    return F.pmod(F.xxhash64(F.lit("sample"), *of), F.lit(1 << 52)) < share * float(1 << 52)


def free_names(df: DataFrame, *plain: str) -> tuple[DataFrame, list[str]]:
    """The table with its columns renamed _c0, _c1, ..., but for the columns `plain`, and the new names in order.

    Operators add columns of their own to the renamed table, so that no name of the input can clash with them.
    """
    names = [c if c in plain else f"_c{i}" for i, c in enumerate(df.columns)]
    return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)]), names


def own_names(df: DataFrame, names: list[str], columns: list[str]) -> DataFrame:
    """Undoes `free_names`."""
    return df.select(*[F.col(n).alias(c) for n, c in zip(names, columns)])
