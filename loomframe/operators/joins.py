"""Key joins: bijection checks, fallback chains, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row of counts: blank and repeated keys of either side, missing and extra ones."""
    l, r = (d.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "_l"), (right, "_r")))
    blank = F.coalesce(F.trim(F.col(key).cast("string")) == "", F.lit(True))
    both = l.withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit(""))).drop(key).join(r.withColumn("_k", F.coalesce(F.col(key).cast("string"), F.lit(""))).drop(key), "_k", "full_outer").withColumnRenamed("_k", key)
    blank = F.trim(F.col(key)) == ""
    return both.agg(
        F.sum(F.when(blank, F.coalesce("_l", F.lit(0)) + F.coalesce("_r", F.lit(0))).otherwise(0)).alias("blank"),
        F.count_if(~blank & (F.coalesce("_l", F.lit(0)) > 1)).alias("left_repeated"),
        F.count_if(~blank & (F.coalesce("_r", F.lit(0)) > 1)).alias("right_repeated"),
        F.count_if(~blank & F.col("_r").isNull()).alias("missing"),
        F.count_if(~blank & F.col("_l").isNull()).alias("extra"),
        F.count_if(~blank & F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
    )


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join, after a check that keys map one to one; fails closed otherwise."""
    c = bijection(left, right, key).first()
    if any(c[n] for n in ("blank", "left_repeated", "right_repeated", "missing", "extra")):
        raise ValueError(f"keys do not map one to one: {c.asDict()}")
    return left.join(right, key)


def fallback(left: DataFrame, right: DataFrame, row: str, keys: list[str], value: str) -> DataFrame:
    """row, value, via: by the first key that finds exactly one partner, then the next for rows still open."""
    open_, out = left, None
    for k in keys:
        unique = right.where(F.col(k).isNotNull()).groupBy(k).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value)).where("_n = 1").drop("_n")
        hit = open_.join(unique, k).select(row, value, F.lit(k).alias("via"))
        out = hit if out is None else out.unionByName(hit)
        open_ = open_.join(hit.select(row), row, "left_anti")
    rest = open_.select(row, F.lit(None).cast(dict(right.dtypes)[value]).alias(value), F.lit(None).cast("string").alias("via"))
    return out.unionByName(rest) if out is not None else rest


def excluded(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return items.join(seen.select(key), key, "left_anti")


def contained(batch: DataFrame, active: DataFrame, key: str) -> bool:
    """Whether every row's key is in the active set."""
    return batch.join(active.select(key), key, "left_anti").isEmpty()


def lookup(items: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner lookup; unmatched rows go.  The planner broadcasts a small table."""
    return items.join(table, key)


def subset(items: DataFrame, positions: DataFrame, key: str = "idx") -> DataFrame:
    """Rows by an ordered list (pos, key) with repeats."""
    return positions.join(items, key)


def split_columns(df: DataFrame, generation: list[str], row: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """(columns for generation, the rest), both with the row's position."""
    return df.select(row, *generation), df.drop(*generation)


def retrieved(queries: DataFrame, passages: DataFrame, k: int) -> DataFrame:
    """Top-k passages a query by similarity, from (idx, vec) and (ref, vec, value)."""
    from .selection import nearest_references

    return nearest_references(queries, passages, k)


def matched_text(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(text), F.lower(needle))
