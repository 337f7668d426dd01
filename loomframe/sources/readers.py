"""Sources and sinks: Parquet and JSON scans, samples, dumps, metric sinks, caches."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators.selection import first_rows

LOADERS: dict[str, Callable[..., DataFrame]] = {}


def register_loader(name: str):
    def put(fn):
        if LOADERS.get(name, fn) is not fn:
            raise ValueError(f"loader {name} is taken")
        LOADERS[name] = fn
        return fn

    return put


def load(spark: SparkSession, name: str, *args, **options) -> DataFrame:
    if name not in LOADERS:
        raise ValueError(f"unknown loader {name}")
    return LOADERS[name](spark, *args, **options)


def scan(spark: SparkSession, paths: str | list[str], schema=None) -> DataFrame:
    """Parquet, JSON and JSONL files as one table; columns that some lack are null."""
    parts = []
    for p in [paths] if isinstance(paths, str) else paths:
        kind = p.rstrip("/*").rsplit(".", 1)[-1].lower()
        reader = spark.read.schema(schema) if schema else spark.read
        if kind == "parquet":
            parts.append(reader.parquet(p))
        elif kind in ("json", "jsonl"):
            parts.append(reader.json(p))
        else:
            raise ValueError(f"unsupported file {p}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sample(df: DataFrame, n: int, key: str = "row_idx", seed: int | None = None) -> DataFrame:
    """The first n rows by key, or a keyed choice of n without replacement; all rows for a negative n.  Sample before any filter."""
    if n < 0:
        return df
    order = [F.xxhash64(F.lit(seed), key), F.col(key)] if seed is not None else [F.col(key)]
    return first_rows(df, n, *order)


def short_enough(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most `most` tokens; a length that cannot be computed (null) drops the row."""
    return df.where(F.coalesce(length <= most, F.lit(False)))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(text.isNull(), None).when(t == "", 0).otherwise(F.size(F.split(t, " ")))


@register_loader("prompts")
def prompts(spark: SparkSession, paths, key: str = "row_idx", most_rows: int = -1, seed: int | None = None, most_tokens: int | None = None, prompt: str = "prompt") -> DataFrame:
    """Scan, sample, then length filter, in this order."""
    df = sample(scan(spark, paths), most_rows, key, seed)
    return df if most_tokens is None else short_enough(df, word_count(F.col(prompt)), most_tokens)


@register_loader("conversations")
def conversations(spark: SparkSession, paths, messages: str = "messages", most_rows: int = -1, key: str = "row_idx") -> DataFrame:
    df = sample(scan(spark, paths), most_rows, key)
    for c, kind in (("tools", "string"), ("enable_thinking", "boolean")):
        df = df if c in df.columns else df.withColumn(c, F.lit(None).cast(kind))
    return df.withColumnRenamed(messages, "messages")


@register_loader("preferences")
def preferences(spark: SparkSession, paths) -> DataFrame:
    return scan(spark, paths).select("prompt", "chosen", "rejected")


def appended(df: DataFrame, made: DataFrame, length: Column | None = None, most: int | None = None) -> DataFrame:
    """A data set with generated rows, the length filter applied to them too."""
    made = short_enough(made, length, most) if most is not None else made
    return df.unionByName(made, allowMissingColumns=True)


def save(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def dump_rows(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """input, output, gts, score, step and the extra columns, score being the sum of token scores."""
    return df.select("input", "output", "gts", A.total("token_scores").alias("score"), "step", *(extra or []))


def dump_generations(df: DataFrame, path: str) -> None:
    """JSON lines, a folder per step."""
    df.write.mode("append").partitionBy("step").json(path)


def read_dumps(spark: SparkSession, glob: str) -> DataFrame:
    """All rows with run and step from their paths (.../<run>_val/<step>.jsonl)."""
    df = spark.read.option("mode", "DROPMALFORMED").json(glob).withColumn("_f", F.input_file_name())
    return df.withColumn("run", F.regexp_extract("_f", r"([^/]+)_val/[^/]*$", 1)).withColumn("step", F.regexp_extract("_f", r"(\d+)\.jsonl$", 1).cast("long")).drop("_f")


def rescored(df: DataFrame, keys: list[str], acc: Column, fmt: Column | None = None) -> DataFrame:
    """Mean accuracy, format and score by run and step; nulls are skipped."""
    return df.groupBy(*keys).agg(F.avg(acc).alias("acc"), *([F.avg(fmt).alias("format")] if fmt is not None else []), F.count(F.lit(1)).alias("n")).orderBy(*keys)


def masked_lines(df: DataFrame, column: str, needles: list[str], mask: str = "*") -> DataFrame:
    """Literal substrings replaced by a mask."""
    out = F.col(column)
    for n in needles:
        out = F.replace(out, F.lit(n), F.lit(mask))
    return df.withColumn(column, out)


def reward_counts(df: DataFrame, threshold: float, index=("sample_index", "dataset_idx", "index"), reward=("reward", "acc", "score")) -> DataFrame:
    """idx, total, correct from logs whose index and reward stand in the first non-null of several columns."""
    pick = lambda names: F.coalesce(*[F.col(c) for c in names if c in df.columns])
    d = df.select(pick(index).cast("long").alias("idx"), pick(reward).cast("double").alias("r")).where("idx is not null and r is not null")
    return d.groupBy("idx").agg(F.count(F.lit(1)).alias("total"), F.sum((F.col("r") >= threshold).cast("long")).alias("correct"))


def merged_counts(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("idx").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, made and written the first time."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class Tracking:
    """Appends metrics (name, step, value) to named sinks; "console" prints, any other name is a table path."""

    def __init__(self, spark: SparkSession, sinks: list[str]):
        self.spark, self.sinks = spark, sinks

    def log(self, metrics: dict[str, float], step: int) -> None:
        rows = [(k, step, float(v)) for k, v in sorted(metrics.items())]
        for sink in self.sinks:
            if sink == "console":
                print(f"step {step}: " + ", ".join(f"{k}={v:.6g}" for k, _, v in rows))
            elif rows:
                self.spark.createDataFrame(rows, "name string, step long, value double").coalesce(1).write.mode("append").parquet(sink)
