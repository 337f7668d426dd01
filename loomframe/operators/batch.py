"""Batch verbs: positional relational operators over DataFrames that carry row_idx BIGINT.

Positions are data, never partition order.  Verbs that need the number of rows take it,
or count once; none sorts globally.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ROW = "row_idx"


def number_rows(df: DataFrame, order: list, start: int = 0, name: str = ROW) -> DataFrame:
    """Adds 0-based positions by the given natural order.

    Rows are range-partitioned and sorted, counted by partition, and numbered from the
    running count: no single task sees all rows.
    """
    d = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    d = d.persist()
    counts = {r["_pid"]: r["n"] for r in d.groupBy("_pid").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    bases, at = [], start
    for pid in sorted(counts):
        bases += [F.lit(pid), F.lit(at)]
        at += counts[pid]
    if not bases:
        return df.withColumn(name, F.lit(None).cast("long"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return d.withColumn(name, (F.create_map(*bases)[F.col("_pid")] + local).cast("long")).drop("_pid", "_mid")


def running_total(df: DataFrame, order: list, value: str, name: str) -> DataFrame:
    """Adds the running sum of `value` by an order that tells all rows apart, itself included.

    Range partitions are summed, and each starts from the sum of those before it: no task sees all rows.
    """
    d = df.repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()).persist()
    sums = {r["_pid"]: r["s"] for r in d.groupBy("_pid").agg(F.sum(value).alias("s")).collect()}  # one row a partition
    bases, at = [], 0
    for pid in sorted(sums):
        bases += [F.lit(pid), F.lit(at)]
        at += sums[pid]
    if not bases:
        return df.withColumn(name, F.col(value))
    within = F.sum(value).over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(name, F.create_map(*bases)[F.col("_pid")] + within).drop("_pid")


def project(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(ROW, *cols)


def pop(df: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """(the popped columns, the rest); missing columns are an error."""
    missing = set(cols) - set(df.columns)
    if missing:
        raise KeyError(f"no such columns: {sorted(missing)}")
    return df.select(ROW, *cols), df.drop(*cols)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones")
    return df.withColumnsRenamed(dict(zip(old, new)))


def gather(df: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows by positions(pos, row_idx), order and repeats kept; row_idx becomes pos."""
    return positions.join(df, ROW).drop(ROW).withColumnRenamed("pos", ROW)


def select_mask(df: DataFrame, mask: Column) -> DataFrame:
    return df.where(mask)


def slice_rows(df: DataFrame, start: int | None = None, end: int | None = None, step: int = 1, n: int | None = None) -> DataFrame:
    """Python's slice of positions; negative bounds count from the end."""
    n = df.count() if n is None and ((start or 0) < 0 or end is None or end < 0 or step < 0) else n
    a, b, s = slice(start, end, step).indices(n if n is not None else max(end or 0, 0))
    if s < 0:
        raise ValueError("step must be positive")
    return df.where((F.col(ROW) >= a) & (F.col(ROW) < b) & ((F.col(ROW) - a) % s == 0)).withColumn(ROW, F.floor((F.col(ROW) - a) / s))


def union_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """Positional one-to-one join; shared columns must agree (NaN and null equal themselves), or the query fails."""
    shared = [c for c in left.columns if c in right.columns and c != ROW]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    d = left.withColumn("_l", F.lit(1)).join(r.withColumn("_r", F.lit(1)), ROW, "full_outer")
    whole = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    d = d.withColumn(ROW, F.when(whole, F.col(ROW)).otherwise(F.raise_error(F.lit("batches differ in size")).cast("long")))
    for c in shared:
        d = d.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"column {c} differs")).cast(dict(left.dtypes)[c])))
    return d.drop("_l", "_r", *[f"_r_{c}" for c in shared])


def conflicts(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """One row: positions on both sides, and disagreements by column."""
    r = right.select(ROW, *[F.col(c).alias(f"_r_{c}") for c in columns])
    return left.join(r, ROW).agg(F.count(F.lit(1)).alias("matched"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_r_{c}"))).alias(c) for c in columns])


def concat(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL in list order, positions continued."""
    sizes = [p.agg(F.count(F.lit(1))).first()[0] for p in parts[:-1]]
    shifted, at = [], 0
    for p, n in zip(parts, [*sizes, 0]):
        shifted.append(p.withColumn(ROW, F.col(ROW) + at))
        at += n
    return reduce(lambda a, b: a.unionByName(b), shifted)


def chunk_id(n: int, chunks: int, padded: bool = False) -> Column:
    """The chunk of each position; sizes differ only if padding is allowed, by ceiling division."""
    if n % chunks and not padded:
        raise ValueError(f"{n} rows do not divide into {chunks} chunks")
    return F.floor(F.col(ROW) / -(-n // chunks)).cast("int")


def split_id(size: int) -> Column:
    return F.floor(F.col(ROW) / size).cast("int")


def repeat(df: DataFrame, times: int, interleave: bool = True, n: int | None = None) -> DataFrame:
    """Every row `times` times: aabb, or abab."""
    if times <= 0:
        return df.limit(0)
    n = df.count() if n is None and not interleave else n
    d = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return d.withColumn(ROW, F.col(ROW) * times + F.col("_k") if interleave else F.col("_k") * n + F.col(ROW)).drop("_k")


def repeat_each(df: DataFrame, counts: Column) -> DataFrame:
    """Row-wise repeat counts; 0 drops the row.  The copy's number is in `copy`."""
    return df.withColumn("_c", counts).where("_c > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).drop("_c")


def unfold(df: DataFrame, parts: int, columns: list[str]) -> DataFrame:
    """Splits array columns into `parts` rows each, other columns repeated."""
    d = df.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    for c in columns:
        w = (F.size(c) / parts).cast("int")
        d = d.withColumn(c, F.slice(c, F.col("_k") * w + 1, w))
    return d.withColumn(ROW, F.col(ROW) * parts + F.col("_k")).drop("_k")


def fold(df: DataFrame, width: int) -> DataFrame:
    """Groups of `width` consecutive rows as one row of arrays."""
    cols = [c for c in df.columns if c != ROW]
    g = df.groupBy(F.floor(F.col(ROW) / width).alias("_g")).agg(F.array_sort(F.collect_list(F.struct(ROW, *cols))).alias("_rows"))
    return g.select(F.col("_g").alias(ROW), *[F.col(f"_rows.{c}").alias(c) for c in cols])


def unfold_rows(df: DataFrame) -> DataFrame:
    """The inverse of fold."""
    cols = [c for c in df.columns if c != ROW]
    w = F.size(cols[0])
    d = df.withColumn("_w", w).select(ROW, "_w", F.posexplode(F.arrays_zip(*cols)).alias("_i", "_x"))
    return d.select((F.col(ROW) * F.col("_w") + F.col("_i")).alias(ROW), *[F.col(f"_x.{c}").alias(c) for c in cols])


def inverse(permutation: DataFrame) -> DataFrame:
    """(pos, row_idx) turned round."""
    return permutation.select(F.col(ROW).alias("pos"), F.col("pos").alias(ROW))


def pad_to_divisor(df: DataFrame, divisor: int, n: int | None = None) -> tuple[DataFrame, int]:
    """Appends leading rows, cyclically, until the size divides; (batch, number appended)."""
    n = df.count() if n is None else n
    if n == 0:
        return df, 0
    more = -n % divisor
    if not more:
        return df, 0
    extra = df.where(F.col(ROW) < min(more, n)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit((more - 1) // n)))).withColumn(ROW, F.col("_k") * n + F.col(ROW)).drop("_k")
    extra = extra.where(F.col(ROW) < more).withColumn(ROW, F.col(ROW) + n)
    return df.unionByName(extra), more


def unpad(df: DataFrame, pad: int, n: int) -> DataFrame:
    """Drops the last `pad` of `n` rows."""
    return df.where(F.col(ROW) < n - pad) if pad else df


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, n: int | None = None, drop_last: bool = False) -> DataFrame:
    """epoch, batch and place of every row; keyed shuffles by epoch if a seed is given; `drop_last` leaves an unfinished batch out."""
    n = df.count() if n is None else n
    if n % size and not drop_last:
        raise ValueError(f"{n} rows do not divide into batches of {size}")
    d = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    if seed is not None:
        # positions over all epochs, less the rows of the epochs before
        d = number_rows(d.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", ROW)), ["epoch", "_h", ROW], name="place").drop("_h")
        d = d.withColumn("place", F.col("place") - F.col("epoch") * F.lit(n))
    else:
        d = d.withColumn("place", F.col(ROW))
    return d.withColumn("batch", F.floor(F.col("place") / size).cast("int")).where(F.col("place") < n // size * size)


def equal_batches(a: DataFrame, b: DataFrame) -> bool:
    """Same rows with the same values, NaN equal to itself."""
    return set(a.columns) == set(b.columns) and a.select(*sorted(a.columns)).exceptAll(b.select(*sorted(b.columns))).isEmpty() and b.select(*sorted(b.columns)).exceptAll(a.select(*sorted(a.columns))).isEmpty()


def collected(metrics: DataFrame, part: str = "part") -> DataFrame:
    """name, values: a list per metric name in part order, as concatenated batches keep their metrics."""
    return metrics.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct(part, "value"))), lambda x: x["value"]).alias("values"))


def prefixed(metrics: DataFrame, prefix: str) -> DataFrame:
    return metrics.withColumn("name", F.concat(F.lit(prefix), F.col("name")))


def with_meta(df: DataFrame, **meta) -> DataFrame:
    """Per-batch values as literal columns."""
    return df.withColumns({k: F.lit(v) for k, v in meta.items()})


def describe(df: DataFrame) -> dict:
    """Column types; sizes are for the planner."""
    return dict(df.dtypes)


def dispatch(df: DataFrame, ranks: int, one_to_all: bool = False) -> DataFrame:
    """Rows per rank: shards by contiguous position, or every row on every rank."""
    if one_to_all:
        return df.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    n = max(df.count(), 1)
    return df.withColumn("rank", F.least(F.floor(F.col(ROW) * ranks / n), F.lit(ranks - 1)).cast("int"))


DISPATCH: dict = {}


def register_dispatch(name: str, spread, gather_back=None):
    """A named way to deal rows to ranks, and to put results together (by default: one replica, in row order)."""
    if name in DISPATCH and DISPATCH[name][0] is not spread:
        raise ValueError(f"dispatch mode {name} is taken")
    DISPATCH[name] = (spread, gather_back or (lambda d: d.dropDuplicates([ROW]).drop("rank")))


register_dispatch("shards", lambda d, ranks: dispatch(d, ranks))
register_dispatch("one_to_all", lambda d, ranks: dispatch(d, ranks, one_to_all=True))


def run_on_ranks(df: DataFrame, mode: str, ranks: int, fn) -> DataFrame:
    """fn over the dealt rows (a DataFrame with `rank`), collected again by the mode."""
    spread, back = DISPATCH[mode]
    return back(fn(spread(df, ranks)))
