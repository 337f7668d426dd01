"""Workload-balanced partitioning, micro-batching and dispatch orders.

The differencing and greedy partitioners are sequential by nature.  They run on one group
of rows at a time (a global batch), inside applyInPandas; groups run in parallel.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def workload(length: Column) -> Column:
    """Fixed value 24576: the linear part against the quadratic one."""
    return 24576 * length + length * length


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    return ceil_div(a, b) * b


def largest_differencing(weights: list[float], k: int, equal: bool = False) -> list[list[int]]:
    """k sets of indices by repeatedly merging the two partial partitions of the widest spread.

    A partial partition keeps its sets by falling sum; merging pairs the heaviest set of one with the
    lightest of the other.  With `equal`, rows enter as k-tuples of neighbours in weight order, so all sets
    grow alike.  Ties are settled by heavier sets first, then by smaller indices.
    """
    n = len(weights)
    if equal and n % k:
        raise ValueError(f"{n} items do not divide into {k} equal sets")
    order = sorted(range(n), key=lambda i: (weights[i], i))
    if equal:
        start = [[(weights[i], (i,)) for i in order[a : a + k]] for a in range(0, n, k)]
    else:
        start = [[(weights[i], (i,))] + [(0.0, ())] * (k - 1) for i in order]
    heap = []

    def push(sets) -> None:
        sets = sorted(sets, key=lambda s: (-s[0], -len(s[1]), s[1]))
        heapq.heappush(heap, (-(sets[0][0] - sets[-1][0]), -sets[0][0], sets[0][1], sets))

    for sets in start:
        push(sets)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        push([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))])
    final = heap[0][3] if heap else [(0.0, ())] * k
    return [sorted(s[1]) for s in final]


def greedy(weights: list[float], k: int, equal: bool = False) -> list[list[int]]:
    """Items in input order to the least loaded set (lowest number first); `equal` adds a bias that counts items first."""
    bias = sum(weights) + 1 if equal else 0
    heap = [(0.0, i) for i in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, w in enumerate(weights):
        load, j = heapq.heappop(heap)
        out[j].append(i)
        heapq.heappush(heap, (load + w + bias, j))
    if equal and len({len(s) for s in out}) > 1:
        raise ValueError("items do not divide into equal sets")
    return out


def checked(sets: list[list[int]], n: int) -> list[list[int]]:
    """Every set has items and every item stands in one set."""
    if any(not s for s in sets):
        raise ValueError("a set is empty")
    if sorted(i for s in sets for i in s) != list(range(n)):
        raise ValueError("sets do not cover the items once")
    return sets


def partitioned(df: DataFrame, keys: list[str], weight: str, k: int, equal: bool = False, method: str = "differencing") -> DataFrame:
    """Adds part, 0..k-1, within each group of keys; row_idx orders ties.  A group of fewer rows than parts is an error."""
    import pandas as pd

    pick = {"differencing": largest_differencing, "greedy": greedy}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx").reset_index(drop=True)
        part = pd.Series(0, index=pdf.index)
        for p, items in enumerate(checked(pick([float(w) for w in pdf[weight]], k, equal), len(pdf))):
            part.iloc[items] = p
        return pdf.assign(part=part.astype("int32"))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", part int"
    return df.groupBy(*keys).applyInPandas(run, schema)


def group_partitioned(df: DataFrame, keys: list[str], uid: str, weight: str, k: int) -> DataFrame:
    """Adds part so that consecutive rows of a uid stay together and every part has as many runs."""
    from .advantages import runs

    d = runs(df, key=uid, partition=keys[0] if keys else None)
    per = d.groupBy(*keys, "run").agg(F.sum(weight).alias("_w")).withColumnRenamed("run", "row_idx")
    parts = partitioned(per, keys, "_w", k, equal=True).select(*keys, F.col("row_idx").alias("run"), "part")
    return d.join(parts, [*keys, "run"]).drop("run", "run_pos")


def imbalance(df: DataFrame, keys: list[str], weight: str, k: int) -> DataFrame:
    """min, max, mean of part sums for contiguous chunks (before) and for `part` (after)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("row_idx")) - 1
    before = df.withColumn("_b", F.floor(at * k / n))
    out = []
    for name, col in (("before", "_b"), ("after", "part")):
        s = before.groupBy(*keys, col).agg(F.sum(weight).alias("_s"))
        out.append(s.groupBy(*keys).agg(F.min("_s").alias(f"min_{name}"), F.max("_s").alias(f"max_{name}"), F.avg("_s").alias(f"mean_{name}")))
    return out[0].join(out[1], keys)


def micro_batch_count(total_tokens: int, n: int, most_tokens: int, least: int | None = None, multiple: int | None = None) -> int:
    k = min(n, ceil_div(total_tokens, most_tokens))
    k = max(k, least or 1)
    return round_up(k, multiple) if multiple else k


def bubble_order(parts: DataFrame, keys: list[str], load: str, odd_last: bool = True) -> DataFrame:
    """Adds place: parts by falling load, even ranks reversed first, then odd ones, so that light parts stand at both ends."""
    w = Window.partitionBy(*keys).orderBy(F.desc(load), "part")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rank = F.row_number().over(w) - 1
    evens = F.ceil(n / 2)
    place = F.when(rank % 2 == 0, evens - 1 - rank / 2).otherwise(evens + (rank - 1) / 2)
    return parts.withColumn("place", place.cast("int"))


def rank_order(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Adds place within a part: rising workload at even ranks, then odd ranks falling."""
    w = Window.partitionBy(*keys, "part")
    rank = F.row_number().over(w.orderBy(weight, "row_idx")) - 1
    n = F.count(F.lit(1)).over(w)
    evens, odds = F.ceil(n / 2), F.floor(n / 2)
    place = F.when(rank % 2 == 0, rank / 2).otherwise(evens + odds - 1 - (rank - 1) / 2)
    return df.withColumn("place", place.cast("int"))


def micro_batches(df: DataFrame, keys: list[str], length: str, most_tokens: int) -> DataFrame:
    """Adds part by balancing each group of keys into as many micro-batches as its tokens need."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_idx").reset_index(drop=True)
        lengths = [int(x) for x in pdf[length]]
        k = micro_batch_count(sum(lengths), len(lengths), most_tokens)
        part = pd.Series(0, index=pdf.index)
        for p, items in enumerate(largest_differencing([24576.0 * x + float(x) * x for x in lengths], k)):
            part.iloc[items] = p
        return pdf.assign(part=part.astype("int32"))

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", part int"
    return df.groupBy(*keys).applyInPandas(run, schema)


def sticky_server(request_id: Column, servers: int) -> Column:
    """Requests of one id go to one server."""
    return F.pmod(F.xxhash64(request_id), F.lit(servers)).cast("int")
