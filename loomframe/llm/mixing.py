"""Mixing sources to target weights by weighted fair queueing.

Every pass over a document gets a virtual finish time: the source's tokens up to and
including it, in a shuffled but fixed order, over the source's target.  A source may be read up to `most`
times; what its target would need beyond that is reshared among the others by weight, so targets
add up to the budget and the budget is spent at virtual time 1: passes that end by then are taken, and
of the one pass of each source that runs across it what comes nearer to the target.  `mixed`
delivers the passes range-sorted by virtual time over the whole corpus, truncated there.

No window runs over a whole source: equal rows are counted first, a source's order is cut into slices by the leading
bits of the order key, and slices are summed level by level, 2**LEVEL of them at a time, so a source with most
of all rows spreads over as many tasks as it has slices and no window holds more than a slice or a level.

Defined cases: a null text has size 0 and is never taken; a null source is a source of
its own and sorts last; without any word all targets are 0; rows that agree in id, source and text are exchangeable and
take their passes by number; a source whose only document is larger than its target takes it if
that is nearer than nothing; an empty table gives an empty result; extra columns of any name pass through `mixed`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_names
from .tokens import SPACE_TABLE, pieces, text_bytes, words

MOST = 3
#: Rows that a slice holds about, and bits of the order key that a level adds.
SLICE_ROWS, LEVEL = 2_000, 10


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    for batch in batches:
        data, off = text_bytes(batch.column("text"))
        n = [np.diff(words(data[off[a] : off[b]], off[a : b + 1] - off[a], SPACE_TABLE)[3]) for a, b in pieces(off, 1 << 20)]
        size = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
        i = batch.schema.names.index("text")
        yield pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != i] + [size], names=[c for c in batch.schema.names if c != "text"] + ["size"])


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, h (hash of the text) and size in words of every document."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("h"), "text").mapInArrow(
        _sizes, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, source string, h long, size long"
    )


def cyclic_weight() -> Column:
    """Weights 1, 2, 3, repeating, over sources by code point, null last."""
    return ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double")


def targets(totals: DataFrame, weight: Column, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    Sources are ordered by how soon they reach `most` times their size; the capped ones
    are a prefix of that order, and one running sum finds the level of the rest.
    """
    t = totals.withColumn("weight", weight).withColumn("room", most * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("room") >= F.col("level") * F.col("weight"), F.col("level")), ignorenulls=True).over(whole)
    return t.withColumn("level", level).select("source", "source_size", F.least("room", F.coalesce(F.col("level") * F.col("weight"), F.col("room"))).alias("target"))


def running(df: DataFrame, bits: int) -> DataFrame:
    """Adds upto, the running sum of `sum` per source in the order of `key`, itself included.

    The order is cut into 2**bits slices by the key's leading bits.  Sums of slices are cut again, LEVEL bits
    at a time, and every level adds what stands before within the next one.
    """
    key, same = F.col("key"), ["source"]
    before = F.coalesce(F.sum("sum").over(Window.partitionBy("source", "above").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = None
    for level in range(LEVEL, bits + LEVEL, LEVEL):
        b = min(level, bits)
        per = df.groupBy("source", F.shiftright(key, 64 - b).alias("slice")).agg(F.sum("sum").alias("sum"))
        # the first level has at most 2**LEVEL slices of a source
        per = per.withColumn("above", F.shiftright("slice", b - (level - LEVEL)) if level > LEVEL else F.lit(0).cast("long"))
        per = per.select("source", "slice", "above", before.alias("base"))
        if base is not None:
            up = base.select(F.col("source").alias("_source"), F.col("slice").alias("_above"), F.col("base").alias("_base"))
            per = per.join(up, F.col("source").eqNullSafe(F.col("_source")) & (F.col("above") == F.col("_above"))).select("source", "slice", (F.col("base") + F.col("_base")).alias("base"))
        base = per.select("source", "slice", "base")
    base = base.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), "base")
    within = F.sum("sum").over(Window.partitionBy(*same, "slice").orderBy("key", "doc_id", "h", "size").rowsBetween(Window.unboundedPreceding, 0))
    d = df.withColumn("slice", F.shiftright(key, 64 - bits)).withColumn("within", within)
    return d.join(base, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))).withColumn("upto", F.col("base") + F.col("within")).drop("slice", "within", "_source", "_slice", "base")


def queue(docs: DataFrame, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """source, doc_id, h, size, rows, source_size, target and number (array) of every distinct document.

    number[e] says how many of the document's equal rows pass e takes; it does not increase with e.
    """
    d = sizes(docs).withColumn("key", F.xxhash64(F.lit("order"), "doc_id", "source", "h", "size"))
    d = d.groupBy("source", "key", "doc_id", "h", "size").agg(F.count(F.lit(1)).alias("rows")).withColumn("sum", F.col("size") * F.col("rows"))
    d = cut(d)
    totals = d.groupBy("source").agg(F.sum("sum").alias("source_size"))
    per = targets(totals, weight if weight is not None else cyclic_weight(), most).withColumnRenamed("source", "_source")
    bits = max(1, d.count() // SLICE_ROWS).bit_length()
    d = running(d, bits)
    d = d.join(F.broadcast(per) if _few(per) else per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    def taken(e: Column) -> Column:
        """Of the rows j = 1, 2, ... whose passes end at start + j * size tokens: those that end by the target, or are nearer to it with it than without."""
        start = e * F.col("source_size") + F.col("upto") - F.col("sum")
        j = F.ceil((F.col("target") - start) / F.col("size") + 0.5) - 1
        return F.least(F.greatest(j, F.lit(0)), F.col("rows")).cast("long")

    number = F.when(F.col("size") > 0, F.transform(F.sequence(F.lit(0), F.lit(most - 1)), taken)).otherwise(F.array_repeat(F.lit(0).cast("long"), most))
    return d.withColumn("number", number).drop("key", "sum")


def mix(docs: DataFrame, weight: Column | None = None, most: int = MOST) -> DataFrame:
    """doc_id, size, source, source_size, target, taken for every document."""
    each = queue(docs, weight, most).withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    taken = F.size(F.filter("number", lambda k: k >= F.col("j"))) * F.col("size")
    return each.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def _few(per: DataFrame, most: int = 10_000) -> bool:
    """Whether there are so few sources that their table (under 1 MB) may be broadcast."""
    return per.limit(most + 1).count() <= most


def digest(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame) -> DataFrame:
    """The documents (all columns), copy and virtual_time: a row for every pass over a document that the mix takes, range-sorted by virtual time.

    Rows that agree in id, source and text are told apart by a number.
    """
    plan = queue(docs).where(F.col("number")[0] > 0)
    names = {c: f"_m{i}" for i, c in enumerate(plan.columns)}
    plan = plan.select(*[F.col(c).alias(n) for c, n in names.items()])
    free, inner = free_names(docs)
    of = dict(zip(docs.columns, inner))
    doc, source = F.col(of["doc_id"]), F.col(of["source"]).cast("string")
    d = free.withColumn("_h", F.xxhash64(of["text"]))
    same = doc.eqNullSafe(F.col(names["doc_id"])) & source.eqNullSafe(F.col(names["source"])) & (F.col("_h") == F.col(names["h"]))
    d = d.join(plan, same)
    rows, number = F.col(names["rows"]), F.col(names["number"])
    # most documents stand alone and need no number
    numbered = d.where(rows > 1).withColumn("_j", F.row_number().over(Window.partitionBy(of["doc_id"], of["source"], "_h").orderBy(*inner_order(docs, inner))))
    d = d.where(rows == 1).withColumn("_j", F.lit(1)).unionByName(numbered)
    d = d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(MOST)))).where(F.element_at(number, F.col("_copy")) >= F.col("_j"))
    tokens = (F.col("_copy") - 1) * F.col(names["source_size"]) + F.col(names["upto"]) - (rows - F.col("_j")) * F.col(names["size"])
    d = d.withColumn("_at", tokens / F.col(names["target"])).repartitionByRange("_at", of["doc_id"]).sortWithinPartitions("_at", of["doc_id"])
    new = [n if n not in docs.columns else f"{n}_" for n in ("copy", "virtual_time")]
    return d.select(*[F.col(n).alias(c) for n, c in zip(inner, docs.columns)], F.col("_copy").alias(new[0]), F.col("_at").alias(new[1]))


def inner_order(docs: DataFrame, names: list[str]) -> list[Column]:
    """The columns that can be ordered by."""
    from pyspark.sql import types as T

    return [F.col(n) for f, n in zip(docs.schema.fields, names) if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def brute(rows: list[tuple], most: int = MOST) -> dict:
    """Passes taken of (source, size, order) rows by plain queueing: sort every source, walk its passes while they bring it nearer (for tests).

    Rows are (source, size, place): place orders a source.  The result lists taken words by row.
    """
    of: dict = {}
    for i, (source, size, place) in enumerate(rows):
        of.setdefault(source, []).append((place, i, size))
    order = sorted((s for s in of if s is not None)) + ([None] if None in of else [])
    total = {s: sum(x[2] for x in of[s]) for s in of}
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        left = sum(total.values()) - sum(most * total[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: float(most * total[s]) if s in capped else left * weight[s] / free for s in order}
        over = {s for s in order if target[s] > most * total[s] and s not in capped}
        if not over:
            break
        capped |= over
    taken = [0] * len(rows)
    for s in order:
        done = 0
        for _, i, size in sorted(of[s]) * most:
            if abs(done + size - target[s]) < abs(done - target[s]):
                taken[i] += size
            done += size
    return {"taken": taken, "target": target, "total": total}
