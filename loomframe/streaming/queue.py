"""The bounded sample stream: drop-oldest queue, count windows, staleness by version.

Streams are keyed by `queue`, and seq orders a queue's samples.  The batch functions
state the semantics over finished logs; the stateful ones do the same over Structured
Streaming with a state store, one state per queue.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, order: list, queue: list[str] | None = None) -> DataFrame:
    """Adds seq from 1 by arrival order within a queue."""
    w = Window.partitionBy(*(queue or [])).orderBy(*order)
    return df.withColumn("seq", F.row_number().over(w))


def kept_in_queue(df: DataFrame, capacity: int, queue: list[str] | None = None) -> DataFrame:
    """What a drop-oldest queue without consumer holds after all arrivals: the last `capacity` of each."""
    keys = queue or []
    last = df.groupBy(*keys).agg(F.max("seq").alias("_last"))
    d = df.join(last, keys) if keys else df.crossJoin(F.broadcast(last))
    return d.where(F.col("seq") > F.col("_last") - capacity).drop("_last")


def queue_statistics(df: DataFrame, capacity: int, queue: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return df.groupBy(*queue).agg(n.alias("produced"), F.greatest(n - capacity, F.lit(0)).alias("dropped"), F.least(n, F.lit(capacity)).alias("size"))


def count_windows(df: DataFrame, size: int, queue: list[str] | None = None, drop_tail: bool = True) -> DataFrame:
    """Adds window, tumbling by count; an incomplete last one goes."""
    d = df.withColumn("window", F.floor((F.col("seq") - 1) / size))
    if not drop_tail:
        return d
    keys = queue or []
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(n, keys) if keys else d.crossJoin(F.broadcast(n))
    return d.where((F.col("window") + 1) * size <= F.col("_n")).drop("_n")


def versions(df: DataFrame, every: int) -> DataFrame:
    """Adds version: parameters advance every so many windows."""
    return df.withColumn("version", F.floor(F.col("window") / every))


def staleness(df: DataFrame, keys: list[str], current: str = "version", made: str = "made_version") -> DataFrame:
    """Per key: samples, stale ones (at least one version old, counted and kept), greatest lag."""
    lag = F.col(current) - F.col(made)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"), F.count_if(lag >= 1).alias("stale"), F.max(lag).alias("max_lag"))


def required_samples(window: int, staleness_share: float, sync_steps: int) -> int:
    """Samples that may be in flight before generation must pause."""
    return int(window * (staleness_share + 1) * sync_steps)


def paused(queued: int, capacity: int, stale: int, cap: int) -> bool:
    return queued >= capacity or stale >= cap


def synced(df: DataFrame, every: int, shut_down: int | None = None) -> DataFrame:
    """Adds version and left, the samples taken since the last parameter update; the count of stale samples starts anew with every update.

    From window `shut_down` on nothing is taken any more.
    """
    d = versions(df, every) if shut_down is None else versions(df.where(F.col("window") < shut_down), every)
    w = Window.partitionBy(*[c for c in ("queue",) if c in df.columns], "version").orderBy("seq")
    return d.withColumn("left", F.row_number().over(w))


def without_cancelled(df: DataFrame, cancelled: DataFrame, key: str = "sample_id") -> DataFrame:
    """Samples less those whose generation was cancelled; they are neither queued nor counted as dropped."""
    return df.join(cancelled.select(key).distinct(), key, "left_anti")


def window_statistics(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """mean, max, min, p50, p95, p99 and number of versions of each window."""
    from ..operators.metrics import percentiles

    v = df.groupBy(*keys).agg(F.countDistinct("version").alias("versions"))
    return percentiles(df, keys, value).join(v, keys)


def traced(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """All rows of n keys chosen by keyed hash."""
    keys = df.select(key).distinct().orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")


def ready_rows(df: DataFrame, required: list[str], consumed: DataFrame, task: str, key: str = "row_idx") -> DataFrame:
    """Rows whose required columns are all there and that the task has not consumed."""
    d = df
    for c in required:
        d = d.where(F.col(c).isNotNull())
    return d.join(consumed.where(F.col("task") == task).select(key), key, "left_anti")


# ---- Structured Streaming


def bounded_queue_stream(stream: DataFrame, capacity: int) -> DataFrame:
    """queue, produced, dropped, size, oldest_seq, newest_seq after every micro-batch, from (queue, seq)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        produced, dropped, held = state.get if state.exists else (0, 0, [])
        held = list(held)
        for pdf in batches:
            for seq in sorted(pdf["seq"]):
                produced += 1
                held.append(int(seq))
        over = max(0, len(held) - capacity)
        dropped, held = dropped + over, held[over:]
        state.update((produced, dropped, held))
        yield pd.DataFrame([{"queue": key[0], "produced": produced, "dropped": dropped, "size": len(held), "oldest_seq": held[0] if held else None, "newest_seq": held[-1] if held else None}])

    kind = dict(stream.dtypes)["queue"]
    return stream.groupBy("queue").applyInPandasWithState(
        step, f"queue {kind}, produced long, dropped long, size long, oldest_seq long, newest_seq long", "produced long, dropped long, held array<long>", "update", GroupStateTimeout.NoTimeout
    )


def count_window_stream(stream: DataFrame, size: int) -> DataFrame:
    """queue, window, first_seq, last_seq, total for every full window, from (queue, seq, value); the tail waits in the state."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        window, seqs, values = state.get if state.exists else (0, [], [])
        rows = sorted([*zip(seqs, values), *((int(s), float(v)) for pdf in batches for s, v in zip(pdf["seq"], pdf["value"]))])
        out = []
        while len(rows) >= size:
            full, rows = rows[:size], rows[size:]
            out.append({"queue": key[0], "window": window, "first_seq": full[0][0], "last_seq": full[-1][0], "total": sum(v for _, v in full)})
            window += 1
        state.update((window, [s for s, _ in rows], [v for _, v in rows]))
        if out:
            yield pd.DataFrame(out)

    kind = dict(stream.dtypes)["queue"]
    return stream.groupBy("queue").applyInPandasWithState(
        step, f"queue {kind}, window long, first_seq long, last_seq long, total double", "window long, seqs array<long>, vals array<double>", "append", GroupStateTimeout.NoTimeout
    )
