"""Metric aggregation: batch statistics, validation metrics, name-driven and cross-rank reduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as A
from .batch import running_total


def response_info(df: DataFrame) -> DataFrame:
    """Adds prompt_length and response_length from attention_mask and the response's width."""
    n = A.count_mask("attention_mask")
    r = A.count_mask(F.slice("attention_mask", -F.size("responses"), F.size("responses")))
    return df.withColumn("response_length", r).withColumn("prompt_length", n - r)


def data_metrics(df: DataFrame, critic: bool = True) -> DataFrame:
    """One row of batch statistics from score, reward, mask, advantages, returns[, values], prompt_length, most.

    Rows with an empty response are aborted and left out of scores and rewards; a batch of such
    rows only is an error.  `most` is the response's widest length.
    """
    n = A.count_mask("mask")
    ok = n > 0

    def three(name: str, c: Column) -> list[Column]:
        return [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]

    def tokens(name: str, col: str) -> list[Column]:
        v = A.keep_valid(col, "mask")
        return [(F.sum(A.total(v)) / F.sum(n)).alias(f"{name}_mean"), F.max(F.array_max(v)).alias(f"{name}_max"), F.min(F.array_min(v)).alias(f"{name}_min")]

    cols = three("score", F.when(ok, F.col("score"))) + three("reward", F.when(ok, F.col("reward")))
    cols += tokens("advantages", "advantages") + tokens("returns", "returns")
    if critic:
        diff = F.zip_with("returns", "values", lambda r, v: r - v)
        cols += tokens("values", "values")
        for name, v in (("_d", A.keep_valid(diff, "mask")), ("_r", A.keep_valid("returns", "mask"))):
            cols += [F.sum(A.total(v)).alias(f"{name}1"), F.sum(A.total(F.transform(v, lambda x: x * x))).alias(f"{name}2")]
        cols.append(F.sum(n).alias("_n"))
    cols += three("response_length", n) + three("prompt_length", F.col("prompt_length"))
    cols += [
        F.avg((n == F.col("most")).cast("double")).alias("response_clip_ratio"),
        F.avg((~ok).cast("double")).alias("aborted_ratio"),
        F.sum(ok.cast("int")).alias("_ok"),
        *[c.alias(c_name) for c, c_name in zip(three("x", F.when(ok, n)), ("response_length_non_aborted_mean", "response_length_non_aborted_max", "response_length_non_aborted_min"))],
    ]
    g = df.agg(*cols)
    g = g.withColumn("score_mean", F.when(F.col("_ok") > 0, F.col("score_mean")).otherwise(F.raise_error(F.lit("every response is aborted")).cast("double")))
    if critic:
        var = lambda p: (F.col(f"{p}2") - F.col(f"{p}1") * F.col(f"{p}1") / F.col("_n")) / (F.col("_n") - 1)
        g = g.withColumn("vf_explained_var", 1 - var("_d") / (var("_r") + 1e-5))
    return g.drop("_d1", "_d2", "_r1", "_r2", "_n", "_ok")


def timing_metrics(times: DataFrame, tokens: DataFrame) -> DataFrame:
    """name, seconds, ms_per_token from times(name, seconds) and one row (prompt_tokens, response_tokens); `gen` counts responses only."""
    all_ = F.col("prompt_tokens") + F.col("response_tokens")
    per = F.when(F.col("name") == "gen", F.col("response_tokens")).otherwise(all_)
    return times.crossJoin(F.broadcast(tokens)).select("name", "seconds", (F.col("seconds") * 1000 / per).alias("ms_per_token"))


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return tokens / (seconds * devices)


def variance_proxies(df: DataFrame, gradient_norm: float | None = None) -> DataFrame:
    """One row of proxies from mask, lp, pi2, advantages[, is_weights]."""
    pairs = F.zip_with("lp", "pi2", lambda a, b: 1 - 2 * F.exp(a) + b)
    raw = A.masked_sum(pairs, "mask")
    a = A.masked_mean("advantages", "mask")
    if "is_weights" in df.columns:
        w = A.masked_sum(F.zip_with(pairs, "is_weights", lambda p, x: p * x * x), "mask")
        power = F.pow(A.masked_mean("is_weights", "mask"), F.lit(2)) * a * a * F.greatest(raw, F.lit(0.0))
    else:
        w, power = raw, a * a * F.greatest(raw, F.lit(0.0))
    g = df.select(w.alias("w"), power.alias("p"), a.alias("a")).agg(F.avg("p").alias("total_power"), F.avg(F.col("a") * F.col("a")).alias("expected_a_squared"), F.avg("w").alias("expected_w"), F.count(F.lit(1)).alias("n"))
    signal = F.lit(float(gradient_norm or 0.0) ** 2)
    noise = F.when((F.col("n") > 1) & F.lit(gradient_norm is not None), F.greatest((F.col("total_power") - signal) / (F.col("n") - 1), F.lit(0.0))).otherwise(0.0)
    return g.select(signal.alias("signal_strength"), "total_power", noise.alias("pure_noise"), "expected_a_squared", "expected_w")


# ---- validation metrics


def majority(df: DataFrame, keys: list[str], vote: str, value: str, pos: str) -> DataFrame:
    """The first value of the most frequent vote of each group; ties go to the vote seen first."""
    g = df.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("_n"), F.min(pos).alias("_first"), F.min_by(value, pos).alias("_value"))
    return g.groupBy(*keys).agg(F.min_by("_value", F.struct(-F.col("_n"), F.col("_first"))).alias("maj"))


def sizes_for(n: Column) -> Column:
    """2, 4, 8, ... below n, then n (null for a single sample)."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.pow(F.lit(2.0), i).cast("int"))
    return F.when(n > 1, F.array_append(F.filter(powers, lambda k: k < n), n.cast("int")))


def extremes(sorted_values: Column, k: Column, best: bool = True) -> Column:
    """Exact mean of the best (or worst) of k draws with replacement from sorted values.

    The i-th smallest of N is the maximum with probability (i/N)^k - ((i-1)/N)^k.
    """
    n = F.size(sorted_values)
    v = sorted_values if best else F.reverse(sorted_values)
    w = F.transform(v, lambda x, i: x * (F.pow((i + 1) / n, k) - F.pow(i / n, k)))
    return A.total(w)


def sample_metrics(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, mean, std (population), and per k the exact best and worst of k, exploded in k."""
    g = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sort_array(F.collect_list(value)).alias("_v"))
    g = g.withColumn("k", F.explode_outer(sizes_for(F.col("n"))))
    return g.select(*keys, "n", "mean", "std", "k", extremes(F.col("_v"), F.col("k")).alias("best"), extremes(F.col("_v"), F.col("k"), False).alias("worst"))


def validation(df: DataFrame, source: str, uid: str, value: str, vote: str | None = None, pos: str | None = None) -> DataFrame:
    """source, name, value: per-prompt metrics averaged over prompts, named mean@n, std@n, best@k, worst@k, and maj@k if votes are given."""
    return averaged(prompt_metrics(df, source, uid, value, vote, pos), source)


def averaged(partial: DataFrame, source: str) -> DataFrame:
    """Averages over prompts from (source, uid, name, v); partial tables of different prompts may be united before."""
    return partial.groupBy(source, "name").agg(F.avg("v").alias("value"))


def prompt_metrics(df: DataFrame, source: str, uid: str, value: str, vote: str | None = None, pos: str | None = None) -> DataFrame:
    """source, uid, name, v of every prompt."""
    m = sample_metrics(df, [source, uid], value)
    one = m.groupBy(source, uid).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), F.first("std").alias("std"))
    at = lambda name, k: F.concat(F.lit(name + "@"), k.cast("string"))
    rows = one.select(source, uid, F.explode(F.array(F.struct(at("mean", F.col("n")).alias("name"), F.col("mean").alias("v")), F.struct(at("std", F.col("n")).alias("name"), F.when(F.col("n") > 1, F.col("std")).alias("v")))).alias("x"))
    more = m.where("k is not null").select(source, uid, F.explode(F.array(F.struct(at("best", F.col("k")).alias("name"), F.col("best").alias("v")), F.struct(at("worst", F.col("k")).alias("name"), F.col("worst").alias("v")))).alias("x"))
    out = rows.unionByName(more).where("x.v is not null").select(source, uid, "x.name", "x.v")
    if vote is None:
        return out
    maj = majority_of_k(df, [source, uid], vote, value, pos)
    return out.unionByName(maj.select(source, uid, at("maj", F.col("k")).alias("name"), F.col("maj_mean").alias("v")))


#: Numbers that one step over drawn samples holds at most, a single round of a single group apart.
DRAWN = 1 << 21


def _drawn(df: DataFrame, keys: list[str], value: str, pos: str, seed: int, rounds: int, run, out: str, vote: str | None = None) -> DataFrame:
    """keys and what run(values, codes, draws) makes of all groups of one size together; groups of one size share their draws.

    A group comes as one array by position, so that no call is made for a single group.  run gets values and codes of votes (groups, size),
    and draws(k), which yields (first round, positions (rounds, k)) in steps; it returns pairs of row numbers and columns.
    """
    import numpy as np
    import pyarrow as pa

    last = F.struct(F.isnull(pos).alias("_null"), F.col(pos).alias("_pos"), F.col(value).cast("double").alias("_v"), *([F.col(vote).alias("_vote")] if vote else []))
    g = df.groupBy(*keys).agg(F.array_sort(F.collect_list(last)).alias("_z")).select(*keys, F.col("_z._v").alias("_v"), *([F.col("_z._vote").alias("_vote")] if vote else []))
    kinds = [k.strip().split(" ") for k in out.split(",")]
    arrow = {"int": pa.int32(), "double": pa.float64()}

    def each(batches):
        import pandas as pd

        kept: dict = {}

        def draws(n: int, k: int):
            step = max(1, DRAWN // max(n, k))
            if (n, k) in kept:
                yield 0, kept[n, k]
                return
            rng = np.random.RandomState(seed)
            for a in range(0, rounds, step):
                got = np.stack([rng.choice(n, size=k, replace=True) for _ in range(min(step, rounds - a))])
                if step >= rounds:
                    if sum(x.size for x in kept.values()) > DRAWN:
                        kept.clear()
                    kept[n, k] = got
                yield a, got

        for batch in batches:
            lists = batch.column(len(keys))
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            off = np.concatenate([[0], np.cumsum(size)])
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            codes = None
            if vote:
                votes = pd.factorize(batch.column(len(keys) + 1).flatten().to_pandas(integer_object_nulls=True))[0] + 1
                # numbered from 0 within each group
                codes = np.unique(np.repeat(np.arange(len(size)), size) * (votes.max(initial=0) + 1) + votes, return_inverse=True)[1]
                codes = codes - np.repeat(np.minimum.reduceat(codes, off[:-1]), size) if len(codes) else codes
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                some = max(1, DRAWN // (int(n) * min(rounds, max(1, DRAWN // int(n)))))
                parts = []
                for i in range(0, len(rows), some):
                    at = off[rows[i : i + some], None] + np.arange(n)
                    parts += [(rows[i : i + some], c) for c in run(flat[at], None if codes is None else codes[at], lambda k, n=int(n): draws(n, k))]
                if parts:
                    take = pa.array(np.concatenate([r for r, _ in parts]))
                    made = [pa.array(np.concatenate([c[j] for _, c in parts])).cast(arrow[t]) for j, (_, t) in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([batch.column(j).take(take) for j in range(len(keys))] + made, names=[*keys, *[c for c, _ in kinds]])

    schema = ", ".join(f"`{c}` {t}" for c, t in df.select(*keys).dtypes)
    return g.mapInArrow(each, f"{schema}, {out}")


def majority_of_k(df: DataFrame, keys: list[str], vote: str, value: str, pos: str, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """keys, k, maj_mean, maj_std: the value of the most frequent vote of k seeded draws with replacement, k of `sizes_for`.

    Ties go to the vote that a draw holds first, and of its votes the first one's value counts.  A group is one prompt's samples.
    Votes are counted by code, so a draw costs its k places and the group's distinct votes.
    """
    import numpy as np

    def run(v, codes, draws):
        groups, n = v.shape
        distinct = int(codes.max()) + 1
        for k in [] if n <= 1 else [2**i for i in range(1, 64) if 2**i < n] + [n]:
            got = np.empty((groups, rounds))
            for a, places in draws(k):
                m = len(places)
                cell = codes[:, places] + (np.arange(groups * m) * distinct).reshape(groups, m, 1)
                count = np.bincount(cell.ravel(), minlength=groups * m * distinct)
                first = np.zeros(len(count), np.int64)
                # of places assigned to one cell the last stays, so they go backwards
                first[cell[:, :, ::-1].ravel()] = np.tile(np.arange(k)[::-1], groups * m)
                best = (count * (k + 1) - first).reshape(groups, m, distinct).argmax(2)
                won = np.take_along_axis(first.reshape(groups, m, distinct), best[:, :, None], 2)[:, :, 0]
                got[:, a : a + m] = np.take_along_axis(v, places[np.arange(m), won], 1)
            yield np.full(groups, k), got.mean(1), got.std(1)

    return _drawn(df, keys, value, pos, seed, rounds, run, "k int, maj_mean double, maj_std double", vote)


def bootstrap(df: DataFrame, keys: list[str], value: str, pos: str, k: int, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """keys, best_mean, best_std, worst_mean, worst_std by seeded resampling, the generator set anew for each reducer.

    A group is one prompt's samples, so it is small by design; groups of one size are resampled together.
    """
    import numpy as np

    def run(v, codes, draws):
        best, worst = np.empty((len(v), rounds)), np.empty((len(v), rounds))
        for a, places in draws(k):
            got = v[:, places]
            best[:, a : a + len(places)], worst[:, a : a + len(places)] = got.max(2), got.min(2)
        yield best.mean(1), best.std(1), worst.mean(1), worst.std(1)

    return _drawn(df, keys, value, pos, seed, rounds, run, "best_mean double, best_std double, worst_mean double, worst_std double")


def named(metrics: DataFrame, core: str = "acc") -> DataFrame:
    """Full names: val-core for the core variable's mean, maj and best at the greatest size, val-aux for others."""
    size = F.regexp_extract("name", r"@(\d+)", 1).cast("int")
    top = F.max(size).over(Window.partitionBy("source", "variable"))
    is_core = (F.col("variable") == core) & F.regexp_like("name", F.lit(r"^(mean|maj|best)@")) & (size == top)
    return metrics.withColumn("metric", F.concat_ws("/", F.when(is_core, "val-core").otherwise("val-aux"), "source", "variable", "name"))


# ---- reductions


def reduce_named(df: DataFrame) -> DataFrame:
    """One value a name: max if the name holds "max", else min if it holds "min", else mean."""
    n = F.col("name")
    v = F.when(n.contains("max"), F.max("value")).when(n.contains("min"), F.min("value")).otherwise(F.avg("value"))
    return df.groupBy("name").agg(F.max("value").alias("_max"), F.min("value").alias("_min"), F.avg("value").alias("_avg")).select("name", F.when(n.contains("max"), F.col("_max")).when(n.contains("min"), F.col("_min")).otherwise(F.col("_avg")).alias("value"))


def reduce_ranks(df: DataFrame) -> DataFrame:
    """name, value from (name, agg, rank, pos, value): sums and means average over ranks by position first."""
    sized = df.groupBy("name", "agg", "rank").agg(F.count(F.lit(1)).alias("n")).groupBy("name", "agg").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    per = df.groupBy("name", "agg", "pos").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    g = per.groupBy("name", "agg").agg(F.sum("m").alias("s"), F.avg("m").alias("a"), F.min("lo").alias("mn"), F.max("hi").alias("mx"))
    ragged = (F.col("_lo") != F.col("_hi")) & F.col("agg").isin("sum", "mean")
    v = F.when(F.col("agg") == "sum", F.col("s")).when(F.col("agg") == "mean", F.col("a")).when(F.col("agg") == "min", F.col("mn")).when(F.col("agg") == "max", F.col("mx"))
    g = g.join(sized.withColumnsRenamed({"lo": "_lo", "hi": "_hi"}), ["name", "agg"])
    return g.select("name", F.when(ragged, F.raise_error(F.lit("ranks differ in length")).cast("double")).otherwise(v).alias("value"))


def rule_of(name: Column) -> Column:
    """Aggregation by words of the name, the first that occurs in this order."""
    n = F.lower(name)
    has = lambda *words: F.lit(False) if not words else __import__("functools").reduce(lambda a, b: a | b, [n.contains(w) for w in words])
    return F.when(has("timing_s/"), "time_sum").when(has("mean", "avg", "average"), "avg").when(has("max", "maximum"), "max").when(has("min", "minimum"), "min").when(has("sum", "total"), "sum").otherwise("avg")


def window_metrics(df: DataFrame) -> DataFrame:
    """name, value over a window of steps from (name, step, value[, rule, weight]); rules given in the column win."""
    rule = F.coalesce(F.col("rule"), rule_of(F.col("name"))) if "rule" in df.columns else rule_of(F.col("name"))
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    g = df.withColumn("_rule", rule).groupBy("name", "_rule").agg(F.sum("value").alias("s"), F.avg("value").alias("a"), F.max("value").alias("mx"), F.min("value").alias("mn"), F.max_by("value", "step").alias("l"), (F.sum(F.col("value") * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("w"))
    r = F.col("_rule")
    return g.select("name", r.alias("rule"), F.when(r.isin("sum", "time_sum"), F.col("s")).when(r == "max", F.col("mx")).when(r == "min", F.col("mn")).when(r == "last", F.col("l")).when(r == "weighted_avg", F.coalesce("w", "a")).otherwise(F.col("a")).alias("value"))


def percentiles(df: DataFrame, keys: list[str], value: str, ps=(0.5, 0.95, 0.99)) -> DataFrame:
    """Linearly interpolated percentiles with mean, max, min."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), *[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in ps])


def slowest(df: DataFrame, keys: list[str], total: Column, *lookups: str) -> DataFrame:
    """min, max, mean of the total, and columns of the row that took longest."""
    d = df.withColumn("_t", total)
    return d.groupBy(*keys).agg(F.min("_t").alias("min"), F.max("_t").alias("max"), F.avg("_t").alias("mean"), *[F.max_by(c, "_t").alias(f"slowest_{c}") for c in lookups])


def source_means(df: DataFrame, source: str, uid: str, score: str) -> DataFrame:
    """Mean over responses of a row, then over rows of a source."""
    return df.groupBy(source, uid).agg(F.avg(score).alias("_m")).groupBy(source).agg(F.avg("_m").alias("mean_score"), F.count(F.lit(1)).alias("prompts"))


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row: 2 sum(i f_i) / (n sum f) - (n + 1) / n over ascending f.

    Equal values are ranked together, so the ranks come from a running count over distinct values.
    """
    per = running_total(df.groupBy(value).agg(F.count(F.lit(1)).alias("c")), [value], "c", "upto")
    # the ranks upto-c+1 .. upto sum to c (2 upto - c + 1) / 2
    per = per.select(value, "c", (F.col("c") * (2 * F.col("upto") - F.col("c") + 1) / 2).alias("ranks"))
    return per.agg((2 * F.sum(F.col("ranks") * F.col(value)) / (F.sum("c") * F.sum(F.col("c") * F.col(value))) - (F.sum("c") + 1) / F.sum("c")).alias("gini"))


def dense_flops(tokens: Column, squares: Column, parameters: float, layers: int, heads: int, head_dim: int) -> Column:
    """Training FLOPs of a dense decoder: 6 per parameter and token, 12 per attention pair."""
    return 6.0 * parameters * tokens + 12.0 * layers * heads * head_dim * squares


def derived_metrics(table: DataFrame, devices: int) -> DataFrame:
    """name, value with the metrics that follow from others put in their place: minmax_diff, throughput, idle ratio."""
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    one = table.agg(
        (pick("global_seqlen/max") - pick("global_seqlen/min")).alias("global_seqlen/minmax_diff"),
        (pick("perf/total_num_tokens") / F.nullif(pick("perf/time_per_step") * devices, F.lit(0.0))).alias("perf/throughput"),
        (pick("timing_s/gen") / F.nullif(pick("timing_s/step"), F.lit(0.0))).alias("trainer/idle_ratio"),
        *[F.max((F.col("name") == n).cast("int")).alias(f"_{n}") for n in ("global_seqlen/minmax_diff", "perf/throughput")],
    )
    made = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("value"), need.alias("ok")) for n, need in (
        ("global_seqlen/minmax_diff", F.col("`_global_seqlen/minmax_diff`") == 1), ("perf/throughput", F.col("`_perf/throughput`") == 1), ("trainer/idle_ratio", F.lit(True)))])).alias("x")).select("x.*").where("ok and value is not null").drop("ok")
    return table.join(made.select("name"), "name", "left_anti").select("name", "value").unionByName(made)
