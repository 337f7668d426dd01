"""Group-wise advantage estimators over rows (row_idx, uid, score, ...).

Each estimator adds `advantage` per row (to be spread over tokens by the mask) with windows
over uid only, so that one exchange by uid serves them all.  Estimators on token arrays add
`advantages` and `returns`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import arrays as A
from .batch import number_rows, running_total

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def register_estimator(name: str):
    """Extension point: a name stands for one function only."""

    def put(fn):
        if ESTIMATORS.get(name, fn) is not fn:
            raise ValueError(f"estimator {name} is taken")
        ESTIMATORS[name] = fn
        return fn

    return put


def compute_advantage(df: DataFrame, estimator: str, **options) -> DataFrame:
    if estimator not in ESTIMATORS:
        raise ValueError(f"unknown estimator {estimator}")
    return ESTIMATORS[estimator](df, **options)


def _w():
    return Window.partitionBy("uid")


def _n() -> Column:
    return F.count(F.lit(1)).over(_w())


def _mean() -> Column:
    """Group mean, 0 for a single row."""
    return F.when(_n() == 1, 0.0).otherwise(F.avg("score").over(_w()))


def _std() -> Column:
    """Sample deviation, 1 for a single row."""
    return F.when(_n() == 1, 1.0).otherwise(F.stddev_samp("score").over(_w()))


def group_ids(df: DataFrame, label: str = "uid") -> DataFrame:
    """Adds gid, 0..G-1 in label order, by a join with the distinct labels."""
    labels = number_rows(df.select(label).distinct(), [label], name="gid").withColumn("gid", F.col("gid").cast("int"))
    return df.join(labels, label)


def group_mean_std(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    """uid, mean, std, n with the variance floored at eps; 0 and 1 for a single row."""
    g = df.groupBy("uid").agg(F.avg("score").alias("mean"), F.var_samp("score").alias("var"), F.count(F.lit(1)).alias("n"))
    one = F.col("n") == 1
    return g.select("uid", F.when(one, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(one, 1.0).otherwise(F.sqrt(F.greatest("var", F.lit(eps)))).alias("std"), "n")


@register_estimator("grpo")
def grpo(df: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    a = F.col("score") - _mean()
    return df.withColumn("advantage", a / (_std() + eps) if by_std else a)


@register_estimator("grpo_vectorized")
def grpo_vectorized(df: DataFrame, eps: float = 1e-6) -> DataFrame:
    std = F.when(_n() == 1, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp("score").over(_w()), F.lit(eps))))
    return df.withColumn("advantage", (F.col("score") - _mean()) / (std + eps))


@register_estimator("grpo_passk")
def grpo_passk(df: DataFrame, eps: float = 1e-6, by_std: bool = True) -> DataFrame:
    """Only the best row of a group gets its lead over the second; groups of one are an error."""
    order = _w().orderBy(F.desc("score"), "row_idx")
    lead = F.col("score") - F.lead("score").over(order)
    a = lead / (F.stddev_samp("score").over(_w()) + eps) if by_std else lead
    a = F.when(F.row_number().over(order) == 1, a).otherwise(0.0)
    return df.withColumn("advantage", F.when(_n() < 2, F.raise_error(F.lit("pass@k needs two rows a group")).cast("double")).otherwise(a))


@register_estimator("rloo")
def rloo(df: DataFrame) -> DataFrame:
    """Leave-one-out; a single row keeps its score."""
    n = _n()
    a = (F.col("score") - F.avg("score").over(_w())) * n / F.nullif(n - 1, F.lit(0))
    return df.withColumn("advantage", F.when(n == 1, F.col("score")).otherwise(a))


@register_estimator("rloo_vectorized")
def rloo_vectorized(df: DataFrame) -> DataFrame:
    """Leave-one-out; a single row gets 0."""
    n = _n()
    a = (n * F.col("score") - F.sum("score").over(_w())) / F.greatest(n - 1, F.lit(1))
    return df.withColumn("advantage", F.when(n > 1, a).otherwise(0.0))


@register_estimator("opo")
def opo(df: DataFrame) -> DataFrame:
    """Length-weighted baseline; a single row has baseline 0."""
    base = F.sum(F.col("score") * F.col("length")).over(_w()) / F.nullif(F.sum("length").over(_w()), F.lit(0))
    return df.withColumn("advantage", F.col("score") - F.when(_n() == 1, 0.0).otherwise(base))


@register_estimator("gpg")
def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """Centred scores scaled by batch size over the number of non-zero scores of the whole batch."""
    scale = df.agg((F.count(F.lit(1)) / F.greatest(F.sum((F.col("score") != 0).cast("int")), F.lit(1))).alias("_alpha"))
    return df.withColumn("_centred", F.col("score") - _mean()).crossJoin(F.broadcast(scale)).withColumn("advantage", F.col("_alpha") * F.col("_centred") / f_norm).drop("_alpha", "_centred")


def masked_moments(df: DataFrame, values: str, mask: str = "mask") -> DataFrame:
    """One row (_n, _mu, _var) over all valid tokens: count, mean and sample variance."""
    z = df.select(F.explode(A.keep_valid(values, mask)).alias("x"))
    return z.agg(F.count("x").alias("_n"), F.avg("x").alias("_mu"), F.var_samp("x").alias("_var"))


def whitened(df: DataFrame, values: str, mask: str = "mask", shift_mean: bool = True) -> DataFrame:
    """Values whitened by the batch's masked mean and variance; two passes, one broadcast row."""
    s = F.broadcast(masked_moments(df, values, mask))
    white = F.transform(values, lambda x: (x - F.col("_mu")) / F.sqrt(F.col("_var") + 1e-8) + (0.0 if shift_mean else F.col("_mu")))
    return df.crossJoin(s).withColumn(values, white).drop("_n", "_mu", "_var")


@register_estimator("reinforce_plus_plus_baseline")
def rfpp_baseline(df: DataFrame) -> DataFrame:
    """Centred scores over tokens, whitened over the batch, times mask."""
    d = df.withColumn("_a", F.col("score") - _mean())
    d = d.withColumn("advantages", F.transform("mask", lambda k: F.col("_a") * k)).drop("_a")
    d = whitened(d, "advantages")
    return d.withColumn("advantages", A.masked("advantages", "mask"))


@register_estimator("gae")
def gae(df: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    d = df.withColumn("advantages", A.gae("rewards", "values", "mask", gamma, lam))
    d = d.withColumn("returns", F.zip_with("advantages", "values", lambda a, v: a + v))
    return whitened(d, "advantages")


@register_estimator("reinforce_plus_plus")
def rfpp(df: DataFrame, gamma: float = 1.0) -> DataFrame:
    d = df.withColumn("returns", A.discounted_return("rewards", "mask", gamma)).withColumn("advantages", F.col("returns"))
    d = whitened(d, "advantages")
    return d.withColumn("advantages", A.masked("advantages", "mask"))


@register_estimator("remax")
def remax(df: DataFrame) -> DataFrame:
    """Suffix sums of masked rewards less the greedy baseline."""
    d = df.withColumn("returns", A.running(A.masked("rewards", "mask"), reverse=True))
    return d.withColumn("advantages", F.zip_with("returns", "mask", lambda r, k: r - F.col("baseline") * k))


@register_estimator("optimal_token_baseline")
def optimal_token_baseline(df: DataFrame, eps: float = 1e-8, compact: bool = False) -> DataFrame:
    """Long form (uid, row_idx, t, r, lp, pi2, m[, w]): a baseline for every time step of a group.

    `compact` numbers the valid tokens of a row consecutively (several turns); the
    sums per step are combined before the shuffle by (uid, t), so a step of a
    large group does not gather in one task.
    """
    row = Window.partitionBy("row_idx").orderBy("t")
    d = df.where("m = 1") if compact else df
    d = d.withColumn("step", F.row_number().over(row)) if compact else d.withColumn("step", F.col("t"))
    w = 1 - 2 * F.exp("lp") + F.col("pi2")
    w = w * F.col("w") * F.col("w") if "w" in df.columns else w
    upto = row.rowsBetween(Window.unboundedPreceding, 0)
    rest = row.rowsBetween(0, Window.unboundedFollowing)
    d = d.withColumn("_w", F.sum(w * F.col("m")).over(upto)).withColumn("_g", F.sum(F.col("r") * F.col("m")).over(rest))
    lengths = df.groupBy("uid", "row_idx").agg(F.sum("m").alias("_len"))
    top = lengths.groupBy("uid").agg(F.count(F.lit(1)).alias("_rows"), F.max("_len").alias("_first"), F.array_sort(F.collect_list("_len")).alias("_all"))
    top = top.select("uid", "_rows", F.coalesce(F.try_element_at("_all", F.lit(-2)), F.lit(0)).alias("_second"))
    base = d.groupBy("uid", "step").agg((F.sum(F.col("_g") * F.col("_w") * F.col("m")) / (F.sum(F.col("_w") * F.col("m")) + eps)).alias("_b"))
    d = d.join(base, ["uid", "step"]).join(top, "uid")
    tail = F.col("step") > F.col("_second")
    b = F.when(tail, 0.0).otherwise(F.col("_b"))
    a = F.when((F.col("_rows") == 1) | tail, 0.0).otherwise((F.col("_g") - b) * F.col("m"))
    return d.withColumn("advantage", a).withColumnRenamed("_g", "return_").drop("_w", "_b", "_rows", "_second", "step")


def spread(df: DataFrame) -> DataFrame:
    """A row's advantage over its tokens by the mask."""
    return df.withColumn("advantages", F.transform("mask", lambda k: F.col("advantage") * k))


def runs(df: DataFrame, order: str = "row_idx", key: str = "uid", partition: str | None = None) -> DataFrame:
    """Adds run, the number of the run of equal consecutive keys, and run_pos, the rank within it."""
    w = (Window.partitionBy(partition) if partition else Window.partitionBy()).orderBy(order)
    new = F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(new)
    d = df.withColumn("_new", first).withColumn("run", F.sum("_new").over(w) - 1)
    inner = Window.partitionBy(*([partition] if partition else []), "run").orderBy(order)
    return d.withColumn("run_pos", F.row_number().over(inner) - 1).drop("_new")


def prefix_groups(df: DataFrame, partition: str | None = None) -> DataFrame:
    """run, size and first row of each run of equal uids."""
    keys = [*([partition] if partition else []), "run"]
    return runs(df, partition=partition).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.min("row_idx").alias("first_row"), F.first("uid").alias("uid"))


def kl_rewards(df: DataFrame, beta: float, kind: str = "kl") -> DataFrame:
    """Token rewards less beta times divergence; also the row's mean divergence."""
    from .losses import kl_values

    d = df.withColumn("_kl", A.masked(kl_values("old_lp", "ref_lp", kind), "mask"))
    d = d.withColumn("rewards", F.zip_with("scores", "_kl", lambda s, k: s - beta * k))
    return d.withColumn("kl", A.masked_mean("_kl", "mask")).drop("_kl")


def adapted_beta(beta: float, current_kl: float, target: float, steps: int, horizon: float) -> float:
    """The adaptive controller's next coefficient."""
    error = min(max(current_kl / target - 1, -0.2), 0.2)
    return beta * (1 + error * steps / horizon)


def adapted_betas(kl: Column, beta: float, target: float, steps: int, horizon: float) -> Column:
    """The controller run over an array of divergences in order."""
    return F.aggregate(kl, F.lit(float(beta)), lambda b, k: b * (1 + A.clipped(k / target - 1, -0.2, 0.2) * steps / horizon))


def resample_weights(score: Column, method: str = "pow", power: float = 2.0) -> Column:
    """Weights by score plus 1e-8, so that every row may be drawn."""
    if method == "pow":
        w = F.pow(F.abs(score), power)
    elif method == "max_min":
        w = F.when((score == F.max(score).over(Window.partitionBy())) | (score == F.min(score).over(Window.partitionBy())), 1.0).otherwise(0.0)
    elif method == "max_random":
        w = F.when(score == F.max(score).over(Window.partitionBy()), 0.4).otherwise(0.1)
    else:
        raise ValueError(f"unknown method {method}")
    return w + 1e-8


def resampled(df: DataFrame, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with replacement by weight: draws meet the weights' running sums in a range join on sorted slices."""
    total = df.agg(F.sum(weight).alias("_all"))
    spans = running_total(df, ["row_idx"], weight, "_to").withColumn("_from", F.col("_to") - F.col(weight))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").withColumn("_u", (F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)))
    draws = draws.crossJoin(F.broadcast(total)).withColumn("_x", F.col("_u") * F.col("_all"))
    # both sides fall into cells of equal weight; a span covers the cells it touches
    cells = max(1, min(n, 1 << 20))
    spans = spans.crossJoin(F.broadcast(total)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / F.col("_all") * cells), F.floor(F.col("_to") / F.col("_all") * cells))))
    draws = draws.withColumn("_cell", F.floor(F.col("_x") / F.col("_all") * cells)).drop("_all", "_u")
    hit = spans.drop("_all").join(draws, "_cell").where("_x >= _from and _x < _to")
    return hit.drop("_cell", "_x", "_from", "_to")
