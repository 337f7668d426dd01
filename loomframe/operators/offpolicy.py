"""Off-policy correction: importance weights, rejection masks and their metrics, row-local over token arrays."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A

BOUND = 20.0
#: The rejection options.
OPTIONS = (
    "token_k1", "token_k2", "token_k3", "seq_sum_k1", "seq_sum_k2", "seq_sum_k3",
    "seq_mean_k1", "seq_mean_k2", "seq_mean_k3", "seq_max_k2", "seq_max_k3",
)


def thresholds(options: list[str], spec) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) of each option; one entry serves all, k1 takes "low_high" or u for 1/u..u."""
    parts = [p.strip() for p in spec.split(",")] if isinstance(spec, str) else [spec]
    if len(parts) == 1:
        parts = parts * len(options)
    if len(parts) != len(options):
        raise ValueError("one threshold for all options, or one for each")
    out = {}
    for option, p in zip(options, parts):
        if option.endswith("k1"):
            if isinstance(p, str) and "_" in p:
                low, high = (float(x) for x in p.split("_"))
            else:
                high = float(p)
                low = 1 / high
            if not 0 < low <= high:
                raise ValueError(f"bounds of {option} must be positive and in order")
            out[option] = (low, high)
        else:
            if isinstance(p, str) and "_" in p:
                raise ValueError(f"{option} takes an upper bound only")
            out[option] = (None, float(p))
    return out


def log_ratio(old: str = "old_lp", rollout: str = "rollout_lp") -> Column:
    return F.zip_with(old, rollout, lambda a, b: a - b)


def _stat(ratio: Column, kind: str) -> Column:
    def one(d):
        d = A.clipped(d, -BOUND, BOUND)
        return {"k1": -d, "k2": 0.5 * d * d, "k3": F.exp(d) - 1 - d}[kind]

    return F.transform(ratio, one)


def statistic(option: str, ratio: Column, mask: str = "mask") -> Column:
    """Token array for token options, one number a row otherwise."""
    level, kind = option.rsplit("_", 1)
    s = _stat(ratio, kind)
    if level == "token":
        return s
    if level == "seq_sum":
        return A.masked_sum(s, mask)
    if level == "seq_mean":
        return A.masked_mean(s, mask)
    return F.coalesce(F.array_max(A.keep_valid(s, mask)), F.lit(0.0))


def rejection_mask(df: DataFrame, options: str, threshold, mask: str = "mask") -> DataFrame:
    """`mask` times the conjunction of all options' bounds; statistics in rs_<option>."""
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    if not names or any(o not in OPTIONS for o in names):
        raise ValueError(f"options must be among {OPTIONS}")
    bounds = thresholds(names, threshold)
    df = df.withColumn("_lr", log_ratio())
    kept = F.col(mask)
    for o in names:
        low, high = bounds[o]
        df = df.withColumn(f"rs_{o}", statistic(o, F.col("_lr"), mask))
        kept = _restricted(kept, o, low, high)
    return df.withColumn("kept_mask", kept).drop("_lr")


def _restricted(mask: Column, option: str, low: float | None, high: float) -> Column:
    def ok(s: Column) -> Column:
        return (s >= math.log(low)) & (s <= math.log(high)) if low is not None else s <= high

    if option.startswith("token"):
        return F.zip_with(mask, f"rs_{option}", lambda k, s: F.when(ok(s), k).otherwise(k * 0))
    return F.transform(mask, lambda k: F.when(ok(F.col(f"rs_{option}")), k).otherwise(k * 0))


def importance_weights(df: DataFrame, level: str = "token", cap: float = 2.0, normalise: bool = False, mask: str = "mask") -> DataFrame:
    """Truncated importance weights in is_weights, by token or by sequence, optionally to mean 1."""
    r = log_ratio()
    if level == "token":
        w = F.transform(r, lambda d: F.exp(A.clipped(d, -BOUND, BOUND)))
    elif level == "sequence":
        total = A.clipped(A.masked_sum(r, mask), -BOUND, BOUND)
        w = F.transform(F.col(mask), lambda k: F.exp(total))
    else:
        raise ValueError(f"unknown level {level}")
    df = df.withColumn("is_weights", F.transform(A.masked(w, mask), lambda x: F.least(x, F.lit(cap))))
    if normalise:
        if level == "token":
            mean = df.agg((F.sum(A.total("is_weights")) / F.sum(A.count_mask(mask))).alias("_mean"))
        else:
            mean = df.where(A.count_mask(mask) > 0).agg(F.avg(A.masked_mean("is_weights", mask)).alias("_mean"))
        df = df.crossJoin(F.broadcast(mean)).withColumn("is_weights", F.transform("is_weights", lambda x: x / F.greatest("_mean", F.lit(1e-8)))).drop("_mean")
    return df


def is_metrics(df: DataFrame, cap: float = 2.0, mask: str = "mask") -> DataFrame:
    """One row over valid tokens: mean, max, min, deviation, fraction at or above the cap and below its inverse, effective sample size."""
    z = df.select(F.explode(A.keep_valid("is_weights", mask)).alias("w"))
    low = 1.0 / cap
    g = z.agg(F.avg("w").alias("mean"), F.max("w").alias("max"), F.min("w").alias("min"), F.stddev_pop("w").alias("std"), F.avg((F.col("w") >= cap).cast("double")).alias("fraction_high"), F.avg((F.col("w") <= low).cast("double")).alias("fraction_low"), F.avg(F.pow(F.least(F.greatest("w", F.lit(low)), F.lit(cap)), F.lit(2))).alias("_sq"), F.avg(F.least(F.greatest("w", F.lit(low)), F.lit(cap))).alias("_m"))
    return g.withColumn("ess", F.col("_m") * F.col("_m") / F.col("_sq")).drop("_sq", "_m")


def divergence_metrics(df: DataFrame, mask: str = "mask") -> DataFrame:
    """One row of training against rollout: kl, k3_kl, perplexities and their ratio, chi-square by token and by row.

    Row means of log-probabilities average over rows; chi2_seq over all rows, fully masked ones included.
    """
    d = df.withColumn("_d", log_ratio())
    c = lambda x: A.clipped(x, -BOUND, BOUND)
    d = d.select(
        A.masked_mean("old_lp", mask).alias("t"),
        A.masked_mean("rollout_lp", mask).alias("r"),
        A.count_mask(mask).alias("n"),
        A.masked_sum("_d", mask).alias("s"),
        A.masked_sum(F.transform("_d", lambda x: F.exp(x) - x - 1), mask).alias("k3"),
        A.masked_sum(F.transform("_d", lambda x: F.exp(2 * c(x))), mask).alias("rho2"),
    )
    return d.agg(
        (-F.sum("s") / F.sum("n")).alias("kl"),
        (F.sum("k3") / F.sum("n")).alias("k3_kl"),
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"),
        F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"),
        F.avg(-F.col("t")).alias("training_log_ppl"),
        F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(F.col("r") - F.col("t")).alias("log_ppl_diff"),
        F.avg(F.abs(F.col("r") - F.col("t"))).alias("log_ppl_abs_diff"),
        F.max(F.col("r") - F.col("t")).alias("log_ppl_diff_max"),
        F.min(F.col("r") - F.col("t")).alias("log_ppl_diff_min"),
        F.avg(F.exp(F.col("r") - F.col("t"))).alias("ppl_ratio"),
        (F.sum("rho2") / F.sum("n") - 1).alias("chi2_token"),
        (F.avg(F.exp(2 * c(F.col("s")))) - 1).alias("chi2_seq"),
    )


def corrected(df: DataFrame, level: str | None = None, cap: float = 2.0, normalise: bool = False, options: str | None = None, threshold=None) -> DataFrame:
    """Weights and rejection together; without options the mask stays."""
    if level:
        df = importance_weights(df, level, cap, normalise)
    return rejection_mask(df, options, threshold) if options else df.withColumn("kept_mask", F.col("mask"))


def bypassed(df: DataFrame) -> DataFrame:
    """Rollout log-probabilities stand for the old policy's."""
    return df.withColumn("old_lp", F.col("rollout_lp"))


def debug_metrics(df: DataFrame, mask: str = "mask") -> DataFrame:
    """One row: difference of token probabilities (max, mean, deviation) and their correlation."""
    z = F.filter(F.arrays_zip(F.col("old_lp").alias("a"), F.col("rollout_lp").alias("b"), F.col(mask).alias("m")), lambda x: x["m"] != 0)
    x = df.select(F.explode(z).alias("x")).select(F.exp("x.a").alias("p"), F.exp("x.b").alias("q"))
    d = F.abs(F.col("p") - F.col("q"))
    return x.agg(F.max(d).alias("diff_max"), F.avg(d).alias("diff_mean"), F.stddev_samp(d).alias("diff_std"), F.corr("p", "q").alias("corr"))


def rejection_metrics(df: DataFrame, option: str, threshold, mask: str = "mask") -> DataFrame:
    """One row on an option's statistic over valid tokens (or rows with any): mean, max, min, deviation, fractions beyond the bounds, share of tokens and of rows dropped."""
    low, high = thresholds([option], threshold)[option]
    low_, high_ = (math.log(low), math.log(high)) if low is not None else (None, high)
    d = rejection_mask(df, option, threshold, mask)
    valid, kept = A.count_mask(mask), A.count_mask("kept_mask")
    if option.startswith("token"):
        x = d.select(F.explode(A.keep_valid(f"rs_{option}", mask)).alias("x"))
    else:
        x = d.where(valid > 0).select(F.col(f"rs_{option}").alias("x"))
    below = F.avg((F.col("x") < low_).cast("double")) if low_ is not None else F.lit(0.0)
    s = x.agg(F.avg("x").alias("mean"), F.max("x").alias("max"), F.min("x").alias("min"), F.stddev_pop("x").alias("std"), F.avg((F.col("x") > high_).cast("double")).alias("fraction_high"), below.alias("fraction_low"))
    t = d.agg((1 - F.sum(kept) / F.sum(valid)).alias("masked_fraction"), F.avg((kept < valid).cast("double")).alias("seq_masked_fraction"))
    return s.crossJoin(F.broadcast(t))


def bypass_loss(df: DataFrame, kind: str = "ppo_clip", level: str | None = None, cap: float = 2.0, options: str | None = None, threshold=None) -> DataFrame:
    """Rollout log-probabilities as the old policy: clipped loss without weights, or REINFORCE with weights; rejection restricts the mask."""
    from .losses import policy_loss

    d = df.withColumn("_old", F.col("old_lp")).withColumn("old_lp", F.col("lp"))  # the current policy against the rollout
    d = corrected(d, level if kind == "reinforce" else None, cap, options=options, threshold=threshold)
    d = bypassed(d.withColumn("mask", F.col("kept_mask")))
    if kind == "ppo_clip":
        return policy_loss(d.drop("is_weights"), "vanilla").withColumn("old_lp", F.col("_old")).drop("_old")
    if kind == "reinforce":
        return policy_loss(d, "reinforce").withColumn("old_lp", F.col("_old")).drop("_old")
    raise ValueError(f"unknown kind {kind}")
