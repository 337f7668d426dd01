"""Divergences and forward loss values over token arrays, row-local until one final aggregate.

Input columns: mask, old_lp, lp, advantages (arrays of one length), optionally
is_weights.  A loss adds the token array `loss` (or one value a row) and what its metrics
need; `agg_loss` reduces it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .batch import number_rows
from .selection import first_rows

LOSSES: dict[str, Callable[..., DataFrame]] = {}


def register_loss(name: str):
    def put(fn):
        if LOSSES.get(name, fn) is not fn:
            raise ValueError(f"loss {name} is taken")
        LOSSES[name] = fn
        return fn

    return put


def policy_loss(df: DataFrame, name: str, **options) -> DataFrame:
    if name not in LOSSES:
        raise ValueError(f"unknown loss {name}")
    return LOSSES[name](df, **options)


def kl_values(lp, ref, kind: str) -> Column:
    """Token divergences: kl/k1, abs, mse/k2, low_var_kl/k3; a trailing + changes gradients only."""
    kind = kind.removesuffix("+")
    if kind in ("kl", "k1"):
        return F.zip_with(lp, ref, lambda a, b: a - b)
    if kind == "abs":
        return F.zip_with(lp, ref, lambda a, b: F.abs(a - b))
    if kind in ("mse", "k2"):
        return F.zip_with(lp, ref, lambda a, b: 0.5 * (a - b) * (a - b))
    if kind in ("low_var_kl", "k3"):

        def k3(a, b):
            d = A.clipped(b - a, -20, 20)
            return A.clipped(F.exp(d) - d - 1, -10, 10)

        return F.zip_with(lp, ref, k3)
    if kind == "full":
        raise NotImplementedError("the full divergence needs whole distributions")
    raise ValueError(f"unknown divergence {kind}")


MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def agg_loss(df: DataFrame, mode: str, loss: str = "loss", mask: str = "mask", dp_size: int = 1, batch_tokens: float | None = None, global_rows: float | None = None, scale: float | None = None) -> Column:
    """The aggregate expression for df.agg(...); fully masked rows count in no row mean."""
    s, n = A.masked_sum(loss, mask), A.count_mask(mask)
    rows = F.lit(float(global_rows)) if global_rows is not None else F.sum((n > 0).cast("double"))
    if mode == "token-mean":
        tokens = F.lit(float(batch_tokens)) if batch_tokens is not None else F.sum(n)
        return F.sum(s) / tokens * dp_size
    if mode == "seq-mean-token-sum":
        return F.sum(F.when(n > 0, s).otherwise(0.0)) / rows * dp_size
    if mode == "seq-mean-token-sum-norm":
        width = F.lit(float(scale)) if scale is not None else F.max(F.size(mask)).cast("double")
        return F.sum(s) / width
    if mode == "seq-mean-token-mean":
        return F.sum(F.when(n > 0, s / (n + 1e-8)).otherwise(0.0)) / rows * dp_size
    raise ValueError(f"unknown mode {mode}")


def loss_matrix(df: DataFrame, modes=MODES, **options) -> DataFrame:
    return df.agg(*[agg_loss(df, m, **options).alias(m.replace("-", "_")) for m in modes])


def _zipped(*names: str) -> Column:
    return F.arrays_zip(*[F.col(n).alias(n) for n in names])


def _tokens(df: DataFrame, body) -> Column:
    names = ["old_lp", "lp", "advantages", "mask"] + (["is_weights"] if "is_weights" in df.columns else [])
    weigh = (lambda x, v: v * x["is_weights"]) if "is_weights" in df.columns else (lambda x, v: v)
    return F.transform(_zipped(*names), lambda x: weigh(x, body(x)))


def _delta(x) -> Column:
    return A.clipped(x["lp"] - x["old_lp"], -20, 20)


def _with_kl(df: DataFrame) -> DataFrame:
    return df.withColumn("kl_tokens", F.transform(_zipped("old_lp", "lp"), lambda x: -_delta(x)))


@register_loss("vanilla")
def vanilla(df: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """Dual-clip PPO; clip flags in `clipped` and `clipped_low`."""

    def parts(x):
        r = F.exp(_delta(x))
        a = -x["advantages"]
        first, second = a * r, a * A.clipped(r, 1 - low, 1 + high)
        return a, first, second, F.greatest(first, second)

    def body(x):
        a, _, _, top = parts(x)
        return F.when(x["advantages"] < 0, F.least(a * dual, top)).otherwise(top)

    z = _zipped("old_lp", "lp", "advantages")
    df = df.withColumn("clipped", F.transform(z, lambda x: (parts(x)[2] > parts(x)[1]).cast("double")))
    low_flag = lambda x: ((parts(x)[3] > parts(x)[0] * dual) & (x["advantages"] < 0)).cast("double")
    return _with_kl(df.withColumn("clipped_low", F.transform(z, low_flag)).withColumn("loss", _tokens(df, body)))


def _truncated(df: DataFrame, keep, cap: float) -> DataFrame:
    def body(x):
        r = F.least(F.exp(_delta(x)), F.lit(cap))
        return -x["advantages"] * r * x["lp"] * keep(x).cast("double")

    out = df.withColumn("loss", _tokens(df, body))
    return _with_kl(out.withColumn("clipped", F.transform(_zipped("old_lp", "lp", "advantages"), lambda x: 1.0 - keep(x).cast("double"))))


@register_loss("dppo_tv")
def dppo_tv(df: DataFrame, low: float = 0.2, high: float = 0.2, cap: float = 20.0) -> DataFrame:
    """Tokens whose probability moved too far in the advantage's direction do not count."""
    d = lambda x: F.exp(x["lp"]) - F.exp(x["old_lp"])
    return _truncated(df, lambda x: F.when(x["advantages"] > 0, d(x) <= high).otherwise(d(x) >= -low), cap)


@register_loss("dppo_kl")
def dppo_kl(df: DataFrame, low: float = 0.2, high: float = 0.2, cap: float = 20.0) -> DataFrame:
    """The same by the divergence of the two-outcome distributions."""

    def keep(x):
        p, q = F.exp(x["lp"]), F.exp(x["old_lp"])
        kl = q * (x["old_lp"] - x["lp"]) + (1 - q) * F.log((1 - q + 1e-8) / (1 - p + 1e-8))
        return F.when(x["advantages"] > 0, (kl <= high) | (p <= q)).otherwise((kl <= low) | (p >= q))

    return _truncated(df, keep, cap)


@register_loss("gspo")
def gspo(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """One ratio a row, the exponential of the mean log ratio (at most 10); aggregate with seq-mean-token-mean."""
    delta = F.zip_with("lp", "old_lp", lambda a, b: a - b)
    df = df.withColumn("_mean", A.masked_sum(delta, "mask") / F.greatest(A.count_mask("mask"), F.lit(1.0)))

    def body(x):
        r = F.exp(F.least(F.col("_mean"), F.lit(10.0)))
        a = -x["advantages"]
        return F.greatest(a * r, a * A.clipped(r, 1 - low, 1 + high))

    return _with_kl(df.withColumn("loss", _tokens(df, body)).drop("_mean"))


@register_loss("sapo")
def sapo(df: DataFrame, positive: float = 1.0, negative: float = 1.05) -> DataFrame:
    """A soft gate instead of a clip; aggregate with seq-mean-token-mean."""

    def body(x):
        tau = F.when(x["advantages"] > 0, positive).otherwise(negative)
        return -x["advantages"] * (4 / tau) / (1 + F.exp(-tau * (F.exp(_delta(x)) - 1)))

    return _with_kl(df.withColumn("loss", _tokens(df, body)))


@register_loss("gpg")
def gpg(df: DataFrame) -> DataFrame:
    return df.withColumn("loss", _tokens(df, lambda x: -x["lp"] * x["advantages"]))


@register_loss("cispo")
def cispo(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    return _with_kl(df.withColumn("loss", _tokens(df, lambda x: -A.clipped(F.exp(_delta(x)), 1 - low, 1 + high) * x["advantages"] * x["lp"])))


@register_loss("geo_mean")
def geo_mean(df: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    """One value a row: minus the mean advantage times the geometric mean of sign-aware clipped ratios."""

    def least(x):
        d = x["lp"] - x["old_lp"]
        s = F.signum(x["advantages"])
        return s * F.least(s * d, s * A.clipped(d, -low, high))

    kept = F.transform(_zipped("old_lp", "lp", "advantages"), least)
    ratio = F.exp(A.masked_mean(kept, "mask"))
    value = -A.masked_mean("advantages", "mask") * ratio
    if "is_weights" in df.columns:
        value = value * F.exp(A.masked_mean(F.transform("is_weights", lambda w: F.log(w + 1e-10)), "mask"))
    return df.withColumn("row_loss", value)


@register_loss("reinforce")
def reinforce(df: DataFrame) -> DataFrame:
    """-A lp, with importance weights if present; also the bypass mode's second form."""
    return df.withColumn("loss", _tokens(df, lambda x: -x["advantages"] * x["lp"]))


def _means(df: DataFrame) -> DataFrame:
    z = F.filter(_zipped("advantages", "lp", "mask"), lambda x: x["mask"] != 0)
    return df.select(F.explode(z).alias("x")).agg(F.avg("x.advantages").alias("_ma"), F.avg("x.lp").alias("_ml"), F.count(F.lit(1)).alias("_n"))


def covariances(df: DataFrame, key: str = "row_idx") -> DataFrame:
    """Long form (key, t, cov, n) of valid tokens against batch means."""
    z = F.transform(_zipped("advantages", "lp", "old_lp", "mask"), lambda x, i: F.struct(i.alias("t"), x["advantages"].alias("a"), x["lp"].alias("l"), x["old_lp"].alias("o"), x["mask"].alias("m")))
    long = df.select(key, F.explode(F.filter(z, lambda x: x["m"] != 0)).alias("x")).crossJoin(F.broadcast(_means(df)))
    return long.select(key, "x.t", "x.a", "x.l", "x.o", ((F.col("x.a") - F.col("_ma")) * (F.col("x.l") - F.col("_ml"))).alias("cov"), F.col("_n").alias("n"))


def kl_cov(df: DataFrame, ratio: float = 0.0002, coef: float = 1.0, key: str = "row_idx") -> DataFrame:
    """One row: token mean of -A r, plus coef |log ratio| on the share of tokens of greatest covariance (ties: key, t)."""
    cov = covariances(df, key)
    n = _means(df).first()["_n"]
    top = first_rows(cov.select(key, "t", "cov"), max(1, int(n * ratio)), F.desc("cov"), key, "t").select(key, "t", F.lit(1).alias("_top"))
    d = F.col("l") - F.col("o")
    all_ = cov.join(top, [key, "t"], "left")
    return all_.agg(F.avg(-F.col("a") * F.exp(d) + F.when(F.col("_top") == 1, coef * F.abs(d)).otherwise(0.0)).alias("loss"), F.sum("_top").alias("n_top"))


def clip_cov(df: DataFrame, ratio: float = 0.0002, lower: float = 1.0, upper: float = 5.0, low: float = 0.2, high: float = 0.2, seed: int = 0, key: str = "row_idx") -> DataFrame:
    """One row: token mean of the clipped loss with a keyed random choice of tokens of middling covariance left out."""
    cov = covariances(df, key)
    r = F.exp(F.col("l") - F.col("o"))
    one, two = -F.col("a") * r, -F.col("a") * A.clipped(r, 1 - low, 1 + high)
    n = _means(df).first()["_n"]
    open_ = cov.where((F.col("cov") > lower) & (F.col("cov") < upper) & ~(two > one))
    hashed = open_.select(key, "t", F.xxhash64(key, "t", F.lit(seed)).alias("_h"))
    out = first_rows(hashed, max(int(ratio * n), 1), "_h", key, "t").select(key, "t", F.lit(0.0).alias("_keep"))
    all_ = cov.join(out, [key, "t"], "left").withColumn("_keep", F.coalesce("_keep", F.lit(1.0)))
    return all_.agg(F.avg(F.greatest(one, two) * F.col("_keep")).alias("loss"), F.avg(1 - F.col("_keep")).alias("clip_fraction"))


def value_loss(df: DataFrame, clip: float = 0.5) -> DataFrame:
    """loss and clipped from predictions, returns, values."""
    z = _zipped("predictions", "returns", "values")

    def pair(x):
        c = A.clipped(x["predictions"], x["values"] - clip, x["values"] + clip)
        return F.pow(x["predictions"] - x["returns"], 2), F.pow(c - x["returns"], 2)

    df = df.withColumn("loss", F.transform(z, lambda x: 0.5 * F.greatest(*pair(x))))
    return df.withColumn("clipped", F.transform(z, lambda x: (pair(x)[1] > pair(x)[0]).cast("double")))


def sft_loss(df: DataFrame, dp_size: int = 1, batch_tokens: float | None = None, rolled: bool = False) -> DataFrame:
    """One row: minus the masked log-probabilities over the number of tokens.

    `rolled` shifts the mask one token to the left over the whole batch in row order, the first
    token's mask going to the last: rows look up the first mask of the next row, so only row heads are ordered.
    """
    mask = F.col("mask")
    if rolled:
        heads = number_rows(df.where(F.size("mask") > 0).select("row_idx", F.element_at("mask", 1).alias("_head")), ["row_idx"], name="_at")
        n = heads.agg(F.count(F.lit(1)).alias("_n"))
        ahead = heads.crossJoin(F.broadcast(n)).select(((F.col("_at") + F.col("_n") - 1) % F.col("_n")).alias("_at"), F.col("_head").alias("_next"))
        heads = heads.join(ahead, "_at").select("row_idx", "_next")
        df = df.join(heads, "row_idx")
        mask = F.concat(F.slice("mask", 2, F.size("mask") - 1), F.array("_next"))
    n = F.lit(float(batch_tokens)) if batch_tokens is not None else F.sum(A.count_mask("mask"))
    return df.agg((-F.sum(A.masked_sum("lp", mask)) / n * dp_size).alias("loss"))


def ppo_total(df: DataFrame, entropy: str, entropy_coef: float, kl_coef: float = 0.0, kl_kind: str = "low_var_kl", mode: str = "token-mean") -> DataFrame:
    """One row: policy loss less the entropy bonus plus the divergence from the reference."""
    d = df.withColumn("_kl", kl_values("lp", "ref_lp", kl_kind))
    pg, ent, kl = agg_loss(d, mode), agg_loss(d, mode, loss=entropy), agg_loss(d, mode, loss="_kl")
    return d.agg(pg.alias("pg_loss"), ent.alias("entropy"), kl.alias("kl_loss")).withColumn("loss", F.col("pg_loss") - entropy_coef * F.col("entropy") + kl_coef * F.col("kl_loss"))
