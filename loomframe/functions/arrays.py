"""Token-array expressions: row-local maths over ARRAY columns, without any shuffle.

Sums, masks and distributions are built-in functions; scans along the tokens, for which those would copy the growing array at
every token, are Arrow functions over whole batches.

Masks are 0/1 arrays of the same length as the values.  Empty arrays give 0 (sums),
0 (means, by their epsilon) or null (variances).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x)


def masked(v, m) -> Column:
    """Values times mask; what lies outside the mask is 0 even if NaN."""
    return F.zip_with(_c(v), _c(m), lambda x, k: F.when(k != 0, x * k).otherwise(0.0))


def masked_sum(v, m) -> Column:
    return total(masked(v, m))


def count_mask(m) -> Column:
    return F.aggregate(_c(m), F.lit(0.0), lambda s, k: s + k)


def masked_mean(v, m) -> Column:
    return masked_sum(v, m) / (count_mask(m) + EPS)


def masked_var(v, m, unbiased: bool = True) -> Column:
    """Masked variance; an error if the mask holds fewer than two tokens (one, if biased)."""
    n = count_mask(m)
    mean = masked_mean(v, m)
    sq = F.zip_with(_c(v), _c(m), lambda x, k: F.when(k != 0, (x - mean) * (x - mean)).otherwise(0.0))
    var = total(sq) / (n + EPS)
    least = 1 if unbiased else 0
    var = var * n / (n - 1) if unbiased else var
    return F.when(n > least, var).otherwise(F.raise_error(F.lit("masked_var: too few tokens in the mask")).cast("double"))


def clipped(x: Column, low, high) -> Column:
    return F.greatest(F.least(x, _lit(high)), _lit(low))


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


# ---- scans along the tokens: one Arrow pass over all rows of a batch, linear in their tokens


def _scan(out: str, step, *columns) -> Column:
    """A column made by step(offsets, *values) from array columns of equal lengths; null where any of them is."""

    @F.arrow_udf(f"array<{out}>")
    def run(*arrays: pa.Array) -> pa.Array:
        some = np.logical_and.reduce([a.is_valid().to_numpy(zero_copy_only=False) for a in arrays])
        lists = [a if some.all() else a.filter(pa.array(some)) for a in arrays]
        sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        for x in lists[1:]:
            if not (x.value_lengths().to_numpy(zero_copy_only=False) == sizes).all():
                raise ValueError("arrays of a row differ in length")
        off = np.concatenate([[0], np.cumsum(sizes)])
        values = [x.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for x in lists]
        flat = step(off, *values)
        bounds = np.concatenate([[0], np.cumsum(np.where(some, np.diff(off)[np.maximum(np.cumsum(some) - 1, 0)] if len(sizes) else 0, 0))])
        kind = pa.float64() if out == "double" else pa.int32()
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat).cast(kind), mask=None if some.all() else pa.array(~some))

    return run(*[_c(c) for c in columns])


def _steps(off: np.ndarray):
    """Positions of the last tokens of all rows, of those before them, and so on, with the rows; longest rows first."""
    size = np.diff(off)
    order = np.argsort(-size, kind="stable")
    end, size = off[1:][order], size[order]
    open_ = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for i, n in enumerate(open_):
        yield end[:n] - 1 - i, n


def running(v, reverse: bool = False) -> Column:
    """Prefix sums, or suffix sums."""

    def step(off: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.empty_like(x)
        for a, b in zip(off[:-1], off[1:]):
            out[a:b] = np.cumsum(x[a:b][::-1])[::-1] if reverse else np.cumsum(x[a:b])
        return out

    return _scan("double", step, v)


def discounted_return(r, m, gamma: float) -> Column:
    """Reverse discounted returns; the running value is multiplied by the mask after every token."""

    def step(off: np.ndarray, r: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, later = np.empty_like(r), np.zeros(len(off) - 1)
        for at, n in _steps(off):
            out[at] = r[at] + gamma * later[:n]
            later[:n] = out[at] * m[at]
        return out

    return _scan("double", step, r, m)


def gae(r, v, m, gamma: float, lam: float) -> Column:
    """Generalised advantages before whitening; masked tokens carry both the next value and the last advantage."""

    def step(off: np.ndarray, r: np.ndarray, v: np.ndarray, m: np.ndarray) -> np.ndarray:
        out, value, last = np.empty_like(r), np.zeros(len(off) - 1), np.zeros(len(off) - 1)
        for at, n in _steps(off):
            on = m[at] != 0
            fresh = r[at] + gamma * value[:n] - v[at] + gamma * lam * last[:n]
            value[:n] = np.where(on, v[at], value[:n])
            last[:n] = out[at] = np.where(on, fresh, last[:n])
        return out

    return _scan("double", step, r, v, m)


# ---- padding, truncation, masks


def pad(a, n, value, left: bool = False) -> Column:
    """Padded to length n (unchanged if longer)."""
    a = _c(a)
    fill = F.array_repeat(value if isinstance(value, Column) else F.lit(value), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def fit_length(a, n: int, value, left_pad: bool = True, truncation: str = "error") -> Column:
    """Exactly n entries: padded, or cut on the left, right or in the middle, or an error."""
    a = _c(a)
    if truncation == "left":
        short = F.slice(a, -n, n)
    elif truncation == "right":
        short = F.slice(a, 1, n)
    elif truncation == "middle":
        h = n // 2
        short = F.concat(F.slice(a, 1, h), F.slice(a, -(n - h), n - h))
    elif truncation == "error":
        short = F.raise_error(F.concat(F.lit("sequence longer than "), F.lit(str(n))))
    else:
        raise ValueError(f"unknown truncation {truncation}")
    return F.when(F.size(a) > n, short).otherwise(pad(a, n, value, left_pad))


def without_pad(ids, mask) -> Column:
    """The last sum(mask) ids."""
    n = count_mask(mask).cast("int")
    return F.when(n > 0, F.slice(_c(ids), -n, n)).otherwise(F.slice(_c(ids), 1, 0))


def keep_valid(v, m) -> Column:
    """Entries inside the mask (padded form to ragged form)."""
    z = F.filter(F.arrays_zip(_c(v).alias("v"), _c(m).alias("m")), lambda x: x["m"] != 0)
    return F.transform(z, lambda x: x["v"])


def eos_mask(ids, eos) -> Column:
    """1 up to and including the first end token."""
    ids, stop = _c(ids), F.array(*[F.lit(e) for e in (eos if isinstance(eos, (list, tuple)) else [eos])])
    first = F.array_min(F.filter(F.transform(ids, lambda x, i: F.when(F.array_contains(stop, x), i)), lambda i: i.isNotNull()))
    return F.transform(ids, lambda x, i: F.when(first.isNull() | (i <= first), 1).otherwise(0))


def position_ids(m) -> Column:
    """Running count of the mask less one, at least 0."""

    def step(off: np.ndarray, m: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0.0], np.cumsum(m)])
        return np.maximum(upto[1:] - np.repeat(upto[off[:-1]], np.diff(off)) - 1, 0)

    return _scan("int", step, m)


def place_last(mask, score) -> Column:
    """The score at the last valid token, 0 elsewhere."""
    n = count_mask(mask).cast("int")
    return F.transform(_c(mask), lambda k, i: F.when(i + 1 == n, _c(score)).otherwise(0.0))


# ---- distributions over logits


def log_sum_exp(x) -> Column:
    x = _c(x)
    top = F.array_max(x)
    return top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def log_prob_of(x, index) -> Column:
    return F.element_at(_c(x), _c(index) + 1) - log_sum_exp(x)


def entropy(x) -> Column:
    """Entropy of softmax(x)."""
    z = log_sum_exp(x)
    return z - total(F.transform(_c(x), lambda v: F.exp(v - z) * v))


def sum_pi_squared(x) -> Column:
    z = log_sum_exp(x)
    return total(F.transform(_c(x), lambda v: F.exp(2 * (v - z))))
