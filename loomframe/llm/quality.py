"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees over the statistics of labelled documents give paths; every path is a
conjunctive rule; a lasso logistic regression keeps few of them; the kept rules
are compiled into one Spark column expression over the statistics.  Statistics cover
whole texts; only the fit looks at a bounded sample of labelled
texts, about `SAMPLE` of them by a hash threshold from their number, so statistics for the fit are computed for those alone.

Defined cases: a null text counts as empty and is scored from its (zero) statistics;
labels that are null, or of documents that do not exist, are ignored; different labels of one
document all count, repeated rows once; without labels every score is 0.5, with one class the prior;
a null id is never held out and never learned from; equal texts get equal scores; extra columns of
documents pass through `accepted` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, hash_below, held_out, own_names
from .tokens import SPACE_TABLE, distinct_sets, pieces, text_bytes, windows, words

SAMPLE = 20_000
STATS = [
    "n_words", "word_length", "upper", "digits", "symbols", "bars", "stops", "non_ascii", "spaces",
    "distinct_words", "distinct_threes", "twins", "line_length", "distinct_lines", "marked_words",
]


def _classes() -> np.ndarray:
    """Bit masks of byte classes: upper, digit, symbol, bar, stop, non-ASCII start, white space, line feed, letter."""
    t = np.zeros(256, np.uint16)
    for b in range(256):
        c = chr(b)
        if b < 0x80:
            t[b] |= (c.isupper() << 0) | (c.isdigit() << 1) | (c in "#$%&*@^~<>{}[]\\/_=+" and 1 << 2) | (c == "|" and 1 << 3) | (c in ".,;:!?" and 1 << 4)
            t[b] |= (c.isspace() and 1 << 6) | (c == "\n" and 1 << 7) | (c.isalpha() and 1 << 8)
        elif b >= 0xC0:
            t[b] |= 1 << 5 | 1 << 8
    return t


_CLASSES = _classes()
#: Only line feeds part the "words" of this table, so its words are lines.
_LINES = np.where(np.arange(256) == 0x0A, np.uint64(0), np.where(SPACE_TABLE == 0, np.uint64(0x51ED270B3A4C9F11), SPACE_TABLE))


def statistics(texts: pa.Array) -> np.ndarray:
    """[row, statistic] of whole texts."""
    data, off = text_bytes(texts)
    out = [_piece(data[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in pieces(off, 1 << 20)]
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def _ratio(a, b):
    return np.asarray(a, float) / np.maximum(b, 1)


def _piece(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    kinds = _CLASSES[data]

    def count(bit: int) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum((kinds >> bit) & 1, dtype=np.int64)])[off])

    h, starts, ends, per = words(data, off, SPACE_TABLE)
    n, size = np.diff(per), np.diff(off)
    solid = size - count(6)
    letters = count(8)
    _, distinct = distinct_sets(h, per)
    three, three_off = windows(h, per, 3)
    _, distinct_three = distinct_sets(three, three_off)
    twin = np.zeros(len(h) + 1, np.int64)
    if len(h) > 1:
        twin[2:] = np.cumsum(h[1:] == h[:-1])
    inner = np.minimum(per[:-1] + 1, per[1:])
    last = (kinds[ends - 1] >> 2) & 0b11 if len(ends) else np.zeros(0, np.int64)
    marked = np.concatenate([[0], np.cumsum(last > 0)])
    line, _, _, line_per = words(data, off, _LINES)
    _, distinct_line = distinct_sets(line, line_per)
    lines = np.diff(line_per)
    return np.column_stack([
        np.log1p(n), _ratio(ends_minus(starts, ends, per), n), _ratio(count(0), letters), _ratio(count(1), solid), _ratio(count(2), solid), _ratio(count(3), solid),
        _ratio(count(4), n), _ratio(count(5), letters), _ratio(count(6), size), _ratio(np.diff(distinct), n), _ratio(np.diff(distinct_three), np.diff(three_off)),
        _ratio(twin[per[1:]] - twin[inner], n), np.log1p(_ratio(n, lines)), _ratio(np.diff(distinct_line), lines), _ratio(np.diff(marked[per]), n),
    ])


def ends_minus(starts: np.ndarray, ends: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Bytes in words of each row."""
    return np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[per])


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and a struct column _stats."""
    cols = [*keep, *([] if "text" in keep else ["text"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = statistics(batch.column(cols.index("text")))
            struct = pa.StructArray.from_arrays([pa.array(s[:, i]) for i in range(len(STATS))], names=STATS)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [struct], names=[*keep, "_stats"])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*cols).mapInArrow(run, f"{schema}, _stats struct<{', '.join(f'{s}:double' for s in STATS)}>")


# ---- the fit, on the driver, over at most SAMPLE rows


def _tree(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, least: int):
    """Nodes (rows, conditions) of a greedy regression tree over binned columns, and its fitted step."""
    step, nodes, todo = np.zeros(len(grad)), [], [(np.arange(len(grad)), ())]
    while todo:
        rows, path = todo.pop()
        if path:
            nodes.append(path)
        g, h = grad[rows].sum(), hess[rows].sum()
        best = None
        if len(path) < depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = x[rows, f]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                i = int(np.argmax(gain))
                if gain[i] > g * g / (h + 1) + 1e-6 and (best is None or gain[i] > best[0]):
                    best = (gain[i], f, i)
        if best is None:
            step[rows] = -g / (h + 1)
        else:
            _, f, i = best
            low = x[rows, f] <= i
            todo += [(rows[low], (*path, (f, i, True))), (rows[~low], (*path, (f, i, False)))]
    return nodes, step


def rules(stats: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, bins: int = 32, rate: float = 0.3) -> list[dict[int, tuple[float, float]]]:
    """Distinct conjunctive rules {statistic: (above, up to)} from the paths of boosted trees."""
    cuts = [np.unique(np.quantile(stats[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(stats.shape[1])]
    x = np.column_stack([np.searchsorted(c, stats[:, f], side="left") for f, c in enumerate(cuts)])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(mean / (1 - mean)))
    found: dict[tuple, dict] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        nodes, step = _tree(x, cuts, p - y, p * (1 - p), depth, max(5, len(y) // 500))
        score += rate * step
        for path in nodes:
            box: dict[int, tuple[float, float]] = {}
            for f, i, low in path:
                a, b = box.get(f, (-np.inf, np.inf))
                c = float(cuts[f][i])
                box[f] = (a, min(b, c)) if low else (max(a, c), b)
            found.setdefault(tuple(sorted(box.items())), box)
    return list(found.values())


def fires(stats: np.ndarray, rule: dict[int, tuple[float, float]]) -> np.ndarray:
    return np.logical_and.reduce([(stats[:, f] > a) & (stats[:, f] <= b) for f, (a, b) in rule.items()])


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1 logistic regression, by accelerated proximal gradient steps."""
    n = len(y)
    mu = z.mean(0)
    z = z - mu
    v = np.ones(z.shape[1], np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    step = 4 * n / (np.linalg.norm(z @ v) ** 2 + n)
    w = u = np.zeros(z.shape[1], np.float32)
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b = c = float(np.log(mean / (1 - mean)))
    t = 1.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(z @ u + c))) - y
        moved = u - step * (z.T @ e) / n
        new, b2 = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), c - step * e.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, c = new + (t - 1) / t2 * (new - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = new.astype(np.float32), float(b2), t2
        u = u.astype(np.float32)
    return b - float(mu @ w), w


def fit(stats: np.ndarray, y: np.ndarray, penalty: float = 5e-4) -> tuple[float, list[tuple[dict, float]]]:
    """(intercept, [(rule, weight)]) with the kept rules only."""
    if not len(y):
        return 0.0, []
    mean = float(y.mean())
    if mean in (0.0, 1.0):  # one class: the smoothed prior
        mean = (y.sum() + 1) / (len(y) + 2)
        return float(np.log(mean / (1 - mean))), []
    made = rules(stats, y)
    if not made:
        return float(np.log(mean / (1 - mean))), []
    z = np.column_stack([fires(stats, r) for r in made]).astype(np.float32)
    b, w = lasso(z, y.astype(np.float32), penalty)
    return b, [(r, float(v)) for r, v in zip(made, w) if abs(v) > 1e-6]


def compiled(model: tuple[float, list[tuple[dict, float]]], stats: str = "_stats") -> Column:
    """The score as a Spark column over the statistics."""
    intercept, kept = model

    def holds(rule) -> Column:
        parts = []
        for f, (a, b) in rule.items():
            c = F.col(f"{stats}.{STATS[f]}")
            parts += ([c > F.lit(float(a))] if a > -np.inf else []) + ([c <= F.lit(float(b))] if b < np.inf else [])
        return reduce(lambda p, q: p & q, parts)

    total = F.lit(float(intercept))
    for rule, weight in kept:
        total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def learn(docs: DataFrame, labels: DataFrame, hold: tuple[int, int] | None, sample: int = SAMPLE):
    """Fit from documents and labels(doc_id, quality), on about `sample` labelled texts at most.

    Ids, hashes and labels are met first; texts are only read for those that the sample takes, and the
    driver gets their statistics.
    """
    lab = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("double").alias("y"))
    if hold:
        lab = lab.where(~held_out(F.col("doc_id"), *hold))
    of = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    keys = cut(of.select("doc_id", "h").join(lab.groupBy("doc_id", "y").agg(F.lit(1)).select("doc_id", "y"), "doc_id").groupBy("doc_id", "h", "y").agg(F.lit(1)).select("doc_id", "h", "y"))
    n = keys.count()
    chosen = keys.where(hash_below(F.lit(sample / n), F.col("doc_id"), F.col("h"), F.col("y"))) if n > sample else keys
    # about `sample` rows of three numbers: small by construction
    met = of.join(F.broadcast(chosen), ["doc_id", "h"]).dropDuplicates(["doc_id", "h", "y"])
    got = with_statistics(met.select("doc_id", "y", "text"), ["doc_id", "y"]).select("doc_id", "y", "_stats.*").toArrow()
    got = got.sort_by([(c, "ascending") for c in ("doc_id", "y", *STATS)])
    return fit(np.column_stack([got.column(c).to_numpy() for c in STATS]), got.column("y").to_numpy())


HOLD, ACCEPT = (5, 0), 0.3


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    score = compiled(learn(docs, labels, HOLD))
    out = with_statistics(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", held_out(F.col("doc_id"), *HOLD).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents (all columns, of whatever names) that score at least ACCEPT."""
    model = learn(docs, labels, HOLD)
    free, names = free_names(docs, "text")
    return own_names(with_statistics(free, names).where(compiled(model) >= ACCEPT), names, docs.columns)
