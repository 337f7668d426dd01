"""Language ID: a linear-chain conditional random field over the words of a text.

A word's emission score is a sum of learned weights of its affixes, byte n-grams and
itself (the lexicon), hashed into one table; transitions between the labels of
neighbouring words are learned too.  Forward-backward gives every word's marginal
probability of each language, so code-switched text is labelled word by word; a
document's language is the one with the largest mean marginal.

The field is fitted on sequences that splice spans of different sample documents, so
that transitions learn to switch.  The sample is bounded: about `DOCS` labelled
documents at most, in equal shares of the languages, of at most `DOC_BYTES` bytes each.  Prediction covers
every word of every text.

Defined cases: a null text, or one without a letter, is `und` with score 0; without labelled
documents everything is `und`; a null id is learned from and not held out;
equal texts get equal predictions; the language, source and id of a document never
enter its prediction.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_below, held_out
from .tokens import SPACE_TABLE, mix64, pieces, text_bytes, words

DOCS, DOC_BYTES = 2_000, 16_384
BITS, SPAN, LENGTH = 17, 128, 64
HOLD = (4, 2)
_LETTER = re.compile(r"[^\W\d_]")


def _letters() -> np.ndarray:
    t = SPACE_TABLE.copy()
    for b in range(0x80):
        if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A):
            t[b] = 0
    return t


_TABLE = _letters()


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower-cases the letters of ISO 8859-1 in UTF-8."""
    data = data.copy()
    data[(data >= 0x41) & (data <= 0x5A)] += 0x20
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        data[second] += 0x20
    return data


def _types(data: np.ndarray, off: np.ndarray):
    """(word type of each word, offsets of rows, first start and end of each type)."""
    h, starts, ends, per = words(data, off, _TABLE)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return inverse.astype(np.int64), per, starts[first], ends[first]


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int = BITS):
    """Hashed features of words data[starts:ends]: (slot, word), words in order.

    All n-grams of 1 to 4 bytes of the word between two boundary marks, those at the
    boundaries being its affixes, and the word itself.
    """
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    size = ends - starts + 2
    base = np.cumsum(size) - size
    text = np.full(int(size.sum()), 1, np.uint64)
    at = np.arange(len(text)) - np.repeat(base, size)
    word = np.repeat(np.arange(len(size), dtype=np.int32), size)
    inner = (at > 0) & (at < size[word] - 1)
    text[inner] = data[(starts[word] + at - 1)[inner]]
    slots, owner = [], []
    roll = np.zeros(len(text), np.uint64)
    left = size[word] - at
    for n in range(1, 5):
        ahead = np.concatenate([text[n - 1 :], np.zeros(n - 1, np.uint64)])
        roll = roll * np.uint64(0x100000001B3) + ahead + np.uint64(17)
        ok = left >= n if n > 1 else inner
        slots.append((mix64(roll[ok] + np.uint64(n << 40)) >> np.uint64(64 - bits)).astype(np.int32))
        owner.append(word[ok])
    p = np.uint64(0x9E3779B97F4A7C15)
    powers = np.multiply.accumulate(np.full(int(size.max(initial=1)), p, np.uint64))
    whole = np.add.reduceat((text + np.uint64(3)) * powers[at], base) if len(base) else np.zeros(0, np.uint64)
    slots.append((mix64(whole) >> np.uint64(64 - bits)).astype(np.int32))
    owner.append(np.arange(len(size), dtype=np.int32))
    slot, own = np.concatenate(slots), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return slot[order], own[order]


def emissions(weights: np.ndarray, slot: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """[word, label]: sums of weights over the root of the number of features."""
    if not n:
        return np.zeros((0, weights.shape[1]), np.float32)
    begin = np.searchsorted(own, np.arange(n))
    count = np.bincount(own, minlength=n)
    return (np.add.reduceat(weights[slot], begin, axis=0) / np.sqrt(count)[:, None]).astype(np.float32)


def marginals(emission: np.ndarray, off: np.ndarray, trans: np.ndarray, span: int = SPAN) -> np.ndarray:
    """[word, label] posterior probabilities of every chain off[i]:off[i + 1].

    Chains are cut into spans; all spans advance in step.  The first pass multiplies
    each span's transfer matrices, the next carries messages over span borders, the
    last fills in the words.
    """
    L = trans.shape[0]
    if not len(emission):
        return np.zeros((0, trans.shape[0]))
    e = np.exp(emission - emission.max(1, keepdims=True)).astype(np.float64)
    t = np.exp(trans - trans.max()).astype(np.float64)
    n = np.diff(off)
    per = -(-n // span)
    chain = np.repeat(np.arange(len(n)), per)
    rank = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    begin = off[chain] + rank * span
    size = np.minimum(span, n[chain] - rank * span)
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    b, s = begin[order], size[order]
    active = np.searchsorted(-s, -np.arange(span), side="left")
    prod = np.broadcast_to(np.eye(L), (len(b), L, L)).copy()
    for i in range(int(s[0]) if len(s) else 0):
        f = active[i]
        prod[:f] = (prod[:f] @ t) * e[b[:f] + i][:, None, :]
        prod[:f] /= prod[:f].max((1, 2), keepdims=True)
    prod = prod[place]
    # messages entering each span from the left and from the right
    first = np.cumsum(per) - per
    left, right = np.full((len(chain), L), 1.0 / L), np.ones((len(chain), L))
    for k in range(1, int(per.max(initial=0))):
        at = (first + k)[per > k]
        m = np.einsum("ni,nij->nj", left[at - 1], prod[at - 1])
        left[at] = m / m.sum(1, keepdims=True)
    for k in range(int(per.max(initial=0)) - 2, -1, -1):
        at = (first + k)[per > k + 1]
        m = np.einsum("nij,nj->ni", prod[at + 1], right[at + 1])
        right[at] = m / m.max(1, keepdims=True)
    out = np.empty((len(emission), L))
    a = left[order]
    for i in range(int(s[0]) if len(s) else 0):
        f = active[i]
        a[:f] = (a[:f] @ t) * e[b[:f] + i]
        a[:f] /= a[:f].sum(1, keepdims=True)
        out[b[:f] + i] = a[:f]
    c = right[order]
    for i in range((int(s[0]) if len(s) else 0) - 1, -1, -1):
        f = active[i]
        out[b[:f] + i] *= c[:f]
        c[:f] = (e[b[:f] + i] * c[:f]) @ t.T
        c[:f] /= c[:f].max(1, keepdims=True)
    return out / out.sum(1, keepdims=True)


def posteriors(emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word posteriors [chain, word, label] and the expected counts [chain, label, next label] of neighbouring labels.

    Forward and backward messages of chains of one length; a pair's posterior is the forward message before it,
    the transition, the emission after it and the backward message beyond, normalised.
    """
    chains, length, L = emission.shape
    e = np.exp(emission - emission.max(2, keepdims=True)).astype(np.float64)
    t = np.exp(trans - trans.max()).astype(np.float64)
    ahead, back = np.empty((length, chains, L)), np.ones((length, chains, L))
    for i in range(length):
        a = e[:, i] * (ahead[i - 1] @ t if i else t.sum(0))
        ahead[i] = a / a.sum(1, keepdims=True)
    pairs = np.zeros((chains, L, L))
    for i in range(length - 2, -1, -1):
        beyond = e[:, i + 1] * back[i + 1]
        both = ahead[i][:, :, None] * t * beyond[:, None, :]
        pairs += both / both.sum((1, 2), keepdims=True)
        b = beyond @ t.T
        back[i] = b / b.max(1, keepdims=True)
    p = (ahead * back).transpose(1, 0, 2)
    return p / p.sum(2, keepdims=True), pairs


def transition_gradient(first: np.ndarray, pairs: np.ndarray, labels: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Of the negative log likelihood: expected less given counts, the step into each first word included."""
    out = pairs.sum(0)
    np.add.at(out, (labels[:, :-1].ravel(), labels[:, 1:].ravel()), -1)
    enter = np.exp(trans) / np.exp(trans).sum(0)
    return out + enter * (first.sum(0) - np.bincount(labels[:, 0], minlength=len(trans)))


def log_likelihood(emission: np.ndarray, trans: np.ndarray, labels: np.ndarray) -> float:
    """Of the labels [chain, word], each first label reached from an even one, up to a constant (for tests)."""
    total, (chains, length, L) = 0.0, emission.shape
    for c in range(chains):
        a = emission[c, 0] + np.log(np.exp(trans).sum(0))
        gold = a[labels[c, 0]]
        for i in range(1, length):
            gold += trans[labels[c, i - 1], labels[c, i]] + emission[c, i, labels[c, i]]
            a = emission[c, i] + np.log(np.exp(a - a.max()) @ np.exp(trans)) + a.max()
        total += gold - a.max() - np.log(np.exp(a - a.max()).sum())
    return total


def spliced(of: np.ndarray, per: np.ndarray, label: np.ndarray, sequences: int, length: int, seed: int = 11):
    """Word types and labels [sequence, word] that switch documents every 4 to 40 words."""
    rng = np.random.default_rng(seed)
    usable = [np.flatnonzero((label == v) & (np.diff(per) > 0)) for v in range(label.max() + 1)]
    usable = [u for u in usable if len(u)]
    types, labels = np.zeros((sequences, length), np.int64), np.zeros((sequences, length), np.int64)
    for q in range(sequences):
        at = 0
        while at < length:
            d = rng.choice(usable[rng.integers(len(usable))])
            n = int(min(rng.integers(4, 41), length - at, per[d + 1] - per[d]))
            start = int(rng.integers(per[d], per[d + 1] - n + 1))
            types[q, at : at + n], labels[q, at : at + n] = of[start : start + n], label[d]
            at += n
    return types, labels


def fit(texts: list[str], langs: list[str], rounds: int = 30, sequences: int = 3_000, bits: int = BITS) -> dict | None:
    """The field's labels, weights [slot, label] and transitions, by Adam over all spliced sequences."""
    names = sorted(set(langs))
    if not names:
        return None
    label = np.array([names.index(v) for v in langs])
    data, off = text_bytes(pa.array(texts, pa.string()))
    data = _lower(data)
    of, per, starts, ends = _types(data, off)
    if not len(of):
        return None
    types, labels = spliced(of, per, label, sequences, LENGTH)
    used, types = np.unique(types, return_inverse=True)
    types = types.reshape(labels.shape)
    slot, own = features(data, starts[used], ends[used], bits)
    L, n = len(names), len(used)
    scale = 1 / np.sqrt(np.bincount(own, minlength=n))[own]
    w, t = np.zeros((1 << bits, L), np.float32), np.zeros((L, L))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    gold = np.zeros((types.size, L))
    gold[np.arange(types.size), labels.ravel()] = 1
    for k in range(1, rounds + 1):
        e = emissions(w, slot, own, n)[types.ravel()]
        p, pairs = posteriors(e.reshape(*types.shape, L), t)
        p = p.reshape(-1, L)
        g = np.zeros((n, L))
        for v in range(L):
            g[:, v] = np.bincount(types.ravel(), p[:, v] - gold[:, v], n)
        gw = np.stack([np.bincount(slot, g[own, v] * scale, 1 << bits) for v in range(L)], axis=1) / len(types) + 1e-4 * w
        gt = transition_gradient(p.reshape(*types.shape, L)[:, 0], pairs, labels, t) / len(types) + 1e-3 * t
        for x, m, v, d, rate in ((w, mw, vw, gw, 0.3), (t, mt, vt, gt, 0.1)):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            x -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)).astype(x.dtype)
    return {"names": names, "w": w, "t": t}


def label_words(model: dict, texts: pa.Array):
    """Marginals of all words of the texts: (probabilities [word, label], offsets of rows, start and end bytes)."""
    data, off = text_bytes(texts)
    data = _lower(data)
    h, starts, ends, per = words(data, off, _TABLE)
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    slot, own = features(data, starts[first], ends[first])
    e = emissions(model["w"], slot, own, len(first))
    return marginals(e[of], per, model["t"]), per, starts, ends


def predict(model: dict | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of every text."""
    langs, scores = [], []
    _, off = text_bytes(texts)
    for a, b in pieces(off, 1 << 20):
        part = texts.slice(a, b - a)
        if model is None:
            langs += ["und"] * (b - a)
            scores.append(np.zeros(b - a))
            continue
        p, per, _, _ = label_words(model, part)
        n = np.diff(per)
        total = np.zeros((b - a, p.shape[1]))
        total[n > 0] = np.add.reduceat(p, per[:-1][n > 0], axis=0) if n.any() else 0  # a row's sum depends on the row alone
        mean = total / np.maximum(n, 1)[:, None]
        best = mean.argmax(1)
        score = np.round(np.clip(mean[np.arange(b - a), best], 0, 1), 9)
        raw = part.to_pylist() if p.shape[0] == 0 or (n == 0).any() else None
        for i in range(b - a):
            langs.append(model["names"][best[i]] if n[i] else "und")
        # words of non-ASCII characters only may hold no letter at all
        if raw is None:
            data, o = text_bytes(part)
            ascii_letter = np.concatenate([[0], np.cumsum((_TABLE[data] != 0) & (data < 0x80))])[o]
            doubt = np.flatnonzero(np.diff(ascii_letter) == 0)
            raw = {int(i): part[int(i)].as_py() for i in doubt}
        else:
            raw = dict(enumerate(raw))
        for i, text in raw.items():
            if not n[i] or not _LETTER.search(text or ""):
                langs[len(langs) - (b - a) + i], score[i] = "und", 0.0
        scores.append(score)
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def learn(docs: DataFrame, hold: tuple[int, int] | None = HOLD, sample: int = DOCS, doc_bytes: int = DOC_BYTES) -> dict | None:
    """The field of about `sample` documents at most, as many of each language as there are.

    Rows are counted first; a hash threshold per language then says which texts the driver gets.
    """
    known = docs.where("lang is not null and text is not null").where(F.octet_length("text") <= doc_bytes)
    if hold:
        known = known.where(~held_out(F.col("doc_id"), *hold))
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, sample / len(counts) / n)])
    rows = known.where(hash_below(shares[F.col("lang")], F.col("doc_id"), F.col("text"))).distinct().toArrow().sort_by([("lang", "ascending"), ("text", "ascending")])
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(sent.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    out = identify(docs, learn(docs))
    return out.select("doc_id", held_out(F.col("doc_id"), *HOLD).alias("held_out"), "lang_pred", "score")
