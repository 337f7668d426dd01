"""Benchmark decontamination: one Aho-Corasick automaton over all item windows.

Texts are normalised to lower-cased words of digits, ASCII letters and non-ASCII
characters, joined by one space.  Every window of `width` consecutive item words (an
item of fewer words, but not none, is one window) is a pattern; each text is scanned
once and matches are mapped back to word positions and to code points of the text.

Defined cases: a null or wordless text has no words and no hits; an item without
words has no window; an item with a null id marks words but is not counted; repeated
items count once; extra columns are ignored; an empty benchmark hits nothing.

The items are broadcast only in shards of at most `shard_bytes` of pattern text, a
bound that is checked; for a larger benchmark each task puts its rows into a temporary file, scans
them by one shard after another and merges the hits row by row, so neither the result nor its rows depend on the number of shards.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 10
SHARD_BYTES = 32 << 20

#: Bytes to normalised bytes: separators become spaces, A-Z lower case.
_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
_SPANS = "n_words long, hit_words array<int>, spans array<struct<start:int,end:int>>, items array<string>, any_item boolean"


def normalised(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def item_windows(text: str | None, width: int = WIDTH) -> list[str]:
    w = normalised(text)
    if not w:
        return []
    return [b" ".join(w[i : i + width]).decode("utf-8", "surrogatepass") for i in range(max(1, len(w) - width + 1))]


def _automaton(items: list[tuple[str | None, str]], width: int):
    """Items are (id as string, text)."""
    owners: dict[str, list[str | None]] = {}
    for item, text in items:
        for window in dict.fromkeys(item_windows(text, width)):
            owners.setdefault(window, []).append(item)
    machine = ahocorasick.Automaton()
    for window, ids in owners.items():
        machine.add_word(f" {window} ", (window.count(" ") + 1, tuple(dict.fromkeys(ids))))
    if owners:
        machine.make_automaton()
    return machine, bool(owners)


def _code_points(text: str, words: set[int]) -> dict[int, tuple[int, int]]:
    """Start and end of the given words in the original text."""
    raw = text.encode("utf-8", "surrogatepass")
    out, at, k = {}, 0, 0
    folded = raw.translate(_FOLD)
    points = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    for w in folded.split():
        at = folded.index(w, at)
        if k in words:
            out[k] = (int(points[at]) - 1, int(points[at + len(w) - 1]))
        at += len(w)
        k += 1
    return out


def hits(text: str | None, machine, ready: bool) -> tuple[int, np.ndarray, set[str | None]]:
    """(words, hit word positions, item ids)."""
    w = normalised(text)
    nothing = np.zeros(0, np.int32)
    if not w or not ready:
        return len(w), nothing, set()
    line = b" " + b" ".join(w) + b" "
    line = line.decode("utf-8", "surrogatepass")
    found = list(machine.iter(line))
    if not found:
        return len(w), nothing, set()
    # the k-th space ends word k - 1; a match ends on a space
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32) == 0x20)
    last = np.searchsorted(spaces, [end for end, _ in found]) - 1
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, last + 1, -1)
    np.add.at(cover, last + 1 - np.array([v[0] for _, v in found]), 1)
    return len(w), np.flatnonzero(np.cumsum(cover[:-1]) > 0).astype(np.int32), {i for _, v in found for i in v[1]}


def spans_of(text: str | None, at: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the original that the runs of hit words cover."""
    if not len(at):
        return []
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    points = _code_points(text, {int(k) for r in runs for k in (r[0], r[-1])})
    return [(points[int(r[0])][0], points[int(r[-1])][1]) for r in runs]


def _shards(benchmark: DataFrame, shard_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("t"))
    size = items.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-size * WIDTH // shard_bytes) or 1  # patterns overlap: a word stands in up to WIDTH of them
    return [items.where(F.pmod(F.xxhash64("t", "item"), F.lit(n)) == k) if n > 1 else items for k in range(n)]


def find(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int = WIDTH, spans: bool = True, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The columns `keep` of every document, with n_words, hit_words, spans, items and any_item.

    A narrow pass over the documents without any shuffle, whatever the number of shards: a row in is a row out.
    """
    sc = docs.sparkSession.sparkContext
    cols = [*keep, *(["text"] if "text" not in keep else [])]
    schema = ", ".join([f"`{c}` {t}" for c, t in docs.select(*cols).dtypes])
    # at most shard_bytes of patterns each
    shards = [sc.broadcast([(r["item"], r["t"]) for r in s.collect()]) for s in _shards(benchmark, shard_bytes)]

    def made(batch: pa.RecordBatch, got: list[tuple[int, np.ndarray, set]]) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist() if spans else []
        where = [spans_of(t, g[1]) for t, g in zip(texts, got)] if spans else [[] for _ in got]
        new = [
            pa.array([g[0] for g in got], pa.int64()),
            pa.array([g[1] for g in got], pa.list_(pa.int32())),
            pa.array([[{"start": s, "end": e} for s, e in w] for w in where], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
            pa.array([sorted(i for i in g[2] if i is not None) for g in got], pa.list_(pa.string())),
            pa.array([len(g[1]) > 0 for g in got], pa.bool_()),
        ]
        return pa.RecordBatch.from_arrays([batch.column(c) for c in cols] + new, names=[*cols, "n_words", "hit_words", "spans", "items", "any_item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if len(shards) == 1:
            machine, ready = _automaton(shards[0].value, width)
            for batch in batches:
                yield made(batch, [hits(t, machine, ready) for t in batch.column("text").to_pylist()])
            return
        with tempfile.TemporaryFile() as file:
            writer = None
            for batch in batches:
                writer = writer or pa.ipc.new_stream(file, batch.schema)
                writer.write_batch(batch)
            if writer is None:
                return
            writer.close()

            def again() -> Iterator[pa.RecordBatch]:
                file.seek(0)
                yield from pa.ipc.open_stream(file)

            merged: list[tuple[int, np.ndarray, set]] = []
            for k, shard in enumerate(shards):
                machine, ready = _automaton(shard.value, width)
                row = 0
                for batch in again():
                    for t in batch.column("text").to_pylist():
                        g = hits(t, machine, ready)
                        if k == 0:
                            merged.append(g)
                        elif len(g[1]):
                            n, at, ids = merged[row]
                            merged[row] = n, np.union1d(at, g[1]), ids | g[2]
                        row += 1
                del machine  # one automaton at a time
            row = 0
            for batch in again():
                yield made(batch, merged[row : row + batch.num_rows])
                row += batch.num_rows

    return docs.select(*cols).mapInArrow(run, f"{schema}, {_SPANS}").select(*keep, "n_words", "hit_words", "spans", "items", "any_item")


def digest(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document."""
    hit = find(docs.select("doc_id", "text"), benchmark, ["doc_id"], width, spans=False)
    return hit.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents (all columns, of whatever names) without any benchmark window."""
    inner = ["text" if c == "text" else f"_c{i}" for i, c in enumerate(docs.columns)]
    free = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, inner)])
    kept = find(free, benchmark, inner, width, spans=False).where(~F.col("any_item"))
    return kept.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, inner)])


def brute_digest(doc: str | None, items: list[tuple[object, str | None]], width: int = WIDTH):
    """The digest of one document by comparing every window at every position (for tests)."""
    w = normalised(doc)
    hit, ids = set(), set()
    for item, text in items:
        v = normalised(text)
        for i in range(max(1, len(v) - width + 1) if v else 0):
            x = v[i : i + width]
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    ids.add(item)
    names = sorted(str(i) for i in ids if i is not None)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)
