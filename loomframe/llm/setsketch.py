"""Near-duplicates by MinHash with SetSketch registers.

A document is the set of its distinct `width`-word shingles.  A register is the
exponentially spaced, truncated minimum of an exponential variable over the set, so
sketches of unions are registers' maxima and two registers agree with about the sets'
similarity.  Bands of registers propose buckets; inside a bucket a joint likelihood of two
sketches and the exact set sizes says which pairs may reach the threshold; what may is
grouped, and links are then confirmed on full sets with integer arithmetic.  The number of bands
is chosen so that a pair at the threshold is missed with probability below `MISS`; the
likelihood test only drops a pair that is exp(-SURE) times less likely to reach it.

Equal sets are one node throughout, found by a 128-bit digest with map-side combine.
Small buckets and groups are compared pair by pair in one task.  Large ones are cut into blocks by id hash, and every
block meets about `HEADS` members drawn by hash: m near copies of one text cost HEADS * m comparisons.  Members outside the
greatest component that this finds are then compared with all members, block by block, so no pair of texts
goes unseen that could add a link; r such members of m cost r * m comparisons and r * m / CHUNK rows of shuffle, which is quadratic only for
groups that are chains rather than copies.  Tasks emit spanning links only, never all pairs.  Components come from star contraction over
tables, checkpointed each round.

Defined cases: a null, empty or wordless text has the empty set, is linked with
nothing and is its own component; fewer words than `width` are one shingle; rows that share a doc_id
count as one document with several texts; a null doc_id joins the component of an
equal set, but proposes no other links; the smallest doc_id of a component names it and is kept;
extra columns are ignored or, in `deduplicated`, kept.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_names, in_tasks, own_names
from .tokens import SPACE_TABLE, distinct_sets, pieces, text_bytes, windows, words

ROWS, MISS, SURE = 5, 1e-6, 12.5
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: Members that a task compares pair by pair at most (half of them), of buckets and of groups.
BUCKET_BLOCK, GROUP_BLOCK = 1024, 128
#: Of large buckets and groups: members of a block, heads expected, and heads of a task of the second pass.
BLOCK, HEADS, CHUNK = 1024, 16, 128
#: A node with more links than HUB and more than 1 / HUBS of all is a hub; there are fewer than HUBS.
HUB, HUBS = 1_000, 1_000


def bands_for(num: int, den: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log1p(-((num / den) ** rows)))


def _seeds(m: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 1 << 63, m, dtype=np.uint64), rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets_of(texts: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, values, offsets): sorted distinct shingle hashes, about a megabyte of text at a time."""
    data, off = text_bytes(texts)
    for a, b in pieces(off, 1 << 20):
        h, _, _, per = words(data[off[a] : off[b]], off[a : b + 1] - off[a], SPACE_TABLE)
        yield a, b, *distinct_sets(*windows(h, per, width))


def registers(values: np.ndarray, off: np.ndarray, m: int) -> np.ndarray:
    """[row, register] of not empty sets; rows of empty sets are 0."""
    out = np.zeros((len(off) - 1, m), np.uint16)
    some = np.diff(off) > 0
    begin = off[:-1][some]
    if not len(begin):
        return out
    xor, mul = _seeds(m)
    least = np.empty((len(begin), m), np.uint64)
    for i in range(m):
        least[:, i] = np.minimum.reduceat((values ^ xor[i]) * mul[i], begin)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    out[some] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / math.log(BASE)), 0, TOP).astype(np.uint16)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def estimate(d0, up, down, u, v):
    """Likeliest similarity from equal, greater and smaller registers and the shares u + v = 1 of the set sizes."""
    m = d0 + up + down
    b = d0 * (u * u + v * v) + up * v * v + down * u * u
    j = (b - np.sqrt(np.maximum(b * b - 4 * m * d0 * u * u * v * v, 0))) / (2 * m * u * v)
    return np.clip(j, 0, np.minimum(u / v, v / u))


def _log_likelihood(j, d0, up, down, u, v):
    low = 1e-12
    return d0 * np.log(np.maximum(j, low)) + up * np.log(np.maximum(u - v * j, low)) + down * np.log(np.maximum(v - u * j, low))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of sketches (rows of a and b) may have a similarity of num / den."""
    d0 = (a == b).sum(1).astype(np.float64)
    up = (a > b).sum(1).astype(np.float64)
    down = a.shape[1] - d0 - up
    u = na / (na + nb)
    v = 1 - u
    j = estimate(d0, up, down, u, v)
    t = num / den
    gap = _log_likelihood(j, d0, up, down, u, v) - _log_likelihood(t, d0, up, down, u, v)
    return (den * np.minimum(na, nb) >= num * np.maximum(na, nb)) & ((j >= t) | (gap <= SURE))


class _Forest:
    """Union-find over 0..n-1 that only ever looks at labels that differ."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.label[i], self.label[j]
            off = a != b
            if not off.any():
                return
            i, j, a, b = i[off], j[off], a[off], b[off]
            low, high = np.minimum(a, b), np.maximum(a, b)
            to = np.arange(len(self.label))
            np.minimum.at(to, high, low)
            while True:
                nxt = to[to]
                if (nxt == to).all():
                    break
                to = nxt
            self.label = to[self.label]


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole runs of equal keys, of about a batch each, from a stream sorted by key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        if held and held[-1].column(key)[-1].as_py() == k[0]:
            change = np.flatnonzero(k != k[0])
            cut_at = int(change[0]) if len(change) else len(k)
            held.append(batch.slice(0, cut_at))
            batch, k = batch.slice(cut_at), k[cut_at:]
            if not len(k):
                continue
        if held:
            yield pa.Table.from_batches(held)
        last = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        if last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def sketches(docs: DataFrame, width: int, m: int) -> DataFrame:
    """doc_id, n, hi, lo, sketch of every document; hi and lo are the set's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, hi, lo, sk = [], [], [], []
            for _, _, values, off in sets_of(batch.column("text"), width):
                raw = values.tobytes()
                reg = registers(values, off, m)
                for i in range(len(off) - 1):
                    d = hashlib.blake2b(raw[8 * off[i] : 8 * off[i + 1]], digest_size=16).digest()
                    hi.append(int.from_bytes(d[:8], "big", signed=True))
                    lo.append(int.from_bytes(d[8:], "big", signed=True))
                    sk.append(reg[i].tobytes())
                n += np.diff(off).tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sk, pa.binary())],
                names=["doc_id", "n", "hi", "lo", "sketch"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, hi long, lo long, sketch binary")


def _joined_heads(links):
    """key, head, comp of one key's links among heads, a few dozen at most whatever the key's size."""
    import pandas as pd

    name, place = np.unique(links[["a", "b"]].to_numpy().ravel(), return_inverse=True)
    forest = _Forest(len(name))
    place = place.reshape(-1, 2)
    forest.join(place[:, 0], place[:, 1])
    return pd.DataFrame({"key": links["key"].iloc[0], "head": name, "comp": name[forest.label]})


def _by_heads(members: DataFrame, payload: DataFrame, linked, block: int) -> DataFrame:
    """a, b: spanning links within large groups, from members(key, node, size) and payload(node, ...).

    linked(heads, members) says which pairs [member, head] of two Arrow tables of payload rows are linked; only
    members outside the greatest component that links with heads make are compared with all others.
    """
    kind, fields = members.schema["node"].dataType.simpleString(), [c for c in payload.columns if c != "node"]
    width, chunk = (BLOCK, CHUNK) if block >= 64 else (block, block)
    k = F.ceil(F.col("size") / width).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("block"), "node"), k).cast("int")
    every = F.explode(F.sequence(F.lit(0), k - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, heads, forest = None, None, None

        def found(key, a, b, among_heads=False):
            return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, types[0]), pa.array(b, types[0]), pa.array([among_heads] * len(a), pa.bool_())], names=["key", "a", "b", "among_heads"])

        types = [None]
        for batch in batches:
            types[0] = batch.schema.field("node").type
            at = batch.column("_g").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]]) if len(at) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                part = pa.Table.from_batches([batch.slice(s, e - s)])
                if at[s] != g:
                    g, heads = at[s], None
                role = part.column("role").to_numpy()
                top = part.filter(pa.array(role == 0))
                if top.num_rows:
                    heads = top if heads is None else pa.concat_tables([heads, top])
                    forest = _Forest(heads.num_rows)
                rest = part.filter(pa.array(role == 1))
                if not rest.num_rows:
                    continue
                key, node = rest.column("key").to_numpy(), rest.column("node").to_numpy()
                if heads is None:
                    yield found(key, node, [None] * len(node))
                    continue
                name = heads.column("node").to_numpy()
                ok = linked(heads, rest)
                self_ = node[:, None] == name
                some = (ok & ~self_).any(1)
                first = (ok & ~self_).argmax(1)
                yield found(key[some], node[some], name[first[some]])
                if (~some).any():
                    yield found(key[~some], node[~some], [None] * int((~some).sum()))
                # heads that a member links, itself included if it is one
                i, j = np.nonzero((ok | self_) & some[:, None])
                f = first[i]
                before = forest.label.copy()
                forest.join(f, j)
                moved = np.flatnonzero(forest.label != before)
                if len(moved):
                    yield found(np.full(len(moved), key[0]), name[moved], name[forest.label[moved]], True)

    def compared(heads: DataFrame, rest: DataFrame) -> DataFrame:
        rows = heads.withColumn("role", F.lit(0)).unionByName(rest.withColumn("role", F.lit(1))).join(payload, "node")
        rows = rows.select("_g", "role", "key", "node", *fields).repartition("_g").sortWithinPartitions("_g", "role")
        return rows.mapInArrow(run, f"key long, a {kind}, b {kind}, among_heads boolean")

    one = compared(
        members.where(F.pmod(F.xxhash64(F.lit("head"), "node"), F.col("size")) < HEADS).select("key", "node", every.alias("at")).select("key", "node", F.xxhash64("key", "at").alias("_g")),
        members.select("key", "node", F.xxhash64("key", mine).alias("_g")),
    )
    one = cut(one)
    links = one.where("b is not null and a != b").select("a", "b")
    # two members of the greatest component add nothing; all others meet everybody
    comp = one.where("among_heads").select("key", "a", "b").distinct().groupBy("key").applyInPandas(_joined_heads, f"key long, head {kind}, comp {kind}")
    placed = one.where("not among_heads").select("key", F.col("a").alias("node"), F.col("b").alias("head")).join(comp, ["key", "head"], "left")
    placed = placed.select("key", "node", F.coalesce("comp", "head", "node").alias("comp"))
    per = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"))
    per = cut(per.where(F.col("n") < F.col("all")).select("key", "main", (F.col("all") - F.col("n")).alias("lone")))
    if per.isEmpty():
        return links
    lone = placed.join(per, "key").where(F.col("comp") != F.col("main")).select("key", "node")
    chunks = F.ceil(F.col("lone") / chunk).cast("int")
    left = members.join(per.select("key", "lone"), "key")
    number = F.pmod(F.xxhash64(F.lit("chunk"), "node"), chunks).cast("int")
    heads = lone.join(left, ["key", "node"]).select("key", "node", number.alias("c"), every.alias("at")).select("key", "node", F.xxhash64("key", "c", "at").alias("_g"))
    rest = left.select("key", "node", mine.alias("at"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("c")).select("key", "node", F.xxhash64("key", "c", "at").alias("_g"))
    two = compared(heads, rest).where("b is not null and a != b").select("a", "b")
    return links.unionByName(two)


def candidates(nodes: DataFrame, bands: int, num: int, den: int, rows: int = ROWS, block: int = BUCKET_BLOCK) -> DataFrame:
    """a, b: spanning links of the nodes (node, n, sketch) that may be similar, from all bands."""
    width = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substr("sketch", i * width + 1, F.lit(width))))
    banded = nodes.select("node", F.explode(keys).alias("key"))
    shared = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    kind = nodes.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "key"):
            g = table.column("key").to_numpy()
            node = table.column("node").to_numpy()
            n = table.column("n").to_numpy().astype(np.float64)
            sk = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(g), -1)
            forest = _Forest(len(g))
            shift, i = 1, np.flatnonzero(g[1:] == g[:-1])
            while len(i):  # pairs at distance 1, 2, ... within a bucket
                open_ = i[forest.label[i] != forest.label[i + shift]]
                for at in range(0, len(open_), 4096):
                    p = open_[at : at + 4096]
                    ok = plausible(sk[p], sk[p + shift], n[p], n[p + shift], num, den)
                    forest.join(p[ok], p[ok] + shift)
                shift += 1
                i = i[i + shift < len(g)]
                i = i[g[i] == g[i + shift]]
            child = np.flatnonzero(forest.label != np.arange(len(g)))
            a, b = node[child], node[forest.label[child]]
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def linked(heads: pa.Table, members: pa.Table) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(t.num_rows, -1) for t in (members, heads))
        nx, ny = (t.column("n").to_numpy().astype(np.float64) for t in (members, heads))
        return np.column_stack([plausible(x, np.broadcast_to(y[j], x.shape), nx, np.full(len(nx), ny[j]), num, den) for j in range(len(ny))])

    small = banded.join(shared.where(F.col("size") <= 2 * block).select("key"), "key").join(nodes.select("node", "n", "sketch"), "node").select("key", "node", "n", "sketch")
    links = small.repartition("key").sortWithinPartitions("key").mapInArrow(run, f"a {kind}, b {kind}")
    # fewer than nodes * bands / (2 * block) keys, often none
    large = shared.where(F.col("size") > 2 * block)
    if not large.isEmpty():
        links = links.unionByName(_by_heads(banded.join(large, "key"), nodes.select("node", "n", "sketch"), linked, block))
    return links.where("a != b").distinct()


def _with_least(links: DataFrame, least: DataFrame, most: int, hub: int) -> DataFrame:
    """The links u, v (at most `most`) with m from least (u, m, n links).

    The minima of hubs, fewer than HUBS rows, are broadcast, so that their links stay where they are.
    """
    hubs = least.where(F.col("n") > max(hub, most // HUBS)).select("u", "m")
    met = links.join(F.broadcast(hubs), "u", "left")
    rest = in_tasks(met.where("m is null").select("u", "v").join(least.select("u", "m"), "u"), most)
    return met.where("m is not null").select("u", "v", "m").unionByName(rest)


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """node, root: the smallest node of every component, for all nodes but the roots, from links a, b.

    Large-star and small-star steps alternate until every node has one link, to a node that has none.  Minima are
    combined before the shuffle and joined back, those of hubs by broadcast, so that a hub does not gather in one task.
    Rounds run in as many tasks as the number of links asks for.  Each of the two steps is checkpointed: a step's plan
    reads its links several times, and the driver plans, describes and replans every one of these copies.
    """
    e = cut(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    most = e.count()  # no step makes more links than there were

    def settled() -> bool:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        per = in_tasks(ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")), 2 * most)
        return per.where("up > 1 or up = 1 and down = 1").isEmpty()

    while not settled():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = in_tasks(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")), 2 * most)
        e = cut(_with_least(both, least, 2 * most, hub).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), most)
        least = in_tasks(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), most)
        ends = F.array(F.col("u"), F.when(F.col("v") != F.col("m"), F.col("v")))
        e = cut(_with_least(e, least, most, hub).select(F.explode(ends).alias("u"), F.col("m").alias("v")).where("u is not null").distinct(), most)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def confirmed(docs: DataFrame, groups: DataFrame, width: int, num: int, den: int, block: int = GROUP_BLOCK) -> DataFrame:
    """node, root: the components by links that hold on full sets, within groups (node, root); a root is its own node too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    sizes = cut(whole.groupBy("root").agg(F.count(F.lit(1)).alias("size")))
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("node"), "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [values[off[i] : off[i + 1]].tobytes() for _, _, values, off in sets_of(batch.column("text"), width) for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), batch.column("size"), pa.array(made, pa.binary())], names=["node", "root", "size", "shingles"])

    # texts are shuffled once; the sets of group members serve small and large groups
    sets = texts.join(whole.join(sizes, "root"), "node").select("node", "root", "size", "text")
    sets = cut(sets.mapInArrow(to_sets, f"node {kind}, root {kind}, size long, shingles binary").where(F.length("shingles") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "root"):
            g, node = table.column("root").to_numpy(), table.column("node").to_numpy()
            raw = table.column("shingles").to_pylist()
            a, b = [], []
            begin = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
            for s, e in zip(begin[:-1], begin[1:]):
                if e - s > 1:  # nodes are in order, so that the least of a component is its first
                    child, parent = links_within([np.frombuffer(x, np.uint64) for x in raw[s:e]], num, den)
                    a.append(node[s:e][child])
                    b.append(node[s:e][parent])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["node", "root"])

    small = sets.where(F.col("size") <= 2 * block).select("node", "root", "shingles")
    roots = small.repartition("root").sortWithinPartitions("root", "node").mapInArrow(run, f"node {kind}, root {kind}").where("node != root").groupBy("node").agg(F.min("root").alias("root"))
    large = sizes.where(F.col("size") > 2 * block)
    if large.isEmpty():
        return roots

    def linked(heads: pa.Table, members: pa.Table) -> np.ndarray:
        x = [np.frombuffer(v, np.uint64) for v in members.column("shingles").to_pylist()]
        values, n = np.concatenate(x), np.array([len(v) for v in x])
        begin = np.cumsum(n) - n
        out = np.zeros((len(x), heads.num_rows), bool)
        for j, raw in enumerate(heads.column("shingles").to_pylist()):
            y = np.frombuffer(raw, np.uint64)
            hit = y[np.minimum(np.searchsorted(y, values), len(y) - 1)] == values
            inter = np.add.reduceat(hit, begin, dtype=np.int64)
            out[:, j] = den * inter >= num * (n + len(y) - inter)
        return out

    hashed = whole.join(large, "root").select(F.xxhash64(F.lit("group"), "root").alias("key"), "node", "size", "root")
    links = _by_heads(hashed.drop("root"), sets.where(F.col("size") > 2 * block).select("node", "shingles"), linked, block)
    return roots.unionByName(components(links))


def links_within(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (child, parent) among sorted sets whose similarity reaches num / den, all pairs compared."""
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    value, column, df = np.unique(np.concatenate(sets) if len(owner) else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    owner, column = owner[shared], column[shared]
    rank = np.cumsum(df > 1) - 1
    column = rank[column]
    inter = np.zeros((len(sets), len(sets)), np.int64)
    wide = int((df > 1).sum())
    step = max(1024, (4 << 20) // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, wide, step):
        i, j = np.searchsorted(column, [at, at + step])
        x = np.zeros((len(sets), min(step, wide - at)), np.float32)
        x[owner[i:j], column[i:j] - at] = 1
        inter += np.rint(x @ x.T).astype(np.int64)
    linked = (den * inter >= num * (size[:, None] + size - inter)) & (size[:, None] > 0) & (size > 0)
    forest = _Forest(len(sets))
    i, j = np.nonzero(np.triu(linked, 1))
    forest.join(i, j)
    child = np.flatnonzero(forest.label != np.arange(len(sets)))
    return child, forest.label[child]


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    bands = bands_for(num, den)
    sk = cut(sketches(docs, width, bands * ROWS))
    nodes = cut(
        sk.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        sk.count(),
        64 + 2 * bands * ROWS,
    )
    named = nodes.where("node is not null")
    groups = components(candidates(named.select("node", "n", "sketch"), bands, num, den))
    roots = confirmed(docs, groups, width, num, den)
    comp = named.select("hi", "lo", "node").join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("component"))
    out = sk.select("doc_id", "n", "hi", "lo").join(comp, ["hi", "lo"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, 3, 85, 100)


def deduplicated(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents (all columns), one of each component.

    Of rows that share a kept doc_id one stays, and of rows without id one of each text that
    no row with an id has.
    """
    kept = near_duplicates(docs.select("doc_id", "text"), width, num, den).where("kept")
    ids = kept.where("doc_id is not null").select("doc_id").distinct()
    free, names = free_names(docs, "doc_id", "text")
    with_id = free.where("doc_id is not null").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    without = free.where("doc_id is null").dropDuplicates(["text"])
    if not without.isEmpty():
        known = free.where("doc_id is not null").select(F.xxhash64("text").alias("_known"), F.col("text").alias("_known_text"))
        without = without.withColumn("_hash", F.xxhash64("text"))
        without = without.join(known, (F.col("_hash") == F.col("_known")) & F.col("text").eqNullSafe(F.col("_known_text")), "left_anti")
    return own_names(with_id.select(*names).unionByName(without.select(*names)), names, docs.columns)


def brute(docs: list[tuple[object, str | None]], width: int, num: int, den: int) -> dict:
    """doc_id to (set size, smallest doc_id reachable) by comparing all pairs (for tests)."""
    import re

    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            inter = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * inter >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}
