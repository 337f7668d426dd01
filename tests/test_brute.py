"""Queries that SQL cannot say, each against a plain recomputation in Python over the same tables."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe.operators import balance as P
from loomframe.operators import selection as L
from loomframe.plans import catalog, views

SF = "/root/testdata/sf0.001"
BRUTE = {}


def brute(name):
    def put(fn):
        BRUTE[name] = fn
        return fn

    return put


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def hashes(spark, rows, *first):
    """xxhash64 of the given literals and each tuple, computed by Spark alone."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)])
    return [r[0] for r in df.orderBy("_1").select(F.xxhash64(*[F.lit(x) for x in first], *df.columns[1:])).collect()]


def near(got, want, tolerance=2e-6):
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert v == pytest.approx(want[k], abs=tolerance), k


@brute("random_split")
def _(spark, got):
    ids = [r["doc_id"] for r in table(spark, "documents").collect()]
    u = [(h % (1 << 30)) / (1 << 30) for h in hashes(spark, [(i,) for i in ids], 7)]
    assert {r["doc_id"]: r["split"] for r in got} == {i: "test" if x < 0.1 else "train" for i, x in zip(ids, u)}


def _groups(got):
    groups = defaultdict(list)
    for r in sorted(got, key=lambda r: r["row_idx"]):
        groups[r["b"]].append(r)
    return groups


@brute("greedy_partitions")
def _(spark, got):
    for rows in _groups(got).values():
        load = [0.0] * 4
        for r in rows:
            j = load.index(min(load))
            assert r["part"] == j
            load[j] += r["length"]


def _differencing(weights, k):
    """By definition: the two partial partitions of the widest spread are merged, heaviest set with lightest."""
    parts = [[(float(w), (i,))] + [(0.0, ())] * (k - 1) for i, w in sorted(enumerate(weights), key=lambda x: (x[1], x[0]))]
    order = lambda p: sorted(p, key=lambda s: (-s[0], -len(s[1]), s[1]))
    parts = [order(p) for p in parts]
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0] - p[-1][0]), -p[0][0], p[0][1]))
        a, b = parts.pop(0), parts.pop(0)
        parts.append(order([(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, b[::-1])]))
    return [set(s[1]) for s in parts[0]]


@brute("balanced_partitions")
def _(spark, got):
    for rows in _groups(got).values():
        rows = rows[:]
        want = _differencing([r["length"] for r in rows], 4)
        assert sorted(map(sorted, want)) == sorted([i for i, r in enumerate(rows) if r["part"] == p] for p in range(4))
        sums = sorted(sum(r["length"] for r in rows if r["part"] == p) for p in range(4))
        assert sums[-1] - sums[0] <= max(r["length"] for r in rows)


@brute("micro_batches")
def _(spark, got):
    for rows in _groups(got).values():
        n = [int(r["length"]) for r in rows]
        k = min(len(n), -(-sum(n) // 200_000))
        want = _differencing([24576.0 * x + float(x) * x for x in n], k)
        assert sorted(map(sorted, want)) == sorted([i for i, r in enumerate(rows) if r["part"] == p] for p in range(k))


@brute("sticky_servers")
def _(spark, got):
    e = {r["event_id"]: r["user_id"] for r in table(spark, "events").collect()}
    h = dict(zip(sorted(set(e.values())), hashes(spark, [(u,) for u in sorted(set(e.values()))])))
    assert {r["event_id"]: r["server"] for r in got} == {i: h[u] % 4 for i, u in e.items()}


def _prompts(spark):
    of = defaultdict(list)
    for r in table(spark, "orders").orderBy("o_orderkey").collect():
        of[r["o_custkey"]].append((r["o_orderkey"], r["o_totalprice"] / 7919.0))
    return of


@brute("bootstrap_metrics")
def _(spark, got):
    want = {}
    for uid, rows in _prompts(spark).items():
        v, rng = np.array([x for _, x in rows]), np.random.RandomState(42)
        draws = [v[rng.choice(len(v), size=2, replace=True)] for _ in range(200)]
        best, worst = [d.max() for d in draws], [d.min() for d in draws]
        want[uid] = (np.mean(best), np.std(best), np.mean(worst), np.std(worst))
    near({r["uid"]: (r["best_mean"], r["best_std"], r["worst_mean"], r["worst_std"]) for r in got}, want)


@brute("majority_of_k")
def _(spark, got):
    want = {}
    for uid, rows in _prompts(spark).items():
        ks, k = [], 2
        while len(rows) > 1 and k < len(rows):
            ks.append(k)
            k *= 2
        for k in [*ks, len(rows)] if len(rows) > 1 else []:
            rng, values = np.random.RandomState(42), []
            for _ in range(100):
                draw = [rows[i] for i in rng.choice(len(rows), size=k, replace=True)]
                votes = Counter(pos % 3 for pos, _ in draw)  # in the order in which the draw holds them
                winner = max(votes, key=votes.get)
                values.append(next(x for pos, x in draw if pos % 3 == winner))
            want[uid, k] = (np.mean(values), np.std(values))
    near({(r["uid"], r["k"]): (r["maj_mean"], r["maj_std"]) for r in got}, want)


def _vectors(spark):
    rows = table(spark, "embeddings").orderBy("vec_id").collect()
    v = np.array([r["embedding"] for r in rows], float)
    return [r["vec_id"] for r in rows], v, np.array([r["label"] for r in rows])


@brute("diverse_rows")
def _(spark, got):
    ids, v, label = _vectors(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for c in set(label):
        at = np.flatnonzero(label == c)
        sim = u[at] @ u[at].T
        np.fill_diagonal(sim, -np.inf)
        density = 1 / ((1 - np.sort(sim, axis=1)[:, ::-1][:, :10]).mean(1) + 1e-8)
        middle = u[at].mean(0) / np.linalg.norm(u[at].mean(0))
        score = (density - density.min()) / (density.max() - density.min()) * np.clip(u[at] @ middle, 0, 1)
        left, want = list(np.argsort(-score, kind="stable")), []
        while left and len(want) < 5:
            want.append(left.pop(0))
            left = [i for i in left if u[at[i]] @ u[at[want[-1]]] < 0.85]
        for i in np.argsort(-score, kind="stable"):
            if len(want) < 5 and i not in want:
                want.append(i)
        assert [r["idx"] for r in sorted(got, key=lambda r: r["rank"]) if r["cluster"] == c] == [ids[at[i]] for i in want]


@brute("mmd_rows")
def _(spark, got):
    ids, v, label = _vectors(spark)
    for c in set(label):
        at = np.flatnonzero(label == c)
        k = np.exp(-0.05 * ((v[at][:, None] - v[at]) ** 2).sum(2))
        want = []
        for n in range(1, 6):  # the row that brings the mean embedding of the subset nearest to the cluster's
            far = {i: k[np.ix_([*want, i], [*want, i])].sum() / n**2 - 2 * k[[*want, i]].mean(1).sum() / n for i in range(len(at)) if i not in want}
            want.append(min(far, key=far.get))
        assert [r["idx"] for r in sorted(got, key=lambda r: r["rank"]) if r["cluster"] == c] == [ids[at[i]] for i in want]


@brute("spherical_kmeans")
def _(spark, got):
    items = table(spark, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"))
    rows = {r["idx"]: r["cluster"] for r in L.kmeans_clusters(items, 10, 3).collect()}
    assert Counter(rows.values()) == {r["cluster"]: r["size"] for r in got} and len(rows) == items.count()
    ids, v, _ = _vectors(spark)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    own = np.array([rows[i] for i in ids])
    means = {c: u[own == c].mean(0) / np.linalg.norm(u[own == c].mean(0)) for c in set(own)}
    names = sorted(means)
    best = np.array(names)[np.argmax(u @ np.array([means[c] for c in names]).T, axis=1)]
    assert (best == own).mean() > 0.97  # every row is at its nearest centre


def _state(spark):
    return {r["c_custkey"]: (r["c_custkey"] % 9 + 1.0, r["c_custkey"] % 5 + 1.0) for r in table(spark, "customer").collect()}


@brute("beta_quantiles")
def _(spark, got):
    state, p = _state(spark), (np.arange(200_000) + 0.5) / 200_000
    want = {}
    for a, b in set(state.values()):
        w = p ** (a - 1) * (1 - p) ** (b - 1)
        order = np.argsort(p * (1 - p))
        upto = np.cumsum(w[order]) / w.sum()
        want[a, b] = (p * (1 - p))[order][np.searchsorted(upto, 0.9)]
    near({r["idx"]: r["weight"] for r in got}, {i: want[s] for i, s in state.items()}, 1e-4)


@brute("beta_draws")
def _(spark, got):
    state = _state(spark)
    h = dict(zip(sorted(state), hashes(spark, [(i,) for i in sorted(state)], 5)))
    p = {i: np.random.default_rng(abs(h[i])).beta(a, b) for i, (a, b) in state.items()}
    near({r["idx"]: r["weight"] for r in got}, {i: x * (1 - x) for i, x in p.items()})


def _customers(spark):
    return {r["c_custkey"]: r["c_acctbal"] for r in table(spark, "customer").collect()}


@brute("random_selection")
def _(spark, got):
    c = sorted(_customers(spark))
    h = hashes(spark, [(i,) for i in c], 0)
    assert {r["idx"] for r in got} == {i for _, i in sorted(zip(h, c))[: len(c) // 10]}


@brute("weighted_selection")
def _(spark, got):
    c = _customers(spark)
    h = hashes(spark, [(i,) for i in sorted(c)], 9)
    key = [(-math.log((x % ((1 << 53) - 1) + 1) / (1 << 53)) / c[i], i) for i, x in zip(sorted(c), h) if c[i] > 0]
    assert {r["idx"] for r in got} == {i for _, i in sorted(key)[:100]}


@brute("resampled_rows")
def _(spark, got):
    c = _customers(spark)
    ids = sorted(c)
    upto = np.cumsum([max(c[i], 1e-8) for i in ids])
    x = [(h % (1 << 53)) / (1 << 53) * upto[-1] for h in hashes_of_draws(spark, 500, 3)]
    want = [ids[int(np.searchsorted(upto, v, side="right"))] for v in x]
    assert [r["row_idx"] for r in sorted(got, key=lambda r: r["draw"])] == want


def hashes_of_draws(spark, n, seed):
    return [r[0] for r in spark.range(n).orderBy("id").select(F.xxhash64("id", F.lit(seed))).collect()]


@brute("ridge_predictions")
def _(spark, got):
    ids, v, _ = _vectors(spark)
    x, y = np.column_stack([v, np.ones(len(v))]), np.array([i % 7 / 7 for i in ids])
    inverse = np.linalg.inv(x.T @ x + np.eye(x.shape[1]))
    want = {i: (p, s) for i, p, s in zip(ids, x @ inverse @ x.T @ y, np.sqrt((x @ inverse * x).sum(1)))}
    near({r["idx"]: (r["predicted"], r["sigma"]) for r in got}, want, 1e-5)


@brute("traced_rows")
def _(spark, got):
    e = [(r["user_id"], r["event_id"]) for r in table(spark, "events").collect()]
    users = sorted({u for u, _ in e})
    top = {u for _, u in sorted(zip(hashes(spark, [(u,) for u in users], 0), users))[:5]}
    assert sorted((r["user_id"], r["event_id"]) for r in got) == sorted(x for x in e if x[0] in top)


@brute("loss_clip_cov")
def _(spark, got):
    t = views.trajectories(spark, SF).collect()
    tok = [(r["row_idx"], i, a, lp, o) for r in t for i, (a, lp, o, m) in enumerate(zip(r["advantages"], r["lp"], r["old_lp"], r["mask"])) if m]
    ma, ml = np.mean([x[2] for x in tok]), np.mean([x[3] for x in tok])
    one = [-a * math.exp(lp - o) for _, _, a, lp, o in tok]
    two = [-a * min(max(math.exp(lp - o), 0.8), 1.2) for _, _, a, lp, o in tok]
    cov = [(a - ma) * (lp - ml) for _, _, a, lp, _ in tok]
    open_ = [k for k in range(len(tok)) if 0 < cov[k] < 0.5 and not two[k] > one[k]]
    df = spark.createDataFrame([(k, tok[k][0], tok[k][1]) for k in open_], "k int, key long, t int")
    kind = dict(views.trajectories(spark, SF).dtypes)["row_idx"]
    order = df.select("k", F.xxhash64(F.col("key").cast(kind), "t", F.lit(0)).alias("h"), "key", "t").orderBy("h", "key", "t").limit(max(int(0.002 * len(tok)), 1))
    out = {r["k"] for r in order.collect()}
    assert out and got[0]["loss"] == pytest.approx(np.mean([0.0 if k in out else max(x, y) for k, (x, y) in enumerate(zip(one, two))]), abs=2e-6)
    assert got[0]["clip_fraction"] == pytest.approx(len(out) / len(tok), abs=2e-6)


@brute("reject_combined")
def _(spark, got):
    want = {}
    for r in views.trajectories(spark, SF).collect():
        ratio = [o - q for o, q in zip(r["old_lp"], r["rollout_lp"])]
        valid = [x for x, m in zip(ratio, r["mask"]) if m]
        k3 = sum(math.exp(x) - 1 - x for x in valid) / len(valid) if valid else 0.0
        kept = sum(0.7 <= math.exp(-x) <= 1.3 for x in valid) if k3 <= 0.0419 else 0
        weight = sum(min(math.exp(min(max(x, -20), 20)), 2.0) for x in valid)
        want[r["row_idx"]] = (kept, weight)
    near({r["rid"]: (r["kept"], r["weight"]) for r in got}, want, 1e-5)


@brute("select_similarity")
def _(spark, got):
    ids, v, _ = _vectors(spark)
    u, value = v / np.linalg.norm(v, axis=1, keepdims=True), np.array([i % 7 / 7 for i in ids])
    sim = u @ u.T
    key = []
    for row, i, h in zip(sim, ids, hashes(spark, [(i,) for i in ids], 4)):
        top = np.argsort(-row, kind="stable")[:8]
        w = np.exp((row[top] - row[top[0]]) / 0.05)
        p = math.exp(-abs((w * value[top]).sum() / w.sum() - 0.5) / 0.1)
        key.append((-math.log((h % ((1 << 53) - 1) + 1) / (1 << 53)) / p, i))
    assert {r["idx"] for r in got} == {i for _, i in sorted(key)[:30]}


@brute("discovery_rounds")
def _(spark, got):
    by = defaultdict(list)
    for r in got:
        by[r["round"]].append(r["idx"])
    first, second, third = (set(by[k]) for k in (1, 2, 3))
    # 30 new rows and 10 repeats, 30 and 10, then the last 10 rows of the cap and 30 repeats
    assert [len(by[k]) for k in (1, 2, 3)] == [40, 40, 40] and len(first) == 30
    assert len(second - first) == 30 and len(third - first - second) == 10 and len(first | second | third) == 70


def test_every_query_without_twin_is_here():
    assert set(BRUTE) == set(catalog.QUERIES) - set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(BRUTE))
def test_brute(spark, name):
    got = catalog.QUERIES[name](spark, SF).collect()
    assert got
    BRUTE[name](spark, got)


def test_frozen_rounds_draw_from_the_pool(spark):
    items = spark.range(100).withColumnRenamed("id", "idx")
    rounds, config = L.Rounds(cap=20, floor=25), L.SelectionConfig("random", 15, seed=2)
    sets = []
    for _ in range(4):
        got, metrics = L.discovery_round(items, config, rounds, 100)
        sets.append([r[0] for r in got.collect()])
    assert [len(set(s)) for s in sets[:2]][0] == 15 and len({i for s in sets for i in s}) == 20 and rounds.frozen and metrics["frozen"]
    assert all(len(s) == 25 for s in sets) and rounds.remaining() == 0
    assert L.exploration_rows(items, rounds, 5, 1).count() == 0
    fresh = L.Rounds(cap=3)
    fresh.admit(spark.range(2).withColumnRenamed("id", "idx"), "probe")
    assert L.exploration_rows(items, fresh, 5, 1).count() == 1


def test_probes_keep_their_distance(spark):
    vec = [(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.05, 0.99])]
    items = spark.createDataFrame(vec, "idx long, vec array<double>")
    predictions = spark.createDataFrame([(i, 1.0 - i / 10, 0.0) for i in range(5)], "idx long, predicted double, sigma double")
    assert L.probes(items, predictions, 3, radius=0.2, batch=2) == [0, 2, 3]
    assert L.probes(items, predictions, 9, radius=0.0, batch=2) == [0, 1, 2, 3, 4]


def test_partitions_are_checked():
    with pytest.raises(ValueError):
        P.checked([[0], []], 1)
    with pytest.raises(ValueError):
        P.checked([[0], [0]], 2)
