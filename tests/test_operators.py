"""Small goldens and properties of the operators."""

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from loomframe.functions import arrays as A
from loomframe.functions import text as X
from loomframe.operators import advantages as G
from loomframe.operators import balance as P
from loomframe.operators import batch as B
from loomframe.operators import joins as J
from loomframe.operators import losses as M
from loomframe.operators import metrics as Q
from loomframe.operators import offpolicy as R
from loomframe.operators import selection as L
from loomframe.operators import state as K
from loomframe.sources import prep as D
from loomframe.sources import readers as S
from loomframe.streaming import queue as T


def one(df):
    return df.first()[0]


def test_group_mean_std(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (0, 3.0)], "uid int, score double")
    got = {r["uid"]: (r["mean"], r["std"], r["n"]) for r in G.group_mean_std(df).collect()}
    assert got[0] == (2.0, pytest.approx(math.sqrt(2)), 2) and got[1] == (0.0, 1.0, 1)


def test_masked_mean(spark):
    nan = float("nan")
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [1, 0, 0, 1]), ([1.0, 2.0, nan, 4.0], [1, 0, 0, 1]), ([1.0, 2.0, nan, 4.0], [1, 0, 1, 0])], "v array<double>, m array<int>")
    got = [r[0] for r in df.select(A.masked_mean("v", "m")).collect()]
    assert got[0] == pytest.approx(2.5) and got[1] == pytest.approx(2.5) and math.isnan(got[2])


def test_masked_var_needs_tokens(spark):
    with pytest.raises(PySparkException):
        spark.createDataFrame([([1.0], [1])], "v array<double>, m array<int>").select(A.masked_var("v", "m")).collect()


def test_gae_ignores_masked_values(spark):
    m = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rng = random.Random(3)
    r = [rng.random() if k else 0.0 for k in m]
    v = [rng.random() for _ in m]
    w = [x if k else 9.0 * rng.random() for x, k in zip(v, m)]
    df = spark.createDataFrame([(r, v, m), (r, w, m)], "r array<double>, v array<double>, m array<int>")
    a, b = [x[0] for x in df.select(A.gae("r", "v", "m", 0.9, 0.8)).collect()]
    assert [x for x, k in zip(a, m) if k] == pytest.approx([x for x, k in zip(b, m) if k])


@pytest.mark.parametrize("seed", [1, 2])
def test_rloo_twins_agree_on_groups(spark, seed):
    rng = random.Random(seed)
    rows = [(i, i % 5, rng.random()) for i in range(20)]
    df = spark.createDataFrame(rows, "row_idx int, uid int, score double")
    a = {r["row_idx"]: r["advantage"] for r in G.compute_advantage(df, "rloo").collect()}
    b = {r["row_idx"]: r["advantage"] for r in G.compute_advantage(df, "rloo_vectorized").collect()}
    assert a == pytest.approx(b)


def test_passk_single_group_fails(spark):
    with pytest.raises(PySparkException):
        G.compute_advantage(spark.createDataFrame([(0, 1, 1.0)], "row_idx int, uid int, score double"), "grpo_passk").collect()


def test_registries_refuse_second_names():
    for register in (G.register_estimator("grpo"), M.register_loss("vanilla"), L.register_selector("random"), S.register_loader("prompts")):
        with pytest.raises(ValueError):
            register(lambda *a: None)


def test_agg_loss_unknown_mode(spark):
    with pytest.raises(ValueError):
        M.agg_loss(None, "nope")
    with pytest.raises(NotImplementedError):
        M.kl_values("a", "b", "full")


def test_union_detects_conflicts(spark):
    a = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "row_idx long, x double")
    assert B.union_columns(a, a.withColumn("y", F.lit(1))).count() == 2
    with pytest.raises(PySparkException):
        B.union_columns(a, a.withColumn("x", F.lit(5.0))).collect()
    with pytest.raises(PySparkException):
        B.union_columns(a, a.limit(1)).collect()


@pytest.mark.parametrize("n,divisor", [(3, 2), (3, 7), (4, 2), (0, 3)])
def test_pad_unpad(spark, n, divisor):
    a = spark.range(n).select(F.col("id").alias("row_idx"), (F.col("id") * 10).alias("x"))
    padded, more = B.pad_to_divisor(a, divisor)
    rows = sorted(tuple(r) for r in padded.collect())
    assert len(rows) == n + more and (n == 0 or len(rows) % divisor == 0)
    assert [r[1] for r in rows] == [(i % n) * 10 for i in range(n + more)] if n else rows == []
    assert sorted(tuple(r) for r in B.unpad(padded, more, n + more).collect()) == [(i, i * 10) for i in range(n)]


def test_repeat_orders(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "row_idx long, x string")
    text = lambda d: "".join(r["x"] for r in sorted(d.collect(), key=lambda r: r["row_idx"]))
    assert text(B.repeat(a, 2)) == "aabb" and text(B.repeat(a, 2, interleave=False)) == "abab" and B.repeat(a, 0).count() == 0


def test_number_rows_and_slices(spark):
    a = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "x int")
    got = {r["x"]: r["row_idx"] for r in B.number_rows(a, ["x"]).collect()}
    assert got == {1: 0, 3: 1, 5: 2, 9: 3}
    b = B.number_rows(a, ["x"])
    assert sorted(r["x"] for r in B.slice_rows(b, -3, None, 2).collect()) == [3, 9]


def test_eos_and_lengths(spark):
    df = spark.createDataFrame([([20, 10, 34, 1, 0, 0, 0],)], "ids array<int>")
    assert one(df.select(A.eos_mask("ids", 1))) == [1, 1, 1, 1, 0, 0, 0]
    assert one(df.select(A.eos_mask("ids", [1, 10]))) == [1, 1, 0, 0, 0, 0, 0]
    assert one(df.select(A.fit_length("ids", 5, 0, truncation="middle"))) == [20, 10, 0, 0, 0]
    assert one(df.select(A.fit_length("ids", 9, 7))) == [7, 7, 20, 10, 34, 1, 0, 0, 0]
    with pytest.raises(PySparkException):
        df.select(A.fit_length("ids", 3, 0)).collect()


def test_bijection_fails_closed(spark):
    a = spark.createDataFrame([("x",), ("y",)], "k string")
    assert J.aligned(a, a.withColumn("v", F.lit(1)), "k").count() == 2
    for bad in ([("x",)], [("x",), ("y",), ("z",)], [("x",), ("y",), ("y",)], [("x",), ("",)], [("x",), (None,)]):
        with pytest.raises(ValueError):
            J.aligned(a, spark.createDataFrame(bad, "k string"), "k")


def test_rejection_thresholds():
    assert R.thresholds(["token_k1"], "0.5_1.5")["token_k1"] == (0.5, 1.5)
    assert R.thresholds(["seq_sum_k1", "token_k2"], "2.0")["seq_sum_k1"] == (0.5, 2.0)
    with pytest.raises(ValueError):
        R.thresholds(["token_k2"], "0.5_1.5")
    with pytest.raises(ValueError):
        R.thresholds(["token_k2", "token_k3"], "1,2,3")


@pytest.mark.parametrize("seed", range(4))
def test_differencing_covers_and_balances(seed):
    rng = random.Random(seed)
    w = [rng.randint(1, 1000) for _ in range(40)]
    for equal in (False, True):
        sets = P.checked(P.largest_differencing(w, 4, equal), 40)
        sums = [sum(w[i] for i in s) for s in sets]
        assert max(sums) - min(sums) <= max(w)
        assert not equal or {len(s) for s in sets} == {10}
    greedy = P.greedy(w, 4)
    assert sorted(i for s in greedy for i in s) == list(range(40))
    assert P.greedy([3, 3, 3, 3], 2) == [[0, 2], [1, 3]]


def test_group_partitions_keep_runs(spark):
    rows = [(0, i, i // 2, 10 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "b int, row_idx int, uid int, w int")
    got = P.group_partitioned(df, ["b"], "uid", "w", 2).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["uid"], set()).add(r["part"])
    assert all(len(p) == 1 for p in parts.values()) and len(got) == 8


def test_majority_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "B", 0.1, 2), (1, "A", 0.7, 3)], "g int, p string, v double, pos int")
    assert Q.majority(df, ["g"], "p", "v", "pos").first()["maj"] == 0.9


def test_best_of_k_exact(spark):
    df = spark.createDataFrame([(1, x) for x in (0.0, 0.25, 0.75, 1.0)], "u int, v double")
    got = {r["k"]: r["best"] for r in Q.sample_metrics(df, ["u"], "v").collect()}
    want = sum(max(a, b) for a in (0, 0.25, 0.75, 1) for b in (0, 0.25, 0.75, 1)) / 16
    assert got[2] == pytest.approx(want) and set(got) == {2, 4}


def test_ranks_must_agree(spark):
    rows = [("a", "mean", 0, 0, 1.0), ("a", "mean", 0, 1, 2.0), ("a", "mean", 1, 0, 3.0)]
    with pytest.raises(PySparkException):
        Q.reduce_ranks(spark.createDataFrame(rows, "name string, agg string, rank int, pos int, value double")).collect()


def test_validation_names(spark):
    rows = [("s", 1, 0.8), ("s", 1, 0.9)]
    got = {r["name"]: r["value"] for r in Q.validation(spark.createDataFrame(rows, "s string, u int, v double"), "s", "u", "v").collect()}
    assert got["mean@2"] == pytest.approx(0.85) and set(got) == {"mean@2", "std@2", "best@2", "worst@2"}


def test_budget_state():
    b = L.Budget(3)
    b.admit([1, 2], "train")
    b.admit([2], "probe")
    assert b.left() == 1 and b.breakdown() == {"train": 2}
    with pytest.raises(ValueError):
        b.admit([3, 4], "train")
    c = L.SelectionConfig(budget=0.1, every_epochs=2, every_steps=0)
    assert c.rows(50) == 5 and c.due(epoch=4) and not c.due(epoch=3) and not c.due(step=4)


def test_incomplete_beta():
    assert L._beta_cdf(1, 1, 0.3) == pytest.approx(0.3)
    assert L._beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)
    assert 0 < L._upper_quantile(2, 2, 0.9) <= 0.25


def test_sliced_references_agree(spark):
    rng = random.Random(5)
    rows = [(i, [rng.random() - 0.5 for _ in range(6)]) for i in range(60)]
    items = spark.createDataFrame(rows, "idx long, vec array<double>")
    refs = items.where("idx % 3 = 0").select(F.col("idx").alias("ref"), "vec", F.col("idx").cast("double").alias("value"))
    key = lambda d: sorted((r["idx"], r["rank"], r["ref"]) for r in d.collect())
    assert key(L.nearest_references(items, refs, 4)) == key(L.nearest_references(items, refs, 4, most_refs=7))


def test_texts(spark):
    df = spark.createDataFrame([("The  Cat, sat!", "x \\boxed{\\frac{1}{2}} y", "#### 1,234 then #### -5")], "a string, b string, c string")
    r = df.select(X.normal_answer(F.col("a")).alias("a"), X.boxed_answer(F.col("b")).alias("b"), X.final_number(F.col("c")).alias("c")).first()
    assert tuple(r) == ("cat sat", "\\frac{1}{2}", "-5")
    assert X._latex("\\dfrac12") == "\\frac{1}{2}" and X._latex("0.5") == "\\frac{1}{2}" and X._latex("3/4") == "\\frac{3}{4}" and X._latex("x = \\sqrt2") == "\\sqrt{2}"
    assert X._boxed("none") is None and X._boxed("\\boxed{a{b}") is None


def test_unknown_speaker_fails(spark):
    df = spark.createDataFrame([([("robot", "x")],)], "t array<struct<from:string,value:string>>")
    with pytest.raises(PySparkException):
        df.select(D.conversation_messages(F.col("t"))).collect()


def test_sources_round_trip(spark, tmp_path):
    a = spark.range(10).select(F.col("id").alias("row_idx"), F.concat(F.lit("a b "), "id").alias("prompt"))
    S.save(a, str(tmp_path / "a.parquet"))
    a.coalesce(1).write.json(str(tmp_path / "b.jsonl"))
    both = S.scan(spark, [str(tmp_path / "a.parquet"), str(tmp_path / "b.jsonl")])
    assert both.count() == 20
    with pytest.raises(ValueError):
        S.scan(spark, "x.csv")
    assert S.load(spark, "prompts", str(tmp_path / "a.parquet"), most_rows=4, most_tokens=3).count() == 4
    made = []
    for _ in range(2):
        assert S.read_through(spark, str(tmp_path / "c"), lambda: made.append(1) or a).count() == 10
    assert made == [1]
    S.Tracking(spark, ["console", str(tmp_path / "m")]).log({"x": 1.0}, 3)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1


def test_state_guards(spark, tmp_path):
    t = spark.createDataFrame([(0, 5), (1, 5), (2, 3)], "pos int, idx int")
    K.save_round(t, str(tmp_path), 1, {"a": 1}, 10)
    assert [r["idx"] for r in K.load_round(spark, str(tmp_path), 1, {"a": 1}, 10).collect()] == [5, 5, 3]
    for config, size in (({"a": 2}, 10), ({"a": 1}, 11)):
        with pytest.raises(ValueError):
            K.load_round(spark, str(tmp_path), 1, config, size)


def test_streams_follow_the_batch_semantics(spark, tmp_path):
    rows = [(q, s, float(s)) for q in ("x", "y") for s in range(1, 24)]
    src = tmp_path / "in"
    for lo in (1, 13):
        spark.createDataFrame([r for r in rows if lo <= r[1] < lo + 12], "queue string, seq long, value double").coalesce(1).write.mode("append").parquet(str(src))
    stream = lambda: spark.readStream.schema("queue string, seq long, value double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = T.count_window_stream(stream(), 5).writeStream.format("memory").queryName("w").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["queue"], r["window"]): r["total"] for r in spark.table("w").collect()}
    assert len(got) == 8 and sum(got.values()) == pytest.approx(2 * sum(range(1, 21)))
    q = T.bounded_queue_stream(stream(), 4).writeStream.format("memory").queryName("b").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max((r for r in spark.table("b").collect() if r["queue"] == "x"), key=lambda r: r["produced"])
    assert (last["produced"], last["dropped"], last["size"], last["oldest_seq"], last["newest_seq"]) == (23, 19, 4, 20, 23)


def test_bucket_and_retries():
    now = [0.0]
    b = X.TokenBucket(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    assert [b.acquire() for _ in range(4)] == pytest.approx([0, 0, 0.5, 0.5])
    with pytest.raises(ValueError):
        b.acquire(3)
    waits, calls = [], []

    def fails_twice():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 7

    assert X.retried(fails_twice, sleep=waits.append) == 7 and waits == [1, 2]
    with pytest.raises(KeyError):
        X.retried(lambda: {}["x"], fatal=KeyError, sleep=waits.append)


def test_dispatch_registry(spark):
    with pytest.raises(ValueError):
        B.register_dispatch("shards", lambda d, n: d)
    a = spark.range(5).select(F.col("id").alias("row_idx"))
    assert B.run_on_ranks(a, "shards", 2, lambda d: d).count() == 5
