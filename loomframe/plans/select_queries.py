"""Queries of metrics, selection and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import metrics as Q
from ..operators import selection as L
from ..sources import prep as D
from ..streaming import queue as T
from .views import TOK_SQL, query, r, rounded, table, trajectories

# ---- metrics

_DM = [
    "score_mean", "score_max", "score_min", "reward_mean", "reward_max", "reward_min", "advantages_mean", "advantages_max", "advantages_min",
    "returns_mean", "returns_max", "returns_min", "values_mean", "values_max", "values_min", "response_length_mean", "response_length_max", "response_length_min",
    "prompt_length_mean", "prompt_length_max", "prompt_length_min", "response_clip_ratio", "aborted_ratio",
    "response_length_non_aborted_mean", "response_length_non_aborted_max", "response_length_non_aborted_min", "vf_explained_var",
]


@query(
    "data_metrics",
    f"WITH {TOK_SQL}, g AS (SELECT traj.rid, coalesce(sum(m), 0) AS n, coalesce(sum(r), 0.0) AS score, coalesce(sum(v), 0.0) AS reward, uid % 50 AS p FROM traj LEFT JOIN tok USING (rid) GROUP BY traj.rid, uid), k AS (SELECT * FROM tok WHERE m = 1), o AS (SELECT "
    + ", ".join(f"{f}(CASE WHEN n > 0 THEN {c} END) AS {c}_{s}" for c in ("score", "reward") for f, s in (("avg", "mean"), ("max", "max"), ("min", "min")))
    + ", " + ", ".join(f"(SELECT {f}({c}) FROM k) AS {n}_{f2}" for n, c in (("advantages", "a"), ("returns", "r"), ("values", "v")) for f, f2 in (("avg", "mean"), ("max", "max"), ("min", "min")))
    + ", avg(n) AS response_length_mean, max(n) AS response_length_max, min(n) AS response_length_min, avg(p) AS prompt_length_mean, max(p) AS prompt_length_max, min(p) AS prompt_length_min, avg(CASE WHEN n = 7 THEN 1.0 ELSE 0.0 END) AS response_clip_ratio, avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END) AS aborted_ratio, avg(CASE WHEN n > 0 THEN n END) AS response_length_non_aborted_mean, max(CASE WHEN n > 0 THEN n END) AS response_length_non_aborted_max, min(CASE WHEN n > 0 THEN n END) AS response_length_non_aborted_min, 1 - (SELECT var_samp(r - v) / (var_samp(r) + 1e-5) FROM k) AS vf_explained_var FROM g) SELECT "
    + ", ".join(f"CAST(round({n}, 5) + 0.0 AS DOUBLE) AS {n}" for n in _DM) + " FROM o",
)
def _(spark, d):
    t = trajectories(spark, d, empty=True).withColumn("score", A.total("rewards")).withColumn("reward", A.total("values")).withColumn("returns", F.col("rewards")).withColumn("prompt_length", F.col("uid") % 50).withColumn("most", F.lit(7))
    m = Q.data_metrics(t)
    return rounded(m.select(*[F.col(c).cast("double").alias(c) for c in _DM]), *_DM, digits=5)


query("timing_metrics", "WITH t AS (SELECT event_type AS name, sum(value) AS seconds FROM events GROUP BY event_type), k AS (SELECT sum(CASE WHEN role = 'user' THEN length(text) ELSE 0 END) AS p, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS q FROM conversations) SELECT name, round(seconds, 4) + 0.0 AS seconds, round(seconds * 1000 / (p + q), 6) + 0.0 AS ms_per_token FROM t, k")(
    lambda spark, d: rounded(rounded(Q.timing_metrics(table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("seconds")), table(spark, d, "conversations").agg(F.sum(F.when(F.col("role") == "user", F.length("text")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(F.col("role") == "assistant", F.length("text")).otherwise(0)).alias("response_tokens"))), "seconds", digits=4), "ms_per_token")
)
query("throughput", "SELECT event_type, round(sum(value) / (count(*) * 8), 6) + 0.0 AS tokens_per_second FROM events GROUP BY event_type")(
    lambda spark, d: rounded(table(spark, d, "events").groupBy("event_type").agg(Q.throughput(F.sum("value"), F.count(F.lit(1)), 8).alias("tokens_per_second")), "tokens_per_second")
)
query(
    "variance_proxies",
    f"WITH {TOK_SQL}, g AS (SELECT rid, sum(m * (1 - 2 * exp(lp) + exp(2 * lp))) AS w, sum(a * m) / (sum(m) + 1e-8) AS adv FROM tok GROUP BY rid), o AS (SELECT 0.25 AS signal_strength, avg(adv * adv * greatest(w, 0)) AS total_power, avg(adv * adv) AS e, avg(w) AS ew, count(*) AS n FROM g) SELECT round(signal_strength, 6)::DOUBLE AS signal_strength, round(total_power, 6) + 0.0 AS total_power, round(greatest((total_power - signal_strength) / (n - 1), 0), 8) + 0.0 AS pure_noise, round(e, 6) + 0.0 AS expected_a_squared, round(ew, 6) + 0.0 AS expected_w FROM o",
)(lambda spark, d: rounded(rounded(Q.variance_proxies(trajectories(spark, d).withColumn("pi2", F.transform("lp", lambda x: F.exp(2 * x))), 0.5), "signal_strength", "total_power", "expected_a_squared", "expected_w"), "pure_noise", digits=8))


def _samples(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_custkey").alias("uid"), (F.col("o_totalprice") / 7919.0).alias("acc"), F.col("o_orderstatus").alias("pred"), F.col("o_orderkey").alias("pos"))


query(
    "majority_vote",
    "WITH v AS (SELECT o_orderpriority AS source, o_custkey AS uid, o_orderstatus AS pred, count(*) AS n, min(o_orderkey) AS f, arg_min(o_totalprice / 7919.0, o_orderkey) AS val FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY source, uid ORDER BY n DESC, f) AS k FROM v) SELECT source, uid, round(val, 6) + 0.0 AS maj FROM k WHERE k = 1",
)(lambda spark, d: rounded(Q.majority(_samples(spark, d), ["source", "uid"], "pred", "acc", "pos"), "maj"))

_BEST = "WITH s AS (SELECT {keys}, o_totalprice / 7919.0 AS x, row_number() OVER (PARTITION BY {keys} ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY {keys}) AS n FROM orders), ks AS (SELECT DISTINCT {keys2}, n, k FROM s, (SELECT unnest([2, 4, 8, 16, 32, 64]) AS k) WHERE k < n UNION SELECT DISTINCT {keys2}, n, n FROM s WHERE n > 1), b AS (SELECT {keys2}, s.n, k, sum(x * (pow(i / s.n::DOUBLE, k) - pow((i - 1) / s.n::DOUBLE, k))) AS best, sum(x * (pow((s.n - i + 1) / s.n::DOUBLE, k) - pow((s.n - i) / s.n::DOUBLE, k))) AS worst FROM s JOIN ks USING ({keys2}) GROUP BY {keys2}, s.n, k)"
_BK = _BEST.format(keys="o_custkey", keys2="o_custkey")
query("best_worst_of_k", _BK + " SELECT o_custkey AS uid, n, CAST(k AS INTEGER) AS k, round(best, 5) + 0.0 AS best, round(worst, 5) + 0.0 AS worst FROM b")(
    lambda spark, d: rounded(Q.sample_metrics(_samples(spark, d), ["uid"], "acc").where("k is not null").select("uid", "n", "k", "best", "worst"), "best", "worst", digits=5)
)
_BV = _BEST.format(keys="o_orderpriority, o_custkey", keys2="o_orderpriority, o_custkey")
query(
    "validation_metrics",
    _BV + ", m AS (SELECT o_orderpriority, o_custkey, count(*) AS n, avg(o_totalprice / 7919.0) AS mean, stddev_pop(o_totalprice / 7919.0) AS std FROM orders GROUP BY ALL), r AS (SELECT o_orderpriority AS source, 'mean@' || n AS name, mean AS v FROM m UNION ALL SELECT o_orderpriority, 'std@' || n, std FROM m WHERE n > 1 UNION ALL SELECT o_orderpriority, 'best@' || k, best FROM b UNION ALL SELECT o_orderpriority, 'worst@' || k, worst FROM b) SELECT source, name, round(avg(v), 5) + 0.0 AS value FROM r GROUP BY source, name",
)(lambda spark, d: rounded(Q.validation(_samples(spark, d), "source", "uid", "acc"), "value", digits=5))
query("bootstrap_metrics")(lambda spark, d: rounded(Q.bootstrap(_samples(spark, d), ["uid"], "acc", "pos", 2, rounds=200), "best_mean", "best_std", "worst_mean", "worst_std"))
query(
    "metric_names",
    _BV + ", m AS (SELECT o_orderpriority AS source, 'mean@' || n AS name, n AS k FROM s GROUP BY o_orderpriority, n UNION SELECT o_orderpriority, 'std@' || n, n FROM s WHERE n > 1 UNION SELECT o_orderpriority, 'best@' || k, k FROM b UNION SELECT o_orderpriority, 'worst@' || k, k FROM b) SELECT source, name, CASE WHEN k = max(k) OVER (PARTITION BY source) AND (name LIKE 'mean@%' OR name LIKE 'best@%') THEN 'val-core/' ELSE 'val-aux/' END || source || '/acc/' || name AS metric FROM m",
)(lambda spark, d: Q.named(Q.validation(_samples(spark, d), "source", "uid", "acc").withColumn("variable", F.lit("acc"))).select("source", "name", "metric"))


def _named(spark, d):
    prefix = F.when(F.col("event_id") % 3 == 0, "max_").when(F.col("event_id") % 3 == 1, "min_").otherwise("")
    return table(spark, d, "events").select(F.concat(prefix, F.col("event_type")).alias("name"), "value", F.col("event_id").alias("pos"), (F.col("user_id") % 2).alias("rank"))


_NM = "SELECT CASE event_id % 3 WHEN 0 THEN 'max_' WHEN 1 THEN 'min_' ELSE '' END || event_type AS name, value, event_id, user_id FROM events"
query("metrics_by_name", f"WITH e AS ({_NM}) SELECT name, round(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END, 6) + 0.0 AS value FROM e GROUP BY name")(
    lambda spark, d: rounded(Q.reduce_named(_named(spark, d)), "value")
)
query(
    "metrics_over_ranks",
    "WITH e AS (SELECT event_type AS name, event_id AS pos, value, k AS rank, CASE event_type WHEN 'click' THEN 'sum' WHEN 'view' THEN 'mean' WHEN 'purchase' THEN 'min' ELSE 'max' END AS agg FROM events, (SELECT unnest([0, 1]) AS k)), p AS (SELECT name, agg, pos, avg(value + rank) AS m, min(value + rank) AS lo, max(value + rank) AS hi FROM e GROUP BY ALL) SELECT name, round(CASE agg WHEN 'sum' THEN sum(m) WHEN 'mean' THEN avg(m) WHEN 'min' THEN min(lo) ELSE max(hi) END, 4) + 0.0 AS value FROM p GROUP BY name, agg",
)(
    lambda spark, d: rounded(Q.reduce_ranks(table(spark, d, "events").withColumn("rank", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.col("event_type").alias("name"), F.col("event_id").alias("pos"), (F.col("value") + F.col("rank")).alias("value"), "rank", F.when(F.col("event_type") == "click", "sum").when(F.col("event_type") == "view", "mean").when(F.col("event_type") == "purchase", "min").otherwise("max").alias("agg"))), "value", digits=4)
)
query(
    "window_metrics",
    f"WITH e AS ({_NM}), z AS (SELECT 'timing_s/' || name AS name, value, event_id FROM e UNION ALL SELECT name, value, event_id FROM e UNION ALL SELECT 'total_' || name, value, event_id FROM e) SELECT name, CASE WHEN contains(name, 'timing_s/') THEN 'time_sum' WHEN contains(name, 'max') THEN 'max' WHEN contains(name, 'min') THEN 'min' WHEN contains(name, 'total') THEN 'sum' ELSE 'avg' END AS rule, round(CASE WHEN contains(name, 'timing_s/') THEN sum(value) WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) WHEN contains(name, 'total') THEN sum(value) ELSE avg(value) END, 4) + 0.0 AS value FROM z GROUP BY name",
)(
    lambda spark, d: rounded(Q.window_metrics(_named(spark, d).select(F.explode(F.array(F.concat(F.lit("timing_s/"), "name"), F.col("name"), F.concat(F.lit("total_"), "name"))).alias("name"), "value", F.col("pos").alias("step"))), "value", digits=4)
)
query("last_metrics", "SELECT event_type AS name, 'last' AS rule, round(arg_max(value, event_id), 6) + 0.0 AS value FROM events GROUP BY event_type")(
    lambda spark, d: rounded(Q.window_metrics(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("step"), "value", F.lit("last").alias("rule"))), "value")
)
query("percentiles", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean, max(value) AS max, min(value) AS min, round(quantile_cont(value, 0.5), 6) + 0.0 AS p50, round(quantile_cont(value, 0.95), 6) + 0.0 AS p95, round(quantile_cont(value, 0.99), 6) + 0.0 AS p99 FROM events GROUP BY event_type")(
    lambda spark, d: rounded(Q.percentiles(table(spark, d, "events"), ["event_type"], "value"), "mean", "p50", "p95", "p99")
)
query("slowest_rows", "SELECT event_type, round(min(value), 6) + 0.0 AS min, round(max(value), 6) + 0.0 AS max, round(avg(value), 6) + 0.0 AS mean, arg_max(event_id, value) AS slowest_event_id FROM events GROUP BY event_type")(
    lambda spark, d: rounded(Q.slowest(table(spark, d, "events"), ["event_type"], F.col("value"), "event_id"), "min", "max", "mean")
)
query("source_means", "WITH p AS (SELECT o_orderpriority AS source, o_custkey, avg(o_totalprice / 7919.0) AS m FROM orders GROUP BY ALL) SELECT source, round(avg(m), 5) + 0.0 AS mean_score, count(*) AS prompts FROM p GROUP BY source")(
    lambda spark, d: rounded(Q.source_means(_samples(spark, d), "source", "uid", "acc"), "mean_score", digits=5)
)
query("selection_gini", "WITH f AS (SELECT user_id, count(*) AS f FROM events GROUP BY user_id), i AS (SELECT f, row_number() OVER (ORDER BY f, user_id) AS i FROM f) SELECT round(2 * sum(i * f) / (count(*) * sum(f)) - (count(*) + 1) / count(*), 6) + 0.0 AS gini FROM i")(
    lambda spark, d: rounded(Q.gini(table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("f")), "f"), "gini")
)
query("flops", "SELECT source, round((6.0 * 7e9 * sum(n_chars) + 12.0 * 28 * 28 * 128 * sum(n_chars * n_chars)) / 1e12, 3) + 0.0 AS tflops FROM documents GROUP BY source")(
    lambda spark, d: rounded(table(spark, d, "documents").groupBy("source").agg((Q.dense_flops(F.sum("n_chars"), F.sum(F.col("n_chars") * F.col("n_chars")), 7e9, 28, 28, 128) / 1e12).alias("tflops")), "tflops", digits=3)
)

# ---- selection

_EMB = "e AS (SELECT vec_id AS idx, label AS cluster, embedding::DOUBLE[] AS v FROM embeddings), u AS (SELECT idx, cluster, v, list_transform(v, lambda x: x / greatest(sqrt(list_sum(list_transform(v, lambda y: y * y))), 1e-12)) AS u FROM e)"


def _items(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").alias("vec"), F.col("label").alias("cluster"))


def _refs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("vec"), (F.col("vec_id") % 7 / 7.0).alias("value"))


_NEAR = f"WITH {_EMB}, s AS (SELECT a.idx, b.idx AS ref, list_dot_product(a.u, b.u) AS sim, b.idx % 7 / 7.0 AS value FROM u a, u b WHERE a.idx % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, ref) AS k FROM s)"
query("nearest_references", _NEAR + " SELECT idx, ref, CAST(k AS INTEGER) AS rank, round(sim, 6) + 0.0 AS sim FROM k WHERE k <= 5")(
    lambda spark, d: rounded(L.nearest_references(_items(spark, d).where("idx % 100 = 0"), _refs(spark, d), 5).select("idx", "ref", "rank", "sim"), "sim")
)
query("knn_interpolation", _NEAR + " SELECT idx, round(sum(exp((sim - m) / 0.05) * value) / sum(exp((sim - m) / 0.05)), 6) + 0.0 AS predicted FROM (SELECT *, max(sim) OVER (PARTITION BY idx) AS m FROM k WHERE k <= 8) GROUP BY idx")(
    lambda spark, d: rounded(L.interpolated(L.nearest_references(_items(spark, d).where("idx % 100 = 0"), _refs(spark, d), 8)), "predicted")
)
_PAIR = f"WITH {_EMB}, p AS (SELECT a.idx, a.cluster, b.idx AS other, list_dot_product(a.u, b.u) AS sim FROM u a JOIN u b ON a.cluster = b.cluster AND a.idx <> b.idx)"
query("cluster_density", _PAIR + ", k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, other) AS k FROM p) SELECT idx, cluster, round(1.0 / (avg(1 - sim) + 1e-8), 5) + 0.0 AS density FROM k WHERE k <= 10 GROUP BY idx, cluster")(
    lambda spark, d: rounded(L.knn_density(_items(spark, d)), "density", digits=5)
)
query("cluster_medoids", _PAIR + ", m AS (SELECT cluster, idx, avg(sim) AS s FROM p GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, idx) AS k FROM m) SELECT cluster, idx, round(s, 6) + 0.0 AS mean_sim, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 3")(
    lambda spark, d: rounded(L.medoids(_items(spark, d), 3), "mean_sim")
)
_CENT = "c AS (SELECT cluster, d, avg(x) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) GROUP BY ALL)"
query("centroids", f"WITH {_EMB}, {_CENT} SELECT cluster, CAST(d AS INTEGER) AS d, round(m, 6) + 0.0 AS m FROM c")(
    lambda spark, d: rounded(L.centroids(_items(spark, d)).select("cluster", F.posexplode("centroid").alias("d", "m")).withColumn("d", F.col("d") + 1), "m")
)
query(
    "nearest_to_centroid",
    f"WITH {_EMB}, {_CENT}, x AS (SELECT idx, cluster, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e), n AS (SELECT idx, cluster, sqrt(sum((x - m) * (x - m))) AS distance FROM x JOIN c USING (cluster, d) GROUP BY idx, cluster), k AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY distance, idx) AS k FROM n) SELECT cluster, idx, round(distance, 5) + 0.0 AS distance, CAST(k AS INTEGER) AS rank FROM k WHERE k <= 4",
)(lambda spark, d: (lambda i: rounded(L.nearest_to_centroid(i, L.centroids(i), 4), "distance", digits=5))(_items(spark, d)))
query(
    "transferability",
    f"WITH {_EMB}, {_CENT}, n AS (SELECT cluster, sqrt(sum(m * m)) AS n FROM c GROUP BY cluster), s AS (SELECT a.cluster, b.cluster AS other, sum(a.m * b.m) / (any_value(x.n) * any_value(y.n)) AS sim FROM c a JOIN c b ON a.d = b.d AND a.cluster <> b.cluster JOIN n x ON x.cluster = a.cluster JOIN n y ON y.cluster = b.cluster GROUP BY ALL) SELECT cluster, round(coalesce(sum(CASE WHEN sim <= 0.9 THEN sim END) / nullif(sum(CASE WHEN sim <= 0.9 THEN 1 ELSE 0 END), 0), 0.0), 6) + 0.0 AS transfer FROM s GROUP BY cluster",
)(lambda spark, d: rounded(L.transferability(L.centroids(_items(spark, d))), "transfer"))
query("diverse_rows")(lambda spark, d: (lambda i: L.diverse_rows(i.join(L.knn_density(i).select("idx", "density"), "idx"), 5))(_items(spark, d)))
query("mmd_rows")(lambda spark, d: L.mmd_rows(_items(spark, d), 5, 0.05))
query("spherical_kmeans")(lambda spark, d: L.kmeans_clusters(_items(spark, d), 10, 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("size")))


def _history(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("idx"), F.datediff("ts", F.lit("2024-01-01")).alias("step"), (F.col("value") / 100).alias("reward"), "event_id")


_HIST = "h AS (SELECT user_id AS idx, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step, value / 100 AS reward, event_id FROM events), gv AS (SELECT idx, step, avg(reward) AS mean, least(4 * var_pop(reward), 1.0) AS value FROM h GROUP BY idx, step)"
query("group_variance", f"WITH {_HIST} SELECT idx, step, round(mean, 6) + 0.0 AS mean, round(value, 6) + 0.0 AS value FROM gv")(lambda spark, d: rounded(L.group_variance(_history(spark, d)), "mean", "value"))
_DEC = f"{_HIST}, dv AS (SELECT idx, sum(exp(-0.1 * (29 - step)) * value) / sum(exp(-0.1 * (29 - step))) AS weighted, max(step) AS last_step FROM gv WHERE 29 - step <= 20 GROUP BY idx)"
query("decayed_variance", f"WITH {_DEC} SELECT idx, round(weighted, 6) + 0.0 AS weighted, last_step FROM dv")(lambda spark, d: rounded(L.decayed(L.group_variance(_history(spark, d)), 29, 0.1, 20), "weighted"))
query("most_recent_references", f"WITH {_DEC} SELECT idx, last_step FROM dv ORDER BY last_step DESC, idx LIMIT 40")(lambda spark, d: L.most_recent(L.decayed(L.group_variance(_history(spark, d)), 29, 0.1, 20), 40).select("idx", "last_step"))
query("pruned_history", f"WITH {_HIST} SELECT event_id, idx, step FROM h WHERE 29 - step <= 5")(lambda spark, d: L.pruned(_history(spark, d), 29, 5).select("event_id", "idx", "step"))
query("observed_or_default", f"WITH {_HIST}, o AS (SELECT idx, avg(mean) AS m FROM gv WHERE idx % 2 = 0 GROUP BY idx) SELECT c_custkey AS idx, round(coalesce(m, 0.5), 4) + 0.0 AS mean FROM customer LEFT JOIN o ON idx = c_custkey")(
    lambda spark, d: rounded(L.observed_or(table(spark, d, "customer").select(F.col("c_custkey").alias("idx")), L.group_variance(_history(spark, d)).where("idx % 2 = 0").groupBy("idx").agg(F.avg("mean").alias("mean")), "mean"), "mean", digits=4)
)


def _state(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") % 9).cast("double").alias("a"), (F.col("c_custkey") % 5).cast("double").alias("b"))


def _counts(spark, d):
    return L.correct_counts(table(spark, d, "events").select(F.col("user_id").alias("idx"), (F.col("value") >= 50).cast("int").alias("reward")), 8)


_ST = "st AS (SELECT c_custkey AS idx, (c_custkey % 9)::DOUBLE AS a, (c_custkey % 5)::DOUBLE AS b FROM customer), ct AS (SELECT user_id AS idx, least(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END), 8) AS correct FROM events GROUP BY user_id)"
query("correct_counts", f"WITH {_ST} SELECT idx, CAST(correct AS INTEGER) AS correct FROM ct")(lambda spark, d: _counts(spark, d))
query("beta_updates", f"WITH {_ST} SELECT st.idx, round(CASE WHEN correct > 0 AND correct < 8 THEN 0.9 ELSE 0.5 END * a + coalesce(correct, 0), 6) + 0.0 AS a, round(CASE WHEN correct > 0 AND correct < 8 THEN 0.9 ELSE 0.5 END * b + coalesce(8 - correct, 0), 6) + 0.0 AS b FROM st LEFT JOIN ct ON ct.idx = st.idx")(
    lambda spark, d: rounded(L.updated_posteriors(_state(spark, d), _counts(spark, d), 8, 0.9, 0.5), "a", "b")
)
query("beta_replaced", f"WITH {_ST} SELECT st.idx, CASE WHEN correct IS NOT NULL THEN correct::DOUBLE ELSE a END AS a, CASE WHEN correct IS NOT NULL THEN (8 - correct)::DOUBLE ELSE b END AS b FROM st LEFT JOIN ct ON ct.idx = st.idx")(
    lambda spark, d: L.replaced_posteriors(_state(spark, d), _counts(spark, d), 8)
)
query("beta_recency", "SELECT c_custkey AS idx, round(2.0 / (1 + (30 - c_custkey % 30) / 10.0) * (c_custkey % 9), 6) + 0.0 AS a, round(2.0 / (1 + (30 - c_custkey % 30) / 10.0) * (8 - c_custkey % 9), 6) + 0.0 AS b FROM customer")(
    lambda spark, d: rounded(L.recency_posteriors(table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), (F.col("c_custkey") % 30).alias("last_step"), (F.col("c_custkey") % 9).alias("last_value")), 30, 8, 10.0, 2.0), "a", "b")
)
query("beta_weights", f"WITH {_ST} SELECT idx, round((a + 1) / (a + b + 2) * (1 - (a + 1) / (a + b + 2)), 6) + 0.0 AS weight FROM st")(lambda spark, d: rounded(L.direct_weights(_state(spark, d)).select("idx", "weight"), "weight"))
query("beta_weights_squared", f"WITH {_ST} SELECT idx, round((a + 1) / (a + b + 2) * pow(1 - (a + 1) / (a + b + 2), 2), 6) + 0.0 AS weight FROM st")(lambda spark, d: rounded(L.direct_weights(_state(spark, d), 2).select("idx", "weight"), "weight"))
query("beta_quantiles")(lambda spark, d: rounded(L.quantile_weights(_state(spark, d), 0.9).select("idx", "weight"), "weight"))
query("beta_draws")(lambda spark, d: rounded(L.thompson_weights(_state(spark, d), 5).select("idx", "weight"), "weight"))


def _clusters(spark, d):
    return table(spark, d, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("vec_id") % 13).cast("double").alias("value"))


_CL = "cl AS (SELECT label AS cluster, count(*) AS size, sum(vec_id % 13)::DOUBLE AS value FROM embeddings GROUP BY label)"
query("proportional_allocation", f"WITH {_CL} SELECT cluster, size, least(greatest(CAST(round_even(value / (SELECT sum(value) FROM cl) * 60, 0) AS BIGINT), 1), size) AS take FROM cl")(
    lambda spark, d: L.proportional(_clusters(spark, d), "value", 60).select("cluster", "size", "take")
)
query(
    "adjusted_allocation",
    f"WITH {_CL}, p AS (SELECT cluster, size, value, least(greatest(CAST(round_even(value / (SELECT sum(value) FROM cl) * 60, 0) AS BIGINT), 1), size) AS t FROM cl), o AS (SELECT *, (SELECT sum(t) FROM p) - 63 AS ov, coalesce(sum(t) OVER (ORDER BY value, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, coalesce(sum(size - t) OVER (ORDER BY value DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hi FROM p) SELECT cluster, CAST(t - least(greatest(ov - lo, 0), t) + least(greatest(-ov - hi, 0), size - t) AS BIGINT) AS take FROM o",
)(lambda spark, d: L.adjusted(L.proportional(_clusters(spark, d), "value", 60), 63, "value").select("cluster", "take"))
query("top_cluster_allocation", f"WITH {_CL} SELECT cluster, CAST(least(greatest(120 - coalesce(sum(size) OVER (ORDER BY value DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), size) AS BIGINT) AS take FROM cl")(
    lambda spark, d: L.top_clusters(_clusters(spark, d), "value", 120).select("cluster", "take")
)
query("softmax_allocation", f"WITH {_CL}, e AS (SELECT cluster, size, exp((value - (SELECT max(value) FROM cl)) / 50.0) AS e FROM cl) SELECT cluster, least(greatest(CAST(round_even(e / (SELECT sum(e) FROM e) * 60, 0) AS BIGINT), 1), size) AS take FROM e")(
    lambda spark, d: L.softmax_share(_clusters(spark, d), "value", 60, 50.0).select("cluster", "take")
)
query("filled_allocation", f"WITH {_CL}, p AS (SELECT cluster, least(greatest(CAST(round_even(value / (SELECT sum(value) FROM cl) * 60, 0) AS BIGINT), 1), size) AS take FROM cl), k AS (SELECT vec_id AS idx, label AS cluster, row_number() OVER (PARTITION BY label ORDER BY vec_id % 13 DESC, vec_id) AS k FROM embeddings) SELECT idx, k.cluster, CAST(k AS INTEGER) AS rank FROM k JOIN p USING (cluster) WHERE k <= take")(
    lambda spark, d: L.fill(table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.col("label").alias("cluster"), (F.col("vec_id") % 13).alias("s")), L.proportional(_clusters(spark, d), "value", 60), "s").select("idx", "cluster", "rank")
)


def _weighted(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_acctbal").alias("weight"))


def _seen(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("idx")).distinct()


query("top_unseen", "SELECT c_custkey AS idx FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') ORDER BY c_acctbal DESC, c_custkey LIMIT 50")(
    lambda spark, d: L.top_unseen(_weighted(spark, d), _seen(spark, d), "weight", 50).select("idx")
)
query("stable_top", "SELECT c_custkey AS idx, CAST(floor(c_acctbal / 1000) AS INTEGER) AS weight FROM customer ORDER BY 2 DESC, 1 LIMIT 80")(
    lambda spark, d: L.select_round(_weighted(spark, d).withColumn("weight", F.floor(F.col("weight") / 1000).cast("int")), L.SelectionConfig("top", 80, options={"score": "weight"}), 10**9)
)
query("top_with_budget", "WITH c AS (SELECT c_custkey AS idx, c_acctbal AS w, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS is_new FROM customer), a AS (SELECT * FROM c WHERE is_new ORDER BY w DESC, idx LIMIT 10), b AS (SELECT * FROM c WHERE NOT is_new) SELECT idx, is_new FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY w DESC, idx LIMIT 100")(
    lambda spark, d: L.top_with_budget(_weighted(spark, d), _seen(spark, d), "weight", 100, 10).select("idx", "is_new")
)
query("random_selection")(lambda spark, d: L.select_round(_weighted(spark, d), L.SelectionConfig("random", 0.1), table(spark, d, "customer").count()).select("idx"))
query("weighted_selection")(lambda spark, d: L.weighted_rows(_weighted(spark, d).withColumn("weight", F.greatest("weight", F.lit(0.0))), 100, "idx", "weight", 9).select("idx"))
query("resampled_rows")(lambda spark, d: (lambda G, w: G.resampled(w, "weight", 500, 3).select("draw", "row_idx"))(__import__("loomframe.operators.advantages", fromlist=["x"]), _weighted(spark, d).select(F.col("idx").alias("row_idx"), F.greatest("weight", F.lit(1e-8)).alias("weight"))))
query("ols_calibration", "WITH p AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem) SELECT round(regr_slope(y, x), 5) + 0.0 AS slope, round(regr_intercept(y, x), 4) + 0.0 AS intercept FROM p")(
    lambda spark, d: rounded(rounded(L.calibration(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "slope", digits=5), "intercept", digits=4)
)
query(
    "predictor_diagnostics",
    "WITH p AS (SELECT o_orderkey, o_custkey AS cluster, round(o_totalprice / 1000) AS x, o_totalprice % 97 + o_totalprice / 2000 AS y FROM orders), r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry, (sum(y) OVER (PARTITION BY cluster) - y) / nullif(count(*) OVER (PARTITION BY cluster) - 1, 0) AS loo FROM p) SELECT round(1 - sum((y - x) ** 2) / (var_pop(y) * count(y)), 5) + 0.0 AS r2, round(avg(abs(y - x)), 5) + 0.0 AS mae, round(corr(rx, ry), 5) + 0.0 AS spearman, round(avg(abs(y - loo)), 5) + 0.0 AS loo_cluster_mae, count(loo) AS covered FROM r",
)(
    lambda spark, d: rounded(L.diagnostics(table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.round(F.col("o_totalprice") / 1000).alias("x"), (F.col("o_totalprice") % 97 + F.col("o_totalprice") / 2000).alias("y")), "x", "y"), "r2", "mae", "spearman", "loo_cluster_mae", digits=5)
)
query("robust_zscores", "WITH m AS (SELECT median(value) AS med FROM events), a AS (SELECT median(abs(value - med)) AS mad FROM events, m) SELECT event_id, round((value - med) / (1.4826 * mad + 1e-6), 5) + 0.0 AS z FROM events, m, a")(
    lambda spark, d: rounded(L.robust_z(table(spark, d, "events"), "value").select("event_id", "z"), "z", digits=5)
)
query("cluster_filled", "WITH v AS (SELECT vec_id, label, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE (vec_id % 17)::DOUBLE END AS v FROM embeddings), m AS (SELECT label, avg(v) AS m FROM v GROUP BY label) SELECT vec_id, round(coalesce(v, m, 0.0), 6) + 0.0 AS v FROM v JOIN m USING (label)")(
    lambda spark, d: rounded(L.filled_by_cluster(table(spark, d, "embeddings").select("vec_id", F.col("label").alias("cluster"), F.when(F.col("vec_id") % 3 == 0, F.lit(float("nan"))).otherwise((F.col("vec_id") % 17).cast("double")).alias("v")), "v").select("vec_id", "v"), "v")
)
query("sigmoid_gates", "SELECT event_id, round(0.2 + 0.8 / (1 + exp(-least(greatest((value - 50) / 5.0, -50), 50))), 6) + 0.0 AS gate FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", r(L.sigmoid_gate(F.col("value"), 0.2, 50.0, 5.0)).alias("gate"))
)
query("utilities", "SELECT p_partkey, round(CASE WHEN p_size / 50.0 < 0.1 OR p_size / 50.0 > 0.9 THEN 0.0 ELSE p_retailprice / 1000 * (1 + 0.5 * (0.5 - p_size / 50.0)) END, 6) + 0.0 AS utility, round(p_retailprice / greatest(p_size / 50.0, 1e-6), 4) + 0.0 AS grounding FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", r(L.utility(F.col("p_retailprice") / 1000, F.col("p_size") / 50, 0.5, 0.1, 0.9)).alias("utility"), r(L.image_grounding(F.col("p_retailprice"), F.col("p_size") / 50), 4).alias("grounding"))
)
query("selection_jaccard", "WITH a AS (SELECT DISTINCT o_custkey AS idx FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT DISTINCT o_custkey AS idx FROM orders WHERE o_orderstatus = 'F') SELECT round((SELECT count(*) FROM a JOIN b USING (idx)) / (SELECT count(*) FROM (SELECT idx FROM a UNION SELECT idx FROM b))::DOUBLE, 6) + 0.0 AS jaccard")(
    lambda spark, d: rounded(L.jaccard(_seen(spark, d), table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("idx"))), "jaccard")
)
query("selection_probabilities", "WITH z AS (SELECT p_partkey, -abs(p_size / 50.0 - 0.5) / 0.1 AS z FROM part) SELECT p_partkey, round(exp(z - (SELECT max(z) FROM z)) / (SELECT sum(exp(z - (SELECT max(z) FROM z))) FROM z), 8) + 0.0 AS probability FROM z")(
    lambda spark, d: rounded(L.attention_probabilities(table(spark, d, "part").select("p_partkey", (F.col("p_size") / 50).alias("p")), "p").select("p_partkey", "probability"), "probability", digits=8)
)
query("logp_contrast", f"WITH {TOK_SQL} SELECT rid, round(sum((olp - rlp) * m) / greatest(sum(m), 1), 6) + 0.0 AS contrast FROM tok GROUP BY rid")(
    lambda spark, d: trajectories(spark, d).select(F.col("row_idx").alias("rid"), r(L.contrast(F.col("old_lp"), F.col("rollout_lp"), "mask")).alias("contrast"))
)


# ---- selection rounds

_ALL = f"WITH {_EMB}, s AS (SELECT a.idx, a.cluster, list_dot_product(a.u, b.u) AS sim, b.idx % 7 / 7.0 AS value, b.idx AS ref FROM u a, u b), k AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY sim DESC, ref) AS k FROM s), p AS (SELECT idx, any_value(cluster) AS cluster, sum(exp((sim - m) / 0.5) * value) / sum(exp((sim - m) / 0.5)) AS score FROM (SELECT *, max(sim) OVER (PARTITION BY idx) AS m FROM k WHERE k <= 8) GROUP BY idx)"
query("select_interpolated", _ALL + " SELECT idx, round(score, 6) + 0.0 AS score FROM p ORDER BY p.score DESC, idx LIMIT 40")(
    lambda spark, d: rounded(L.select_round(_items(spark, d), L.SelectionConfig("interpolated", 40, options={"refs": _refs(spark, d), "temperature": 0.5}), 10**9).select("idx", "score"), "score")
)
query(
    "select_interpolated_diverse",
    _ALL + ", c AS (SELECT cluster, avg(score) AS value, count(*) AS size FROM p GROUP BY cluster), t AS (SELECT *, least(greatest(CAST(round_even(value / (SELECT sum(value) FROM c) * 40, 0) AS BIGINT), 1), size) AS t FROM c), o AS (SELECT *, (SELECT sum(t) FROM t) - 40 AS ov, coalesce(sum(t) OVER (ORDER BY value, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, coalesce(sum(size - t) OVER (ORDER BY value DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hi FROM t), a AS (SELECT cluster, t - least(greatest(ov - lo, 0), t) + least(greatest(-ov - hi, 0), size - t) AS take FROM o), r AS (SELECT idx, cluster, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, idx) AS k FROM p) SELECT idx, r.cluster FROM r JOIN a USING (cluster) WHERE k <= take",
)(lambda spark, d: L.select_round(_items(spark, d), L.SelectionConfig("interpolated", 40, options={"refs": _refs(spark, d), "temperature": 0.5, "diverse": True}), 10**9).select("idx", "cluster"))
query("select_top_clusters", f"WITH {_CL}, t AS (SELECT cluster, least(greatest(120 - coalesce(sum(size) OVER (ORDER BY value DESC, cluster ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), size) AS take FROM cl), k AS (SELECT vec_id AS idx, label AS cluster, row_number() OVER (PARTITION BY label ORDER BY vec_id % 13 DESC, vec_id) AS k FROM embeddings) SELECT idx, k.cluster FROM k JOIN t USING (cluster) WHERE k <= take")(
    lambda spark, d: L.select_round(_items(spark, d).withColumn("score", F.col("idx") % 13), L.SelectionConfig("top_clusters", 120, options={"values": _clusters(spark, d).select("cluster", "value")}), 10**9).select("idx", "cluster")
)
query("select_bandit", "WITH w AS (SELECT c_custkey AS idx, (c_custkey % 9 + 1.0) / (c_custkey % 9 + 1.0 + (c_custkey % 5 + 1.0)) AS p, c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS is_new FROM customer), v AS (SELECT idx, p * (1 - p) AS w, is_new FROM w), a AS (SELECT * FROM v WHERE is_new ORDER BY w DESC, idx LIMIT 15), b AS (SELECT * FROM v WHERE NOT is_new) SELECT idx, is_new FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY w DESC, idx LIMIT 60")(
    lambda spark, d: L.select_round(table(spark, d, "customer").select(F.col("c_custkey").alias("idx")), L.SelectionConfig("bandit", 60, options={"state": _state(spark, d), "seen": _seen(spark, d), "new_left": 15}), 10**9).select("idx", "is_new")
)
query("select_similarity")(lambda spark, d: L.select_round(_items(spark, d), L.SelectionConfig("similarity", 30, seed=4, options={"refs": _refs(spark, d)}), 10**9).select("idx"))


def _predictions(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), (F.col("vec_id") % 17 / 17).alias("predicted"), (F.col("vec_id") % 5 / 10).alias("sigma"))


@query("probe_rows", "SELECT vec_id AS idx FROM embeddings WHERE label <> 3 ORDER BY vec_id % 17 / 17 + 2.0 * (vec_id % 5 / 10) DESC, vec_id LIMIT 25")
def _(spark, d):
    seen = _items(spark, d).where("cluster = 3").select("idx")
    got = L.probes(_items(spark, d), _predictions(spark, d), 25, 2.0, seen=seen)
    return spark.createDataFrame([(i,) for i in got], "idx long")


@query("discovery_rounds")
def _(spark, d):
    """Three rounds under a cap of 70 rows: round, idx of every choice."""
    rounds, items, out = L.Rounds(cap=70, floor=40), _items(spark, d), None
    for k in range(3):
        config = L.SelectionConfig("interpolated", 30, seed=1, options={"refs": None if k == 0 else _refs(spark, d)})
        got, _metrics = L.discovery_round(items, config, rounds, 10**9, signal=_refs(spark, d).select(F.col("ref").alias("idx"), "value"))
        got = got.withColumn("round", F.lit(k + 1))
        out = got if out is None else out.unionByName(got)
    return out


query("majority_of_k")(lambda spark, d: rounded(Q.majority_of_k(_samples(spark, d).withColumn("pred", F.col("pos") % 3), ["uid"], "pred", "acc", "pos", rounds=100), "maj_mean", "maj_std"))


@query("ridge_predictions")
def _(spark, d):
    i = table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), (F.col("vec_id") % 7 / 7).alias("y"), F.lit(1.0).alias("w"))
    beta, inverse = L.ridge(i, "vec", "y", "w", 1.0)
    return rounded(L.ridge_predict(i, beta, inverse), "predicted", "sigma")


# ---- streams

_EV = "q AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY event_type) AS n FROM events)"


def _queue(spark, d):
    return T.numbered(table(spark, d, "events").select("event_type", "event_id", "ts", "value", "user_id"), ["ts", "event_id"], ["event_type"])


query("bounded_queue", f"WITH {_EV} SELECT event_type, event_id, CAST(seq AS INTEGER) AS seq FROM q WHERE seq > n - 50")(lambda spark, d: T.kept_in_queue(_queue(spark, d), 50, ["event_type"]).select("event_type", "event_id", "seq"))
query("queue_statistics", "SELECT event_type, count(*) AS produced, greatest(count(*) - 50, 0) AS dropped, least(count(*), 50) AS size FROM events GROUP BY event_type")(
    lambda spark, d: T.queue_statistics(_queue(spark, d), 50, ["event_type"]).select("event_type", "produced", "dropped", F.col("size").cast("long").alias("size"))
)
query("count_windows", f"WITH {_EV} SELECT event_type, (seq - 1) // 32 AS window, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM q WHERE ((seq - 1) // 32 + 1) * 32 <= n GROUP BY ALL")(
    lambda spark, d: rounded(T.count_windows(_queue(spark, d), 32, ["event_type"]).groupBy("event_type", "window").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=4)
)
query("staleness", f"WITH {_EV}, w AS (SELECT event_type, ((seq - 1) // 32) // 4 AS version, greatest(((seq - 1) // 32) // 4 - user_id % 3, 0) AS made FROM q WHERE ((seq - 1) // 32 + 1) * 32 <= n) SELECT event_type, version, count(*) AS samples, CAST(sum(CASE WHEN version - made >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS stale, max(version - made) AS max_lag FROM w GROUP BY ALL")(
    lambda spark, d: T.staleness(T.versions(T.count_windows(_queue(spark, d), 32, ["event_type"]), 4).withColumn("made_version", F.greatest(F.col("version") - F.col("user_id") % 3, F.lit(0))), ["event_type", "version"])
)
query("window_statistics", f"WITH {_EV}, w AS (SELECT event_type, ((seq - 1) // 32) // 4 AS version, value FROM q) SELECT event_type, round(avg(value), 5) + 0.0 AS mean, max(value) AS max, min(value) AS min, round(quantile_cont(value, 0.5), 5) + 0.0 AS p50, round(quantile_cont(value, 0.95), 5) + 0.0 AS p95, round(quantile_cont(value, 0.99), 5) + 0.0 AS p99, count(DISTINCT version) AS versions FROM w GROUP BY event_type")(
    lambda spark, d: rounded(T.window_statistics(T.versions(T.count_windows(_queue(spark, d), 32, ["event_type"], drop_tail=False), 4), "value", ["event_type"]), "mean", "p50", "p95", "p99", digits=5)
)
query("ready_rows", "SELECT event_id FROM events WHERE event_type <> 'view' AND event_id NOT IN (SELECT event_id FROM events WHERE user_id % 4 = 0)")(
    lambda spark, d: (lambda e: T.ready_rows(e.withColumn("out", F.when(F.col("event_type") != "view", F.col("value"))), ["out"], e.where("user_id % 4 = 0").select("event_id", F.lit("train").alias("task")), "train", "event_id").select("event_id"))(table(spark, d, "events"))
)
query("traced_rows")(lambda spark, d: T.traced(table(spark, d, "events").select("user_id", "event_id"), "user_id", 5))
query("chat_texts", "SELECT conv_id, turn, '<|' || role || '|>' || text || chr(10) AS t FROM conversations")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", D.chat_text(F.array(D.message(F.col("role"), F.col("text")))).alias("t"))
)
query("frozen_weights", "SELECT c_custkey AS idx, round(greatest(c_acctbal, 0.05 * (SELECT max(c_acctbal) FROM customer)), 6) + 0.0 AS weight FROM customer")(
    lambda spark, d: rounded(L.frozen_weights(table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), "c_acctbal"), "c_acctbal").select("idx", "weight"), "weight")
)
query("derived_metrics", "WITH e AS (SELECT event_type AS t, sum(value) AS v FROM events GROUP BY event_type), m AS (SELECT sum(v) AS s, max(v) AS hi, min(v) AS lo FROM e) SELECT 'global_seqlen/max' AS name, round(hi, 4) + 0.0 AS value FROM m UNION ALL SELECT 'global_seqlen/min', round(lo, 4) + 0.0 FROM m UNION ALL SELECT 'global_seqlen/minmax_diff', round(hi - lo, 4) + 0.0 FROM m UNION ALL SELECT 'perf/total_num_tokens', round(s, 4) + 0.0 FROM m UNION ALL SELECT 'perf/time_per_step', 7.0 UNION ALL SELECT 'perf/throughput', round(s / 56.0, 4) + 0.0 FROM m")(
    lambda spark, d: (lambda m: rounded(Q.derived_metrics(m.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in (("global_seqlen/max", F.col("hi")), ("global_seqlen/min", F.col("lo")), ("global_seqlen/minmax_diff", F.lit(0.0)), ("perf/total_num_tokens", F.col("s")), ("perf/time_per_step", F.lit(7.0)), ("perf/throughput", F.lit(0.0)))])).alias("x")).select("x.*"), 8), "value", digits=4))(
        table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("v")).agg(F.sum("v").alias("s"), F.max("v").alias("hi"), F.min("v").alias("lo"))
    )
)
