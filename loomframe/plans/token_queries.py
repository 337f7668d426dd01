"""Queries of the estimators, kernels, losses and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import advantages as G
from ..operators import losses as M
from ..operators import offpolicy as R
from .views import TOK_SQL, long, query, r, rollouts, rounded, table, tokens, trajectories

KEY = "l_orderkey, l_linenumber, l_partkey, l_extendedprice AS score"


def _group(name: str, estimator: str, sql_value: str, digits: int = 6, **options):
    w = "OVER (PARTITION BY l_orderkey)"

    def run(spark, d):
        return rounded(G.compute_advantage(rollouts(spark, d), estimator, **options).select("l_orderkey", "l_linenumber", "l_partkey", "score", "advantage"), "advantage", digits=digits)

    sql = f"SELECT {KEY}, round({sql_value.replace('{w}', w)}, {digits}) + 0.0 AS advantage FROM lineitem"
    query(name, sql)(run)


S = "l_extendedprice"
_group("grpo_advantage", "grpo", f"CASE WHEN count(*) {{w}} = 1 THEN {S} / (1 + 1e-6) ELSE ({S} - avg({S}) {{w}}) / (stddev_samp({S}) {{w}} + 1e-6) END")
_group("grpo_no_std", "grpo", f"CASE WHEN count(*) {{w}} = 1 THEN {S} ELSE {S} - avg({S}) {{w}} END", by_std=False)
_group("grpo_vectorized", "grpo_vectorized", f"CASE WHEN count(*) {{w}} = 1 THEN {S} / (1 + 1e-6) ELSE ({S} - avg({S}) {{w}}) / (sqrt(greatest(var_samp({S}) {{w}}, 1e-6)) + 1e-6) END")
_group("rloo", "rloo", f"CASE WHEN count(*) {{w}} = 1 THEN {S} ELSE ({S} - avg({S}) {{w}}) * count(*) {{w}} / (count(*) {{w}} - 1) END")
_group("rloo_vectorized", "rloo_vectorized", f"CASE WHEN count(*) {{w}} > 1 THEN (count(*) {{w}} * {S} - sum({S}) {{w}}) / greatest(count(*) {{w}} - 1, 1) ELSE 0.0 END")
_PRIME = "l_extendedprice / 7919.0"  # no decimal of few digits, so that rounding meets no ties


@query("opo", f"SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round({_PRIME} - CASE WHEN count(*) OVER w = 1 THEN 0.0 ELSE sum({_PRIME} * l_quantity) OVER w / sum(l_quantity) OVER w END, 6) + 0.0 AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def _(spark, d):
    x = rollouts(spark, d).withColumn("l_extendedprice", F.col("score")).withColumn("score", F.col("score") / 7919.0)
    return rounded(G.compute_advantage(x, "opo").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "advantage"), "advantage")


_group("gpg", "gpg", f"(SELECT count(*) / greatest(sum(CASE WHEN {S} <> 0 THEN 1 ELSE 0 END), 1) FROM lineitem) * ({S} - CASE WHEN count(*) {{w}} = 1 THEN 0.0 ELSE avg({S}) {{w}} END)", 7)


@query(
    "grpo_passk",
    "WITH o AS (SELECT o_custkey % 50 AS uid, o_orderkey AS row_idx, o_totalprice AS score FROM orders), g AS (SELECT uid, row_idx, score, stddev_samp(score) OVER (PARTITION BY uid) AS s, row_number() OVER (PARTITION BY uid ORDER BY score DESC, row_idx) AS k, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, row_idx) AS nxt FROM o) SELECT row_idx, uid, round(CASE WHEN k = 1 THEN (score - nxt) / (s + 1e-6) ELSE 0.0 END, 6) + 0.0 AS advantage FROM g",
)
def _(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), (F.col("o_custkey") % 50).alias("uid"), F.col("o_totalprice").alias("score"))
    return rounded(G.compute_advantage(o, "grpo_passk").select("row_idx", "uid", "advantage"), "advantage")


@query("group_mean_std", f"SELECT l_orderkey AS uid, round(CASE WHEN count(*) = 1 THEN 0.0 ELSE avg({S}) END, 6) + 0.0 AS mean, round(CASE WHEN count(*) = 1 THEN 1.0 ELSE sqrt(greatest(var_samp({S}), 1e-6)) END, 6) + 0.0 AS std, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return rounded(G.group_mean_std(rollouts(spark, d)), "mean", "std")


@query("group_ids", "SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS gid FROM customer")
def _(spark, d):
    return G.group_ids(table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("uid"))).select("c_custkey", "gid")


_SCORED = f"WITH {TOK_SQL}, s AS (SELECT rid, uid, sum(r) AS score FROM tok JOIN traj USING (rid) GROUP BY rid, uid)"


def _scored(spark, d):
    return trajectories(spark, d).withColumn("score", A.total("rewards"))


@query(
    "reinforce_plus_plus_baseline",
    _SCORED + ", c AS (SELECT rid, CASE WHEN count(*) OVER (PARTITION BY uid) = 1 THEN score ELSE score - avg(score) OVER (PARTITION BY uid) END AS adv FROM s), w AS (SELECT avg(adv) AS mu, var_samp(adv) AS va FROM c JOIN tok USING (rid) WHERE m = 1) SELECT rid, t, round(m * (adv - mu) / sqrt(va + 1e-8), 5) + 0.0 AS advantages FROM c JOIN tok USING (rid), w",
)
def _(spark, d):
    out = G.compute_advantage(_scored(spark, d), "reinforce_plus_plus_baseline")
    return rounded(long(out, "advantages"), "advantages", digits=5).withColumn("t", F.col("t").cast("long"))


@query("remax_return", f"WITH {TOK_SQL} SELECT rid, t, round(sum(r * m) OVER (PARTITION BY rid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0 AS returns, round(sum(r * m) OVER (PARTITION BY rid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.05 * m, 6) + 0.0 AS advantages FROM tok")
def _(spark, d):
    out = G.compute_advantage(trajectories(spark, d).withColumn("baseline", F.lit(0.05)), "remax")
    return rounded(long(out, "returns", "advantages"), "returns", "advantages").withColumn("t", F.col("t").cast("long"))


_REV = "z AS (SELECT *, count(*) OVER (PARTITION BY rid) AS n FROM tok)"


@query(
    "discounted_return",
    f"WITH RECURSIVE {TOK_SQL}, {_REV}, s AS (SELECT rid, t, r AS ret, m FROM z WHERE t = n UNION ALL SELECT z.rid, z.t, z.r + 0.9 * s.ret * s.m, z.m FROM s JOIN z ON z.rid = s.rid AND z.t = s.t - 1) SELECT rid, t, round(ret, 6) + 0.0 AS returns FROM s",
)
def _(spark, d):
    out = trajectories(spark, d).withColumn("returns", A.discounted_return("rewards", "mask", 0.9))
    return rounded(long(out, "returns"), "returns").withColumn("t", F.col("t").cast("long"))


@query(
    "gae",
    f"WITH RECURSIVE {TOK_SQL}, {_REV}, s AS (SELECT rid, t, CASE WHEN m = 1 THEN r - v ELSE 0.0 END AS g, CASE WHEN m = 1 THEN v ELSE 0.0 END AS nv, v, m FROM z WHERE t = n UNION ALL SELECT z.rid, z.t, CASE WHEN z.m = 1 THEN z.r + 0.99 * s.nv - z.v + 0.99 * 0.95 * s.g ELSE s.g END, CASE WHEN z.m = 1 THEN z.v ELSE s.nv END, z.v, z.m FROM s JOIN z ON z.rid = s.rid AND z.t = s.t - 1), w AS (SELECT avg(g) AS mu, var_samp(g) AS va FROM s WHERE m = 1) SELECT rid, t, round(g + v, 6) + 0.0 AS returns, round((g - mu) / sqrt(va + 1e-8), 5) + 0.0 AS advantages FROM s, w",
)
def _(spark, d):
    out = G.compute_advantage(trajectories(spark, d), "gae", gamma=0.99, lam=0.95)
    return rounded(rounded(long(out, "returns", "advantages"), "returns"), "advantages", digits=5).withColumn("t", F.col("t").cast("long"))


def _otb_sql(compact: bool) -> str:
    step = "row_number() OVER (PARTITION BY rid ORDER BY t)" if compact else "t"
    where = "WHERE m = 1" if compact else ""
    return (
        f"WITH {TOK_SQL}, x AS (SELECT uid, tok.*, {step} AS step, 1 - 2 * exp(lp) + exp(2 * lp) * 1.5 AS w FROM tok JOIN traj USING (rid) {where}), "
        "y AS (SELECT *, sum(w * m) OVER (PARTITION BY rid ORDER BY t) AS cw, sum(r * m) OVER (PARTITION BY rid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g FROM x), "
        "b AS (SELECT uid, step, sum(g * cw * m) / (sum(cw * m) + 1e-8) AS b FROM y GROUP BY uid, step), "
        "l AS (SELECT uid, rid, sum(m) AS len FROM tok JOIN traj USING (rid) GROUP BY uid, rid), "
        "k AS (SELECT uid, rid, len, row_number() OVER (PARTITION BY uid ORDER BY len DESC, rid) AS k, count(*) OVER (PARTITION BY uid) AS n FROM l), "
        "s AS (SELECT uid, max(n) AS n, coalesce(max(CASE WHEN k = 2 THEN len END), 0) AS second FROM k GROUP BY uid) "
        "SELECT rid, t, round(CASE WHEN n = 1 OR step > second THEN 0.0 ELSE (g - b) * m END, 6) + 0.0 AS advantage FROM y JOIN b USING (uid, step) JOIN s USING (uid)"
    )


def _otb(spark, d, compact):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rid"), F.col("o_custkey").alias("uid"))
    x = tokens(spark, d).join(o, "rid").withColumn("pi2", F.exp(2 * F.col("lp")) * 1.5).withColumnRenamed("rid", "row_idx")
    out = G.compute_advantage(x, "optimal_token_baseline", compact=compact)
    return rounded(out.select(F.col("row_idx").alias("rid"), F.col("t").cast("long").alias("t"), "advantage"), "advantage")


query("optimal_token_baseline", _otb_sql(False))(lambda spark, d: _otb(spark, d, False))
query("optimal_token_baseline_turns", _otb_sql(True))(lambda spark, d: _otb(spark, d, True))


@query(
    "run_lengths",
    "WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS new FROM orders), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS run FROM a) SELECT o_custkey, o_orderkey, run, CAST(row_number() OVER (PARTITION BY o_custkey, run ORDER BY o_orderkey) - 1 AS INTEGER) AS run_pos FROM b",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return G.runs(o, order="o_orderkey", key="o_orderstatus", partition="o_custkey").select("o_custkey", "o_orderkey", "run", "run_pos")


@query(
    "prefix_groups",
    "WITH a AS (SELECT o_custkey, o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) THEN 0 ELSE 1 END AS new FROM orders), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS run FROM a) SELECT o_custkey, run, count(*) AS size, min(o_orderkey) AS first_row, min(o_orderstatus) AS uid FROM b GROUP BY o_custkey, run",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("row_idx"), F.col("o_orderstatus").alias("uid"))
    return G.prefix_groups(o, partition="o_custkey")


_K3 = "least(greatest(exp(least(greatest(refp - olp, -20), 20)) - least(greatest(refp - olp, -20), 20) - 1, -10), 10)"


@query("kl_values", f"WITH {TOK_SQL} SELECT rid, round(sum((olp - refp) * m), 6) + 0.0 AS k1, round(sum(abs(olp - refp) * m), 6) + 0.0 AS abs_, round(sum(0.5 * (olp - refp) * (olp - refp) * m), 6) + 0.0 AS k2, round(sum({_K3} * m), 6) + 0.0 AS k3 FROM tok GROUP BY rid")
def _(spark, d):
    t = trajectories(spark, d)
    kinds = {"k1": "k1", "abs_": "abs", "k2": "mse", "k3": "low_var_kl+"}
    return rounded(t.select(F.col("row_idx").alias("rid"), *[A.masked_sum(M.kl_values("old_lp", "ref_lp", k), "mask").alias(n) for n, k in kinds.items()]), *kinds)


@query("kl_rewards", f"WITH {TOK_SQL} SELECT rid, round(sum(r - 0.1 * (olp - refp) * m), 6) + 0.0 AS reward, round(sum((olp - refp) * m) / (sum(m) + 1e-8), 6) + 0.0 AS kl FROM tok GROUP BY rid")
def _(spark, d):
    t = G.kl_rewards(trajectories(spark, d).withColumnRenamed("rewards", "scores"), 0.1)
    return rounded(t.select(F.col("row_idx").alias("rid"), A.total("rewards").alias("reward"), "kl"), "reward", "kl")


@query(
    "adaptive_kl_coefficient",
    "WITH RECURSIVE k AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, abs(value) / 100 AS kl FROM events), s AS (SELECT user_id, CAST(0 AS BIGINT) AS i, 0.2::DOUBLE AS beta FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT k.user_id, k.i, s.beta * (1 + least(greatest(k.kl / 0.5 - 1, -0.2), 0.2) * 4 / 1000.0) FROM s JOIN k ON k.user_id = s.user_id AND k.i = s.i + 1) SELECT user_id, round(arg_max(beta, i), 8) + 0.0 AS beta FROM s GROUP BY user_id",
)
def _(spark, d):
    e = table(spark, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: F.abs(x["value"]) / 100).alias("kl"))
    return e.select("user_id", r(G.adapted_betas(F.col("kl"), 0.2, 0.5, 4, 1000.0), 8).alias("beta"))


@query("masked_statistics", f"WITH {TOK_SQL}, n AS (SELECT rid, sum(m) AS k FROM tok GROUP BY rid), mu AS (SELECT rid, sum(v * m) AS s, sum(v * m) / (sum(m) + 1e-8) AS mean FROM tok GROUP BY rid) SELECT rid, round(max(s), 6) + 0.0 AS total, round(max(mean), 6) + 0.0 AS mean, CASE WHEN max(k) > 1 THEN round(sum(m * (v - mean) * (v - mean)) / (max(k) + 1e-8) * max(k) / (max(k) - 1), 8) + 0.0 END AS var FROM tok JOIN mu USING (rid) JOIN n USING (rid) GROUP BY rid")
def _(spark, d):
    t = trajectories(spark, d)
    t = t.select(F.col("row_idx").alias("rid"), A.masked_sum("values", "mask").alias("total"), A.masked_mean("values", "mask").alias("mean"), F.when(A.count_mask("mask") > 1, A.masked_var("values", "mask")).alias("var"))
    return rounded(rounded(t, "total", "mean"), "var", digits=8)


@query("masked_whiten", f"WITH {TOK_SQL}, w AS (SELECT avg(v) AS mu, var_samp(v) AS va FROM tok WHERE m = 1) SELECT rid, t, round((v - mu) / sqrt(va + 1e-8) + mu, 6) + 0.0 AS x FROM tok, w")
def _(spark, d):
    t = G.whitened(trajectories(spark, d).withColumnRenamed("values", "x"), "x", shift_mean=False)
    return rounded(long(t, "x"), "x").withColumn("t", F.col("t").cast("long"))


@query(
    "logit_statistics",
    "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), z AS (SELECT vec_id, max(v) + ln(sum(exp(v))) - max(v) AS lse FROM x GROUP BY vec_id) SELECT vec_id, round(max(CASE WHEN i = label THEN v END) - max(lse), 6) + 0.0 AS log_prob, round(max(lse) - sum(exp(v - lse) * v), 6) + 0.0 AS entropy, round(sum(exp(2 * (v - lse))), 8) + 0.0 AS pi2 FROM x JOIN z USING (vec_id) GROUP BY vec_id",
)
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))
    e = e.select("vec_id", A.log_prob_of("x", "label").alias("log_prob"), A.entropy("x").alias("entropy"), A.sum_pi_squared("x").alias("pi2"))
    return rounded(rounded(e, "log_prob", "entropy"), "pi2", digits=8)


# ---- losses

_L = "round({}, 6) + 0.0 AS {}"
_ROWS = "g AS (SELECT rid, sum(x * m) AS s, sum(m) AS n, count(*) AS width FROM x GROUP BY rid)"
_MODES = "sum(s) / sum(n) AS token_mean, sum(CASE WHEN n > 0 THEN s ELSE 0 END) / sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS seq_mean_token_sum, sum(s) / max(width) AS seq_mean_token_sum_norm, sum(CASE WHEN n > 0 THEN s / (n + 1e-8) ELSE 0 END) / sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS seq_mean_token_mean"
_MODE_NAMES = ["token_mean", "seq_mean_token_sum", "seq_mean_token_sum_norm", "seq_mean_token_mean"]


def _loss(name: str, loss: str, x: str, **options):
    sql = f"WITH {TOK_SQL}, x AS (SELECT rid, t, m, {x} AS x FROM tok), {_ROWS}, o AS (SELECT {_MODES} FROM g) SELECT {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in _MODE_NAMES)} FROM o"
    query(name, sql)(lambda spark, d: rounded(M.loss_matrix(M.policy_loss(trajectories(spark, d), loss, **options)), *_MODE_NAMES))


_D = "least(greatest(lp - olp, -20), 20)"
_RT = f"exp({_D})"
_PPO = f"greatest(-a * {_RT}, -a * least(greatest({_RT}, 0.8), 1.2))"
_loss("loss_ppo", "vanilla", f"CASE WHEN a < 0 THEN least(-a * 3.0, {_PPO}) ELSE {_PPO} END")
_loss("loss_dppo_tv", "dppo_tv", f"-a * least({_RT}, 20.0) * lp * CASE WHEN CASE WHEN a > 0 THEN exp(lp) - exp(olp) <= 0.05 ELSE exp(lp) - exp(olp) >= -0.05 END THEN 1 ELSE 0 END", low=0.05, high=0.05)
_BK = "exp(olp) * (olp - lp) + (1 - exp(olp)) * ln((1 - exp(olp) + 1e-8) / (1 - exp(lp) + 1e-8))"
_loss("loss_dppo_kl", "dppo_kl", f"-a * least({_RT}, 20.0) * lp * CASE WHEN CASE WHEN a > 0 THEN ({_BK}) <= 0.02 OR exp(lp) <= exp(olp) ELSE ({_BK}) <= 0.02 OR exp(lp) >= exp(olp) END THEN 1 ELSE 0 END", low=0.02, high=0.02)
_loss("loss_sapo", "sapo", f"CASE WHEN a > 0 THEN -a * 4.0 / (1 + exp(-1.0 * ({_RT} - 1))) ELSE -a * (4 / 1.05) / (1 + exp(-1.05 * ({_RT} - 1))) END")
_loss("loss_gpg", "gpg", "-lp * a")
_loss("loss_cispo", "cispo", f"-least(greatest({_RT}, 0.8), 1.2) * a * lp")
_loss("loss_reinforce", "reinforce", "-a * lp")

_GR = "exp(least(q, 10.0))"
query(
    "loss_gspo",
    f"WITH {TOK_SQL}, q AS (SELECT rid, sum((lp - olp) * m) / greatest(sum(m), 1) AS q FROM tok GROUP BY rid), x AS (SELECT rid, t, m, greatest(-a * {_GR}, -a * least(greatest({_GR}, 0.8), 1.2)) AS x FROM tok JOIN q USING (rid)), {_ROWS}, o AS (SELECT {_MODES} FROM g) SELECT round(seq_mean_token_mean, 6) + 0.0 AS seq_mean_token_mean FROM o",
)(lambda spark, d: rounded(M.loss_matrix(M.policy_loss(trajectories(spark, d), "gspo"), ["seq-mean-token-mean"]), "seq_mean_token_mean"))

query(
    "loss_geo_mean",
    f"WITH {TOK_SQL}, g AS (SELECT rid, sum(m * a) / (sum(m) + 1e-8) AS adv, sum(m * sign(a) * least(sign(a) * (lp - olp), sign(a) * least(greatest(lp - olp, -0.2), 0.2))) / (sum(m) + 1e-8) AS q FROM tok GROUP BY rid) SELECT rid, round(-adv * exp(q), 6) + 0.0 AS row_loss FROM g",
)(lambda spark, d: rounded(M.policy_loss(trajectories(spark, d), "geo_mean").select(F.col("row_idx").alias("rid"), "row_loss"), "row_loss"))


@query(
    "loss_kl_cov",
    f"WITH {TOK_SQL}, v AS (SELECT * FROM tok WHERE m = 1), c AS (SELECT *, (a - (SELECT avg(a) FROM v)) * (lp - (SELECT avg(lp) FROM v)) AS cov FROM v), k AS (SELECT *, row_number() OVER (ORDER BY cov DESC, rid, t) <= greatest(1, CAST(floor((SELECT count(*) FROM v) * 0.002) AS BIGINT)) AS top FROM c) SELECT round(avg(-a * exp(lp - olp) + CASE WHEN top THEN abs(lp - olp) ELSE 0 END), 6) + 0.0 AS loss, sum(CASE WHEN top THEN 1 ELSE 0 END)::BIGINT AS n_top FROM k",
)
def _(spark, d):
    return rounded(M.kl_cov(trajectories(spark, d), 0.002), "loss")


@query("loss_clip_cov")
def _(spark, d):
    return rounded(M.clip_cov(trajectories(spark, d), 0.002, lower=0.0, upper=0.5), "loss", "clip_fraction")


@query(
    "value_loss",
    f"WITH {TOK_SQL}, x AS (SELECT rid, t, m, 0.5 * greatest((lp - r) * (lp - r), (least(greatest(lp, v - 0.5), v + 0.5) - r) ** 2) AS x, CASE WHEN (least(greatest(lp, v - 0.5), v + 0.5) - r) ** 2 > (lp - r) * (lp - r) THEN 1.0 ELSE 0.0 END AS c FROM tok) SELECT round(sum(x * m) / sum(m), 6) + 0.0 AS loss, round(sum(c * m) / sum(m), 6) + 0.0 AS clip_fraction FROM x",
)
def _(spark, d):
    t = M.value_loss(trajectories(spark, d).withColumn("predictions", F.col("lp")).withColumn("returns", F.col("rewards")))
    return rounded(t.agg(M.agg_loss(t, "token-mean").alias("loss"), M.agg_loss(t, "token-mean", loss="clipped").alias("clip_fraction")), "loss", "clip_fraction")


query("sft_loss", f"WITH {TOK_SQL} SELECT round(-sum(lp * m) / sum(m), 6) + 0.0 AS loss FROM tok")(lambda spark, d: rounded(M.sft_loss(trajectories(spark, d)), "loss"))
query(
    "sft_loss_rolled",
    f"WITH {TOK_SQL}, x AS (SELECT lp, m, coalesce(lead(m) OVER (ORDER BY rid, t), first_value(m) OVER (ORDER BY rid, t)) AS nm FROM tok) SELECT round(-sum(lp * nm) / sum(m), 6) + 0.0 AS loss FROM x",
)(lambda spark, d: rounded(M.sft_loss(trajectories(spark, d), rolled=True), "loss"))


@query(
    "ppo_total_loss",
    f"WITH {TOK_SQL}, x AS (SELECT m, CASE WHEN a < 0 THEN least(-a * 3.0, {_PPO}) ELSE {_PPO} END AS pg, v AS ent, least(greatest(exp(least(greatest(refp - lp, -20), 20)) - least(greatest(refp - lp, -20), 20) - 1, -10), 10) AS kl FROM tok), o AS (SELECT sum(pg * m) / sum(m) AS pg_loss, sum(ent * m) / sum(m) AS entropy, sum(kl * m) / sum(m) AS kl_loss FROM x) SELECT round(pg_loss, 6) + 0.0 AS pg_loss, round(entropy, 6) + 0.0 AS entropy, round(kl_loss, 6) + 0.0 AS kl_loss, round(pg_loss - 0.01 * entropy + 0.1 * kl_loss, 6) + 0.0 AS loss FROM o",
)
def _(spark, d):
    t = M.policy_loss(trajectories(spark, d), "vanilla")
    return rounded(M.ppo_total(t, "values", 0.01, 0.1), "pg_loss", "entropy", "kl_loss", "loss")


@query("ppo_clip_fractions", f"WITH {TOK_SQL}, x AS (SELECT m, a, -a * {_RT} AS l1, -a * least(greatest({_RT}, 0.8), 1.2) AS l2, {_D} AS dd FROM tok) SELECT round(sum(m * CASE WHEN l2 > l1 THEN 1.0 ELSE 0.0 END) / sum(m), 6) + 0.0 AS clip_fraction, round(sum(m * CASE WHEN greatest(l1, l2) > -a * 3.0 AND a < 0 THEN 1.0 ELSE 0.0 END) / sum(m), 6) + 0.0 AS clip_fraction_low, round(-sum(dd * m) / sum(m), 6) + 0.0 AS kl FROM x")
def _(spark, d):
    t = M.policy_loss(trajectories(spark, d), "vanilla")
    return rounded(t.agg(*[M.agg_loss(t, "token-mean", loss=c).alias(n) for c, n in (("clipped", "clip_fraction"), ("clipped_low", "clip_fraction_low"), ("kl_tokens", "kl"))]), "clip_fraction", "clip_fraction_low", "kl")


# ---- off-policy correction

_LR = "olp - rlp"
_CL = "least(greatest(olp - rlp, -20), 20)"


@query(
    "importance_weights_token",
    f"WITH {TOK_SQL} SELECT rid, t, round(least(exp({_CL}) * m, 2.0), 6) + 0.0 AS is_weights FROM tok",
)
def _(spark, d):
    return rounded(long(R.importance_weights(trajectories(spark, d), "token"), "is_weights"), "is_weights").withColumn("t", F.col("t").cast("long"))


@query("importance_weights_sequence", f"WITH {TOK_SQL}, s AS (SELECT rid, least(greatest(sum(({_LR}) * m), -20), 20) AS q FROM tok GROUP BY rid) SELECT rid, t, round(least(exp(q) * m, 2.0), 6) + 0.0 AS is_weights FROM tok JOIN s USING (rid)")
def _(spark, d):
    return rounded(long(R.importance_weights(trajectories(spark, d), "sequence"), "is_weights"), "is_weights").withColumn("t", F.col("t").cast("long"))


@query("importance_weights_normalised", f"WITH {TOK_SQL}, w AS (SELECT rid, t, m, least(exp({_CL}) * m, 2.0) AS w FROM tok), n AS (SELECT sum(w) / sum(m) AS mu FROM w) SELECT rid, t, round(w / greatest(mu, 1e-8), 6) + 0.0 AS is_weights FROM w, n")
def _(spark, d):
    return rounded(long(R.importance_weights(trajectories(spark, d), "token", normalise=True), "is_weights"), "is_weights").withColumn("t", F.col("t").cast("long"))


@query(
    "importance_metrics",
    f"WITH {TOK_SQL}, w AS (SELECT least(exp({_CL}) * m, 2.0) AS w FROM tok WHERE m = 1) SELECT round(avg(w), 6) + 0.0 AS mean, round(max(w), 6) + 0.0 AS max, round(min(w), 6) + 0.0 AS min, round(stddev_pop(w), 6) + 0.0 AS std, round(avg(CASE WHEN w >= 2.0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_high, round(avg(CASE WHEN w <= 0.5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_low, round(avg(least(greatest(w, 0.5), 2.0)) ** 2 / avg(least(greatest(w, 0.5), 2.0) ** 2), 6) + 0.0 AS ess FROM w",
)
def _(spark, d):
    return rounded(R.is_metrics(R.importance_weights(trajectories(spark, d), "token")), "mean", "max", "min", "std", "fraction_high", "fraction_low", "ess")


_K = {"k1": f"-({_CL})", "k2": f"0.5 * ({_CL}) * ({_CL})", "k3": f"exp({_CL}) - 1 - ({_CL})"}


def _reject(option: str, threshold, low: float | None, high: float):
    import math

    level, kind = option.rsplit("_", 1)
    ok = (lambda s: f"({s} >= {math.log(low)!r} AND {s} <= {math.log(high)!r})") if low is not None else (lambda s: f"({s} <= {high!r})")
    if level == "token":
        sql = f"WITH {TOK_SQL} SELECT rid, CAST(sum(CASE WHEN {ok('(' + _K[kind] + ')')} THEN m ELSE 0 END) AS BIGINT) AS kept, CAST(sum(m) AS BIGINT) AS valid FROM tok GROUP BY rid"
    else:
        stat = {"seq_sum": f"sum(({_K[kind]}) * m)", "seq_mean": f"sum(({_K[kind]}) * m) / (sum(m) + 1e-8)", "seq_max": f"coalesce(max(CASE WHEN m = 1 THEN {_K[kind]} END), 0.0)"}[level]
        sql = f"WITH {TOK_SQL}, s AS (SELECT rid, {stat} AS s, sum(m) AS n FROM tok GROUP BY rid) SELECT rid, CAST(CASE WHEN {ok('s')} THEN n ELSE 0 END AS BIGINT) AS kept, CAST(n AS BIGINT) AS valid FROM s"

    def run(spark, d):
        t = R.rejection_mask(trajectories(spark, d), option, threshold)
        return t.select(F.col("row_idx").alias("rid"), A.count_mask("kept_mask").cast("long").alias("kept"), A.count_mask("mask").cast("long").alias("valid"))

    query(f"reject_{option}", sql)(run)


for _o, _t, _lo, _hi in (
    ("token_k1", "0.7_1.3", 0.7, 1.3), ("token_k2", 0.013, None, 0.013), ("token_k3", 0.017, None, 0.017),
    ("seq_sum_k1", "0.61_1.43", 0.61, 1.43), ("seq_sum_k2", 0.137, None, 0.137), ("seq_sum_k3", 0.151, None, 0.151),
    ("seq_mean_k1", "0.83_1.17", 0.83, 1.17), ("seq_mean_k2", 0.0413, None, 0.0413), ("seq_mean_k3", 0.0419, None, 0.0419),
    ("seq_max_k2", 0.1171, None, 0.1171), ("seq_max_k3", 0.1013, None, 0.1013),
):
    _reject(_o, _t, _lo, _hi)

query("reject_combined")(
    lambda spark, d: R.corrected(trajectories(spark, d), "token", options="token_k1,seq_mean_k3", threshold="0.7_1.3,0.0419").select(
        F.col("row_idx").alias("rid"), A.count_mask("kept_mask").cast("long").alias("kept"), r(A.total("is_weights")).alias("weight")
    )
)

_OFF = ["kl", "k3_kl", "training_ppl", "rollout_ppl", "training_log_ppl", "rollout_log_ppl", "log_ppl_diff", "log_ppl_abs_diff", "log_ppl_diff_max", "log_ppl_diff_min", "ppl_ratio", "chi2_token", "chi2_seq"]
query(
    "offpolicy_metrics",
    f"WITH {TOK_SQL}, s AS (SELECT rid, sum(olp * m) / (sum(m) + 1e-8) AS tr, sum(rlp * m) / (sum(m) + 1e-8) AS ro, sum(m) AS n, sum(({_LR}) * m) AS q, sum((exp({_LR}) - ({_LR}) - 1) * m) AS k3, sum(exp(2 * {_CL}) * m) AS rho2 FROM tok GROUP BY rid), o AS (SELECT -sum(q) / sum(n) AS kl, sum(k3) / sum(n) AS k3_kl, avg(exp(-tr)) AS training_ppl, avg(exp(-ro)) AS rollout_ppl, avg(-tr) AS training_log_ppl, avg(-ro) AS rollout_log_ppl, avg(ro - tr) AS log_ppl_diff, avg(abs(ro - tr)) AS log_ppl_abs_diff, max(ro - tr) AS log_ppl_diff_max, min(ro - tr) AS log_ppl_diff_min, avg(exp(ro - tr)) AS ppl_ratio, sum(rho2) / sum(n) - 1 AS chi2_token, avg(exp(2 * least(greatest(q, -20), 20))) - 1 AS chi2_seq FROM s) SELECT {', '.join(f'round({n}, 5) + 0.0 AS {n}' for n in _OFF)} FROM o",
)(lambda spark, d: rounded(R.divergence_metrics(trajectories(spark, d)), *_OFF, digits=5))

query(
    "probability_differences",
    f"WITH {TOK_SQL}, x AS (SELECT exp(olp) AS p, exp(rlp) AS q FROM tok WHERE m = 1) SELECT round(max(abs(p - q)), 6) + 0.0 AS diff_max, round(avg(abs(p - q)), 6) + 0.0 AS diff_mean, round(stddev_samp(abs(p - q)), 6) + 0.0 AS diff_std, round(corr(p, q), 6) + 0.0 AS corr FROM x",
)(lambda spark, d: rounded(R.debug_metrics(trajectories(spark, d)), "diff_max", "diff_mean", "diff_std", "corr"))

query(
    "rejection_metrics",
    f"WITH {TOK_SQL}, s AS (SELECT rid, sum(({_K['k3']}) * m) / (sum(m) + 1e-8) AS x, sum(m) AS n FROM tok GROUP BY rid), t AS (SELECT 1 - sum(CASE WHEN x <= 0.0419 THEN n ELSE 0 END) / sum(n) AS a, avg(CASE WHEN x > 0.0419 AND n > 0 THEN 1.0 ELSE 0.0 END) AS b FROM s) SELECT round(avg(x), 6) + 0.0 AS mean, round(max(x), 6) + 0.0 AS max, round(min(x), 6) + 0.0 AS min, round(stddev_pop(x), 6) + 0.0 AS std, round(avg(CASE WHEN x > 0.0419 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS fraction_high, 0.0::DOUBLE AS fraction_low, round(any_value(t.a), 6) + 0.0 AS masked_fraction, round(any_value(t.b), 6) + 0.0 AS seq_masked_fraction FROM s, t WHERE n > 0",
)(lambda spark, d: rounded(R.rejection_metrics(trajectories(spark, d), "seq_mean_k3", 0.0419), "mean", "max", "min", "std", "fraction_high", "fraction_low", "masked_fraction", "seq_masked_fraction"))
query("bypass_reinforce_loss", f"WITH {TOK_SQL}, x AS (SELECT m, -a * lp * least(exp(least(greatest(lp - rlp, -20), 20)) * m, 2.0) AS x FROM tok) SELECT round(sum(x * m) / sum(m), 6) + 0.0 AS loss FROM x")(
    lambda spark, d: (lambda t: rounded(t.agg(M.agg_loss(t, "token-mean").alias("loss")), "loss"))(R.bypass_loss(trajectories(spark, d), "reinforce", "token"))
)


@query(
    "long_scans",
    "WITH t AS (SELECT l_suppkey % 40 AS rid, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS t, CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS m, l_discount AS r FROM lineitem) SELECT rid, count(*) AS n, CAST(greatest(sum(m) - 1, 0) AS INTEGER) AS last_position, round(sum(t * r * m), 3) + 0.0 AS suffix_total FROM t GROUP BY rid",
)
def _(spark, d):
    """Scans along arrays of thousands of tokens."""
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("rid"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.expr("CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END").alias("m"), F.col("l_discount").alias("r")).alias("z"))
    g = li.groupBy("rid").agg(F.sort_array(F.collect_list("z")).alias("z")).select("rid", F.col("z.m").alias("mask"), F.col("z.r").alias("rewards"))
    out = g.select("rid", F.size("mask").cast("long").alias("n"), F.array_max(A.position_ids("mask")).alias("last_position"), A.total(A.running(A.masked("rewards", "mask"), reverse=True)).alias("suffix_total"))
    return rounded(out, "suffix_total", digits=3)
