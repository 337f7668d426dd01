"""Queries of batch verbs, joins, preparation, scoring, sources and balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as X
from ..operators import balance as P
from ..operators import batch as B
from ..operators import joins as J
from ..operators import metrics as Q
from ..operators import selection as L
from ..sources import prep as D
from ..sources import readers as S
from .views import POS_SQL, TOK_SQL, positions, query, r, rounded, table, trajectories

# ---- batch verbs over customers at dense positions

query("batch_select", f"WITH {POS_SQL} SELECT row_idx, c_acctbal, c_mktsegment FROM pos")(lambda spark, d: B.project(positions(spark, d), "c_acctbal", "c_mktsegment"))
query("batch_select_mask", f"WITH {POS_SQL} SELECT * FROM pos WHERE c_acctbal > 0")(lambda spark, d: B.select_mask(positions(spark, d), F.col("c_acctbal") > 0))
query("batch_slice", f"WITH {POS_SQL} SELECT (row_idx - 10) // 3 AS row_idx, c_name FROM pos WHERE row_idx >= 10 AND row_idx < (SELECT count(*) FROM pos) - 5 AND (row_idx - 10) % 3 = 0")(
    lambda spark, d: B.slice_rows(positions(spark, d).select("row_idx", "c_name"), 10, -5, 3)
)
query("batch_pop_rename", f"WITH {POS_SQL} SELECT row_idx, c_name AS name, c_acctbal AS balance FROM pos")(
    lambda spark, d: B.rename(B.pop(positions(spark, d), "c_name", "c_acctbal")[0], ["c_name", "c_acctbal"], ["name", "balance"])
)


@query("batch_gather", f"WITH {POS_SQL} SELECT o_orderkey AS row_idx, c_name FROM orders JOIN pos ON pos.row_idx = o_custkey - (SELECT min(c_custkey) FROM customer)")
def _(spark, d):
    from .views import first_key

    picks = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") - first_key(spark, d)).alias("row_idx"))
    return B.gather(positions(spark, d).select("row_idx", "c_name"), picks)


@query("batch_union", f"WITH {POS_SQL} SELECT row_idx, c_name, c_acctbal, c_mktsegment, c_acctbal * 2 AS double_balance FROM pos")
def _(spark, d):
    p = positions(spark, d)
    return B.union_columns(p.select("row_idx", "c_name", "c_acctbal", "c_mktsegment"), p.select("row_idx", "c_acctbal", (F.col("c_acctbal") * 2).alias("double_balance")))


@query("batch_conflicts", f"WITH {POS_SQL} SELECT count(*) AS matched, CAST(0 AS BIGINT) AS c_name, CAST(sum(CASE WHEN c_acctbal <> abs(c_acctbal) THEN 1 ELSE 0 END) AS BIGINT) AS c_acctbal FROM pos")
def _(spark, d):
    p = positions(spark, d).select("row_idx", "c_name", "c_acctbal")
    return B.conflicts(p, p.withColumn("c_acctbal", F.abs("c_acctbal")), ["c_name", "c_acctbal"])


@query("batch_concat", f"WITH {POS_SQL}, a AS (SELECT * FROM pos), b AS (SELECT * FROM pos WHERE c_acctbal < 0) SELECT row_idx, c_name FROM a UNION ALL SELECT row_number() OVER (ORDER BY row_idx) - 1 + (SELECT count(*) FROM a), c_name FROM b")
def _(spark, d):
    p = positions(spark, d).select("row_idx", "c_name", "c_acctbal")
    b = B.number_rows(p.where("c_acctbal < 0").drop("row_idx").join(p.select("c_name", F.col("row_idx").alias("o")), "c_name"), ["o"])
    return B.concat([p.select("row_idx", "c_name"), b.select("row_idx", "c_name")])


query("batch_chunk", f"WITH {POS_SQL} SELECT row_idx, c_name, CAST(row_idx // CAST(ceil((SELECT count(*) FROM pos) / 7.0) AS BIGINT) AS INTEGER) AS chunk FROM pos")(
    lambda spark, d: (lambda p: p.select("row_idx", "c_name", B.chunk_id(p.count(), 7, padded=True).alias("chunk")))(positions(spark, d))
)
query("batch_split", f"WITH {POS_SQL} SELECT row_idx, CAST(row_idx // 64 AS INTEGER) AS part FROM pos")(lambda spark, d: positions(spark, d).select("row_idx", B.split_id(64).alias("part")))
query("batch_repeat_interleaved", f"WITH {POS_SQL} SELECT row_idx * 3 + k AS row_idx, c_name FROM pos, (SELECT unnest([0, 1, 2]) AS k)")(
    lambda spark, d: B.repeat(positions(spark, d).select("row_idx", "c_name"), 3)
)
query("batch_repeat_tiled", f"WITH {POS_SQL} SELECT row_idx + k * (SELECT count(*) FROM pos) AS row_idx, c_name FROM pos, (SELECT unnest([0, 1, 2]) AS k)")(
    lambda spark, d: B.repeat(positions(spark, d).select("row_idx", "c_name"), 3, interleave=False)
)
query("batch_repeat_each", f"WITH {POS_SQL} SELECT row_idx, c_name, CAST(copy AS BIGINT) AS copy FROM (SELECT row_idx, c_name, unnest(range(0, row_idx % 4)) AS copy FROM pos)")(
    lambda spark, d: B.repeat_each(positions(spark, d).select("row_idx", "c_name"), F.col("row_idx") % 4)
)
query("batch_unfold", "SELECT vec_id * 4 + k AS row_idx, label, CAST(embedding[k * 16 + 1] AS DOUBLE) AS first, CAST(embedding[k * 16 + 16] AS DOUBLE) AS last FROM embeddings, (SELECT unnest([0, 1, 2, 3]) AS k)")(
    lambda spark, d: B.unfold(table(spark, d, "embeddings").withColumnRenamed("vec_id", "row_idx"), 4, ["embedding"]).select(
        "row_idx", "label", F.element_at("embedding", 1).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last")
    )
)
query("batch_fold", f"WITH {POS_SQL} SELECT row_idx // 5 AS row_idx, string_agg(c_name, ',' ORDER BY row_idx) AS names, count(*)::INTEGER AS n FROM pos GROUP BY row_idx // 5")(
    lambda spark, d: B.fold(positions(spark, d).select("row_idx", "c_name"), 5).select("row_idx", F.array_join("c_name", ",").alias("names"), F.size("c_name").alias("n"))
)
query("batch_fold_unfold", f"WITH {POS_SQL} SELECT row_idx, c_name, c_acctbal FROM pos")(
    lambda spark, d: (lambda p, n: (lambda padded, more: B.unpad(B.unfold_rows(B.fold(padded, 7)), more, n + more))(*B.pad_to_divisor(p, 7, n)))(positions(spark, d).select("row_idx", "c_name", "c_acctbal"), positions(spark, d).count())
)
query("batch_pad", f"WITH {POS_SQL}, n AS (SELECT count(*) AS n, (64 - count(*) % 64) % 64 AS more FROM pos) SELECT row_idx, c_name FROM pos UNION ALL SELECT row_idx + n, c_name FROM pos, n WHERE row_idx < more")(
    lambda spark, d: B.pad_to_divisor(positions(spark, d).select("row_idx", "c_name"), 64)[0]
)


@query("batch_pad_unpad", f"WITH {POS_SQL} SELECT row_idx, c_name FROM pos")
def _(spark, d):
    p = positions(spark, d).select("row_idx", "c_name")
    n = p.count()
    padded, more = B.pad_to_divisor(p, 64, n)
    return B.unpad(padded, more, n + more)


@query("batch_reorder", f"WITH {POS_SQL}, o AS (SELECT row_number() OVER (ORDER BY c_acctbal, row_idx) - 1 AS p, row_idx, c_name FROM pos) SELECT p AS row_idx, c_name FROM o")
def _(spark, d):
    p = positions(spark, d).select("row_idx", "c_name", "c_acctbal")
    perm = B.number_rows(p, ["c_acctbal", "row_idx"], name="pos").select("pos", "row_idx")
    return B.gather(p.select("row_idx", "c_name"), perm)


@query("batch_inverse_permutation", f"WITH {POS_SQL} SELECT row_idx AS pos, row_number() OVER (ORDER BY c_acctbal, row_idx) - 1 AS row_idx FROM pos")
def _(spark, d):
    p = positions(spark, d).select("row_idx", "c_acctbal")
    return B.inverse(B.number_rows(p, ["c_acctbal", "row_idx"], name="pos").select("pos", "row_idx"))


query("batch_mini_batches", f"WITH {POS_SQL} SELECT row_idx, CAST(e AS INTEGER) AS epoch, CAST(row_idx // 10 AS INTEGER) AS batch FROM pos, (SELECT unnest([0, 1]) AS e) WHERE row_idx < (SELECT count(*) FROM pos) // 10 * 10")(
    lambda spark, d: B.mini_batches(positions(spark, d), 10, 2, drop_last=True).select("row_idx", "epoch", "batch")
)
query("batch_metrics_collected", "SELECT event_type AS name, string_agg(CAST(round(value, 2) AS VARCHAR), ';' ORDER BY event_id) AS vals FROM events GROUP BY event_type")(
    lambda spark, d: B.collected(table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_id").alias("part"), F.round("value", 2).alias("value"))).select("name", F.array_join(F.transform("values", lambda v: v.cast("string")), ";").alias("vals"))
)
query("batch_prefixed", "SELECT 'train/' || event_type AS name, count(*) AS value FROM events GROUP BY event_type")(
    lambda spark, d: B.prefixed(table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value")), "train/")
)
query("batch_dispatch", f"WITH {POS_SQL} SELECT row_idx, CAST(least(row_idx * 8 // (SELECT count(*) FROM pos), 7) AS INTEGER) AS rank FROM pos")(
    lambda spark, d: B.dispatch(positions(spark, d).select("row_idx"), 8)
)
query("batch_dispatch_all", f"WITH {POS_SQL} SELECT row_idx, CAST(k AS INTEGER) AS rank FROM pos, (SELECT unnest([0, 1, 2]) AS k)")(lambda spark, d: B.dispatch(positions(spark, d).select("row_idx"), 3, one_to_all=True))
query("batch_meta", f"WITH {POS_SQL} SELECT row_idx, 7 AS step, 'train' AS split FROM pos")(lambda spark, d: B.with_meta(positions(spark, d).select("row_idx"), step=7, split="train"))

# ---- joins

query(
    "join_bijection",
    "WITH l AS (SELECT CAST(c_nationkey AS VARCHAR) AS k FROM customer), a AS (SELECT k, count(*) AS l FROM l GROUP BY k), b AS (SELECT CAST(n_nationkey AS VARCHAR) AS k, count(*) AS r FROM nation GROUP BY k), j AS (SELECT coalesce(a.k, b.k) AS k, l, r FROM a FULL JOIN b ON a.k = b.k) SELECT CAST(0 AS BIGINT) AS blank, CAST(sum(CASE WHEN l > 1 THEN 1 ELSE 0 END) AS BIGINT) AS left_repeated, CAST(sum(CASE WHEN r > 1 THEN 1 ELSE 0 END) AS BIGINT) AS right_repeated, CAST(sum(CASE WHEN r IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing, CAST(sum(CASE WHEN l IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS extra, CAST(sum(CASE WHEN l IS NOT NULL AND r IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched FROM j",
)(lambda spark, d: J.bijection(table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("k")), table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k")), "k"))
query("join_aligned", "SELECT CAST(n_nationkey AS VARCHAR) AS k, n_name, n_regionkey FROM nation")(
    lambda spark, d: J.aligned(table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_name"), table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), "n_regionkey"), "k")
)
query(
    "join_fallback",
    "WITH a AS (SELECT c_custkey, c_name AS name, c_acctbal AS bal FROM customer), b AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name END AS name, c_acctbal AS bal, c_custkey * 10 AS v FROM customer), n1 AS (SELECT name, any_value(v) AS v FROM b WHERE name IS NOT NULL GROUP BY name HAVING count(*) = 1), n2 AS (SELECT bal, any_value(v) AS v FROM b WHERE bal IS NOT NULL GROUP BY bal HAVING count(*) = 1) SELECT a.c_custkey, coalesce(n1.v, n2.v) AS v, CASE WHEN n1.v IS NOT NULL THEN 'name' WHEN n2.v IS NOT NULL THEN 'bal' END AS via FROM a LEFT JOIN n1 ON a.name = n1.name LEFT JOIN n2 ON a.bal = n2.bal",
)(
    lambda spark, d: (lambda c: J.fallback(c.select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal")), c.select(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).alias("name"), F.col("c_acctbal").alias("bal"), (F.col("c_custkey") * 10).alias("v")), "c_custkey", ["name", "bal"], "v"))(table(spark, d, "customer"))
)
query("join_excluded", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")(
    lambda spark, d: J.excluded(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")
)
query("join_subset", "SELECT o_orderkey AS pos, o_custkey AS idx, c_name FROM orders JOIN customer ON c_custkey = o_custkey")(
    lambda spark, d: J.subset(table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), "c_name"), table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("idx"))).select("pos", "idx", "c_name")
)

# ---- preparation

query("length_filter", "SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) <= 200")(
    lambda spark, d: S.short_enough(table(spark, d, "documents"), S.word_count(F.col("text")), 200).select("doc_id")
)
query("sample_then_filter", "SELECT row_idx FROM (SELECT doc_id AS row_idx, text FROM documents ORDER BY doc_id LIMIT 500) WHERE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) <= 200")(
    lambda spark, d: S.short_enough(S.sample(table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), "text"), 500), S.word_count(F.col("text")), 200).select("row_idx")
)
query(
    "preference_rows",
    "WITH p AS (SELECT c.doc_id AS row_idx, c.source, c.text AS chosen, c.lang AS rejected FROM documents c) SELECT row_idx * 2 AS row_idx, source AS prompt, chosen AS response FROM p UNION ALL SELECT row_idx * 2 + 1, source, rejected FROM p",
)(lambda spark, d: D.pairs_to_rows(table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("source").alias("prompt"), F.col("text").alias("chosen"), F.col("lang").alias("rejected"))))
query("head_split", f"WITH {POS_SQL} SELECT row_idx, CASE WHEN row_idx < CAST(floor((SELECT count(*) FROM pos) * 0.75) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM pos")(
    lambda spark, d: (lambda p: D.head_split(p.select("row_idx"), 0.75, p.count()))(positions(spark, d))
)
query("random_split")(lambda spark, d: D.random_split(table(spark, d, "documents").select("doc_id"), 0.1, "doc_id", 7))
query("rl_rows", "SELECT doc_id, 'docs' AS data_source, 'user' AS role, lang AS content, 'rule' AS style, source AS ground_truth, 'train' AS split, doc_id AS idx FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", *D.rl_row("docs", F.array(D.message("user", F.col("lang"))), "text", F.col("source"), "train", F.col("doc_id"))).select(
        "doc_id", "data_source", F.col("prompt")[0]["role"].alias("role"), F.col("prompt")[0]["content"].alias("content"), "reward_model.style", "reward_model.ground_truth", "extra_info.split", F.col("extra_info.index").alias("idx")
    )
)
query("tagged_truth", "SELECT doc_id, 'search_' || source AS data_source, CASE WHEN doc_id % 2 = 0 THEN lang ELSE source END AS ground_truth FROM documents")(
    lambda spark, d: D.tagged_truth(table(spark, d, "documents").select("doc_id", F.col("source").alias("data_source"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("reward_ground_truth"), F.col("source").alias("golden_answers")), "search_").select("doc_id", "data_source", "ground_truth")
)
query("equal_splits", f"WITH {POS_SQL} , n AS (SELECT count(*) + (5 - count(*) % 5) % 5 AS n, (5 - count(*) % 5) % 5 AS more, count(*) AS had FROM pos), x AS (SELECT row_idx FROM pos UNION ALL SELECT row_idx + had FROM pos, n WHERE row_idx < more) SELECT row_idx, CAST(row_idx // (n // 5) AS INTEGER) AS part FROM x, n")(
    lambda spark, d: (lambda padded, more: (lambda n: padded.select("row_idx", D.equal_splits(n, 5).alias("part")))(padded.count()))(*B.pad_to_divisor(positions(spark, d).select("row_idx"), 5))
)
query(
    "sft_loss_mask",
    "WITH w AS (SELECT conv_id, role, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, CAST(sum(len(ws)) AS BIGINT) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN len(ws) ELSE 0 END) AS BIGINT) AS n_loss FROM w GROUP BY conv_id",
)(
    lambda spark, d: D.whole_conversation(table(spark, d, "conversations").withColumn("tokens", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))).select(
        "conv_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("loss_mask", F.lit(0), lambda s, x: s + x).cast("long").alias("n_loss")
    )
)
query("conversation_messages", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' ELSE 'system' END AS role, text AS content FROM conversations")(
    lambda spark, d: table(spark, d, "conversations").select("conv_id", "turn", F.explode(D.conversation_messages(F.array(F.struct(F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise("system").alias("from"), F.col("text").alias("value"))))).alias("m")).select("conv_id", "turn", "m.role", "m.content")
)
query("question_answer_messages", "SELECT item_id, 2 AS n, 'user' AS first, 'assistant' AS second FROM benchmark")(
    lambda spark, d: table(spark, d, "benchmark").select("item_id", D.question_answer_messages(F.col("text"), F.col("text")).alias("m")).select("item_id", F.size("m").alias("n"), F.col("m")[0]["role"].alias("first"), F.col("m")[1]["role"].alias("second"))
)
query("media_segments", "SELECT item_id, CAST(4 + item_id % 2 AS INTEGER) AS n, 'text,image,text,video' || CASE WHEN item_id % 2 = 1 THEN ',image' ELSE '' END AS kinds, 'see ,img' || item_id || ', now ,vid' || item_id || CASE WHEN item_id % 2 = 1 THEN ',more' ELSE '' END AS vals FROM benchmark")(
    lambda spark, d: (lambda odd: table(spark, d, "benchmark").select("item_id", D.media_segments(F.concat(F.lit("see <image> now <video>"), F.when(odd, "<image>").otherwise("")), F.when(odd, F.array(F.concat(F.lit("img"), "item_id"), F.lit("more"))).otherwise(F.array(F.concat(F.lit("img"), "item_id"))), F.array(F.concat(F.lit("vid"), "item_id"))).alias("s")).select(
        "item_id", F.size("s").alias("n"), F.array_join("s.type", ",").alias("kinds"), F.array_join("s.value", ",").alias("vals")
    ))(F.col("item_id") % 2 == 1)
)
query("preference_pairs", f"WITH {TOK_SQL}, g AS (SELECT rid, count(*) AS n FROM tok GROUP BY rid) SELECT rid, CAST(least(n + 1, 6) AS INTEGER) AS chosen, CAST(least(n + 2, 6) AS INTEGER) AS rejected, 6 AS width FROM g")(
    lambda spark, d: D.preference_pair(_ids(spark, d).select("rid", F.col("ids").alias("prompt_ids"), F.array(F.lit(9)).alias("chosen_ids"), F.array(F.lit(7)).alias("rejected_ids")), 6, 9).select(
        "rid", *[F.aggregate(F.col("pair")[i]["mask"], F.lit(0), lambda s, x: s + x).alias(n) for i, n in enumerate(("chosen", "rejected"))], F.size(F.col("pair")[0]["ids"]).alias("width")
    )
)
query("unpadded_ids", f"WITH {TOK_SQL}, g AS (SELECT rid, list(t ORDER BY t) AS ids, sum(m) AS n, count(*) AS c FROM tok GROUP BY rid) SELECT rid, coalesce(array_to_string(ids[c - n + 1 : c], ','), '') AS s, CAST(n AS BIGINT) AS tail FROM g")(
    lambda spark, d: _ids(spark, d).select("rid", F.array_join(F.transform(A.without_pad("ids", "mask"), lambda x: x.cast("string")), ",").alias("s"), F.size(D.response_slice("ids", "mask")).alias("_n"), F.aggregate("mask", F.lit(0), lambda s, x: s + x).cast("long").alias("tail")).drop("_n")
)
query("padded_responses", f"WITH {TOK_SQL} SELECT rid, round(sum(CASE WHEN t > 1 THEN r ELSE 0 END), 6) + 0.0 AS total, 20 AS width FROM tok GROUP BY rid")(
    lambda spark, d: trajectories(spark, d).select(F.col("row_idx").alias("rid"), D.padded_response(F.col("rewards"), F.lit(2), F.greatest(F.size("rewards") - 1, F.lit(0)), 20).alias("p")).select("rid", r(A.total("p")).alias("total"), F.size("p").alias("width"))
)
query("rows_without_ids", f"WITH {TOK_SQL} SELECT rid, CAST(sum(CASE WHEN t % 3 <> 0 THEN t ELSE 0 END) AS BIGINT) AS total, 20 AS width FROM tok GROUP BY rid")(
    lambda spark, d: _ids(spark, d).select("rid", D.without_ids(F.col("ids"), list(range(3, 60, 3)), 20, 0).alias("x")).select("rid", F.aggregate("x", F.lit(0), lambda s, x: s + x).cast("long").alias("total"), F.size("x").alias("width"))
)

_PAD = "WITH {t}, g AS (SELECT rid, list(t ORDER BY t) AS ids, count(*) AS n FROM tok GROUP BY rid)".replace("{t}", TOK_SQL)


def _ids(spark, d):
    t = trajectories(spark, d)
    return t.select(F.col("row_idx").alias("rid"), F.transform("mask", lambda m, i: i + 1).alias("ids"), "mask")


query("pad_left", _PAD + " SELECT rid, array_to_string(list_concat(list_resize([]::BIGINT[], (SELECT max(n) FROM g) + 2 - n, 0), ids), ',') AS s FROM g")(
    lambda spark, d: (lambda i: i.select("rid", F.array_join(F.transform(A.fit_length("ids", i.agg(F.max(F.size("ids"))).first()[0] + 2, 0), lambda x: x.cast("string")), ",").alias("s")))(_ids(spark, d))
)
for _side, _expr in (("left", "ids[n - 3 : n]"), ("right", "ids[1 : 4]"), ("middle", "list_concat(ids[1 : 2], ids[n - 1 : n])")):
    query(f"truncate_{_side}", _PAD + f" SELECT rid, array_to_string(CASE WHEN n > 4 THEN {_expr} ELSE list_concat(ids, list_resize([]::BIGINT[], greatest(4 - n, 0), 0)) END, ',') AS s FROM g")(
        lambda spark, d, side=_side: _ids(spark, d).select("rid", F.array_join(F.transform(A.fit_length("ids", 4, 0, left_pad=False, truncation=side), lambda x: x.cast("string")), ",").alias("s"))
    )
query("valid_tokens", f"WITH {TOK_SQL} SELECT rid, coalesce(string_agg(CAST(t AS VARCHAR), ',' ORDER BY t) FILTER (WHERE m = 1), '') AS s FROM tok GROUP BY rid")(
    lambda spark, d: _ids(spark, d).select("rid", F.array_join(F.transform(A.keep_valid("ids", "mask"), lambda x: x.cast("string")), ",").alias("s"))
)
query("position_ids", f"WITH {TOK_SQL}, p AS (SELECT rid, t, greatest(sum(m) OVER (PARTITION BY rid ORDER BY t) - 1, 0) AS p FROM tok) SELECT rid, string_agg(CAST(CAST(p AS INTEGER) AS VARCHAR), ',' ORDER BY t) AS s FROM p GROUP BY rid")(
    lambda spark, d: _ids(spark, d).select("rid", F.array_join(F.transform(A.position_ids("mask"), lambda x: x.cast("string")), ",").alias("s"))
)
query("eos_mask", f"WITH {TOK_SQL}, f AS (SELECT rid, min(t) FILTER (WHERE m = 0) AS e FROM tok GROUP BY rid) SELECT rid, CAST(sum(CASE WHEN e IS NULL OR t <= e THEN 1 ELSE 0 END) AS BIGINT) AS n FROM tok JOIN f USING (rid) GROUP BY rid")(
    lambda spark, d: _ids(spark, d).select("rid", F.aggregate(A.eos_mask("mask", 0), F.lit(0), lambda s, x: s + x).cast("long").alias("n"))
)
query("score_at_last_token", f"WITH {TOK_SQL} SELECT rid, CAST(sum(m) AS BIGINT) AS at, round(sum(r), 6) + 0.0 AS score FROM tok GROUP BY rid HAVING sum(m) > 0")(
    lambda spark, d: trajectories(spark, d).withColumn("s", A.total("rewards")).where(A.count_mask("mask") > 0).withColumn("p", A.place_last("mask", "s")).select(F.col("row_idx").alias("rid"), A.count_mask("mask").cast("long").alias("at"), r(F.element_at("p", A.count_mask("mask").cast("int"))).alias("score"))
)

# ---- scoring

_PUNCTUATED = "translate(lower(text), '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', '')"
#: Articles between non-letters, taken out twice as neighbours share an edge.
_ARTICLES = "'(^|[^\\p{L}\\p{Nd}_])(a|an|the)([^\\p{L}\\p{Nd}_]|$)', '\\1 \\3', 'g'"
_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace({_PUNCTUATED}, {_ARTICLES}), {_ARTICLES}), '\\s+', ' ', 'g'))"
query("qa_normalised", f"SELECT item_id, md5({_NORM}) AS h FROM benchmark")(
    lambda spark, d: table(spark, d, "benchmark").select("item_id", F.md5(X.normal_answer(F.col("text"))).alias("h"))
)
query("qa_exact_match", "WITH p AS (SELECT a.item_id, b.item_id AS other, a.text AS t, b.text AS u FROM benchmark a JOIN benchmark b ON abs(a.item_id - b.item_id) <= 1) SELECT item_id, other, CAST(CASE WHEN item_id = other OR t = u THEN 1 ELSE 0 END AS INTEGER) AS em, CAST(CASE WHEN item_id = other OR t = u THEN 1 ELSE 0 END AS INTEGER) AS sub FROM p")(
    lambda spark, d: (lambda a, b: a.join(b, F.abs(F.col("item_id") - F.col("other")) <= 1).select("item_id", "other", X.exact_match(F.upper("t"), F.array("u")).alias("em"), X.contained_match(F.concat(F.col("t"), F.lit("!")), F.array("u")).alias("sub")))(
        table(spark, d, "benchmark").select("item_id", F.col("text").alias("t")), table(spark, d, "benchmark").select(F.col("item_id").alias("other"), F.col("text").alias("u"))
    )
)
query("number_extraction", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS strict, CAST(o_orderkey AS VARCHAR) AS flexible, CASE WHEN o_custkey % 2 = 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM orders")(
    lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("so #### "), F.format_number("o_custkey", 0), F.lit(" and "), F.col("o_orderkey")).alias("t"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey").cast("string")).otherwise("x").alias("g")).select(
        "o_orderkey", X.final_number(F.col("t")).alias("strict"), X.final_number(F.col("t"), "flexible").alias("flexible"), X.number_score(F.col("t"), F.col("g"), format_score=0.1).alias("score")
    )
)
query("tagged_answers", "SELECT c_custkey, c_mktsegment AS answer, CASE WHEN c_custkey % 5 = 0 THEN 0.0 WHEN c_nationkey > 12 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, NULL, 0.0 FROM customer WHERE c_custkey % 5 = 0")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("none")).otherwise(F.concat(F.lit("<answer>x</answer> then <answer>\n "), F.col("c_mktsegment"), F.lit(" </answer>"))).alias("t"), F.when(F.col("c_nationkey") > 12, F.lower("c_mktsegment")).otherwise("zz").alias("g")).select(
        "c_custkey", F.trim(F.regexp_replace(X.tagged_answer(F.col("t")), "\n", "")).alias("answer"), X.answer_score(F.regexp_replace("t", "\n", ""), F.array("g")).alias("score")
    )
)
query("tool_calls", "SELECT event_id, event_type AS name, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, 1 AS n, 'call done' AS rest FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", F.concat(F.lit("call <tool_call>{\"name\": \""), F.col("event_type"), F.lit("\", \"arguments\": "), F.col("props"), F.lit("}</tool_call><tool_call>{bad</tool_call>done")).alias("t")).select("event_id", X.tool_calls(F.col("t")).alias("c"), X.without_tool_calls(F.col("t")).alias("rest")).select(
        "event_id", F.col("c")[0]["name"].alias("name"), F.col("c")[0]["arguments"]["k"].alias("k"), F.size("c").alias("n"), "rest"
    )
)
query("minerva_answers", "SELECT c_custkey, c_name AS answer FROM customer")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", X.minerva_answer(F.concat(F.lit("ANSWER: no\nso answer : "), F.col("c_name"), F.lit("\nend"))).alias("answer"))
)
query(
    "box_iou",
    "WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity AS x, l_quantity + l_discount * 100 AS x2, l_linenumber::DOUBLE AS y, l_linenumber + 5.0 AS y2 FROM lineitem), i AS (SELECT *, greatest(least(x2, 30) - greatest(x, 10), 0) * greatest(least(y2, 8) - greatest(y, 2), 0) AS inter, greatest(x2 - x, 0) * greatest(y2 - y, 0) + 120.0 AS areas FROM b) SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(CASE WHEN areas - inter > 0 THEN inter / (areas - inter) ELSE 0 END, 6) + 0.0 AS iou FROM i",
)(
    lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", r(X.box_iou(F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.col("l_quantity") + F.col("l_discount") * 100, F.col("l_linenumber") + 5.0), F.array(F.lit(10.0), F.lit(2.0), F.lit(30.0), F.lit(8.0)))).alias("iou"))
)
query("close_numbers", "SELECT p_partkey, p_size % 3 <> 0 OR p_size % 3 = 0 AND false AS eq FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.answers_equal(F.col("p_retailprice").cast("string"), F.when(F.col("p_size") % 3 == 0, F.lit("-1")).when(F.col("p_size") % 3 == 1, (F.col("p_retailprice") * 1.00005).cast("string")).otherwise((F.col("p_retailprice") * 100).cast("string"))).alias("eq"))
)
query("overlong_penalty", "SELECT doc_id, round(least(-(n_chars - (2000 - 500)) / 500.0 * 1.0, 0), 6) + 0.0 AS penalty FROM documents")(
    lambda spark, d: table(spark, d, "documents").select("doc_id", r(X.overlong_penalty(F.col("n_chars"), 2000, 500, 1.0)).alias("penalty"))
)
query("unshaped_accuracy", "WITH a AS (SELECT p_partkey, least(greatest((p_retailprice / 2000 - 0.1 * (p_size % 2)) / 0.9, 0), 1) AS a FROM part) SELECT p_partkey, round(CASE WHEN abs(a) < 1e-6 THEN 0 WHEN abs(a - 1) < 1e-6 THEN 1 ELSE a END, 6) + 0.0 AS acc FROM a")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", r(X.unshaped_accuracy(F.col("p_retailprice") / 2000, F.col("p_size") % 2, 0.1)).alias("acc"))
)
_COMPLETION = "' ' || text || ' [title] end  [edit] of [it'"
query("completion_text", f"SELECT item_id, replace(regexp_replace(replace(trim({_COMPLETION}), ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS t FROM benchmark")(
    lambda spark, d: table(spark, d, "benchmark").select("item_id", X.completion_text(F.concat(F.lit(" "), F.col("text"), F.lit(" [title] end  [edit] of [it"))).alias("t"))
)
query(
    "final_answers",
    "SELECT p_partkey, CAST(p_size AS VARCHAR) AS normal, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS score, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE -1.0 END::DOUBLE AS strict FROM part",
)(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.concat(F.lit("x = \\text{"), F.col("p_size"), F.lit("} cm^\\circ")).alias("a"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("none").alias("g")).select(
        "p_partkey", X.final_answer_normal(F.col("a")).alias("normal"), X.final_answer_score(F.concat(F.lit("first\nAnswer: "), F.col("a")), F.col("g")).alias("score"), X.final_answer_score(F.concat(F.lit("so \\boxed{"), F.regexp_extract("a", r"(\d+)", 1), F.lit("}")), F.col("g"), strict_box=True).alias("strict")
    )
)
query("channel_tool_calls", "SELECT event_id, event_type AS name, props AS arguments, 1 AS n, 'ab' AS content FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", X.channel_tool_calls(F.concat(F.lit("a<|channel|>analysis<|message|>hm<|end|><|start|>assistant<|channel|>commentary to=functions."), F.col("event_type"), F.lit(" <|constrain|>json<|message|>"), F.col("props"), F.lit("<|call|>b"))).alias("c")).select(
        "event_id", F.col("c.calls")[0]["name"].alias("name"), F.col("c.calls")[0]["arguments"].alias("arguments"), F.size("c.calls").alias("n"), "c.content"
    )
)
query("scores_by_source", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.score_by_source(F.when(F.col("p_partkey") % 2 == 0, "numbers").otherwise("answers"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#### "), F.col("p_size"))).otherwise(F.concat(F.lit("<answer>"), F.col("p_size"), F.lit("</answer>"))), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise("none"), ["numbers", "answers"]).alias("score"))
)
query("boxed_answers", "SELECT p_partkey, '\\frac{' || p_size || '}{2}' AS answer, 1.0::DOUBLE AS score FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", F.concat(F.lit("so \\boxed{\\frac{"), F.col("p_size"), F.lit("}{2}}.")).alias("t"), F.concat(F.lit("\\dfrac{"), F.col("p_size"), F.lit("}{2}")).alias("g")).select("p_partkey", X.boxed_answer(F.col("t")).alias("answer"), X.boxed_score(F.col("t"), F.col("g")).alias("score"))
)
query("tool_rewards", "WITH p AS (SELECT event_id, value, coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0.0) AS before FROM events) SELECT event_id, CASE WHEN value > before THEN 0.0 ELSE -0.05 END::DOUBLE AS reward FROM p")(
    lambda spark, d: table(spark, d, "events").withColumn("before", F.coalesce(F.lag("value").over(__import__("pyspark.sql.window", fromlist=["Window"]).Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0.0))).select("event_id", F.when(F.col("value") > F.col("before"), 0.0).otherwise(-0.05).alias("reward"))
)
query("html_titles", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")(lambda spark, d: table(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")))

# ---- logs

query("reward_counts", "SELECT user_id AS idx, count(*) AS total, CAST(sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM events GROUP BY user_id")(
    lambda spark, d: S.reward_counts(table(spark, d, "events").select(F.lit(None).cast("long").alias("sample_index"), F.col("user_id").alias("index"), F.col("value").alias("reward")), 50.0)
)
query("merged_counts", "SELECT user_id AS idx, CAST(2 * count(*) AS BIGINT) AS total, CAST(2 * sum(CASE WHEN value >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS correct FROM events GROUP BY user_id")(
    lambda spark, d: (lambda c: S.merged_counts([c, c]))(S.reward_counts(table(spark, d, "events").select(F.col("user_id").alias("index"), F.col("value").alias("reward")), 50.0))
)
query("dump_rows", f"WITH {TOK_SQL} SELECT 'p' || rid AS input, 'r' || rid AS output, uid AS gts, round(sum(r), 6) + 0.0 AS score, 3 AS step FROM tok JOIN traj USING (rid) GROUP BY rid, uid")(
    lambda spark, d: rounded(S.dump_rows(trajectories(spark, d).select(F.concat(F.lit("p"), "row_idx").alias("input"), F.concat(F.lit("r"), "row_idx").alias("output"), F.col("uid").alias("gts"), F.col("rewards").alias("token_scores"), F.lit(3).alias("step"))), "score")
)
query("rescored_runs", "SELECT event_type AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS step, round(avg(value / 100), 6) + 0.0 AS acc, count(*) AS n FROM events GROUP BY ALL")(
    lambda spark, d: rounded(S.rescored(table(spark, d, "events").select(F.col("event_type").alias("run"), F.datediff("ts", F.lit("2024-01-01")).alias("step"), "value"), ["run", "step"], F.col("value") / 100), "acc")
)
query("masked_lines", "SELECT item_id, replace(replace(text, 'the', '*'), 'and', '*') AS text FROM benchmark")(lambda spark, d: S.masked_lines(table(spark, d, "benchmark"), "text", ["the", "and"]).select("item_id", "text"))

# ---- balancing

query("workload", "SELECT doc_id, CAST(24576 * n_chars + n_chars * n_chars AS BIGINT) AS w FROM documents")(lambda spark, d: table(spark, d, "documents").select("doc_id", P.workload(F.col("n_chars")).alias("w")))


def _batches(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("b"), F.col("o_orderkey").alias("row_idx"), F.round(F.col("o_totalprice") / 100).cast("long").alias("length"))


def _global_batches(spark, d):
    """About a thousand rows a batch, as a training step has."""
    return _batches(spark, d).withColumn("b", F.floor(F.col("row_idx") / 1024))


query("balanced_partitions")(lambda spark, d: P.partitioned(_global_batches(spark, d), ["b"], "length", 4))
query("greedy_partitions")(lambda spark, d: P.partitioned(_global_batches(spark, d), ["b"], "length", 4, method="greedy"))
query("micro_batches")(lambda spark, d: P.micro_batches(_global_batches(spark, d), ["b"], "length", 200_000))


@query(
    "partition_imbalance",
    "WITH o AS (SELECT o_custkey AS b, o_orderkey AS row_idx, CAST(round(o_totalprice / 100) AS BIGINT) AS w, CAST(o_orderkey % 3 AS INTEGER) AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), x AS (SELECT b, i * 3 // n AS c, sum(w) AS s FROM o GROUP BY ALL), y AS (SELECT b, part, sum(w) AS s FROM o GROUP BY ALL), p AS (SELECT b, min(s)::BIGINT AS min_before, max(s)::BIGINT AS max_before, round(avg(s), 6) + 0.0 AS mean_before FROM x GROUP BY b), q AS (SELECT b, min(s)::BIGINT AS min_after, max(s)::BIGINT AS max_after, round(avg(s), 6) + 0.0 AS mean_after FROM y GROUP BY b) SELECT * FROM p JOIN q USING (b)",
)
def _(spark, d):
    b = _batches(spark, d).withColumn("part", (F.col("row_idx") % 3).cast("int"))
    return rounded(P.imbalance(b, ["b"], "length", 3), "mean_before", "mean_after")


@query(
    "bubble_order",
    "WITH o AS (SELECT o_custkey AS b, CAST(o_orderkey AS BIGINT) AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY round(o_totalprice / 100) DESC, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT b, part, CAST(CASE WHEN k % 2 = 0 THEN (n + 1) // 2 - 1 - k // 2 ELSE (n + 1) // 2 + (k - 1) // 2 END AS INTEGER) AS place FROM o",
)
def _(spark, d):
    return P.bubble_order(_batches(spark, d).withColumnRenamed("row_idx", "part"), ["b"], "length").select("b", "part", "place")


@query(
    "rank_order",
    "WITH o AS (SELECT o_custkey AS b, o_orderkey AS row_idx, o_orderkey % 2 AS part, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 2 ORDER BY round(o_totalprice / 100), o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey, o_orderkey % 2) AS n FROM orders) SELECT b, row_idx, CAST(CASE WHEN k % 2 = 0 THEN k // 2 ELSE n - 1 - (k - 1) // 2 END AS INTEGER) AS place FROM o",
)
def _(spark, d):
    return P.rank_order(_batches(spark, d).withColumn("part", F.col("row_idx") % 2), ["b"], "length").select("b", "row_idx", "place")


query("sticky_servers")(lambda spark, d: table(spark, d, "events").select("event_id", P.sticky_server(F.col("user_id"), 4).alias("server")))
query("first_rows", "SELECT o_custkey, min(o_orderkey) AS row_idx FROM orders GROUP BY o_custkey ORDER BY 2 LIMIT 32")(
    lambda spark, d: L.first_per_key(table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("row_idx")), "o_custkey")
)
query("packed_tokens", f"WITH {TOK_SQL}, g AS (SELECT rid AS row_idx, count(*) AS n FROM tok GROUP BY rid), t AS (SELECT sum(n) AS s, max(row_idx) + 1 AS r FROM g) SELECT row_idx, CAST(n AS INTEGER) AS n FROM g UNION ALL SELECT r, CAST(4096 - s % 4096 AS INTEGER) FROM t WHERE s % 4096 > 0")(
    lambda spark, d: D.packed_to_multiple(trajectories(spark, d).select("row_idx", F.col("mask").alias("ids")), "ids", 4096).select("row_idx", F.size("ids").alias("n"))
)
query("rollout_rows", f"WITH {TOK_SQL}, g AS (SELECT rid, count(*) AS n, sum(m) AS v FROM tok GROUP BY rid) SELECT rid, 20 AS width, CAST(n + 1 AS INTEGER) AS valid, CAST(v AS INTEGER) AS generated, CAST(n AS INTEGER) AS last_position FROM g")(
    lambda spark, d: trajectories(spark, d).select(F.col("row_idx").alias("rid"), *D.rollout_row(F.array(F.lit(7)), F.transform("mask", lambda _, i: i + 1), 4, 16, response_mask="mask")).select("rid", F.size("input_ids").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda s, x: s + x).alias("valid"), F.aggregate("response_mask", F.lit(0), lambda s, x: s + x).alias("generated"), F.array_max("position_ids").alias("last_position"))
)
query("open_answers", "SELECT c_custkey, 1.0::DOUBLE AS either, true AS same FROM customer")(
    lambda spark, d: table(spark, d, "customer").select("c_custkey", X.either_contains(F.concat(F.lit("It is "), "c_mktsegment"), F.lower("c_mktsegment")).alias("either"), X.equal_without_punctuation(F.concat(F.col("c_name"), F.lit("!")), F.regexp_replace(F.upper("c_name"), "#", " - ")).alias("same"))
)
query("scored_by_function", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size::DOUBLE ELSE -1.0 END AS score FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.scored_by(lambda a, b: float(a) if int(a) % 2 == 0 else 1 / 0, F.col("p_size").cast("string"), F.lit(""), on_error=-1.0).alias("score"))
)
query("run_on_ranks", f"WITH {POS_SQL} SELECT row_idx, c_acctbal * 2 AS x FROM pos")(
    lambda spark, d: B.run_on_ranks(positions(spark, d).select("row_idx", "c_acctbal"), "one_to_all", 3, lambda t: t.select("row_idx", "rank", (F.col("c_acctbal") * 2).alias("x")))
)

# ---- loaders and row forms

query("prompt_scan", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) <= 150")(
    lambda spark, d: S.prompts(spark, f"{d}/documents.parquet", key="doc_id", most_tokens=150, prompt="text").select("doc_id")
)
query("conversation_scan", "SELECT conv_id, turn, text AS messages, CAST(NULL AS VARCHAR) AS tools FROM conversations")(
    lambda spark, d: S.conversations(spark, f"{d}/conversations.parquet", messages="text", key="conv_id").select("conv_id", "turn", "messages", "tools")
)
query("appended_rows", "SELECT doc_id AS id, lang AS tag FROM documents UNION ALL SELECT item_id, NULL FROM benchmark WHERE length(text) <= 60")(
    lambda spark, d: S.appended(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("tag")), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), F.length("text"), 60).select("id", "tag")
)
query("labelled_rows", "SELECT doc_id, lang AS label FROM documents WHERE length(lang) > 0")(lambda spark, d: D.labelled_only(table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))))
query("lifted_defaults", "SELECT doc_id AS dataset_idx, n_chars AS idx, '{}' AS tools, '{}' AS interaction FROM documents")(
    lambda spark, d: D.with_defaults(table(spark, d, "documents").select(F.col("doc_id").alias("row_idx"), F.struct(F.col("n_chars").alias("index")).alias("extra_info"))).select("dataset_idx", F.col("index").alias("idx"), F.col("tools_kwargs").alias("tools"), F.col("interaction_kwargs").alias("interaction"))
)
query("response_lengths", f"WITH {TOK_SQL} SELECT rid, 3.0::DOUBLE AS prompt_length, sum(m)::DOUBLE AS response_length FROM tok GROUP BY rid")(
    lambda spark, d: Q.response_info(trajectories(spark, d).select(F.col("row_idx").alias("rid"), F.concat(F.array_repeat(F.lit(1), 3), "mask").alias("attention_mask"), F.col("rewards").alias("responses"))).select("rid", "prompt_length", "response_length")
)
query("generation_columns", f"WITH {POS_SQL} SELECT row_idx, c_name, c_mktsegment, c_acctbal FROM pos")(
    lambda spark, d: (lambda made, rest: made.join(rest, "row_idx"))(*J.split_columns(positions(spark, d).select("row_idx", "c_name", "c_mktsegment", "c_acctbal"), ["c_name", "c_mktsegment"]))
)
query("join_lookup", "SELECT o_orderkey, o_custkey AS idx, c_name FROM orders JOIN customer ON c_custkey = o_custkey")(
    lambda spark, d: J.lookup(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("idx")), table(spark, d, "customer").select(F.col("c_custkey").alias("idx"), "c_name"), "idx")
)
query("format_rewards", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM part")(
    lambda spark, d: table(spark, d, "part").select("p_partkey", X.formatted(F.concat(F.when(F.col("p_size") % 2 == 0, "<think>a\nb</think>").otherwise("<think>"), F.lit("\nso \\boxed{"), F.col("p_size"), F.lit("}"))).alias("reward"))
)
