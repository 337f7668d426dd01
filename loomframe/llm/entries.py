"""Registered queries of this subpackage."""

from __future__ import annotations

from . import decontam, flac, htmlmain, langid, licenses, linkgraph, mixing, quality, setsketch, surrogate
from .common import read

QUERIES = {
    "op1_near_duplicates": lambda spark, d: setsketch.digest(read(spark, d, "documents")),
    "op2_mixing": lambda spark, d: mixing.digest(read(spark, d, "documents")),
    "op3_language_id": lambda spark, d: langid.digest(read(spark, d, "documents")),
    "op4_decontamination": lambda spark, d: decontam.digest(read(spark, d, "documents"), read(spark, d, "benchmark")),
    "op5_url_filter": lambda spark, d: linkgraph.digest(read(spark, d, "pages")),
    "op6_pii_surrogates": lambda spark, d: surrogate.digest(read(spark, d, "documents")),
    "op7_license_scan": lambda spark, d: licenses.digest(read(spark, d, "documents")),
    "op8_media_columns": lambda spark, d: flac.digest(read(spark, d, "documents")),
    "op9_html_main_text": lambda spark, d: htmlmain.digest(read(spark, d, "pages")),
    "op10_quality": lambda spark, d: quality.digest(read(spark, d, "documents"), read(spark, d, "labels")),
}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED, _ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLE_SQL: dict[str, str] = {
    "op1_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_SPACED}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      WHERE 100 * least(na.n, nb.n) >= 85 * greatest(na.n, nb.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(na.n) + any_value(nb.n) - count(*))),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS root FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(root, doc_id), doc_id) AS component_id, coalesce(root, doc_id) >= doc_id AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v))),
h AS (SELECT doc_id, i, p.k, item_id FROM p JOIN v ON v.s = p.s AND v.k = p.k),
x AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN t USING (doc_id)""",
}
