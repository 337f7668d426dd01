"""URL filters by link-graph propagation, in DataFrame functions only.

Hosts and their parent domains of two labels and more are nodes; an absolute link of a page is an edge from the page's host to the
link's host, and every host is tied both ways to its parent domain.
Trust is a personalised PageRank over the edges from hosts that rules allow;
distrust is one over the reversed edges from hosts that rules block.  A page that no
rule fits gets its host's verdict: block if distrust is at least
`threshold` times trust plus `floor`.

Rounds go on until no further one can change a verdict: the mass still to move is bounded by
the last change, and a host whose two ranks differ by more is settled, as is one that no seed reaches.  They end as well when at most
`LEFT` of the mass is left to move (40 rounds at the most), so a host whose ranks differ by less may be judged either way.

Defined cases: a null url, or one without "://", has an empty host and path, fits
no rule and is allowed unless the empty host is distrusted (it never is);
repeated pages are judged alike; null html has no links; a host without parent or links keeps its own seeds; an empty table gives an empty
result; extra columns are ignored.  Pages are read once: hosts, paths, rules and linked hosts are checkpointed without the
html.  Edges are counted per pair of hosts before any join.  Hosts with more than a thousandth of all pages or edges are fewer than
a thousand; they are met by broadcast, so that no host gathers its rows in one task.  Ranks and edges are never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, in_tasks

#: (verdict, host, path), as the contract gives them.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING, THRESHOLD, FLOOR = 0.85, 1.0, 1e-9
#: Rounds between checkpoints, and the share of rows beyond which a host is a hub (above the least number).
STEP, HUBS, HUB = 6, 1_000, 1_000
#: Share of the mass that may be left to move when rounds end.
LEFT = 0.02
_LINK = r"""(?is)\bhref\s*=\s*["']?[a-z][a-z0-9+.\-]*://([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=None) -> Column:
    """The longest fitting rule as struct(verdict, rule); null if none fits."""
    rules = sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2]))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in reversed(rules):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight between different hosts, from pages(host, linked): links, and ties to parent domains."""
    links = (
        pages.select(F.col("host").alias("src"), F.explode("linked").alias("dst"))
        .where("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )
    hosts = pages.where("host != ''").select("host").distinct().union(links.select("src")).union(links.select("dst")).distinct()
    # a host and all its parents: numbers and names without a dot have none
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    named = hosts.where((F.size(labels) > 2) & ~F.col("host").rlike(r"^[0-9.]+(:\d+)?$|\.\.|^\.|\.$"))
    ties = named.select(F.explode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("a"), F.slice(chain, 2, F.size(chain) - 1).alias("b"))).alias("z")).select("z.a", "z.b").distinct()
    both = ties.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(ties.select("b", "a"))
    return links.unionByName(both.withColumn("weight", F.lit(1.0))).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _hubs(df: DataFrame, key: str, total: int) -> DataFrame:
    """Values of the key on more than a share of all rows: fewer than HUBS rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HUB, total // HUBS)).select(key)


def _met(rows: DataFrame, ranks: DataFrame, key: str, hubs: DataFrame | None, how: str = "inner") -> DataFrame:
    """rows with the columns of ranks(key, ...); those of hubs are broadcast and their rows stay where they are."""
    if hubs is None:
        return rows.join(ranks, key, how)
    some = F.broadcast(hubs.withColumn("_hub", F.lit(True)))
    told = rows.join(some, key, "left")
    few = F.broadcast(ranks.join(F.broadcast(hubs), key))
    return told.where("_hub").drop("_hub").join(few, key, how).unionByName(told.where("_hub is null").drop("_hub").join(ranks, key, how))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, threshold: float = THRESHOLD, floor: float = FLOOR, rounds: int | None = None, hub: int | None = None, least: float = LEFT) -> DataFrame:
    """host, trust, distrust: personalised PageRanks from seeds(host, good, bad), distrust against the edges.

    Mass at dead ends returns to nobody; hosts without rank are absent.  A round is one join and one sum with map-side combine for both
    ranks; STEP rounds are one job.  Without `rounds` they go on until every verdict is settled or at most `least` of the mass is left to move.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("all"))
    ahead = edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("all")).alias("f"), F.lit(0.0).alias("g"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("all"))
    back = edges.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0.0).alias("f"), (F.col("weight") / F.col("all")).alias("g"))
    most = 2 * edges.count()
    share = cut(ahead.unionByName(back).groupBy("src", "dst").agg(F.sum("f").alias("f"), F.sum("g").alias("g")), most)
    n = share.count()
    total = seeds.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    start = seeds.select("host", (F.col("good") / F.lit(total["good"] or 1.0)).alias("t"), (F.col("bad") / F.lit(total["bad"] or 1.0)).alias("d"))
    start = cut(start.withColumns({"t": F.coalesce("t", F.lit(0.0)), "d": F.coalesce("d", F.lit(0.0))}), seeds.count())
    hubs = cut(_hubs(share, "src", n) if hub is None else share.groupBy("src").count().where(F.col("count") > hub).select("src"), n)
    hubs = None if hubs.isEmpty() else hubs
    rank, seen, done = start, -1, 0
    while n and (rounds is None or done < rounds):
        before = rank
        for _ in range(STEP if rounds is None else min(STEP, rounds - done)):
            before = rank
            here = rank.select(F.col("host").alias("src"), "t", "d")
            # every host with a rank is a seed or the end of an edge, so tasks need be no more than those rows ask for
            moved = _met(share, here, "src", hubs).select(F.col("dst").alias("host"), (F.col("f") * F.col("t") * damping).alias("t"), (F.col("g") * F.col("d") * damping).alias("d"))
            given = start.select("host", (F.col("t") * (1 - damping)).alias("t"), (F.col("d") * (1 - damping)).alias("d"))
            rank = in_tasks(in_tasks(moved, n).unionByName(given).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), n)
            done += 1
        # both rounds in one table, so that the change is seen without another pass
        both = rank.select("host", "t", "d", F.lit(0.0).alias("t0"), F.lit(0.0).alias("d0")).unionByName(before.select("host", F.lit(0.0).alias("t"), F.lit(0.0).alias("d"), F.col("t").alias("t0"), F.col("d").alias("d0")))
        both = cut(both.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("t", "d", "t0", "d0")]), n)
        rank = both.select("host", "t", "d")
        if rounds is not None:
            continue
        left = damping / (1 - damping)
        moving = both.agg(F.sum(F.abs(F.col("t") - F.col("t0"))).alias("t"), F.sum(F.abs(F.col("d") - F.col("d0"))).alias("d"), F.count(F.lit(1)).alias("n")).first()
        slack = left * (moving["t"] * threshold + moving["d"])
        gap = F.abs(F.col("d") - threshold * F.col("t") - floor)
        if slack <= least or moving["n"] == seen and rank.where(gap <= slack).isEmpty():
            break
        seen = moving["n"]
    return rank.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))


def judge(pages: DataFrame, rules=None, threshold: float = THRESHOLD, floor: float = FLOOR) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    linked = F.array_distinct(F.transform(F.coalesce(F.regexp_extract_all("html", F.lit(_LINK), 1), F.array().cast("array<string>")), ascii_lower))
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), linked.alias("linked"))
    p = cut(p.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)))
    hosts = cut(p.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("fit.verdict") == "allow").cast("double")).alias("good"), F.sum((F.col("fit.verdict") == "block").cast("double")).alias("bad")))
    seeds = hosts.where("host != '' and (good > 0 or bad > 0)").select("host", "good", "bad")
    edges = host_edges(p.select("host", "linked"))
    scores = propagate(cut(edges), seeds, threshold=threshold, floor=floor)
    total = hosts.agg(F.sum("n")).first()[0] or 0
    hubs = hosts.where(F.col("n") > max(HUB, total // HUBS)).select("host")
    judged = _met(p.drop("linked"), scores, "host", hubs, "left").fillna(0.0, ["trust", "distrust"])
    own = F.when(F.col("distrust") >= F.col("trust") * threshold + floor, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "trust", "distrust")


def digest(pages: DataFrame) -> DataFrame:
    return judge(pages)
