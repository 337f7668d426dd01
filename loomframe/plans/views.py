"""Relations of the data plane, derived from the star-schema tables; every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can say it, its DuckDB twin."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


TOKEN = {
    "m": "CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END",
    "r": "l_discount + 0.0D",
    "v": "l_tax + 0.0D",
    "olp": "-(l_discount + 0.01D) * 10",
    "rlp": "-(l_tax + 0.01D) * 10",
    "refp": "-l_quantity / 50",
    "lp": "-(l_discount * 0.8D + l_tax * 0.2D + 0.01D) * 10",
    "a": "(l_extendedprice - 35000) / 20000",
}
TOK_SQL = (
    "tok AS (SELECT l_orderkey AS rid, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS t, "
    + ", ".join(f"{v.replace('D)', ')').replace('D *', ' *').replace('0.0D', '0.0').replace('D +', ' +')} AS {k}" for k, v in TOKEN.items())
    + " FROM lineitem), traj AS (SELECT o_orderkey AS rid, o_custkey AS uid FROM orders)"
)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Long form: rid, t from 1, and the token columns."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("rid"), F.row_number().over(w).alias("t"), *[F.expr(e).alias(k) for k, e in TOKEN.items()])


NAMES = {"m": "mask", "r": "rewards", "v": "values", "olp": "old_lp", "rlp": "rollout_lp", "refp": "ref_lp", "lp": "lp", "a": "advantages"}


def trajectories(spark: SparkSession, d: str, empty: bool = False) -> DataFrame:
    """Array form: row_idx, uid and token arrays; `empty` keeps orders without lines as aborted rows."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *[F.expr(e).alias(k) for k, e in TOKEN.items()])
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_extendedprice", *TOKEN))).alias("z"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("pred"))
    j = o.join(g, F.col("row_idx") == F.col("l_orderkey"), "left" if empty else "inner")
    get = lambda k: F.coalesce(F.col(f"z.{k}"), F.array().cast("array<int>" if k == "m" else "array<double>"))
    return j.select("row_idx", "uid", "source", "pred", *[get(k).alias(n) for k, n in NAMES.items()])


def long(df: DataFrame, *cols: str) -> DataFrame:
    """rid, t from 1, and the arrays' entries."""
    return df.select(F.col("row_idx").alias("rid"), F.posexplode(F.arrays_zip(*cols)).alias("t", "z")).select("rid", (F.col("t") + 1).alias("t"), *[f"z.{c}" for c in cols])


def rollouts(spark: SparkSession, d: str) -> DataFrame:
    """One scored row per line: row key columns, uid, score, length."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_orderkey").alias("uid"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").alias("length"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """A batch with row_idx 0..n-1: customers, whose keys are dense."""
    return table(spark, d, "customer").select((F.col("c_custkey") - F.lit(first_key(spark, d))).alias("row_idx"), "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")


def first_key(spark: SparkSession, d: str) -> int:
    return table(spark, d, "customer").agg(F.min("c_custkey")).first()[0] or 0


POS_SQL = "pos AS (SELECT c_custkey - (SELECT min(c_custkey) FROM customer) AS row_idx, c_name, c_acctbal, c_mktsegment, c_nationkey FROM customer)"
