"""The register, and views over the given tables that play the roles of catalog, purchases and events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
NOW = "1999-06-01 00:00:00"
RATES = [("USD", 7.0), ("EUR", 7.5)]


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a catalog; every fourth product each is priced in USD and JPY, and JPY has no rate."""
    currency = F.expr("CASE p_partkey % 4 WHEN 2 THEN 'USD' WHEN 3 THEN 'JPY' ELSE 'CNY' END")
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.element_at(F.split("p_name", " "), -1).alias("sub_category"), F.col("p_retailprice").alias("base_price"), currency.alias("currency"),
        F.concat_ws(" ", F.lower("p_type"), F.lit("item of size"), F.col("p_size").cast("string")).alias("description"), F.col("p_size").alias("size"),
    )


CAT = """cat AS (SELECT p_partkey AS product_id, p_name AS title, p_brand AS brand, p_type AS category, split_part(p_name, ' ', -1) AS sub_category,
 p_retailprice AS base_price, CASE p_partkey % 4 WHEN 2 THEN 'USD' WHEN 3 THEN 'JPY' ELSE 'CNY' END AS currency,
 lower(p_type) || ' item of size ' || p_size AS description, p_size AS size FROM part)"""


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "currency string, rate double")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the cluster names in spark.checkpoint.dir, which all executors share. Without that setting the session must run on one machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or f"/tmp/spark-{uuid.uuid4().hex}")
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """A table of these rows beside the checkpoints, so that a long plan that uses them often computes them once."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_kept: dict = {}


def kept(spark: SparkSession, sf_dir: str, name: str, build):
    """What several queries over the same tables use (an index, vectors), built once in a session: build() of the first that asks."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = build()
    return _kept[key]


def line_id():
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey")


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as purchases: id, user_id, product_id, purchased_at, cycle_days (explicit for every fifth)."""
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(line_id().alias("id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("product_id"), F.col("o_orderdate").alias("purchased_at"), F.expr("CASE WHEN l_orderkey % 5 = 0 THEN 45 END").alias("cycle_days"))


PUR = """pur AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000000 + l_partkey * 1000 + l_suppkey AS id, o_custkey AS user_id, l_partkey AS product_id, o_orderdate AS purchased_at,
 CASE WHEN l_orderkey % 5 = 0 THEN 45 END AS cycle_days FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as likes and errors as dislikes of the product in props.k."""
    key = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").where("event_type in ('click', 'error')").select(F.col("event_id").alias("id"), "ts", "user_id", key.alias("product_id"), F.expr("CASE event_type WHEN 'click' THEN 1 ELSE -1 END").alias("signal"))


FB = """fb AS (SELECT event_id AS id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product_id,
 CASE event_type WHEN 'click' THEN 1 ELSE -1 END AS signal FROM events WHERE event_type IN ('click', 'error'))"""
