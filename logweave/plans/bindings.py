"""Log views over the driver's tables: events as a run log, users as branches of a fork tree, conversations as model turns."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_ms, tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """branch_id, seq, type, step_id, epoch, at_ms, cost_micros, body, event_id."""
    e = table(spark, sf_dir, "events")
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    same = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("branch_id"),
        (F.row_number().over(own) - 1).cast("bigint").alias("seq"),
        F.col("event_type").alias("type"),
        F.concat("event_type", F.lit("#"), F.row_number().over(same).cast("string")).alias("step_id"),
        (1 + F.count(F.when(F.col("event_type") == "signup", 1)).over(own)).alias("epoch"),
        epoch_ms("ts").alias("at_ms"),
        F.round(F.col("value") * 1000000).cast("bigint").alias("cost_micros"),
        F.col("props").alias("body"),
        "event_id",
    )


EVLOG = """evlog AS (SELECT user_id AS branch_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_type AS type,
  event_type || '#' || row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS step_id,
  1 + count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
  epoch_ns(ts) // 1000000 AS at_ms, CAST(round(value * 1000000) AS BIGINT) AS cost_micros, props AS body, event_id FROM events)"""


def branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """branch_id, parent_branch, fork_seq, created_at_ms: a binary tree of users, forked at differing places."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("ts"))
    forked = F.col("user_id") > 1
    return e.select(
        F.col("user_id").alias("branch_id"),
        F.when(forked, F.expr("user_id div 2")).alias("parent_branch"),
        F.when(forked, 1 + F.col("user_id") % 7).alias("fork_seq"),
        epoch_ms("ts").alias("created_at_ms"),
    )


BRANCHES = """branches AS (SELECT user_id AS branch_id, CASE WHEN user_id > 1 THEN user_id // 2 END AS parent_branch,
  CASE WHEN user_id > 1 THEN 1 + user_id % 7 END AS fork_seq, epoch_ns(min(ts)) // 1000000 AS created_at_ms FROM events GROUP BY user_id)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """branch_id, seq, role, text, tokens."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("branch_id"), F.col("turn").alias("seq"), "role", "text", tokens("text").alias("tokens"))


TURNS = "turns AS (SELECT conv_id AS branch_id, turn AS seq, role, text, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) AS tokens FROM conversations)"


def payments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as payments (payment, cents, status), lines as refunds (payment, line, part, supplier, cents)."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cents = lambda c: F.round(F.col(c) * 100).cast("bigint").alias("cents")
    return o.select(F.col("o_orderkey").alias("payment"), cents("o_totalprice"), F.col("o_orderstatus").alias("status")), line.select(
        F.col("l_orderkey").alias("payment"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), cents("l_extendedprice")
    )


PAYMENTS = """payments AS (SELECT o_orderkey AS payment, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderstatus AS status FROM orders),
refunds AS (SELECT l_orderkey AS payment, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"""


def with_views(*views: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(views)
