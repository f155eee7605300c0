"""Messaging tables as projections of the base tables: DataFrames, and the same in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(column: Column, values: dict[str, str], default: str) -> Column:
    """A value by key, with a default for keys that aren't known and for null."""
    known = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(known, column), F.lit(default))


STAGES = {"view": "DESTINATION_RESOLUTION", "click": "POLICY", "signup": "BILLING", "purchase": "ROUTING", "error": "DELIVERY"}
STATUSES = {"O": "SUBMITTED", "P": "DELIVERY_UNRESOLVED", "F": "DELIVERED"}


def to_millis(ts: Column) -> Column:
    """Milliseconds are what the stored tables keep."""
    return F.date_trunc("millisecond", ts).cast("timestamp_ntz")


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.col("value")
    return e.select(
        "event_id",
        F.col("user_id").alias("message_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("partner_id"),
        lookup(F.col("event_type"), STAGES, "UNSPECIFIED").alias("stage_name"),
        F.when(value < 10, "REJECTED").when(value < 20, "FAILED").otherwise("SUCCEEDED").alias("outcome"),
        to_millis(F.col("ts")).alias("occurred_at"),
        to_millis(F.col("ts")).alias("ingested_at"),
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage events with every seventh delivered again 5 s later."""
    deliveries = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    rows = stage_events(spark, sf_dir).withColumn("_later", F.explode(deliveries))
    return rows.withColumn("ingested_at", F.col("ingested_at") + F.make_dt_interval(secs=F.col("_later").cast("decimal(18,6)"))).drop("_later")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("account_id"),
        F.col("l_suppkey").alias("partner_id"),
        F.col("l_extendedprice").cast(T.DecimalType(18, 4)).alias("amount"),
        F.when(F.col("l_returnflag") == "R", "compensating").otherwise("charge").alias("entry_type"),
        F.element_at(F.array(F.lit("UZS"), F.lit("USD"), F.lit("EUR")), (F.col("o_custkey") % 3 + 1).cast("int")).alias("currency"),
        F.col("l_shipdate").alias("created_at"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("message_id"),
        (F.col("o_custkey") % 50).alias("partner_id"),
        lookup(F.col("o_orderstatus"), STATUSES, "UNSPECIFIED").alias("current_status"),
        (F.col("o_orderstatus") == "F").alias("terminal"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 5 + 1).alias("lifecycle_version"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("partner_id"),
        F.when(F.col("role") == "user", "partner").otherwise("admin").alias("sender_type"),
        F.col("text").alias("body"),
        "turn",
        (F.col("turn") % 2 == 0).alias("is_read"),
    )


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("entity_type"),
        F.col("p_type").alias("entity_id"),
        F.col("p_size").alias("version"),
        F.when(F.col("p_partkey") % 11 == 0, "archived").otherwise("active").alias("status"),
        F.col("p_name").alias("payload"),
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static ranges of 100 numbers with gaps, and overlays of 40 that come first."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    static = c.filter(key % 5 != 0).select((key * 100).alias("range_start"), (key * 100 + 99).alias("range_end"), F.concat(F.lit("op"), (F.col("c_nationkey") % 4).cast("string")).alias("operator_id"), (key + 1_000_000).alias("position"))
    over = c.filter(key % 9 == 0).select((key * 100 + 20).alias("range_start"), (key * 100 + 59).alias("range_end"), F.concat(F.lit("dyn"), (F.col("c_nationkey") % 3).cast("string")).alias("operator_id"), key.alias("position"))
    return static.unionByName(over)


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers to look up; some aren't numeric."""
    n = (F.col("o_orderkey") * 7919) % 160_000
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), F.when(F.col("o_orderkey") % 41 == 0, F.concat(F.lit("x"), n.cast("string"))).otherwise(n.cast("string")).alias("msisdn"))


def ported(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").filter(F.col("c_custkey") % 37 == 0)
    return c.select((F.col("c_custkey") * 100 + 7).cast("string").alias("msisdn"), F.lit("ported").alias("operator_id"))


SQL = {
    "se": """se AS (SELECT event_id, user_id AS message_id, 'p' || (user_id % 10)::VARCHAR AS partner_id,
      CASE event_type WHEN 'view' THEN 'DESTINATION_RESOLUTION' WHEN 'click' THEN 'POLICY' WHEN 'signup' THEN 'BILLING' WHEN 'purchase' THEN 'ROUTING' WHEN 'error' THEN 'DELIVERY' ELSE 'UNSPECIFIED' END AS stage_name,
      CASE WHEN value < 10 THEN 'REJECTED' WHEN value < 20 THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome,
      date_trunc('millisecond', ts) AS occurred_at, date_trunc('millisecond', ts) AS ingested_at FROM events)""",
    "red": """red AS (SELECT * FROM se UNION ALL SELECT event_id, message_id, partner_id, stage_name, outcome, occurred_at, ingested_at + INTERVAL 5 SECOND FROM se WHERE event_id % 7 = 0)""",
    "lg": """lg AS (SELECT o_custkey AS account_id, l_suppkey AS partner_id, CAST(l_extendedprice AS DECIMAL(18,4)) AS amount,
      CASE WHEN l_returnflag = 'R' THEN 'compensating' ELSE 'charge' END AS entry_type,
      CASE o_custkey % 3 WHEN 0 THEN 'UZS' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency,
      l_shipdate AS created_at, l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "msg": """msg AS (SELECT o_orderkey AS message_id, o_custkey % 50 AS partner_id,
      CASE o_orderstatus WHEN 'O' THEN 'SUBMITTED' WHEN 'P' THEN 'DELIVERY_UNRESOLVED' WHEN 'F' THEN 'DELIVERED' ELSE 'UNSPECIFIED' END AS current_status,
      o_orderstatus = 'F' AS terminal, o_orderdate AS created_at, o_orderkey % 5 + 1 AS lifecycle_version, o_orderpriority AS priority, o_totalprice AS price FROM orders)""",
    "chat": """chat AS (SELECT conv_id * 1000 + turn AS id, conv_id AS partner_id, CASE WHEN role = 'user' THEN 'partner' ELSE 'admin' END AS sender_type, text AS body, turn, turn % 2 = 0 AS is_read FROM conversations)""",
    "cfg": """cfg AS (SELECT p_partkey AS id, p_brand AS entity_type, p_type AS entity_id, p_size AS version, CASE WHEN p_partkey % 11 = 0 THEN 'archived' ELSE 'active' END AS status, p_name AS payload FROM part)""",
    "rg": """rg AS (SELECT c_custkey * 100 AS range_start, c_custkey * 100 + 99 AS range_end, 'op' || (c_nationkey % 4)::VARCHAR AS operator_id, c_custkey + 1000000 AS position FROM customer WHERE c_custkey % 5 <> 0
      UNION ALL SELECT c_custkey * 100 + 20, c_custkey * 100 + 59, 'dyn' || (c_nationkey % 3)::VARCHAR, c_custkey FROM customer WHERE c_custkey % 9 = 0)""",
    "num": """num AS (SELECT o_orderkey AS message_id, CASE WHEN o_orderkey % 41 = 0 THEN 'x' ELSE '' END || ((o_orderkey * 7919) % 160000)::VARCHAR AS msisdn FROM orders)""",
    "por": """por AS (SELECT (c_custkey * 100 + 7)::VARCHAR AS msisdn, 'ported' AS operator_id FROM customer WHERE c_custkey % 37 = 0)""",
}


def sql(query: str, *names: str) -> str:
    """The query with the projections that it names, in the order that they build on each other."""
    return "WITH " + ", ".join(SQL[n] for n in names) + " " + query
