"""Aggregations: merge-on-read, reports, money, latest rows, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywright.operators.core import latest
from relaywright.plans.registry import query
from relaywright.sources import domain as D
from relaywright.sources.domain import sql

_FINAL = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY occurred_at, event_id, message_id ORDER BY ingested_at DESC) AS rn FROM red) WHERE rn = 1)"


def merged(rows: DataFrame) -> DataFrame:
    """Merge-on-read: the row ingested last for each key."""
    return latest(rows, ["occurred_at", "event_id", "message_id"], [F.desc("ingested_at")])


def hour(column: str):
    return F.date_trunc("hour", column).cast("timestamp_ntz")


@query("A1_merge_on_read", sql(f"SELECT event_id, message_id, occurred_at, ingested_at FROM {_FINAL}", "se", "red"))
def merge_on_read(spark, d):
    return merged(D.redelivered(spark, d)).select("event_id", "message_id", "occurred_at", "ingested_at")


@query("A1b_pdu_dedup", "SELECT ts, user_id, seq, event_type, direction FROM (SELECT *, row_number() OVER (PARTITION BY ts, user_id, seq, event_type ORDER BY event_id DESC, direction DESC) AS rn FROM (SELECT date_trunc('hour', ts) AS ts, user_id, event_id % 3 AS seq, event_type, event_id, CASE WHEN event_id % 2 = 0 THEN 'IN' ELSE 'OUT' END AS direction FROM events)) WHERE rn = 1")
def pdu_dedup(spark, d):
    """The key leaves direction and message out: different PDUs with equal keys collapse, as they do in the stored table."""
    rows = D.table(spark, d, "events").select(hour("ts").alias("ts"), "user_id", (F.col("event_id") % 3).alias("seq"), "event_type", "event_id", F.when(F.col("event_id") % 2 == 0, "IN").otherwise("OUT").alias("direction"))
    return latest(rows, ["ts", "user_id", "seq", "event_type"], [F.desc("event_id"), F.desc("direction")]).drop("event_id")


@query("A2_hourly_stage_report", sql(f"SELECT date_trunc('hour', occurred_at) AS hour, partner_id, stage_name, outcome, count(*) AS n FROM {_FINAL} GROUP BY ALL ORDER BY 1, 2, 3, 4", "se", "red"))
def hourly_stage_report(spark, d):
    return merged(D.redelivered(spark, d)).groupBy(hour("occurred_at").alias("hour"), "partner_id", "stage_name", "outcome").agg(F.count(F.lit(1)).alias("n")).orderBy("hour", "partner_id", "stage_name", "outcome")


@query("A3_partner_report", sql(f"SELECT date_trunc('hour', occurred_at) AS hour, stage_name, outcome, count(*) AS n FROM {_FINAL} WHERE partner_id = 'p4' GROUP BY ALL", "se", "red"))
def partner_report(spark, d):
    rows = D.redelivered(spark, d).filter("partner_id = 'p4'")  # before the shuffle of the merge
    return merged(rows).groupBy(hour("occurred_at").alias("hour"), "stage_name", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("A4_hourly_view_undeduplicated", sql("SELECT date_trunc('hour', occurred_at) AS hour, partner_id, stage_name, outcome, count(*) AS n FROM red GROUP BY ALL", "se", "red"))
def hourly_view(spark, d):
    return D.redelivered(spark, d).groupBy(hour("occurred_at").alias("hour"), "partner_id", "stage_name", "outcome").agg(F.count(F.lit(1)).alias("n"))


def _net(rows: DataFrame) -> DataFrame:
    money = lambda c: c.cast("decimal(18,4)").cast("string")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("entry_type") == kind, F.col("amount"))), F.lit(0).cast("decimal(18,4)"))
    return rows.agg(of("charge").alias("c"), of("compensating").alias("k"), F.count(F.lit(1)).alias("n")).select("key", money(F.col("c")).alias("charged"), money(F.col("k")).alias("compensated"), money(F.col("c") - F.col("k")).alias("net"), "n")


_NET = "CAST(coalesce(sum(amount) FILTER (WHERE entry_type = 'charge'), 0) AS DECIMAL(18,4))::VARCHAR AS charged, CAST(coalesce(sum(amount) FILTER (WHERE entry_type = 'compensating'), 0) AS DECIMAL(18,4))::VARCHAR AS compensated, CAST(coalesce(sum(amount) FILTER (WHERE entry_type = 'charge'), 0) - coalesce(sum(amount) FILTER (WHERE entry_type = 'compensating'), 0) AS DECIMAL(18,4))::VARCHAR AS net, count(*) AS n"


@query("A5_ledger_by_partner", sql(f"SELECT partner_id::VARCHAR AS key, {_NET} FROM lg GROUP BY 1", "lg"))
def ledger_by_partner(spark, d):
    return _net(D.ledger(spark, d).groupBy(F.col("partner_id").cast("string").alias("key")))


@query("A5_ledger_by_day", sql(f"SELECT strftime(created_at, '%Y-%m-%d') AS key, {_NET} FROM lg GROUP BY 1", "lg"))
def ledger_by_day(spark, d):
    return _net(D.ledger(spark, d).groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("key")))


@query("A6_spend_by_currency", sql("SELECT currency, CAST(sum(CASE WHEN entry_type = 'charge' THEN amount ELSE -amount END) AS DECIMAL(18,4))::VARCHAR AS spend FROM lg WHERE partner_id = 9 GROUP BY 1", "lg"))
def spend_by_currency(spark, d):
    signed = F.when(F.col("entry_type") == "charge", F.col("amount")).otherwise(-F.col("amount"))
    return D.ledger(spark, d).filter("partner_id = 9").groupBy("currency").agg(F.sum(signed).cast("decimal(18,4)").cast("string").alias("spend"))


_BALANCE = "SELECT account_id, sum(CASE WHEN entry_type = 'compensating' THEN amount ELSE -amount END) * 100 AS b FROM lg GROUP BY 1"


def _balances(spark, d):
    signed = F.when(F.col("entry_type") == "compensating", F.col("amount")).otherwise(-F.col("amount"))
    return D.ledger(spark, d).groupBy("account_id").agg((F.sum(signed) * 100).alias("b"))


@query("A7_balance_minor_units", sql(f"SELECT account_id, CAST(trunc(b) AS BIGINT) AS minor_units, b = trunc(b) AS exact FROM ({_BALANCE})", "lg"))
def balance_minor_units(spark, d):
    whole = F.col("b").cast("long")
    return _balances(spark, d).select("account_id", whole.alias("minor_units"), (F.col("b") == whole).alias("exact"))


@query("A8_drift_class", sql(f"SELECT account_id, drift, CASE WHEN abs(drift) = 0 THEN 'NONE' WHEN abs(drift) < 100 THEN 'LOW' WHEN abs(drift) < 10000 THEN 'MEDIUM' ELSE 'HIGH' END AS severity, abs(drift) >= 10000 AS freeze FROM (SELECT account_id, (account_id % 4) * (account_id % 4) * (account_id % 4) * (account_id % 97) * 7 AS drift FROM ({_BALANCE}))", "lg"))
def drift_class(spark, d):
    k = F.col("account_id") % 4
    ledger_units = F.col("b").cast("long")
    stored = ledger_units + k * k * k * (F.col("account_id") % 97) * 7  # what the store holds
    drift = F.abs("drift")
    rows = _balances(spark, d).select("account_id", (stored - ledger_units).alias("drift"))
    return rows.select("account_id", "drift", F.when(drift == 0, "NONE").when(drift < 100, "LOW").when(drift < 10000, "MEDIUM").otherwise("HIGH").alias("severity"), (drift >= 10000).alias("freeze"))


@query("A9_unread_count", sql("SELECT partner_id, count(*) AS unread FROM chat WHERE NOT is_read GROUP BY 1", "chat"))
def unread_count(spark, d):
    return D.chats(spark, d).filter("NOT is_read").groupBy("partner_id").agg(F.count(F.lit(1)).alias("unread"))


@query("A10_next_version", sql("SELECT e.entity_type, coalesce(max(c.version), 0) + 1 AS next_version FROM (SELECT DISTINCT entity_type FROM cfg) e LEFT JOIN (SELECT * FROM cfg WHERE version < 20 AND id % 17 = 0) c USING (entity_type) GROUP BY 1", "cfg"))
def next_version(spark, d):
    rows = D.configs(spark, d)
    top = F.max(F.when((F.col("version") < 20) & (F.col("id") % 17 == 0), F.col("version")))
    return rows.groupBy("entity_type").agg((F.coalesce(top, F.lit(0)) + 1).alias("next_version"))


@query("A11_latest_per_key", sql("SELECT DISTINCT ON (entity_type, entity_id) entity_type, entity_id, id, payload FROM cfg ORDER BY entity_type, entity_id, id DESC", "cfg"))
def latest_per_key(spark, d):
    return latest(D.configs(spark, d), ["entity_type", "entity_id"], [F.desc("id")]).select("entity_type", "entity_id", "id", "payload")


@query("A12_array_without_nulls", sql("SELECT entity_type, coalesce(array_agg(CASE WHEN version > 25 THEN id END ORDER BY id) FILTER (WHERE version > 25), []) AS ids FROM cfg GROUP BY 1", "cfg"))
def array_without_nulls(spark, d):
    return D.configs(spark, d).groupBy("entity_type").agg(F.array_sort(F.collect_list(F.when(F.col("version") > 25, F.col("id")))).alias("ids"))


@query("A13_consent_sets", sql("SELECT entity_type AS key, array_agg(DISTINCT entity_id ORDER BY entity_id) AS scopes FROM cfg WHERE status = 'active' AND version % 5 = 0 GROUP BY 1", "cfg"))
def consent_sets(spark, d):
    return D.configs(spark, d).filter("status = 'active' AND version % 5 = 0").groupBy(F.col("entity_type").alias("key")).agg(F.array_sort(F.collect_set("entity_id")).alias("scopes"))


@query("A14_nearest_rank_p95", "SELECT user_id, CASE WHEN count(*) >= 20 THEN list_sort(array_agg(value))[CAST(ceil(0.95 * count(*)) AS BIGINT)] END AS p95 FROM events GROUP BY 1")
def nearest_rank_p95(spark, d):
    """Exact and without collecting a group: the value at the rank, from a window."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = D.table(spark, d, "events").select("user_id", "value", F.row_number().over(w.orderBy("value", "event_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n"))
    at = F.when((F.col("n") >= 20) & (F.col("k") == F.ceil(F.lit(0.95) * F.col("n"))), F.col("value"))
    return e.groupBy("user_id").agg(F.max(at).alias("p95"))


@query("A15_stage_latency", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY 1")
def stage_latency(spark, d):
    """Exact, without a task that sees all values of a stage: counts by bucket of values find the bucket of each rank, and only that one is gone through."""
    from pyspark.sql import Window

    ranks = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    counts = D.table(spark, d, "events").groupBy("event_type", "value").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", F.floor(F.col("value") * 4))
    by_bucket = counts.groupBy("event_type", "bucket").agg(F.sum("n").alias("held"))
    w = Window.partitionBy("event_type").orderBy("bucket")
    by_bucket = by_bucket.withColumn("upto", F.sum("held").over(w)).withColumn("total", F.sum("held").over(Window.partitionBy("event_type")))
    wanted = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.ceil(F.col("total") * p).alias("rank")) for k, p in ranks.items())))
    asked = by_bucket.select("event_type", "bucket", (F.col("upto") - F.col("held")).alias("before"), "upto", wanted.alias("q")).filter((F.col("q.rank") > F.col("before")) & (F.col("q.rank") <= F.col("upto")))
    inside = counts.join(asked.select("event_type", "bucket", "before", "q.name", "q.rank"), ["event_type", "bucket"])
    running = F.sum("n").over(Window.partitionBy("event_type", "name").orderBy("value"))
    found = inside.withColumn("reached", F.col("before") + running).filter(F.col("reached") >= F.col("rank"))
    return found.groupBy("event_type").pivot("name", list(ranks)).agg(F.min("value"))


@query("A15b_stage_latency_approx")
def stage_latency_approx(spark, d):
    return D.table(spark, d, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 10_000).alias("quantiles"))


@query("A17_error_share", "SELECT date_trunc('hour', ts) AS tick, CASE WHEN sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN event_type = 'error' AND value > 5 THEN 1 ELSE 0 END)::DOUBLE / sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) END AS share FROM events GROUP BY 1")
def error_share(spark, d):
    some = F.when(F.col("value") > 5, 1).otherwise(0)
    errors = F.when((F.col("event_type") == "error") & (F.col("value") > 5), 1).otherwise(0)
    return D.table(spark, d, "events").groupBy(hour("ts").alias("tick")).agg(F.try_divide(F.sum(errors), F.sum(some)).alias("share"))


@query("A18_effective_scope", "SELECT c_nationkey AS scope, min(c_acctbal) AS rate, max(CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END) AS severity FROM customer GROUP BY 1")
def effective_scope(spark, d):
    severity = F.when(F.col("c_mktsegment") == "BUILDING", 2).when(F.col("c_mktsegment") == "MACHINERY", 1).otherwise(0)
    return D.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("scope")).agg(F.min("c_acctbal").alias("rate"), F.max(severity).alias("severity"))


@query("A19_max_offset", "SELECT user_id % 16 AS partition_id, max(event_id) AS last_offset FROM events GROUP BY 1")
def max_offset(spark, d):
    return D.table(spark, d, "events").groupBy((F.col("user_id") % 16).alias("partition_id")).agg(F.max("event_id").alias("last_offset"))


@query("A20_drain_count", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS slot, user_id % 50 AS partner_id, user_id % 3 AS application_id, count(*) AS consumed FROM events GROUP BY ALL")
def drain_count(spark, d):
    e = D.table(spark, d, "events")
    rows = e.groupBy(F.window("ts", "1 hour").alias("w"), (F.col("user_id") % 50).alias("partner_id"), (F.col("user_id") % 3).alias("application_id")).agg(F.count(F.lit(1)).alias("consumed"))
    return rows.select(F.col("w.start").alias("slot"), "partner_id", "application_id", "consumed")


@query("A21_counter_delta", "SELECT tick, tier, n, n - coalesce(lag(n) OVER (PARTITION BY tier ORDER BY tick), 0) AS delta FROM (SELECT tick, tier, sum(k) OVER (PARTITION BY tier ORDER BY tick)::BIGINT AS n FROM (SELECT date_trunc('day', ts) AS tick, event_type AS tier, count(*) AS k FROM events GROUP BY ALL))")
def counter_delta(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("tier").orderBy("tick")
    k = D.table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("tick"), F.col("event_type").alias("tier")).agg(F.count(F.lit(1)).alias("k"))
    scraped = k.withColumn("n", F.sum("k").over(w))
    return scraped.select("tick", "tier", "n", (F.col("n") - F.coalesce(F.lag("n").over(w), F.lit(0))).alias("delta"))


@query("A16_lag_totals", "SELECT user_id % 6 AS group_id, sum(event_id % 31)::BIGINT AS total_lag, coalesce(array_agg(event_id % 31 ORDER BY event_id % 31) FILTER (WHERE event_id % 500 = 0), []) AS sampled FROM events GROUP BY 1")
def lag_totals(spark, d):
    lag = F.col("event_id") % 31
    return D.table(spark, d, "events").groupBy((F.col("user_id") % 6).alias("group_id")).agg(F.sum(lag).alias("total_lag"), F.array_sort(F.collect_list(F.when(F.col("event_id") % 500 == 0, lag))).alias("sampled"))
