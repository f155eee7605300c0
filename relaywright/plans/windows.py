"""Window logic: timelines, fair order, windowed rates, continuous conditions, contiguous offsets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relaywright.operators.core import islands
from relaywright.plans.registry import query
from relaywright.sources import domain as D
from relaywright.sources.domain import sql


@query("W1_stage_timeline", sql("SELECT event_id, message_id, date_diff('millisecond', lag(occurred_at) OVER w, occurred_at) AS duration_ms, date_diff('millisecond', min(occurred_at) OVER (PARTITION BY message_id), max(occurred_at) OVER (PARTITION BY message_id)) AS total_ms FROM se WINDOW w AS (PARTITION BY message_id ORDER BY occurred_at, event_id)", "se"))
def stage_timeline(spark, d):
    w = Window.partitionBy("message_id")
    t = F.unix_millis(F.col("occurred_at").cast("timestamp"))
    rows = D.stage_events(spark, d).withColumn("t", t)
    return rows.select("event_id", "message_id", (F.col("t") - F.lag("t").over(w.orderBy("occurred_at", "event_id"))).alias("duration_ms"), (F.max("t").over(w) - F.min("t").over(w)).alias("total_ms"))


@query("W4_fair_order", "SELECT event_id, row_number() OVER (ORDER BY k, first_seen, user_id) AS position FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, min(ts) OVER (PARTITION BY user_id) AS first_seen FROM events WHERE event_type = 'click')")
def fair_order(spark, d):
    """Round robin over the keys, in the order that they first appear.

    A position is the rows of the rounds before, those of the own round whose keys appeared in an earlier hour, and the place among
    the rest. Rounds are summed in spans of 10,000, so that no window is wider than a span, the hours of a round, or an hour's new keys.
    """
    w = Window.partitionBy("user_id")
    held = D.table(spark, d, "events").filter("event_type = 'click'").select("event_id", "user_id", F.row_number().over(w.orderBy("ts", "event_id")).alias("k"), F.min("ts").over(w).alias("first_seen"))
    held = held.withColumn("hour", F.date_trunc("hour", "first_seen"))
    earlier = lambda of, by: F.coalesce(F.sum("n").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = held.groupBy("k", "hour").agg(F.count(F.lit(1)).alias("n")).withColumn("span", F.floor(F.col("k") / 10_000))
    rounds = hours.groupBy("span", "k").agg(F.sum("n").alias("n"))
    spans = rounds.groupBy("span").agg(F.sum("n").alias("n")).select("span", earlier([], "span").alias("before_span"))
    before = rounds.select("span", "k", earlier(["span"], "k").alias("before_round")).join(spans, "span")
    starts = hours.select("k", "hour", earlier(["k"], "hour").alias("before_hour")).join(before, "k").select("k", "hour", (F.col("before_span") + F.col("before_round") + F.col("before_hour")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("k", "hour").orderBy("first_seen", "user_id"))
    return held.withColumn("inside", inside).join(starts, ["k", "hour"]).select("event_id", (F.col("before") + F.col("inside")).alias("position"))


@query("W5_five_minute_rates", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS slot, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)::DOUBLE AS error_share FROM events GROUP BY 1")
def five_minute_rates(spark, d):
    e = D.table(spark, d, "events").groupBy(F.window("ts", "5 minutes").alias("w"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_share")).select(F.col("w.start").alias("slot"), "n", "error_share")


@query("W6_condition_held", "WITH m AS (SELECT date_trunc('hour', ts) AS t, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) > 0.2 AS bad FROM events GROUP BY 1), g AS (SELECT t, bad, sum(c) OVER (ORDER BY t) AS island FROM (SELECT t, bad, CASE WHEN lag(bad) OVER (ORDER BY t) = bad THEN 0 ELSE 1 END AS c FROM m)) SELECT min(t) AS begins, max(t) AS ends, count(*) AS ticks FROM g WHERE bad GROUP BY island HAVING count(*) >= 3")
def condition_held(spark, d):
    """Spells of three or more consecutive ticks over the limit; the ticks are one row an hour at any scale."""
    share = F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0))
    ticks = D.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg((share > 0.2).alias("bad"))
    runs = islands(ticks.withColumn("series", F.lit(0)), ["series"], "t", "bad").filter("bad")
    return runs.groupBy("island").agg(F.min("t").alias("begins"), F.max("t").alias("ends"), F.count(F.lit(1)).alias("ticks")).filter("ticks >= 3").drop("island")


#: Offsets that are looked at together.
_SPAN = 1_000


@query("W8_contiguous_watermark", "SELECT p AS partition_id, coalesce(max(o) FILTER (WHERE o = rn - 1), -1) AS watermark FROM (SELECT event_id % 8 AS p, event_id // 8 AS o, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id // 8) AS rn FROM events WHERE event_id // 8 <> 37 + 170 * (event_id % 8)) GROUP BY 1")
def contiguous_watermark(spark, d):
    """The last offset before the first gap. Spans that are complete are skipped by their counts; only the first one that isn't is gone through."""
    e = D.table(spark, d, "events")
    done = e.select((F.col("event_id") % 8).alias("partition_id"), F.expr("event_id div 8").alias("o")).filter(F.col("o") != 37 + 170 * F.col("partition_id"))
    done = done.withColumn("span", F.floor(F.col("o") / _SPAN))
    spans = done.groupBy("partition_id", "span").agg(F.count(F.lit(1)).alias("n"))
    ordered = spans.withColumn("k", F.row_number().over(Window.partitionBy("partition_id").orderBy("span")) - 1)
    whole = F.count_if((F.col("n") == _SPAN) & (F.col("span") == F.col("k")))
    stops = F.min(F.when((F.col("n") < _SPAN) | (F.col("span") != F.col("k")), F.col("k")))
    first = ordered.groupBy("partition_id").agg(F.coalesce(stops, whole).alias("span"))  # the span that isn't complete, or the one after the last
    rest = done.join(first, ["partition_id", "span"]).withColumn("rn", F.row_number().over(Window.partitionBy("partition_id", "span").orderBy("o")))
    reached = rest.filter(F.col("o") == F.col("span") * _SPAN + F.col("rn") - 1).groupBy("partition_id").agg(F.max("o").alias("reached"))
    return first.join(reached, "partition_id", "left").select("partition_id", F.coalesce("reached", F.col("span") * _SPAN - 1).alias("watermark"))


@query("W10_session_gaps", "SELECT user_id, min(ts) AS begins, count(*) AS n FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, s")
def session_gaps(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = D.table(spark, d, "events").withColumn("c", F.when(F.col("ts") - F.lag("ts").over(w) < F.expr("INTERVAL 2 HOURS"), 0).otherwise(1))
    return e.withColumn("s", F.sum("c").over(w)).groupBy("user_id", "s").agg(F.min("ts").alias("begins"), F.count(F.lit(1)).alias("n")).drop("s")
