"""Queries with feedback: each row's result changes what the next row of its key meets.

Their SQL walks each key's rows one by one with a recursive CTE, so it shares no code and no shortcut with
the folds. The rows are made from base tables so that the borders of each rule are met.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from relaywright.operators import folds as S
from relaywright.plans.registry import query
from relaywright.sources import domain as D


def millis(column: str = "ts"):
    return F.unix_millis(F.col(column).cast("timestamp"))


def walk(source: str, key: str, order: str, seed: str, steps: list[str], state: str, out: str) -> str:
    """SQL that goes through the rows of `source` by `key` in `order`. `seed`: the first state; `steps`: selects that each add
    columns to row and state; `state`: the next state, in the columns of the seed; `out`: what is put out of the last step."""
    nested = "SELECT s.*, f.* EXCLUDE (key, k) FROM f JOIN src s ON s.key = f.key AND s.k = f.k + 1"
    for step in steps:
        nested = f"SELECT *, {step} FROM ({nested})"
    return f"WITH RECURSIVE src AS MATERIALIZED (SELECT *, {key} AS key, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS k FROM ({source})), f AS (SELECT DISTINCT key, 0::BIGINT AS k, {seed} FROM src UNION ALL SELECT key, k, {state} FROM ({nested})) SELECT {out} FROM f WHERE k > 0"


# lifecycle

_STATUS = "CASE event_type WHEN 'view' THEN 'SUBMITTED' WHEN 'purchase' THEN 'DELIVERED' WHEN 'error' THEN 'DELIVERY_UNRESOLVED' WHEN 'click' THEN 'LATE_DELIVERY_CONFIRMED' ELSE CASE WHEN value < 15 THEN 'UNDELIVERABLE' WHEN value < 30 THEN 'REJECTED' WHEN value < 60 THEN 'FAILED' ELSE 'SYSTEM_UNAVAILABLE' END END"
_MOVES = "'>SUBMITTED', '>REJECTED', '>FAILED', '>SYSTEM_UNAVAILABLE', '>DELIVERED', '>UNDELIVERABLE', '>DELIVERY_UNRESOLVED', 'SUBMITTED>DELIVERED', 'SUBMITTED>UNDELIVERABLE', 'DELIVERY_UNRESOLVED>LATE_DELIVERY_CONFIRMED'"
_LIFECYCLE = walk(
    f"SELECT event_id // 8 AS message_id, event_id, {_STATUS} AS next, ts, unnest(CASE WHEN event_id % 7 = 0 THEN [0, 1] ELSE [0] END) AS delivery FROM events",
    "message_id",
    "ts, event_id, delivery",
    "NULL::BIGINT AS event, NULL::VARCHAR AS status, 0 AS version, NULL::BIGINT AS last, '' AS verdict",
    [f"CASE WHEN event_id = last THEN 'DUPLICATE' WHEN (coalesce(status, '') || '>' || next) IN ({_MOVES}) THEN 'VALID' ELSE 'REGRESSION' END AS now"],
    "event_id, CASE WHEN now = 'VALID' THEN next ELSE status END, version + (now = 'VALID')::INTEGER, CASE WHEN now = 'VALID' THEN event_id ELSE last END, now",
    "key AS message_id, event AS event_id, verdict, status, version",
)


def lifecycle_events(spark, d):
    kind, value = F.col("event_type"), F.col("value")
    rest = F.when(value < 15, "UNDELIVERABLE").when(value < 30, "REJECTED").when(value < 60, "FAILED").otherwise("SYSTEM_UNAVAILABLE")
    status = F.when(kind == "view", "SUBMITTED").when(kind == "purchase", "DELIVERED").when(kind == "error", "DELIVERY_UNRESOLVED").when(kind == "click", "LATE_DELIVERY_CONFIRMED").otherwise(rest)
    deliveries = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return D.table(spark, d, "events").select(F.expr("event_id div 8").alias("message_id"), "event_id", status.alias("status"), "ts", F.explode(deliveries).alias("delivery"))


@query("T1_W10_lifecycle_fold", _LIFECYCLE)
def lifecycle_fold(spark, d):
    return S.ordered_fold(lifecycle_events(spark, d), ["message_id"], ["ts", "event_id", "delivery"], S.lifecycle_step, S.LIFECYCLE_SCHEMA)


# limits and buckets


@query(
    "W3_sliding_limit",
    walk(
        "SELECT user_id, event_id, epoch_ms(date_trunc('hour', ts)) AS t FROM events",
        "user_id",
        "t, event_id",
        "NULL::BIGINT AS event, []::BIGINT[] AS kept, false AS accepted",
        ["list_filter(kept, lambda x: x >= t - 86400000) AS now", "len(now) < 3 AS fits"],
        "event_id, CASE WHEN fits THEN list_append(now, t) ELSE now END, fits",
        "event AS event_id, accepted",
    ),
)
def sliding_limit(spark, d):
    """Whole hours, so that events stand exactly a window apart."""
    e = D.table(spark, d, "events").select("user_id", "event_id", F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("t"))
    return S.ordered_fold(e, ["user_id"], ["t", "event_id"], S.sliding_limit_step(3, 86_400_000), "event_id long, accepted boolean")


@query(
    "W9_token_bucket",
    walk(
        "SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, event_id % 4 + 1 AS wanted FROM events",
        "user_id",
        "t, event_id",
        "NULL::BIGINT AS event, 5::DOUBLE AS tokens, NULL::BIGINT AS since, 0::BIGINT AS granted",
        ["least(5::DOUBLE, tokens + coalesce(t - since, 0) / 1000::DOUBLE * 0.00005::DOUBLE) AS now", "least(wanted, floor(now)::BIGINT) AS grant_"],
        "event_id, now - grant_, t, grant_",
        "event AS event_id, granted, tokens",
    ),
)
def token_bucket(spark, d):
    e = D.table(spark, d, "events").select("user_id", "event_id", millis().alias("t"), (F.col("event_id") % 4 + 1).alias("wanted"))
    return S.ordered_fold(e, ["user_id"], ["t", "event_id"], S.token_bucket_step(5.0, 0.00005), "event_id long, granted long, tokens double")


_TICKS = "SELECT user_id // 8 AS series, date_diff('day', DATE '2024-01-01', ts::DATE) * 1000 AS t, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS high, count(*) FILTER (WHERE event_type = 'click') AS medium, count(*) FILTER (WHERE event_type IN ('view', 'signup')) AS low, (user_id // 8) % 8 + 6 AS permits FROM events GROUP BY ALL"


@query(
    "W9b_hierarchical_pacing",
    walk(
        _TICKS,
        "series",
        "t",
        "NULL::BIGINT AS since, 0::BIGINT AS wh, 0::BIGINT AS wm, 0::BIGINT AS wl, 12::DOUBLE AS c, greatest(12 * 0.7::DOUBLE * 0.15::DOUBLE, 1) AS h, greatest(12 * 0.2::DOUBLE * 0.15::DOUBLE, 1) AS m, greatest(12 * 0.1::DOUBLE * 0.15::DOUBLE, 1) AS l, 0::BIGINT AS gh, 0::BIGINT AS gm, 0::BIGINT AS gl",
        [
            "coalesce(t - since, 0) / 1000::DOUBLE AS s, wh + high AS qh, wm + medium AS qm, wl + low AS ql",
            "least(12::DOUBLE, c + s * 12) AS c0, least(greatest(12 * 0.7::DOUBLE * 0.15::DOUBLE, 1), h + s * (12 * 0.7::DOUBLE)) AS h0, least(greatest(12 * 0.2::DOUBLE * 0.15::DOUBLE, 1), m + s * (12 * 0.2::DOUBLE)) AS m0, least(greatest(12 * 0.1::DOUBLE * 0.15::DOUBLE, 1), l + s * (12 * 0.1::DOUBLE)) AS l0",
            "least(qh, permits, floor(h0)::BIGINT) AS ah",
            "least(qm, permits - ah, floor(m0)::BIGINT) AS am, c0 - least(ah, floor(c0)::BIGINT) AS c1",
            "least(ql, permits - ah - am, floor(l0)::BIGINT) AS al, c1 - least(am, floor(c1)::BIGINT) AS c2",
            "c2 - least(al, floor(c2)::BIGINT) AS c3, permits - ah - am - al AS p3",
            "least(qh - ah, p3, floor(c3)::BIGINT) AS bh",
            "c3 - bh AS c4, p3 - bh AS p4",
            "least(qm - am, p4, floor(c4)::BIGINT) AS bm",
            "c4 - bm AS c5, p4 - bm AS p5",
            "least(ql - al, p5, floor(c5)::BIGINT) AS bl",
        ],
        "t, qh - ah - bh, qm - am - bm, ql - al - bl, c5 - bl, h0 - ah, m0 - am, l0 - al, ah + bh, am + bm, al + bl",
        "key AS series, since AS t, gh AS high_granted, gm AS medium_granted, gl AS low_granted, wh + wm + wl AS waiting",
    ),
)
def hierarchical_pacing(spark, d):
    """Days stand for seconds: what isn't admitted on one waits for the next."""
    kind, series = F.col("event_type"), F.expr("user_id div 8")
    t = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long") * 1000
    ticks = D.table(spark, d, "events").groupBy(series.alias("series"), t.alias("t")).agg(F.count_if(kind.isin("purchase", "error")).alias("high"), F.count_if(kind == "click").alias("medium"), F.count_if(kind.isin("view", "signup")).alias("low"))
    return S.ordered_fold(ticks.withColumn("permits", F.col("series") % 8 + 6), ["series"], ["t"], S.pacing_step(12.0), "series long, t long, high_granted long, medium_granted long, low_granted long, waiting long")


# control loops

_SUGGEST = "CASE WHEN state = 'PAUSED' THEN CASE WHEN metric <= 0.5 THEN 'DEGRADED' ELSE 'PAUSED' END WHEN metric >= 0.8 THEN 'PAUSED' WHEN state = 'DEGRADED' THEN CASE WHEN metric <= 0.3 THEN 'ACTIVE' ELSE 'DEGRADED' END WHEN metric >= 0.5 THEN 'DEGRADED' ELSE 'ACTIVE' END"
#: Columns state, ticks, candidate and streak to n_state, n_ticks, n_candidate and n_streak.
_LOOP = [
    f"{_SUGGEST} AS wish",
    "wish <> state AS differs, CASE WHEN wish = candidate THEN streak + 1 ELSE 1 END AS run, CASE WHEN (wish, state) IN (('ACTIVE', 'DEGRADED'), ('DEGRADED', 'PAUSED')) THEN 2 ELSE 1 END AS need",
    "differs AND run >= need AND ticks + 1 >= 3 AS moves",
    "CASE WHEN moves THEN wish ELSE state END AS n_state, CASE WHEN moves THEN 0 ELSE ticks + 1 END AS n_ticks, CASE WHEN differs AND NOT moves THEN wish END AS n_candidate, CASE WHEN differs AND NOT moves THEN run ELSE 0 END AS n_streak",
]
#: Short windows, as the metric of these rows jumps from one to the next.
_THRESHOLDS = S.Thresholds(enter_window=1, exit_window=2, least_ticks=3)


@query(
    "W7_hysteresis",
    walk(
        "SELECT user_id AS scope, event_id AS tick, value / 100 AS metric FROM events",
        "scope",
        "tick",
        "NULL::BIGINT AS since, 'ACTIVE' AS state, 0 AS ticks, NULL::VARCHAR AS candidate, 0 AS streak, false AS changed",
        _LOOP,
        "tick, n_state, n_ticks, n_candidate, n_streak, moves",
        "key AS scope, since AS tick, state, changed",
    ),
)
def hysteresis(spark, d):
    e = D.table(spark, d, "events").select(F.col("user_id").alias("scope"), F.col("event_id").alias("tick"), (F.col("value") / 100).alias("metric"))
    return S.ordered_fold(e, ["scope"], ["tick"], S.hysteresis_step(_THRESHOLDS), "scope long, tick long, state string, changed boolean")


@query(
    "T20_override_registry",
    walk(
        "SELECT user_id AS scope, event_id, epoch_us(ts) // 1000 AS t, CASE event_id % 31 WHEN 7 THEN 'override' WHEN 13 THEN 'clear' ELSE 'evaluate' END AS kind, value / 100 AS metric, CASE WHEN event_id % 2 = 0 THEN 'PAUSED' ELSE 'DEGRADED' END AS o_state, 0.3::DOUBLE AS o_rate, CASE WHEN event_id % 3 > 0 THEN 172800000 END AS lasts FROM events",
        "scope",
        "t, event_id",
        "NULL::BIGINT AS event, '' AS did, 'ACTIVE' AS state, 0 AS ticks, NULL::VARCHAR AS candidate, 0 AS streak, 1::DOUBLE AS rate, 0::BIGINT AS version, NULL::VARCHAR AS last, NULL::VARCHAR AS forced, NULL::DOUBLE AS forced_rate, NULL::BIGINT AS until, NULL::VARCHAR AS shown, NULL::DOUBLE AS shown_rate",
        [
            "kind = 'evaluate' AS asks, forced IS NOT NULL AND (until IS NULL OR until > t) AS holds",
            *_LOOP,
            "asks AND NOT holds AS runs",
            "CASE n_state WHEN 'PAUSED' THEN 0::DOUBLE WHEN 'DEGRADED' THEN 0.05::DOUBLE ELSE coalesce(list_min(list_filter([0, 0.05, 0.1, 0.25, 0.5, 1]::DOUBLE[], lambda x: x > rate)), 1) END AS n_rate",
        ],
        "event_id, kind, CASE WHEN runs THEN n_state ELSE state END, CASE WHEN runs THEN n_ticks ELSE ticks END, CASE WHEN runs THEN n_candidate ELSE candidate END, CASE WHEN runs THEN n_streak ELSE streak END, CASE WHEN runs THEN n_rate ELSE rate END, version + (NOT asks OR runs AND n_state IS DISTINCT FROM last)::BIGINT, CASE WHEN runs THEN n_state ELSE last END, CASE WHEN kind = 'override' THEN o_state WHEN asks AND holds THEN forced END, CASE WHEN kind = 'override' THEN o_rate WHEN asks AND holds THEN forced_rate END, CASE WHEN kind = 'override' THEN t + lasts WHEN asks AND holds THEN until END, CASE WHEN asks THEN CASE WHEN holds THEN forced ELSE n_state END END, CASE WHEN asks THEN CASE WHEN holds THEN forced_rate ELSE n_rate END END",
        "key AS scope, event AS event_id, did AS kind, shown AS state, shown_rate AS rate, version",
    ),
)
def override_registry(spark, d):
    key = F.col("event_id")
    kind = F.when(key % 31 == 7, "override").when(key % 31 == 13, "clear").otherwise("evaluate")
    e = D.table(spark, d, "events").select(F.col("user_id").alias("scope"), "event_id", millis().alias("t"), kind.alias("kind"), (F.col("value") / 100).alias("metric"), F.when(key % 2 == 0, "PAUSED").otherwise("DEGRADED").alias("state"), F.lit(0.3).alias("rate"), F.when(key % 3 > 0, F.lit(172_800_000)).alias("lasts"))
    return S.ordered_fold(e, ["scope"], ["t", "event_id"], S.override_step(_THRESHOLDS), "scope long, event_id long, kind string, state string, rate double, version long")


# money

_ACCOUNT_ROWS = "SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY event_id) AS seen FROM (SELECT *, (kind <> 'charge' AND kind <> coalesce(last_value(CASE WHEN kind <> 'charge' THEN kind END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'unfreeze'))::BIGINT AS turn FROM (SELECT user_id, event_id, CASE event_id % 11 WHEN 3 THEN 'freeze' WHEN 6 THEN 'unfreeze' ELSE 'charge' END AS kind, event_id // 300 AS charge_id, round(value * 100)::BIGINT AS amount, event_id * 100 AS recomputed FROM events))"
_CHARGES = walk(
    f"SELECT *, CASE WHEN event_id % 23 = 0 THEN NULL ELSE seen - turn - (event_id % 17 = 0)::BIGINT END AS asked FROM ({_ACCOUNT_ROWS})",
    "user_id",
    "event_id",
    "NULL::BIGINT AS event, 0::BIGINT AS balance, 0::BIGINT AS epoch, false AS frozen, []::BIGINT[] AS applied, '' AS result, NULL::BIGINT AS outbox",
    [
        "asked IS NOT DISTINCT FROM epoch AS current",
        "CASE kind WHEN 'freeze' THEN CASE WHEN frozen THEN 'ALREADY_FROZEN' ELSE 'FROZEN' END WHEN 'unfreeze' THEN CASE WHEN NOT frozen THEN 'ALREADY_ACTIVE' WHEN NOT current THEN 'STALE_EPOCH' ELSE 'UNFROZEN' END ELSE CASE WHEN list_contains(applied, charge_id) THEN 'ALREADY_PROCESSED' WHEN NOT current THEN 'STALE_EPOCH' WHEN frozen THEN 'ACCOUNT_FROZEN' ELSE 'APPLIED' END END AS now",
    ],
    "event_id, CASE now WHEN 'APPLIED' THEN balance - amount WHEN 'UNFROZEN' THEN recomputed ELSE balance END, epoch + (now IN ('FROZEN', 'UNFROZEN'))::BIGINT, CASE now WHEN 'FROZEN' THEN true WHEN 'UNFROZEN' THEN false ELSE frozen END, CASE WHEN now = 'APPLIED' THEN list_append(applied, charge_id) ELSE applied END, now, CASE WHEN now = 'APPLIED' THEN amount END",
    "event AS event_id, result, balance, epoch, outbox AS outbox_amount",
)


@query("T16_T17_charges", _CHARGES)
def charges(spark, d):
    """Expected epochs follow the changes between freezing and unfreezing; some are one behind or unknown. An id that doesn't come again needn't be remembered."""
    key = F.col("event_id")
    e = D.table(spark, d, "events").select("user_id", "event_id", F.when(key % 11 == 3, "freeze").when(key % 11 == 6, "unfreeze").otherwise("charge").alias("kind"), F.expr("event_id div 300").alias("charge_id"), F.round(F.col("value") * 100).cast("long").alias("amount"), (key * 100).alias("recomputed"))
    by_account = Window.partitionBy("user_id").orderBy("event_id")
    admin = F.when(F.col("kind") != "charge", F.col("kind"))
    before = F.coalesce(F.last(admin, ignorenulls=True).over(by_account.rowsBetween(Window.unboundedPreceding, -1)), F.lit("unfreeze"))
    turned = F.coalesce((admin != before).cast("long"), F.lit(0))
    rows = e.withColumn("turn", turned).withColumn("seen", F.sum("turn").over(by_account) - F.col("turn"))
    rows = rows.withColumn("epoch", F.when(key % 23 != 0, F.col("seen") - (key % 17 == 0).cast("long")))
    again = F.lead("event_id").over(Window.partitionBy("user_id", "charge_id").orderBy("event_id")).isNotNull()
    return S.ordered_fold(rows.withColumn("again", again), ["user_id"], ["event_id"], S.charge_step, S.CHARGE_SCHEMA)


# pipelines

NODES = {"n1": "DESTINATION_RESOLUTION", "n2": "POLICY", "n3": "BILLING", "blocked": "BILLING", "n4": "ROUTING", "n5": "DELIVERY", "n6": "DELIVERY_RECONCILIATION"}
EDGES = {("n1", "SUCCEEDED"): "n2", ("n2", "SUCCEEDED"): "n3", ("n2", "REJECTED"): "blocked", ("n3", "SUCCEEDED"): "n4", ("n4", "SUCCEEDED"): "n5", ("n5", "SUBMISSION_OUTCOME_UNKNOWN"): "n6", ("n5", "TIMED_OUT"): "n6", ("n5", "RETRY_EXHAUSTED"): "n6"}
_TTL = 1_200_000
_STAGE_ROWS = "SELECT *, CASE WHEN stage = 'POLICY' AND value < 12 THEN 'REJECTED' WHEN stage = 'DELIVERY' AND value < 60 THEN 'FAILED' WHEN stage = 'DELIVERY' AND value < 90 THEN 'TIMED_OUT' WHEN value < 4 THEN 'FAILED' ELSE 'SUCCEEDED' END AS outcome FROM (SELECT *, CASE least(n, 7) WHEN 1 THEN 'DESTINATION_RESOLUTION' WHEN 2 THEN 'POLICY' WHEN 3 THEN 'BILLING' WHEN 4 THEN 'ROUTING' WHEN 7 THEN CASE WHEN event_id % 3 = 0 THEN 'DELIVERY_RECONCILIATION' ELSE 'DELIVERY' END ELSE 'DELIVERY' END AS stage FROM (SELECT event_id, event_id // 12 AS message, epoch_us(ts) // 1000 AS t, value, event_id % 6 > 0 AS own, CASE WHEN event_id % 6 > 0 THEN sum((event_id % 6 > 0)::BIGINT) OVER (PARTITION BY event_id // 12 ORDER BY ts, event_id) ELSE 0 END AS n FROM events))"
_PROGRESS = walk(
    _STAGE_ROWS,
    "message",
    "t, event_id",
    f"NULL::BIGINT AS event, 'n1' AS node, 1::BIGINT AS execution, 1 AS attempt, NULL::BIGINT AS until, NULL::VARCHAR AS category, '' AS action",
    [
        f"coalesce(until, t + {_TTL}) AS ends, map_extract_value(map {{{', '.join(f"'{n}': '{s}'" for n, s in NODES.items())}}}, node) AS awaited",
        "coalesce(stage = awaited AND n = execution, false) AS counts, CASE WHEN stage = 'POLICY' THEN CASE WHEN outcome = 'REJECTED' THEN 'BLOCKED' ELSE 'SERVICE' END ELSE category END AS named",
        "counts AND stage = 'DELIVERY' AND outcome = 'FAILED' AND event_id % 3 > 0 AS again",
        "CASE WHEN again THEN 'RETRY_EXHAUSTED' ELSE outcome END AS counted, again AND t < ends AS repeats",
        f"CASE WHEN stage = 'BILLING' AND category = 'BLOCKED' THEN NULL ELSE map_extract_value(map {{{', '.join(f"'{n}:{o}': '{x}'" for (n, o), x in EDGES.items())}}}, node || ':' || counted) END AS following",
        "CASE WHEN NOT counts THEN 'IGNORED' WHEN repeats THEN 'RETRY' WHEN following IS NOT NULL THEN 'ADVANCE' ELSE 'FINISH' END AS now",
    ],
    "event_id, CASE WHEN now IN ('IGNORED', 'RETRY') THEN node ELSE following END, execution + (now <> 'IGNORED')::BIGINT, CASE now WHEN 'IGNORED' THEN attempt WHEN 'RETRY' THEN attempt + 1 ELSE 1 END, ends, CASE WHEN counts THEN named ELSE category END, now",
    "event AS event_id, action, node, attempt",
)


@query("T4_T5_pipeline_progress", _PROGRESS)
def pipeline_progress(spark, d):
    """Rows whose execution is 0 are stale; the others number the executions that a message would have if none were ignored."""
    key, value = F.col("event_id"), F.col("value")
    own = key % 6 > 0
    w = Window.partitionBy("message").orderBy("ts", "event_id")
    rows = D.table(spark, d, "events").withColumn("message", F.expr("event_id div 12")).withColumn("execution", F.when(own, F.sum(own.cast("long")).over(w)).otherwise(F.lit(0)))
    late = F.when(key % 3 == 0, "DELIVERY_RECONCILIATION").otherwise("DELIVERY")
    n = F.col("execution")
    stage = F.when(n == 1, "DESTINATION_RESOLUTION").when(n == 2, "POLICY").when(n == 3, "BILLING").when(n == 4, "ROUTING").when(n >= 7, late).otherwise("DELIVERY")
    rows = rows.withColumn("stage", stage)
    delivery = F.col("stage") == "DELIVERY"
    outcome = F.when((F.col("stage") == "POLICY") & (value < 12), "REJECTED").when(delivery & (value < 60), "FAILED").when(delivery & (value < 90), "TIMED_OUT").when(value < 4, "FAILED").otherwise("SUCCEEDED")
    rows = rows.select("message", "event_id", millis().alias("t"), "stage", "execution", outcome.alias("outcome"), (key % 3 > 0).alias("retryable")).withColumn("category", F.when(F.col("outcome") == "REJECTED", "BLOCKED").otherwise("SERVICE"))
    return S.ordered_fold(rows, ["message"], ["t", "event_id"], S.pipeline_step(NODES, EDGES, "n1", _TTL), S.PIPELINE_SCHEMA)


# hold and release


def lane_rows(spark, d):
    """Holds and control records from events, an hour's tick for each stage, and the reminders of reconciliation twice a day."""
    key = F.col("event_id")
    e = D.table(spark, d, "events").select("event_id", "user_id", millis().alias("t"), F.when(F.col("event_type") == "signup", "DELIVERY_RECONCILIATION").otherwise(D.lookup(F.col("event_type"), D.STAGES, "UNSPECIFIED")).alias("stage"))
    own = F.concat(F.when(F.col("user_id") % 3 == 0, "PARTNER:p").otherwise("OPERATOR_ROUTE:r"), (F.col("user_id") % 10).cast("string"))
    scope = F.when(key % 40 == 3, F.concat(F.lit("PARTNER_STAGE:p"), (F.col("user_id") % 10).cast("string"), F.lit(":"), "stage")).when(key % 400 == 23, "GLOBAL:").when(key % 40 == 23, F.concat(F.lit("STAGE:"), "stage")).otherwise(own)
    kind = F.when(key % 40 < 4, "control").when(key % 40 == 23, "control").otherwise("hold")
    state = F.when(key % 5 < 2, "PAUSED").when(key % 5 == 2, "DEGRADED").otherwise("ACTIVE")
    rows = e.select("stage", "t", kind.alias("kind"), scope.alias("scope"), key.alias("item"), F.when(kind == "control", state).alias("state"), F.when(kind == "control", (key % 5) / 4.0 + 0.25).alias("rate"), F.lit(0).alias("later"))
    clock = e.select("stage", (F.floor(F.col("t") / 3_600_000) * 3_600_000 + 3_600_000).alias("t")).distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("scope", "string"), ("item", "long"), ("state", "string"), ("rate", "double"))]
    ticks = clock.select("stage", "t", F.lit("tick").alias("kind"), *none, F.lit(1).alias("later"))
    reminders = clock.filter((F.col("stage") == "DELIVERY_RECONCILIATION") & (F.col("t") % 43_200_000 == 0)).select("stage", "t", F.lit("remind").alias("kind"), *none, F.lit(2).alias("later"))
    return rows.unionByName(ticks).unionByName(reminders)


@query("T8_hold_and_release")
def hold_and_release(spark, d):
    """A stage's bucket is shared by all that it holds, so its ticks are one fold, of numbers and of what they can come to."""
    return S.release_lanes(lane_rows(spark, d), 3_600_000, 3.0, 0.001)
