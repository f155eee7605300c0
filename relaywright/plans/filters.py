"""Sources, projections, filters, paging and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaywright.functions import rules as R
from relaywright.operators.core import between, latest, matching, page, page_with_more
from relaywright.plans.registry import query
from relaywright.sources import domain as D
from relaywright.sources.domain import sql
from relaywright.sources.files import checked_lines

DAY = "1998-01-01"


@query("S2_union_normalized", "SELECT 'incoming_message' AS event_type, o_orderkey AS message_id, 'p' || (o_custkey % 10)::VARCHAR AS partner_id, '' AS stage_name, o_orderdate AS occurred_at FROM orders UNION ALL SELECT 'stage_completed', user_id, '', event_type, ts FROM events WHERE event_type <> 'error' UNION ALL SELECT 'message_lifecycle', user_id, '', '', ts FROM events WHERE event_type = 'error'")
def union_normalized(spark, d):
    e = D.table(spark, d, "events")
    incoming = D.table(spark, d, "orders").select(F.lit("incoming_message").alias("event_type"), F.col("o_orderkey").alias("message_id"), F.concat(F.lit("p"), (F.col("o_custkey") % 10).cast("string")).alias("partner_id"), F.col("o_orderdate").alias("occurred_at"))
    stages = e.filter("event_type <> 'error'").select(F.lit("stage_completed").alias("event_type"), F.col("user_id").alias("message_id"), F.col("event_type").alias("stage_name"), F.col("ts").alias("occurred_at"))
    life = e.filter("event_type = 'error'").select(F.lit("message_lifecycle").alias("event_type"), F.col("user_id").alias("message_id"), F.col("ts").alias("occurred_at"))
    return incoming.unionByName(stages, allowMissingColumns=True).unionByName(life, allowMissingColumns=True).fillna("", ["partner_id", "stage_name"])


@query("S3_undecodable_split", "SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_id % 13 = 0 AS corrupt FROM events")
def undecodable_split(spark, d):
    raw = D.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props")).alias("raw"))
    parsed = raw.withColumn("j", F.from_json("raw", "k long, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.select("event_id", F.col("j.k").alias("k"), F.col("j._corrupt_record").isNotNull().alias("corrupt"))


@query("S4_timestamp_fallback", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN ts ELSE ts - INTERVAL 1 SECOND END AS occurred_at FROM events")
def timestamp_fallback(spark, d):
    e = D.table(spark, d, "events")
    completed = F.when(F.col("event_id") % 9 == 0, F.lit(0)).otherwise(F.unix_micros((F.col("ts") - F.expr("INTERVAL 1 SECOND")).cast("timestamp")))
    own = F.timestamp_micros(completed).cast("timestamp_ntz")
    return e.select("event_id", F.when(completed <= 0, F.col("ts")).otherwise(own).alias("occurred_at"))


@query("S8_idempotent_insert", sql("SELECT event_id, message_id, stage_name, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) AS rn FROM red) WHERE rn = 1 AND event_id % 10 <> 0", "se", "red"))
def idempotent_insert(spark, d):
    batch = latest(D.redelivered(spark, d), ["event_id"], [F.asc("ingested_at")])
    target = D.stage_events(spark, d).filter("event_id % 10 = 0").select("event_id")
    return batch.join(target, "event_id", "left_anti").select("event_id", "message_id", "stage_name", "ingested_at")


_LIFE = "lc AS (SELECT user_id AS message_id, event_type AS status, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"


def _life(spark, d):
    from pyspark.sql import Window

    e = D.table(spark, d, "events")
    return e.select(F.col("user_id").alias("message_id"), F.col("event_type").alias("status"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("version"))


@query("S9_guarded_upsert", f"WITH {_LIFE} SELECT message_id, max(version) AS version, arg_max(status, version) AS status FROM lc GROUP BY message_id")
def guarded_upsert(spark, d):
    return _life(spark, d).groupBy("message_id").agg(F.max("version").alias("version"), F.max_by("status", "version").alias("status"))


@query("S9b_upsert_reapplies_equal", sql("SELECT entity_type, entity_id, version, id, payload FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY version DESC, id DESC) AS rn FROM cfg) WHERE rn = 1", "cfg"))
def upsert_reapplies_equal(spark, d):
    row = F.struct("version", "id", "payload")
    best = D.configs(spark, d).groupBy("entity_type", "entity_id").agg(F.max_by(row, F.struct("version", "id")).alias("r"))
    return best.select("entity_type", "entity_id", "r.*")


@query("S10_missing_base_rows", "SELECT event_id, user_id AS message_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def missing_base_rows(spark, d):
    base = D.table(spark, d, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("message_id"))
    return D.table(spark, d, "events").select("event_id", F.col("user_id").alias("message_id")).join(base, "message_id", "left_anti").select("event_id", "message_id")


@query("S11_json_config_overlay", "SELECT event_id, coalesce(CASE WHEN event_id % 6 = 0 THEN 1000 + event_id END, CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events")
def json_config_overlay(spark, d):
    e = D.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    reload = e.filter("event_id % 6 = 0").select("event_id", (F.col("event_id") + 1000).alias("live"))
    return e.join(reload, "event_id", "left").select("event_id", F.coalesce("live", "k").alias("k"))


@query("S12_csv_import", "SELECT p_partkey AS line, CASE WHEN p_partkey % 9 = 0 THEN ['malformed'] ELSE list_filter([CASE WHEN p_partkey % 7 = 0 THEN 'name' END, CASE WHEN p_size > 45 THEN 'size' END], lambda x: x IS NOT NULL) END AS errors FROM part")
def csv_import(spark, d):
    """Rows written as CSV lines and read again; lines that don't parse or break a rule are told, the others go on."""
    p = D.table(spark, d, "part")
    name = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    text = F.to_csv(F.struct(F.col("p_partkey").alias("id"), name.alias("name"), F.col("p_size").alias("size")))
    lines = p.select(F.col("p_partkey").alias("line"), F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("x"), text)).otherwise(text).alias("text"))
    rules = {"name": F.col("row.name").isNotNull(), "size": F.col("row.size") <= 45}
    return checked_lines(lines, "text", "id long, name string, size int", rules).select("line", "errors")


@query("S14_outbox_poll", sql("SELECT c.id, c.entity_type, c.entity_id, coalesce(v.version, 0)::INTEGER AS latest_version FROM (SELECT * FROM cfg WHERE status = 'active' AND id % 3 = 0 AND id % 5 < 4 ORDER BY id LIMIT 100) c LEFT JOIN (SELECT entity_type, entity_id, max(version) AS version FROM cfg WHERE status = 'archived' GROUP BY ALL) v USING (entity_type, entity_id)", "cfg"))
def outbox_poll(spark, d):
    rows = D.configs(spark, d)
    batch = rows.filter("status = 'active' AND id % 3 = 0 AND id % 5 < 4").orderBy("id").limit(100)
    versions = rows.filter("status = 'archived'").groupBy("entity_type", "entity_id").agg(F.max("version").alias("v"))
    return batch.join(versions, ["entity_type", "entity_id"], "left").select("id", "entity_type", "entity_id", F.coalesce("v", F.lit(0)).alias("latest_version"))


@query("S16_group_lag", "SELECT 'g' || (l_suppkey % 7)::VARCHAR AS group_id, sum(l_orderkey + 10 - l_orderkey % 11)::BIGINT - sum(l_orderkey - l_orderkey % 11)::BIGINT AS lag, count(*) AS partitions FROM lineitem GROUP BY 1")
def group_lag(spark, d):
    li = D.table(spark, d, "lineitem").select(F.concat(F.lit("g"), (F.col("l_suppkey") % 7).cast("string")).alias("group_id"), (F.col("l_orderkey") + 10 - F.col("l_orderkey") % 11).alias("end"), (F.col("l_orderkey") - F.col("l_orderkey") % 11).alias("committed"))
    return li.groupBy("group_id").agg(F.sum(F.col("end") - F.col("committed")).alias("lag"), F.count(F.lit(1)).alias("partitions"))


@query("S18_minor_units", "SELECT l_orderkey, l_linenumber, l_partkey, (CAST(round(l_extendedprice * 100) AS BIGINT) // 100)::VARCHAR || '.' || lpad((CAST(round(l_extendedprice * 100) AS BIGINT) % 100)::VARCHAR, 2, '0') || '00' AS amount FROM lineitem")
def minor_units(spark, d):
    minor = F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")
    return D.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (minor / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,4)").cast("string").alias("amount"))


@query("S19_sorted_routes", "SELECT DISTINCT 'op' || (s_nationkey % 4)::VARCHAR AS operator_id, s_suppkey AS route_id FROM supplier ORDER BY 1, 2")
def sorted_routes(spark, d):
    return D.table(spark, d, "supplier").select(F.concat(F.lit("op"), (F.col("s_nationkey") % 4).cast("string")).alias("operator_id"), F.col("s_suppkey").alias("route_id")).distinct().orderBy("operator_id", "route_id")


@query("F1_optional_filters", sql("SELECT message_id, partner_id, current_status FROM msg WHERE partner_id = 7 AND current_status = 'SUBMITTED'", "msg"))
def optional_filters(spark, d):
    return matching(D.messages(spark, d), partner_id=7, current_status="SUBMITTED", priority=None).select("message_id", "partner_id", "current_status")


@query("F2_nullable_boolean", sql("SELECT message_id, terminal FROM msg WHERE terminal = false", "msg"))
def nullable_boolean(spark, d):
    return matching(D.messages(spark, d), terminal=False, partner_id=None).select("message_id", "terminal")


@query("F3_half_open_range", sql(f"SELECT message_id, created_at FROM msg WHERE created_at >= TIMESTAMP '{DAY}' AND created_at < TIMESTAMP '1998-07-01'", "msg"))
def half_open_range(spark, d):
    return between(D.messages(spark, d), "created_at", F.lit(DAY).cast("timestamp_ntz"), F.lit("1998-07-01").cast("timestamp_ntz")).select("message_id", "created_at")


@query("F4_closed_range", sql(f"SELECT message_id, created_at FROM msg WHERE created_at >= TIMESTAMP '{DAY}' AND created_at <= TIMESTAMP '1998-07-01'", "msg"))
def closed_range(spark, d):
    return between(D.messages(spark, d), "created_at", F.lit(DAY).cast("timestamp_ntz"), F.lit("1998-07-01").cast("timestamp_ntz"), closed=True).select("message_id", "created_at")


@query("F5_wildcard_parameter", sql("SELECT message_id, priority FROM msg WHERE ('' = '' OR priority = '') AND ('2-HIGH' = '' OR priority = '2-HIGH')", "msg"))
def wildcard_parameter(spark, d):
    rows = D.messages(spark, d)
    for value in ("", "2-HIGH"):
        rows = matching(rows, priority=value or None)
    return rows.select("message_id", "priority")


@query("F6_in_list", sql("SELECT message_id, partner_id FROM msg WHERE partner_id IN (3, 17, 44)", "msg"))
def in_list(spark, d):
    return matching(D.messages(spark, d), partner_id=[3, 17, 44]).select("message_id", "partner_id")


@query("F6_empty_list", sql("SELECT message_id, partner_id FROM msg WHERE false", "msg"))
def empty_list(spark, d):
    return matching(D.messages(spark, d), partner_id=[]).select("message_id", "partner_id")


@query("F7_disjunctive_conversation", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 11 OR (event_type = 'purchase' AND user_id IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) ORDER BY event_id")
def disjunctive_conversation(spark, d):
    e = D.table(spark, d, "events")
    other = D.table(spark, d, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("known"))
    rows = e.join(other, "user_id", "left").filter((F.col("user_id") == 11) | ((F.col("event_type") == "purchase") & F.col("known")))
    return rows.select("event_id", "user_id", "event_type").orderBy("event_id")


@query("F8_since_cursor", sql("SELECT id, partner_id, turn FROM chat WHERE partner_id < 50 AND turn > 2", "chat"))
def since_cursor(spark, d):
    rows = D.chats(spark, d).filter("partner_id < 50")
    since = 2
    return (rows if since is None else rows.filter(F.col("turn") > since)).select("id", "partner_id", "turn")


@query("F9_tenant_first", sql("SELECT message_id, current_status, created_at FROM msg WHERE partner_id = 12 ORDER BY created_at DESC, message_id DESC LIMIT 20", "msg"))
def tenant_first(spark, d):
    return page(D.messages(spark, d).filter("partner_id = 12"), [F.desc("created_at"), F.desc("message_id")], 20).select("message_id", "current_status", "created_at")


@query("F10_F11_scope_and_tag", sql("SELECT id, CASE WHEN entity_id = 'ECONOMY' THEN entity_type ELSE entity_type || ':' || entity_id END AS target, 'replay' AS source FROM cfg", "cfg"))
def scope_and_tag(spark, d):
    return D.configs(spark, d).select("id", F.when(F.col("entity_id") == "ECONOMY", F.col("entity_type")).otherwise(F.concat_ws(":", "entity_type", "entity_id")).alias("target"), F.lit("replay").alias("source"))


@query("F12_null_defaults", "SELECT o_orderkey AS message_id, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE '' END AS error_detail, coalesce(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END, 0) AS version FROM orders")
def null_defaults(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("error_detail"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")).alias("version"))
    return o.fillna({"error_detail": "", "version": 0})


@query("F13_money_as_text", sql("SELECT l_orderkey, l_linenumber, l_partkey, amount::VARCHAR AS amount FROM lg", "lg"))
def money_as_text(spark, d):
    return D.ledger(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.col("amount").cast("string").alias("amount"))


def hashed(key):
    """32 bits of a key that any engine can compute."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def sampled(key, rate):
    """The same share of keys each time."""
    return hashed(key) % 1_000_000 < (rate * 1_000_000).cast("long")


_ORDERS_14 = """SELECT o_orderkey AS k, CASE WHEN k % 31 = 1 THEN '' WHEN k % 31 = 2 THEN NULL ELSE 'p1' END AS partner, CASE WHEN k % 37 = 1 THEN '' ELSE 'app' END AS app, CASE WHEN k % 41 <> 1 THEN 'key' END AS api_key, CASE WHEN k % 43 <> 1 THEN '10.0.0.1' END AS ip,
  CASE k % 7 WHEN 0 THEN '99x' WHEN 1 THEN '' WHEN 2 THEN repeat('9', 16) ELSE '998' || lpad(k::VARCHAR, 8, '0') END AS msisdn, CASE k % 11 WHEN 0 THEN '' WHEN 1 THEN repeat('s', 22) WHEN 2 THEN 'Кlick' WHEN 3 THEN repeat('s', 21) ELSE o_orderpriority END AS sender,
  CASE k % 13 WHEN 0 THEN '' WHEN 1 THEN repeat('b', 1601) WHEN 2 THEN repeat('b', 1600) ELSE 'hello' END AS body, CASE k % 17 WHEN 0 THEN repeat('i', 129) WHEN 1 THEN repeat('i', 128) WHEN 2 THEN '' END AS idem,
  CASE WHEN k % 47 = 1 THEN 300 WHEN k % 5 > 0 THEN k % 5 END AS priority, k % 53 = 1 AS broken, k % 59 = 1 AS no_sender FROM orders"""


@query("F14_validation_ladder", f"SELECT k AS message_id, CASE WHEN coalesce(partner, '') = '' THEN 'missing_partner_id' WHEN app = '' THEN 'missing_application_id' WHEN api_key IS NULL THEN 'missing_api_key' WHEN ip IS NULL THEN 'missing_remote_ip' WHEN broken OR no_sender OR priority > 255 THEN 'invalid_json_body' WHEN msisdn = '' THEN 'empty_msisdn' WHEN NOT regexp_full_match(msisdn, '[0-9]{{9,15}}') THEN 'invalid_msisdn' WHEN sender = '' THEN 'empty_sender_id' WHEN length(sender) > 21 THEN 'sender_id_too_long' WHEN sender = 'Кlick' THEN 'invalid_sender_id' WHEN body = '' THEN 'empty_body' WHEN length(body) > 1600 THEN 'body_too_long' WHEN length(idem) > 128 THEN 'idempotency_key_too_long' WHEN priority > 3 THEN 'invalid_priority' ELSE '' END AS error FROM ({_ORDERS_14})")
def validation_ladder(spark, d):
    k = F.col("o_orderkey")
    case = lambda n, values, rest: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), (k % n).cast("int")), rest)
    fields = F.struct(
        case(7, {0: "99x", 1: "", 2: "9" * 16}, F.concat(F.lit("998"), F.lpad(k.cast("string"), 8, "0"))).alias("msisdn"),
        F.when(k % 59 != 1, case(11, {0: "", 1: "s" * 22, 2: "Кlick", 3: "s" * 21}, F.col("o_orderpriority"))).alias("sender_id"),
        case(13, {0: "", 1: "b" * 1601, 2: "b" * 1600}, F.lit("hello")).alias("body"),
        F.when(k % 47 == 1, 300).when(k % 5 > 0, k % 5).alias("priority"),
    )
    body = F.when(k % 53 == 1, "{broken").otherwise(F.to_json(fields))
    partner = F.when(k % 31 == 1, "").when(k % 31 != 2, "p1")
    idempotency = F.when(k % 17 == 0, F.lit("i" * 129)).when(k % 17 == 1, F.lit("i" * 128)).when(k % 17 == 2, "")
    error = R.request_error(partner, F.when(k % 37 == 1, "").otherwise("app"), F.when(k % 41 != 1, "key"), F.when(k % 43 != 1, "10.0.0.1"), body, idempotency)
    return D.table(spark, d, "orders").select(k.alias("message_id"), error.alias("error"))


@query("F15_enum_decode", sql("SELECT event_id, stage_name, outcome FROM se", "se"))
def enum_decode(spark, d):
    return D.stage_events(spark, d).select("event_id", "stage_name", "outcome")


@query("F16_status_normalize", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'DELIVERED' WHEN 'error' THEN 'UNDELIVERABLE' WHEN 'view' THEN 'ACCEPTED' END AS status FROM events WHERE event_type IN ('purchase', 'error', 'view')")
def status_normalize(spark, d):
    known = F.create_map(*map(F.lit, ("purchase", "DELIVERED", "error", "UNDELIVERABLE", "view", "ACCEPTED")))
    return D.table(spark, d, "events").select("event_id", F.try_element_at(known, F.col("event_type")).alias("status")).filter("status IS NOT NULL")


_STAGES_17 = "list_element(['DESTINATION_RESOLUTION', 'POLICY', 'BILLING', 'ROUTING', 'DELIVERY', 'DELIVERY_RECONCILIATION'], (event_id % 6 + 1)::INTEGER)"
_OUTCOMES_17 = "list_element(['SUCCEEDED', 'REJECTED', 'FAILED', 'TIMED_OUT', 'RETRY_EXHAUSTED', 'SUBMISSION_OUTCOME_UNKNOWN', 'DELIVERY_UNRESOLVED'], (event_id // 6 % 7 + 1)::INTEGER)"
_RECONCILED_17 = "list_element([NULL, 'CONFIRMED_SUBMITTED', 'CONFIRMED_NOT_SUBMITTED', 'DELIVERY_CONFIRMED', 'DELIVERY_FAILED', 'DELIVERY_UNRESOLVED'], (event_id // 42 % 6 + 1)::INTEGER)"
_TABLE_17 = "(VALUES ('POLICY', 'REJECTED', '', 'REJECTED'), ('DELIVERY', 'SUCCEEDED', '', 'SUBMITTED'), ('DELIVERY', 'FAILED', '', 'UNDELIVERABLE'), ('DELIVERY', 'TIMED_OUT', '', 'SYSTEM_UNAVAILABLE'), ('DELIVERY', 'RETRY_EXHAUSTED', '', 'SYSTEM_UNAVAILABLE'), ('DELIVERY_RECONCILIATION', '', 'CONFIRMED_SUBMITTED', 'SUBMITTED'), ('DELIVERY_RECONCILIATION', '', 'CONFIRMED_NOT_SUBMITTED', 'UNDELIVERABLE'), ('DELIVERY_RECONCILIATION', '', 'DELIVERY_CONFIRMED', 'DELIVERED'), ('DELIVERY_RECONCILIATION', '', 'DELIVERY_FAILED', 'UNDELIVERABLE'), ('DELIVERY_RECONCILIATION', '', 'DELIVERY_UNRESOLVED', 'DELIVERY_UNRESOLVED'), ('DESTINATION_RESOLUTION', 'REJECTED', '', 'FAILED'), ('DESTINATION_RESOLUTION', 'FAILED', '', 'FAILED'), ('DESTINATION_RESOLUTION', 'TIMED_OUT', '', 'FAILED'), ('DESTINATION_RESOLUTION', 'RETRY_EXHAUSTED', '', 'FAILED'), ('ROUTING', 'REJECTED', '', 'FAILED'), ('ROUTING', 'FAILED', '', 'FAILED'), ('ROUTING', 'TIMED_OUT', '', 'FAILED'), ('ROUTING', 'RETRY_EXHAUSTED', '', 'FAILED')) AS v(stage, outcome, reconciled, status)"


@query("F17_candidate_status", f"SELECT event_id, status AS candidate FROM (SELECT event_id, {_STAGES_17} AS s, {_OUTCOMES_17} AS o, {_RECONCILED_17} AS r, value < 20 AS again FROM events) LEFT JOIN {_TABLE_17} ON NOT again AND stage = s AND (outcome = o OR outcome = '') AND (reconciled = r OR reconciled = '')")
def candidate_status(spark, d):
    """Every stage with every outcome and every finding of reconciliation."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int"))
    key = F.col("event_id")
    stage = pick(["DESTINATION_RESOLUTION", "POLICY", "BILLING", "ROUTING", "DELIVERY", "DELIVERY_RECONCILIATION"], key % 6 + 1)
    outcome = pick(["SUCCEEDED", "REJECTED", "FAILED", "TIMED_OUT", "RETRY_EXHAUSTED", "SUBMISSION_OUTCOME_UNKNOWN", "DELIVERY_UNRESOLVED"], F.expr("event_id div 6") % 7 + 1)
    reconciliation = pick([None, *R.RECONCILED], F.expr("event_id div 42") % 6 + 1)
    return D.table(spark, d, "events").select("event_id", R.candidate_status(stage, outcome, F.col("value") < 20, reconciliation).alias("candidate"))


@query("F17b_admission_rate", "SELECT c_custkey AS partner_id, CASE n_regionkey WHEN 0 THEN CASE WHEN live AND state = 'PAUSED' THEN NULL WHEN live THEN least(0.75::DOUBLE, rate) ELSE 0.75::DOUBLE END WHEN 4 THEN CASE WHEN live AND state = 'PAUSED' THEN NULL WHEN live THEN least(0.2::DOUBLE, rate) ELSE 0.2::DOUBLE END END AS rate FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_suppkey, (s_suppkey % 11) / 10.0::DOUBLE AS rate, CASE WHEN s_suppkey % 6 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS state, s_suppkey % 5 <> 2 AS live FROM supplier WHERE s_suppkey % 4 <> 1) ON s_suppkey = c_custkey % 120")
def admission_rate(spark, d):
    """Regions stand for clusters with a record of their own each: open, paused, just expired, none, and open for another minute."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    after = lambda s: now + F.make_dt_interval(secs=s)
    region = D.table(spark, d, "region").select(F.col("r_regionkey").alias("region")).filter("region <> 3")
    expiry = F.when(F.col("region") == 2, after(F.lit(0))).when(F.col("region") == 4, after(F.lit(60)))
    overall = region.select("region", F.struct(F.when(F.col("region") == 1, "PAUSED").otherwise("ACTIVE").alias("state"), F.when(F.col("region") == 4, 0.2).otherwise(0.75).alias("rate"), expiry.alias("expires_at")).alias("overall"))
    key = F.col("s_suppkey")
    expires = F.when(key % 5 == 2, after(F.lit(-1))).when(key % 5 == 3, after(F.lit(1)))
    own = D.table(spark, d, "supplier").filter(key % 4 != 1).select(key.alias("record"), F.struct(F.when(key % 6 == 0, "PAUSED").otherwise("ACTIVE").alias("state"), ((key % 11) / 10.0).alias("rate"), expires.alias("expires_at")).alias("own"))
    nations = D.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("region"))
    partners = D.table(spark, d, "customer").select(F.col("c_custkey").alias("partner_id"), "c_nationkey", (F.col("c_custkey") % 120).alias("record")).join(nations, "c_nationkey")
    rows = partners.join(overall, "region", "left").join(own, "record", "left")
    return rows.select("partner_id", R.admission_rate(F.col("overall"), F.col("own"), now).alias("rate"))


@query("F17c_hash_sampling", "SELECT user_id, event_id FROM events WHERE ('0x' || md5(user_id || ':' || event_id)[1:8])::BIGINT % 1000000 < CASE WHEN user_id % 10 = 9 THEN 1000000 WHEN user_id % 10 = 0 THEN 0 ELSE 250000 END")
def hash_sampling(spark, d):
    """All of one in ten partners, nothing of another, a quarter of the rest."""
    rate = F.when(F.col("user_id") % 10 == 9, 1.0).when(F.col("user_id") % 10 == 0, 0.0).otherwise(0.25)
    return D.table(spark, d, "events").filter(sampled(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), rate)).select("user_id", "event_id")


_REASONS_17D = "['TPS_THROTTLED', 'PACER_QUEUE_FULL', 'PACER_QUEUE_TIMEOUT', 'SUBMIT_TIMEOUT', 'GATEWAY_INSTANCE_NOT_FOUND', 'AMBIGUOUS_PRIOR_ATTEMPT_NOT_RESUBMITTED', 'SMPP_STATUS_0x00000058', 'UNAVAILABLE', NULL, 'SUBMIT_TIMEOUT_', '']"


@query("F17d_retryable_reason", f"SELECT event_id, event_id % 11 < 6 AS retryable, list_element({_REASONS_17D}, (event_id % 11 + 1)::INTEGER) AS reason FROM events")
def retryable_reason(spark, d):
    reasons = F.array(*map(F.lit, [*R.RETRYABLE, "SMPP_STATUS_0x00000058", "UNAVAILABLE", None, "SUBMIT_TIMEOUT_", ""]))
    rows = D.table(spark, d, "events").select("event_id", F.element_at(reasons, (F.col("event_id") % 11 + 1).cast("int")).alias("reason"))
    return rows.select("event_id", R.retryable_reason(F.col("reason")).alias("retryable"), "reason")


@query("F17e_response_class", "SELECT event_id, CASE WHEN s >= 500 THEN 'AMBIGUOUS' WHEN s >= 400 THEN 'REJECTED' WHEN k < 50 THEN 'ACCEPTED' ELSE 'REJECTED' END AS result FROM (SELECT event_id, 200 + (event_id % 5) * 100 AS s, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def response_class(spark, d):
    status, body = 200 + (F.col("event_id") % 5) * 100, F.from_json("props", "k long")["k"]
    return D.table(spark, d, "events").select("event_id", F.when(status >= 500, "AMBIGUOUS").when(status >= 400, "REJECTED").when(body < 50, "ACCEPTED").otherwise("REJECTED").alias("result"))


@query("F17f_cidr_allow_list", "SELECT o_orderkey AS message_id, ((o_custkey % 3 = 0) AND (o_orderkey % 256) // 16 = 2) OR (o_custkey % 3 = 1) AS allowed FROM orders")
def cidr_allow_list(spark, d):
    """10.0.0.32/28 and 192.168.1.0/24 are allowed; the malformed entry is skipped."""
    address = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("10.0.0."), (F.col("o_orderkey") % 256).cast("string"))).when(F.col("o_custkey") % 3 == 1, F.concat(F.lit("192.168.1."), (F.col("o_orderkey") % 256).cast("string"))).otherwise(F.lit("172.16.0.9"))
    number = lambda c: F.aggregate(F.split(c, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + F.try_to_number(x, F.lit("999")).cast("long"))
    entries = F.array(F.lit("10.0.0.32/28"), F.lit("192.168.1.0/24"), F.lit("nonsense"))
    well = F.filter(entries, lambda e: e.rlike(r"^\d{1,3}(\.\d{1,3}){3}/\d{1,2}$"))
    inside = F.exists(well, lambda e: F.floor(number(F.col("address")) / F.pow(F.lit(2.0), 32 - F.split_part(e, F.lit("/"), F.lit(2)).cast("int"))) == F.floor(number(F.split_part(e, F.lit("/"), F.lit(1))) / F.pow(F.lit(2.0), 32 - F.split_part(e, F.lit("/"), F.lit(2)).cast("int"))))
    return D.table(spark, d, "orders").withColumn("address", address).select(F.col("o_orderkey").alias("message_id"), inside.alias("allowed"))


@query("F18_json_path_predicate", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def json_path_predicate(spark, d):
    return D.table(spark, d, "events").filter(F.get_json_object("props", "$.k") == "42").select("event_id")


@query("L1_newest_page", sql("SELECT message_id, created_at FROM msg ORDER BY created_at DESC, message_id DESC LIMIT 50 OFFSET 100", "msg"))
def newest_page(spark, d):
    return page(D.messages(spark, d), [F.desc("created_at"), F.desc("message_id")], 500, 100).select("message_id", "created_at")


@query("L2_has_more", sql("SELECT message_id, (SELECT count(*) FROM msg WHERE partner_id = 4) > 20 AS has_more FROM msg WHERE partner_id = 4 ORDER BY message_id LIMIT 20", "msg"))
def has_more(spark, d):
    return page_with_more(D.messages(spark, d).filter("partner_id = 4").select("message_id"), [F.asc("message_id")], 20)


@query("L3_keyset_page", sql("SELECT id, entity_type FROM cfg WHERE id > 150 ORDER BY id LIMIT 25", "cfg"))
def keyset_page(spark, d):
    return page(D.configs(spark, d).filter("id > 150"), [F.asc("id")], 25).select("id", "entity_type")


@query("L4_oldest_expired", sql("SELECT message_id, created_at FROM msg WHERE NOT terminal AND created_at < TIMESTAMP '1997-01-01' ORDER BY created_at, message_id LIMIT 100", "msg"))
def oldest_expired(spark, d):
    return D.messages(spark, d).filter("NOT terminal AND created_at < TIMESTAMP_NTZ '1997-01-01'").orderBy("created_at", "message_id").limit(100).select("message_id", "created_at")


@query("L5_multi_key_sort", sql("SELECT id, partner_id, turn FROM chat ORDER BY turn, partner_id, id", "chat"))
def multi_key_sort(spark, d):
    return D.chats(spark, d).select("id", "partner_id", "turn").orderBy("turn", "partner_id", "id")


@query("L6_specific_first", sql("SELECT entity_type, id AS best_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY version DESC, id) AS rn FROM cfg) WHERE rn = 1", "cfg"))
def specific_first(spark, d):
    return D.configs(spark, d).groupBy("entity_type").agg(F.max_by("id", F.struct("version", -F.col("id"))).alias("best_id"))


@query("L7_healthy_route", "SELECT s_nationkey AS operator_id, arg_min(s_suppkey, s_suppkey + CASE WHEN s_suppkey % 7 = 3 THEN 0 ELSE 1000000 END) AS route_id FROM supplier WHERE s_suppkey % 4 <> 0 GROUP BY 1")
def healthy_route(spark, d):
    s = D.table(spark, d, "supplier").filter("s_suppkey % 4 <> 0")  # the others are paused
    return s.groupBy(F.col("s_nationkey").alias("operator_id")).agg(F.min_by("s_suppkey", F.struct(F.col("s_suppkey") % 7 != 3, "s_suppkey")).alias("route_id"))


@query("L8_batch_grant", "SELECT event_id, fair FROM (SELECT event_id, row_number() OVER (ORDER BY k, user_id) AS fair, count(*) OVER () AS n FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'signup')) WHERE fair <= least(ceil(n * 0.25), 300)")
def batch_grant(spark, d):
    """A quarter of what is held, 300 at most: the first in fair order."""
    from pyspark.sql import Window

    signups = D.table(spark, d, "events").filter("event_type = 'signup'")
    held = signups.select("event_id", "user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("k"))
    first = held.orderBy("k", "user_id").limit(300)
    n = signups.agg(F.count(F.lit(1)).alias("n")).scalar()
    return first.select("event_id", F.row_number().over(Window.orderBy("k", "user_id")).cast("long").alias("fair")).filter(F.col("fair") <= F.ceil(n * 0.25))


@query("L9_capped_list", sql("SELECT id, payload FROM cfg WHERE status = 'active' ORDER BY id LIMIT 400", "cfg"))
def capped_list(spark, d):
    return D.configs(spark, d).filter("status = 'active'").orderBy("id").limit(min(1000, 400)).select("id", "payload")


@query("U1_audit_union", "SELECT source, actor, target, created_at FROM (SELECT 'replay' AS source, 'u' || user_id::VARCHAR AS actor, event_id AS target, ts AS created_at FROM events WHERE event_type = 'error' UNION ALL SELECT 'config', 'c' || o_custkey::VARCHAR, o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'billing', 's' || l_suppkey::VARCHAR, l_orderkey * 100000 + l_partkey, l_shipdate FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT 'iam', 'n' || c_nationkey::VARCHAR, c_custkey, TIMESTAMP '2000-01-01' FROM customer WHERE c_acctbal < 0) ORDER BY created_at DESC, source, target DESC, actor LIMIT 200")
def audit_union(spark, d):
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias("actor")
    parts = [
        D.table(spark, d, "events").filter("event_type = 'error'").select(F.lit("replay").alias("source"), tag("u", "user_id"), F.col("event_id").alias("target"), F.col("ts").alias("created_at")),
        D.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.lit("config").alias("source"), tag("c", "o_custkey"), F.col("o_orderkey").alias("target"), F.col("o_orderdate").alias("created_at")),
        D.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.lit("billing").alias("source"), tag("s", "l_suppkey"), (F.col("l_orderkey") * 100000 + F.col("l_partkey")).alias("target"), F.col("l_shipdate").alias("created_at")),
        D.table(spark, d, "customer").filter("c_acctbal < 0").select(F.lit("iam").alias("source"), tag("n", "c_nationkey"), F.col("c_custkey").alias("target"), F.lit("2000-01-01").cast("timestamp_ntz").alias("created_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return page(out, [F.desc("created_at"), F.asc("source"), F.desc("target"), F.asc("actor")], 200)


@query("U2_hit_union", "SELECT event_id, list_sort(list_distinct(list_concat([k % 3, k % 5], [k % 4]))) AS hits FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)")
def hit_union(spark, d):
    k = F.from_json("props", "k long")["k"]
    return D.table(spark, d, "events").select("event_id", F.array_sort(F.array_union(F.array(k % 3, k % 5), F.array(k % 4))).alias("hits"))


@query("U3_stale_rows", sql("SELECT DISTINCT entity_type, entity_id FROM cfg WHERE status = 'archived' EXCEPT SELECT entity_type, entity_id FROM cfg WHERE status = 'active' AND version > 45", "cfg"))
def stale_rows(spark, d):
    rows = D.configs(spark, d)
    fresh = rows.filter("status = 'active' AND version > 45").select("entity_type", "entity_id").distinct()
    return rows.filter("status = 'archived'").select("entity_type", "entity_id").distinct().join(fresh, ["entity_type", "entity_id"], "left_anti")


@query("U4_available", "SELECT n_nationkey AS role_id FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def available(spark, d):
    taken = D.table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("role_id"))
    return D.table(spark, d, "nation").select(F.col("n_nationkey").alias("role_id")).join(taken, "role_id", "left_anti").distinct()
