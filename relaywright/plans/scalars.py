"""Scalar functions, validation and decision gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaywright.functions import rules as R
from relaywright.functions import text as X
from relaywright.operators.core import latest
from relaywright.plans.registry import query
from relaywright.sources import domain as D
from relaywright.sources.domain import sql

AS_OF = "2024-01-20 00:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("X1_time_truncation", "SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('day', ts) AS day, strftime(ts, '%Y-%m-%d') AS day_text FROM events")
def time_truncation(spark, d):
    cut = lambda unit: F.date_trunc(unit, "ts").cast("timestamp_ntz")
    return D.table(spark, d, "events").select("event_id", cut("hour").alias("hour"), cut("day").alias("day"), F.date_format("ts", "yyyy-MM-dd").alias("day_text"))


@query("X2_age_filter", f"SELECT event_id FROM events WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR - INTERVAL 30 SECOND")
def age_filter(spark, d):
    return D.table(spark, d, "events").filter(F.col("ts") < as_of() - F.make_dt_interval(F.lit(0), F.lit(6), F.lit(0), F.lit(30))).select("event_id")


@query("X3_partition_name", "SELECT event_id, try_strptime(regexp_extract(n, '_(\\d{10})$', 1), '%Y%m%d%H') AS hour FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'history_default' ELSE 'history_' || strftime(ts, '%Y%m%d%H') END AS n FROM events)")
def partition_name(spark, d):
    name = F.when(F.col("event_id") % 10 == 0, F.lit("history_default")).otherwise(F.concat(F.lit("history_"), F.date_format("ts", "yyyyMMddHH")))
    return D.table(spark, d, "events").select("event_id", F.try_to_timestamp(F.regexp_extract(name, r"_(\d{10})$", 1), F.lit("yyyyMMddHH")).cast("timestamp_ntz").alias("hour"))


@query("X4_local_time_window", "SELECT event_id, CAST(ts + INTERVAL 5 HOUR AS TIME) BETWEEN TIME '09:00:00' AND TIME '18:00:00' AS open FROM (SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events)")
def local_time_window(spark, d):
    local = F.date_format(D.to_millis(F.col("ts")) + F.expr("INTERVAL 5 HOURS"), "HH:mm:ss.SSS")
    return D.table(spark, d, "events").select("event_id", local.between("09:00:00.000", "18:00:00.000").alias("open"))


#: Look-alikes of Latin letters, in Cyrillic and Greek, and wide forms of some others.
_CYRILLIC, _GREEK, _WIDE = ("aeopcxyisjhkm", "аеорсхуіѕјһкм"), ("aoikvpytx", "αοικνρυτχ"), ("tnrlu", "ｔｎｒｌｕ")
_SEPARATORS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\-_.]"


def disguised(spark, d):
    """Documents whose letters are replaced by look-alikes, by another alphabet for each third of them. Undone, they are as they were."""
    text, kind = F.col("text"), F.col("doc_id") % 3
    other = F.when(kind == 0, F.translate(text, *_CYRILLIC)).when(kind == 1, F.translate(text, *_GREEK)).otherwise(F.translate(text, *_WIDE))
    return D.table(spark, d, "documents").select("doc_id", other.alias("text"))


@query("X5_homoglyph_fold", f"SELECT doc_id, regexp_replace(lower(text), '{_SEPARATORS}+', '', 'g') AS folded FROM documents")
def homoglyph_fold(spark, d):
    return disguised(spark, d).select("doc_id", X.folded(F.col("text")).alias("folded"))


#: In other letters, cases and widths than the texts; two of them fold alike.
_WORDS = ("ThTiоn", "ｅｒｅble", "ingand", "onthe", "ΟNTHE", "le la")
_HITS = f"SELECT doc_id, list_filter(['ereble', 'ingand', 'le la', 'onthe', 'thtion'], lambda w: contains(lower(text), w) OR contains(regexp_replace(lower(text), '{_SEPARATORS}', '', 'g'), w)) AS hits FROM documents"


@query("X6_banwords", _HITS)
def banwords(spark, d):
    plain = disguised(spark, d).select("doc_id", X.normalized(F.col("text")).alias("plain"))
    both = plain.withColumn("squeezed", X.despaced(F.col("plain")))
    return both.select("doc_id", X.banwords_in(F.col("plain"), F.col("squeezed"), list(_WORDS)).alias("hits"))


@query("X6_banwords_automaton", _HITS)
def banwords_automaton(spark, d):
    return disguised(spark, d).select("doc_id", X.banword_hits(list(_WORDS))(F.col("text")).alias("hits"))


_PATTERN_SQL = "CASE p_partkey % 7 WHEN 0 THEN p_name || ' %w' WHEN 1 THEN 'code %d{1,' || p_size || '} ' || p_name WHEN 2 THEN '%{otp}-' || p_name || '%w.' WHEN 3 THEN '%w%d{2,4}' WHEN 4 THEN '%d{x,2}' || p_name || '%{Bad}' WHEN 5 THEN '%w' || p_name || 'é%w' ELSE p_name END"
_PLACEHOLDER_SQL = r"%w|%d\{\+?[0-9]+,\+?[0-9]+\}|%\{[a-z][a-z0-9_]*\}"


def patterns(spark, d):
    name, k = F.col("p_name"), F.col("p_partkey") % 7
    text = F.when(k == 0, F.concat(name, F.lit(" %w"))).when(k == 1, F.concat(F.lit("code %d{1,"), F.col("p_size").cast("string"), F.lit("} "), name)).when(k == 2, F.concat(F.lit("%{otp}-"), name, F.lit("%w.")))
    text = text.when(k == 3, "%w%d{2,4}").when(k == 4, F.concat(F.lit("%d{x,2}"), name, F.lit("%{Bad}"))).when(k == 5, F.concat(F.lit("%w"), name, F.lit("é%w"))).otherwise(name)
    return D.table(spark, d, "part").select(F.col("p_partkey").alias("id"), text.alias("pattern"))


@query("X7_template_parse", f"SELECT id, regexp_extract_all(pattern, '{_PLACEHOLDER_SQL}') AS placeholders, regexp_split_to_array(pattern, '{_PLACEHOLDER_SQL}') AS literals FROM (SELECT p_partkey AS id, {_PATTERN_SQL} AS pattern FROM part)")
def template_parse(spark, d):
    return patterns(spark, d).select("id", X.placeholders(F.col("pattern")).alias("placeholders"), X.literals(F.col("pattern")).alias("literals"))


#: Of a text: where the literals of "Dear %w, code %d{4,6} for %{shop}" stand, and what lies between.
_MESSAGES = "SELECT o_orderkey AS message_id, CASE o_orderkey % 5 WHEN 0 THEN 'Dear client ' || o_custkey || ', ' WHEN 1 THEN 'Oh Dear client' || o_custkey || ', ' WHEN 2 THEN 'Dear client, , ' ELSE 'Dear you, ' END || CASE o_orderkey % 7 WHEN 0 THEN 'code 12-34' WHEN 1 THEN 'code 12 3' WHEN 2 THEN 'code 1234567' WHEN 3 THEN 'code 123456' ELSE 'code 1234x' END || CASE o_orderkey % 3 WHEN 0 THEN ' for shop' || o_custkey % 10 WHEN 1 THEN ' for shop10 for me' ELSE ' on ' || o_orderpriority END AS text, o_custkey % 4 AS sender FROM orders"
_MATCHES = f"""WITH m AS ({_MESSAGES}), p AS (SELECT *, strpos(text, 'Dear ') + 4 AS a1, strpos(text, ', code ') AS b0, strpos(text, ' on ') AS o0, strpos(text, 'code ') AS c0, strpos(text, ' for ') AS f0 FROM m),
  q AS (SELECT *, regexp_full_match(substr(text, a1 + 1, b0 - a1 - 1), '\\S+') AS word, CASE WHEN f0 > 0 THEN substr(text, c0 + 5, f0 - c0 - 5) END AS code, substr(text, f0 + 5) AS tail FROM p),
  r AS (SELECT *, f0 > 0 AND regexp_full_match(code, '[0-9 ._-]+') AND length(regexp_replace(code, '[^0-9]', '', 'g')) BETWEEN 4 AND 6 AS digits FROM q)
  SELECT message_id, CASE WHEN word AND digits AND regexp_full_match(tail, 'shop[0-9]') THEN 'full' WHEN digits AND sender = 2 THEN 'bound' WHEN word THEN 'dear' WHEN o0 > 0 AND regexp_full_match(substr(text, o0 + 4), '\\S+') THEN 'on' WHEN f0 > 0 THEN 'for' END AS template_id FROM r"""


@query("X8_template_match", _MATCHES)
def template_match(spark, d):
    key, n = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    greeting = F.when(key % 5 == 0, F.concat(F.lit("Dear client "), n, F.lit(", "))).when(key % 5 == 1, F.concat(F.lit("Oh Dear client"), n, F.lit(", "))).when(key % 5 == 2, "Dear client, , ").otherwise("Dear you, ")
    code = F.when(key % 7 == 0, "code 12-34").when(key % 7 == 1, "code 12 3").when(key % 7 == 2, "code 1234567").when(key % 7 == 3, "code 123456").otherwise("code 1234x")
    tail = F.when(key % 3 == 0, F.concat(F.lit(" for shop"), (F.col("o_custkey") % 10).cast("string"))).when(key % 3 == 1, " for shop10 for me").otherwise(F.concat(F.lit(" on "), "o_orderpriority"))
    messages = D.table(spark, d, "orders").select(key.alias("message_id"), F.concat(greeting, code, tail).alias("text"), (F.col("o_custkey") % 4).cast("string").alias("sender"))
    templates = [("any", "%w%d{0,9}", None), ("dear", "Dear %w, code ", None), ("full", "Dear %w, code %d{4,6} for %{shop}", None), ("bound", "code %d{4,6} for ", "2"), ("on", " on %w", None), ("for", " for ", None), ("rule", "code %{broken} for ", None)]
    return messages.select("message_id", X.best_template(templates, {"shop": "shop[0-9]", "broken": "("})(F.col("text"), F.col("sender")).alias("template_id"))


@query("X9_specificity", f"SELECT id, list_sum([CASE WHEN x = '%w' THEN 1 WHEN starts_with(x, '%d') THEN 2 ELSE 3 END FOR x IN found])::INTEGER AS points, octet_length(encode(regexp_replace(pattern, '{_PLACEHOLDER_SQL}', '', 'g')))::INTEGER AS bytes FROM (SELECT *, list_concat(regexp_extract_all(pattern, '{_PLACEHOLDER_SQL}'), []) AS found FROM (SELECT p_partkey AS id, {_PATTERN_SQL} AS pattern FROM part)) WHERE len(found) > 0 UNION ALL SELECT id, 0, octet_length(encode(pattern))::INTEGER FROM (SELECT p_partkey AS id, {_PATTERN_SQL} AS pattern FROM part) WHERE NOT regexp_matches(pattern, '{_PLACEHOLDER_SQL}')")
def specificity(spark, d):
    return patterns(spark, d).select("id", X.specificity(F.col("pattern")).alias("s")).select("id", "s.points", "s.bytes")


@query("X10_selectivity_warning", f"SELECT id, len(t) = 0 OR list_min([length(x) FOR x IN t]) < 3 AS weak FROM (SELECT id, list_filter(regexp_split_to_array(pattern, '{_PLACEHOLDER_SQL}'), lambda x: x <> '') AS t FROM (SELECT p_partkey AS id, {_PATTERN_SQL} AS pattern FROM part))")
def selectivity_warning(spark, d):
    return patterns(spark, d).select("id", X.weak_template(F.col("pattern")).alias("weak"))


@query("X11_segment_count", "SELECT doc_id, CASE WHEN gsm THEN CASE WHEN s <= 160 THEN 1 ELSE CAST(ceil(s / 153.0) AS INTEGER) END ELSE CASE WHEN u <= 70 THEN 1 ELSE CAST(ceil(u / 67.0) AS INTEGER) END END AS segments FROM (SELECT doc_id, regexp_full_match(text, '[\\x0a\\x0d\\x20-\\x5f\\x61-\\x7e£¥èéùìòÇØøÅåΔ_ΦΓΛΩΠΨΣΘΞÆæßÉ¤¡ÄÖÑÜ§¿äöñüà€]*') AS gsm, length(text) + length(regexp_replace(text, '[^\\^{}\\\\\\[~\\]|€]', '', 'g')) AS s, length(text) AS u FROM documents)")
def segment_count(spark, d):
    return D.table(spark, d, "documents").select("doc_id", X.segments(F.col("text")).alias("segments"))


@query("X12_segment_split")
def segment_split(spark, d):
    # outer, though no text is without segments: else the plan makes them once more for a filter
    return D.table(spark, d, "documents").select("doc_id", F.posexplode_outer(X.sent_segments(F.col("text"))).alias("segment", "body"))


@query("X13_tariff", sql("SELECT message_id, CAST(CASE current_status WHEN 'SUBMITTED' THEN 2 WHEN 'DELIVERED' THEN 3 ELSE 0 END * (message_id % 4 + 1) AS BIGINT) AS price FROM msg", "msg"))
def tariff(spark, d):
    prices = F.create_map(*[F.lit(x) for pair in {"SUBMITTED": 2, "DELIVERED": 3, "DELIVERY_UNRESOLVED": 0}.items() for x in pair])
    # an unknown category is an error, as map lookup is under ANSI
    return D.messages(spark, d).select("message_id", (F.element_at(prices, F.col("current_status")) * (F.col("message_id") % 4 + 1)).cast("long").alias("price"))


@query("X14_recurring_charges", "WITH k AS (SELECT s_suppkey AS partner, 'sender' AS kind, 'S' || n AS sender FROM supplier, (SELECT unnest([1, 2, 3]) AS n) WHERE (s_suppkey + n) % 2 = 0 UNION ALL SELECT s_suppkey, 'package', '' FROM supplier), h AS (SELECT *, md5('recurring:' || kind || ':' || partner || ':' || sender || ':2024-01') AS m FROM k) SELECT partner, kind, sender, m[1:8] || '-' || m[9:12] || '-3' || m[14:16] || '-' || ['8','9','a','b'][(('0x' || m[17:17])::INTEGER % 4) + 1] || m[18:20] || '-' || m[21:32] AS charge_id FROM h")
def recurring_charges(spark, d):
    """A fee for each active sender and one package; the id is a UUID version 3 of the charge's name."""
    s = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("partner"))
    senders = s.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).filter((F.col("partner") + F.col("n")) % 2 == 0)
    rows = senders.select("partner", F.lit("sender").alias("kind"), F.concat(F.lit("S"), F.col("n").cast("string")).alias("sender")).unionByName(s.select("partner", F.lit("package").alias("kind"), F.lit("").alias("sender")))
    name = F.concat_ws(":", F.lit("recurring"), "kind", F.col("partner").cast("string"), "sender", F.lit("2024-01"))
    return rows.select("partner", "kind", "sender", X.uuid3_of(name).alias("charge_id"))


@query("X15_event_id", "SELECT event_id, substr(sha256(concat_ws('|', user_id, event_id, event_id % 3, event_type, epoch_us(ts))), 1, 32) AS derived FROM events")
def derived_event_id(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    parts = [F.col(c).cast("string") for c in ("user_id", "event_id")] + [(F.col("event_id") % 3).cast("string"), F.col("event_type"), micros.cast("string")]
    return D.table(spark, d, "events").select("event_id", F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32).alias("derived"))


@query("X15b_receipt_fields", "SELECT event_id, event_id::VARCHAR AS id, CASE WHEN event_id % 4 = 0 THEN '' ELSE upper(event_type) END AS stat FROM events")
def receipt_fields(spark, d):
    body = F.concat(F.lit("id:"), F.col("event_id").cast("string"), F.lit(" submit date:x xstat:NO "), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("STAT:"), F.upper("event_type"))).otherwise(F.lit("")), F.lit(" err:000"))
    return D.table(spark, d, "events").select("event_id", X.receipt_field(body, "id").alias("id"), X.receipt_field(body, "stat").alias("stat"))


@query("X16_backoff", "SELECT event_id, least(CAST(pow(2, event_id % 12) AS BIGINT) * 100, 60000) AS delay_ms, least(100 * CAST(pow(2, greatest(event_id % 12 - 1, 0)) AS BIGINT), 30000) AS jitter_bound_ms FROM events")
def backoff(spark, d):
    attempt = F.col("event_id") % 12
    power = lambda n: F.pow(F.lit(2.0), n).cast("long")
    return D.table(spark, d, "events").select("event_id", F.least(power(attempt) * 100, F.lit(60_000).cast("long")).alias("delay_ms"), F.least(power(F.greatest(attempt - 1, F.lit(0))) * 100, F.lit(30_000).cast("long")).alias("jitter_bound_ms"))


@query("X17_ramp_step", "SELECT event_id, CASE WHEN event_type = 'error' THEN r ELSE coalesce(list_min(list_filter([0.0, 0.05, 0.1, 0.25, 0.5, 1.0]::DOUBLE[], lambda x: x > r)), 1.0) END AS next_rate FROM (SELECT event_id, event_type, (event_id % 11) / 10.0::DOUBLE AS r FROM events)")
def ramp_step(spark, d):
    rate = (F.col("event_id") % 11) / 10.0
    steps = F.array(*[F.lit(x) for x in (0.0, 0.05, 0.1, 0.25, 0.5, 1.0)])
    following = F.coalesce(F.array_min(F.filter(steps, lambda s: s > rate)), F.lit(1.0))
    return D.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", rate).otherwise(following).alias("next_rate"))


@query("X17b_priority_tier", "SELECT o_orderkey AS message_id, CASE WHEN o_custkey % 5 = 3 THEN 'HIGH' WHEN o_custkey % 5 IN (1, 2) THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM orders")
def priority_tier(spark, d):
    p = F.col("o_custkey") % 5
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), F.when(p == 3, "HIGH").when(p.between(1, 2), "MEDIUM").otherwise("LOW").alias("tier"))


@query("X18_json_fields", "SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.name'), 'none') AS name FROM events")
def json_fields(spark, d):
    j = F.from_json("props", "k long, name string")
    return D.table(spark, d, "events").select("event_id", F.coalesce(j["k"], F.lit(-1)).alias("k"), F.coalesce(j["name"], F.lit("none")).alias("name"))


@query("X19_key_composition", "SELECT event_id, user_id || ':' || event_type AS key, event_type AS tail FROM events")
def key_composition(spark, d):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return D.table(spark, d, "events").select("event_id", key.alias("key"), F.split_part(key, F.lit(":"), F.lit(2)).alias("tail"))


@query("X20_shard_hash", "SELECT event_id, ('0x' || md5(user_id::VARCHAR)[1:8])::BIGINT % 32 AS shard FROM events")
def shard_hash(spark, d):
    return D.table(spark, d, "events").select("event_id", (F.conv(F.substring(F.md5(F.col("user_id").cast("string")), 1, 8), 16, 10).cast("long") % 32).alias("shard"))


# validation


@query("V1_pipeline_graph", "SELECT c_custkey AS pipeline_id, list_filter([CASE WHEN c_custkey % 7 = 0 THEN 'entry_missing' WHEN c_custkey % 11 = 0 THEN 'entry_not_resolution' END, CASE WHEN c_custkey % 11 = 0 THEN 'rejected_unbilled:n1' END, CASE WHEN c_custkey % 5 IN (0, 1, 2) THEN 'rejected_unbilled:n2' END, CASE WHEN c_custkey % 5 = 2 THEN 'dangling:n2:REJECTED:n9' END, CASE WHEN c_custkey % 6 = 0 THEN 'dangling:n3:SUCCEEDED:n8' END], lambda x: x IS NOT NULL) AS errors FROM customer")
def pipeline_graph(spark, d):
    key = F.col("c_custkey")
    node = lambda i, stage, following: F.struct(F.lit(i).alias("node_id"), stage.alias("stage_name"), following.alias("following"))
    to = lambda *pairs: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in pairs])
    none = F.lit(None).cast("string")
    rejected = F.when(key % 5 == 1, "n4").when(key % 5 == 2, "n9").otherwise("n3")
    policy = F.when(key % 5 == 0, to("SUCCEEDED", "n3")).otherwise(to("SUCCEEDED", "n3", "REJECTED", rejected))
    nodes = F.array(
        node("n1", F.when(key % 11 == 0, "POLICY").otherwise("DESTINATION_RESOLUTION"), to("SUCCEEDED", "n2", "FAILED", none)),
        node("n2", F.lit("POLICY"), policy),
        node("n3", F.lit("BILLING"), to("SUCCEEDED", F.when(key % 6 == 0, "n8").otherwise("n4"))),
        node("n4", F.lit("ROUTING"), to("SUCCEEDED", none)),
    )
    return D.table(spark, d, "customer").select(key.alias("pipeline_id"), R.pipeline_errors(F.when(key % 7 == 0, "n0").otherwise("n1"), nodes).alias("errors"))


@query("V2_routing_table", "SELECT s_nationkey AS operator_id, bool_or(s_suppkey % 7 = 3) AS has_active, count(*) = count(DISTINCT s_suppkey % 10) AS unique_priorities FROM supplier GROUP BY 1")
def routing_table(spark, d):
    s = D.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("operator_id"))
    return s.agg(F.bool_or(F.col("s_suppkey") % 7 == 3).alias("has_active"), (F.count(F.lit(1)) == F.count_distinct(F.col("s_suppkey") % 10)).alias("unique_priorities"))


@query("V3_number_range", sql("SELECT range_start, position, range_end >= range_start AS valid, coalesce(range_start <= max(range_end) OVER (ORDER BY range_start, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS overlaps FROM rg WHERE position >= 0", "rg"))
def number_range(spark, d):
    """A range overlaps one before it if it starts before the furthest end so far. That end is kept by cell of 10**5 starts, and by area of
    10**5 cells, so no task sees more than one of either; areas are as few as 10**10 goes into the numbers."""
    from pyspark.sql import Window

    before = lambda of, by: F.max("end").over(Window.partitionBy(*of).orderBy(by).rowsBetween(Window.unboundedPreceding, -1))
    r = D.ranges(spark, d).withColumn("cell", F.floor(F.col("range_start") / 100_000))
    cells = r.groupBy("cell").agg(F.max("range_end").alias("end")).withColumn("area", F.floor(F.col("cell") / 100_000))
    areas = cells.groupBy("area").agg(F.max("end").alias("end")).select("area", before([], "area").alias("far"))
    reach = cells.withColumn("near", before(["area"], "cell")).join(areas, "area").select("cell", F.greatest("near", "far").alias("reach"))
    inside = Window.partitionBy("cell").orderBy("range_start", "position").rowsBetween(Window.unboundedPreceding, -1)
    rows = r.withColumn("own", F.max("range_end").over(inside)).join(reach, "cell")
    return rows.select("range_start", "position", (F.col("range_end") >= F.col("range_start")).alias("valid"), F.coalesce(F.col("range_start") <= F.greatest("own", "reach"), F.lit(False)).alias("overlaps"))


@query("V4_check_constraints", sql("SELECT l_orderkey, l_linenumber, l_partkey, (entry_type = 'compensating') = (l_partkey % 3 = 0) AS source_ok, amount > 0 AS amount_ok FROM lg", "lg"))
def check_constraints(spark, d):
    rows = D.ledger(spark, d).withColumn("source_charge_id", F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", ((F.col("entry_type") == "compensating") == F.col("source_charge_id").isNotNull()).alias("source_ok"), (F.col("amount") > 0).alias("amount_ok"))


@query("V4_case_constraints", "SELECT o_orderkey AS case_id, o_orderkey % 5 <> 4 AS status_ok, o_orderkey % 5 = 0 OR o_orderkey % 3 > 0 AS resolved_ok FROM orders")
def case_constraints(spark, d):
    """Only an open case can be without the time that it was resolved at."""
    key = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("open", "resolved", "unresolved", "resolved", "closed"))), (key % 5 + 1).cast("int"))
    rows = D.table(spark, d, "orders").select(key.alias("case_id"), status.alias("status"), F.when(key % 3 > 0, F.col("o_orderdate")).alias("resolved_at"))
    return rows.select("case_id", F.col("status").isin("open", "resolved", "unresolved").alias("status_ok"), ((F.col("status") == "open") | F.col("resolved_at").isNotNull()).alias("resolved_ok"))


@query("V5_control_record", "SELECT event_id, event_id % 9 <> 0 AND value / 100 BETWEEN 0 AND 1 AND (event_type = 'error') = (event_id % 2 = 0) AS valid FROM events")
def control_record(spark, d):
    rate = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100)
    scope = (F.col("event_type") == "error") == (F.col("event_id") % 2 == 0)
    return D.table(spark, d, "events").select("event_id", (~F.isnan(rate) & rate.between(0, 1) & scope).alias("valid"))


@query("V6_late_rows", f"SELECT count(*) FILTER (WHERE ts < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR) AS too_old, count(*) FILTER (WHERE ts > TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR) AS too_new, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR AND TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR) AS accepted FROM events")
def late_rows(spark, d):
    old, new = F.col("ts") < as_of() - F.expr("INTERVAL 48 HOURS"), F.col("ts") > as_of() + F.expr("INTERVAL 24 HOURS")
    return D.table(spark, d, "events").agg(F.count_if(old).alias("too_old"), F.count_if(new).alias("too_new"), F.count_if(~old & ~new).alias("accepted"))


@query("V7_consent_payload", "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'unreadable' WHEN event_id % 7 IN (0, 1) THEN 'no_msisdn' WHEN event_id % 5 = 2 THEN 'unknown_scope_type' WHEN event_id % 4 IN (2, 3) THEN 'unknown_status' ELSE '' END AS error FROM events")
def consent_payload(spark, d):
    key = F.col("event_id")
    fields = F.struct(F.when(key % 7 == 0, "").when(key % 7 != 1, "998901234567").alias("msisdn"), F.element_at(F.array(*map(F.lit, ("CATEGORY", "SENDER", "sender", "CATEGORY", "SENDER"))), (key % 5 + 1).cast("int")).alias("scope_type"), F.col("event_type").alias("scope_value"))
    payload = F.when(key % 13 == 0, F.concat(F.lit("{"), F.to_json(fields))).otherwise(F.to_json(fields))
    status = F.when(key % 4 == 0, "active").when(key % 4 == 1, "archived").when(key % 4 == 2, "Active")
    return D.table(spark, d, "events").select("event_id", R.consent_error(payload, status).alias("error"))


@query("V9_all_errors", "SELECT doc_id, list_filter([CASE WHEN doc_id % 6 IN (0, 1) THEN 'empty_destination' END, CASE WHEN octet_length(encode(text)) > 254 THEN 'message_too_long' END, CASE WHEN doc_id % 6 = 2 THEN 'destination_too_long' END], lambda x: x IS NOT NULL) AS errors, doc_id % 6 > 2 AND octet_length(encode(text)) <= 254 AS valid FROM (SELECT doc_id, substr(text, 1, CASE WHEN doc_id % 4 > 0 THEN 100 ELSE 1000000 END) AS text FROM documents)")
def all_errors(spark, d):
    kind = F.col("doc_id") % 6
    to = F.when(kind == 0, F.lit("")).when(kind == 2, F.repeat(F.lit("9"), F.lit(22))).when(kind == 3, F.repeat(F.lit("9"), F.lit(21))).when(kind > 3, "998901234567")
    body = F.when(F.col("doc_id") % 4 > 0, F.substring("text", 1, 100)).otherwise(F.col("text"))
    errors = R.submit_errors(F.col("to"), F.col("body"))
    return D.table(spark, d, "documents").select("doc_id", to.alias("to"), body.alias("body")).select("doc_id", errors.alias("errors"), (F.size(errors) == 0).alias("valid"))


# decisions


@query("T6_deadline_sweep", f"SELECT event_id FROM events WHERE ts + INTERVAL 30 MINUTE <= TIMESTAMP '{AS_OF}' AND event_type = 'click'")
def deadline_sweep(spark, d):
    return D.table(spark, d, "events").filter((F.col("ts") + F.expr("INTERVAL 30 MINUTES") <= as_of()) & (F.col("event_type") == "click")).select("event_id")


@query("T7_sweep_decision", "SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'HOLD' WHEN event_id % 6 < user_id % 4 THEN 'RETRY' WHEN user_id % 4 = 0 THEN 'TIMEOUT' ELSE 'DLQ' END AS decision FROM events")
def sweep_decision(spark, d):
    attempt, most = F.col("event_id") % 6, F.col("user_id") % 4
    return D.table(spark, d, "events").select("event_id", F.when(F.col("user_id") % 10 == 0, "HOLD").when(attempt < most, "RETRY").when(most == 0, "TIMEOUT").otherwise("DLQ").alias("decision"))


@query("T9_due_tasks", f"SELECT event_id, CASE event_type WHEN 'view' THEN 'retry' WHEN 'click' THEN 'notify' ELSE 'reconcile' END AS sink FROM events WHERE ts <= TIMESTAMP '{AS_OF}' ORDER BY ts, event_id")
def due_tasks(spark, d):
    rows = D.table(spark, d, "events").filter(F.col("ts") <= as_of())
    return rows.orderBy("ts", "event_id").select("event_id", F.when(F.col("event_type") == "view", "retry").when(F.col("event_type") == "click", "notify").otherwise("reconcile").alias("sink"))


@query("T10_receipt_decision", f"SELECT r.event_id, CASE WHEN r.value < 5 THEN 'DROP' WHEN s.event_id IS NOT NULL THEN 'PUBLISH' WHEN TIMESTAMP '{AS_OF}' < r.ts + INTERVAL 48 HOUR THEN 'RETRY' ELSE 'DLQ' END AS decision FROM (SELECT * FROM events WHERE event_type = 'purchase') r ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click' AND value > 60) s ON r.user_id = s.user_id AND r.ts >= s.ts")
def receipt_decision(spark, d):
    from relaywright.operators.core import asof_join

    e = D.table(spark, d, "events")
    receipts = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    submitted = e.filter("event_type = 'click' AND value > 60").select("user_id", F.col("ts").alias("at"), F.col("event_id").alias("submission_id"))
    rows = asof_join(receipts, submitted, ["user_id"], "ts", "at", ["submission_id"])
    return rows.select("event_id", F.when(F.col("value") < 5, "DROP").when(F.col("submission_id").isNotNull(), "PUBLISH").when(as_of() < F.col("ts") + F.expr("INTERVAL 48 HOURS"), "RETRY").otherwise("DLQ").alias("decision"))


_EVIDENCE = "SELECT event_id // 3 AS message_id, bool_or(event_type = 'purchase') AS submitted, bool_or(event_type = 'error' AND value > 30) AS conclusive, arg_max(event_type, event_id) FILTER (WHERE event_type IN ('view', 'signup')) AS delivery_status FROM events GROUP BY 1"


def _evidence(spark, d):
    kind = F.col("event_type")
    rows = D.table(spark, d, "events").groupBy(F.expr("event_id div 3").alias("message_id"))
    last = F.max_by(F.when(kind.isin("view", "signup"), kind), F.when(kind.isin("view", "signup"), F.col("event_id")))
    return rows.agg(F.bool_or(kind == "purchase").alias("submitted"), F.bool_or((kind == "error") & (F.col("value") > 30)).alias("conclusive"), last.alias("delivery_status"))


@query("T11_evidence_merge", _EVIDENCE)
def evidence_merge(spark, d):
    return _evidence(spark, d)


@query("T12_evidence_outcome", f"SELECT message_id, CASE WHEN delivery_status IS NOT NULL THEN upper(delivery_status) WHEN conclusive THEN 'QUERY' WHEN message_id % 3 = 0 THEN 'NONE' WHEN message_id % 5 = 0 THEN 'INCONCLUSIVE' WHEN submitted THEN 'SUBMIT_ACCEPTED' ELSE 'NOT_SUBMITTED' END AS outcome FROM ({_EVIDENCE})")
def evidence_outcome(spark, d):
    expired = F.col("message_id") % 3 != 0
    outcome = F.when(F.col("delivery_status").isNotNull(), F.upper("delivery_status")).when(F.col("conclusive"), "QUERY").when(~expired, "NONE").when(F.col("message_id") % 5 == 0, "INCONCLUSIVE").when(F.col("submitted"), "SUBMIT_ACCEPTED").otherwise("NOT_SUBMITTED")
    return _evidence(spark, d).select("message_id", outcome.alias("outcome"))


@query("T13_purge_by_age", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY")
def purge_by_age(spark, d):
    return D.table(spark, d, "events").filter(F.col("ts") >= as_of() - F.expr("INTERVAL 7 DAYS")).select("event_id")


@query("T14_versioned_projection", sql("SELECT entity_type, entity_id, version, status, CASE WHEN status = 'active' THEN id END AS current_id FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY version DESC, status = 'archived' DESC, id DESC) AS rn FROM cfg) WHERE rn = 1", "cfg"))
def versioned_projection(spark, d):
    top = latest(D.configs(spark, d), ["entity_type", "entity_id"], [F.desc("version"), F.desc(F.col("status") == "archived"), F.desc("id")])
    return top.select("entity_type", "entity_id", "version", "status", F.when(F.col("status") == "active", F.col("id")).alias("current_id"))


@query("T15_consent_projection", "SELECT user_id, k FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, arg_max(event_type, event_id) AS last FROM events GROUP BY ALL) WHERE last <> 'error'")
def consent_projection(spark, d):
    e = D.table(spark, d, "events").select("user_id", F.from_json("props", "k long")["k"].alias("k"), "event_type", "event_id")
    return e.groupBy("user_id", "k").agg(F.max_by("event_type", "event_id").alias("last")).filter("last <> 'error'").select("user_id", "k")


@query("T18_first_claim", "SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) = 1 AS won, first_value(event_id) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS claimed_by FROM events")
def first_claim(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", F.date_trunc("day", "ts")).orderBy("ts", "event_id")
    return D.table(spark, d, "events").select("event_id", (F.row_number().over(w) == 1).alias("won"), F.first("event_id").over(w).alias("claimed_by"))


_CONTROLS_19 = "SELECT event_id % 5 AS cluster, CASE event_id // 5 % 5 WHEN 0 THEN 'GLOBAL' WHEN 1 THEN 'STAGE' WHEN 2 THEN 'PARTNER' WHEN 3 THEN 'PARTNER_STAGE' ELSE 'OPERATOR_ROUTE' END AS scope, CASE event_id // 5 % 5 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN 'p' || user_id % 10 WHEN 3 THEN 'p' || user_id % 10 || ':' || event_type ELSE 'r' || user_id % 7 END AS scope_id, arg_max(value < 30 OR round(value) % 5 = 0, event_id) AS blocked FROM events WHERE NOT (event_id % 5 = 3 AND event_id // 5 % 5 = 0) AND NOT (event_id % 5 = 1 AND event_id // 5 % 5 = 0 AND value < 30) GROUP BY ALL"


@query("T19_admission", f"WITH c AS ({_CONTROLS_19}), m AS (SELECT o_orderkey AS message_id, o_custkey % 5 AS cluster, 'p' || o_custkey % 10 AS partner, list_element(['view', 'click', 'signup', 'purchase', 'error'], (o_orderkey % 5 + 1)::INTEGER) AS stage, CASE WHEN o_orderkey % 6 > 0 THEN 'r' || o_orderkey % 7 ELSE '' END AS route FROM orders), k AS (SELECT m.message_id, c.scope, c.scope_id, list_position(['PARTNER', 'PARTNER_STAGE', 'OPERATOR_ROUTE', 'STAGE', 'GLOBAL'], c.scope) AS rank FROM m JOIN c ON c.cluster = m.cluster AND c.blocked AND (c.scope = 'PARTNER' AND c.scope_id = partner OR c.scope = 'PARTNER_STAGE' AND c.scope_id = partner || ':' || stage OR c.scope = 'OPERATOR_ROUTE' AND c.scope_id = route OR c.scope = 'STAGE' AND c.scope_id = stage OR c.scope = 'GLOBAL')) SELECT m.message_id, CASE WHEN NOT EXISTS (SELECT 1 FROM c WHERE c.cluster = m.cluster AND c.scope = 'GLOBAL') THEN 'HOLD:GLOBAL:' ELSE coalesce((SELECT arg_min('HOLD:' || scope || ':' || scope_id, rank) FROM k WHERE k.message_id = m.message_id), 'ADMIT') END AS decision FROM m")
def admission(spark, d):
    """Control records of five scopes in five clusters, one of which has none for all messages; the narrowest scope that blocks is named."""
    key, n = F.col("event_id"), F.expr("event_id div 5") % 5
    partner = F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string"))
    scope = F.element_at(F.array(*map(F.lit, ("GLOBAL", "STAGE", "PARTNER", "PARTNER_STAGE", "OPERATOR_ROUTE"))), (n + 1).cast("int"))
    scope_id = F.when(n == 0, "").when(n == 1, F.col("event_type")).when(n == 2, partner).when(n == 3, F.concat_ws(":", partner, "event_type")).otherwise(F.concat(F.lit("r"), (F.col("user_id") % 7).cast("string")))
    state = F.when(F.col("value") < 30, "PAUSED").otherwise("ACTIVE")
    rate = F.round("value") % 5 / 4
    log = D.table(spark, d, "events").filter(~((key % 5 == 3) & (n == 0)) & ~((key % 5 == 1) & (n == 0) & (F.col("value") < 30))).select((key % 5).alias("cluster"), scope.alias("scope"), scope_id.alias("scope_id"), F.struct(state.alias("state"), rate.alias("rate")).alias("r"), "event_id")
    records = log.groupBy("cluster", "scope", "scope_id").agg(F.max_by("r", "event_id").alias("r"))
    blocking = records.filter((F.col("r.state") == "PAUSED") | (F.col("r.rate") <= 0))
    order = D.table(spark, d, "orders")
    stage = F.element_at(F.array(*map(F.lit, D.STAGES)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    rows = order.select(F.col("o_orderkey").alias("message_id"), (F.col("o_custkey") % 5).alias("cluster"), F.concat(F.lit("p"), (F.col("o_custkey") % 10).cast("string")).alias("partner"), stage.alias("stage"), F.when(F.col("o_orderkey") % 6 > 0, F.concat(F.lit("r"), (F.col("o_orderkey") % 7).cast("string"))).otherwise("").alias("route"))
    names = {"PARTNER": F.col("partner"), "PARTNER_STAGE": F.concat_ws(":", "partner", "stage"), "OPERATOR_ROUTE": F.col("route"), "STAGE": F.col("stage"), "GLOBAL": F.lit("")}
    for name, own in names.items():
        mine = blocking.filter(F.col("scope") == name).select("cluster", F.col("scope_id").alias(f"{name}_id"), F.concat_ws(":", F.lit("HOLD"), "scope", "scope_id").alias(f"{name}_hold"))
        rows = rows.withColumn(f"{name}_id", own).join(mine, ["cluster", f"{name}_id"], "left")
    known = records.filter("scope = 'GLOBAL'").select("cluster", F.lit(True).alias("known"))
    rows = rows.join(known, "cluster", "left")
    return rows.select("message_id", F.when(F.col("known").isNull(), "HOLD:GLOBAL:").otherwise(F.coalesce(*(f"{n}_hold" for n in names), F.lit("ADMIT"))).alias("decision"))


@query("T21_replay_gates", sql(f"SELECT m.message_id, CASE WHEN created_at < TIMESTAMP '1996-01-01' THEN 'EXPIRED' WHEN terminal THEN 'TERMINAL' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = m.message_id AND l_returnflag = 'R') THEN 'BILLED' WHEN EXISTS (SELECT 1 FROM events WHERE event_id = m.message_id AND event_type = 'purchase') THEN 'DELIVERED' ELSE 'REPLAY' END AS gate FROM msg m", "msg"))
def replay_gates(spark, d):
    billed = D.table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("message_id")).distinct().withColumn("billed", F.lit(True))
    sent = D.table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("message_id"), F.lit(True).alias("sent"))
    rows = D.messages(spark, d).join(billed, "message_id", "left").join(sent, "message_id", "left")
    return rows.select("message_id", F.when(F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz"), "EXPIRED").when(F.col("terminal"), "TERMINAL").when(F.col("billed"), "BILLED").when(F.col("sent"), "DELIVERED").otherwise("REPLAY").alias("gate"))


@query("T22_notification_ttl", f"SELECT event_id, TIMESTAMP '{AS_OF}' < ts + INTERVAL 24 HOUR AS live FROM events")
def notification_ttl(spark, d):
    return D.table(spark, d, "events").select("event_id", (as_of() < F.col("ts") + F.expr("INTERVAL 24 HOURS")).alias("live"))


@query("T23_retention", f"SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE date_trunc('hour', ts) >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR GROUP BY 1")
def retention(spark, d):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return D.table(spark, d, "events").filter(hour >= as_of() - F.expr("INTERVAL 72 HOURS")).groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("V8_json_structure", "SELECT event_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM events")
def json_structure(spark, d):
    """Documents that lack the required field, or hold it with another type, aren't valid."""
    from relaywright.sources.files import conforms

    doc = F.when(F.col("event_id") % 5 == 0, F.lit('{"other": 1}')).when(F.col("event_id") % 7 == 0, F.lit('{"k": "text"}')).otherwise(F.col("props"))
    return D.table(spark, d, "events").select("event_id", conforms(doc, "k long", ["k"]).alias("valid"))
