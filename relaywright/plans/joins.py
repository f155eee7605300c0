"""Joins: equality, outer, semi, anti, as-of, range and overlay."""

from __future__ import annotations

from pyspark.sql import functions as F

from relaywright.operators.core import asof_join, range_lookup
from relaywright.plans.registry import query
from relaywright.sources import domain as D
from relaywright.sources.domain import sql


@query("J1_permission_check", "SELECT DISTINCT c.c_custkey AS account_id, r.r_name AS permission FROM (SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 13 <> 0) a JOIN customer c ON a.c_custkey = c.c_custkey JOIN nation n ON a.c_nationkey = n.n_nationkey JOIN supplier s ON s.s_nationkey = n.n_nationkey JOIN region r ON r.r_regionkey = (n.n_regionkey + s.s_suppkey) % 5 WHERE c.c_acctbal > 0")
def permission_check(spark, d):
    c, n, s, r = (D.table(spark, d, t) for t in ("customer", "nation", "supplier", "region"))
    accounts = c.filter("c_acctbal > 0").select(F.col("c_custkey").alias("account_id"))
    assigned = c.filter("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("role_id"))
    # a role's permissions don't hang on the account: distinct before the large side is joined
    granted = n.join(s, n.n_nationkey == s.s_nationkey).select(F.col("n_nationkey").alias("role_id"), ((F.col("n_regionkey") + F.col("s_suppkey")) % 5).alias("permission_id")).distinct()
    named = granted.join(r, granted.permission_id == r.r_regionkey).select("role_id", F.col("r_name").alias("permission"))
    return assigned.join(accounts, "account_id").join(named, "role_id").select("account_id", "permission").distinct()


@query("J2_grouped_array", "SELECT n_nationkey AS role_id, coalesce(array_agg(s_suppkey ORDER BY s_suppkey) FILTER (WHERE s_suppkey IS NOT NULL), []) AS members FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 4000) ON s_nationkey = n_nationkey LEFT JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def grouped_array(spark, d):
    n, r = D.table(spark, d, "nation"), D.table(spark, d, "region")
    s = D.table(spark, d, "supplier").filter("s_acctbal > 4000")
    rows = n.join(s, n.n_nationkey == s.s_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left")
    return rows.groupBy(F.col("n_nationkey").alias("role_id")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("members"))


@query("J3_nullable_filter_join", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2 ORDER BY c_custkey")
def nullable_filter_join(spark, d):
    c, n = D.table(spark, d, "customer"), D.table(spark, d, "nation").filter("n_regionkey = 2")
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name").orderBy("c_custkey")


@query("J4_predicate_in_on", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 7000")
def predicate_in_on(spark, d):
    n, s = D.table(spark, d, "nation"), D.table(spark, d, "supplier")
    return n.join(s, (n.n_nationkey == s.s_nationkey) & (s.s_acctbal > 7000), "left").select("n_nationkey", "s_suppkey")


@query("J5_threads_with_unread", sql("SELECT l.partner_id, l.id AS last_id, coalesce(u.n, 0) AS unread FROM (SELECT partner_id, max(id) AS id FROM chat GROUP BY 1) l LEFT JOIN (SELECT partner_id, count(*) AS n FROM chat WHERE sender_type = 'partner' AND NOT is_read OR turn % 4 = 0 GROUP BY 1) u USING (partner_id)", "chat"))
def threads_with_unread(spark, d):
    rows = D.chats(spark, d)
    last = rows.groupBy("partner_id").agg(F.max("id").alias("last_id"))
    unread = rows.filter("sender_type = 'partner' AND NOT is_read OR turn % 4 = 0").groupBy("partner_id").agg(F.count(F.lit(1)).alias("n"))
    return last.join(unread, "partner_id", "left").select("partner_id", "last_id", F.coalesce("n", F.lit(0)).alias("unread"))


@query("J7_cross_join_seed", "SELECT n_nationkey AS role_id, r_regionkey AS permission_id FROM nation, region WHERE n_nationkey % 5 >= r_regionkey")
def cross_join_seed(spark, d):
    n, r = D.table(spark, d, "nation"), D.table(spark, d, "region")  # 25 and 5 rows at any scale
    return n.crossJoin(r).filter("n_nationkey % 5 >= r_regionkey").select(F.col("n_nationkey").alias("role_id"), F.col("r_regionkey").alias("permission_id"))


@query("J8_anti_join_distinct", "SELECT DISTINCT c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')")
def anti_join_distinct(spark, d):
    o = D.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return D.table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_nationkey").distinct()


@query("J9_semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def semi_join(spark, d):
    o = D.table(spark, d, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return D.table(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@query("J10_scalar_subquery", "SELECT c_custkey FROM customer WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7')")
def scalar_subquery(spark, d):
    n = D.table(spark, d, "nation").filter("n_name = 'NATION_7'").select("n_nationkey").scalar()
    return D.table(spark, d, "customer").filter(F.col("c_nationkey") == n).select("c_custkey")


_ASOF = "SELECT r.event_id, s.event_id AS submission_id, s.ts AS submitted_at FROM (SELECT * FROM events WHERE event_type = 'purchase') r ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') s ON r.user_id = s.user_id AND r.ts >= s.ts"


def _receipts(spark, d):
    e = D.table(spark, d, "events")
    receipts = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "value")
    submissions = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("submitted_at"), F.col("event_id").alias("submission_id"))
    return receipts, submissions


def _correlated(spark, d):
    receipts, submissions = _receipts(spark, d)
    return asof_join(receipts, submissions, ["user_id"], "ts", "submitted_at", ["submission_id", "submitted_at"])


@query("J11_asof_correlation", _ASOF)
def asof_correlation(spark, d):
    return _correlated(spark, d).select("event_id", "submission_id", "submitted_at")


@query("J12_asof_fast_path", f"SELECT a.event_id, coalesce(CASE WHEN a.event_id % 4 = 0 AND f.ts <= a.ts THEN f.event_id END, a.submission_id) AS submission_id FROM (SELECT x.*, e.user_id, e.ts FROM ({_ASOF}) x JOIN events e USING (event_id)) a LEFT JOIN (SELECT user_id, min(event_id) AS event_id, arg_min(ts, event_id) AS ts FROM events WHERE event_type = 'click' GROUP BY 1) f ON f.user_id = a.user_id")
def asof_fast_path(spark, d):
    receipts, submissions = _receipts(spark, d)
    cache = submissions.groupBy("user_id").agg(F.min_by(F.struct("submission_id", "submitted_at"), "submission_id").alias("hit"))
    rows = asof_join(receipts, submissions, ["user_id"], "ts", "submitted_at", ["submission_id"]).join(cache, "user_id", "left")
    fast = F.when((F.col("event_id") % 4 == 0) & (F.col("hit.submitted_at") <= F.col("ts")), F.col("hit.submission_id"))
    return rows.select("event_id", F.coalesce(fast, "submission_id").alias("submission_id"))


_RANGE = "SELECT message_id, arg_min(operator_id, position) AS operator_id FROM num LEFT JOIN rg ON TRY_CAST(msisdn AS BIGINT) BETWEEN range_start AND range_end GROUP BY 1"


def _ranged(spark, d):
    points = D.numbers(spark, d).select("message_id", "msisdn", F.expr("try_cast(msisdn AS BIGINT)").alias("number"))
    return range_lookup(points, D.ranges(spark, d), "number", "range_start", "range_end", "position", "operator_id")


@query("J13_range_lookup", sql(_RANGE, "rg", "num"))
def range_lookup_query(spark, d):
    return _ranged(spark, d).select("message_id", "operator_id")


@query("J14_ported_then_range", sql(f"SELECT num.message_id, coalesce(por.operator_id, x.operator_id, 'NOT_FOUND') AS operator_id FROM num LEFT JOIN por USING (msisdn) LEFT JOIN ({_RANGE}) x ON x.message_id = num.message_id", "rg", "num", "por"))
def ported_then_range(spark, d):
    exact = D.ported(spark, d).withColumnRenamed("operator_id", "ported")
    rows = _ranged(spark, d).join(exact, "msisdn", "left")
    return rows.select("message_id", F.coalesce("ported", "operator_id", F.lit("NOT_FOUND")).alias("operator_id"))


@query("J15_two_step_lookup", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_orderkey = 77 OR l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 77)")
def two_step_lookup(spark, d):
    li = D.table(spark, d, "lineitem")
    parts = li.filter("l_orderkey = 77").select("l_partkey").distinct()
    direct = li.filter("l_orderkey = 77")
    other = li.filter("l_orderkey <> 77").join(parts, "l_partkey", "left_semi")
    columns = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return direct.select(*columns).unionByName(other.select(*columns))


@query("J16_enrich_from_snapshot", sql("SELECT event_id, se.message_id, msg.priority, msg.current_status FROM se LEFT JOIN msg ON msg.message_id = se.message_id", "se", "msg"))
def enrich_from_snapshot(spark, d):
    return D.stage_events(spark, d).select("event_id", "message_id").join(D.messages(spark, d).select("message_id", "priority", "current_status"), "message_id", "left").select("event_id", "message_id", "priority", "current_status")


@query("J17_overlay_join", sql("SELECT s.id, coalesce(l.payload, s.payload) AS payload FROM cfg s LEFT JOIN (SELECT id - 1 AS id, payload, status FROM cfg WHERE id % 3 = 1) l USING (id) WHERE s.id % 3 = 0 AND coalesce(l.status, 'active') <> 'archived'", "cfg"))
def overlay_join(spark, d):
    rows = D.configs(spark, d)
    static = rows.filter("id % 3 = 0").select("id", F.col("payload").alias("base"))
    live = rows.filter("id % 3 = 1").select((F.col("id") - 1).alias("id"), "payload", "status")
    merged = static.join(live, "id", "left").filter(F.coalesce("status", F.lit("active")) != "archived")
    return merged.select("id", F.coalesce("payload", "base").alias("payload"))


@query("J18_set_membership", "SELECT event_id, user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 1000) AS listed FROM events")
def set_membership(spark, d):
    listed = D.table(spark, d, "customer").filter("c_acctbal < 1000").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("hit"))
    return D.table(spark, d, "events").select("event_id", "user_id").join(listed, "user_id", "left").select("event_id", F.coalesce("hit", F.lit(False)).alias("listed"))


@query("J19_deadline_lookup", "SELECT e.event_id, o.o_orderkey AS message_id FROM events e JOIN orders o ON o.o_orderkey = e.event_id * 3 WHERE e.value > 100")
def deadline_lookup(spark, d):
    e = D.table(spark, d, "events").filter("value > 100").select("event_id", (F.col("event_id") * 3).alias("message_id"))
    return e.join(D.table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id")), "message_id").select("event_id", "message_id")


@query("J20_lookup_with_default", "SELECT o_orderkey AS message_id, coalesce(p.p_retailprice, 1.5) AS tariff FROM orders LEFT JOIN (SELECT s_suppkey, s_suppkey * 3 AS pointer FROM supplier WHERE s_suppkey % 3 <> 0) v ON v.s_suppkey = o_custkey % 20 LEFT JOIN part p ON p.p_partkey = v.pointer AND p.p_partkey % 2 = 1")
def lookup_with_default(spark, d):
    versions = D.table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("partner"), (F.col("s_suppkey") * 3).alias("p_partkey"))
    payloads = D.table(spark, d, "part").filter("p_partkey % 2 = 1").select("p_partkey", "p_retailprice")
    rows = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("message_id"), (F.col("o_custkey") % 20).alias("partner"))
    return rows.join(versions, "partner", "left").join(payloads, "p_partkey", "left").select("message_id", F.coalesce("p_retailprice", F.lit(1.5)).alias("tariff"))


@query("J21_nested_application", "SELECT c_custkey AS partner_id, CASE WHEN c_custkey % 3 = 0 THEN 'SMPP_BIND' WHEN c_custkey % 3 = 1 THEN 'CALLBACK' ELSE 'ERROR' END AS channel, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 + 2 ELSE c_custkey * 10 + 1 END AS application_id FROM customer")
def nested_application(spark, d):
    """The application asked for by id, or the first; its channel by what it has."""
    key = F.col("c_custkey")
    app = lambda n: F.struct((key * 10 + n).alias("id"), F.when(key % 3 == 0, F.lit("bind")).alias("bind"), F.when(key % 3 == 1, F.lit("https://callback")).alias("url"))
    rows = D.table(spark, d, "customer").select(key, F.array(app(1), app(2), app(3)).alias("apps"), F.when(key % 2 == 0, key * 10 + 2).alias("asked"))
    found = F.coalesce(F.try_element_at(F.filter("apps", lambda a: a["id"] == F.col("asked")), F.lit(1)), F.element_at("apps", 1))
    rows = rows.withColumn("app", found)
    return rows.select(key.alias("partner_id"), F.when(F.col("app.bind").isNotNull(), "SMPP_BIND").when(F.col("app.url").isNotNull(), "CALLBACK").otherwise("ERROR").alias("channel"), F.col("app.id").alias("application_id"))


@query("J22_version_pair", sql("SELECT a.entity_type, a.entity_id, min(a.payload) AS payload_a, max(b.payload) AS payload_b FROM cfg a JOIN cfg b USING (entity_type, entity_id) WHERE a.version = 10 AND b.version = 20 GROUP BY ALL", "cfg"))
def version_pair(spark, d):
    rows = D.configs(spark, d)
    a = rows.filter("version = 10").groupBy("entity_type", "entity_id").agg(F.min("payload").alias("payload_a"))
    b = rows.filter("version = 20").groupBy("entity_type", "entity_id").agg(F.max("payload").alias("payload_b"))
    return a.join(b, ["entity_type", "entity_id"])


@query("J6_outbox_versions", sql("SELECT o.id, o.entity_type, v.version FROM (SELECT id, entity_type, entity_id FROM cfg WHERE id % 7 = 0) o LEFT JOIN (SELECT entity_type, entity_id, max(version) AS version FROM cfg WHERE version < 15 GROUP BY ALL) v USING (entity_type, entity_id)", "cfg"))
def outbox_versions(spark, d):
    rows = D.configs(spark, d)
    versions = rows.filter("version < 15").groupBy("entity_type", "entity_id").agg(F.max("version").alias("version"))
    return rows.filter("id % 7 = 0").select("id", "entity_type", "entity_id").join(versions, ["entity_type", "entity_id"], "left").select("id", "entity_type", "version")
