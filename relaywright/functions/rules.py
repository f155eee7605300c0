"""Rules of the message path as columns: request checks, classes of outcomes, effective control records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_SENDER, MAX_BODY, MAX_IDEMPOTENCY_KEY, MAX_PRIORITY = 21, 1600, 128, 3


def request_error(partner: Column, application: Column, api_key: Column, remote_ip: Column, body_json: Column, idempotency_key: Column) -> Column:
    """The first rule that a request breaks, '' if none. Headers come first, then the JSON body field by field; types are strict."""
    v = F.try_parse_json(body_json)
    field = lambda name: F.try_variant_get(v, f"$.{name}", "string")
    kind = lambda name: F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    missing = lambda c: F.coalesce(c == "", F.lit(True))
    texts = [F.coalesce(kind(n) == "STRING", F.lit(False)) for n in ("msisdn", "sender_id", "body")]
    priority = F.try_variant_get(v, "$.priority", "long")
    numeric = F.coalesce(kind("priority").isin("BIGINT", "VOID"), F.lit(True)) & F.coalesce(priority.between(0, 255), F.lit(True))
    readable = v.isNotNull() & texts[0] & texts[1] & texts[2] & numeric
    rules = [
        (missing(partner), "missing_partner_id"),
        (missing(application), "missing_application_id"),
        (missing(api_key), "missing_api_key"),
        (remote_ip.isNull(), "missing_remote_ip"),
        (~readable, "invalid_json_body"),
        (field("msisdn") == "", "empty_msisdn"),
        (~field("msisdn").rlike("^[0-9]{9,15}$"), "invalid_msisdn"),
        (field("sender_id") == "", "empty_sender_id"),
        (F.char_length(field("sender_id")) > MAX_SENDER, "sender_id_too_long"),
        (~field("sender_id").rlike("^[ -~]*$"), "invalid_sender_id"),
        (field("body") == "", "empty_body"),
        (F.char_length(field("body")) > MAX_BODY, "body_too_long"),
        (F.char_length(idempotency_key) > MAX_IDEMPOTENCY_KEY, "idempotency_key_too_long"),
        (priority > MAX_PRIORITY, "invalid_priority"),
    ]
    found = F.lit("")
    for broken, name in reversed(rules):
        found = F.when(broken, F.lit(name)).otherwise(found)
    return found


#: What a reconciliation says of a message.
RECONCILED = {"CONFIRMED_SUBMITTED": "SUBMITTED", "CONFIRMED_NOT_SUBMITTED": "UNDELIVERABLE", "DELIVERY_CONFIRMED": "DELIVERED", "DELIVERY_FAILED": "UNDELIVERABLE", "DELIVERY_UNRESOLVED": "DELIVERY_UNRESOLVED"}
DELIVERED = {"SUCCEEDED": "SUBMITTED", "FAILED": "UNDELIVERABLE", "TIMED_OUT": "SYSTEM_UNAVAILABLE", "RETRY_EXHAUSTED": "SYSTEM_UNAVAILABLE"}


def candidate_status(stage: Column, outcome: Column, retryable: Column, reconciliation: Column) -> Column:
    """The status that a completed stage proposes: none while it will be retried, none from billing, from inner stages only their failure."""
    named = lambda of, values: F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), of)
    inner = stage.isin("DESTINATION_RESOLUTION", "ROUTING") & outcome.isin("REJECTED", "FAILED", "TIMED_OUT", "RETRY_EXHAUSTED")
    status = F.when(stage == "DELIVERY", named(outcome, DELIVERED)).when(stage == "DELIVERY_RECONCILIATION", named(reconciliation, RECONCILED))
    status = status.when((stage == "POLICY") & (outcome == "REJECTED"), "REJECTED").when(inner, "FAILED")
    return F.when(~F.coalesce(retryable, F.lit(False)), status)


# fixed values: reasons of a failed submission that are worth another try
RETRYABLE = ("TPS_THROTTLED", "PACER_QUEUE_FULL", "PACER_QUEUE_TIMEOUT", "SUBMIT_TIMEOUT", "GATEWAY_INSTANCE_NOT_FOUND", "AMBIGUOUS_PRIOR_ATTEMPT_NOT_RESUBMITTED")


def retryable_reason(reason: Column) -> Column:
    """Whether a failed submission is worth another try; a status that the operator gave isn't, nor is an unknown reason or none."""
    return F.coalesce(~F.startswith(reason, F.lit("SMPP_STATUS_0x")) & reason.isin(*RETRYABLE), F.lit(False))


def admission_rate(overall: Column, partner: Column, now: Column) -> Column:
    """The rate at which a partner's messages are let in, null for none. `overall` and `partner` are structs of state, rate and expires_at, or null.

    A record counts until it expires. Without one for all, or with one that is paused, nothing is let in; a
    partner's own record can lower the rate or pause it.
    """
    counts = lambda r: r.isNotNull() & F.coalesce(r["expires_at"] > now, F.lit(True))
    open_ = counts(overall) & (overall["state"] != "PAUSED")
    own = counts(partner)
    return F.when(open_ & ~(own & F.coalesce(partner["state"] == "PAUSED", F.lit(False))), F.when(own, F.least(overall["rate"], partner["rate"])).otherwise(overall["rate"]))


def submit_errors(destination: Column, message: Column) -> Column:
    """All rules that a submission breaks."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(destination == "", F.lit(True)), "empty_destination"),
            F.when(F.octet_length(message) > 254, "message_too_long"),
            F.when(F.char_length(destination) > 21, "destination_too_long"),
        )
    )


def consent_error(payload: Column, status: Column) -> Column:
    """Why a consent change isn't applied, '' if it is."""
    v = F.try_parse_json(payload)
    field = lambda name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    return (
        F.when(v.isNull(), "unreadable")
        .when(field("msisdn") == "", "no_msisdn")
        .when(~field("scope_type").isin("CATEGORY", "SENDER"), "unknown_scope_type")
        .when(~F.coalesce(status.isin("active", "archived"), F.lit(False)), "unknown_status")
        .otherwise("")
    )


def pipeline_errors(entry: Column, nodes: Column) -> Column:
    """What is wrong with a pipeline. `nodes`: an array of structs of node_id, stage_name and following (a map of outcome to node, null where the run ends)."""
    stages = F.map_from_entries(F.transform(nodes, lambda n: F.struct(n["node_id"], n["stage_name"])))
    stage = lambda node: F.try_element_at(stages, node)
    start = F.when(stage(entry).isNull(), F.lit("entry_missing")).when(stage(entry) != "DESTINATION_RESOLUTION", "entry_not_resolution")
    policies = F.filter(nodes, lambda n: n["stage_name"] == "POLICY")
    unbilled = F.filter(policies, lambda n: F.coalesce(stage(F.try_element_at(n["following"], F.lit("REJECTED"))) != "BILLING", F.lit(True)))
    targets = F.flatten(F.transform(nodes, lambda n: F.transform(F.map_entries(n["following"]), lambda e: F.struct(n["node_id"].alias("node"), e["key"].alias("outcome"), e["value"].alias("target")))))
    dangling = F.filter(targets, lambda t: t["target"].isNotNull() & stage(t["target"]).isNull())
    return F.concat(
        F.array_compact(F.array(start)),
        F.transform(unbilled, lambda n: F.concat(F.lit("rejected_unbilled:"), n["node_id"])),
        F.transform(dangling, lambda t: F.concat_ws(":", F.lit("dangling"), t["node"], t["outcome"], t["target"])),
    )
