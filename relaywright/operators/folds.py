"""Ordered folds: logic whose output feeds its own state, key by key.

Rows are dealt by key, sorted within each partition, and read as a stream; the state of one key is held at
a time, so a key with any number of rows takes memory for its state alone. The step functions are plain
Python and serve the streaming processors too.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

Step = Callable[[Any, dict], tuple[Any, dict | list[dict] | None]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], step: Step, schema: str, start: Callable[[], Any] = lambda: None) -> DataFrame:
    """step(state, row) gives the next state and an output row, a list of them or None, for the rows of each key in order."""
    out = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    current, state = key, start()
                state, result = step(state, row)
                if isinstance(result, list):
                    rows.extend(result)
                elif result is not None:
                    rows.append(result)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *order).mapInArrow(run, out)


# message lifecycle

#: Where a message can start. Submission isn't always first: reconciliation can give the first status.
ENTRY = frozenset({"SUBMITTED", "REJECTED", "FAILED", "SYSTEM_UNAVAILABLE", "DELIVERED", "UNDELIVERABLE", "DELIVERY_UNRESOLVED"})
#: What may follow a status; all others are final.
FOLLOWS = {"SUBMITTED": frozenset({"DELIVERED", "UNDELIVERABLE"}), "DELIVERY_UNRESOLVED": frozenset({"LATE_DELIVERY_CONFIRMED"})}


def lifecycle_step(state, row):
    """VALID moves on and raises the version; DUPLICATE is the event applied last; anything else is a REGRESSION."""
    status, version, last = state or (None, 0, None)
    if last is not None and row["event_id"] == last:
        verdict = "DUPLICATE"
    elif row["status"] in (ENTRY if status is None else FOLLOWS.get(status, frozenset())):
        status, version, last, verdict = row["status"], version + 1, row["event_id"], "VALID"
    else:
        verdict = "REGRESSION"
    return (status, version, last), {"message_id": row["message_id"], "event_id": row["event_id"], "verdict": verdict, "status": status, "version": version}


LIFECYCLE_SCHEMA = "message_id long, event_id long, verdict string, status string, version int"


# limits and buckets


def sliding_limit_step(limit: int, window_ms: int):
    """At most `limit` accepted events in the last window, both ends in; what is rejected doesn't count."""

    def step(state, row):
        kept = [t for t in state or [] if t >= row["t"] - window_ms]
        accepted = len(kept) < limit
        return (kept + [row["t"]] if accepted else kept), {"event_id": row["event_id"], "accepted": accepted}

    return step


@dataclass
class Bucket:
    """Tokens that come back with time, up to a capacity; it starts full, and time that runs backwards adds none."""

    capacity: float
    per_second: float
    tokens: float | None = None
    at: int | None = None

    def take(self, wanted: int, now_ms: int) -> int:
        """As many whole tokens as wanted, or as there are."""
        if self.tokens is None:
            self.tokens, self.at = self.capacity, now_ms
        elapsed = now_ms - self.at
        if elapsed > 0:
            self.tokens, self.at = min(self.capacity, self.tokens + elapsed / 1000.0 * self.per_second), now_ms
        granted = max(0, min(wanted, math.floor(self.tokens)))
        self.tokens -= granted
        return granted


def token_bucket_step(capacity: float, per_second: float):
    """Whole tokens are granted, as many as asked for or there are."""

    def step(state, row):
        bucket = state or Bucket(capacity, per_second)
        granted = bucket.take(row["wanted"], row["t"])
        return bucket, {"event_id": row["event_id"], "granted": granted, "tokens": bucket.tokens}

    return step


#: Tiers from the most urgent, with their guaranteed shares; a tier's bucket holds this share of a second's tokens, one at least.
TIERS = {"high": 0.70, "medium": 0.20, "low": 0.10}
HEADROOM = 0.15


@dataclass
class Pacer:
    """A bucket for each tier and one for all of them, which starts with a full second's tokens; what waits in each tier."""

    ceiling: Bucket
    tiers: dict[str, Bucket]
    waiting: dict[str, int]

    @classmethod
    def of(cls, per_second: float) -> Pacer:
        share = {t: per_second * s for t, s in TIERS.items()}
        return cls(Bucket(per_second, per_second), {t: Bucket(max(r * HEADROOM, 1.0), r) for t, r in share.items()}, dict.fromkeys(TIERS, 0))

    def tick(self, permits: int, now_ms: int) -> dict[str, int]:
        """Guaranteed grants first, which the ceiling is charged for without being asked; then what it has left, in the order of the tiers."""
        granted = {}
        for t, bucket in self.tiers.items():
            granted[t] = bucket.take(min(self.waiting[t], permits), now_ms)
            self.ceiling.take(granted[t], now_ms)
            permits -= granted[t]
            self.waiting[t] -= granted[t]
        for t in self.tiers:
            more = self.ceiling.take(min(self.waiting[t], permits), now_ms)
            granted[t] += more
            permits -= more
            self.waiting[t] -= more
        return granted


def pacing_step(per_second: float):
    """A tick: what arrived joins what waits, and the pacer admits some of it."""

    def step(state, row):
        pacer = state or Pacer.of(per_second)
        for t in TIERS:
            pacer.waiting[t] += row[t]
        granted = pacer.tick(row["permits"], row["t"])
        return pacer, {"series": row["series"], "t": row["t"], **{f"{t}_granted": g for t, g in granted.items()}, "waiting": sum(pacer.waiting.values())}

    return step


# hold and release


@dataclass
class Lane:
    """What one stage holds, by scope in the order of arrival; the control records that apply to it; the stage's bucket."""

    stage: str
    bucket: Bucket
    held: dict[str, deque] = field(default_factory=dict)
    items: set = field(default_factory=set)
    controls: dict[str, tuple[str, float]] = field(default_factory=dict)

    def hold(self, scope: str, at: int, item: int) -> bool:
        """A command that comes again changes nothing."""
        if item in self.items:
            return False
        self.items.add(item)
        self.held.setdefault(scope, deque()).append((at, item))
        return True

    def size(self, scope: str) -> int:
        return len(self.held[scope])

    def applicable(self, scope: str) -> list[tuple[str, float]]:
        """Records of all messages, of the stage, of the scope itself and of a partner at this stage."""
        names = ["GLOBAL:", f"STAGE:{self.stage}", scope]
        if scope.startswith("PARTNER:"):
            names.append(f"PARTNER_STAGE:{scope.removeprefix('PARTNER:')}:{self.stage}")
        return [self.controls[n] for n in names if n in self.controls]

    def release(self, now_ms: int) -> list[dict]:
        """Of what isn't paused a share as large as the strictest rate among it, if the bucket has the tokens; one of each scope in turn."""
        open_, rate = {}, 1.0
        for scope, queue in self.held.items():
            records = self.applicable(scope)
            if all(state != "PAUSED" for state, _ in records):
                open_[scope] = queue
                rate = min([rate, *(r for _, r in records)])
        if not open_ or rate <= 0:
            return []
        granted = self.bucket.take(math.ceil(sum(map(self.size, open_)) * rate), now_ms)
        turn = deque(sorted(open_, key=lambda scope: open_[scope][0]))  # in the order of their oldest items
        out = []
        while len(out) < granted:
            scope = turn.popleft()
            at, item = open_[scope].popleft()
            self.items.discard(item)
            out.append({"item": item, "held_at": at, "scope": scope})
            if open_[scope]:
                turn.append(scope)
            else:
                del self.held[scope]
        return out


#: Tokens of a stage, and how many come back in a second.
LANE_CAPACITY, LANE_PER_SECOND = 50.0, 10.0


def release_step(capacity: float = LANE_CAPACITY, per_second: float = LANE_PER_SECOND):
    """Rows of one stage: `hold` keeps an item of a scope, `control` sets the state and rate of a scope, `tick` releases, and `remind` repeats what is held without releasing it."""

    def step(lane, row):
        lane = lane or Lane(row["stage"], Bucket(capacity, per_second))
        if row["kind"] == "hold":
            lane.hold(row["scope"], row["t"], row["item"])
            return lane, None
        if row["kind"] == "control":
            lane.controls[row["scope"]] = (row["state"], row["rate"])
            return lane, None
        if row["kind"] == "tick":
            out = lane.release(row["t"])
        else:
            out = [{"item": item, "held_at": at, "scope": k} for at, item, k in sorted((at, item, k) for k, q in lane.held.items() for at, item in q)]
        return lane, [{"stage": row["stage"], "t": row["t"], "kind": row["kind"], "position": i, **r} for i, r in enumerate(out, 1)]

    return step


RELEASE_SCHEMA = "stage string, t long, kind string, position int, item long, held_at long, scope string"


@dataclass
class Front(Lane):
    """A lane that knows the items which its ticks can come to; of the others it has the number in each scope."""

    others: dict[str, int] = field(default_factory=dict)

    def size(self, scope: str) -> int:
        return super().size(scope) + self.others.get(scope, 0)


def front_step(capacity: float, per_second: float):
    """`others` adds to the number of a scope; `again` is a hold of an item that came before, and is put out if it is held anew."""
    release = release_step(capacity, per_second)

    def step(lane, row):
        lane = lane or Front(row["stage"], Bucket(capacity, per_second))
        if row["kind"] == "others":
            lane.others[row["scope"]] = lane.others.get(row["scope"], 0) + row["n"]
            return lane, None
        if row["kind"] == "again":
            kept = lane.hold(row["scope"], row["t"], row["item"])
            return lane, {"stage": row["stage"], "t": row["t"], "kind": "again", "position": 0, "item": row["item"], "held_at": row["t"], "scope": row["scope"]} if kept else None
        return release(lane, row)

    return step


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null is a value like others."""
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(right, same, how).drop(*(f"_{k}" for k in keys))


def release_lanes(rows: DataFrame, period: int, capacity: float, per_second: float) -> DataFrame:
    """What `release_step` gives for `rows` in the order of t, later, item and scope, if ticks and reminders are at multiples of `period`, each once.

    A tick releases `capacity` items at most, so the ticks of a stage can't come to more than the first `reach` items of a scope. These go
    through the stage's fold one by one; of the others it takes their number by scope and period, and of control records the last of a
    period, so its rows grow with the periods. Reminders don't pass the fold: what a stage holds is cut into runs, each in one period and
    either one released item or items that stay. An item's place is its rank in its run behind all that earlier runs hold at the time.
    """
    by_scope = ["stage", "scope", "cell"]
    cell = F.col("t") + F.pmod(-F.col("t"), F.lit(period))
    rows = rows.withColumn("cell", cell)
    ticks = rows.filter("kind = 'tick'")
    nth = F.row_number().over(Window.partitionBy("stage", "item").orderBy("t", "scope"))
    holds = rows.filter("kind = 'hold'").select("stage", "t", "item", "scope", "cell").withColumn("nth", nth)
    first, again = holds.filter("nth = 1"), holds.filter("nth > 1")

    reach = ticks.groupBy("stage").agg((F.count(F.lit(1)) * math.floor(capacity) + 1).alias("reach"))
    earlier = Window.partitionBy("stage", "scope").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = first.groupBy(*by_scope).agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(reach, "stage")
    rank = F.col("before") + F.row_number().over(Window.partitionBy(*by_scope).orderBy("t", "item"))
    near = _matched(first, counts.filter("before < reach").drop("n"), by_scope).withColumn("rank", rank).filter("rank <= reach")
    others = counts.select("stage", F.col("cell").alias("t"), F.lit("others").alias("kind"), "scope", (F.col("n") - F.greatest(F.least("n", F.col("reach") - F.col("before")), F.lit(0))).alias("n"))
    controls = rows.filter("kind = 'control'").groupBy(*by_scope).agg(F.max_by(F.struct("state", "rate"), F.struct("t", "item")).alias("last"))
    parts = [
        near.select("stage", "t", F.lit("hold").alias("kind"), "item", "scope"),
        _matched(again, near.select("stage", "item"), ["stage", "item"], "left_semi").select("stage", "t", F.lit("again").alias("kind"), "item", "scope"),
        others.filter("n > 0"),
        controls.select("stage", F.col("cell").alias("t"), F.lit("control").alias("kind"), "scope", "last.state", "last.rate"),
        ticks.select("stage", "t", "kind", "later"),
    ]
    lanes = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).fillna(0, ["later"])
    folded = ordered_fold(lanes, ["stage"], ["t", "later", "item", "scope"], front_step(capacity, per_second), RELEASE_SCHEMA)

    reminders = rows.filter("kind = 'remind'").groupBy("stage").agg(F.collect_list("t").alias("reminders"))
    came = first.select("stage", "t", "item", "scope", F.lit(None).cast("long").alias("until"))
    left = folded.select("stage", F.col("held_at").alias("t"), "item", "scope", F.when(F.col("kind") == "tick", F.col("t")).alias("until"))
    kept = came.unionByName(left).join(reminders.select("stage"), "stage", "left_semi").groupBy("stage", "t", "item", "scope").agg(F.max("until").alias("until")).withColumn("cell", cell)
    order = Window.partitionBy("stage", "cell").orderBy("t", "item", "scope")
    gone = F.col("until").isNotNull().cast("long")
    kept = kept.withColumn("rank", F.row_number().over(order)).withColumn("run", 2 * F.sum(gone).over(order.rowsBetween(Window.unboundedPreceding, 0)) - gone)

    by_run = ["stage", "cell", "run"]
    runs = kept.groupBy(*by_run).agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("start"), F.max("until").alias("until")).join(reminders, "stage")
    due = runs.withColumn("at", F.explode(F.filter("reminders", lambda at: (at >= F.col("cell")) & (F.col("until").isNull() | (at < F.col("until"))))))
    older = F.sum("n").over(Window.partitionBy("stage", "at").orderBy("cell", "run").rowsBetween(Window.unboundedPreceding, -1))
    lists = due.withColumn("shift", F.coalesce(older, F.lit(0)) - F.col("start") + 1).groupBy(*by_run).agg(F.collect_list(F.struct("at", "shift")).alias("lists"))
    listed = kept.join(lists, by_run).select("stage", "t", "item", "scope", "rank", F.inline("lists"))
    reminded = listed.select("stage", F.col("at").alias("t"), F.lit("remind").alias("kind"), (F.col("rank") + F.col("shift")).cast("int").alias("position"), "item", F.col("t").alias("held_at"), "scope")
    return folded.filter("kind = 'tick'").unionByName(reminded)


# control loops


@dataclass(frozen=True)
class Thresholds:
    """Levels of the metric at which a state is entered and left, ticks that a change is to be suggested in a row, ticks that a state lasts at least."""

    enter_degraded: float = 0.5
    exit_degraded: float = 0.3
    enter_paused: float = 0.8
    exit_paused: float = 0.5
    enter_window: int = 3
    exit_window: int = 5
    least_ticks: int = 5


SEVERITY = {"ACTIVE": 0, "DEGRADED": 1, "PAUSED": 2}


@dataclass
class Loop:
    """Down in one step if it must be, up through DEGRADED only; a change takes a streak of equal suggestions."""

    state: str = "ACTIVE"
    ticks: int = 0
    candidate: str | None = None
    streak: int = 0

    def suggest(self, metric: float, at: Thresholds) -> str:
        if self.state == "PAUSED":
            return "DEGRADED" if metric <= at.exit_paused else "PAUSED"
        if metric >= at.enter_paused:
            return "PAUSED"
        if self.state == "DEGRADED":
            return "ACTIVE" if metric <= at.exit_degraded else "DEGRADED"
        return "DEGRADED" if metric >= at.enter_degraded else "ACTIVE"

    def tick(self, metric: float, at: Thresholds) -> str:
        self.ticks += 1
        suggested = self.suggest(metric, at)
        if suggested == self.state:
            self.candidate, self.streak = None, 0
            return self.state
        self.candidate, self.streak = suggested, self.streak + 1 if suggested == self.candidate else 1
        window = at.exit_window if SEVERITY[suggested] < SEVERITY[self.state] else at.enter_window
        if self.streak >= window and self.ticks >= at.least_ticks:
            self.state, self.ticks, self.candidate, self.streak = suggested, 0, None, 0
        return self.state


def hysteresis_step(at: Thresholds = Thresholds()):
    def step(state, row):
        loop = state or Loop()
        before = loop.state
        now = loop.tick(row["metric"], at)
        return loop, {"scope": row["scope"], "tick": row["tick"], "state": now, "changed": now != before}

    return step


RAMP = (0.0, 0.05, 0.10, 0.25, 0.50, 1.00)


@dataclass
class Scope:
    loop: Loop = field(default_factory=Loop)
    rate: float = 1.0
    version: int = 0
    last: str | None = None
    override: tuple[str, float, int | None] | None = None  # state, rate, until

    def evaluate(self, metric: float, now: int, at: Thresholds) -> tuple[str, float]:
        """An override that hasn't expired is the answer, and the loop stands still; else the loop's state, with a rate that ramps up while it is active."""
        if self.override and self.override[2] is not None and self.override[2] <= now:
            self.override = None
        if self.override:
            return self.override[:2]
        state = self.loop.tick(metric, at)
        if state == "ACTIVE":
            self.rate = next((r for r in RAMP if r > self.rate), RAMP[-1])
        else:
            self.rate = 0.0 if state == "PAUSED" else RAMP[1]
        if state != self.last:  # the first evaluation too
            self.version, self.last = self.version + 1, state
        return state, self.rate


def override_step(at: Thresholds = Thresholds()):
    """Rows of a scope: `evaluate` with a metric, `override` with a state, a rate and how long it lasts (null: until cleared), `clear`. Overriding and clearing raise the version."""

    def step(state, row):
        scope = state or Scope()
        shown, rate = None, None
        if row["kind"] == "evaluate":
            shown, rate = scope.evaluate(row["metric"], row["t"], at)
        else:
            scope.override = None
            if row["kind"] == "override":
                scope.override = (row["state"], row["rate"], None if row["lasts"] is None else row["t"] + row["lasts"])
            scope.version += 1
        return scope, {"scope": row["scope"], "event_id": row["event_id"], "kind": row["kind"], "state": shown, "rate": rate, "version": scope.version}

    return step


# money


def charge_step(state, row):
    """Checks in order: applied before, another epoch (an unknown one is another), frozen; else the balance falls and an outbox amount is put out.

    Freezing raises the epoch, once. Unfreezing takes the recomputed balance and raises it again, if it is of
    the epoch that was expected. Only ids that come again (`again`, true where it isn't known) are remembered.
    """
    balance, epoch, frozen, applied = state or (0, 0, False, set())
    amount = None
    if row["kind"] == "freeze":
        result = "ALREADY_FROZEN" if frozen else "FROZEN"
        epoch, frozen = epoch + (not frozen), True
    elif row["kind"] == "unfreeze":
        if not frozen:
            result = "ALREADY_ACTIVE"
        elif row["epoch"] != epoch:
            result = "STALE_EPOCH"
        else:
            balance, epoch, frozen, result = row["recomputed"], epoch + 1, False, "UNFROZEN"
    elif row["charge_id"] in applied:
        result = "ALREADY_PROCESSED"
    elif row["epoch"] != epoch:
        result = "STALE_EPOCH"
    elif frozen:
        result = "ACCOUNT_FROZEN"
    else:
        applied.add(row["charge_id"])
        balance, result, amount = balance - row["amount"], "APPLIED", row["amount"]
    if row.get("again") is False:
        applied.discard(row["charge_id"])
    return (balance, epoch, frozen, applied), {"event_id": row["event_id"], "result": result, "balance": balance, "epoch": epoch, "outbox_amount": amount}


CHARGE_SCHEMA = "event_id long, result string, balance long, epoch long, outbox_amount long"


# pipelines


def pipeline_step(stages: dict[str, str], edges: dict[tuple[str, str], str], entry: str, ttl_ms: int):
    """Moves a message along the nodes of a pipeline by the outcome of the stage that it waits for.

    `stages` names each node's stage, `edges` the node that follows a node and an outcome. An event of another
    stage, or of another execution than the one that was dispatched, is ignored; executions are
    numbered as they are dispatched. Policy sets the category, and billing of a blocked message ends it,
    whatever the graph says. Delivery that failed but can be retried is dispatched again until the
    message's time is over; then the edge for exhausted retries counts.
    """

    def step(state, row):
        node, execution, attempt, until, category = state or (entry, 1, 1, row["t"] + ttl_ms, None)
        stage = stages.get(node)
        if stage is None or row["stage"] != stage or row["execution"] != execution:
            return (node, execution, attempt, until, category), {"event_id": row["event_id"], "action": "IGNORED", "node": node, "attempt": attempt}
        outcome = row["outcome"]
        if stage == "POLICY":
            category = row["category"]
        if stage == "BILLING" and category == "BLOCKED":
            following = None
        else:
            if stage == "DELIVERY" and outcome == "FAILED" and row["retryable"]:
                if row["t"] < until:
                    return (node, execution + 1, attempt + 1, until, category), {"event_id": row["event_id"], "action": "RETRY", "node": node, "attempt": attempt + 1}
                outcome = "RETRY_EXHAUSTED"
            following = edges.get((node, outcome))
        action = "ADVANCE" if following else "FINISH"
        return (following, execution + 1, 1, until, category), {"event_id": row["event_id"], "action": action, "node": following, "attempt": 1}

    return step


PIPELINE_SCHEMA = "event_id long, action string, node string, attempt int"
