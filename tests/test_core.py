"""Golden cases of the text functions and folds, and edge cases of the join helpers."""

import datetime as dt
import unicodedata

from pyspark.sql import functions as F

from relaywright.functions import text as X
from relaywright.operators import folds as S
from relaywright.operators.core import asof_join, clamp, matching, page_with_more, range_lookup
from relaywright.sources import files


def match(pattern, text, **names):
    return X.template_matches(X.parse_template(pattern), text, names)


PAYMENT = "%w shartnoma bo'yicha %d{1,6} so'm to'lovni bugun amalga oshiring"


def test_templates():
    assert match("Your code is %d{4,6}", "Your code is 12-34")
    assert not match("Your code is %d{4,6}", "Your code is 123")
    assert not match("Hi %w!", "Hi two words!")
    assert match("Hi %w!", "say Hi you! now")  # literals aren't anchored
    assert not match("Hi %w", "Hi ")
    assert match("Pay %{sum} now", "Pay 12.50 now", sum=r"\d+\.\d\d")
    assert not match("Pay %{sum} now", "Pay 12.501 now", sum=r"\d+\.\d\d")
    assert not match("Pay %{sum} now", "Pay 12 now", sum="(") and not match("Pay %{sum} now", "Pay 12 now")
    assert not match("a %w b %w c", "a x b y z c")  # the earliest places are final
    assert not match("%w%d{0,9}", "word") and not match("", "word")  # without text nothing matches
    assert match("%w%d{2,2}!", "12!") and not match("%d{2,2}%w!", "1 2!")  # of two that touch only the last counts
    assert match("%w%w%w%w%wx", "a" * 5000 + "x")
    words = PAYMENT.replace("%w", "Hello1238!@*")
    assert [match(PAYMENT, words.replace("%d{1,6}", n)) for n in ("1 2 3 4 5 6", "1 2 3 4 5 6 7", "12-34-56")] == [True, False, True]
    assert not match(PAYMENT, PAYMENT.replace("%w", "two words").replace("%d{1,6}", "123"))
    assert match("%d{2,2}-ok-%w", "42-ok-done") and not match("%d{2,2}-ok-%w", "4-ok-done") and not match("%d{2,2}-ok-%w", "42-ok-")
    assert match("Спасибо за %w покупку", "Спасибо за вашу покупку") and match("🎉 %w tabriklaymiz", "🎉 sizni tabriklaymiz")
    assert X.parse_template("%d{9,1}") == [("digits", 9, 1)] and X.parse_template("%d{a,1}%{Up}") == [("text", "%d{a,1}%{Up}")]


def test_best_template(spark):
    rows = spark.createDataFrame([("code 1234 ok", "A"), ("code word ok", "A"), ("other", "B"), ("the code 123", "A"), (None, None)], "text string, sender string")
    best = X.best_template([("w", "code %w ok", None), ("d", "code %d{4,4} ok", None), ("b", "other", "A"), ("short", "code %w", None), ("long", "the code %w", None)])
    assert [r[0] for r in rows.select(best("text", "sender")).collect()] == ["d", "w", None, "long", None]
    many = [(f"u{i}", f"another text number {i} without common words", None) for i in range(20_000)] + [("real", PAYMENT, None)]
    text = PAYMENT.replace("%w", "Hello").replace("%d{1,6}", "123")
    assert X._Templates(tuple(many)).best(text, None, {}) == "real"


def test_folding(spark):
    rows = spark.createDataFrame([("".join(X.HOMOGLYPHS) + "".join(X.HOMOGLYPHS).upper(),), ("Ｂａd\u00a0Ｗ-o\u2028r.D",), ("ﬁ²ǆ",), ("e\u0301 É ß",), (None,), ("",)], "text string")
    got = [r[0] for r in rows.select(X.folded(F.col("text"))).collect()]
    values = "".join(X.HOMOGLYPHS.values())
    assert got == [values * 2, "badword", "fi2dž", "ééß", None, ""]
    every = "".join(chr(c) for c in range(1, 0x300))
    assert spark.createDataFrame([(every,)], "t string").select(X.normalized(F.col("t"))).first()[0] == unicodedata.normalize("NFKC", every.lower().replace("i̇", "i̇"))


BANNED = ["idiot", "kot", "qotaq", "мудак", "черт", "терроризм"]


def test_banwords(spark):
    cases = ["у меня есть kot дома", "он повёл себя как настоящий мудак сегодня", "ты просто qоtaq, всё", "он т е р р о р и з м устроил", "q-o-t-a-q написано", "shartnoma bo'yicha to'lovni", "у меня кot дома", "ты просто qοtaq", "он ιdiot", "qоtαq", None, ""]
    rows = spark.createDataFrame(list(enumerate(cases)), "id int, text string").repartition(3)
    got = {r.id: len(r.hits) for r in rows.select("id", X.banword_hits(BANNED)(F.col("text")).alias("hits")).collect()}
    assert [got[i] for i in range(len(cases))] == [1, 1, 1, 1, 1, 0, 1, 1, 1, 1, 0, 0]
    odd = spark.createDataFrame([("ｂａｄｗｏｒｄ",), ("Cyrillic bаd wоrd",), ("BADWORD",), ("go o k ay",)], "text string")
    assert [r[0] for r in odd.select(X.banword_hits(["BadWord", "oK"])("text")).collect()] == [["badword"], ["badword"], ["badword"], ["ok"]]
    plain = odd.select(X.normalized(F.col("text")).alias("p"))
    assert [r[0] for r in plain.select(X.banwords_in(F.col("p"), X.despaced(F.col("p")), ["BadWord", "oK"])).collect()] == [["badword"], ["badword"], ["badword"], ["ok"]]


def test_segments(spark):
    cases = [("a" * 160, 1), ("a" * 161, 2), ("€" * 80, 1), ("€" * 81, 2), ("я" * 70, 1), ("я" * 71, 2), ("😀" * 35, 1), ("😀" * 36, 2), ("", 1)]
    rows = spark.createDataFrame([(t,) for t, _ in cases], "text string")
    assert [r[0] for r in rows.select(X.segments(F.col("text"))).collect()] == [n for _, n in cases]
    split = X.split_segments.func
    import pandas as pd

    assert split(pd.Series(["a" * 152 + "€" + "b" * 20]))[0] == ["a" * 152, "€" + "b" * 20]


def fold(step, rows, state=None):
    out = []
    for row in rows:
        state, result = step(state, row)
        out.append(result)
    return out


def verdicts(*statuses):
    rows = [{"message_id": 1, "event_id": i, "status": s} for i, s in enumerate(statuses)]
    return [r["verdict"] for r in fold(S.lifecycle_step, rows)]


def test_lifecycle():
    every = [*S.ENTRY, "LATE_DELIVERY_CONFIRMED"]
    for status in S.ENTRY:
        assert verdicts(status) == ["VALID"]
    assert verdicts("LATE_DELIVERY_CONFIRMED") == verdicts("ACCEPTED") == ["REGRESSION"]
    may = {"SUBMITTED": {"DELIVERED", "UNDELIVERABLE"}, "DELIVERY_UNRESOLVED": {"LATE_DELIVERY_CONFIRMED"}}
    for first in S.ENTRY:
        for then in every:
            assert verdicts(first, then)[1] == ("VALID" if then in may.get(first, ()) else "REGRESSION"), (first, then)
    assert verdicts("DELIVERY_UNRESOLVED", "LATE_DELIVERY_CONFIRMED", "DELIVERED") == ["VALID", "VALID", "REGRESSION"]
    again = [{"message_id": 1, "event_id": 7, "status": s} for s in ("SUBMITTED", "DELIVERED")]
    assert [(r["verdict"], r["status"], r["version"]) for r in fold(S.lifecycle_step, again)] == [("VALID", "SUBMITTED", 1), ("DUPLICATE", "SUBMITTED", 1)]


def test_limits_and_buckets():
    rows = [{"event_id": i, "t": t} for i, t in enumerate([0, 10_000, 20_001])]
    assert [r["accepted"] for r in fold(S.sliding_limit_step(1, 10_000), rows)] == [True, False, True]  # just a window apart still counts
    rows = [{"event_id": i, "t": t * 1000, "wanted": w} for i, (t, w) in enumerate([(0, 3), (0, 3), (1, 3), (10, 9), (9, 1)])]
    assert [r["granted"] for r in fold(S.token_bucket_step(5.0, 1.0), rows)] == [3, 2, 1, 5, 0]


def test_pacing():
    """Tiers of 7, 2 and 1 a second start with one token each; the ceiling has 10 and is charged for theirs."""
    tick = lambda t, high, medium, low, permits=100: {"series": 1, "t": t, "high": high, "medium": medium, "low": low, "permits": permits}
    got = fold(S.pacing_step(10.0), [tick(0, 4, 20, 5), tick(0, 0, 0, 0), tick(100, 0, 0, 0), tick(1000, 0, 0, 0, 3), tick(5000, 0, 0, 0)])
    assert [(r["high_granted"], r["medium_granted"], r["low_granted"], r["waiting"]) for r in got] == [(4, 5, 1, 19), (0, 0, 0, 19), (0, 1, 0, 18), (0, 2, 1, 15), (0, 9, 1, 5)]


def test_hysteresis():
    loop = lambda series, **at: [r["state"] for r in fold(S.hysteresis_step(S.Thresholds(**at)), [{"scope": 1, "tick": i, "metric": m} for i, m in enumerate(series)])]
    assert set(loop([0.45, 0.55, 0.48, 0.52, 0.49, 0.51, 0.47, 0.53, 0.50, 0.46] * 3)) == {"ACTIVE"}
    states = loop([0.6] * 10 + [0.9] * 10)
    assert states[:4] == ["ACTIVE"] * 4 and states[4] == "DEGRADED" and states[-1] == "PAUSED"
    states = loop([0.6] * 5 + [0.9] * 5 + [0.1] * 20)
    assert states[9] == "PAUSED" and states.index("DEGRADED", 10) < states.index("ACTIVE", 10)
    assert "DEGRADED" not in (states := loop([0.95] * 10)) and states[-1] == "PAUSED"
    assert loop([0.6] * 6, enter_window=1, exit_window=1, least_ticks=4)[:4] == ["ACTIVE"] * 3 + ["DEGRADED"]


def test_charges():
    charge = lambda i, c, epoch: {"event_id": i, "kind": "charge", "charge_id": c, "epoch": epoch, "amount": 10}
    admin = lambda i, kind, epoch=None, to=None: {"event_id": i, "kind": kind, "charge_id": None, "epoch": epoch, "recomputed": to}
    rows = [charge(1, 1, 0), charge(2, 1, 0), charge(3, 9, None), admin(4, "freeze"), admin(5, "freeze"), charge(6, 2, 1), charge(7, 3, 0), admin(8, "unfreeze", 0, 5), admin(9, "unfreeze", 1, 97), charge(10, 4, 2), admin(11, "unfreeze", 2, 1), charge(12, 1, 9)]
    got = fold(S.charge_step, rows)
    assert [r["result"] for r in got] == ["APPLIED", "ALREADY_PROCESSED", "STALE_EPOCH", "FROZEN", "ALREADY_FROZEN", "ACCOUNT_FROZEN", "STALE_EPOCH", "STALE_EPOCH", "UNFROZEN", "APPLIED", "ALREADY_ACTIVE", "ALREADY_PROCESSED"]
    assert [r["epoch"] for r in got] == [0, 0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2] and got[9]["balance"] == 87 and [r["outbox_amount"] for r in got if r["outbox_amount"]] == [10, 10]


def test_overrides():
    at = S.Thresholds(enter_window=1, exit_window=1, least_ticks=1)
    row = lambda t, kind="evaluate", metric=None, state=None, rate=None, lasts=None: {"scope": 1, "event_id": t, "t": t, "kind": kind, "metric": metric, "state": state, "rate": rate, "lasts": lasts}
    got = fold(S.override_step(at), [row(0, metric=0.1), row(1, metric=0.1), row(2, "override", state="PAUSED", rate=0.2, lasts=2), row(3, metric=0.1), row(4, metric=0.6), row(5, metric=0.1), row(6, metric=0.1), row(7, "clear")])
    assert [(r["state"], r["rate"], r["version"]) for r in got] == [("ACTIVE", 1.0, 1), ("ACTIVE", 1.0, 1), (None, None, 2), ("PAUSED", 0.2, 2), ("DEGRADED", 0.05, 3), ("ACTIVE", 0.1, 4), ("ACTIVE", 0.25, 4), (None, None, 5)]


def test_pipeline():
    step = S.pipeline_step({"a": "POLICY", "b": "BILLING", "c": "DELIVERY", "d": "DELIVERY_RECONCILIATION"}, {("a", "SUCCEEDED"): "b", ("a", "REJECTED"): "b", ("b", "SUCCEEDED"): "c", ("c", "RETRY_EXHAUSTED"): "d"}, "a", 100)
    row = lambda t, stage, execution, outcome="SUCCEEDED", retryable=False, category=None: {"event_id": t, "t": t, "stage": stage, "execution": execution, "outcome": outcome, "retryable": retryable, "category": category}
    got = fold(step, [row(0, "POLICY", 1, category="OK"), row(1, "POLICY", 1), row(2, "BILLING", 2), row(3, "DELIVERY", 3, "FAILED", True), row(4, "DELIVERY", 3, "FAILED", True), row(5, "DELIVERY", 4, "FAILED", True), row(200, "DELIVERY", 5, "FAILED", True), row(201, "DELIVERY_RECONCILIATION", 6), row(202, "DELIVERY_RECONCILIATION", 7)])
    assert [(r["action"], r["node"], r["attempt"]) for r in got] == [("ADVANCE", "b", 1), ("IGNORED", "b", 1), ("ADVANCE", "c", 1), ("RETRY", "c", 2), ("IGNORED", "c", 2), ("RETRY", "c", 3), ("ADVANCE", "d", 1), ("FINISH", None, 1), ("IGNORED", None, 1)]
    assert [r["action"] for r in fold(step, [row(0, "POLICY", 1, "REJECTED", category="BLOCKED"), row(1, "BILLING", 2)])] == ["ADVANCE", "FINISH"]
    assert fold(step, [row(0, "POLICY", 1), row(1, "BILLING", 2), row(2, "DELIVERY", 3, "FAILED", False)])[-1]["action"] == "FINISH"


def test_asof_edges(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    left = spark.createDataFrame([(1, 0, t(0)), (1, 1, t(5)), (1, 2, t(80)), (2, 3, t(5)), (1, 4, t(5))], "k int, id int, at timestamp_ntz")
    right = spark.createDataFrame([(1, 10, t(1)), (1, 11, t(5)), (1, 12, t(30))], "k int, v int, bt timestamp_ntz")
    got = {r.id: r.v for r in asof_join(left, right, ["k"], "at", "bt", ["v"]).collect()}
    assert got == {0: None, 1: 11, 2: 12, 3: None, 4: 11}
    assert asof_join(left, right.limit(0), ["k"], "at", "bt", ["v"]).filter("v IS NOT NULL").count() == 0


def test_range_lookup_edges(spark):
    ranges = spark.createDataFrame([(0, 9, 2, "a"), (5, 5, 1, "b"), (0, 10**15, 4, "huge"), (0, 10**9, 3, "wide"), (100, 250_000, 2, "mid"), (70, 60, 0, "empty")], "s long, e long, p int, v string")
    points = spark.createDataFrame([(1, 0), (2, 5), (3, 10), (4, 250_000), (5, -1), (6, None), (7, 10**9), (8, 10**15), (9, 65), (1, 5), (1, 5)], "id int, x long")
    got = sorted(((r.id, r.x, r.v) for r in range_lookup(points, ranges, "x", "s", "e", "p", "v").collect()), key=repr)
    want = [(1, 0, "a"), (2, 5, "b"), (3, 10, "wide"), (4, 250_000, "mid"), (5, -1, None), (6, None, None), (7, 10**9, "wide"), (8, 10**15, "huge"), (9, 65, "wide"), (1, 5, "b"), (1, 5, "b")]
    assert got == sorted(want, key=repr)
    assert [r.v for r in range_lookup(points, ranges.limit(0), "x", "s", "e", "p", "v").collect()] == [None] * 11


def test_has_more(spark):
    for n, more in ((0, None), (19, False), (20, False), (21, True), (50, True)):
        got = page_with_more(spark.range(n), [F.asc("id")], 20).collect()
        assert [r.id for r in got] == list(range(min(n, 20))) and {r.has_more for r in got} <= {more}


def test_filters(spark):
    assert (clamp(0), clamp(200), clamp(201), clamp(7)) == (50, 200, 50, 7)
    rows = spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean")
    assert [r.id for r in matching(rows, ok=False).collect()] == [2]
    assert matching(rows, id=[]).count() == 0 and matching(rows, id=None, ok=None).count() == 2


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "in.csv").write_text("id,name\n1,a\nx,b\n3,\n")
    good, bad = files.read_csv(spark, str(tmp_path / "in.csv"), "id int, name string", {"name": F.col("name").isNotNull()})
    assert [r.id for r in good.collect()] == [1]
    assert sorted(r.errors[0] for r in bad.collect()) == ["malformed", "name"]
    files.write_csv(good, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 1
    docs = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "no"}',), ("{",), ('{"a": 2}',)], "j string")
    assert [r[0] for r in docs.select(files.conforms(F.col("j"), "a int, b string", ["a", "b"])).collect()] == [True, False, False, False]
