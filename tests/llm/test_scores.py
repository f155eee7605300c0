"""Held-out accuracy of the two classifiers, and odd rows."""

import random

import numpy as np
import pytest

from relaywright.llm import toxicity
from relaywright.llm.quality import class_prior, fit_nnpu, moments, quality_table
from relaywright.llm.toxicity import _words_of, fit_words, toxicity_table

SF = "/root/testdata/sf0.1"


def auc(y, s):
    rank = np.empty(len(s))
    rank[np.argsort(s, kind="stable")] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("make", "label", "least"), [(quality_table, "quality", 0.97), (toxicity_table, "toxic", 0.9)])
def test_held_out(spark, make, label, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = make(docs, labels).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    held = labels.toPandas().merge(out[out.held_out], on="doc_id")
    assert len(held) > 500 and auc(held[label].to_numpy(), held.score.to_numpy()) > least


def test_held_out_labels_are_not_read(spark, sf_dir):
    from pyspark.sql import functions as F

    from relaywright.llm.samples import held_out

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for make in (quality_table, toxicity_table):
        a, b = ({r.doc_id: r.score for r in make(docs, x).collect()} for x in (labels, turned))
        assert a == b


@pytest.mark.parametrize("make", [quality_table, toxicity_table])
def test_odd_rows(spark, make):
    texts = ["good words here and there", "BAD!! BAD!! BAD!!", "you idiot", None, "", " \n", "x" * 100_000, "a b c " * 20_000]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts * 3)] + [(None, "x", "s"), (1, "BAD!!", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(24)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = make(docs, labels).collect()
    assert len(out) == 26 and all(0 <= r.score <= 1 for r in out)
    assert make(docs, labels.limit(0)).count() == 26
    assert make(docs.limit(0), labels).count() == 0


def test_nnpu_separates_and_finds_the_prior():
    r = np.random.default_rng(1)
    sure = lambda x: np.clip(x + 4, 0, 8)  # noqa: E731  features are positive
    good, bad = sure(r.normal(1, 0.5, (3000, 6))), sure(r.normal(-1.5, 0.5, (3000, 6)))
    unlabelled = np.concatenate([good[1500:], bad[:500]])
    p, u = moments(good[:1500]), moments(unlabelled)
    model = fit_nnpu(p, u, 0.75)
    assert (model.margins(good) > 0).mean() > 0.95 and (model.margins(bad) > 0).mean() < 0.1
    count = lambda x: np.bincount(((model.margins(x) + 1) * 50).astype(int), minlength=101)
    assert abs(class_prior(count(good[:1500]), count(unlabelled)) - 0.75) < 0.05


def test_moments_are_exact_sums():
    x = np.random.default_rng(2).uniform(0, 4, (70_000, 3)).astype(np.float32)
    whole = np.hstack([np.rint(x.astype(float) * 4096), np.full((len(x), 1), 4096.0)]).astype(np.int64)
    assert (moments(x) == whole.T @ whole).all() and (moments(x[:100]) + moments(x[100:]) == moments(x)).all()


@pytest.mark.parametrize("make", [quality_table, toxicity_table])
def test_a_model_hangs_on_the_rows_alone(spark, sf_dir, make):
    """Ids that repeat with other texts, in other partitions and another order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.filter("doc_id % 3 = 0").selectExpr("doc_id", "reverse(text) AS text")).unionByName(docs.filter("doc_id % 7 = 0"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = [sorted((r.doc_id, r.score) for r in make(d, labels).collect()) for d in (docs.coalesce(1), docs.repartition(7).orderBy("text"))]
    assert scores[0] == scores[1]


def test_subsequence_norms():
    """Against all subsequences of each word in plain Python."""
    words = [b"\1\2\3", b"\1\1\1\1\1\1", b"\1\2\1\2\1\2\1", b"\5", b"\5\6", b"\1\2\3", bytes(range(1, 25))]
    sym = np.frombuffer(b"".join(b"\0" + w for w in words) + b"\0", dtype=np.uint8)
    first = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])[:-1]
    for w, norm in zip(words, toxicity.norms(sym, first), strict=True):
        bordered, held = b"\0" + w + b"\0", {}
        for gaps in toxicity.GAPS:
            for i in range(len(bordered) - gaps[-1]):
                key = (bordered[i], *(bordered[i + g] for g in gaps))
                weight = toxicity.DECAY ** (gaps[-1] - 2) if len(gaps) == 2 else toxicity.FIVE_WEIGHT * toxicity.DECAY ** (gaps[-1] - 4)
                held[key] = held.get(key, 0) + weight
        assert abs(norm - max(1e-9, sum(v * v for v in held.values())) ** 0.5) < 0.02 * norm + 1e-4, w
    at, places, weights = toxicity.explicit(words)
    for k, w in enumerate(words):
        if len(w) > 1:
            own = np.bincount(places[at == k], weights=weights[at == k])
            assert abs((own**2).sum() - 1) < 1e-9


def test_gaps_and_insertions_score_higher_than_clean():
    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioubcdfgklmnprst") for _ in range(r.choice([3, 5, 7, 9])))
    insults = ["idiot", "moron", "worthless", "pathetic"]
    clean = [" ".join(word() for _ in range(30)) for _ in range(600)]
    toxic = [" ".join([*(word() for _ in range(20)), r.choice(insults), word()]) for _ in range(300)]
    model = fit_words(_words_of(toxic), _words_of(clean))
    score = lambda t: float(model.scores(np.frombuffer(t.encode(), dtype=np.uint8), np.array([0, len(t.encode())]))[0])
    plain = max(score(" ".join(word() for _ in range(20))) for _ in range(50))
    for text in ("such an i-d-i-o-t here", "an i d i o t he is", "you m.o.r.o.n", "you IDI0T"):
        assert score(text) > max(0.5, plain)
    for text in ("you idiiot", "how worthxless"):
        assert score(text) > np.median([score(" ".join(word() for _ in range(20))) for _ in range(30)])
