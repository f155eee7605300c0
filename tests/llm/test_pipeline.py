"""The pipeline against its operators' plain versions, stage by stage."""

import importlib

import pytest

pipeline = importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        path = f"file://{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        out.append((name, before, docs))
    return out


def test_columns_and_counts(stages, spark, sf_dir):
    for _, before, after in stages[:-1]:
        assert set(after.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        assert 0 < after.count() <= before.count()
    assert stages[2][1].count() == stages[2][2].count() and stages[4][1].count() == stages[4][2].count()
    assert sorted(r.doc_id for r in pipeline.run(spark, sf_dir).collect()) == sorted(r.doc_id for r in stages[-1][2].collect())


def test_one_of_each_component_stays(stages):
    from test_jaccard import brute

    _, before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    want = {c if n else i for i, n, c in brute(rows, 5, (80, 100))}
    assert {r.doc_id for r in after.collect()} == want


def test_leaks_go(stages, spark, sf_dir):
    from test_decontaminate import brute

    _, before, after = stages[3]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    hit = {x[0] for x in brute(rows[:60], items[:12])}
    kept = {r.doc_id for r in after.collect()}
    assert not hit & kept and len(kept) > 0.8 * len(rows)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty, very long and repeated texts, columns with clashing names; then no rows at all."""
    good = next(r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").filter("n_chars BETWEEN 400 AND 2000").orderBy("doc_id").collect())
    rows = [(1, good, "en", "s", len(good)), (1, good, "en", "s", len(good)), (2, good, None, None, None), (None, good, "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, None, "en", "s", None), (4, good[::-1], "en", "s", 5), (5, (good + "\n") * 300, "en", "s", 7)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, 1, "x", True) for r in rows], f"{schema}, row long, component string, score boolean").repartition(3)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = out.collect()
        assert name == "tokens" or out.columns == list(pipeline.COLUMNS)
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
        ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in got)
        if name in ("substring_dedup", "tokens"):
            assert len(got) == len(rows)
        elif name == "near_duplicates":
            # of the copies the first stays, and the long one has the same shingles but a few; empty ones link with nothing
            assert ids == [-1, 1, 3, 4, 4]
        elif name == "decontamination":
            assert len(got) == len(rows)
        else:
            assert len(got) <= len(rows) and ids.count(1) in (0, 2)
