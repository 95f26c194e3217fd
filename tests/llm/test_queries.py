"""Registered queries against their oracles, and the pipeline against a plain version of its deterministic stages."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

import oracle  # noqa: E402

from phrasemill.llm import queries as q  # noqa: E402
from phrasemill.llm.shared import table  # noqa: E402


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_oracle(spark, small, name):
    assert oracle.of_spark(q.queries()[name](spark, small)) == oracle.of_duckdb(q.oracle_sql()[name], small)


def test_all_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in q.queries()) == list(range(1, 14))


def test_pipeline_stages(spark, small):
    docs = table(spark, small, "documents")
    texts = {}
    for name, stage in pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, small).persist()
        after = docs.toPandas()
        if name != "best-fit packing":
            assert list(after.columns) == pipeline.COLUMNS and set(after.doc_id) <= set(before.doc_id)
            texts[name] = dict(zip(after.doc_id, after.text))
        if name == "exact dedup":
            first = {}
            for i, t in sorted(zip(before.doc_id, before.text)):
                first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), i)
            assert set(after.doc_id) == set(first.values())
        if name == "n-gram Jaccard join":
            from test_operators import brute_components, shingle_sets

            own = sorted(zip(before.doc_id, before.text))
            roots = brute_components(shingle_sets([t for _, t in own]))
            assert set(after.doc_id) == {own[k][0] for k, r in enumerate(roots) if k == r}
        if name == "PII":
            assert set(after.doc_id) == set(before.doc_id) and not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", t) for t in after.text)
            assert (after.n_chars == after.text.str.len()).all()
    assert set(after.doc_id) == set(texts["PII"])
    assert len(texts["quality classifier"]) >= 0.7 * table(spark, small, "documents").count()


def test_pipeline_runs(spark, small):
    rows = pipeline.run(spark, small)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_pipeline_rows_that_repeat_or_lack_ids(spark, small):
    """Copies are dropped row by row: a repeated id takes no other row with it, and rows without an id are compared too."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:-1], "other"])
    texts = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "c  d"), (None, "a b"), (None, "lone"), (None, "lone"), (3, " ".join(words)), (3, near), (0, "z"), (None, near + " "), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    once = stages["exact dedup"](spark, docs.repartition(3), small).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 99, re.sub(" +", " ", r.text or "")) for r in once) == sorted([(1, "a b"), (1, "c d"), (3, " ".join(words)), (3, near), (0, "z"), (99, "lone"), (4, ""), (99, near + " ")])
    once = stages["n-gram Jaccard join"](spark, docs.repartition(3), small).collect()
    assert sorted((r.doc_id if r.doc_id is not None else 99) for r in once) == sorted([1, 1, 99, 3, 0, 4, 5])
    for name in ("PII", "best-fit packing"):
        assert stages[name](spark, docs, small).count() == len(texts)
