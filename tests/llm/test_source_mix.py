"""Mixing sources: targets, permutations, documents' shares and the mix itself against plain versions."""

import re
from collections import Counter
from fractions import Fraction

import oracle
import pytest
from pyspark.sql import functions as F

from phrasemill.llm import op11_source_mix as op11

TEXTS = [("a", "one two  three"), ("b", " four\tfive "), (None, "six"), ("a", None), ("a", ""), ("é", "\x0b\x0c "), ("b", "x" * 5000), ("c", "seven " * 3000), ("a", "one two  three"), ("", "eight nine"), ("c", "ten")]
SCHEMA = "doc_id long, source string, text string, size long, row long, no long, target string"


def rows(texts):
    return [(i if i != 4 else None, s, t, -1, -2, -3, "clash") for i, (s, t) in enumerate(texts)]


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, left = {}, Fraction(sum(sizes.values()))
    while True:
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        above = [s for s in open_ if weight[s] * level > most * sizes[s]]
        if not above:
            return {s: float(full[s] if s in full else weight[s] * level) for s in names}
        for s in above:
            full[s] = most * sizes[s]
            left -= full[s]


def test_targets_share_what_small_sources_cannot_give(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 10, "d": 3, None: 0}, {"a": 7}, {None: 5, "": 1, "é": 90, "z": 2}, {"a": 0, "b": 0}, {chr(97 + i): 2**i for i in range(20)}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
        got = {r.source: r.target for r in op11.targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes)) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_permutations_hold_every_number_once(spark):
    for n in (1, 2, 3, 64, 1000):
        got = [r[0] for r in spark.range(n).select(op11.permuted(F.col("id"), F.lit(n).cast("long"), 7, "k")).collect()]
        assert sorted(got) == list(range(n)) and (n < 64 or got != sorted(got))


def test_documents_and_texts(spark):
    docs = spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3)
    planned = op11.mix(docs, keep_text=True)
    got = op11.taken(planned).collect()
    assert len(got) == len(TEXTS)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    per = Counter()
    for s, t in TEXTS:
        per[s] += size(t)
    want, took = plain_targets(per), Counter()
    assert sorted((r.doc_id if r.doc_id is not None else 4, r.size) for r in got) == [(i, size(t)) for i, (_, t) in enumerate(TEXTS)]
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == per[r.source] and r.target == pytest.approx(want[r.source])
        took[r.source] += r.taken
    blocks = {r.source: r.block for r in planned.sources.collect()}
    for s in per:
        assert abs(took[s] - want[s]) <= 1.5 * blocks[s] + 1
    # the mix holds the words that the documents were told to give
    words, own = Counter(), {(s, w) for s, t in TEXTS for w in (t or "").split()}
    for r in op11.mixed(planned).collect():
        found = r.text.split()
        words[r.source] += len(found)
        assert all((r.source, w) in own for w in found) and len(found) <= op11.BLOCK
    assert words == +took
    again = op11.source_mix(docs.coalesce(1))
    assert oracle.of_spark(again) == oracle.of_spark(op11.taken(planned))


def test_no_words_and_no_rows(spark):
    docs = spark.createDataFrame(rows([("a", None), (None, " "), ("b", "")]), SCHEMA)
    assert [(r.size, r.taken, r.target) for r in op11.source_mix(docs).collect()] == [(0, 0, 0.0)] * 3
    assert op11.source_mix(docs.where("false")).count() == 0


def test_many_sources_and_a_hot_one(spark, monkeypatch):
    """Sources too many to broadcast are joined salted; one source with most documents is cut by range."""
    monkeypatch.setattr(op11, "BROADCAST_ROWS", 1)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 60)).alias("source"), F.expr("repeat('w ', cast(1 + id % 40 as int))").alias("text"))
    got = op11.source_mix(docs).toPandas()
    assert len(got) == 600 and (got.taken <= 3 * got["size"]).all()
    per = got.groupby("source").agg({"taken": "sum", "target": "first", "source_size": "first"})
    assert (abs(per.taken - per.target) <= 0.05 * per.target + 3).all()


def test_native(spark, small):
    text = op11.source_mix(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", text) and "CartesianProduct" not in text
