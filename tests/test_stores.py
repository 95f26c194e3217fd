"""Quantiles over ranges, serving lookups, the index in increments, stored calibrations."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from phrasemill.operators import bibliography as b
from phrasemill.operators import tagging, trials, vectors
from phrasemill.operators.pattern_index import PatternIndex
from phrasemill.sources import writers


@pytest.mark.parametrize("parts", [1, 9])
def test_quantile(spark, parts):
    rng = random.Random(1)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for n in (0, 1, 2, 11, 400):
            xs = [rng.choice([0.5, 0.5, rng.random(), -1.0]) for _ in range(n)]
            df = spark.createDataFrame([(x,) for x in [*xs, None]], "v double").repartition(5)
            for share in (0.0, 0.1, 0.5, 1.0):
                at, own = share * (n - 1), sorted(xs)
                want = own[math.floor(at)] + (own[math.ceil(at)] - own[math.floor(at)]) * (at - math.floor(at)) if n else None
                got = vectors.quantile(df, "v", share).first()[0]
                assert got == want if want is None else abs(got - want) < 1e-12
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def scanned(df):
    """Rows that the scan of a plan put out."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    plans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(p.metrics().apply("numOutputRows").value() for p in plans if p.metrics().contains("numOutputRows"))


def test_a_lookup_skips_row_groups(spark, tmp_path):
    """Fillers lie by tag and preposition; a lookup of one filler without its slot reads the row groups that may hold it."""
    n = 40_000
    own = spark.range(n).select(F.when(F.col("id") % 2 == 0, "of_object").otherwise("list_item").alias("slot_type"), F.concat(F.lit("Filler "), F.md5(F.col("id").cast("string"))).alias("filler"), F.concat(F.lit("T"), F.col("id") % 7).alias("pos_tag"), F.lit(None).cast("string").alias("prep"))
    writers.write_serving(own.coalesce(2), str(tmp_path / "serving"), row_group=60_000)
    name = own.limit(1).first().filler
    found = writers.read_serving(spark, str(tmp_path / "serving"), name.upper())
    assert [r.filler for r in found.collect()] == [name]
    assert scanned(found) < n / 4 and writers.read_serving(spark, str(tmp_path / "serving")).count() == n
    assert writers.read_serving(spark, str(tmp_path / "serving"), "no such filler").count() == 0


def test_index_in_increments(spark, tmp_path):
    words = b.lexicon(spark)
    texts = [(i, x) for i, x in enumerate(["the art of war", "a cold anvil", "the art of money", "Money", "the end of Race", "a large anvil", "Money", "the art of war"])]
    df = lambda ids: spark.createDataFrame([t for t in texts if t[0] in ids], "id long, phrase string")
    index = PatternIndex(spark, f"file://{tmp_path}/index")

    def rebuilt(ids):
        return {(r.template, r["count"], r.example) for r in b.pattern_index(b.templates(df(ids), words)).collect()}

    def now():
        return {(r.template, r["count"], r.example) for r in index.index().collect()}

    assert now() == set()
    assert index.add(df({2, 3, 5}), words, 0) and now() == rebuilt({2, 3, 5})
    assert index.add(df({1, 2, 3, 6}), words, 1) and now() == rebuilt({1, 2, 3, 5, 6})  # known texts aren't counted again, an example moves to a lesser id
    assert not index.add(df({0}), words, 1) and now() == rebuilt({1, 2, 3, 5, 6})  # a version that stands
    assert index.remove(df({1, 3, 4}), 2) and now() == rebuilt({2, 5, 6})  # examples go to the least id left, 4 was never there
    assert index.remove(df({6}), 3) and now() == rebuilt({2, 5})  # a template leaves
    assert index.add(df(range(8)), words, 4) and now() == rebuilt(set(range(8)))  # removed texts may come back
    assert {r.id for r in index.analyzed().collect()} == set(range(8))


def test_each_phrase_is_tagged_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf(tagging.TOKENS)
    def tagger(x):
        seen.add(1)
        return [(x, "NOUN", x, "")]

    rows = [(i, f"p{i % 3}") for i in range(30)]
    out = b.templates(spark.createDataFrame(rows, "id long, phrase string"), b.lexicon(spark), tagger)
    assert {r.template for r in out.collect()} == {"NOUN"} and seen.value == 3


def test_stored_calibration(spark):
    rows = [(1, k, 1.0, x, 5.0 + k, 4.0, 3.0, 4.0 + k, 0.5, 10, 1.0, k == 2) for k, x in enumerate((0.0, 0.05, 0.1))] + [(2, k, x, 0.1, 1.0, 2.0, 3.0, 4.0 - k, 0.5, 10, x, k == 0) for k, x in enumerate((0.0, 0.2))]
    made = spark.createDataFrame(rows, "phase int, level int, remix_prob double, min_sim double, coherence double, evocativeness double, surprise double, overall double, quality double, n long, remix_rate double, best boolean")
    base = spark.createDataFrame([(0.5, 0.1, 0.2, 0.3)], "mean double, std double, least double, p10 double")
    stored = trials.results(made, base)
    got = {r.key: r.value for r in stored.collect()}
    assert float(got["remix_calibrated_min_sim"]) == 0.1 and float(got["remix_calibrated_remix_prob"]) == 0.0 and len(got) == 5
    assert json.loads(got["remix_baseline_sim"]) == {"mean": 0.5, "std": 0.1, "min": 0.2, "p10": 0.3}
    phase = json.loads(got["remix_phase1_results"])
    assert list(phase) == ["0.0", "0.05", "0.1"] and phase["0.05"] == {"avg": 5.0, "dims": {"coherence": 6.0, "evocativeness": 4.0, "surprise": 3.0}, "remix_rate": 1.0}
    req = spark.createDataFrame([(1, None, None), (2, 0.3, None), (3, None, 0.7)], "id int, remix_prob double, min_sim double")
    look = lambda s: {r.id: (r.remix_prob, r.min_sim) for r in trials.with_calibrated(req, s).collect()}
    assert look(stored) == {1: (0.0, 0.1), 2: (0.3, 0.1), 3: (0.0, 0.7)} and look(stored.where("false"))[1] == (0.8, 0.1)
