"""Phrases anywhere in texts against a plain search, over one shard and many."""

import random

import pytest
from pyspark.sql import functions as F

from phrasemill.operators import bibliography as b
from phrasemill.operators import search


@pytest.mark.parametrize("chars", [4_000_000, 60])
def test_first_holders(spark, monkeypatch, chars):
    monkeypatch.setattr(search, "SHARD_CHARS", chars)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé .") for _ in range(n))
    texts = [(rng.randint(-50, 50), word(rng.randint(0, 40)) if i % 9 else None, "x") for i in range(80)] + [(None, "abab", "x"), (-99, "y" * 300_000 + "qq", "x")]
    phrases = {word(rng.randint(1, 4)) for _ in range(120)} | {"", "yqq", "zz"}
    want = {p: min((i for i, t, _ in texts if i is not None and t is not None and p in t), default=None) for p in phrases}
    df = spark.createDataFrame(texts, "id long, text string, phrase string").repartition(5)
    got = search.first_holders(spark.createDataFrame([(p,) for p in [*phrases, None, *phrases]], "phrase string"), df).collect()
    assert {r.phrase: r.id for r in got} == {p: i for p, i in want.items() if i is not None} and len(got) == len({r.phrase for r in got})
    assert search.first_holders(spark.createDataFrame([], "phrase string"), df).count() == 0
    assert search.first_holders(spark.createDataFrame([("a",)], "phrase string"), df.where("false")).count() == 0


def test_sources_inside_words(spark):
    """A filler is found as LIKE '%filler%' finds it: inside words and over punctuation, without case."""
    texts = [(3, "A", "the heart of it all", "openlibrary"), (2, None, "re-martial-ing / ", "part01"), (9, "B", "The Heart of it all", "part02"), (7, " C /", "", "part03")]
    subtitles = spark.createDataFrame(texts, "id long, title string, subtitle string, source_file string")
    fillers = spark.createDataFrame([("of_object", "Known", 7)], "slot_type string, filler string, source_subtitle_id long")
    wanted = [("of_object", x) for x in ("eart of", "MARTIAL", "t all", "known", "absent", "l-in", None)] + [("list_item", "known")]
    got = b.find_sources(spark.createDataFrame(wanted, "slot_type string, filler string"), fillers, subtitles).collect()
    assert {(r.slot_type, r.filler): (r.description, r.source_tag) for r in got} == {
        ("of_object", "eart of"): ("A: the heart of it all", "OL"), ("of_object", "MARTIAL"): ("re-martial-ing", "LOC"), ("of_object", "t all"): ("A: the heart of it all", "OL"), ("of_object", "l-in"): ("re-martial-ing", "LOC"),
        ("of_object", "known"): ("C", "LOC"), ("of_object", "absent"): (None, None), ("of_object", None): (None, None), ("list_item", "known"): (None, None),
    }


def test_texts_are_not_shuffled(spark, small):
    plan = search.first_holders(spark.createDataFrame([("a",)], "phrase string"), spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and text.index("HashAggregate") < text.index("Exchange") < text.index("MapInArrow")
