"""Tables of cases for text functions and article choice."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from phrasemill.functions import text as t
from phrasemill.operators import bibliography as b
from phrasemill.operators import tagging


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows)]


def test_a_or_an(spark):
    cases = {"ethnic": "an", "road": "a", "hour": "an", "university": "a", "FBI": "an", "U.S. money": "a", "unimportant man": "an", "": "a"}
    assert column(spark, cases, lambda c: t.a_or_an(F.lit("a"), c)) == list(cases.values())
    assert column(spark, ["hour"], lambda c: t.a_or_an(F.lit("the"), c)) == ["the"]


def test_title_case(spark):
    cases = {
        "race, power, and the rise of an empire": "Race, Power, and the Rise of an Empire", "the iPhone of doom": "The iPhone of Doom",
        "life in the U.S. and of": "Life in the U.S. and Of", "": "",
    }
    assert column(spark, cases, t.title_case) == list(cases.values())


def test_leading_articles(spark):
    cases = {"the American Dream": ("the", "American Dream"), "a Revolution": ("a", "Revolution"), "an Empire": ("an", "Empire"), "Modern Science": ("", "Modern Science"), "The Nuclear Revolution": ("the", "Nuclear Revolution")}
    assert column(spark, cases, t.leading_article) == [v[0] for v in cases.values()]
    assert column(spark, cases, t.without_article) == [v[1] for v in cases.values()]


def test_cleaning(spark):
    assert column(spark, ["  a  history of /  ", "abc :", "x. y. z .", None], t.clean_record_subtitle) == ["a history of", None, "x. y. z", None]
    assert column(spark, ["a history  of / "], t.clean_edition_subtitle) == ["a history of"]
    assert column(spark, [" 89-8 3818 "], t.normalize_lccn) == ["8983818"]


def test_judgements(spark):
    assert column(spark, ["Independent Fi", "Independent Fil", "Class A", "A", "CIA", "x Ab"], t.is_truncated) == [True, False, True, False, False, True]
    assert column(spark, ["caf¿", "café", "a–b", "日本"], t.has_artifacts) == [True, False, False, True]
    assert column(spark, ["U. S. Money", "D. C policy", "plain"], t.join_initials) == ["U.S. Money", "D.C. policy", "plain"]
    assert column(spark, ["the making", "secret life", "SHOUTING rise", "a b c rise", "blue"], t.is_valid_action) == [True, True, False, False, False]


ARTICLES = [("american dream", "the", 14), ("american dream", "", 2), ("tie", "the", 2), ("tie", "a", 2), ("science", "", 9), ("science", "the", 1), ("dream", "a", 3), ("rare", "an", 1)]


def test_majority_and_backoff(spark):
    counts = spark.createDataFrame([("of_object", *a) for a in ARTICLES], "slot_type string, filler_lc string, article string, n long")
    got = {r.filler_lc: r.article for r in b.majority_articles(counts).collect()}
    assert got == {"american dream": "the", "science": "", "dream": "a", "rare": "an"}
    assert "rare" not in {r.filler_lc for r in b.majority_articles(counts, 2).collect()}
    phrases = spark.createDataFrame([("American Dream",), ("Bad Dream",), ("Dream",), ("Science",), ("Nothing Else",)], "phrase string")
    assert {r.phrase: r.article for r in b.article_for(phrases, b.majority_articles(counts)).collect()} == {"American Dream": "the", "Bad Dream": "a", "Dream": "a", "Science": "", "Nothing Else": ""}


def test_tags(spark):
    p = spark.createDataFrame([(i, x) for i, x in enumerate(("the small anvil of Africa", "", "U.S. money - 1984", "famous quickly", None))], "id long, phrase string")
    got = {r.id: r.tags for r in tagging.tag_phrases(p, b.lexicon(spark)).collect()}
    assert got[0] == ["DET", "ADJ", "NOUN", "ADP", "PROPN"] and got[1] == [] and got[2] == ["PROPN", "NOUN", "PUNCT", "NUM"] and len(got) == 5


@F.pandas_udf(ArrayType(StructType([StructField(k, StringType()) for k in ("text", "tag", "lemma", "ent")])))
def model(texts: pd.Series) -> pd.Series:
    """A stand-in for a model: capitals are names, ``of`` is a preposition, a hyphenated word is one token."""
    tag = lambda w: "ADP" if w == "of" else "PROPN" if w[:1].isupper() else "PUNCT" if w in ",;" else "NOUN"
    return texts.map(lambda x: [{"text": w, "tag": tag(w), "lemma": w.lower(), "ent": "PERSON" if w == "Ada" else ""} for w in x.replace(",", " ,").split()])


def test_a_given_tagger(spark):
    """Tags, validation, splits and templates all take the tagger's tokens; each distinct phrase is tagged once."""
    words = b.lexicon(spark)
    p = spark.createDataFrame([(1, "state-of-the-art Art"), (2, "kings of Kings"), (3, "kings of Kings")], "id long, phrase string")
    assert {r.id: r.tags for r in tagging.tag_phrases(p, words, tagger=model).collect()} == {1: ["NOUN", "PROPN"], 2: ["NOUN", "ADP", "PROPN"], 3: ["NOUN", "ADP", "PROPN"]}
    got = {r.id: r.template for r in b.templates(p, words, model).collect()}
    assert got == {1: "NOUN PROPN", 2: "NOUN of PROPN", 3: "NOUN of PROPN"}
    rows = [(1, "t", "s", ["Race", "Power,", "x of y"], "rise", "the", "green Fields", "the"), (2, "t", "s", ["Race", "of"], "rise", "the", "Fields", "")]
    found = spark.createDataFrame(rows, "subtitle_id long, title string, subtitle string, list_items array<string>, action_noun string, action_article string, of_object string, of_article string")
    assert [(r.subtitle_id, r.list_items) for r in b.validated(found, words, model).collect()] == [(1, ["Race", "Power"])]
    objects = spark.createDataFrame([("kings of Kings", 1, 1), ("Ada lovelace", 1, 2), ("Green fields", 1, 3)], "filler string, freq long, source_subtitle_id long")
    split = {r.filler: r for r in b.split_parts(objects, words, model).collect()}
    assert split["kings of Kings"].prep_split.topic == "kings" and split["Ada lovelace"].compound is None and split["Green fields"].compound.head == "fields"


def test_lexicons_of_any_size_agree(spark, small, monkeypatch):
    """A lexicon that is joined gives the results of one that travels as a map."""
    from phrasemill.plans import bibliography as bib

    few = b.lexicon(spark)
    many = few.unionByName(spark.range(5000).select(F.concat(F.lit("word"), "id").alias("word"), F.lit("VERB").alias("tag"), F.lit("").alias("ent")))
    objects = bib.pools(spark, small).where("slot_type = 'of_object'").drop("slot_type")
    texts = bib.sentences(spark, small).where("pos < 3").withColumn("id", F.struct("doc_id", "pos"))
    jobs = {
        "validated": lambda words: b.validated(bib.found(spark, small), words), "split": lambda words: b.split_parts(objects, words),
        "templates": lambda words: b.templates(texts.select("id", "phrase"), words),
    }
    for name, job in jobs.items():
        one, two = (sorted(map(str, job(words).collect())) for words in (few, many))
        assert one == two and len(one) > 0, name
