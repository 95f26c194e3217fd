"""Tokens with part of speech, lemma and entity: from a lexicon, or from a given tagger.

A tagger is a function from a text column to a column array<struct<text, tag, lemma, ent>>, for instance a pandas UDF around a model. Each distinct phrase
of a table goes through it once. Without one, tokens are cut by a pattern and looked up in a lexicon; words outside it are tagged by their form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions import text as t
from phrasemill.functions import words as lists

Tagger = Callable[[Column], Column]
#: A lexicon of at most so many words travels whole, in so many small maps by the words' hash; a larger one is joined.
LEXICON_MAP_ROWS, MAPS = 2000, 256
TOKENS = "array<struct<text:string,tag:string,lemma:string,ent:string>>"


def lexicon(spark) -> DataFrame:
    return spark.createDataFrame(list(lists.LEXICON), "word string, tag string, ent string")


def _own_phrases(df: DataFrame, key: str, phrases: tuple[Column, ...]) -> DataFrame:
    every = F.array_distinct(F.flatten(F.array(*phrases)))
    return df.select(F.col(key).alias("_key"), F.explode(every).alias("phrase")).where("phrase is not null")


def with_tagger(df: DataFrame, words: DataFrame, key: str, *phrases: Column, tagger: Tagger | None = None) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Prepares ``df`` for tagging: adds a column ``_tags`` and gives the function that turns a phrase into its tokens (TOKENS). ``phrases`` are arrays of the
    texts that will be asked for, ``key`` names the row.

    A small lexicon is one broadcast value; of a larger one each row gets the words of its phrases, and of a tagger the tokens of its phrases, by a join of
    distinct words or phrases. Of several entries of a word the least counts.
    """
    if tagger is not None:
        long = _own_phrases(df, key, phrases)
        told = long.select("phrase").distinct().withColumn("tokens", tagger(F.col("phrase")).cast(TOKENS))
        maps = long.join(told, "phrase").groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("phrase", "tokens"))).alias("_tags"))
        out = df.join(maps, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        return out, lambda phrase: F.coalesce(F.try_element_at(F.col("_tags"), phrase), F.array().cast(TOKENS))
    out, known = _with_lexicon(df, words, key, *phrases)

    def one_token(x: Column) -> Column:
        """``x`` is a struct of the word, its lower case and its entry."""
        tag = F.coalesce(x["entry"]["tag"], t.guessed_tag(x["text"]))
        return F.struct(x["text"].alias("text"), tag.alias("tag"), x["lemma"].alias("lemma"), F.coalesce(x["entry"]["ent"], F.lit("")).alias("ent"))

    def of(phrase: Column) -> Column:
        low = F.transform(t.tokens(phrase), lambda w: F.struct(w.alias("text"), F.lower(w).alias("lemma")))
        found = F.transform(low, lambda x: F.struct(x["text"].alias("text"), x["lemma"].alias("lemma"), known(x["lemma"]).alias("entry")))
        return F.transform(found, one_token)

    return out, of


def _with_lexicon(df: DataFrame, words: DataFrame, key: str, *phrases: Column) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``df`` with a column ``_tags``, and the function from a lower-case word to its entry (tag, ent), null outside the lexicon."""
    entry = words.groupBy("word").agg(F.min(F.struct("tag", "ent")).alias("entry"))
    place = lambda w: F.pmod(F.xxhash64(w), F.lit(MAPS)).cast("int")
    if words.count() <= LEXICON_MAP_ROWS:
        every = entry.agg(F.collect_list(F.struct(place(F.col("word")).alias("place"), F.struct("word", "entry").alias("e"))).alias("all"))
        one = lambda k: F.map_from_entries(F.transform(F.filter("all", lambda x: x["place"] == k), lambda x: x["e"]))
        out = df.crossJoin(F.broadcast(every.select(F.transform(F.sequence(F.lit(0), F.lit(MAPS - 1)), one).alias("_tags"))))
        known = lambda low: F.try_element_at(F.get("_tags", place(low)), low)
    else:
        own = _own_phrases(df, key, phrases).select("_key", F.explode(F.transform(t.tokens(F.col("phrase")), F.lower)).alias("word")).distinct().join(entry, "word")
        maps = own.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("word", "entry"))).alias("_tags"))
        out = df.join(maps, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")
        known = lambda low: F.try_element_at(F.col("_tags"), low)
    return out, known


def with_words(df: DataFrame, words: DataFrame, key: str, phrase: Column, tagger: Tagger | None = None) -> DataFrame:
    """Adds ``_words``, ``_low`` and ``_pos``: the texts, lower-case texts and tags of the phrase's tokens. Long texts are worked on as such arrays of strings:
    building a struct for each token several times over costs more than tagging it."""
    if tagger is not None:
        out, of = with_tagger(df, words, key, F.array(phrase), tagger=tagger)
        out = once(out, "_tokens", of(phrase)).withColumns({"_words": part(F.col("_tokens"), "text"), "_pos": part(F.col("_tokens"), "tag")})
        return out.withColumn("_low", F.transform("_words", F.lower)).drop("_tags", "_tokens")
    out, known = _with_lexicon(df, words, key, F.array(phrase))
    out = once(once(out, "_words", t.tokens(phrase)), "_low", F.transform("_words", F.lower))
    tag = lambda low, i: F.coalesce(known(low)["tag"], t.guessed_tag(F.get("_words", i), low))
    return once(out, "_pos", F.transform("_low", tag)).drop("_tags")


def once(df: DataFrame, name: str, c: Column, test: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``c`` (where the test holds) by a generator of one element or none: it is computed once, where a projection or filter that
    uses it several times would compute it again."""
    rows = F.array(c)
    return df.select("*", F.explode(rows if test is None else F.filter(rows, test)).alias(name))


def part(tokens: Column, name: str) -> Column:
    return F.transform(tokens, lambda x: x[name])


def tag_phrases(phrases: DataFrame, words: DataFrame, id_col: str = "id", col: str = "phrase", tagger: Tagger | None = None) -> DataFrame:
    """-> id, tags of each phrase."""
    out, of = with_tagger(phrases, words, id_col, F.array(col), tagger=tagger)
    return once(out, "_tokens", of(F.col(col))).select(id_col, part(F.col("_tokens"), "tag").alias("tags"))
