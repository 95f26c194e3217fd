"""Records to matches: cleaning, deduplication across sources, pattern matching, validation (B, C1, C2, E1, G2, D10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.functions import text as t
from phrasemill.functions import words as lists
from phrasemill.operators.search import first_holders
from phrasemill.operators.tagging import Tagger, lexicon, once, part, tag_phrases, with_tagger, with_words  # noqa: F401
from phrasemill.session import materialise, spread

#: What a literal token of a template begins with while runs are looked for.
_LITERAL = "\x1f"


def clean_records(raw: DataFrame) -> DataFrame:
    """id, source_file, title, lang, lccn, isbn, work_key, raw_subtitle -> the same with a cleaned subtitle; dirty rows leave.

    Library rows follow the record rule and may lack a language; edition rows follow the edition rule and need English.
    """
    edition = F.col("source_file") == "openlibrary"
    out = raw.where(F.col("raw_subtitle").isNotNull() & (F.col("raw_subtitle") != ""))
    out = out.where(F.when(edition, F.coalesce(F.col("lang") == "eng", F.lit(False))).otherwise(t.is_english_record(F.col("lang"))))
    subtitle = F.when(edition, t.clean_edition_subtitle(F.col("raw_subtitle"))).otherwise(t.clean_record_subtitle(F.col("raw_subtitle")))
    out = once(out.withColumn("title", F.when(edition, t.strip(F.col("title"))).otherwise(t.clean_title(F.col("title")))), "subtitle", subtitle, lambda x: x.isNotNull())
    return out.drop("raw_subtitle")


def _keyed(key: Column) -> Column:
    return F.coalesce(key != "", F.lit(False))


def _spread(key: Column, row: Column) -> Column:
    """The key, or for rows without one something of their own, so that they don't gather in one task."""
    return F.when(_keyed(key), key).otherwise(F.concat(F.lit("#"), row.cast("string")))


def drop_known(editions: DataFrame, records: DataFrame, key: str, normal=lambda c: c, row: str = "id") -> DataFrame:
    """Editions whose key no record has (one anti join); rows without a key match nothing and stay."""
    own = normal(F.col(key))
    have = records.select(own.alias("known"), F.lit(True).alias("keyed")).where(_keyed(F.col("known"))).distinct()
    return editions.join(have, (_spread(own, F.col(row)) == F.col("known")) & (_keyed(own) == F.col("keyed")), "left_anti")


def one_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, found by an aggregate that keeps one row a key before anything is dealt out; rows without a key all stay,
    each in a group of its own."""
    own = df.groupBy(_spread(F.col(key), F.col(order)).alias("_key"), _keyed(F.col(key)).alias("_keyed"))
    return own.agg(F.min_by(F.struct(*df.columns), F.struct(order)).alias("r")).select("r.*")


def merge_sources(cleaned: DataFrame) -> DataFrame:
    """Library rows and those editions that they don't hold, one edition per work, first in file order.

    ``cleaned`` is read four times, so it should be a written table.
    """
    records, editions = cleaned.where("source_file <> 'openlibrary'"), cleaned.where("source_file = 'openlibrary'")
    editions = drop_known(editions, records, "lccn", t.normalize_lccn)
    editions = drop_known(editions, records, "isbn")
    return records.unionByName(one_per_key(editions, "work_key", "id"))


def extract_counters(spark, scanned: int, cleaned: int, kept: int) -> DataFrame:
    """scanned, cleaned, kept and duplicates_skipped, of the rows that an extraction's own writes observed."""
    return spark.createDataFrame([(scanned, cleaned, kept, cleaned - kept)], "scanned long, cleaned long, kept long, duplicates_skipped long")


def matches(subtitles: DataFrame) -> DataFrame:
    """subtitle_id, title, subtitle, list_items, action_noun, action_article, of_object, of_article of the texts that fit the pattern."""
    named = ~((F.col("source_file") == "openlibrary") & (F.coalesce("isbn", F.lit("")) == "") & (F.coalesce("lccn", F.lit("")) == ""))
    near = subtitles.where(t.may_match(F.col("subtitle"))).where(named & ~t.is_noise(F.col("subtitle")))
    parts = once(near.select("id", "title", "subtitle"), "p", t.pattern_parts(F.col("subtitle")), lambda x: F.size(x) == 4)
    parts = once(parts, "list_items", t.list_items(F.col("p")[0]), lambda x: F.size(x) >= 2)
    parts = parts.withColumn("object", t.strip_ending(F.col("p")[3]))
    return parts.select(
        F.col("id").alias("subtitle_id"), "title", "subtitle", "list_items", t.strip(F.col("p")[2]).alias("action_noun"), F.lower(F.col("p")[1]).alias("action_article"),
        t.without_article(F.col("object")).alias("of_object"), t.leading_article(F.col("object")).alias("of_article"),
    )


def validated(found: DataFrame, words: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Matches whose action, object and at least two items are valid; invalid items leave the list.

    Each distinct action, object and list is judged once, and what passes is written and joined to the matches: few of them travel whole, many are a
    join by key, so tagging doesn't grow with their repetitions.
    """
    tidy = lambda x: t.join_initials(t.strip_ending(x))
    each = lambda c: spread(materialise(found.select(F.col(c).alias("_own")).where(F.col(c).isNotNull()).distinct(), "distinct"), 1 << 16)
    action = once(each("action_noun"), "_new", t.join_initials(F.col("_own")), lambda a: t.is_clean(a) & t.is_valid_action(a))
    target = once(each("of_object"), "_new", t.join_initials(F.col("_own")), t.is_clean)
    target, of = with_tagger(target, words, "_own", F.array("_new"), tagger=tagger)
    target = once(target, "_tokens", of(F.col("_new")), lambda x: t.is_valid_object(F.col("_new"), x))
    items = once(each("list_items"), "_clean", F.filter(F.transform("_own", tidy), t.is_clean), lambda x: F.size(x) >= 2)
    items, of = with_tagger(items, words, "_own", F.col("_clean"), tagger=tagger)
    tagged = F.transform("_clean", lambda x: F.struct(x.alias("item"), of(x).alias("tokens")))
    good = F.transform(F.filter(tagged, lambda x: t.is_valid_item(x["item"], x["tokens"])), lambda x: x["item"])
    items = once(items, "_new", good, lambda x: F.size(x) >= 2)
    out = found
    for column, judged in (("action_noun", action), ("of_object", target), ("list_items", items)):
        own = materialise(judged.select(F.col("_own").alias(column), "_new"), "judged")
        out = out.join(own, column).drop(column).withColumnRenamed("_new", column)
    return out.select(*found.columns)


def slot_pools(valid: DataFrame) -> DataFrame:
    """slot_type, filler, freq (occurrences) and source_subtitle_id (the first id) over one exploded table."""
    one = lambda slot, c: F.struct(F.lit(slot).alias("slot_type"), c.alias("filler"))
    rows = F.concat(F.transform("list_items", lambda x: one("list_item", x)), F.array(one("action_noun", F.col("action_noun")), one("of_object", F.col("of_object"))))
    return valid.select("subtitle_id", F.explode(rows).alias("r")).groupBy("r.slot_type", "r.filler").agg(F.count(F.lit(1)).alias("freq"), F.min("subtitle_id").alias("source_subtitle_id"))


def article_counts(valid: DataFrame) -> DataFrame:
    """slot_type, filler_lc, article, n: articles of objects and actions, without case."""
    rows = F.array(*(F.struct(F.lit(s).alias("slot_type"), F.lower(s).alias("filler_lc"), F.col(a).alias("article")) for s, a in (("of_object", "of_article"), ("action_noun", "action_article"))))
    return valid.select(F.explode(rows).alias("r")).groupBy("r.slot_type", "r.filler_lc", "r.article").agg(F.count(F.lit(1)).alias("n"))


def article_stats(counts: DataFrame) -> DataFrame:
    """slot_type, filler_lc, counts map<string,long>."""
    return counts.groupBy("slot_type", "filler_lc").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("article", "n")))).alias("counts"))


def article_coverage(counts: DataFrame) -> DataFrame:
    """Per slot: fillers, those with an article (objects), those with one that isn't ``the`` (actions)."""
    per = counts.groupBy("slot_type", "filler_lc").agg(F.max((F.col("article") != "").cast("int")).alias("any"), F.max((~F.col("article").isin("", "the")).cast("int")).alias("other"))
    return per.groupBy("slot_type").agg(F.count(F.lit(1)).alias("fillers"), F.sum("any").alias("with_article"), F.sum("other").alias("with_other_article"))


def best_articles(counts: DataFrame) -> DataFrame:
    """slot_type, filler_lc, article, n, total: the most frequent article of each filler, among equals the longest, which is
    never the missing one."""
    best = F.max_by(F.struct("article", "n"), F.struct("n", F.length("article"), F.col("article")))
    return counts.groupBy("slot_type", "filler_lc").agg(F.sum("n").alias("total"), best.alias("b")).select("slot_type", "filler_lc", "b.*", "total")


def majority_articles(counts: DataFrame, min_freq: float = 1.0, share: float | None = None) -> DataFrame:
    """slot_type, filler_lc, article: the most frequent one where the total is at least ``min_freq`` and it has over half
    (or, given ``share``, that share and isn't '').  Equals are decided as in ``best_articles``."""
    per = best_articles(counts)
    clear = F.col("n") * 2 > F.col("total") if share is None else (F.col("article") != "") & (F.col("n") >= share * F.col("total"))
    return per.where((F.col("total") >= min_freq) & clear).select("slot_type", "filler_lc", "article")


def article_for(phrases: DataFrame, majority: DataFrame, slot: str = "of_object", head: str | None = None) -> DataFrame:
    """Adds ``article``: of the whole phrase, else of its last word (or of the column ``head``), else ''."""
    dim = majority.where(F.col("slot_type") == slot).select("filler_lc", "article")
    second = F.lower(F.col(head)) if head else F.when(t.word_count(F.col("phrase")) > 1, F.lower(t.last_word(F.col("phrase"))))
    out = phrases.withColumns({"k1": F.lower("phrase"), "k2": second})
    out = out.join(dim.toDF("k1", "a1"), "k1", "left").join(dim.toDF("k2", "a2"), "k2", "left")
    return out.withColumn("article", F.coalesce(F.nullif("a1", F.lit("")), F.nullif("a2", F.lit("")), F.lit(""))).drop("k1", "k2", "a1", "a2")


def _is_noun(tag: Column) -> Column:
    return tag.isin(*lists.NOUN_TAGS)


def split_parts(objects: DataFrame, words: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """filler, freq, source_subtitle_id -> the same with ``prep_split`` and ``compound``, null where they don't apply.

    The prepositional split is at the first preposition with a noun on both sides; a compound of two or three words has its head
    last, holds no person, isn't a two-word place or noun and noun, and its head is no roman numeral.
    """
    out, of = with_tagger(objects, words, "filler", F.array("filler"), tagger=tagger)
    out = once(out, "_tokens", of(F.col("filler"))).drop("_tags")
    names = {"tok": "text", "tags": "tag", "ents": "ent"}
    out = out.withColumns({k: part(F.col("_tokens"), v) for k, v in names.items()} | {"wc": t.word_count(F.col("filler"))}).drop("_tokens")
    out = out.withColumns({"at": F.array_position("tags", "ADP"), "n": F.size("tok")})
    side = lambda lo, k: F.array_join(F.slice("tok", lo, F.greatest(k, F.lit(0))), " ")
    tag = lambda lo, k: F.array_join(F.slice("tags", lo, F.greatest(k, F.lit(0))), "+")
    left, right = F.slice("tags", 1, F.greatest(F.col("at") - 1, F.lit(0))), F.slice("tags", F.greatest(F.col("at") + 1, F.lit(1)), F.greatest(F.col("n") - F.col("at"), F.lit(0)))
    prep = F.when(
        (F.col("at") > 0) & F.exists(left, _is_noun) & F.exists(right, _is_noun),
        F.struct(side(F.lit(1), F.col("at") - 1).alias("topic"), tag(F.lit(1), F.col("at") - 1).alias("topic_pos"), F.lower(F.get("tok", F.col("at").cast("int") - 1)).alias("prep"),
                 side(F.col("at") + 1, F.col("n") - F.col("at")).alias("complement"), tag(F.col("at") + 1, F.col("n") - F.col("at")).alias("complement_pos")),
    )
    last = F.get("tags", F.col("n") - 1)
    base = F.col("wc").isin(2, 3) & (F.col("n") > 1) & ~F.array_contains("ents", "PERSON") & _is_noun(last)
    place = (F.col("wc") == 2) & F.forall("ents", lambda e: e == "GPE")
    nouns = (F.col("wc") == 2) & F.forall("tags", lambda x: x == "NOUN")
    whole = F.array_join("tok", " ") == F.col("filler")
    numeral = F.get("tok", F.col("n") - 1).isin(*lists.ROMAN)
    compound = F.when(
        base & ~place & ~nouns & ~numeral & whole & prep.isNull(),
        F.struct(side(F.lit(1), F.col("n") - 1).alias("modifier"), tag(F.lit(1), F.col("n") - 1).alias("modifier_pos"), F.get("tok", F.col("n") - 1).alias("head"), last.alias("head_pos")),
    )
    first_prep = F.lower(F.get("tok", F.col("at").cast("int") - 1))
    kind = F.when(F.col("wc") == 1, None).when(F.col("at") > 0, "type2").when(base & ~place & ~nouns, "type1")
    return out.withColumns({"prep_split": prep, "compound": compound, "remix_type": kind, "remix_prep": F.when(kind == "type2", first_prep), "remix_word_count": F.when(kind.isNotNull(), F.col("wc"))}).drop("tok", "tags", "ents", "wc", "at", "n")


def part_pools(split: DataFrame) -> DataFrame:
    """slot_type, filler, pos_tag, prep, freq, source_subtitle_id of the sub-parts, merged without case: freq summed, the rest of
    the first seen by (source id, object)."""
    one = lambda slot, a, b, c: F.struct(F.lit(slot).alias("slot_type"), F.col(a).alias("part"), F.col(b).alias("pos_tag"), (F.col(c) if c else F.lit(None).cast("string")).alias("prep"))
    parts = F.when(F.col("prep_split").isNotNull(), F.array(one("of_topic", "prep_split.topic", "prep_split.topic_pos", "prep_split.prep"), one("of_complement", "prep_split.complement", "prep_split.complement_pos", "prep_split.prep")))
    parts = parts.when(F.col("compound").isNotNull(), F.array(one("of_modifier", "compound.modifier", "compound.modifier_pos", None), one("of_head", "compound.head", "compound.head_pos", None)))
    rows = split.select("filler", "freq", "source_subtitle_id", F.explode(parts).alias("r")).select("r.*", "freq", F.struct("source_subtitle_id", "filler").alias("seen"))
    first = F.min_by(F.struct(F.col("part").alias("filler"), "pos_tag", "prep"), "seen")
    return rows.groupBy("slot_type", F.lower("part").alias("key")).agg(first.alias("f"), F.sum("freq").alias("freq"), F.min("seen")["source_subtitle_id"].alias("source_subtitle_id")).select("slot_type", "f.*", "freq", "source_subtitle_id")


def tag_distribution(parts: DataFrame) -> DataFrame:
    """kind, words, pos_tag, freq: modifiers by the words of the whole (2, 3), and heads."""
    words = F.size(F.split("filler", " "))
    mods = parts.where("slot_type = 'of_modifier'").select(F.lit("modifier").alias("kind"), (words + 1).alias("words"), "pos_tag", "freq").where("words in (2, 3)")
    heads = parts.where("slot_type = 'of_head'").select(F.lit("head").alias("kind"), F.lit(1).alias("words"), "pos_tag", "freq")
    return mods.unionByName(heads).groupBy("kind", "words", "pos_tag").agg(F.sum("freq").alias("freq"))


def prep_groups(parts: DataFrame) -> DataFrame:
    return parts.where("slot_type = 'of_topic'").groupBy("prep").agg(F.count(F.lit(1)).alias("n"))


def provenance(fillers: DataFrame, subtitles: DataFrame) -> DataFrame:
    """slot_type, filler, title, subtitle_text, source_tag of each filler's first source."""
    s = subtitles.select(F.col("id").alias("source_subtitle_id"), "title", F.col("subtitle").alias("subtitle_text"), F.when(F.col("source_file") == "openlibrary", "OL").otherwise("LOC").alias("source_tag"))
    return fillers.join(s, "source_subtitle_id").select("slot_type", "filler", "title", "subtitle_text", "source_tag")


def described(title: Column, subtitle: Column) -> Column:
    end = lambda c: F.regexp_replace(t.strip(F.coalesce(c, F.lit(""))), r"[ /:]+$", "")
    return F.concat_ws(": ", F.nullif(end(title), F.lit("")), F.nullif(end(subtitle), F.lit("")))


def find_sources(wanted: DataFrame, fillers: DataFrame, subtitles: DataFrame) -> DataFrame:
    """slot_type, filler -> description and source_tag: of the filler itself without case, else of a text that holds it, else null.

    The second lookup finds a filler anywhere in a text, inside words too (``search.first_holders``); of several texts the least id counts.
    Only ids leave the search, titles are joined to the hits.
    """
    known = provenance(fillers, subtitles).select(F.col("slot_type").alias("st"), F.lower("filler").alias("k"), F.struct("filler", "title", "subtitle_text", "source_tag").alias("s"))
    known = known.groupBy("st", "k").agg(F.min("s").alias("s"))
    first = wanted.join(known, (F.col("slot_type") == F.col("st")) & (F.lower("filler") == F.col("k")), "left").drop("st", "k")
    left = first.where("s is null").select(F.lower("filler").alias("phrase"))
    holders = first_holders(left, subtitles.select("id", F.lower("subtitle").alias("text")))
    tag = F.when(F.col("source_file") == "openlibrary", "OL").otherwise("LOC").alias("source_tag")
    texts = subtitles.select("id", F.struct("title", F.col("subtitle").alias("subtitle_text"), tag).alias("h"))
    hit = holders.join(texts, "id").groupBy("phrase").agg(F.min("h").alias("h"))
    out = first.join(hit, F.col("s").isNull() & (F.lower("filler") == F.col("phrase")), "left")
    told = lambda x: F.when(F.col(x).isNotNull(), described(F.col(f"{x}.title"), F.col(f"{x}.subtitle_text")))
    return out.select("slot_type", "filler", F.coalesce(told("s"), told("h")).alias("description"), F.coalesce("s.source_tag", "h.source_tag").alias("source_tag"))


def templates(texts: DataFrame, words: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """id, phrase -> template (literals and tags, runs of a tag as ``TAG+``) and slot_data (pos, text, multi).

    A token is itself in the template if it is literal, else its tag. Runs are found by the places where one begins: work grows with a sentence's
    length, however long.
    """
    out = with_words(texts, words, "id", F.col("phrase"), tagger)

    def placed(low: Column, i: Column) -> Column:
        """The tag, or for a literal token itself behind a mark that no tag begins with."""
        tag = F.get("_pos", i)
        mark = low.isin(*lists.LITERAL_PUNCTUATION) & (tag == "PUNCT")
        return F.when(low.isin(*lists.LITERALS) | mark, F.concat(F.lit(_LITERAL), low)).otherwise(tag)

    literal = lambda p: F.coalesce(p.startswith(_LITERAL), F.lit(False))
    out = once(out, "_parts", F.transform("_low", placed)).drop("_low", "_pos")
    begins = lambda p, i: F.when((i > 0) & (p == F.get("_parts", i - 1)) & ~literal(p), F.lit(None)).otherwise(i)
    out = once(out, "_starts", F.array_compact(F.transform("_parts", begins)))
    n = lambda s, k: F.coalesce(F.get("_starts", k + 1), F.size("_parts")) - s

    def shown(s: Column, k: Column) -> Column:
        p = F.get("_parts", s)
        return F.when(literal(p), F.substring(p, 1 + len(_LITERAL), 1 << 30)).when(n(s, k) > 1, F.concat(p, F.lit("+"))).otherwise(p)

    def slot(s: Column, k: Column) -> Column:
        p, multi = F.get("_parts", s), n(s, k) > 1
        text = F.when(multi, F.array_join(F.slice("_words", s + 1, n(s, k)), " ")).otherwise(F.get("_words", s))
        return F.when(~literal(p), F.struct(p.alias("pos"), text.alias("text"), multi.alias("multi")))

    return out.select(*texts.columns, F.array_join(F.transform("_starts", shown), " ").alias("template"), F.array_compact(F.transform("_starts", slot)).alias("slot_data"))


def pattern_index(analyzed: DataFrame) -> DataFrame:
    """template, count, example (of the least id)."""
    return analyzed.groupBy("template").agg(F.count(F.lit(1)).alias("count"), F.min_by("phrase", "id").alias("example"))


def not_yet_analyzed(texts: DataFrame, analyzed: DataFrame) -> DataFrame:
    return texts.join(analyzed.select("id"), "id", "left_anti")
