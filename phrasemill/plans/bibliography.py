"""Queries over bibliographic records and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasemill import fixtures
from phrasemill.functions import text as t
from phrasemill.functions import words as lists
from phrasemill.operators import bibliography as b
from phrasemill.operators.pattern_index import PatternIndex
from phrasemill.plans import duck
from phrasemill.plans.duck import chain
from phrasemill.session import build_table, rows_built, scratch, spread


def raw(spark, d):
    return fixtures.view(spark, d, "editions_raw")


def cleaned(spark, d):
    return build_table(spark, d, "cleaned", b.clean_records, lambda: raw(spark, d))


def merged(spark, d):
    return build_table(spark, d, "subtitles", lambda: b.merge_sources(cleaned(spark, d)))


def counters(spark, d):
    """What the writes of an extraction observed."""
    merged(spark, d)
    kept, (rows, scanned) = rows_built(spark, d, "subtitles")[0], rows_built(spark, d, "cleaned")
    return b.extract_counters(spark, scanned, rows, kept)


def found(spark, d):
    return build_table(spark, d, "pattern_matches", lambda: b.matches(spread(merged(spark, d))))


def valid(spark, d):
    return build_table(spark, d, "valid_matches", lambda: b.validated(spread(found(spark, d)), b.lexicon(spark)))


def pools(spark, d):
    return build_table(spark, d, "slot_fillers", lambda: b.slot_pools(valid(spark, d)))


def articles(spark, d):
    return b.article_counts(valid(spark, d))


def split(spark, d):
    return build_table(spark, d, "object_splits", lambda: b.split_parts(pools(spark, d).where("slot_type = 'of_object'").drop("slot_type"), b.lexicon(spark)))


def parts(spark, d):
    return build_table(spark, d, "part_fillers", lambda: b.part_pools(split(spark, d)))


def sentences(spark, d):
    """Every English sentence of ``documents``, however late or long; its id is the document's with the place in it."""
    s = spread(fixtures.view(spark, d, "documents")).where("lang = 'en'").select("doc_id", F.posexplode(F.split("text", "[.\n]")).alias("pos", "s"))
    return s.select(F.struct("doc_id", "pos").alias("id"), "doc_id", "pos", F.trim("s").alias("phrase")).where("phrase <> ''")


def analyzed(spark, d):
    return build_table(spark, d, "analyzed", lambda: b.templates(sentences(spark, d), b.lexicon(spark)))


def incremental_index(spark, d):
    """The index after two increments, a removal and the texts' return."""
    texts, words = sentences(spark, d).select("id", "doc_id", "phrase"), b.lexicon(spark)
    index = PatternIndex(spark, scratch(spark, "pattern-index"), "struct<doc_id:bigint,pos:int>")
    index.add(texts.where("doc_id % 3 = 0"), words, 0)
    index.add(texts, words, 1)
    index.remove(texts.where("doc_id % 4 = 1"), 2)
    index.add(texts.where("doc_id % 2 = 1"), words, 3)
    return index.index()


PHRASES = ("U. S. Money", "D. C  Life", "Grit  and  Fil", "GOLFERS", "Things", "new bibliographies", "São Paulo", "Caf¿", "Independent Fi", "The X", "a 1984 rule", "secret life", "NBA")


def judged(spark, d):
    p = fixtures.view(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("p_partkey") % len(PHRASES)).cast("int") + 1)).alias("phrase"))
    x = F.col("phrase")
    return p.select("p_partkey", "phrase", t.join_initials(x).alias("joined"), t.has_artifacts(x).alias("artifacts"), t.is_truncated(x).alias("truncated"), t.is_weak(x).alias("weak"), t.shouts(x).alias("shouts"), t.is_valid_action(x).alias("valid_action"), t.strip_ending(x).alias("bare"), t.leading_article(x).alias("article"), t.without_article(x).alias("no_article"))


def source_parts(spark, d, choice="1,3,5-9"):
    """A3: rows of the chosen source parts."""
    return b_chosen(raw(spark, d), choice).groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))


def b_chosen(df, choice: str):
    """Rows whose source is among the parts named by ``all``, numbers and ranges, clipped to 1..43."""
    spans = F.explode(F.split(F.lit("1-43" if choice == "all" else choice), ","))
    own = df.sparkSession.range(1).select(spans.alias("s")).select(F.explode(F.sequence(F.split("s", "-")[0].cast("int"), F.element_at(F.split("s", "-"), -1).cast("int"))).alias("k")).where("k between 1 and 43")
    return df.join(F.broadcast(own.select(F.concat(F.lit("part"), F.lpad(F.col("k").cast("string"), 2, "0")).alias("source_file")).distinct()), "source_file", "left_semi")


#: Phrases that are no filler: words, parts of words, over punctuation, of other case, and one that no text holds.
WANTED = ("the secret", "no such thing", "cret lif", "frica, and", "RISE OF", "merica", "d the ma", ", and a", "of the", "urope")

QUERIES = {
    "a03_source_parts": (source_parts, chain("select source_file, count(*) as n from editions_raw where source_file in ('part01', 'part03', 'part05', 'part06', 'part07', 'part08', 'part09') group by 1")),
    "b01_b02_language": (
        lambda s, d: raw(s, d).select("id", t.record_language(F.concat(F.lpad(F.lit(""), 35, "x"), F.rpad(F.coalesce("lang", F.lit("")), 5, " "))).alias("record_lang"), t.is_english_record(F.col("lang")).alias("record_ok"), t.edition_language(F.when(F.col("lang").isNotNull(), F.array(F.struct(F.concat(F.lit("/languages/"), "lang").alias("key"))))).alias("edition_lang")),
        chain("select id, coalesce(lang, '') as record_lang, lang is null or lang in ('', 'eng') as record_ok, lang as edition_lang from editions_raw"),
    ),
    "b03_b08_cleaning": (
        lambda s, d: raw(s, d).select("id", t.clean_record_subtitle(F.col("raw_subtitle")).alias("record_subtitle"), t.clean_edition_subtitle(F.col("raw_subtitle")).alias("edition_subtitle"), t.clean_title(F.col("title")).alias("title"), t.normalize_lccn(F.col("lccn")).alias("lccn"), t.pick_isbn(F.when(F.col("id") % 3 == 0, F.array("isbn")), F.array(F.lit(" 123 "))).alias("isbn"), (F.col("raw_subtitle").isNotNull() & (F.col("raw_subtitle") != "")).alias("has_subtitle")),
        chain(rf"select id, case when length({duck.CLEAN_RECORD}) >= 5 then {duck.CLEAN_RECORD} end as record_subtitle, case when length({duck.CLEAN_EDITION}) >= 5 then {duck.CLEAN_EDITION} end as edition_subtitle, trim(regexp_replace(title, '\s*[/:;.]\s*$', '')) as title, regexp_replace(lccn, '[\s\-]', '', 'g') as lccn, trim(case when id % 3 = 0 then coalesce(isbn, ' 123 ') else ' 123 ' end) as isbn, raw_subtitle is not null and raw_subtitle <> '' as has_subtitle from editions_raw"),
    ),
    "b09_b11_prefilter": (
        lambda s, d: raw(s, d).select("id", t.may_match(F.col("raw_subtitle")).alias("may_match"), t.is_noise(F.col("raw_subtitle")).alias("noise"), ((F.col("source_file") == "openlibrary") & (F.coalesce("isbn", F.lit("")) == "") & (F.coalesce("lccn", F.lit("")) == "")).alias("anonymous")),
        chain("select id, raw_subtitle ilike '%, % and the % of %' or raw_subtitle ilike '%, % and a % of %' or raw_subtitle ilike '%, % and an % of %' as may_match, regexp_matches(lower(raw_subtitle), 'hearing|subcommittee|committee|congress|session') as noise, source_file = 'openlibrary' and coalesce(isbn, '') = '' and coalesce(lccn, '') = '' as anonymous from editions_raw"),
    ),
    "b12_b15_matches": (lambda s, d: found(s, d).drop("title"), chain("select subtitle_id, subtitle, list_items, action_noun, action_article, of_object, of_article from found")),
    "b16_b21_judged": (
        judged,
        "with p as (select p_partkey, p_name || ' ' || ([" + duck.quoted(PHRASES) + f"])[(p_partkey % {len(PHRASES)}) + 1] as phrase from part) select p_partkey, phrase, {duck.initials('phrase')} as joined, {duck.artifacts('phrase')} as artifacts, {duck.truncated('phrase')} as truncated, {duck.weak('phrase')} as weak, {duck.shouts('phrase')} as shouts, {duck.action('phrase')} as valid_action, {duck.ending('phrase')} as bare, lower(regexp_extract(phrase, '(?i)^(a|an|the)\\s+', 1)) as article, regexp_replace(phrase, '(?i)^(?:a|an|the)\\s+', '') as no_article from p",
    ),
    "b22_b24_validated": (lambda s, d: valid(s, d).drop("title"), chain("select subtitle_id, subtitle, list_items, action_noun, action_article, of_object, of_article from valid")),
    "c01_c02_e01_g02_merged": (lambda s, d: merged(s, d), chain("select id, source_file, title, lang, lccn, isbn, work_key, subtitle from merged")),
    "c03_d08_f01_patterns": (
        lambda s, d: b.pattern_index(analyzed(s, d)).where("count >= 2").orderBy(F.desc("count"), "template").limit(50),
        f"with {duck.LEX}{duck.TEMPLATES} select template, count(*) as count, arg_min(phrase, id) as example from tpl group by 1 having count(*) >= 2 order by 2 desc, 1 limit 50",
    ),
    "c04_provenance": (lambda s, d: b.provenance(pools(s, d), merged(s, d)), chain("select slot_type, filler, m.title, m.subtitle as subtitle_text, case when source_file = 'openlibrary' then 'OL' else 'LOC' end as source_tag from pools p join merged m on m.id = p.source_subtitle_id")),
    "c05_find_sources": (
        lambda s, d: b.find_sources(pools(s, d).select("slot_type", F.upper("filler").alias("filler")).unionByName(s.createDataFrame([("of_object", x) for x in WANTED], "slot_type string, filler string")), pools(s, d), merged(s, d)),
        chain(r"""select slot_type, filler, case when h is not null then concat_ws(': ', nullif(regexp_replace(trim(coalesce(h.title, '')), '[ /:]+$', ''), ''), nullif(regexp_replace(trim(coalesce(h.text, '')), '[ /:]+$', ''), '')) end as description, h.tag as source_tag from (
          select w.slot_type, w.filler, coalesce(k.s, c.s) as h from wa w left join kn k on k.slot_type = w.slot_type and k.k = lower(w.filler)
          left join (select w.slot_type, w.filler, arg_min({'filler': w.filler, 'title': m.title, 'text': m.subtitle, 'tag': case when source_file = 'openlibrary' then 'OL' else 'LOC' end}, m.id) as s from wa w join merged m on contains(lower(m.subtitle), lower(w.filler)) where not exists (select 1 from kn where kn.slot_type = w.slot_type and kn.k = lower(w.filler)) group by 1, 2) c on c.slot_type = w.slot_type and c.filler = w.filler) x""",
          more=f"wa as (select slot_type, upper(filler) as filler from pools union all select * from (values {', '.join(f"('of_object', '{x}')" for x in WANTED)}) v(a, b)), kn as (select p.slot_type, lower(p.filler) as k, min({{'filler': p.filler, 'title': m.title, 'text': m.subtitle, 'tag': case when source_file = 'openlibrary' then 'OL' else 'LOC' end}}) as s from pools p join merged m on m.id = p.source_subtitle_id group by 1, 2)"),
    ),
    "c08_e10_articles": (
        lambda s, d: b.article_for(pools(s, d).where("slot_type = 'of_object'").select(F.col("filler").alias("phrase")), b.majority_articles(articles(s, d))),
        chain(f"select filler as phrase, coalesce(nullif(a.article, ''), nullif(z.article, ''), '') as article from pools p left join major a on a.slot_type = 'of_object' and a.filler_lc = lower(filler) left join major z on z.slot_type = 'of_object' and len({duck.words('filler')}) > 1 and z.filler_lc = {duck.words('lower(filler)')}[-1] where p.slot_type = 'of_object'"),
    ),
    "c09_tags": (
        lambda s, d: b.tag_phrases(fixtures.view(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" of the U.S. - "), "p_type").alias("phrase")), b.lexicon(s)),
        f"with {duck.LEX} select p_partkey as id, {duck.tags(chr(39).join(['p_name || ', ' of the U.S. - ', ' || p_type']))} as tags from part",
    ),
    "d01_slot_frequencies": (pools, chain("select * from pools")),
    "d02_article_counts": (articles, chain("select * from arts")),
    "d03_article_coverage": (
        lambda s, d: b.article_coverage(articles(s, d)),
        chain("select slot_type, count(*) as fillers, cast(sum(x) as bigint) as with_article, cast(sum(y) as bigint) as with_other_article from (select slot_type, filler_lc, max(cast(article <> '' as int)) as x, max(cast(article not in ('', 'the') as int)) as y from arts group by all) a group by 1"),
    ),
    "d04_part_pools": (parts, chain("select * from parts")),
    "d05_d09_slot_counts": (
        lambda s, d: pools(s, d).select("slot_type", "filler").unionByName(parts(s, d).select("slot_type", "filler")).groupBy("slot_type").agg(F.count(F.lit(1)).alias("fillers")),
        chain("select slot_type, count(*) as fillers from (select slot_type from pools union all select slot_type from parts) x group by 1"),
    ),
    "d06_tag_distribution": (
        lambda s, d: b.tag_distribution(parts(s, d)),
        chain("select kind, words, pos_tag, cast(sum(freq) as bigint) as freq from (select 'modifier' as kind, cast(len(string_split(filler, ' ')) + 1 as int) as words, pos_tag, freq from parts where slot_type = 'of_modifier' union all select 'head', 1, pos_tag, freq from parts where slot_type = 'of_head') x where words in (1, 2, 3) group by all"),
    ),
    "d07_prep_groups": (lambda s, d: b.prep_groups(parts(s, d)), chain("select prep, count(*) as n from parts where slot_type = 'of_topic' group by 1")),
    "d10_extract_counters": (counters, chain("select *, cleaned - kept as duplicates_skipped from (select (select count(*) from editions_raw) as scanned, (select count(*) from cleaned) as cleaned, (select count(*) from merged) as kept) x")),
    "d30_distinct_keys": (
        lambda s, d: raw(s, d).agg(F.count_distinct(t.normalize_lccn(F.col("lccn"))).alias("lccns"), F.count_distinct("isbn").alias("isbns"), F.count_distinct("work_key").alias("works")),
        chain(r"select count(distinct regexp_replace(lccn, '[\s\-]', '', 'g')) as lccns, count(distinct isbn) as isbns, count(distinct work_key) as works from editions_raw"),
    ),
    "e02_first_per_key": (lambda s, d: b.one_per_key(raw(s, d), "work_key", "id").select("id", "work_key"), chain("select id, work_key from (select *, row_number() over (partition by coalesce(nullif(work_key, ''), 'none' || id) order by id) as rn from editions_raw) x where rn = 1")),
    "e11_not_yet_analyzed": (lambda s, d: b.not_yet_analyzed(raw(s, d).select("id", "title"), raw(s, d).where("id % 3 = 0")), chain("select id, title from editions_raw where id % 3 <> 0")),
    "d08_pattern_index": (lambda s, d: b.pattern_index(analyzed(s, d)), f"with {duck.LEX}{duck.TEMPLATES} select template, count(*) as count, arg_min(phrase, id) as example from tpl group by 1"),
    "d08_incremental_index": (incremental_index, f"with {duck.LEX}{duck.TEMPLATES} select template, count(*) as count, arg_min(phrase, id) as example from tpl group by 1"),
    "g01_all_pools": (
        lambda s, d: pools(s, d).unionByName(parts(s, d), allowMissingColumns=True),
        chain("select slot_type, filler, freq, source_subtitle_id, cast(null as varchar) as pos_tag, cast(null as varchar) as prep from pools union all select slot_type, filler, freq, source_subtitle_id, pos_tag, prep from parts"),
    ),
    "h12_h13_templates": (lambda s, d: analyzed(s, d).select("doc_id", "pos", "template", F.transform("slot_data", lambda x: F.concat_ws("|", x["pos"], x["text"], x["multi"].cast("string"))).alias("slots")), f"with {duck.LEX}{duck.TEMPLATES} select doc_id, cast(pos as int) as pos, template, slots from tpl"),
    "h14_h16_splits": (
        lambda s, d: split(s, d).select("filler", "prep_split.topic", "prep_split.prep", "prep_split.complement", "compound.modifier", "compound.modifier_pos", "compound.head", "compound.head_pos", "remix_type", "remix_prep", "remix_word_count"),
        chain("select filler, topic, prep, complement, modifier, modifier_pos, head, head_pos, remix_type, remix_prep, case when remix_type is not null then wc end as remix_word_count from cut"),
    ),
}
