"""Queries that generate samples, and text functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasemill import fixtures
from phrasemill.functions import scores as s
from phrasemill.functions import text as t
from phrasemill.functions import words as lists
from phrasemill.operators import bibliography as b
from phrasemill.operators import feedback as f
from phrasemill.operators import generate as g
from phrasemill.operators import sampling as p
from phrasemill.operators import trials as u
from phrasemill.operators import vectors as v
from phrasemill.plans import bibliography as bib
from phrasemill.plans import duck, numbers
from phrasemill.plans.duck import chain
from phrasemill.plans.numbers import rounded
from phrasemill.session import build_table, materialise, scratch, spread
from phrasemill.sources.keyed import KeyedTable


def pools(sp, d):
    return bib.pools(sp, d).withColumn("popularity", F.when(F.length("filler") % 3 != 0, F.log10(1 + F.col("freq")) / 2))


def parts(sp, d):
    return bib.parts(sp, d).withColumn("popularity", F.lit(None).cast("double"))


def scalars(sp, d):
    """centroid_dot and norm_sq of every sub-part that has a vector; the others have no similarity."""

    def build():
        own = v.scalars(numbers.part_vectors(sp, d), v.centroid(numbers.phrase_vectors(sp, d)), "slot_type")
        return own.select("slot_type", F.col("id").alias("filler"), "centroid_dot", "norm_sq")

    return build_table(sp, d, "part_scalars", build)


def constants(sp, d):
    """The centroid's norm and the mean cross similarities of the two remix types, three numbers."""
    kinds = numbers.cross(sp, d, digits=None).groupBy().pivot("kind", ["type1", "type2"]).agg(F.first("mean_cosine"))
    one = v.centroid(numbers.phrase_vectors(sp, d)).select("centroid_norm").crossJoin(kinds)
    return tuple(build_table(sp, d, "remix_constants", lambda: one).first())


def requests(sp, d):
    """A request for each customer; some hold locks, a third asks for one tone and a third for two."""
    i = F.col("c_custkey")
    lock = lambda k, v: F.create_map(F.lit(k), F.lit(v))
    locks = F.when(i % 5 == 0, lock("item1", "Race")).when(i % 7 == 0, lock("of_head", "anvil")).when(i % 11 == 0, lock("of_object", "the end"))
    tone = F.element_at(F.array(F.lit(""), F.lit("pop"), F.lit("niche, pop")), (i % 3).cast("int") + 1)
    return fixtures.view(sp, d, "customer").select(i.alias("req_id"), (i + 1000).alias("seed"), tone.alias("tone"), F.lit(0.7).alias("remix_prob"), F.lit(0.6).alias("min_sim"), locks.alias("locks"))


def made(sp, d, req, params=None, own_pools=None):
    return g.generate(req, pools(sp, d) if own_pools is None else own_pools, parts(sp, d), bib.split(sp, d), bib.articles(sp, d), scalars(sp, d), p.defaults(sp) if params is None else params, constants(sp, d))


def samples(sp, d):
    return build_table(sp, d, "samples", lambda: made(sp, d, requests(sp, d)))


def flat(df):
    entries = F.array_sort(F.transform(F.map_entries("remix_parts"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rounded(df.withColumn("remix_parts", F.array_join(entries, ";")), "remix_similarity")


def ratings_of(made_samples):
    """The axes that a rater would give; here a hash of the text stands for the rater."""
    return made_samples.select("req_id", *(u.rated_by(F.col("text"), a).alias(a) for a in AXES))


def proposals(sp, d):
    """Every distinct change of a parameter in the experiment log, numbered from 1 by its first iteration."""
    return fixtures.view(sp, d, "experiments").groupBy("param", F.col("new_value").alias("value")).agg((1 + F.min("iteration")).alias("trial"))


def trials(sp, d):
    """All proposals clamped and evaluated as one batch, then judged in order."""
    bounds = sp.createDataFrame([(k, *v) for k, v in BOUNDS.items()], "param string, lo double, hi double")
    params = p.defaults(sp)
    own = materialise(u.clamped_trials(proposals(sp, d), bounds, params), "trials")
    every = own.select("trial", "param", "value").unionByName(sp.createDataFrame([(0, "", 0.0)], "trial long, param string, value double"))
    by_trial = materialise(u.trial_params(params, every), "trial-params")
    req = materialise(u.trial_requests(every), "trial-requests")
    texts = materialise(made(sp, d, req, by_trial), "trial-samples")
    scores = materialise(u.evaluated(texts, req, ratings_of(texts), pools(sp, d), by_trial), "trial-scores")
    return rounded(u.judged(own, scores), "quality", "separation", "composite")


def calibrated(sp, d):
    """Both sweeps over a seed for each customer."""
    seeds = fixtures.view(sp, d, "customer").select(F.col("c_custkey").alias("n"))
    out = u.calibrate(seeds, lambda req: made(sp, d, req), ratings_of)
    return rounded(out, *AXES, "overall", "quality", "remix_rate")


def calibration_log(sp, d):
    """The calibration's five results, put into the config table."""
    made_of = build_table(sp, d, "calibration", lambda: u.calibrate(fixtures.view(sp, d, "customer").select(F.col("c_custkey").alias("n")), lambda req: made(sp, d, req), ratings_of))
    vec = numbers.phrase_vectors(sp, d)
    table = KeyedTable(sp, scratch(sp, "config"), "key string, value string", ("key",), "value")
    table.upsert(sp.createDataFrame([("pop_tone_blend", "0.25"), ("remix_calibrated_min_sim", "9")], "key string, value string"), 0)
    table.upsert(u.results(made_of, v.baseline(v.scalars(vec, v.centroid(vec)))), 1)
    return table.read()


def stored_results(sp, d):
    """The stored results read back: the settings that requests get, the baseline's p10, the sums of the phases' levels."""
    stored = calibration_log(sp, d).where("key like 'remix%'")
    bare = sp.createDataFrame([(None, None)], "remix_prob double, min_sim double")
    got = u.with_calibrated(bare, stored).select(F.explode(F.create_map(F.lit("remix_calibrated_min_sim"), "min_sim", F.lit("remix_calibrated_remix_prob"), "remix_prob")).alias("key", "x"))
    phase = F.from_json("value", "map<string,struct<avg:double,dims:struct<coherence:double,evocativeness:double,surprise:double>,remix_rate:double>>")
    levels = stored.where("key like 'remix_phase%'").select("key", F.map_values(phase).alias("l"))
    levels = levels.select("key", F.aggregate("l", F.lit(0.0), lambda a, x: a + x["avg"]).alias("x"), F.concat(F.lit("/"), F.size("l").cast("string")).alias("n"))
    p10 = stored.where("key = 'remix_baseline_sim'").select("key", F.get_json_object("value", "$.p10").cast("double").alias("x"))
    rows = got.unionByName(p10).withColumn("n", F.lit("")).unionByName(levels)
    return rows.select("key", F.concat(F.round("x", 6).cast("string"), F.col("n")).alias("value"))


def sample_sources(sp, d):
    """C14: the sources of each plain sample's four fillers."""
    long = samples(sp, d).where("not remixed").unpivot("req_id", ["item1", "item2", "action_noun", "of_object"], "slot", "filler")
    long = long.withColumn("slot_type", F.when(F.col("slot").startswith("item"), "list_item").otherwise(F.col("slot")))
    found = b.find_sources(long.select("slot_type", "filler").distinct(), pools(sp, d), bib.merged(sp, d))
    sources = F.array_sort(F.collect_list(F.struct("slot", "description", "source_tag")))
    own = long.join(found, ["slot_type", "filler"], "left").groupBy("req_id").agg(sources.alias("sources"))
    told = F.transform("sources", lambda x: F.concat_ws("=", x["slot"], F.coalesce(x["source_tag"], F.lit("?")), F.coalesce(x["description"], F.lit("?"))))
    return own.select("req_id", F.size("sources").alias("n"), F.array_join(told, ";").alias("sources"))


TEXTS = "case p_partkey % 4 when 0 then 'Race, ' || p_name || ', and the Rise of ' || p_name when 1 then p_name || ', Power and a fall of x' when 2 then 'Race, Power, Home and the end of ' || p_name || ' /' else 'nothing here' end"


def texts(sp, d):
    return spread(fixtures.view(sp, d, "part").select("p_partkey", "p_name"), 1 << 16).selectExpr("p_partkey as id", f"{TEXTS} as text")


AXES = ("coherence", "evocativeness", "surprise")
SECTIONS = ["## Title", "## Subtitle", "## Blurb 1"]
BOUNDS = {"pop_exponent": (0.2, 0.6), "pop_tone_blend": (0.0, 0.5), "weighted_sample_spread": (0.1, 0.8)}

_REQ = """r_req as (select c_custkey as req_id, 0 as trial, c_custkey + 1000 as seed, case c_custkey % 3 when 0 then '' when 1 then 'pop' else 'niche,pop' end as tone, 0.7 as remix_prob, 0.6 as min_sim,
  case when c_custkey % 5 = 0 then 'Race' end as lk_item1, case when c_custkey % 5 <> 0 and c_custkey % 7 = 0 then 'anvil' end as lk_head, case when c_custkey % 5 <> 0 and c_custkey % 7 <> 0 and c_custkey % 11 = 0 then 'the end' end as lk_object from customer),
r_prm as (select 0 as trial, 0.0 as blend, 0.1 as missing, 0.4 as spread)"""
#: The vectors of the sub-parts, their scalars, the cross similarities and the centroid's norm.
_PARTS_OF = f"{numbers.WORDS}, {numbers.VEC}, {numbers.PARTVEC},\nrc as ({numbers.CROSSED}), cn as (select sqrt(list_dot_product(centroid, centroid)) as norm from cen)"
VIEWS = ("editions_raw", "token_words")
_SAMPLES = f"{_PARTS_OF},\n{_REQ},\n{duck.generated('r')}"
_PARTS = "case when kind = 'type1' then 'head=' || two || ';modifier=' || one when kind = 'type2' then 'complement=' || two || ';prep=' || {mid} || ';topic=' || one end"
_MID = duck.title("mid")
_RATED = "1 + cast(floor(10 * {0}) as int)"


def _rated(text):
    return ", ".join(f"{_RATED.format(duck.uniform(f"{text} || '|{a}'"))} as {a}" for a in AXES)


def _sweep(p, base, levels):
    """The requests of one phase, its samples, ratings, summary and best level."""
    return f"""{p}_req as (select c_custkey * 64 + level as req_id, 0 as trial, c_custkey + {base} as seed, '' as tone, remix_prob, min_sim, null as lk_item1, null as lk_head, null as lk_object, level from customer, ({levels}) l),
{p}_prm as (select 0 as trial, 0.0 as blend, 0.1 as missing, 0.4 as spread),
{duck.generated(p)},
{p}_rate as (select q.level, q.remix_prob, q.min_sim, x.remixed, {_rated("x.text")} from {p}_fin x join {p}_req q using (req_id)),
{p}_sum as (select level, remix_prob, min_sim, round(avg(coherence), 6) as coherence, round(avg(evocativeness), 6) as evocativeness, round(avg(surprise), 6) as surprise, sum(coherence + evocativeness + surprise) / (3 * count(*)) as overall, round(sum(coherence + evocativeness + surprise) / (30 * count(*)), 6) as quality, count(*) as n, round(avg(cast(remixed as int)), 6) as remix_rate from {p}_rate group by 1, 2, 3),
{p}_top as (select level, min_sim from {p}_sum order by overall desc, level limit 1)"""


_LEVELS = lambda xs: ", ".join(f"({i}, {x})" for i, x in enumerate(xs))
_T1_WITH = (
    f"{_PARTS_OF},\n" + _sweep("c1", 3000, f"select level, 1.0 as remix_prob, x as min_sim from (values {_LEVELS(u.MIN_SIM_LEVELS)}) v(level, x)") + ",\n"
    + _sweep("c2", 4000, f"select level, x as remix_prob, (select min_sim from c1_top) as min_sim from (values {_LEVELS(u.REMIX_PROB_LEVELS)}) v(level, x)")
)
_T1_ROW = (
    "select {k} as phase, level, cast(remix_prob as double) as remix_prob, cast(min_sim as double) as min_sim, coherence, evocativeness, surprise, round(overall, 6) as overall, quality, n, remix_rate,"
    " level = (select level from c{k}_top) as best from c{k}_sum"
)
_T1 = chain(" union all ".join(_T1_ROW.format(k=k) for k in (1, 2)), VIEWS, _T1_WITH)
_T1_RESULTS = chain(
    f"""select key, case when key = 'remix_baseline_sim' then round(x, 6)::varchar else round(x, 6)::varchar || n end as value from (
      select 'remix_calibrated_min_sim' as key, (select min_sim from c1_top)::double as x, '' as n union all
      select 'remix_calibrated_remix_prob', (select remix_prob from c2_sum order by overall desc, level limit 1), '' union all
      select 'remix_baseline_sim', (select quantile_cont(similarity, 0.1) from scal), '' union all
      select 'remix_phase1_results', sum(overall), '/' || count(*) from c1_sum union all select 'remix_phase2_results', sum(overall), '/' || count(*) from c2_sum) x""",
    VIEWS, f"{_T1_WITH}, {numbers.SCAL}",
)
_BOUNDS = ", ".join(f"('{k}', {lo}, {hi})" for k, (lo, hi) in BOUNDS.items())
_T2 = chain(
    "select trial, param, value, round(quality, 6) as quality, round(separation, 6) as separation, round(composite, 6) as composite, case when composite > greatest((select composite from z_score where trial = 0), coalesce(max(composite) over (order by trial rows between unbounded preceding and 1 preceding), (select composite from z_score where trial = 0))) then 'keep' else 'discard' end as status from z_trials join z_score using (trial)",
    (*VIEWS, "experiments"),
    f"""{_PARTS_OF},
z_trials as (select trial, param, greatest(coalesce(lo, value), least(coalesce(hi, value), value)) as value from (select param, new_value as value, 1 + min(iteration) as trial from experiments group by 1, 2) p left join (values {_BOUNDS}) b(param, lo, hi) using (param)),
z_prm as (select trial, case when param = 'pop_tone_blend' then value else 0.0 end as blend, case when param = 'pop_missing_default' then value else 0.1 end as missing, case when param = 'weighted_sample_spread' then value else 0.4 end as spread from (select trial, param, value from z_trials union all select 0, '', 0) x),
z_req as (select trial * 110 + i as req_id, trial, 1000 + 100 * trial + i as seed, case when i < 50 then '' when i < 80 then 'pop' else 'niche' end as tone, 0.0 as remix_prob, 0.0 as min_sim, null as lk_item1, null as lk_head, null as lk_object from z_prm, (select unnest(range(110)) as i) r),
{duck.generated("z")},
z_rate as (select trial, {_rated("text")} from z_fin where tone = ''),
z_qual as (select trial, sum(coherence + evocativeness + surprise) / (30 * count(*)) as quality from z_rate group by 1),
z_long as (select trial, tone, unnest(['list_item', 'list_item', 'action_noun', 'of_object']) as slot_type, unnest([item1, item2, action_noun, of_object]) as filler from z_fin where tone <> ''),
z_dim as (select slot_type, lower(filler) as k, sum(freq) as freq, max(popularity) as popularity from z_fill where slot_type in ('list_item', 'action_noun', 'of_object') group by 1, 2),
z_bin as (select trial, greatest(0, least(9, cast(floor(((1 - blend) * log10(1 + coalesce(freq, 0)) + blend * coalesce(popularity, missing)) / 0.3) as int))) as bin, count(*) filter (tone = 'pop') as x, count(*) filter (tone = 'niche') as y from z_long l left join z_dim d on d.slot_type = l.slot_type and d.k = lower(l.filler) join z_prm using (trial) group by 1, 2),
z_sep as (select trial, round(1 - sum(least(x / tx, y / ty)), 9) as separation from (select *, sum(x) over (partition by trial) as tx, sum(y) over (partition by trial) as ty from z_bin) q group by 1),
z_score as (select trial, quality, separation, 0.5 * quality + 0.5 * separation as composite from z_qual join z_sep using (trial))""",
)
_SHOWN = """select req_id, pos - 1 as pos, x.t as text, x.c as cls, x.p as is_punctuation from (select req_id, generate_subscripts(l, 1) as pos, unnest(l) as x from (select req_id, list_concat(
  [{'t': item1, 'c': 'item1', 'p': false}, {'t': ',', 'c': '', 'p': true}, {'t': item2, 'c': 'item2', 'p': false}, {'t': ', and ' || action_article, 'c': '', 'p': true}, {'t': action_noun, 'c': 'action_noun', 'p': false}, {'t': case when of_article <> '' then 'of ' || of_article else 'of' end, 'c': '', 'p': true}],
  case kind when 'type1' then [{'t': one, 'c': 'of_modifier', 'p': false}, {'t': two, 'c': 'of_head', 'p': false}] when 'type2' then [{'t': one, 'c': 'of_topic', 'p': false}, {'t': MID, 'c': '', 'p': true}, {'t': two, 'c': 'of_complement', 'p': false}] else [{'t': of_object, 'c': 'of_object', 'p': false}] end) as l from r_fin) y) z""".replace("MID", _MID)
_ENDS = "nullif(regexp_replace(trim(coalesce({0}, '')), '[ /:]+$', ''), '')"
_C14 = chain(
    f"""select req_id, cast(count(*) as int) as n, string_agg(slot || '=' || coalesce(h.tag, '?') || '=' || case when h is null then '?' else concat_ws(': ', {_ENDS.format("h.title")}, {_ENDS.format("h.text")}) end, ';' order by slot) as sources
    from (select req_id, unnest(['item1', 'item2', 'action_noun', 'of_object']) as slot, unnest(['list_item', 'list_item', 'action_noun', 'of_object']) as slot_type, unnest([item1, item2, action_noun, of_object]) as filler from r_fin where not remixed) w
    left join (select slot_type, k, s as h from kn) z on z.slot_type = w.slot_type and z.k = lower(w.filler) group by 1""",
    views=VIEWS, more=f"{_SAMPLES},\n" + "kn as (select p.slot_type, lower(p.filler) as k, min({'filler': p.filler, 'title': m.title, 'text': m.subtitle, 'tag': case when source_file = 'openlibrary' then 'OL' else 'LOC' end}) as s from pools p join merged m on m.id = p.source_subtitle_id group by 1, 2)",
)

QUERIES = {
    "h01_title_case": (lambda sp, d: texts(sp, d).select("id", t.title_case(F.col("text")).alias("titled")), f"select id, {duck.title('text')} as titled from (select p_partkey as id, {TEXTS} as text from part) x"),
    "h02_a_or_an": (
        lambda sp, d: fixtures.view(sp, d, "customer").select("c_custkey", *(t.a_or_an(F.lit("a"), F.col(c)).alias(f"before_{c}") for c in ("c_mktsegment", "c_name"))),
        f"select c_custkey, {duck.a_or_an(chr(39) + 'a' + chr(39), 'c_mktsegment')} as before_c_mktsegment, {duck.a_or_an(chr(39) + 'a' + chr(39), 'c_name')} as before_c_name from customer",
    ),
    "h11_json": (
        lambda sp, d: fixtures.view(sp, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("made")),
        "select event_id, props->>'$.k' as k, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' as made from events",
    ),
    "h18_text_fillers": (
        lambda sp, d: texts(sp, d).select("id", t.text_fillers(F.col("text")).alias("fillers")),
        f"with x as (select p_partkey as id, {TEXTS} as text from part) select id, case when regexp_matches(text, {duck.RX_THE}) then list_concat(list_filter(list_transform(string_split(regexp_extract(text, {duck.RX_THE}, 1), ','), lambda q: trim(q)), lambda q: q <> ''), [trim(regexp_extract(text, {duck.RX_THE}, 2)), {duck.ending(f'regexp_extract(text, {duck.RX_THE}, 3)')}]) else [] end as fillers from x",
    ),
    "h19_sections": (
        lambda sp, d: fixtures.view(sp, d, "documents").select("doc_id", F.concat(F.lit("intro\n## title\n"), "text", F.when(F.col("doc_id") % 2 == 0, "\n## Subtitle\ny\n").otherwise("")).alias("doc"))
        .select("doc_id", t.missing_sections(F.col("doc"), SECTIONS).alias("missing"), F.md5(t.drop_section(t.cut_preamble(F.col("doc")), "## Subtitle")).alias("rest")),
        "select doc_id, case when doc_id % 2 = 0 then ['## Blurb 1'] else ['## Subtitle', '## Blurb 1'] end as missing, md5('## title' || chr(10) || text) as rest from documents",
    ),
    "k01_tone_targets": (
        lambda sp, d: rounded(g.tone_targets(fixtures.view(sp, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "niche,pop").otherwise("").alias("tone")), p.defaults(sp)), "target").drop("trial"),
        f"with {duck.PARAMS} select case when even then 'niche,pop' else '' end as tone, s as slot_type, case when even then round(((select value from params where key = 'tone_target_niche_' || s) + (select value from params where key = 'tone_target_pop_' || s)) / 2, 6) end as target from (select distinct c_custkey % 2 = 0 as even from customer) r, (values ('list_item'), ('action_noun'), ('of_object')) v(s)",
    ),
    "k02_pool_weights": (
        lambda sp, d: rounded(g.pool_weights(pools(sp, d), g.tone_targets(sp.createDataFrame([("pop",), ("",)], "tone string"), p.defaults(sp)), p.defaults(sp)), "weight").drop("trial"),
        chain("select slot_type, tone, filler, round(sqrt(freq) * case when tone = '' then 1 else 0.05 + 0.95 * exp(-pow((log10(1 + freq) - case slot_type when 'of_object' then 1.0 else 1.5 end) / 0.4, 2)) end, 6) as weight from pools, (values ('pop'), ('')) v(tone)"),
    ),
    "k03_k06_generate": (
        lambda sp, d: flat(samples(sp, d)),
        chain(f"select req_id, text, item1, item2, action_noun, of_object, remixed, {_PARTS.format(mid=_MID)} as remix_parts, round(sim, 6) as remix_similarity, of_article, action_article from r_fin", VIEWS, _SAMPLES),
    ),
    "k04_remix_gate": (
        lambda sp, d: requests(sp, d).select("req_id", (s.uniform(F.col("seed"), "gate", 0, "") < F.col("remix_prob")).alias("passes")),
        "select c_custkey as req_id, ('0x' || substr(md5((c_custkey + 1000) || '|gate|0|'), 1, 13))::bigint / 4503599627370496.0 < 0.7 as passes from customer",
    ),
    "h17_display_slots": (lambda sp, d: g.display_slots(samples(sp, d)), chain(_SHOWN, VIEWS, _SAMPLES)),
    "k08_spot_check_requests": (
        lambda sp, d: g.spot_check_requests(sp, fixtures.view(sp, d, "customer").count(), 77).select("req_id", "seed", "tone"),
        "select row_number() over (order by md5('77|' || seed), seed) as req_id, seed, tone from (select i * n + j + 77 as seed, tone from (values (0, 'pop'), (1, 'mainstream'), (2, 'niche')) t(i, tone), (select count(*) as n from customer) c, (select unnest(range((select count(*) from customer))) as j) r) x",
    ),
    "k09_text_scores": (
        lambda sp, d: rounded(g.text_scores(texts(sp, d), pools(sp, d), p.defaults(sp)), "score"),
        chain(f""", tx as (select p_partkey as id, {TEXTS} as text from part), fl as (select id, unnest(list_concat(list_filter(list_transform(string_split(regexp_extract(text, {duck.RX_THE}, 1), ','), lambda q: trim(q)), lambda q: q <> ''), [trim(regexp_extract(text, {duck.RX_THE}, 2)), {duck.ending(f'regexp_extract(text, {duck.RX_THE}, 3)')}])) as filler from tx where regexp_matches(text, {duck.RX_THE})),
        dm as (select filler, arg_min(freq, slot_type) as freq from pools group by 1), sc as (select id, avg(log10(1 + coalesce(freq, 1))) as score from fl left join dm using (filler) group by 1)
        select id, round(coalesce(score, 0), 6) as score, case when score is null then 'mainstream' when score > 1 then 'pop' when score >= 0.5 then 'mainstream' else 'niche' end as tier from tx left join sc using (id)"""),
    ),
    "k10_not_enough": (
        lambda sp, d: made(sp, d, requests(sp, d).withColumn("locks", F.lit(None).cast("map<string,string>")), own_pools=pools(sp, d).where("slot_type <> 'action_noun'")).select("req_id", "text"),
        "select c_custkey as req_id, '(not enough fillers)' as text from customer",
    ),
    "c12_locks_known": (
        lambda sp, d: fixtures.view(sp, d, "part").select("p_partkey", F.col("p_name").alias("filler")).join(pools(sp, d).where("slot_type = 'of_object'").select("filler", F.lit(True).alias("known")), "filler", "left").select("p_partkey", F.coalesce("known", F.lit(False)).alias("known")),
        chain("select p_partkey, p_name in (select filler from pools where slot_type = 'of_object') as known from part"),
    ),
    "c14_sample_sources": (sample_sources, _C14),
    "t01_calibration": (calibrated, _T1),
    "t01_stored_results": (stored_results, _T1_RESULTS),
    "t02_t03_trials": (trials, _T2),
    "t07_snapshot": (
        lambda sp, d: f.with_snapshot(fixtures.view(sp, d, "ratings").select("id", "system_tone"), p.effective_params(sp, sp.createDataFrame([("pop_tone_blend", "0.25")], "key string, value string")))
        .select("id", F.size("config_snapshot").alias("n"), F.element_at("config_snapshot", F.concat(F.lit("tier_center_"), "system_tone")).alias("center"), F.element_at("config_snapshot", "pop_tone_blend").alias("blend")),
        fixtures.with_views(["ratings"], f", {duck.PARAMS} select id, 31 as n, value as center, 0.25::double as blend from ratings join params on key = 'tier_center_' || system_tone"),
    ),
}
