"""Samples in bulk: requests to finished texts.

Pools are slot tables (slot_type, filler, freq, popularity, ...). Requests may carry a ``trial`` and parameters then differ by trial: all
draw from pools that are cumulated once, under a weight that no trial exceeds, and accept in proportion to their own weight. Draws are seeded
hashes found by a bucketed range join, all slots in one; remix attempts are rows of a join and not a loop; articles are left joins. What
is used several times (requests, cumulated weights, draws, attempts) is written once, so plans stay small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions import scores as s
from phrasemill.functions import text as t
from phrasemill.functions import words as lists
from phrasemill.operators import sampling as p
from phrasemill.operators.bibliography import best_articles
from phrasemill.session import materialise, spread

ATTEMPTS, LOCKED_ATTEMPTS = 5, 20
#: Tries of a draw in three rounds, the parameters that weights depend on.
TRIES = ((1, 4), (5, 16), (17, 64))
#: Cells to one unit of log10(1 + freq), and of popularity, by which a pool's fillers are taken together.
CELLS = 20
#: Rows that are exploded into tries are dealt over the cores from so many bytes on.
SPREAD_BYTES = 1 << 14
WEIGHT_PARAMS = ("pop_base_weight_blend", "pop_missing_default", "pop_tone_blend", "weighted_sample_spread", "weighted_sample_bias_floor")
NOT_ENOUGH = "(not enough fillers)"
REQUEST = "req_id long, seed long, tone string, remix_prob double, min_sim double, locks map<string,string>"


def _tried(df: DataFrame) -> DataFrame:
    """Rows without a trial belong to trial 0."""
    return df if "trial" in df.columns else df.withColumn("trial", F.lit(0).cast("long"))


def _lock(name: str) -> Column:
    return F.try_element_at("locks", F.lit(name))


def tone_targets(tones: DataFrame, params: DataFrame) -> DataFrame:
    """trial, tone (comma list, normalised), slot_type -> target: the mean over the tones named, times the slot's multiplier; null
    for no tone."""
    tones, params = _tried(tones).select("trial", "tone").distinct(), _tried(params)
    named = params.where(F.col("key").startswith("tone_target_")).select("trial", F.regexp_extract("key", "^tone_target_([a-z]+)_", 1).alias("one"), F.regexp_extract("key", "^tone_target_[a-z]+_(.*)$", 1).alias("slot_type"), "value")
    times = params.where(F.col("key").startswith("pop_slot_mult_")).select("trial", F.substring("key", 15, 99).alias("slot_type"), F.col("value").alias("times"))
    own = tones.join(times, "trial").withColumn("one", F.explode_outer(F.split(F.nullif("tone", F.lit("")), ",")))
    return own.join(named, ["trial", "one", "slot_type"], "left").groupBy("trial", "tone", "slot_type").agg((F.avg("value") * F.first("times")).alias("target"))


def pool_weights(pools: DataFrame, targets: DataFrame, params: DataFrame) -> DataFrame:
    """trial, slot_type, tone, filler and a weight; sub-part slots share the object's target."""
    c = F.col
    own = pools.withColumn("target_slot", F.when(c("slot_type").startswith("of_"), "of_object").otherwise(c("slot_type")))
    own = own.join(targets.withColumnRenamed("slot_type", "target_slot"), "target_slot")
    own = own.join(p.as_row(_tried(params), "trial"), "trial")
    score = s.filler_score(c("freq"), c("popularity"), c("pop_tone_blend"), c("pop_missing_default"))
    weight = s.base_weight(c("freq"), c("popularity"), c("pop_base_weight_blend"), c("pop_missing_default")) * s.tone_bias(score, c("target"), c("weighted_sample_spread"), c("weighted_sample_bias_floor"))
    return own.select("trial", "slot_type", "tone", "filler", weight.alias("weight"), *(x for x in ("pos_tag", "prep") if x in pools.columns))


def _pool(slot: Column, rest: Column | None = None) -> Column:
    return F.concat_ws("|", slot, *([] if rest is None else [rest.cast("string")]))


def draw_terms(req: DataFrame, params: DataFrame) -> DataFrame:
    """trial, tone, slot -> target and the parameters that a draw's weights need; sub-part slots share the object's target."""
    named = F.when(F.col("slot_type") == "of_object", F.array(*map(F.lit, ("of_object", *lists.PART_SLOTS)))).otherwise(F.array("slot_type"))
    own = tone_targets(req, params).select("trial", "tone", "target", F.explode(named).alias("slot"))
    return own.join(p.as_row(params.where(F.col("key").isin(*WEIGHT_PARAMS)), "trial").select("trial", *WEIGHT_PARAMS), "trial")


def _weight() -> Column:
    """A filler's weight (freq, popularity) with the terms of a draw, as in ``pool_weights``."""
    c = F.col
    score = s.filler_score(c("freq"), c("popularity"), c("pop_tone_blend"), c("pop_missing_default"))
    base = s.base_weight(c("freq"), c("popularity"), c("pop_base_weight_blend"), c("pop_missing_default"))
    return base * s.tone_bias(score, c("target"), c("weighted_sample_spread"), c("weighted_sample_bias_floor"))


def _cumulated(pools: DataFrame, parts: DataFrame, params: DataFrame) -> DataFrame:
    """The pools that requests draw from, cumulated once for all trials and tones under a weight that no trial exceeds: the largest base weight of
    any trial (a tone only lowers it). Modifiers are pooled by words, topics and complements by preposition; a filler stands once in a pool."""
    both = pools.select("slot_type", "filler", "freq", "popularity", F.lit(None).cast("string").alias("prep")).unionByName(parts.select("slot_type", "filler", "freq", "popularity", "prep"))
    slot = F.col("slot_type")
    rest = F.when(slot == "of_modifier", t.word_count(F.col("filler")).cast("string")).when(slot.isin("of_topic", "of_complement"), F.col("prep"))
    pool = both.groupBy(_pool(slot, rest).alias("pool"), "filler").agg(F.sum("freq").alias("freq"), F.max("popularity").alias("popularity"))
    bases = p.as_row(params.where("key in ('pop_base_weight_blend', 'pop_missing_default')"), "trial").agg(F.collect_set(F.struct("pop_base_weight_blend", "pop_missing_default")).alias("bases"))
    most = F.array_max(F.transform("bases", lambda b: s.base_weight(F.col("freq"), F.col("popularity"), b["pop_base_weight_blend"], b["pop_missing_default"])))
    return materialise(p.cumulative(pool.crossJoin(F.broadcast(bases)).withColumn("weight", most).drop("bases")), "cumulated")


def _likeliest(rows: DataFrame, cum: DataFrame) -> DataFrame:
    """trial, tone, slot, pool -> most: the largest share of its tries that any filler of the pool is accepted with under the terms of a tone, from above, as
    digits (``scores.digits_to``).

    Fillers are taken together in cells of log10(1 + freq) and popularity, so the work is a pool's cells for each of the terms, whatever the pool's size;
    a cell's scores lie in an interval, and of a tone's bias over it the ends or the target itself are the largest.
    """
    c = F.col
    cell = lambda x: F.floor(x * CELLS)
    level = F.log10(1 + c("freq"))
    ends = (F.min(level).alias("l1"), F.max(level).alias("l2"), F.min("popularity").alias("p1"), F.max("popularity").alias("p2"))
    cells = cum.where("units > 0").groupBy("pool", cell(level), cell(c("popularity"))).agg(*ends).select("pool", "l1", "l2", "p1", "p2")
    levels = [(1 - c("pop_tone_blend")) * c(x) for x in ("l1", "l2")]
    pops = [c("pop_tone_blend") * F.coalesce(x, "pop_missing_default") for x in ("p1", "p2")]
    lo, hi = F.least(*levels) + F.least(*pops), F.greatest(*levels) + F.greatest(*pops)
    near, far = F.greatest(lo - c("target"), c("target") - hi, F.lit(0.0)), F.greatest(hi - c("target"), c("target") - lo)
    bias = F.greatest(*(s.tone_bias(x, F.lit(0.0), c("weighted_sample_spread"), c("weighted_sample_bias_floor")) for x in (near, far)))
    own = rows.where("target is not null").select("trial", "tone", "slot", "pool", "target", *WEIGHT_PARAMS).distinct()
    return own.join(cells, "pool").groupBy("trial", "tone", "slot", "pool").agg(s.digits_to(F.max(bias) * (1 + 1e-9)).alias("most"))


def accepted(draws: DataFrame, cum: DataFrame, key: tuple[str, ...], number: int = 1) -> DataFrame:
    """draws (the columns ``key``, seed, slot, pool, the terms; for a second one also first, first_lo, first_units) -> key, filler, units, lo.

    A filler is drawn from the shared pool and accepted in proportion to the weight that the draw gives it, so the accepted ones have just that weight; the
    second of a pair is drawn from what the first leaves. What is written grows with the draws, not with trials times fillers. Draws that no try
    of TRIES serves get their filler from their own weights, cumulated for them alone. A try whose luck no filler of the pool could meet (``_likeliest``) is
    left out before its filler is looked up: where all fillers are far from a tone's target, that is nearly every try.
    """
    letter, second = " ab"[number], number == 2
    rows = p.started(draws, cum).withColumn("room", F.col("total") - (F.col("first_units") if second else F.lit(0))).where("room > 0")
    likeliest = materialise(_likeliest(draws, cum), "likeliest")
    rows = rows.join(likeliest, ["trial", "tone", "slot", "pool"], "left")
    past = lambda v: F.when(v >= F.col("first_lo"), v + F.col("first_units")).otherwise(v) if second else v
    found = []
    for lo, hi in TRIES:
        k = F.col("try")
        last = F.when(F.col("target").isNull(), F.lit(lo)).otherwise(F.lit(hi)) if lo == 1 else F.lit(hi)  # without a tone the first one mostly serves
        luck = F.col("seed"), F.col("slot"), number, F.concat(F.lit("accept"), k.cast("string"))
        tries = rows.withColumn("try", F.explode(F.sequence(F.lit(lo), last))).where(F.col("most").isNull() | (s.digits(*luck) <= F.col("most")))
        name = F.when(k == 1, letter).otherwise(F.concat(F.lit(letter), k.cast("string")))
        got = p.pick(tries.withColumn("point", past(s.whole_uniform(F.col("room"), F.col("seed"), F.col("slot"), number, name))), cum, more=("freq", "popularity", "weight"))
        hit = got.where(s.uniform(*luck) * F.col("weight") < _weight()).groupBy(*key).agg(F.min_by(F.struct("filler", "units", "lo"), "try").alias("hit"))
        found.append(materialise(hit.select(*key, "hit.*"), "accepted"))
        rows = spread(materialise(rows.join(found[-1].select(*key), list(key), "left_anti"), "open"), SPREAD_BYTES)
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, found)
    own = rows.select("pool", "trial", "tone", "slot", "target", *WEIGHT_PARAMS).distinct().withColumn("own", F.concat_ws("|", "trial", "tone", "pool"))
    weights = own.join(cum.select("pool", "filler", "freq", "popularity"), "pool").select("own", "filler", _weight().alias("weight"))
    exact = materialise(p.cumulative(weights, ("own",)), "exact")
    rest = p.started(rows.drop("total", "width", "most").withColumn("own", F.concat_ws("|", "trial", "tone", "pool")), exact, ("own",))
    if second:
        taken = exact.select("own", F.col("filler").alias("first"), F.col("lo").alias("_lo"), F.col("units").alias("_units"))
        rest = rest.drop("first_lo", "first_units").join(taken, ["own", "first"]).withColumnsRenamed({"_lo": "first_lo", "_units": "first_units"})
    rest = rest.withColumn("room", F.col("total") - (F.col("first_units") if second else F.lit(0))).where("room > 0")
    rest = rest.withColumn("point", past(s.whole_uniform(F.col("room"), F.col("seed"), F.col("slot"), number, letter + "x")))
    served = p.pick(rest, exact, ("own",)).select(*key, "pool", "filler").join(cum.select("pool", "filler", "units", "lo"), ["pool", "filler"])  # in the shared pool
    return reduce(DataFrame.unionByName, [*found, served.select(*key, "filler", "units", "lo")])


def generate(requests: DataFrame, pools: DataFrame, parts: DataFrame, splits: DataFrame, counts: DataFrame, scalars: DataFrame, params: DataFrame, constants=(1.0, 0.1, 0.1)) -> DataFrame:
    """requests (REQUEST, and perhaps trial) -> req_id, text, item1, item2, action_noun, of_object, remixed, remix_parts,
    remix_similarity, of_article, action_article, and the trial if it was given.

    pools: slot_type, filler, freq, popularity. parts: the same for sub-parts, with pos_tag and prep. splits: filler, remix_type,
    remix_prep, remix_word_count of objects. counts: article counts. scalars: slot_type, filler, centroid_dot, norm_sq.
    params: key, value, and perhaps trial. constants: the centroid's norm and the mean cross similarities of the two remix types.
    Requests have ids of their own. A text that lacks fillers is a placeholder.
    """
    tones = F.filter(F.transform(F.split(F.coalesce("tone", F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    no_locks = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    req = _tried(requests).withColumns({"tone": F.array_join(F.array_sort(F.array_distinct(tones)), ","), "locks": F.coalesce("locks", no_locks)})
    locked = F.to_json(F.array_sort(F.map_entries("locks")))
    draw = F.concat_ws("|", F.coalesce(F.col("seed").cast("string"), F.lit("null")), "trial", "tone")
    req = req.withColumn("draw", draw).withColumn("mix", F.concat_ws("\x1f", "draw", locked))
    req, params = spread(materialise(req, "requests"), SPREAD_BYTES), _tried(params)
    cum, terms = _cumulated(pools, parts, params), materialise(draw_terms(req, params), "terms")
    slots = F.explode(F.array(*map(F.lit, lists.SLOTS))).alias("slot")
    seeds = spread(materialise(req.select("draw", "seed", "trial", "tone").distinct(), "seeds"), SPREAD_BYTES)
    draws = seeds.select("draw", "seed", "trial", "tone", slots).join(terms, ["trial", "tone", "slot"]).withColumn("pool", _pool(F.col("slot")))
    first = accepted(draws, cum, ("draw", "slot"))
    pairs = draws.where("slot = 'list_item'").join(first.where("slot = 'list_item'").select("draw", F.col("filler").alias("first"), F.col("lo").alias("first_lo"), F.col("units").alias("first_units")), "draw")
    second = accepted(pairs, cum, ("draw",), 2)
    both = first.select("draw", "slot", "filler").unionByName(second.select("draw", F.lit("second").alias("slot"), "filler"))
    picked = both.groupBy("draw").agg(*(F.max(F.when(F.col("slot") == k, F.col("filler"))).alias(v) for k, v in (("list_item", "i1"), ("second", "i2"), ("action_noun", "a"), ("of_object", "o"))))
    # one locked item: the drawn pair is distinct, so one of the two differs from it
    free1 = F.when(F.col("i1") == _lock("item2"), F.col("i2")).otherwise(F.col("i1"))
    free2 = F.when(_lock("item1").isNotNull(), F.when(F.col("i1") == _lock("item1"), F.col("i2")).otherwise(F.col("i1"))).otherwise(F.col("i2"))
    drawn = req.join(picked, "draw", "left").withColumns({"item1": F.coalesce(_lock("item1"), free1), "item2": F.coalesce(_lock("item2"), free2), "action_noun": F.coalesce(_lock("action_noun"), "a"), "of_object": F.coalesce(_lock("of_object"), "o")})
    drawn = materialise(drawn.drop("i1", "i2", "a", "o", "draw"), "drawn")
    mixed = remix(drawn, cum, terms, parts, splits, scalars, params, constants)
    out = drawn.join(mixed, "req_id", "left").withColumn("remixed", F.col("composed").isNotNull())
    out = out.withColumn("of_object", F.coalesce("composed", "of_object")).drop("composed")
    done = finish(out, counts, params)
    return done if "trial" in requests.columns else done.drop("trial")


def remix(drawn: DataFrame, cum: DataFrame, terms: DataFrame, parts: DataFrame, splits: DataFrame, scalars: DataFrame, params: DataFrame, constants) -> DataFrame:
    """req_id, composed, remix_parts, remix_similarity of the requests that remix: the first valid attempt, or with locks the most similar.

    Only gated requests remix. Those of one seed, trial, tone and locks (``mix``) have the same attempts, which are made once: exploded, and each into
    the draws of its two parts from the pool needed (words of the modifier, or preposition). A request then takes of its mix's attempts, a short array
    in order, the first that is similar enough for it.
    """
    c = F.col
    has = F.exists(F.map_keys("locks"), lambda k: k.isin(*lists.PART_SLOTS))
    gate = (t.word_count(c("of_object")) >= 2) & (s.uniform(c("seed"), "gate", 0, "") < c("remix_prob"))
    own = drawn.where(_lock("of_object").isNull() & (has | gate)).withColumn("locked", has)
    own = own.join(splits.select(c("filler").alias("of_object"), "remix_type", "remix_prep", "remix_word_count"), "of_object", "left")
    held = F.when(_lock("of_modifier").isNotNull() | _lock("of_head").isNotNull(), "type1").when(_lock("of_topic").isNotNull() | _lock("of_complement").isNotNull(), "type2")
    preps = parts.where("slot_type in ('of_topic', 'of_complement')").groupBy(c("filler").alias("lock_filler")).agg(F.min("prep").alias("lock_prep"))
    own = own.withColumns({"kind": F.coalesce(held, "remix_type"), "lock_filler": F.coalesce(_lock("of_topic"), _lock("of_complement"))}).join(preps, "lock_filler", "left")
    words = F.when(_lock("of_modifier").isNotNull(), t.word_count(_lock("of_modifier")) + 1).when(c("remix_type") == "type1", c("remix_word_count")).otherwise(2)
    own = own.withColumns({"words": F.when(c("kind") == "type1", words).otherwise(c("remix_word_count")), "prep": F.when(c("kind") == "type2", F.coalesce(F.when(c("remix_type") == "type2", c("remix_prep")), "lock_prep"))})
    no_of = params.where("key = 'remix_reject_double_of'").select("trial", (c("value") > 0).alias("no_of"))
    own = own.join(no_of, "trial").where("kind is not null and (kind = 'type1' or prep is not null)").where(~(c("no_of") & (c("kind") == "type2") & (c("prep") == "of")))
    most = F.when(c("locked"), LOCKED_ATTEMPTS).otherwise(ATTEMPTS)
    asked = materialise(own.select("req_id", "mix", "seed", "trial", "tone", "kind", "words", "prep", "locks", "locked", "min_sim"), "remixing")
    mixes = asked.groupBy("mix").agg(F.first(F.struct("seed", "trial", "tone", "kind", "words", "prep", "locks", "locked")).alias("m")).select("mix", "m.*")
    tries = materialise(mixes.select("*", F.explode(F.sequence(F.lit(1), most)).alias("attempt")), "attempts")
    tries = spread(tries, SPREAD_BYTES)
    first = c("kind") == "type1"
    pool1 = F.when(first, _pool(F.lit("of_modifier"), c("words") - 1)).otherwise(_pool(F.lit("of_topic"), c("prep")))
    pool2 = F.when(first, _pool(F.lit("of_head"))).otherwise(_pool(F.lit("of_complement"), c("prep")))
    rows = F.explode(F.array(F.struct(F.lit("part1").alias("slot"), pool1.alias("pool")), F.struct(F.lit("part2").alias("slot"), pool2.alias("pool"))))
    seed = F.concat_ws("/", c("seed").cast("string"), c("attempt").cast("string")).alias("seed")
    draws = tries.select("mix", "attempt", "trial", "tone", seed, rows.alias("r")).select("mix", "attempt", "trial", "tone", "seed", "r.*")
    draws = draws.join(terms.where("slot = 'of_object'").drop("slot"), ["trial", "tone"])
    picks = accepted(draws, cum, ("mix", "attempt", "slot")).groupBy("mix", "attempt").agg(*(F.max(F.when(c("slot") == k, c("filler"))).alias(k) for k in ("part1", "part2")))
    tries = tries.join(picks, ["mix", "attempt"], "left")
    one = F.when(first, F.coalesce(_lock("of_modifier"), "part1")).otherwise(F.coalesce(_lock("of_topic"), "part1"))
    two = F.when(first, F.coalesce(_lock("of_head"), "part2")).otherwise(F.coalesce(_lock("of_complement"), "part2"))
    tries = tries.withColumns({"one": one, "two": two}).where("one is not null and two is not null")
    tries = tries.withColumn("composed", F.when(first, F.concat_ws(" ", "one", "two")).otherwise(F.concat_ws(" ", "one", "prep", "two")))
    tries = tries.where(first | c("locked") | (t.word_count(c("composed")) == c("words")))

    def side(k: str, kinds: tuple[str, str]) -> DataFrame:
        kind = F.when(c("slot_type").isin("of_modifier", "of_head"), "type1").otherwise("type2").alias("kind")
        return scalars.where(c("slot_type").isin(*kinds)).select(kind, c("filler").alias(k), c("centroid_dot").alias(f"d_{k}"), c("norm_sq").alias(f"q_{k}"))

    tries = tries.join(side("one", ("of_modifier", "of_topic")), ["kind", "one"], "left").join(side("two", ("of_head", "of_complement")), ["kind", "two"], "left")
    norm, cross1, cross2 = constants
    sim = s.approximate_cosine(F.array("d_one", "d_two"), F.array("q_one", "q_two"), F.lit(norm), F.when(first, cross1).otherwise(cross2))
    tries = tries.withColumn("sim", sim)
    named = lambda names, cols: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*cols))
    remix_parts = F.when(first, named(("modifier", "head"), ("one", "two"))).otherwise(named(("topic", "prep", "complement"), ("one", "prep", "two")))
    made = F.struct("composed", remix_parts.alias("remix_parts"), c("sim").alias("remix_similarity"))
    listed = F.array_sort(F.collect_list(F.struct("attempt", made.alias("made"))), lambda x, y: (x["attempt"] - y["attempt"]).cast("int"))
    best = tries.groupBy("mix").agg(listed.alias("made"), F.max_by(F.when(c("locked"), made), F.when(c("locked"), F.struct("sim", -c("attempt")))).alias("fallback"))
    asks = (c("min_sim") > 0) | c("locked")
    enough = lambda x: (c("min_sim") <= 0) | x.isNull() | (x >= c("min_sim"))
    passing = F.filter("made", lambda x: enough(F.when(asks, x["made"]["remix_similarity"])))
    out = asked.join(best, "mix").select("req_id", "min_sim", "locked", F.coalesce(F.get(passing, F.lit(0))["made"], "fallback").alias("m")).where("m is not null")
    return out.select("req_id", "m.composed", "m.remix_parts", F.when(asks, c("m.remix_similarity")).alias("remix_similarity"))


def finish(drawn: DataFrame, counts: DataFrame, params: DataFrame) -> DataFrame:
    """Articles (of the whole object, else of its head, topic or last word), assembly and title case."""
    c = F.col
    own = p.as_row(params.where(c("key").startswith("article_")), "trial").select("trial", "article_of_min_freq", "article_action_min_freq", "article_remix_heuristic_threshold")
    best = materialise(best_articles(counts), "articles")
    dim = lambda slot, k: best.where(c("slot_type") == slot).select(c("filler_lc").alias(k), *(c(x).alias(f"{x}_{k}") for x in ("article", "n", "total")))
    remix_head = F.coalesce(F.try_element_at("remix_parts", F.lit("head")), F.try_element_at("remix_parts", F.lit("topic")))
    last = F.when(t.word_count(c("of_object")) > 1, t.last_word(c("of_object")))
    out = drawn.join(own, "trial").withColumns({"whole": F.lower("of_object"), "part": F.lower(F.when(c("remixed"), remix_head).otherwise(last)), "act": F.lower("action_noun")})
    out = out.join(dim("of_object", "whole"), "whole", "left").join(dim("of_object", "part"), "part", "left").join(dim("action_noun", "act"), "act", "left")

    def article(k: str, least: str, strict: Column) -> Column:
        clear = F.when(strict, c(f"n_{k}") >= c("article_remix_heuristic_threshold") * c(f"total_{k}")).otherwise(2 * c(f"n_{k}") > c(f"total_{k}"))
        return F.when(clear & (c(f"total_{k}") >= c(least)) & (c(f"article_{k}") != ""), c(f"article_{k}"))

    of = F.coalesce(article("whole", "article_of_min_freq", c("remixed")), article("part", "article_of_min_freq", c("remixed")), F.lit(""))
    act = F.coalesce(article("act", "article_action_min_freq", F.lit(False)), F.lit("the"))
    out = out.withColumns({"action_article": t.a_or_an(act, c("action_noun")), "of_article": t.a_or_an(of, c("of_object"))})
    before = F.when(c("of_article") != "", F.concat("of_article", F.lit(" "))).otherwise("")
    raw = F.concat(c("item1"), F.lit(", "), c("item2"), F.lit(", and "), c("action_article"), F.lit(" "), c("action_noun"), F.lit(" of "), before, c("of_object"))
    up = {x: F.when(c(x).isNotNull() & raw.isNotNull(), t.title_case(c(x))).otherwise("") for x in ("item1", "item2", "action_noun", "of_object")}
    titled = F.transform_values("remix_parts", lambda k, v: t.title_case(v)).alias("remix_parts")
    text = F.coalesce(t.title_case(raw), F.lit(NOT_ENOUGH)).alias("text")
    return out.select("req_id", "trial", text, *(x.alias(k) for k, x in up.items()), "remixed", titled, "remix_similarity", "of_article", "action_article")


def sample_requests(spark, n: int, tone: str = "", seed_base: int = 1000, remix_prob: float = 0.0, min_sim: float = 0.0) -> DataFrame:
    return spark.range(n).select("id", (F.col("id") + seed_base).alias("seed"), F.lit(tone).alias("tone"), F.lit(remix_prob).alias("remix_prob"), F.lit(min_sim).alias("min_sim"), F.lit(None).cast("map<string,string>").alias("locks")).withColumnRenamed("id", "req_id")


def spot_check_requests(spark, k: int, seed_base: int) -> DataFrame:
    """k requests for each tier, numbered in the batch's shuffled order; the target stays in ``tone``."""
    tiers = spark.createDataFrame([(i, x) for i, x in enumerate(lists.TIERS)], "i long, tone string")
    own = spark.range(k).crossJoin(F.broadcast(tiers)).select((F.col("i") * k + F.col("id") + seed_base).alias("seed"), "tone").withColumn("key", F.col("seed"))
    own = p.shuffled(own, "key", seed_base)
    return own.select(F.col("place").cast("long").alias("req_id"), "seed", "tone", F.lit(0.0).alias("remix_prob"), F.lit(0.0).alias("min_sim"), F.lit(None).cast("map<string,string>").alias("locks"))


def display_slots(samples: DataFrame) -> DataFrame:
    """req_id, pos, text, cls, is_punctuation: the parts of a sample in order."""
    part = lambda x, cls="", punct=False: F.struct(x.alias("text"), F.lit(cls).alias("cls"), F.lit(punct).alias("is_punctuation"))
    c, m = F.col, lambda k: F.try_element_at("remix_parts", F.lit(k))
    of = F.when(c("of_article") != "", F.concat(F.lit("of "), c("of_article"))).otherwise("of")
    tail = F.when(m("modifier").isNotNull(), F.array(part(m("modifier"), "of_modifier"), part(m("head"), "of_head"))).when(m("topic").isNotNull(), F.array(part(m("topic"), "of_topic"), part(m("prep"), "", True), part(m("complement"), "of_complement"))).otherwise(F.array(part(c("of_object"), "of_object")))
    row = F.concat(F.array(part(c("item1"), "item1"), part(F.lit(","), "", True), part(c("item2"), "item2"), part(F.concat(F.lit(", and "), c("action_article")), "", True), part(c("action_noun"), "action_noun"), part(of, "", True)), tail)
    return samples.select("req_id", F.posexplode(row).alias("pos", "s")).select("req_id", "pos", "s.*")


def text_scores(texts: DataFrame, fillers: DataFrame, params: DataFrame, all_articles: bool = False) -> DataFrame:
    """id, text -> score and tier: the mean filler score of the parts; a text that doesn't fit scores 0 and is mainstream.

    Only ``and the`` texts fit unless ``all_articles``.
    """
    parts = t.text_fillers(F.regexp_replace("text", r"(?i)\band an? ", "and the ") if all_articles else F.col("text"))
    long = texts.select("id", F.explode(parts).alias("filler"))
    dim = fillers.groupBy("filler").agg(F.min_by(F.struct("freq", "popularity"), "slot_type").alias("f"))
    own = p.with_params(long.join(dim, "filler", "left"), params)
    score = s.filler_score(F.coalesce("f.freq", F.lit(1)), F.col("f.popularity"), F.col("pop_tone_blend"), F.col("pop_missing_default"))
    mean = own.groupBy("id", "accessibility_threshold_pop", "accessibility_threshold_mainstream").agg(F.avg(score).alias("score"))
    tier = s.tier(F.col("score"), F.col("accessibility_threshold_pop"), F.col("accessibility_threshold_mainstream"))
    return texts.select("id").join(mean.select("id", "score", tier.alias("tier")), "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("tier", F.lit("mainstream")).alias("tier"))
