"""Queries on parameters, scores, draws and vectors, and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from phrasemill import fixtures
from phrasemill.functions import scores as s
from phrasemill.operators import sampling as p
from phrasemill.operators import vectors as v
from phrasemill.operators.ranges import running
from phrasemill.plans import bibliography as bib
from phrasemill.plans import duck
from phrasemill.session import materialise

SEED = 7
STORED = [("pop_tone_blend", "0.25"), ("sample_tone_spread", "0.5"), ("pop_exponent", "x"), ("other", "1")]
_STORED_SQL = "stored as (select * from (values " + ", ".join(f"('{k}', '{x}')" for k, x in STORED) + ") v(key, value))"
_U = "(('0x' || substr(md5({0}), 1, 13))::bigint / 4503599627370496.0)"
_POP = "pop as (select filler, freq, case when coalesce(checkouts, 0) + coalesce(editions, 0) > 0 then 0.7 * log10(1 + checkouts) + 0.3 * log10(1 + editions) end as popularity from signals)"


def signals(spark, d):
    return fixtures.view(spark, d, "signals")


def pop(spark, d):
    return p.popularity(signals(spark, d))


def stored(spark):
    return spark.createDataFrame(STORED, "key string, value string")


def params(spark):
    return p.effective_params(spark, stored(spark))


def scored(spark, d):
    c = F.col
    own = p.with_params(pop(spark, d), params(spark))
    score = s.filler_score(c("freq"), c("popularity"), c("pop_tone_blend"), c("pop_missing_default"))
    out = own.withColumns({"score": score, "base": s.base_weight(c("freq"), c("popularity"), F.lit(0.5), c("pop_missing_default"))})
    out = out.withColumn("bias", s.tone_bias(c("score"), c("tone_target_pop_list_item"), c("weighted_sample_spread"), c("weighted_sample_bias_floor")))
    return out.select("filler", F.round("score", 6).alias("score"), F.round("base", 6).alias("base"), F.round("bias", 6).alias("bias"), s.tier(c("score"), c("accessibility_threshold_pop"), c("accessibility_threshold_mainstream")).alias("tier"), F.round(s.tier_weight(c("score"), c("tier_center_niche"), c("sample_tone_spread")), 6).alias("niche_weight"), F.round(s.composite(c("score"), c("base"), 0.3), 6).alias("composite"))


def pool(spark, d):
    return signals(spark, d).select(F.lit("all").alias("pool"), "filler", F.sqrt("freq").alias("weight"))


def seeds(spark, d):
    return fixtures.view(spark, d, "customer").select(F.col("c_custkey").alias("seed"))


def words(spark, d):
    e = fixtures.view(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return fixtures.view(spark, d, "token_words").join(e, "vec_id").select("word", "v")


def phrase_vectors(spark, d):
    names = fixtures.view(spark, d, "part").select(F.col("p_name").alias("id"), F.col("p_name").alias("phrase")).distinct()
    return v.phrase_vectors(names, words(spark, d))


def rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


WORDS = "words as (select word, e.embedding::double[] as v from token_words join embeddings e using (vec_id))"
VEC = """long as (select distinct p_name as id, p_name from part), tk as (select id, unnest(string_split(lower(p_name), ' ')) as word from long),
ex as (select id, generate_subscripts(v, 1) as pos, unnest(v) as x from tk join words using (word) where list_dot_product(v, v) > 0),
sums as (select id, pos, sum(x) as x, count(*) as n from ex group by id, pos), vec as (select id, list(x order by pos) as vector, max(n) as token_count from sums group by id),
cen as (select list(x order by pos) as centroid from (select pos, avg(x / token_count) as x from sums s join (select id, token_count from vec) t using (id) group by pos) c)"""
SCAL = "scal as (select id, list_dot_product(vector, centroid) as centroid_dot, list_dot_product(vector, vector) as norm_sq, list_dot_product(vector, centroid) / sqrt(list_dot_product(vector, vector)) / sqrt(list_dot_product(centroid, centroid)) as similarity from vec, cen)"
_EFF = f"eff as (select key, coalesce(try_cast(s.value as double), p.value) as value from params p left join stored s using (key))"
#: Draws without replacement: the first by its interval, the next from what is left, moved past the intervals taken.
_DRAW = f"""c as (select filler, sqrt(freq) as w, sum(sqrt(freq)) over (order by filler) as hi, sum(sqrt(freq)) over (order by filler) - sqrt(freq) as lo, sum(sqrt(freq)) over () as t from signals),
u as (select seed, {", ".join(f"{_U.format(f"seed || '|slot|{k}|draw'")} as u{k}" for k in (1, 2, 3))} from (select c_custkey as seed from customer) z),
one as (select u.*, filler, lo as lo1, w as w1, t from u join c on u1 * t >= lo and u1 * t < hi),
v2 as (select * exclude (filler), u2 * (t - w1) as v from one), two as (select v2.* exclude (t), c.filler, c.lo as lo2, c.w as w2, c.t from v2 join c on v + case when v >= lo1 then w1 else 0 end >= lo and v + case when v >= lo1 then w1 else 0 end < hi),
v3 as (select seed, u3 * (t - w1 - w2) as v, least(lo1, lo2) as la, case when lo1 < lo2 then w1 else w2 end as wa, greatest(lo1, lo2) as lb, case when lo1 < lo2 then w2 else w1 end as wb from two),
x3 as (select seed, case when v >= la then v + wa else v end as v, lb, wb from v3), y3 as (select seed, case when v >= lb then v + wb else v end as v from x3),
three as (select seed, filler from y3 join c on v >= lo and v < hi)"""


def with_vec(q, views=("token_words",)):
    return fixtures.with_views(list(views), f", {WORDS}, {VEC}, {SCAL}\n{q}")


def part_vectors(spark, d):
    """id (the sub-part), slot_type, vector and token_count of every sub-part with a known word."""
    parts = bib.parts(spark, d).select("slot_type", F.col("filler").alias("id"))
    found = v.phrase_vectors(parts.select("id", F.col("id").alias("phrase")).distinct(), words(spark, d))
    return materialise(parts.join(found, "id"), "part-vectors")


def approx(spark, d):
    """H9 of the two parts of every object that is a compound."""
    vec = phrase_vectors(spark, d)
    center = v.centroid(vec)
    own = part_vectors(spark, d)
    sc = v.scalars(own.where("slot_type = 'of_modifier'"), center).select(F.col("id").alias("modifier"), F.col("centroid_dot").alias("d1"), F.col("norm_sq").alias("q1"))
    head = v.scalars(own.where("slot_type = 'of_head'"), center).select(F.col("id").alias("head"), F.col("centroid_dot").alias("d2"), F.col("norm_sq").alias("q2"))
    out = bib.split(spark, d).select("filler", "compound.modifier", "compound.head").where("head is not null")
    out = out.join(sc, "modifier", "left").join(head, "head", "left").crossJoin(F.broadcast(center.select("centroid_norm")))
    return out.select("filler", F.round(s.approximate_cosine(F.array("d1", "d2"), F.array("q1", "q2"), F.col("centroid_norm"), F.lit(0.1)), 6).alias("sim"))


def cross(spark, d, digits=6):
    """C11: modifier x head and topic x complement, 3000 picks of each."""
    own = part_vectors(spark, d)
    num = lambda slot: running(own.where(F.col("slot_type") == slot), "count", F.lit(1), [F.col("id")], "n").select((F.col("n") - 1).alias("n"), "vector")
    one = lambda kind, a, b: v.mean_cross_similarity(num(a), num(b)).withColumn("kind", F.lit(kind))
    both = one("type1", "of_modifier", "of_head").unionByName(one("type2", "of_topic", "of_complement"))
    return both if digits is None else rounded(both, "mean_cosine")


PARTVEC = """pl as (select distinct filler as id from parts), ptk as (select id, unnest(string_split(lower(id), ' ')) as word from pl),
pex as (select id, generate_subscripts(v, 1) as pos, unnest(v) as x from ptk join words using (word) where list_dot_product(v, v) > 0),
pvec as (select id, list(x order by pos) as vector from (select id, pos, sum(x) as x from pex group by id, pos) s group by id),
psc as (select slot_type, filler, vector, list_dot_product(vector, centroid) as d, list_dot_product(vector, vector) as q from parts join pvec on pvec.id = filler, cen)"""


def with_parts(q):
    return duck.chain(q, ("editions_raw", "token_words"), f"{WORDS}, {VEC}, {PARTVEC}")


def _crossed(kind, a, b):
    u = lambda x: _U.format(f"'42|cross|' || id || '|{x}'")
    num = lambda slot: f"(select row_number() over (order by filler) - 1 as n, vector, count(*) over () as size from psc where slot_type = '{slot}')"
    return f"""select '{kind}' as kind, round(coalesce(avg(list_dot_product(a.vector, b.vector) / sqrt(list_dot_product(a.vector, a.vector)) / sqrt(list_dot_product(b.vector, b.vector))), 0), 6) as mean_cosine
    from (select unnest(range(3000)) as id) r join {num(a)} a on a.n = cast(floor({u('a')} * a.size) as bigint) join {num(b)} b on b.n = cast(floor({u('b')} * b.size) as bigint) where id < a.size * b.size"""


CROSSED = (_crossed("type1", "of_modifier", "of_head") + " union all " + _crossed("type2", "of_topic", "of_complement")).replace("round(coalesce(", "(coalesce(").replace(", 0), 6) as mean", ", 0)) as mean")

QUERIES = {
    "a11_upsert": (
        lambda sp, d: p.upsert(fixtures.view(sp, d, "experiments").select(F.col("param").alias("key"), F.col("iteration").alias("version"), F.when(F.col("iteration") % 50 != 0, F.col("new_value")).alias("value"))),
        fixtures.with_views(["experiments"], "select key, value from (select param as key, case when iteration % 50 <> 0 then new_value end as value, row_number() over (partition by param order by iteration desc) as rn from experiments) x where rn = 1 and value is not null"),
    ),
    "b29_clamp": (
        lambda sp, d: p.clamp_proposals(fixtures.view(sp, d, "experiments").select("param", F.col("new_value").alias("value")), sp.createDataFrame([("pop_exponent", 0.2, 0.6), ("pop_tone_blend", 0.0, 0.5)], "param string, lo double, hi double")),
        fixtures.with_views(["experiments"], "select param, greatest(lo, least(hi, new_value)) as value from experiments join (values ('pop_exponent', 0.2, 0.6), ('pop_tone_blend', 0.0, 0.5)) b(param, lo, hi) using (param)"),
    ),
    "c10_params": (
        lambda sp, d: p.with_params(fixtures.view(sp, d, "customer").select("c_custkey"), params(sp)).select("c_custkey", "pop_tone_blend", "sample_tone_spread", "pop_exponent"),
        f"with {duck.PARAMS}, {_STORED_SQL}, {_EFF} select c_custkey, (select value from eff where key = 'pop_tone_blend') as pop_tone_blend, (select value from eff where key = 'sample_tone_spread') as sample_tone_spread, (select value from eff where key = 'pop_exponent') as pop_exponent from customer",
    ),
    "g03_set_difference": (
        lambda sp, d: p.set_difference(p.defaults(sp), fixtures.view(sp, d, "experiments").select(F.col("param").alias("key")).distinct().unionByName(fixtures.view(sp, d, "region").select(F.lower("r_name").alias("key")))),
        fixtures.with_views(["experiments"], f", {duck.PARAMS}, b as (select distinct param as key from experiments union select lower(r_name) from region) select key, 'added' as change from params where key not in (select key from b) union all select key, 'removed' from b where key not in (select key from params)"),
    ),
    "d14_popularity": (lambda sp, d: rounded(pop(sp, d), "popularity"), fixtures.with_views(["signals"], f", {_POP} select filler, freq, round(popularity, 6) as popularity from pop")),
    "d15_correlation": (lambda sp, d: rounded(p.correlation(pop(sp, d)), "r"), fixtures.with_views(["signals"], f", {_POP} select round(corr(log10(1 + freq), popularity), 6) as r from pop")),
    "h03_h08_scores": (
        scored,
        fixtures.with_views(["signals"], f""", {_POP}, x as (select *, 0.75 * log10(1 + freq) + 0.25 * coalesce(popularity, 0.1) as sc, 0.5 * sqrt(freq) + 0.5 * sqrt(greatest(coalesce(popularity, 0.1), 0.001)) as b from pop)
        select filler, round(sc, 6) as score, round(b, 6) as base, round(0.05 + 0.95 * exp(-pow((sc - 1.5) / 0.4, 2)), 6) as bias, case when sc > 1.0 then 'pop' when sc >= 0.5 then 'mainstream' else 'niche' end as tier, round(exp(-pow((sc - 0.25) / 0.5, 2)), 6) as niche_weight, round(0.3 * sc + 0.7 * b, 6) as composite from x"""),
    ),
    "e08_k03_draw_small": (
        lambda sp, d: p.draw_without(pool(sp, d), seeds(sp, d).withColumn("pool", F.lit("all")), 2).drop("pool"),
        fixtures.with_views(["signals"], f", {_DRAW} select seed, filler, 1 as rank from one union all select seed, filler, 2 from two"),
    ),
    "e08_draw_three": (
        lambda sp, d: p.draw_without(pool(sp, d), fixtures.view(sp, d, "orders").select(F.col("o_orderkey").alias("seed"), F.lit("all").alias("pool")), 3).drop("pool"),
        fixtures.with_views(["signals"], f", {_DRAW.replace('c_custkey as seed from customer', 'o_orderkey as seed from orders')} select seed, filler, 1 as rank from one union all select seed, filler, 2 from two union all select seed, filler, 3 from three"),
    ),
    "e09_cumulative": (
        lambda sp, d: p.cumulative(pool(sp, d)).select("pool", "filler", *(F.round(F.col(c) / F.col("scale"), 6).alias(k) for c, k in (("lo", "cum_lo"), ("hi", "cum_hi"), ("total", "total")))),
        fixtures.with_views(["signals"], "select 'all' as pool, filler, round(sum(sqrt(freq)) over (order by filler), 6) as cum_hi, round(sum(sqrt(freq)) over (order by filler) - sqrt(freq), 6) as cum_lo, round(sum(sqrt(freq)) over (), 6) as total from signals"),
    ),
    "c13_draw_large": (
        lambda sp, d: p.draw_large(pool(sp, d), fixtures.view(sp, d, "orders").select(F.col("o_orderkey").alias("seed"), F.lit("all").alias("pool"))),
        fixtures.with_views(["signals"], f", c as (select filler, sum(sqrt(freq)) over (order by filler) as hi, sum(sqrt(freq)) over (order by filler) - sqrt(freq) as lo, sum(sqrt(freq)) over () as t from signals) select o_orderkey as seed, 'all' as pool, filler from orders join c on {_U.format(chr(39).join(['o_orderkey || ', '|slot|1|a', '']))} * t >= lo and {_U.format(chr(39).join(['o_orderkey || ', '|slot|1|a', '']))} * t < hi"),
    ),
    "k03_draw_two_large": (lambda sp, d: p.draw_large(pool(sp, d), fixtures.view(sp, d, "orders").select(F.col("o_orderkey").alias("seed"), F.lit("all").alias("pool")), two=True),
        fixtures.with_views(["signals"], f""", c as (select filler, sqrt(freq) as w, sum(sqrt(freq)) over (order by filler) as hi, sum(sqrt(freq)) over (order by filler) - sqrt(freq) as lo, sum(sqrt(freq)) over () as t from signals),
        u as (select o_orderkey as seed, {_U.format("o_orderkey || '|slot|1|a'")} as u1, {_U.format("o_orderkey || '|slot|2|b'")} as u2 from orders),
        one as (select seed, filler, lo, w, u2 * (t - w) as v from u join c on u1 * t >= lo and u1 * t < hi)
        select seed, 'all' as pool, one.filler, c.filler as filler2 from one join c on (case when v >= one.lo then v + one.w else v end) >= c.lo and (case when v >= one.lo then v + one.w else v end) < c.hi"""),
    ),
    "f02_sample_per_group": (
        lambda sp, d: p.sample_per_group(fixtures.view(sp, d, "part").select("p_brand", F.col("p_partkey").cast("string").alias("key")), "p_brand", "key", 3, SEED),
        f"select p_brand, key from (select p_brand, p_partkey::varchar as key, row_number() over (partition by p_brand order by md5('{SEED}|' || p_partkey), p_partkey::varchar) as rn from part) x where rn <= 3",
    ),
    "f03_sample_rows": (lambda sp, d: p.sample_rows(fixtures.view(sp, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key")), "key", 2000, SEED).drop("key"), f"select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, l_orderkey || '-' || l_linenumber as key from lineitem) x order by md5('{SEED}|' || key), key limit 2000"),
    "f05_shuffled": (lambda sp, d: p.shuffled(fixtures.view(sp, d, "customer").select("c_custkey"), "c_custkey", SEED), f"select c_custkey, row_number() over (order by md5('{SEED}|' || c_custkey), c_custkey) as place from customer"),
    "f07_g04_tier_draws": (
        lambda sp, d: rounded(p.tier_draws(pop(sp, d).select(F.col("filler").alias("id"), F.coalesce("popularity", F.lit(0.1)).alias("score")), p.defaults(sp), SEED, sp.createDataFrame([("pop",), ("niche",)], "tier string")), "score"),
        fixtures.with_views(["signals"], f", {_POP}, s as (select filler as id, coalesce(popularity, 0.1) as score from pop), w as (select id, score, exp(-pow((score - 0.25) / 0.6, 2)) as n, exp(-pow((score - 1.5) / 0.6, 2)) as p, {_U.format(chr(39).join(['', str(SEED) + '|tier|0|', ' || id']))} as u from s) select id, round(score, 6) as score, case when u * (n + p) < n then 'niche' else 'pop' end as tier from w"),
    ),
    "d11_phrase_vectors": (
        lambda sp, d: phrase_vectors(sp, d).select("id", "token_count", F.round(F.get("vector", F.lit(0)), 6).alias("x0"), F.round(F.get("vector", F.lit(63)), 6).alias("x63")),
        with_vec("select id, token_count, round(vector[1], 6) as x0, round(vector[64], 6) as x63 from vec"),
    ),
    "d12_centroid": (lambda sp, d: v.centroid(phrase_vectors(sp, d)).select(F.round("centroid_norm", 6).alias("centroid_norm"), F.round(F.get("centroid", F.lit(0)), 6).alias("x0")), with_vec("select round(sqrt(list_dot_product(centroid, centroid)), 6) as centroid_norm, round(centroid[1], 6) as x0 from cen")),
    "d13_h10_scalars": (
        lambda sp, d: (lambda vec: rounded(v.scalars(vec, v.centroid(vec)), "centroid_dot", "norm_sq", "similarity"))(phrase_vectors(sp, d)),
        with_vec("select id, round(centroid_dot, 6) as centroid_dot, round(norm_sq, 6) as norm_sq, round(similarity, 6) as similarity from scal"),
    ),
    "d18_baseline": (
        lambda sp, d: (lambda vec: rounded(v.baseline(v.scalars(vec, v.centroid(vec))), "mean", "std", "least", "p10"))(phrase_vectors(sp, d)),
        with_vec("select round(avg(similarity), 6) as mean, round(stddev_pop(similarity), 6) as std, round(min(similarity), 6) as least, round(quantile_cont(similarity, 0.1), 6) as p10 from scal"),
    ),
    "h09_approximate_cosine": (
        approx,
        with_parts("""select c.filler, round(case when a.d is not null and b.d is not null then (a.d + b.d) / sqrt(a.q + b.q + 2 * sqrt(a.q) * sqrt(b.q) * 0.1) / sqrt(list_dot_product(centroid, centroid)) end, 6) as sim
        from cut c left join psc a on a.slot_type = 'of_modifier' and a.filler = modifier left join psc b on b.slot_type = 'of_head' and b.filler = head, cen where head is not null"""),
    ),
    "c11_cross_similarity": (cross, with_parts(f"{_crossed('type1', 'of_modifier', 'of_head')} union all {_crossed('type2', 'of_topic', 'of_complement')}")),
}
