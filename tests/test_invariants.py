"""Invariants: frequencies, draws against weights, independence of partitioning, samples."""

import math

import oracle
import pytest
from pyspark.sql import functions as F

from phrasemill import catalog
from phrasemill.operators import sampling
from phrasemill.plans import bibliography as bib
from phrasemill.plans import generation as gen
from phrasemill.plans import numbers


def test_frequencies_add_up(spark, small):
    valid = bib.valid(spark, small)
    items = valid.agg(F.sum(F.size("list_items") + 2)).first()[0]
    assert bib.pools(spark, small).agg(F.sum("freq")).first()[0] == items


def test_draws_follow_weights(spark, small):
    pool = numbers.pool(spark, small)
    n = 20_000
    got = sampling.draw_large(pool, spark.range(n).select(F.col("id").alias("seed"), F.lit("all").alias("pool")), two=True)
    both = got.join(pool.select("filler", "weight"), "filler").groupBy("filler", "weight").agg(F.count(F.lit(1)).alias("k")).collect()
    total = pool.agg(F.sum("weight")).first()[0]
    chi = sum((r.k - n * r.weight / total) ** 2 / (n * r.weight / total) for r in both)
    assert got.count() == n and got.where("filler = filler2").count() == 0 and chi < 2 * len(both)


def test_same_draws_at_any_partitioning(spark, small):
    pool, seeds = numbers.pool(spark, small).drop("pool"), numbers.seeds(spark, small)
    pool, seeds = pool.withColumn("pool", F.lit("all")), seeds.withColumn("pool", F.lit("all"))
    assert oracle.of_spark(sampling.draw_without(pool.repartition(1), seeds.repartition(1), 3)) == oracle.of_spark(sampling.draw_without(pool.repartition(8), seeds.repartition(8), 3))


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_intervals_part_the_whole_range(spark, parts):
    """No gap and no overlap: each interval begins where the one before ends, from 0 to the total, in two pools of uneven weights."""
    rows = [(f"p{i % 2}", f"f{i:04}", math.sqrt(i) * (1e-9 if i % 7 == 0 else 1) if i % 5 else 0.0) for i in range(3000)] + [("p0", "none", None), ("p1", "less", -1.0)]
    pool = spark.createDataFrame(rows, "pool string, filler string, weight double")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        cum = sampling.cumulative(pool.repartition(parts)).persist()
        got = cum.orderBy("pool", "lo", "hi").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    for name in ("p0", "p1"):
        own = [r for r in got if r.pool == name]
        assert own[0].lo == 0 and own[-1].hi == own[0].total < 1 << 62 and all(a.hi == b.lo for a, b in zip(own, own[1:]))
        assert all(abs(r.units / r.scale - max(r.weight or 0, 0)) <= 1 / r.scale for r in own)
    # every edge of every interval finds exactly one filler
    edges = cum.where("units > 0").select("pool", "width", F.explode(F.array("lo", F.col("hi") - 1)).alias("point"), F.col("filler").alias("want"))
    found = sampling.pick(edges, cum).select("want", "filler").collect()
    assert len(found) == edges.count() and all(r.want == r.filler for r in found)


def test_draws_without_replacement_have_the_law_of_exponential_keys(spark):
    """Pairs of fillers, in order, as often as the least exponential keys -ln(u) / w give them; a pool that is too small gives all it has."""
    weights = {"a": 1.0, "b": 2.0, "c": 4.0, "d": 0.5}
    pool = spark.createDataFrame([("p", k, w) for k, w in weights.items()], "pool string, filler string, weight double")
    n = 20_000
    seeds = spark.range(n).select(F.col("id").alias("seed"), F.lit("p").alias("pool"))
    rows = sampling.draw_without(pool, seeds, 2).groupBy("seed").agg(F.min_by("filler", "rank").alias("x"), F.max_by("filler", "rank").alias("y")).groupBy("x", "y").count().collect()
    total = sum(weights.values())
    want = {(x, y): n * weights[x] / total * weights[y] / (total - weights[x]) for x in weights for y in weights if x != y}
    assert sum(r["count"] for r in rows) == n and all((r.x, r.y) in want for r in rows)
    got = {(r.x, r.y): r["count"] for r in rows}
    assert sum((got.get(k, 0) - w) ** 2 / w for k, w in want.items()) < 31.3  # chi square of 11 degrees, p = 0.001
    all_of = sampling.draw_without(pool, seeds.limit(5), 6).groupBy("seed").agg(F.sort_array(F.collect_list("filler")).alias("f"), F.max("rank").alias("r")).collect()
    assert len(all_of) == 5 and all(r.f == sorted(weights) and r.r == 4 for r in all_of)


def test_samples(spark, small):
    rows = {r.req_id: r for r in gen.samples(spark, small).collect()}
    req = {r.req_id: r for r in gen.requests(spark, small).collect()}
    assert set(rows) == set(req)
    for i, r in rows.items():
        locks = req[i].locks or {}
        assert r.item1 != r.item2 and r.text.startswith(f"{r.item1}, {r.item2}, and ")
        assert locks.get("item1", r.item1) == r.item1
        if "of_object" in locks:
            assert r.of_object == "The End" and not r.remixed
        if "of_head" in locks:
            assert r.remixed and r.remix_parts["head"] == "Anvil"
        if r.remixed and "of_head" not in locks:
            assert r.remix_similarity is None or r.remix_similarity >= 0.1
            assert len(r.of_object.split()) == len(" ".join(r.remix_parts.values()).split())


def test_templates_of_late_and_long_sentences(spark, tmp_path):
    """A sentence has the template of its words wherever it stands, and the index counts all of them."""
    few = ["The art of war", "A history of small towns and large rivers", "Money", "How to paint, draw and print", "The end of the road"]
    texts = [". ".join(few[(i + k) % 5] for k in range(9)) + "\n" + " ".join([few[i % 5]] * 40) for i in range(7)]
    spark.createDataFrame([(i - 2, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i - 2, pos): s.strip(" ") for i, x in enumerate(texts) for pos, s in enumerate(x.replace("\n", ".").split("."))}
    rows = {(r.doc_id, r.pos): (r.template, tuple(r.slots)) for r in catalog.queries()["h12_h13_templates"](spark, str(tmp_path)).collect()}
    assert rows.keys() == want.keys() and max(map(len, want.values())) >= 400
    assert len({(want[k], v) for k, v in rows.items()}) == len(set(want.values()))
    index = {r.template: (r["count"], r.example) for r in catalog.queries()["d08_pattern_index"](spark, str(tmp_path)).collect()}
    assert index == {x: (sum(v[0] == x for v in rows.values()), want[min(k for k, v in rows.items() if v[0] == x)]) for x in {v[0] for v in rows.values()}}
