"""Parameters, popularity, weights and seeded draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.functions import scores as s
from phrasemill.functions import words as lists
from phrasemill.operators.ranges import running
from phrasemill.session import materialise

#: Buckets of a pool's range join: so many at least, and so many fillers in each on average.
BUCKETS, BUCKET_FILLERS = 64, 4
#: All units of a pool are fewer than two to this power.
UNIT_BITS = 61


def defaults(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(lists.PARAMS), "key string, value double")


def upsert(log: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """The newest row of each key of an append-only log; a null value is a tombstone. Reverting appends the older value."""
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(version)))
    return log.withColumn("rn", last).where("rn = 1 and value is not null").drop("rn", version)


def effective_params(spark: SparkSession, stored: DataFrame | None = None) -> DataFrame:
    """Defaults, overridden by stored values that are numbers; unknown keys are ignored."""
    own = defaults(spark)
    if stored is None:
        return own
    got = stored.select("key", F.expr("try_cast(value as double)").alias("stored"))
    return own.join(F.broadcast(got), "key", "left").select("key", F.coalesce("stored", "value").alias("value"))


def as_row(params: DataFrame, *by: str) -> DataFrame:
    """One row (of each group), a column for each parameter: for a broadcast cross join of known size."""
    return params.groupBy(*by).pivot("key", [k for k, _ in lists.PARAMS]).agg(F.first("value"))


def with_params(df: DataFrame, params: DataFrame) -> DataFrame:
    return df.crossJoin(F.broadcast(as_row(params)))


def clamp_proposals(proposals: DataFrame, bounds: DataFrame) -> DataFrame:
    """param, value within lo..hi of ``bounds``; unknown parameters leave."""
    return proposals.join(F.broadcast(bounds), "param").select("param", F.greatest("lo", F.least("hi", "value")).alias("value"))


def set_difference(now: DataFrame, before: DataFrame, key: str = "key") -> DataFrame:
    """key and change (added or removed)."""
    added, removed = now.select(key).exceptAll(before.select(key)), before.select(key).exceptAll(now.select(key))
    return added.withColumn("change", F.lit("added")).unionByName(removed.withColumn("change", F.lit("removed")))


def popularity(signals: DataFrame, weights=(0.7, 0.3, 0.0), exponent: float = 1.0) -> DataFrame:
    """filler, freq, popularity: the weighted sum of log10(1 + x)^e over checkouts, editions and freq; null without any signal."""
    terms = [w * F.pow(F.log10(1 + F.coalesce(F.col(c), F.lit(0)).cast("double")), exponent) for w, c in zip(weights, ("checkouts", "editions", "freq"))]
    total = reduce(lambda a, b: a + b, terms)
    return signals.select("filler", "freq", F.when(F.coalesce("checkouts", F.lit(0)) + F.coalesce("editions", F.lit(0)) > 0, total).alias("popularity"))


def correlation(pop: DataFrame) -> DataFrame:
    return pop.agg(F.corr(F.log10(1 + F.col("freq")), F.col("popularity")).alias("r"))


def cumulative(pool: DataFrame, by=("pool",)) -> DataFrame:
    """Adds units, lo, hi, total, width and scale: the weights as whole units, laid end to end by filler within each pool of any size.

    ``scale`` (units of weight 1) is a power of two that depends on the pool's largest weight and its size only, so a filler's units are the same at any
    partitioning; the intervals [lo, hi) part [0, total) without gap or overlap. Null, negative and vanishing weights get no units. ``width`` is that
    of the pool's buckets (``pick``).
    """
    weight, by = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), list(by)
    bits = F.ceil(F.log2(F.greatest(F.max(weight), F.lit(1e-300)) * F.count(F.lit(1))))
    scale = pool.groupBy(*by).agg(F.pow(F.lit(2.0), F.lit(UNIT_BITS) - bits).alias("scale"))
    own = pool.join(scale, by).withColumn("units", F.floor(weight * F.col("scale") + 0.5))
    own = running(own, "sum", F.col("units"), [F.col("filler")], "hi", tuple(by)).withColumn("lo", F.col("hi") - F.col("units"))
    buckets = F.greatest(F.lit(BUCKETS), F.ceil(F.count(F.lit(1)) / BUCKET_FILLERS))
    totals = own.groupBy(*by).agg(F.max("hi").alias("total"), buckets.alias("buckets"))
    return own.join(totals.select(*by, "total", (F.call_function("div", "total", "buckets") + 1).alias("width")), by)


def pick(draws: DataFrame, cum: DataFrame, by=("pool",), point: str = "point", more=()) -> DataFrame:
    """Joins each draw's point, a whole number in [0, total), to the filler whose interval holds it, which is always one; draws from a
    pool that isn't there or is empty leave.

    ``draws`` has the pool's width; the filler's columns ``more`` come along. The range join is an equi join: every interval stands in the buckets that it touches, and a pool
    has so many that a bucket holds few fillers.
    """
    spot = lambda c: F.call_function("div", c, F.col("width"))
    reach = F.explode(F.sequence(spot(F.col("lo")), spot(F.col("hi") - 1))).alias("bucket")
    wide = cum.where("units > 0").select(*by, "filler", "units", "lo", "hi", *more, reach)
    own = draws.withColumn("bucket", spot(F.col(point)))
    return own.join(wide, [*by, "bucket"]).where((F.col(point) >= F.col("lo")) & (F.col(point) < F.col("hi"))).drop("bucket", "hi")


def started(seeds: DataFrame, cum: DataFrame, by=("pool",)) -> DataFrame:
    """The seeds with total and width of their pools."""
    return seeds.join(cum.groupBy(*by).agg(F.max("total").alias("total"), F.max("width").alias("width")), list(by))


def first_picks(seeds: DataFrame, cum: DataFrame, slot: Column, by=("pool",)) -> DataFrame:
    """seeds (seed, the columns ``by``, others) -> the same with filler, units, lo, total and width."""
    one = started(seeds, cum, by).withColumn("point", s.whole_uniform(F.col("total"), F.col("seed"), slot, 1, "a"))
    return pick(one, cum, by).drop("point")


def second_picks(first: DataFrame, cum: DataFrame, slot: Column, by=("pool",)) -> DataFrame:
    """``first_picks`` -> the same with ``filler2``: drawn from [0, T - w1) and moved past the first one's interval, which is exact."""
    v = s.whole_uniform(F.col("total") - F.col("units"), F.col("seed"), slot, 2, "b")
    again = first.withColumn("point", F.when(v >= F.col("lo"), v + F.col("units")).otherwise(v)).withColumnRenamed("filler", "first").drop("units", "lo")
    return pick(again, cum, by).withColumnRenamed("filler", "filler2").withColumnRenamed("first", "filler").drop("point")


def draw_large(pool: DataFrame, seeds: DataFrame, two: bool = False, slot: str = "slot", by=("pool",)) -> DataFrame:
    """seed, pool, filler (and filler2): by inverse cumulative weights, one row per seed; any number of seeds."""
    cum = materialise(cumulative(pool, by), "cumulated")
    got = first_picks(seeds, cum, F.lit(slot), by)
    if not two:
        return got.select("seed", *by, "filler")
    return second_picks(got, cum, F.lit(slot), by).select("seed", *by, "filler", "filler2")


def draw_without(pool: DataFrame, seeds: DataFrame, k: int, slot: str = "slot", by=("pool",)) -> DataFrame:
    """seed, the columns ``by``, filler, rank: k of a pool without replacement for each seed, in the order drawn; pools and seeds of any size.

    The j-th point is drawn from the units that are left and moved past the intervals taken before it, from left to right: each draw has the
    law of weights among the fillers left, and costs one look into a bucket. A pool of fewer fillers gives what it has.
    """
    cum = materialise(cumulative(pool, by), "cumulated")
    none = F.array().cast("array<struct<lo:bigint,units:bigint>>")
    state, out = started(seeds.select("seed", *by), cum, by).withColumn("taken", none), None
    for rank in range(1, k + 1):
        left = F.aggregate("taken", F.col("total"), lambda a, x: a - x["units"])
        v = s.whole_uniform(left, F.col("seed"), slot, rank, "draw")
        moved = F.aggregate(F.array_sort("taken"), v, lambda a, x: F.when(a >= x["lo"], a + x["units"]).otherwise(a))
        got = pick(state.withColumn("left", left).where("left > 0").withColumn("point", moved), cum, by)
        got = materialise(got.drop("left", "point"), "picks")
        own = got.select("seed", *by, "filler", F.lit(rank).alias("rank"))
        out = own if out is None else out.unionByName(own)
        state = got.withColumn("taken", F.concat("taken", F.array(F.struct("lo", "units")))).drop("filler", "units", "lo")
    return out


def sample_per_group(df: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key)))
    return df.withColumn("rn", F.row_number().over(W.partitionBy(group).orderBy(order, key))).where(F.col("rn") <= k).drop("rn")


def sample_rows(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(k)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``place``, the row's turn in a batch of any size."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return running(df.withColumn("_order", order), "count", F.lit(1), [F.col("_order"), F.col(key)], "place").drop("_order")


def tier_draws(scores: DataFrame, params: DataFrame, seed: int, allowed: DataFrame | None = None) -> DataFrame:
    """id, score -> tier drawn with Gaussian weights around the tiers' centers, among the allowed ones (all by default)."""
    centers = params.where(F.col("key").startswith("tier_center_")).select(F.substring("key", 13, 99).alias("tier"), F.col("value").alias("center"))
    if allowed is not None:
        centers = centers.join(F.broadcast(allowed), "tier", "left_semi")
    spread = params.where("key = 'sample_tone_spread'").select(F.col("value").alias("spread"))
    own = scores.crossJoin(F.broadcast(centers)).crossJoin(F.broadcast(spread)).withColumn("w", s.tier_weight(F.col("score"), F.col("center"), F.col("spread")))
    w = W.partitionBy("id").orderBy("tier")
    own = own.withColumns({"hi": F.sum("w").over(w), "total": F.sum("w").over(W.partitionBy("id")), "u": s.uniform(F.lit(seed), "tier", 0, F.col("id"))})
    return own.where(F.col("u") * F.col("total") < F.col("hi")).groupBy("id", "score").agg(F.min("tier").alias("tier"))
