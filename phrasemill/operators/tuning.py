"""Experiment logs and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.operators.ranges import previous, running

REGIME = "[regime change]"


def running_best(log: DataFrame, run: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``best``: the highest composite so far; logs of any length, ``run`` separates many."""
    return running(log, "max", F.col("composite"), [F.col("iteration")], "best", run)


def keep_or_discard(log: DataFrame, baseline: float | Column, run: tuple[str, ...] = ()) -> DataFrame:
    """A trial is kept if it beats the last kept score, that is the best of the baseline and all before."""
    floor = baseline if isinstance(baseline, Column) else F.lit(baseline)
    out = running(log, "max", F.col("composite"), [F.col("iteration")], "before", run, strict=True)
    return out.withColumn("status", F.when(F.col("composite") > F.greatest(floor, F.coalesce("before", floor)), "keep").otherwise("discard")).drop("before")


def value_path(log: DataFrame) -> DataFrame:
    return previous(log, "new_value", "iteration", "old_value", ("param",))


def param_stats(log: DataFrame) -> DataFrame:
    kept = F.count_if(F.col("status") == "keep")
    out = log.groupBy("param").agg(F.count(F.lit(1)).alias("attempts"), kept.alias("kept"), F.max("composite").alias("best_composite"), F.avg("composite").alias("avg_composite"))
    return out.withColumn("keep_rate", F.round(F.col("kept") / F.col("attempts") * 100).cast("int"))


def log_totals(log: DataFrame) -> DataFrame:
    at = lambda f: f("iteration", F.struct("composite", -F.col("iteration")))
    return log.agg(
        F.count(F.lit(1)).alias("experiments"), F.count_if(F.col("status") == "keep").alias("kept"), F.max("composite").alias("best"), at(F.max_by).alias("best_at"),
        F.min("composite").alias("worst"), F.min_by("iteration", F.struct("composite", "iteration")).alias("worst_at"), F.avg("composite").alias("mean"), (F.max("quality") - F.min("quality")).alias("quality_range"),
        (F.max("separation") - F.min("separation")).alias("separation_range"), F.count_distinct("param").alias("params"),
    ).withColumn("kept_pct", 100 * F.col("kept") / F.col("experiments"))


def log_context(log: DataFrame, n: int = 20) -> DataFrame:
    """The newest n rows (a top-n) and all regime marks."""
    since = log.orderBy(F.desc("iteration")).limit(n).agg(F.min("iteration").alias("since"))
    return log.crossJoin(F.broadcast(since)).where((F.col("iteration") >= F.col("since")) | (F.col("param") == REGIME)).drop("since")


def regime_change(log: DataFrame, params: DataFrame) -> DataFrame:
    """change, key of the parameters added or removed since the newest mark (``description`` lists them after ``available_params=``);
    without a mark, those never mentioned count as added, if any was mentioned. Empty if nothing changed."""
    mark = log.where(F.col("param") == REGIME).agg(F.max_by("description", "iteration").alias("d")).select(F.split(F.element_at(F.split("d", "available_params="), -1), ",").alias("marked"), F.col("d").isNotNull().alias("has_mark"))
    mentioned = log.where(~F.col("param").isin(REGIME, "(failed)")).agg(F.collect_set("param").alias("mentioned"))
    now = params.agg(F.collect_set("key").alias("now"))  # one short array each
    both = mark.crossJoin(mentioned).crossJoin(now)
    before = F.when(F.col("has_mark"), F.col("marked")).otherwise(F.when(F.size("mentioned") > 0, F.array_intersect("mentioned", "now")).otherwise(F.col("now")))
    out = both.select("now", before.alias("before"))
    rows = F.concat(F.transform(F.array_except("now", "before"), lambda k: F.struct(F.lit("added").alias("change"), k.alias("key"))), F.transform(F.array_except("before", "now"), lambda k: F.struct(F.lit("removed").alias("change"), k.alias("key"))))
    return out.select(F.explode(rows).alias("r")).select("r.*")


def prefer_round(score: Column, round_score: Column, value: Column, round_value: Column, tolerance: float = 0.02) -> Column:
    """The rounder value where it costs at most ``tolerance`` of the score."""
    return F.when(round_score >= (1 - tolerance) * score, round_value).otherwise(value)


def pareto(log: DataFrame) -> DataFrame:
    """Adds ``frontier``: no other trial is better in one score and at least as good in the other; equal trials are so together."""
    best = log.groupBy("quality").agg(F.max("separation").alias("top"))
    best = running(best, "max", F.col("top"), [F.desc("quality")], "above", strict=True)
    out = log.join(best, "quality")
    return out.withColumn("frontier", (F.col("separation") == F.col("top")) & (F.col("above").isNull() | (F.col("separation") > F.col("above")))).drop("top", "above")


def axis_summary(ratings: DataFrame, *by: str) -> DataFrame:
    """Means of coherence, evocativeness, surprise, their mean, and quality (their sum over 30 a sample), per group if given."""
    axes = ("coherence", "evocativeness", "surprise")
    total = F.col(axes[0]) + F.col(axes[1]) + F.col(axes[2])
    return ratings.groupBy(*by).agg(*(F.avg(a).alias(a) for a in axes), (F.sum(total) / (3 * F.count(F.lit(1)))).alias("overall"), (F.sum(total) / (30 * F.count(F.lit(1)))).alias("quality"), F.count(F.lit(1)).alias("n"))


def best_level(summary: DataFrame, level: str, score: str, *by: str) -> DataFrame:
    """The level with the highest score, the first of equals."""
    return summary.groupBy(*by).agg(F.max_by(level, F.struct(score, -F.col(level))).alias("best_level"), F.max(score).alias("best_score"))
