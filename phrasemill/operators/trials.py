"""Calibration sweeps and parameter trials, many at once (T1-T3): requests carry their trial, all trials run in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.functions import scores as s
from phrasemill.operators import feedback, tuning
from phrasemill.operators import sampling as p
from phrasemill.session import materialise

SAMPLES, TONE_SAMPLES, SEED_BASE, SEED_STEP = 50, 30, 1000, 100
MIN_SIM_LEVELS, REMIX_PROB_LEVELS, SEED_BASES = (0.0, 0.05, 0.1, 0.15, 0.2, 0.3), (0.0, 0.2, 0.4, 0.6, 0.8, 1.0), (3000, 4000)


def _unlocked() -> Column:
    return F.lit(None).cast("map<string,string>").alias("locks")


def clamped_trials(proposals: DataFrame, bounds: DataFrame, params: DataFrame) -> DataFrame:
    """trial, param, value -> the same with the value within the parameter's bounds, if it has any; unknown parameters leave."""
    own = proposals.join(params.select(F.col("key").alias("param")), "param", "left_semi").join(bounds, "param", "left")
    return own.select("trial", "param", F.greatest(F.coalesce("lo", "value"), F.least(F.coalesce("hi", "value"), "value")).alias("value"))


def trial_params(params: DataFrame, trials: DataFrame) -> DataFrame:
    """trial, key, value: the parameters with each trial's own one in place."""
    own = trials.select("trial", F.col("param").alias("key"), F.col("value").alias("own"))
    every = trials.select("trial").distinct().crossJoin(F.broadcast(params.select("key", "value")))
    return every.join(own, ["trial", "key"], "left").select("trial", "key", F.coalesce("own", "value").alias("value"))


def trial_requests(trials: DataFrame, samples: int = SAMPLES, tone_samples: int = TONE_SAMPLES, step: int = SEED_STEP) -> DataFrame:
    """Of each trial: ``samples`` requests without a tone, for quality, and ``tone_samples`` each for pop and niche."""
    every = samples + 2 * tone_samples
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(every - 1).cast("long"))).alias("i")
    tone = F.when(F.col("i") < samples, "").when(F.col("i") < samples + tone_samples, "pop").otherwise("niche")
    own = trials.select("trial").distinct().select("trial", i)
    return own.select((F.col("trial") * every + F.col("i")).alias("req_id"), "trial", (SEED_BASE + step * F.col("trial") + F.col("i")).alias("seed"), tone.alias("tone"), F.lit(0.0).alias("remix_prob"), F.lit(0.0).alias("min_sim"), _unlocked())


def evaluated(samples: DataFrame, requests: DataFrame, ratings: DataFrame, pools: DataFrame, params: DataFrame, weight: float = 0.5) -> DataFrame:
    """trial, quality, separation, composite: quality from the ratings (req_id and the three axes) of the samples without a tone,
    separation from the fillers of the others, scored with the trial's own parameters."""
    own = samples.join(requests.select("req_id", "tone"), "req_id")
    quality = tuning.axis_summary(own.where("tone = ''").select("req_id", "trial").join(ratings, "req_id"), "trial").select("trial", "quality")
    slots = (("item1", "list_item"), ("item2", "list_item"), ("action_noun", "action_noun"), ("of_object", "of_object"))
    long = own.where("tone <> ''").select("trial", "tone", F.explode(F.array(*(F.struct(F.lit(k).alias("slot_type"), F.col(c).alias("filler")) for c, k in slots))).alias("f")).select("trial", "tone", "f.*")
    long = feedback.scores_by_slot(long, pools, missing=None, case_sensitive=False).join(p.as_row(params.where("key in ('pop_tone_blend', 'pop_missing_default')"), "trial"), "trial")
    score = s.filler_score(F.col("freq"), F.col("popularity"), F.col("pop_tone_blend"), F.col("pop_missing_default"))
    apart = feedback.histogram_overlap(long.withColumn("score", score), "tone", "pop", "niche", by=("trial",)).withColumn("separation", F.round("separation", 9))
    both = quality.join(apart, "trial")
    return both.select("trial", "quality", "separation", s.composite(F.col("quality"), F.col("separation"), weight).alias("composite"))


def judged(trials: DataFrame, scores: DataFrame, baseline: int = 0) -> DataFrame:
    """trial, param, value, quality, separation, composite, status: a trial is kept if it beats the baseline and every trial before."""
    floor = scores.where(F.col("trial") == baseline).select(F.col("composite").alias("floor"))
    log = trials.join(scores, "trial").where(F.col("trial") != baseline).crossJoin(F.broadcast(floor)).withColumnRenamed("trial", "iteration")
    return tuning.keep_or_discard(log, F.col("floor")).withColumnRenamed("iteration", "trial").drop("floor")


def sweep_requests(seeds: DataFrame, levels: DataFrame, phase: int) -> DataFrame:
    """Requests of all levels (level, remix_prob, min_sim) of one phase with all seeds (n from 0)."""
    own = seeds.crossJoin(F.broadcast(levels))
    return own.select((F.col("n") * 64 + F.col("level")).alias("req_id"), (F.col("n") + SEED_BASES[phase - 1]).alias("seed"), F.lit("").alias("tone"), "remix_prob", "min_sim", _unlocked(), "level")


def sweep_summary(samples: DataFrame, requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """level, remix_prob, min_sim, the axes' means, overall, quality, n and remix_rate."""
    own = samples.join(requests.select("req_id", "level", "remix_prob", "min_sim"), "req_id").join(ratings, "req_id")
    keys = ("level", "remix_prob", "min_sim")
    return tuning.axis_summary(own, *keys).join(own.groupBy(*keys).agg(F.avg(F.col("remixed").cast("int")).alias("remix_rate")), list(keys))


def calibrate(seeds: DataFrame, generate, rate) -> DataFrame:
    """phase, level, remix_prob, min_sim, means, remix_rate, best: min_sim swept with every sample remixed, then remix_prob at the best min_sim.

    ``generate`` makes samples of requests and ``rate`` gives a table of ratings (req_id and axes) of samples. All levels of a phase
    run in one plan; of levels with equal means the first is best.
    """
    spark = seeds.sparkSession
    out = None
    best = None
    for phase in (1, 2):
        if phase == 1:
            levels = spark.createDataFrame([(i, 1.0, x) for i, x in enumerate(MIN_SIM_LEVELS)], "level int, remix_prob double, min_sim double")
        else:
            levels = spark.createDataFrame([(i, x) for i, x in enumerate(REMIX_PROB_LEVELS)], "level int, remix_prob double").crossJoin(F.broadcast(best.select("min_sim")))
        requests = materialise(sweep_requests(seeds, levels, phase), "sweep")
        samples = materialise(generate(requests), "samples")
        summary = materialise(sweep_summary(samples, requests, rate(samples)), "summary")
        best = summary.agg(F.max_by(F.struct("level", "remix_prob", "min_sim"), F.struct("overall", -F.col("level"))).alias("b")).select("b.*")
        own = summary.join(F.broadcast(best.select("level", F.lit(True).alias("best"))), "level", "left").select(F.lit(phase).alias("phase"), *summary.columns, F.coalesce("best", F.lit(False)).alias("best"))
        out = own if out is None else out.unionByName(own)
    return out


#: The calibrated settings, with their values before any calibration.
CALIBRATED = {"remix_calibrated_min_sim": 0.1, "remix_calibrated_remix_prob": 0.8}


def results(calibrated: DataFrame, baseline: DataFrame) -> DataFrame:
    """``calibrate`` and the baseline's one row -> key, value: the five entries that a calibration leaves in the config log, the best levels as numbers and
    the baseline and the phases (by level: avg, dims, remix_rate) as JSON."""
    c, phase = F.col, lambda k: F.col("phase") == k
    told = F.struct(c("overall").alias("avg"), F.struct("coherence", "evocativeness", "surprise").alias("dims"), "remix_rate")
    levels = lambda k, level: F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.when(phase(k), F.struct("level", c(level).cast("string").alias("name"), told.alias("told"))))), lambda x: F.struct(x["name"], x["told"]))))
    best = lambda k, level: F.max(F.when(phase(k) & c("best"), c(level))).cast("string")
    one = calibrated.agg(best(1, "min_sim").alias("a"), best(2, "remix_prob").alias("b"), levels(1, "min_sim").alias("c"), levels(2, "remix_prob").alias("d"))
    one = one.crossJoin(baseline.select(F.to_json(F.struct("mean", "std", F.col("least").alias("min"), "p10")).alias("e")))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), c(value).alias("value"))
    rows = F.array(pair("remix_calibrated_min_sim", "a"), pair("remix_calibrated_remix_prob", "b"), pair("remix_baseline_sim", "e"), pair("remix_phase1_results", "c"), pair("remix_phase2_results", "d"))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def with_calibrated(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests without a remix_prob or min_sim of their own get the calibrated ones of the config table (key, value), or the
    values before any calibration."""
    got = stored.where(F.col("key").isin(*CALIBRATED)).groupBy().agg(*(F.max(F.when(F.col("key") == k, F.expr("try_cast(value as double)"))).alias(k) for k in CALIBRATED))
    own = requests.crossJoin(F.broadcast(got))
    fill = lambda c, k: F.coalesce(c, k, F.lit(CALIBRATED[k]))
    return own.withColumns({"min_sim": fill("min_sim", "remix_calibrated_min_sim"), "remix_prob": fill("remix_prob", "remix_calibrated_remix_prob")}).drop(*CALIBRATED)


def rated_by(text: Column, axis: str) -> Column:
    """A stand-in for a rater: 1 to 10 by a hash of the text."""
    return (1 + F.floor(10 * s.uniform(text, axis))).cast("int")
