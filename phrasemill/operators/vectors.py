"""Phrase vectors, their centroid and the scalars kept of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.functions import scores as s
from phrasemill.operators.ranges import in_ranges


def phrase_vectors(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """id, phrase x word, v -> id, vector (sum), token_count; unknown and zero words are left out, phrases of none leave."""
    long = phrases.select("id", F.explode(F.split(F.lower("phrase"), " ")).alias("word"))
    known = words.where(s.dot(F.col("v"), F.col("v")) > 0)
    found = long.join(known, "word").select("id", F.posexplode("v").alias("pos", "x"))
    sums = found.groupBy("id", "pos").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("vector"), F.max("n").alias("token_count"))


def centroid(vectors: DataFrame) -> DataFrame:
    """One row: the mean of the mean vectors, and its norm."""
    mean = vectors.select(F.posexplode(F.transform("vector", lambda x: x / F.col("token_count"))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("x"))
    one = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("centroid"))
    return one.withColumn("centroid_norm", F.sqrt(s.dot(F.col("centroid"), F.col("centroid"))))


def scalars(vectors: DataFrame, center: DataFrame, *more: str) -> DataFrame:
    """id, centroid_dot, norm_sq, similarity (and the columns ``more``): all that later steps need of the vectors."""
    own = vectors.crossJoin(F.broadcast(center))
    dots = s.dot(F.col("vector"), F.col("centroid")).alias("centroid_dot"), s.dot(F.col("vector"), F.col("vector")).alias("norm_sq")
    return own.select("id", *more, *dots, s.cosine(F.col("vector"), F.col("centroid")).alias("similarity"))


def mean_cross_similarity(a: DataFrame, b: DataFrame, seed: int = 42, most: int = 3000) -> DataFrame:
    """Mean cosine of up to ``most`` seeded pairs of two numbered pools (n from 0, vector): two equi joins on the picks."""
    sizes = a.agg(F.count(F.lit(1)).alias("na")).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    picks = a.sparkSession.range(most).crossJoin(F.broadcast(sizes)).where("id < na * nb")
    picks = picks.select(F.floor(s.uniform(F.lit(seed), "cross", F.col("id"), "a") * F.col("na")).alias("i"), F.floor(s.uniform(F.lit(seed), "cross", F.col("id"), "b") * F.col("nb")).alias("j"))
    pairs = picks.join(a.select(F.col("n").alias("i"), F.col("vector").alias("x")), "i").join(b.select(F.col("n").alias("j"), F.col("vector").alias("y")), "j")
    return pairs.agg(F.coalesce(F.avg(s.cosine(F.col("x"), F.col("y"))), F.lit(0.0)).alias("mean_cosine"))


def quantile(df: DataFrame, value: str, share: float) -> DataFrame:
    """One row, ``quantile``: the value at this share of the order, between its two neighbours in proportion; null without values.

    Rows are cut into ranges of the order (equal values too), the ranges' counts say which range holds the two ranks, and only that range is ordered.
    """
    own = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x")).withColumn("_row", F.monotonically_increasing_id())
    own = in_ranges(own, [F.col("x"), F.col("_row")])
    per = own.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    to = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("_range"))
    per = per.withColumns({"before": to - F.col("n"), "total": F.sum("n").over(W.partitionBy(F.lit(0)))})
    at = F.lit(share) * (F.col("total") - 1)
    per = per.withColumns({"lo": F.floor(at), "hi": F.ceil(at), "part": at - F.floor(at)})
    per = per.where((F.col("lo") < F.col("before") + F.col("n")) & (F.col("hi") >= F.col("before")))
    rank = F.row_number().over(W.partitionBy("_range").orderBy("x", "_row")) + F.col("before") - 1
    found = own.join(F.broadcast(per), "_range").withColumn("rank", rank).where("rank in (lo, hi)")
    low, high = F.max(F.when(F.col("rank") == F.col("lo"), F.col("x"))), F.max(F.when(F.col("rank") == F.col("hi"), F.col("x")))
    return found.agg((low + (high - low) * F.max("part")).alias("quantile"))


def baseline(similarities: DataFrame) -> DataFrame:
    """mean, std, least and p10 of the similarities."""
    x = F.col("similarity")
    whole = similarities.agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("least"))
    return whole.crossJoin(F.broadcast(quantile(similarities, "similarity", 0.1).withColumnRenamed("quantile", "p10")))
