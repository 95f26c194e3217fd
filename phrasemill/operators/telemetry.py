"""Request logs: filters, windows, alert state, client metrics, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counts_for(kind: str, severity: int = 3) -> Column:
    """Whether a request counts for alerts of this kind: failure, error or browser."""
    tests = {"failure": ~F.col("success"), "error": F.col("severity_level") >= severity, "browser": F.col("client_type") == "Browser"}
    return F.coalesce(tests[kind], F.lit(False))


def failures(log: DataFrame) -> DataFrame:
    return log.where(counts_for("failure"))


def errors(log: DataFrame, severity: int = 3) -> DataFrame:
    return log.where(counts_for("error", severity))


def browser_exceptions(log: DataFrame) -> DataFrame:
    return log.where(counts_for("browser"))


def joined_names(names: Column, most: int = 10, between: str = ", ") -> Column:
    return F.array_join(F.slice(F.array_sort(names), 1, most), between)


def windowed(log: DataFrame, width: str, name: str = "name", code: str = "severity_level", between: str = ", ", most: int = 10) -> DataFrame:
    """window_start, n, names (the least ``most`` distinct), code (least): each name is counted first and the least names are kept by
    rank, however many there are."""
    short, w = F.substring(name, 1, 200), F.window("timestamp", width).alias("w")
    per = log.groupBy(w, short.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.min(code).alias("code"))
    rank = F.row_number().over(W.partitionBy("w").orderBy(F.asc_nulls_last("name")))
    out = per.withColumn("rank", rank).groupBy("w").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("rank") <= most, F.col("name"))).alias("set"), F.min("code").alias("code"))
    return out.select(F.col("w.start").alias("window_start"), "n", joined_names(F.col("set"), most, between).alias("names"), "code")


def alert_state(counts: DataFrame, width: str, periods: int = 3, least: int = 2, threshold: int = 0) -> DataFrame:
    """window_start, n, alert over a gapless series: at least ``least`` of the last ``periods`` windows above the threshold.

    The series has one row per period of the log's span, so the window over it grows with time, not with events.
    """
    spine = counts.agg(F.min("window_start").alias("a"), F.max("window_start").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b", F.expr(f"interval {width}"))).alias("window_start"))
    dense = spine.join(counts.select("window_start", "n"), "window_start", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    failing = F.sum((F.col("n") > threshold).cast("int")).over(W.partitionBy(F.lit(0)).orderBy("window_start").rowsBetween(1 - periods, 0))
    return dense.withColumn("alert", failing >= least)


def client_metrics(log: DataFrame) -> DataFrame:
    """Mean duration and counts by event and the property k's parity: success, errors, total."""
    k = F.get_json_object("props", "$.k").cast("int")
    return log.groupBy("name", (k % 2).alias("k_odd")).agg(F.avg("duration").alias("mean_duration"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("errors"), F.count(F.lit(1)).alias("total"))


def retained(log: DataFrame, days: int = 30) -> DataFrame:
    last = log.agg(F.max("timestamp").alias("last"))
    return log.crossJoin(F.broadcast(last)).where(F.col("timestamp") >= F.col("last") - F.expr(f"interval {days} days")).drop("last")
