"""The continuous jobs: alerts, ratings ingestion, live counters.

Event times must be timestamps with a zone (cast TIMESTAMP_NTZ first). Watermarks bound the state; trigger with
``availableNow`` to drain or ``processingTime`` to run on.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.operators import feedback, telemetry
from phrasemill.sources.keyed import KeyedTable

LATE, RATING_KEYS = "10 minutes", "2 days"
WIDTHS = {"failure": timedelta(minutes=5), "error": timedelta(minutes=15), "browser": timedelta(minutes=15)}
#: Keyed state with timers needs this store.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def alert_windows(log: DataFrame, kind: str, late: str = LATE) -> DataFrame:
    """kind, window, n, names, code of the windows with failures (5 minutes), errors or browser exceptions (15 minutes), each once, when the
    watermark has passed its end; rows that are later than that are dropped.

    All requests move the watermark, so a window closes though nothing fails after it: they are counted if they match, not filtered before. A
    window's state is its counts and its set of names.
    """
    match, width = telemetry.counts_for(kind), WIDTHS[kind]
    name = F.when(match, F.substring("name", 1, 200))
    counted = log.withWatermark("timestamp", late).groupBy(F.window("timestamp", f"{int(width.total_seconds())} seconds"))
    out = counted.agg(F.count_if(match).alias("n"), F.collect_set(name).alias("set"), F.min(F.when(match, F.col("severity_level"))).alias("code")).where("n > 0")
    return out.select(F.lit(kind).alias("kind"), "window", "n", telemetry.joined_names(F.col("set")).alias("names"), "code")


def checked_ratings(ratings: DataFrame, key: str = "row_key", late: str = RATING_KEYS) -> DataFrame:
    """Adds ``error`` (null for a good rating) and drops repeated keys within the watermark."""
    error = feedback.rating_error(F.col("subtitle"), F.col("thumbs"), F.col("tone_override"), feedback.tags_of(F.col("tags")))
    return ratings.withColumn("error", error).withWatermark("created_at", late).dropDuplicatesWithinWatermark([key])


def ingest_ratings(ratings: DataFrame, good: str, rejected: str, checkpoint: str):
    """Streams good and rejected ratings to their own tables; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.where("error is null").drop("error").write.mode("overwrite").parquet(f"{good}/batch={n}")
        batch.where("error is not null").write.mode("overwrite").parquet(f"{rejected}/batch={n}")
        batch.unpersist()

    return checked_ratings(ratings).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counters(ratings: DataFrame) -> DataFrame:
    """kind, value, n: by source, tone pair and tag, for update or complete mode."""
    row = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    both = F.col("system_tone").isNotNull() & F.col("tone_override").isNotNull()
    pair = F.when(both, F.array(row("tones", F.concat_ws("->", "system_tone", "tone_override")))).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    source = F.array(row("source", F.coalesce("source", F.lit("unknown"))))
    rows = F.concat(source, pair, F.transform(feedback.tags_of(F.col("tags")), lambda x: row("tag", x)))
    return ratings.select(F.explode(rows).alias("r")).groupBy("r.kind", "r.value").agg(F.count(F.lit(1)).alias("n"))


def counted_into(ratings: DataFrame, table: KeyedTable, checkpoint: str):
    """The live counters, kept in a keyed table: each batch puts the counters that it has changed; a batch that is run again changes nothing."""

    def put(batch: DataFrame, n: int) -> None:
        table.upsert(batch, n)

    return live_counters(ratings).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, "kind string, value string, n long", ("kind", "value"), "n")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream to the end of its input; what it puts out in append mode goes to files at ``path``, which are returned.

    The state of alerts is small, a row for each open window, and each of its partitions is a store that every batch commits: it has as many as there are
    cores, not as many as a shuffle has.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(before), spark.sparkContext.defaultParallelism))
    try:
        query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def file_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """``files`` are read at a time, in the order of their landing."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
