"""From raw documents to packed sequences, stage by stage; each stage's rows are written and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.llm.op1_exact_dedup import exact_dedup
from phrasemill.llm.op3_pii import redact
from phrasemill.llm.op4_quality import fit, score
from phrasemill.llm.op7_best_fit_packing import best_fit_packing
from phrasemill.llm.op10_ngram_join import ngram_join
from phrasemill.llm.shared import materialise, ship, table, tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Rows up to so many are sent to all tasks instead of dealing out all texts by row.
BROADCAST_ROWS = 1_000_000


def keyed(docs: DataFrame) -> DataFrame:
    """The documents with a number for each row, written with them: rows may repeat an id or lack one, decisions are about rows."""
    return materialise(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed", compression="zstd")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents but for the dropped rows, without their numbers."""
    dropped = materialise(dropped.select("row"), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, "row", "left_anti").select(COLUMNS)


def rank():
    """Which row of a group stays: the smallest id, rows without an id last, then the first row."""
    return F.struct(F.col("doc_id").isNull().alias("lacks"), F.col("doc_id").alias("id"), F.col("row").alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    ship(spark)
    docs = docs.select(COLUMNS)
    return score(docs, fit(docs, table(spark, sf_dir, "labels"))).where("score >= 0.5").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: that with the smallest id, of rows that repeat it the first."""
    ship(spark)
    docs = keyed(docs)
    found = exact_dedup(docs.select(rank().alias("rank"), "text"), "rank")
    return without(docs, found.where("not kept").select("doc_id.row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest id, of rows that repeat it the first."""
    ship(spark)
    docs = keyed(docs)
    found = ngram_join(docs.select("row", "text"), "row")
    groups = materialise(found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")), "groups")
    ranked = groups.join(docs.select("row", "doc_id"), "row").select("component", rank().alias("rank"))
    stays = ranked.groupBy("component").agg(F.min("rank").alias("first")).select("first.row")  # one row for each group, alone or not
    return without(docs, groups.select("row").join(stays, "row", "left_anti"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data and secrets replaced by their kind; null texts become empty."""
    ship(spark)
    return redact(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence of at most 2048 tokens."""
    ship(spark)
    return best_fit_packing(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", redact_personal_data),
    ("best-fit packing", pack),
]

#: The stages train models and pack, which SQL doesn't express; ``tests/llm`` holds them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
