"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters deal the normalised bytes out by range: the range key is the leading bytes and a fingerprint,
so that splitters stay small and a common opening does not gather in one task. Each partition is sorted
externally by range key and whole text; equal texts are then neighbours, compared in full by the window, and
the smallest id of a run stays (a minimum over the run, whatever its order). Texts with a fingerprint that fills about a partition or more (one row in ``HOT_SHARE``, or in
as many as there are partitions, carries it, so there are at most that many of them) are first dealt into salted runs of half
a partition, ``SALTS`` at least, whose heads, already the results of full comparisons, are merged afterwards by the SHA-256 of their texts.

Null text counts as empty. Repeated ids count as separate rows with the same keep_id, all kept if the id is the smallest. Null ids
come after all others: such a row stays only where no equal text has an id. An empty table gives an empty result. Other
columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.llm.shared import materialise, parts

LEAD_BYTES, HOT_SHARE, HOT_ROWS, SALTS = 48, 1000, 500, 64


def normalised(text: str = "text"):
    """Null as empty; each run of space, tab and line ends is one space. Most texts hold line feeds alone, which a plain replacement
    takes faster than a pattern, and few hold runs."""
    t = F.coalesce(F.col(text), F.lit(""))
    spaced = F.when(t.rlike("[\\x09\\x0B-\\x0D]"), F.regexp_replace(t, "[\\x09-\\x0D]", " ")).otherwise(F.replace(t, F.lit("\n"), F.lit(" ")))
    return F.when(F.contains(spaced, F.lit("  ")), F.regexp_replace(spaced, " {2,}", " ")).otherwise(spaced)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, keep_id, group_size, kept, text_sha256: one row per input row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("norm")).withColumn("print", F.xxhash64("norm"))
    counts = rows.groupBy("print").agg(F.count(F.lit(1)).alias("n"))
    total, tasks = docs.count(), parts(docs.sparkSession)
    share = max(HOT_SHARE, tasks)  # a bound of the rows of hot and merged, which are broadcast
    hot = counts.where((F.col("n") >= HOT_ROWS) & (F.col("n") * share >= total)).select("print", F.greatest(F.lit(SALTS), F.ceil(F.col("n") * (2 * tasks) / total)).alias("salts"))
    salted = rows.join(F.broadcast(hot), "print", "left").withColumn("salt", F.coalesce(1 + F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0)))
    dealt = salted.select("doc_id", "norm", "print", "salt", F.substring("norm", 1, LEAD_BYTES).alias("lead")).repartitionByRange(tasks, "lead", "print", "salt")
    run = W.partitionBy("lead", "print", "salt", "norm")
    runs = dealt.withColumns({"head": F.min("doc_id").over(run), "n": F.count(F.lit(1)).over(run)})
    runs = materialise(runs.select("doc_id", "salt", "head", "n", F.sha2("norm", 256).alias("text_sha256")), "runs")
    heads = runs.where("salt > 0").groupBy("text_sha256", "salt", "head").agg(F.max("n").alias("n"))
    merged = heads.groupBy("text_sha256").agg(F.min("head").alias("all_head"), F.sum("n").alias("all_n"))  # share rows at most
    whole = runs.join(F.broadcast(merged), "text_sha256", "left").withColumns({"keep_id": F.coalesce("all_head", "head"), "group_size": F.coalesce("all_n", "n")})
    return whole.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
