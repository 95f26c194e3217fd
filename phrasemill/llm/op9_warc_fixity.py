"""Merkle fixity audit of WARC replicas.

Pages become records of archive files. A replica is a table of records with the offsets that it holds them at itself: of a folder of
WARC files (``read_warc``), or of records and the replica's own index (``digests``). A leaf hashes a record's digest with its range; each inner
node hashes up to FANOUT ordered children with the range they span. Replicas are compared at the roots, and only below nodes
that differ are children read, level by level, down to the damaged, resized, moved, lost and stray records.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.llm.shared import materialise

FILE_BITS, FANOUT = 12, 16
#: Files with differences that a scan is told one by one.
FEW_FILES = 64
FILE_RECORDS = 1 << FILE_BITS
KEYS = ("file_no", "record_no", "page_id")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """-> file_no, record_no, page_id, payload: a record is a header and the body; null counts as empty. Nothing is shuffled.

    A file holds the ids of one range of FILE_RECORDS; a record's number is its id's place in the range, for negative and the largest
    ids too. A page without an id has no address and makes no record; rows that repeat an id share a leaf in ``manifest``.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(url_col, F.lit("")).alias("url"), F.coalesce(body_col, F.lit("")).alias("body")).where("page_id is not null")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(">\r\nWARC-Target-URI: "), F.col("url"), F.lit("\r\nContent-Length: "), F.octet_length("body"), F.lit("\r\n\r\n"))
    return own.select(F.shiftright("page_id", FILE_BITS).alias("file_no"), F.col("page_id").bitwiseAND(F.lit(FILE_RECORDS - 1)).alias("record_no"), "page_id", F.concat(head, F.col("body"), F.lit("\r\n\r\n")).alias("payload"))


def write_warc(written: DataFrame, path: str) -> None:
    """A folder of WARC files, one for each file number, records in order; the line end of the writer closes the record."""
    body = F.expr("left(payload, length(payload) - 4)").alias("value")
    dealt = written.repartition("file_no").sortWithinPartitions("file_no", "record_no").select("file_no", body)
    dealt.write.option("lineSep", "\r\n\r\n").partitionBy("file_no").text(path)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of whole files, by the length that each header states; what can't be parsed ends a file."""
    for batch in batches:
        for file_no, content in zip(batch.column("file_no").to_pylist(), batch.column("content").to_pylist()):
            rows, at = [], 0
            while (split := content.find(b"\r\n\r\n", at)) >= 0:
                length, page = (re.search(rb"\r\n" + p, content[at : split + 2]) for p in (rb"Content-Length: ([0-9]+)\r\n", rb"WARC-Record-ID: <urn:page:(-?[0-9]+)>\r\n"))
                if not length or not page:
                    break
                end, page_id = split + 8 + int(length[1]), int(page[1])
                rows.append((file_no, page_id & (FILE_RECORDS - 1), page_id, at, content[at:end].decode(errors="replace")))
                at = end
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in list(zip(*rows))[:4]), pa.array([r[4] for r in rows])], ["file_no", "record_no", "page_id", "start", "payload"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """-> file_no, record_no, page_id, start, payload of a folder of WARC files; a file of FILE_RECORDS is one task's read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("file_no").cast("long").alias("file_no"), "content")
    return files.mapInArrow(_parsed, "file_no long, record_no long, page_id long, start long, payload string")


def _hashed(replica: DataFrame) -> DataFrame:
    """A narrow row for each record: payloads are hashed where they are read. Rows with one id make one leaf of all their digests, in order."""
    start = F.col("start") if "start" in replica.columns else F.lit(None)
    own = replica.select(*KEYS, start.cast("long").alias("start"), F.sha2("payload", 256).alias("sha"), F.octet_length("payload").cast("long").alias("length"))
    all_of = own.groupBy(*KEYS).agg(F.array_sort(F.collect_list("sha")).alias("shas"), F.sum("length").alias("length"), F.min("start").alias("start"))
    return all_of.select(*KEYS, "start", "length", F.when(F.size("shas") == 1, F.col("shas")[0]).otherwise(F.sha2(F.array_join("shas", ","), 256)).alias("sha"))


def manifest(written: DataFrame) -> DataFrame:
    """-> file_no, record_no, page_id, start, length, sha of the records as written one after the other; a file's window is bounded by
    FILE_RECORDS."""
    start = F.sum("length").over(W.partitionBy("file_no").orderBy("record_no")) - F.col("length")
    return materialise(_hashed(written).withColumn("start", start), "manifest")


def digests(replica: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """The same of the records that a replica holds, hashed from its own bytes, at its own offsets: those of its ``index`` (file_no,
    record_no, page_id, start), or without one its column ``start``. A record that the index doesn't have has no start."""
    held = _hashed(replica)
    if index is not None:
        held = held.drop("start").join(index.select(*KEYS, "start"), list(KEYS), "left")
    return materialise(held.select(*KEYS, "start", "length", "sha"), "digests")


def _level(nodes: DataFrame, name: str) -> DataFrame:
    """A level written in the order of files and nodes, so that a read of a few branches skips the rest by the files' and row groups' ranges."""
    return materialise(nodes.repartitionByRange("file_no", "node").sortWithinPartitions("file_no", "node"), name)


def _below(bad: DataFrame):
    """What the scan of the next level is told of the branches that differ: the file and the nodes of each while these are few files, else the range
    of the files. The semi join decides, this only skips."""
    lo, hi = F.min("node").alias("lo"), F.max("node").alias("hi")
    few = bad.groupBy("file_no").agg(lo, hi).limit(FEW_FILES + 1).collect()
    if len(few) <= FEW_FILES:
        return reduce(operator.or_, ((F.col("file_no") == r.file_no) & F.col("node").between(r.lo * FANOUT, r.hi * FANOUT + FANOUT - 1) for r in few))
    return F.col("file_no").between(*bad.agg(F.min("file_no"), F.max("file_no")).first())


def tree(leaves: DataFrame) -> list[DataFrame]:
    """Levels of (file_no, node, hash), leaves first, the root (node 0) last."""
    span = lambda *c: F.sha2(F.concat_ws(":", *(F.col(x).cast("string") for x in c)), 256)
    level = _level(leaves.select("file_no", F.col("record_no").alias("node"), "start", "length", span("start", "length", "sha").alias("hash")), "leaves")
    levels, size = [level], FILE_RECORDS
    while size > 1:
        size = -(-size // FANOUT)
        group = level.groupBy("file_no", F.floor(F.col("node") / FANOUT).alias("node")).agg(
            F.min("start").alias("start"), (F.max(F.col("start") + F.col("length")) - F.min("start")).alias("length"),
            F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("node", "hash"))), lambda x: x.getField("hash"))).alias("children"),
        )
        level = _level(group.select("file_no", "node", "start", "length", span("start", "length", "children").alias("hash")), "nodes")
        levels.append(level)
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves of two replicas -> file_no, record_no, page_id, start, length, right_start, left_sha, right_sha, found of the records that differ.

    ``found`` is damaged (other bytes), resized (other bytes and another length), moved (the same bytes at another offset), or missing_left,
    missing_right for a record that one replica lacks; ``start`` and ``length`` are the left one's where it has the record. Equal
    replicas and empty tables give an empty result, for which only the roots are read. Bodies of any length are hashed where they are read.
    """
    a, b = tree(left), tree(right)
    bad = None
    for x, y in zip(reversed(a), reversed(b)):
        x, y = x.select("file_no", "node", "hash"), y.select("file_no", "node", F.col("hash").alias("other"))
        if bad is not None:
            if bad.isEmpty():
                break
            parent, here = bad.select("file_no", F.col("node").alias("parent")), _below(bad)
            x, y = (t.where(here).withColumn("parent", F.floor(F.col("node") / FANOUT)).join(parent, ["file_no", "parent"], "left_semi").drop("parent") for t in (x, y))
        bad = materialise(x.join(y, ["file_no", "node"], "full").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file_no", "node"), "differ")
    spots = bad.withColumnRenamed("node", "record_no")
    keys = ["file_no", "record_no"]
    sides = [t.join(spots, keys, "left_semi").select(*keys, *(F.col(c).alias(f"{side}_{c}") for c in ("page_id", "start", "length", "sha"))) for side, t in (("left", left), ("right", right))]
    both = sides[0].join(sides[1], keys, "full")
    found = (
        F.when(F.col("left_sha").isNull(), "missing_left").when(F.col("right_sha").isNull(), "missing_right").when(F.col("left_sha") == F.col("right_sha"), "moved")
        .when(F.col("left_length") != F.col("right_length"), "resized").otherwise("damaged")
    )
    return both.select(*keys, *(F.coalesce(f"left_{c}", f"right_{c}").alias(c) for c in ("page_id", "start", "length")), "right_start", "left_sha", "right_sha", found.alias("found"))


def decayed(replica: DataFrame) -> DataFrame:
    """A replica after storage faults, chosen by the page: some records have a byte overwritten, some lost their end, others are gone."""
    hurt = F.concat(F.expr("left(payload, 20)"), F.lit("#"), F.expr("substring(payload, 22)"))
    cut = F.expr("left(payload, length(payload) - 3)")
    fault = _fault()
    return replica.where(fault != 7).withColumn("payload", F.when(fault.isin(3, 5), hurt).when(fault == 13, cut).otherwise(F.col("payload")))


def misplaced(index: DataFrame) -> DataFrame:
    """An index after faults: some records are held a byte further on."""
    return index.withColumn("start", F.col("start") + (_fault() == 11).cast("long"))


def _fault():
    return F.pmod(F.pmod("page_id", F.lit(101)) * 7919, F.lit(101))
