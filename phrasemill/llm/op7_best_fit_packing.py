"""Best-fit packing with certified bounds.

Documents become pieces of at most ``room`` tokens. Every partition packs its pieces best-fit decreasing and states a
lower bound of its bins from dual feasible functions. A partition that meets its bound is certified and gives up its
emptiest bin only; the others give up all their bins with gaps. These pieces are dealt into fewer partitions, of
``PARTITION_PIECES`` on average at most, and packed again, until one partition is left, nothing is given up, or a round saves nothing.
``certificate`` states the bins of a result, the lower bound of all its pieces together, and so how far it can be from the best.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.pretokens import encode_rows
from phrasemill.llm.shared import materialise, parts
from phrasemill.llm.textbytes import slices

ROOM, ROUNDS, PARTITION_PIECES = 2048, 32, 100_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECE + ", sequence_id long, offset long, gap boolean, bound long, bins long"


def _pieces(path: str, room: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for lo, _, data, offsets in slices(batch.column("text")):
                ids, at = encode_rows(path, data, offsets)
                rows = []
                for r, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist())):
                    own = np.append(ids[a:b], np.uint32(0)).astype("<u4")
                    cuts = [0, *range((len(own) - 1) % room + 1, len(own) + 1, room)]
                    rows += [(doc_ids[lo + r], k, x, y - x, zlib.crc32(own[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return job


def lower_bound(counts: np.ndarray, room: int) -> int:
    """Bins that pieces need, counts[s] of size s: the best of two families of dual feasible functions, in integers.

    Thresholds e <= room / 2 take large pieces (> room - e) as whole bins and drop those below e; the steps k map s to
    s where (k + 1) s is a multiple of room, else to floor((k + 1) s / room) room / k.
    """
    s = np.arange(len(counts), dtype=np.int64)
    weight = counts * s
    below = np.concatenate([[0], np.cumsum(weight)])
    number = np.concatenate([[0], np.cumsum(counts)])
    e = np.arange(0, room // 2 + 1)
    whole = number[-1] - number[np.minimum(room - e + 1, len(counts))]
    between = below[np.minimum(room - e + 1, len(counts))] - below[e]
    best = int((whole - (-between // room)).max())
    for k in range(1, 41):
        exact = (k + 1) * s % room == 0
        mapped = np.where(exact, s * k, (k + 1) * s // room * room)  # times k
        best = max(best, -int(-(counts * mapped).sum() // (room * k)))
    return best


def best_fit_decreasing(size: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin. Ties by the order given."""
    bin_of, offset, fill = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), []
    open_bins: dict[int, list[int]] = {}
    gaps: list[int] = []
    for i in np.argsort(-size, kind="stable").tolist():
        s = int(size[i])
        k = bisect_left(gaps, s)
        if k < len(gaps):
            gap = gaps[k]
            b = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(k)
        else:
            gap, b = room, len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += s
        if rest := gap - s:
            if rest not in open_bins:
                open_bins[rest] = []
                insort(gaps, rest)
            open_bins[rest].append(b)
    return bin_of, offset, np.array(fill, np.int64)


def _pack(room: int, turn: int):
    def job(t: pa.Table) -> pa.Table:
        own = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        size = own.column("length").to_numpy()
        b, offset, fill = best_fit_decreasing(size, room)
        bound = lower_bound(np.bincount(size, minlength=room + 1), room)
        n = len(size)
        cols = [own.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        seq = (turn << 58) | (own.column("task")[0].as_py() << 26)
        return pa.table([*cols, pa.array(seq + b), pa.array(offset), pa.array((fill[b] < room) & ((len(fill) > bound) | (b == fill.argmin()))), pa.array(np.full(n, bound)), pa.array(np.full(n, len(fill)))], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap", "bound", "bins"])

    return job


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """-> doc_id, piece, start, length, ids_crc32: ids and a closing 0, cut from the end into full pieces if longer than ``room``."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_pieces(tokenizer_path, room), PIECE)


def best_fit_packing(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """-> doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece.

    Null and empty texts are the single token 0. Ids are passed on: rows without one or with one that repeats are packed as rows of
    their own. Very long texts are encoded in parts. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    all_pieces = materialise(pieces(docs, tokenizer_path, id_col, text_col, room), "pieces")
    n = all_pieces.count()
    left, tasks, kept, open_before = all_pieces, max(1, math.ceil(n / PARTITION_PIECES), min(parts(spark), n // 2000)), [], None
    for turn in range(ROUNDS):
        dealt = left.withColumn("task", F.pmod(F.xxhash64("doc_id", "piece", F.lit(turn)), F.lit(tasks)))
        placed = materialise(dealt.groupBy("task").applyInArrow(_pack(room, turn), PLACED), "packed")
        bins, open_bins, open_pieces = placed.agg(F.count_distinct("sequence_id"), F.count_distinct(F.when(F.col("gap"), F.col("sequence_id"))), F.count_if("gap")).first()
        if open_before is not None and bins >= open_before[0]:
            kept.append(open_before[1])
            break
        if not open_bins or tasks == 1 or turn == ROUNDS - 1:
            kept.append(placed)
            break
        kept.append(placed.where("not gap"))
        open_before = (open_bins, placed.where("gap"))
        left, tasks = open_before[1].select(all_pieces.columns), max(1, tasks // 8, math.ceil(open_pieces / PARTITION_PIECES))
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def certificate(packed: DataFrame, room: int = ROOM) -> DataFrame:
    """One row: pieces, tokens, bins, the certified lower bound of the bins that these pieces need, and the gap between the two.

    The bound takes how many pieces there are of each length: ``room`` rows at most.
    """
    sizes = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = np.zeros(room + 1, np.int64)
    for r in sizes:
        counts[r["length"]] = r["n"]
    bound = lower_bound(counts, room) if sizes else 0
    out = packed.agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.count_distinct("sequence_id").alias("bins"))
    return out.withColumn("bound", F.lit(bound).cast("long")).withColumn("gap", F.col("bins") - F.col("bound"))
