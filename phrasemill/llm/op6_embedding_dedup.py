"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them, one vector of a group kept.

Equal vectors are one row with a count before anything else. Centroids are fitted on a bounded sample by Lloyd steps
on the sphere. How many, from one cell for about ``CELL_ROWS`` vectors (``MOST_CELLS`` at most) down to a single one, is what by held-out rows of the
sample costs least: vectors that fill all dimensions are near most planes and would be copied to most cells. A vector has a home cell, and is a guest of each further cell from whose bisecting plane it lies at most d / 2
away, d = sqrt(2 - 2 t): two vectors on either side of a plane and at most d apart can't both be farther from it, so every
pair at the threshold meets in the home of one of them, whatever the data. It is counted where the vector nearer to the plane is
the guest. Rows travel packed, and what a task holds of them is bounded, however many cells a row goes to. The rows at home in a cell and its
guests are cut into blocks of ``BLOCK_BYTES`` at most, and each block of rows at home meets the later ones and the guests' in a task of its own. Products are taken in single precision with a slack and those near the threshold again in double.
Tasks return sums of links per vector and a forest of links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.components import components
from phrasemill.llm.op10_ngram_join import Forest
from phrasemill.llm.shared import materialise

THRESHOLD, CELL_ROWS, BLOCK_BYTES, SAMPLE_ROWS, MOST_CELLS, STEPS, ROUNDING, SLACK, PACKET_BYTES, SAMPLE_BYTES = 0.9, 1500, 12 << 20, 20_000, 16_384, 8, 1e-9, 1e-3, 1 << 16, 128 << 20
#: Rows of the sample that tell the cost of cells; distances and packed bytes that a task holds at a time; nanoseconds to move a byte, to compare two rows, and for each dimension of these.
HELD_OUT, DISTANCES, OUT_BYTES, MOVE_NS, PAIR_NS, DIM_NS = 2000, 1 << 21, 4 << 20, 20.0, 1.5, 0.07
PACKET = "ids binary, copies binary, homes binary, v binary"
_COLUMNS = ["ids", "copies", "homes", "v"]


def spherical_kmeans(x: np.ndarray, k: int, steps: int = STEPS, seed: int = 7) -> np.ndarray:
    """k unit centroids of the unit rows of x; an emptied cell takes the row that fits its centroid worst."""
    rng = np.random.default_rng(seed)
    c, rows = x[rng.choice(len(x), k, replace=False)], max(16, (1 << 22) // k)  # products of 32 MB at a time
    for _ in range(steps):
        near = np.concatenate([(x[i : i + rows] @ c.T).argmax(1) for i in range(0, len(x), rows)])
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1)
        fit = np.einsum("ij,ij->i", x, c[near])
        for cell in np.flatnonzero(norm < 1e-12):
            worst = int(fit.argmin())
            sums[cell], norm[cell], fit[worst] = x[worst], 1.0, 2.0
        c = sums / norm[:, None]
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _loaded(column, kind: str, dim: int) -> np.ndarray:
    """The unit vectors of a binary column, one or many to a value."""
    return _unit(np.concatenate([np.frombuffer(v, kind) for v in column.to_pylist()]).reshape(-1, dim).astype(np.float64))


def _pack(kind: str):
    """Numbers as bytes; null for vectors that are null, zero, or not finite throughout."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.fill_null(pc.list_value_length(b.column("v")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = pc.fill_null(b.column("v").flatten(), math.nan).to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)
            row, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
            bad = np.bincount(row, ~np.isfinite(x), len(size)) + (np.bincount(row, x != 0, len(size)) == 0) > 0
            offsets = np.concatenate([[0], ends]) * x.itemsize
            v = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(x)])
            v = pc.if_else(pa.array(bad), pa.scalar(None, pa.large_binary()), v).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), v], ["vec_id", "v"])

    return job


def guests(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """The home of each unit row, and (rows, cells) whether the row is placed in the cell."""
    dot = x @ c.T
    home = dot.argmax(1)
    gap = np.sqrt(np.maximum(0.0, 2 - 2 * (c[home] @ c.T)))
    placed = dot.max(1)[:, None] - dot <= margin * gap + ROUNDING
    placed[np.arange(len(home)), home] = True
    return home, placed


def centroids(x: np.ndarray, n: int, most: int, margin: float, row_bytes: int, block_bytes: int) -> np.ndarray:
    """Of the unit sample x of n rows: centroids of the cells, ``most`` at most, that cost least to compare and to move, by rows that they weren't fitted on."""
    test, fit = np.split(x, [min(HELD_OUT, len(x) // 5)])
    best, k = None, min(most, len(fit))
    while k > 1 and len(test):
        c = spherical_kmeans(fit, k)
        home, placed = zip(*(guests(test[i : i + max(1, DISTANCES // k)], c, margin) for i in range(0, len(test), max(1, DISTANCES // k))))
        home, placed = np.concatenate(home), np.concatenate(placed)
        at_home = np.bincount(home, minlength=k) * n / len(test)
        visit = placed.sum(0) * n / len(test) - at_home
        blocks, more = np.ceil(at_home * row_bytes / block_bytes), np.ceil(visit * row_bytes / block_bytes)
        pairs, copies = (at_home * (at_home / 2 + visit)).sum(), (at_home * (blocks + more) + visit * (1 + blocks)).sum()
        cost = pairs * (PAIR_NS + DIM_NS * x.shape[1]) + copies * row_bytes * MOVE_NS
        if best is None or cost < best[0]:
            best = (cost, c)
        k = max(1, k // 4)
    one = n * n / 2 * (PAIR_NS + DIM_NS * x.shape[1]) + n * math.ceil(n * row_bytes / block_bytes) * row_bytes * MOVE_NS
    return spherical_kmeans(x, 1) if best is None or one <= best[0] else best[1]


def _packets(raw: np.ndarray, ids: np.ndarray, copies: np.ndarray, home: np.ndarray, row: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows placed in cells as packets of PACKET_BYTES at most, in batches of about OUT_BYTES."""
    key = 2 * cell + (home[row] != cell)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    most = max(1, PACKET_BYTES // raw[0].nbytes)
    cut = np.concatenate([np.arange(a, z, most) for a, z in zip(first, np.append(first[1:], len(row)))])
    ends = np.append(cut[1:], len(row))
    at = 0
    while at < len(cut):
        upto = max(at + 1, int(np.searchsorted(ends, cut[at] + OUT_BYTES // raw[0].nbytes, "right")))
        rows = [row[a:z] for a, z in zip(cut[at:upto], ends[at:upto])]
        keys = key[cut[at:upto]]
        cols = [pa.array([x[r].tobytes() for r in rows], pa.binary()) for x in (ids, copies, home, raw)]
        yield pa.RecordBatch.from_arrays([pa.array(keys // 2), pa.array(keys % 2 == 1), *cols], ["cell", "guest", *_COLUMNS])
        at = upto


def _place(shared, margin: float, kind: str):
    """Packets for each cell, of the rows at home there and others of the guests."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        step = max(16, DISTANCES // len(c))  # distances to all centroids of so many rows at a time: 16 MB
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                raw = np.stack([np.frombuffer(v, kind) for v in part.column("v").to_pylist()])
                ids, copies = part.column("vec_id").to_numpy(zero_copy_only=False), part.column("copies").to_numpy(zero_copy_only=False)
                home, placed = guests(_unit(raw.astype(np.float64)), c, margin)
                yield from _packets(raw, ids, copies, home.astype(np.int32), *np.nonzero(placed))

    return job


def _here(x, y, ids_x, ids_y, home_x, home_y, c) -> np.ndarray:
    """Of links of rows at home (x) with guests (y): whether the guest is the nearer to the plane between the homes, so that
    the link counts here and not in the guest's home. Both tasks take the same sums, to the last bit."""
    lo, hi = np.minimum(home_x, home_y), np.maximum(home_x, home_y)
    normal = c[lo] - c[hi]
    far_x, far_y = np.abs((normal * x).sum(1)), np.abs((normal * y).sum(1))
    return (far_y < far_x) | ((far_y == far_x) & (ids_y < ids_x))


def _compare(shared, threshold: float, kind: str, dim: int):
    """Links of a cell's left block (rows at home) with its right block (rows at home of this or a later block, and guests)."""

    def job(t: pa.Table) -> pa.Table:
        c = shared.value
        sizes = np.array([len(v) // 8 for v in t.column("ids").to_pylist()])
        load = lambda name, kind: np.concatenate([np.frombuffer(v, kind) for v in t.column(name).to_pylist()])
        ids, copies, home, x = load("ids", np.int64), load("copies", np.int64), load("homes", np.int32), _loaded(t.column("v"), kind, dim)
        side = np.repeat(np.array(t.column("side").to_pylist()), sizes)
        left, right = np.flatnonzero((side == "l") | (side == "b")), np.flatnonzero(side != "l")
        twice = side == "b"
        low, right_low = x.astype(np.float32), x[right].astype(np.float32).T
        extra, forest, tree, a, b = np.zeros(len(ids), np.int64), Forest(len(ids)), np.arange(len(ids)), [], []
        for start in range(0, len(left), 256):
            own = left[start : start + 256]
            near = np.flatnonzero(np.ravel(low[own] @ right_low) >= threshold - SLACK)
            for at in range(0, len(near), 1 << 16):
                i, j = np.divmod(near[at : at + (1 << 16)], len(right))
                i, j = own[i], right[j]
                keep = ~(twice[j] & (i >= j)) & (np.einsum("ij,ij->i", x[i], x[j]) >= threshold)
                i, j = i[keep], j[keep]
                other = np.flatnonzero(home[i] != home[j])
                keep = np.ones(len(i), bool)
                p, q = i[other], j[other]
                keep[other] = _here(x[p], x[q], ids[p], ids[q], home[p], home[q], c)
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                extra += np.bincount(i, copies[j], len(ids)).astype(np.int64) + np.bincount(j, copies[i], len(ids)).astype(np.int64)
                p, q = tree[i], tree[j]  # only links between different trees go on, each pair of trees once
                for key in np.unique((np.minimum(p, q) * len(ids) + np.maximum(p, q))[p != q]).tolist():
                    p, q = divmod(key, len(ids))
                    if forest.join(p, q):
                        a.append(int(ids[p])), b.append(int(ids[q]))
                tree = np.array(forest.up)
                while (tree[tree] != tree).any():
                    tree = tree[tree]
        some = np.flatnonzero(extra)
        n = len(some)
        return pa.table({"id": pa.array(np.append(ids[some], a).astype(np.int64)), "links": pa.array(np.append(extra[some], np.zeros(len(a))).astype(np.int64)), "b": pa.array([None] * n + b, pa.int64())})

    return job


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """-> vec_id, n_links, component_id, kept: one row per input row.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows without an id,
    which are kept and have no component. Equal vectors always link. Vectors of the most frequent length (of equally frequent
    ones the longest) are compared; the others link with equal ones only. Rows that repeat an id with other vectors are one
    node of the links: they share the component, and the links of all of them are summed. An empty table gives an empty
    result; other columns are ignored.
    """
    spark = vectors.sparkSession
    number, kind = ("float", "f4") if vectors.select(vector_col).dtypes[0][1] == "array<float>" else ("double", "f8")
    rows = materialise(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(F.col(id_col).isNotNull(), F.col(vector_col).cast(f"array<{number}>")).alias("v")).mapInArrow(_pack(kind), "vec_id long, v binary"), "vectors")
    own = materialise(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies")), "distinct")
    most = own.groupBy(F.octet_length("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is not None:
        n, dim, kept = most["count"], most["size"] // np.dtype(kind).itemsize, own.where(F.octet_length("v") == most["size"])
        row_bytes = most["size"] + 20  # with id, count and home
        side = math.ceil(math.sqrt(12 * spark.sparkContext.defaultParallelism))  # so many blocks at least: six tasks for each core
        block_bytes = min(BLOCK_BYTES, max(PACKET_BYTES, n * row_bytes // side))
        k = min(MOST_CELLS, max(1, round(n / CELL_ROWS)), max(1, SAMPLE_BYTES // most["size"] // 4))
        rows_of = min(max(SAMPLE_ROWS, 4 * k), SAMPLE_BYTES // most["size"])  # bounded by bytes too: what the driver holds
        sample = kept.orderBy(F.xxhash64("v"), "vec_id").limit(max(1, rows_of)).select("v").toPandas()["v"]
        x = _unit(np.array([np.frombuffer(v, kind) for v in sample], np.float64))
        margin = math.sqrt(2 - 2 * threshold) / 2
        shared = spark.sparkContext.broadcast(centroids(x, n, k, margin, row_bytes, block_bytes))  # MOST_CELLS rows at most
        placed = materialise(kept.select("vec_id", "copies", "v").mapInArrow(_place(shared, margin, kind), f"cell long, guest boolean, {PACKET}"), "placed")
        of = lambda here: F.ceil(F.coalesce(F.sum(F.when(here, F.length("v"))), F.lit(0)) / block_bytes)
        blocks = placed.groupBy("cell").agg(of(~F.col("guest")).alias("own"), of(F.col("guest")).alias("more"))  # a row per cell
        # rows at home are the first blocks of a cell, guests the others
        block = F.when(F.col("guest"), F.col("own") + F.pmod(F.xxhash64("ids"), F.col("more"))).otherwise(F.pmod(F.xxhash64("ids"), F.col("own")))
        at = placed.join(F.broadcast(blocks), "cell").where("own > 0").withColumn("block", block)
        # a block of rows at home stands on the left of its pairs with itself and the later ones, guests among them; each later one on the right
        upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<bigint>"))
        right = F.transform(upto(F.when(F.col("guest"), F.col("own")).otherwise(F.col("block") + 1)), lambda o: F.struct(o.alias("x"), F.col("block").alias("y"), F.when(o == F.col("block"), "b").otherwise("r").alias("side")))
        left = F.transform(F.filter(upto(F.when(F.col("guest"), 0).otherwise(F.col("own") + F.col("more"))), lambda o: o > F.col("block")), lambda o: F.struct(F.col("block").alias("x"), o.alias("y"), F.lit("l").alias("side")))
        pairs = at.select("cell", *_COLUMNS, F.explode(F.concat(right, left)).alias("p")).select("cell", "p.*", *_COLUMNS)
        found = materialise(pairs.groupBy("cell", "x", "y").applyInArrow(_compare(shared, threshold, kind, dim), "id long, links long, b long"), "links")
        near = found.where("b is null").groupBy("id").agg(F.sum("links").alias("links"))
        linked = components(found.where("b is not null").select(F.col("id").alias("a"), "b"))
        own = own.join(near, own.vec_id == near.id, "left").drop("id").join(linked, own.vec_id == linked.id, "left").select("v", F.coalesce("component", "vec_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        out = rows.where("v is not null").join(own, "v").select("vec_id", "n_links", "component_id")
    else:
        out = rows.where("v is not null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.unionByName(rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
