"""Whitening of embeddings: leading eigenvectors of their covariance by the Jacobi-Davidson method, without forming the covariance.

Entries become large whole numbers x = floor(64 c) + 1,000,000, so products of uncentred values would lose the digits that matter: sums are whole numbers, and
every product is taken of (n x - S) / n. What the method needs of the data is V u for a few vectors u at a time, one pass over packed blocks of rows: each
task returns the sum of y (y u) of its rows, and Spark adds these by cell. The driver holds a subspace of a few vectors of one row's length.

A block of wanted pairs is worked on at once: Rayleigh-Ritz in the subspace, residuals, locking of the pairs that have reached double precision, and for the
others a correction equation, projected against all locked and current vectors and solved approximately by MINRES, every step of which is one pass for all of
them. The subspace is restarted from its best vectors when it is full.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.shared import materialise

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Bytes of a packed block; MINRES steps for a correction; vectors of the subspace at most, as a multiple of those wanted.
BLOCK_BYTES, INNER, SUBSPACE = 1 << 20, 6, 4
#: A pair is final when its residual is at most so many roundings of the largest eigenvalue; rounds of the outer loop at most.
ROUNDINGS, ROUNDS = 16, 200
_EPS = np.finfo(np.float64).eps


def _clean(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch remain, and their vectors as doubles, of ``dim`` columns: shorter ones end in zeros."""
    v = batch.column("v")
    size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(v.flatten(), np.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
    bad = np.bincount(row, ~np.isfinite(flat), len(size)) > 0
    good = (size >= 0) & ~bad
    out = np.zeros((len(size), dim))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    kept = good[row]
    out[row[kept], place[kept]] = flat[kept]
    return good, out[good]


def whole(c: np.ndarray) -> np.ndarray:
    """x of the entries; entries so large that x fits in no long (over 2**56) count as 2**56."""
    return np.floor(np.clip(c, -(2.0**56), 2.0**56) * SCALE).astype(np.int64) + OFFSET


def _sums(x: np.ndarray) -> np.ndarray:
    return x.sum(0) if int(np.abs(x).max(initial=0)) * max(1, len(x)) < 1 << 62 else x.astype(object).sum(0)


def _packed(dim: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(1, BLOCK_BYTES // (8 * max(1, dim)))
        for b in batches:
            x = whole(_clean(b, dim)[1])
            blocks = [x[k : k + most] for k in range(0, len(x), most)]
            yield pa.RecordBatch.from_arrays([pa.array([len(k) for k in blocks], pa.int64()), pa.array([k.tobytes() for k in blocks], pa.binary())], ["n", "x"])

    return job


class Vectors:
    """The remaining vectors in packed blocks: n, dim, sums, and sums over all rows of what a function makes of a block's centred rows."""

    def __init__(self, embeddings: DataFrame):
        size = F.max(F.when(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.size("v"))).alias("dim")
        self.dim = int(embeddings.agg(F.coalesce(size, F.lit(0))).first()[0])
        self.blocks = materialise(embeddings.select("v").mapInArrow(_packed(self.dim), "n long, x binary"), "vectors")
        self.n = int(self.blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        dim = self.dim

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = [0] * dim
            for b in batches:
                for x in b.column("x").to_pylist():
                    total = [a + int(s) for a, s in zip(total, _sums(np.frombuffer(x, np.int64).reshape(-1, dim)))]
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int64()), pa.array([str(s) for s in total])], ["cell", "value"])

        rows = self.blocks.mapInArrow(add, "cell long, value string") if self.n and dim else None
        sums = rows.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("string").alias("s")).collect() if rows else []
        self.sums = [0] * dim
        for r in sums:
            self.sums[r.cell] = int(r.s)

    def total(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """The sum over all blocks of ``of`` (centred rows -> an array of ``shape``)."""
        n, sums, dim, cells = self.n, self.sums, self.dim, int(np.prod(shape))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(cells)
            for b in batches:
                for x in b.column("x").to_pylist():
                    total += of(centred(np.frombuffer(x, np.int64).reshape(-1, dim), n, sums)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(total)], ["cell", "value"])

        out = np.zeros(cells)
        if n and cells:
            added = self.blocks.mapInArrow(add, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
            out[added.column("cell").to_numpy()] = added.column("value").to_numpy()
        return out.reshape(shape)

    def product(self, u: np.ndarray) -> np.ndarray:
        """V u for the columns of u."""
        return self.total(lambda y: y.T @ (y @ u), u.shape) / self.n


def shifted(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: in 64 bits where they hold it, else in Python's whole numbers."""
    most = max(map(abs, sums), default=0) + n * int(np.abs(x).max(initial=0))
    if most < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return shifted(x, n, sums).astype(np.float64) / n


def deviations(t: np.ndarray) -> list[int | None]:
    """The sum of squares of each row of n x - S, exact; null where no long holds it."""
    top = int(np.abs(t).max(initial=0))
    own = (t if top * top * max(1, t.shape[1]) < 1 << 63 else t.astype(object)) ** 2
    return [None if v >= 1 << 63 else v for v in map(int, own.sum(1))]


def _orthonormal(t: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of t add to those of ``against``; directions lost to rounding leave."""
    t = t / np.maximum(np.linalg.norm(t, axis=0), np.finfo(float).tiny)
    for _ in range(3):
        t = t - against @ (against.T @ t)
        q, s, _ = np.linalg.svd(t, full_matrices=False)
        t = q[:, s > 1e-8 * max(1.0, s.max(initial=0.0))]
    return t


def minres(product: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int, ratio: float = 1e-3) -> np.ndarray:
    """Approximate solutions of A x = b for each column of ``right`` by itself, a product for all of them in each step; ends when all
    residuals have fallen by ``ratio``."""
    x, v0, beta = np.zeros_like(right), np.zeros_like(right), np.linalg.norm(right, axis=0)
    first, eta = np.maximum(beta, np.finfo(float).tiny), beta.copy()
    v, w0, w1 = right / first, np.zeros_like(right), np.zeros_like(right)
    c0, c1, s0, s1 = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    beta = np.zeros_like(beta)
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(0)
        p = p - alpha * v - beta * v0
        after = np.linalg.norm(p, axis=0)
        delta, r2, r3 = c1 * alpha - c0 * s1 * beta, s1 * alpha + c0 * c1 * beta, s0 * beta
        r1 = np.hypot(delta, after)
        live = r1 > 0
        r1 = np.where(live, r1, 1.0)
        c0, s0, c1, s1 = c1, s1, np.where(live, delta / r1, 1.0), np.where(live, after / r1, 0.0)
        w0, w1 = w1, (v - r3 * w0 - r2 * w1) / r1
        x = x + np.where(live, c1 * eta, 0.0) * w1
        eta = np.where(live, -s1 * eta, 0.0)
        v0, beta = v, after
        v = p / np.maximum(after, np.finfo(float).tiny)
        if (np.abs(eta) <= ratio * first).all():
            break
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors, by products with blocks of vectors."""
    spare = min(dim, wanted + 4)
    most = min(dim, max(SUBSPACE * wanted, 24))
    locked, values = np.zeros((dim, 0)), np.zeros(0)
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dim, spare)), locked)
    image, last = product(basis), np.inf
    for _ in range(ROUNDS):
        theta, s = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, turned = basis @ s, image @ s
        rest = turned - ritz * theta
        rest -= locked @ (locked.T @ rest)
        need = min(wanted - len(values), len(theta))
        norms = np.linalg.norm(rest[:, :need], axis=0)
        scale = max(abs(theta).max(initial=0.0), abs(values).max(initial=0.0))
        done = norms <= ROUNDINGS * _EPS * max(1.0, np.sqrt(dim)) * scale
        full = basis.shape[1] + len(values) >= dim
        # with the whole space at hand, or where rounding stops all progress, what there is has the precision of the products
        if full or (norms.max(initial=0.0) >= last / 2 and norms.max(initial=0.0) <= 1e-11 * scale):
            done[:] = True
        last = norms.max(initial=0.0)
        k = need if done.all() else int(done.argmin())
        locked, values = np.hstack([locked, ritz[:, :k]]), np.append(values, theta[:k])
        if len(values) >= wanted:
            break
        if k:
            last = np.inf
        keep = slice(k, min(len(theta), k + spare) if basis.shape[1] + need > most else len(theta))
        basis, image = ritz[:, keep], turned[:, keep]
        open_ = slice(k, need)
        now, level, residual = ritz[:, open_], theta[open_], rest[:, open_]
        z = np.hstack([locked, now])
        part = lambda t: t - z @ (z.T @ t)  # noqa: B023, E731
        inside = lambda t: part(product(u := part(t)) - u * level)  # noqa: B023, E731
        new = _orthonormal(minres(inside, -part(residual), INNER), np.hstack([locked, basis]))
        if not new.shape[1]:
            new = _orthonormal(np.random.default_rng(seed + 1).standard_normal((dim, need)), np.hstack([locked, basis]))
        new = new[:, : dim - len(values) - basis.shape[1]]
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order], locked[:, order]


def _rows(dim: int, n: int, sums: list[int], axes: np.ndarray):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, c = _clean(b, dim)
            ids, step = b.column("vec_id").filter(pa.array(good)), max(1, BLOCK_BYTES // (8 * max(1, dim)))
            for k in range(0, len(c), step):
                t = shifted(whole(c[k : k + step]), n, sums)
                w = (t.astype(np.float64) / n) @ axes
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, max(1, w.shape[1])) if w.shape[1] else np.zeros(len(w) + 1), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([ids[k : k + step], pa.array(deviations(t), pa.int64()), lists], ["vec_id", "deviation", "w"])

    return job


def whitening(embeddings: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each remaining vector and component.

    Vectors that are null or hold null or non-finite entries leave; zero vectors stay, repeated and missing ids are kept as they are. Vectors shorter than the
    longest count as ending in zeros. Components whose eigenvalue is zero up to rounding have no scale: their ``whitened`` is null, and
    they don't count in identity_error; without any variance ``explained`` is null. A deviation that no long holds is null, and entries over
    2**56 count as that. An empty table gives an empty result.
    """
    own = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    data = Vectors(own)
    n, dim, wanted = data.n, data.dim, min(components, data.dim)
    types = "vec_id long, deviation long, w array<double>"
    out = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
    if not n or not wanted:
        none = own.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
        return none.select(*out)
    values, vectors = leading(data.product, dim, wanted)
    trace = float(data.total(lambda y: np.array([(y * y).sum()]), (1,))[0]) / n
    scaled = values > 1e3 * _EPS * dim * max(values.max(initial=0.0), 0.0)
    axes = vectors / np.sqrt(np.where(scaled, values, 1.0))
    moment = data.total(lambda y: (w := y @ axes).T @ w, (wanted, wanted)) / n
    centre = data.total(lambda y: (y @ axes).sum(0), (wanted,)) / n
    error = np.abs(moment - np.outer(centre, centre) - np.eye(wanted))[np.ix_(scaled, scaled)].max(initial=0.0)
    rows = own.mapInArrow(_rows(dim, n, data.sums, axes), types).select("vec_id", "deviation", F.posexplode("w").alias("pos", "w"))
    at = lambda xs, kind: F.element_at(F.array(*(F.lit(x).cast(kind) for x in xs)), F.col("pos") + 1)
    whitened = F.when(at([bool(s) for s in scaled], "boolean"), F.col("w"))
    explained = at([float(v) / trace if trace > 0 else None for v in values], "double")
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", whitened.alias("whitened"), explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
