"""Toxicity classifier, regularised by counterfactuals.

A document's features are its distinct words and their openings of four to six bytes, hashed. On a bounded sample of
labelled rows the features that tell the classes apart are chosen by an aggregate, and a logistic model is fitted whose loss has, for each
document that mentions a term of a kind, the squared difference between its score and those of the same document with the
kind's terms swapped for the others. Kinds are the group names of a given list, and kinds mined from the sample: terms that stand in one
slot, that is, frequent in both classes at like rates, in like contexts. A name that only happens to stand in toxic sentences so
loses its weight, and neutral mentions keep low scores. Scoring is one narrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.folds import held_out, training_rows
from phrasemill.llm.shared import materialise
from phrasemill.llm.textbytes import LOWER, prefix_sums, slice_parts, slices, span_hash, words

FOLD = (5, 0)
TRAIN_ROWS, BITS, FEATURES, STEPS, RATE, RIDGE, PENALTY = 12_000, 20, 6000, 250, 0.5, 1e-4, 4.0
OPENINGS = (4, 5, 6)
#: Mined kinds: terms of so large a share of either class's documents, at rates at most so many times apart, the most frequent ones;
#: contexts are the most frequent words beside them; a kind's terms have profiles with such a cosine to its first.
TERM_SHARE, RATE_APART, MOST_TERMS, MOST_CONTEXTS, ALIKE, KIND_TERMS, MOST_KINDS = 0.02, 1.5, 200, 400, 0.6, 4, 24
#: Group names by kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("immigrants", "natives"), ("young", "old"), ("disabled", "deaf", "blind"),
)

_WORD_BREAK = np.zeros(256, bool)
_WORD_BREAK[:128] = True
_WORD_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
#: The same breaks for column expressions.
_BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ALPHABET = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _codes(h: np.ndarray, kind: int) -> np.ndarray:
    return ((h ^ np.uint64(0x9E3779B97F4A7C15 * (kind + 1) & ((1 << 64) - 1))) >> np.uint64(64 - BITS)).astype(np.int64)


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature codes (words x kinds, -1 where a word is shorter than the opening), the words' hashes, and their rows."""
    data = LOWER[data]
    start, end, row = words(data, offsets, _WORD_BREAK)
    sums = prefix_sums(data)
    whole = span_hash(sums, start, end)
    cols = [_codes(whole, 0)]
    for k, size in enumerate(OPENINGS, 1):
        codes = _codes(span_hash(sums, start, np.minimum(start + size, end)), k)
        codes[end - start < size] = -1
        cols.append(codes)
    return np.stack(cols, 1), whole, row


def _terms(kinds) -> dict[int, tuple[int, int]]:
    """Hash of each term -> its kind and place in it; a term belongs to the first kind that has it."""
    found: dict[int, tuple[int, int]] = {}
    for k, kind in enumerate(kinds):
        for i, term in enumerate(kind):
            own = np.frombuffer(term.encode(), np.uint8)
            found.setdefault(int(word_codes(own, np.array([0, len(own)]))[1][0]), (k, i))
    return found


def _term_codes(kinds) -> list[list[np.ndarray]]:
    out = []
    for kind in kinds:
        own = []
        for term in kind:
            c = word_codes(np.frombuffer(term.encode(), np.uint8), np.array([0, len(term.encode())]))[0]
            own.append(c[c >= 0])
        out.append(own)
    return out


def _row_codes(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> Iterator[tuple[np.ndarray, list[int]]]:
    """Of each row: the distinct codes of the words that aren't terms, and the hashes of the terms that it mentions."""
    n = len(offsets) - 1
    own: list[list[np.ndarray]] = [[] for _ in range(n)]
    said: list[set[int]] = [set() for _ in range(n)]
    for part, at in slice_parts(data, offsets):
        codes, whole, row = word_codes(part, at)
        hit = np.isin(whole, terms)
        edge = np.searchsorted(row, np.arange(n + 1))
        for r, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
            c = np.unique(codes[a:b][~hit[a:b]])
            own[r].append(c[c >= 0])
            said[r].update(whole[a:b][hit[a:b]].tolist())
    for r in range(n):
        yield np.unique(np.concatenate(own[r])), sorted(said[r])


def _counterfactuals(rest: np.ndarray, said: list[int], where: dict[int, tuple[int, int]], codes: list[list[np.ndarray]]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A document's codes, and (codes lost, codes gained) of each of its counterfactuals: in the k-th every term is swapped for the
    one k places further on in its kind, so that each term is swapped for every other of its kind."""
    mentioned = [where[h] for h in said]
    full = np.unique(np.concatenate([rest, *(codes[k][i] for k, i in mentioned)])) if mentioned else rest
    out = []
    for turn in range(1, max((len(codes[k]) for k, _ in mentioned), default=1)):
        other = np.unique(np.concatenate([rest, *(codes[k][(i + turn) % len(codes[k])] for k, i in mentioned)]))
        out.append((np.setdiff1d(full, other), np.setdiff1d(other, full)))
    return full, out


def _counted(kinds):
    """Each code of each document once, for the choice of features."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, codes = _terms(kinds), _term_codes(kinds)
        terms = np.array(sorted(where), np.uint64)
        for batch in batches:
            y = batch.column("y").to_pylist()
            for lo, _, data, offsets in slices(batch.column("text")):
                count, positive = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
                for r, (rest, said) in enumerate(_row_codes(data, offsets, terms)):
                    full, _ = _counterfactuals(rest, said, where, codes)
                    count[full] += 1
                    positive[full] += y[lo + r]
                code = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count[code]), pa.array(positive[code])], ["code", "n", "p"])

    return job


def _features(kinds, chosen: np.ndarray):
    """Of each document the places of its chosen codes, and those that its counterfactuals lose and gain, each list behind its length."""
    place = np.full(1 << BITS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, codes = _terms(kinds), _term_codes(kinds)
        terms = np.array(sorted(where), np.uint64)
        kept = lambda c: place[c][place[c] >= 0].astype(np.int32)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                own, swaps = [], []
                for rest, said in _row_codes(data, offsets, terms):
                    full, pairs = _counterfactuals(rest, said, where, codes)
                    own.append(kept(full).tobytes())
                    pairs = [(kept(a), kept(b)) for a, b in pairs]
                    swaps.append(b"".join(np.concatenate([[len(a), len(b)], a, b]).astype(np.int32).tobytes() for a, b in pairs))
                cols = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "y")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(own, pa.binary()), pa.array(swaps, pa.binary())], ["doc_id", "y", "own", "swaps"])

    return job


def swaps_of(packed: bytes) -> list[tuple[np.ndarray, np.ndarray]]:
    x, at, out = np.frombuffer(packed, np.int32), 0, []
    while at < len(x):
        a, b = int(x[at]), int(x[at + 1])
        out.append((x[at + 2 : at + 2 + a], x[at + 2 + a : at + 2 + a + b]))
        at += 2 + a + b
    return out


@dataclass
class Model:
    """A weight for each feature code (most are 0), the intercept, the kinds whose terms were swapped, and how many of the sample's
    documents mention one."""

    weight: np.ndarray
    intercept: float
    kinds: tuple = ()
    swapped_rows: int = 0


class Loss:
    """Mean logistic loss, a ridge, and ``penalty`` times the mean over documents of the squared score changes of their counterfactuals."""

    def __init__(self, own: list[np.ndarray], swaps: list[list[tuple[np.ndarray, np.ndarray]]], y: np.ndarray, k: int, penalty: float):
        self.y, self.n, self.k, self.penalty = y, len(y), k, penalty
        flat = lambda lists: (np.concatenate([*lists, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
        self.f, self.d = flat(own)
        self.doc = np.repeat(np.arange(self.n), [len(s) for s in swaps])
        self.lost, self.lost_of = flat([a for s in swaps for a, _ in s])
        self.gained, self.gained_of = flat([b for s in swaps for _, b in s])

    def gradient(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        z = b + np.bincount(self.d, w[self.f], self.n)
        p = 1 / (1 + np.exp(-z))
        loss = float(np.logaddexp(0, z).sum() - (self.y * z).sum()) / self.n + RIDGE / 2 * float(w @ w)
        err, g = (p - self.y) / self.n, RIDGE * w
        if len(self.doc) and self.penalty:
            m = len(self.doc)
            q = 1 / (1 + np.exp(-(z[self.doc] - np.bincount(self.lost_of, w[self.lost], m) + np.bincount(self.gained_of, w[self.gained], m))))
            gap, scale = p[self.doc] - q, self.penalty / self.n
            loss += scale * float(gap @ gap)
            slope, other = p * (1 - p), q * (1 - q)
            err = err + 2 * scale * np.bincount(self.doc, gap * (slope[self.doc] - other), self.n)
            g = g + 2 * scale * (np.bincount(self.lost, (gap * other)[self.lost_of], self.k) - np.bincount(self.gained, (gap * other)[self.gained_of], self.k))
        return loss, g + np.bincount(self.f, err[self.d], self.k), float(err.sum())


def train(own, swaps, y: np.ndarray, k: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights of k features and the intercept, by steps of decreasing length along the gradient."""
    share = (y.sum() + 1) / (len(y) + 2)
    w, b = np.zeros(k), float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return w, b
    loss = Loss(own, swaps, y, k, penalty)
    seen, seen_b = np.full(k, 1e-6), 1e-6
    for _ in range(STEPS):
        _, g, gb = loss.gradient(w, b)
        seen, seen_b = seen + g * g, seen_b + gb * gb
        w -= RATE * g / np.sqrt(seen)
        b -= RATE * 0.1 * gb / np.sqrt(seen_b)
    return w, b


def mined_kinds(sample: DataFrame) -> tuple[tuple[str, ...], ...]:
    """Kinds of exchangeable terms of labelled texts (text, y): what is collected is bounded by MOST_TERMS and MOST_CONTEXTS.

    A kind is a term with those most like it in the words on their left and right.
    """
    said = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), *_ALPHABET), _BREAKS), lambda x: x != "")
    rows = sample.select("y", said.alias("w"))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return ()
    per = rows.select("y", F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(*(F.count_if(F.col("y") == v).alias(f"n{v}") for v in (0, 1)))
    per = per.select("word", "n0", "n1", *((F.col(f"n{v}") / sizes[v]).alias(f"s{v}") for v in (0, 1)))
    apart = F.greatest("s0", "s1") / F.greatest(F.least("s0", "s1"), F.lit(1e-9))
    frequent = materialise(per.orderBy(F.desc(F.col("n0") + F.col("n1")), "word").limit(MOST_CONTEXTS), "contexts")
    terms = frequent.where((F.least("s0", "s1") >= TERM_SHARE) & (apart <= RATE_APART)).orderBy(F.desc(F.least("s0", "s1")), "word").limit(MOST_TERMS)
    terms = [r["word"] for r in terms.select("word").collect()]
    if len(terms) < 2:
        return ()
    near = F.transform("w", lambda x, i: F.struct(x.alias("term"), F.array(F.concat(F.lit("<"), F.get("w", i - 1)), F.concat(F.lit(">"), F.get("w", i + 1))).alias("beside")))
    spots = rows.select(F.explode(near).alias("r")).select("r.term", F.explode("r.beside").alias("beside")).where(F.col("beside").isNotNull())
    known = frequent.select(F.explode(F.array(F.concat(F.lit("<"), "word"), F.concat(F.lit(">"), "word"))).alias("beside"))  # twice MOST_CONTEXTS
    own = sample.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    counts = spots.join(F.broadcast(own), "term").join(F.broadcast(known), "beside").groupBy("term", "beside").count().collect()
    beside = {b: j for j, b in enumerate(sorted({r["beside"] for r in counts}))}
    at = {t: i for i, t in enumerate(terms)}
    profile = np.zeros((len(terms), max(1, len(beside))))
    for r in counts:
        profile[at[r["term"]], beside[r["beside"]]] = r["count"]
    profile /= np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-9)
    like, free, kinds = profile @ profile.T, np.ones(len(terms), bool), []
    for i, term in enumerate(terms):
        if free[i] and len(kinds) < MOST_KINDS:
            free[i] = False
            close = [j for j in np.argsort(-like[i], kind="stable").tolist() if free[j] and like[i, j] >= ALIKE][: KIND_TERMS - 1]
            if close:
                free[close] = False
                kinds.append((term, *(terms[j] for j in close)))
    return tuple(kinds)


def chosen_features(sample: DataFrame, kinds) -> np.ndarray:
    """The codes that tell the classes apart best, FEATURES at most: counted by an aggregate, of which only these are collected."""
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        return np.zeros(0, np.int64)
    share = positive / n
    counts = sample.mapInArrow(_counted(kinds), "code long, n long, p long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    gain = F.pow(F.col("p") - F.col("n") * share, 2) / F.greatest(F.col("n") * (share * (1 - share)) * (1 - F.col("n") / n + 1e-9), F.lit(1e-9))
    best = counts.where("n >= 3").withColumn("gain", gain).where("gain > 4").orderBy(F.desc("gain"), "code").limit(FEATURES)
    return np.array([r["code"] for r in best.select("code").collect()], np.int64)


def fit(docs: DataFrame, labels: DataFrame, kinds=IDENTITY_TERMS, penalty: float = PENALTY, most: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``most`` labelled rows outside the held-out fold (crc32 of the id mod 5 = 0).

    The sample is written once. What comes to the driver is bounded: at most FEATURES places for a row, and of the counterfactuals
    those that differ.
    """
    sample = materialise(training_rows(docs, labels, "toxic", *FOLD, most), "sample")
    listed = {t for kind in kinds for t in kind}
    kinds = (*kinds, *(own for kind in mined_kinds(sample) if len(own := tuple(t for t in kind if t not in listed)) > 1))
    chosen = chosen_features(sample, kinds)
    rows = sample.mapInArrow(_features(kinds, chosen), "doc_id long, y int, own binary, swaps binary").toPandas().sort_values("doc_id", kind="stable")
    swaps = [swaps_of(x) for x in rows["swaps"]]
    w, b = train([np.frombuffer(x, np.int32) for x in rows["own"]], swaps, rows["y"].to_numpy(float), len(chosen), penalty)
    weight = np.zeros(1 << BITS, np.float32)
    weight[chosen] = w
    return Model(weight, b, kinds, sum(map(bool, swaps)))


def _scores(shared):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        live = model.weight != 0
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                own = np.zeros(0, np.int64)
                for part, at in slice_parts(data, offsets):
                    codes, _, row = word_codes(part, at)
                    r, k = np.nonzero((codes >= 0) & live[codes])
                    own = np.unique(np.concatenate([own, (row[r] << BITS) | codes[r, k]]))
                logit = model.intercept + np.bincount(own >> BITS, model.weight[own & ((1 << BITS) - 1)], hi - lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(logit, -500, 500))))], ["doc_id", "score"])

    return job


def score(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS floats
    return docs.select("doc_id", "text").mapInArrow(_scores(shared), "doc_id long, score double")


def score_changes(docs: DataFrame, model: Model) -> DataFrame:
    """-> doc_id, n_swaps, change: the mean absolute change of the score over a document's counterfactuals; documents without any leave."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        where, codes = _terms(own.kinds), _term_codes(own.kinds)
        terms = np.array(sorted(where), np.uint64)
        sigmoid = lambda z: 1 / (1 + np.exp(-z))
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for lo, _, data, offsets in slices(batch.column("text")):
                out = []
                for r, (rest, said) in enumerate(_row_codes(data, offsets, terms)):
                    full, pairs = _counterfactuals(rest, said, where, codes)
                    z = own.intercept + float(own.weight[full].sum())
                    if pairs:
                        out.append((ids[lo + r], len(pairs), float(np.mean([abs(sigmoid(z) - sigmoid(z - own.weight[a].sum() + own.weight[b].sum())) for a, b in pairs]))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "n_swaps", "change"])

    return docs.select("doc_id", "text").mapInArrow(job, "doc_id long, n_swaps long, change double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> doc_id, held_out, score, predicted: one row per document.

    Null and empty texts get the intercept's score. Without labels of both classes the score is the smoothed share of
    label 1. Rows that repeat an id are scored each by its own text, and each is a labelled row if the id is labelled. A row without an id
    is scored, is no labelled row, and is not held out. Very long texts are worked on in parts. Other columns of either table are
    ignored; of repeated labels of an id the larger counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit(docs, labels)).select("doc_id", held_out(*FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
