"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are made by vectorised passes over the bytes of a batch. Trees are grown on a bounded sample
of labelled rows, by histograms of binned statistics, and laid out as arrays (feature, threshold, leaf value), so
that a batch goes down all trees by numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.folds import held_out, training_rows
from phrasemill.llm.textbytes import hashed_words, slices

FOLD = (3, 1)
TRAIN_ROWS, TREES, DEPTH, BINS, RATE, RIDGE, LEAST_WEIGHT = 20_000, 60, 4, 64, 0.2, 1.0, 1.0
STATISTICS = (
    "log_bytes", "log_words", "mean_word", "longest_word", "upper", "lower", "digit", "punctuation", "symbol", "pipe", "not_ascii", "space",
    "line_ends", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "distinct_lines", "sentence_ends", "symbol_endings", "upper_words", "entropy",
)

_CLASS = np.full(256, 7)  # 0 upper, 1 lower, 2 digit, 3 punctuation, 4 symbol, 5 pipe, 6 not ASCII, 7 space and control
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]], _CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]], _CLASS[ord("|")] = 3, 4, 5
_CLASS[128:] = 6
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _histogram(data: np.ndarray, offsets: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """How often each byte value stands in each row."""
    n, out = len(offsets) - 1, np.zeros((len(offsets) - 1) * 256, np.int64)
    for lo in range(0, len(data), step):
        row = np.searchsorted(offsets, np.arange(lo, min(lo + step, len(data))), "right") - 1
        out += np.bincount(row * 256 + data[lo : lo + step], minlength=n * 256)
    return out.reshape(n, 256)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different hashes each row has, and how often its most frequent one stands."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, row[first], np.diff(np.append(first, len(h))))
    return np.bincount(row[first], minlength=n), top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    seen = _histogram(data, offsets)
    kinds = np.stack([seen[:, _CLASS == k].sum(1) for k in range(8)], 1) / np.maximum(size, 1)[:, None]
    low = seen.copy()
    low[:, 97:123] += low[:, 65:91]
    low[:, 65:91] = 0
    share = low / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    start, end, of, h = hashed_words(data, offsets)
    count = np.bincount(of, minlength=n)
    per = lambda x, total: x / np.maximum(total, 1)
    lens = end - start
    longest = np.zeros(n)
    np.maximum.at(longest, of, lens)
    same, pair = of[1:] == of[:-1], np.zeros(0, np.uint64)
    if len(h) > 1:
        with np.errstate(over="ignore"):
            pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    again = np.bincount(of[1:][same & (h[1:] == h[:-1])], minlength=n)
    different, top = _distinct(of, h, n)
    pairs, _ = _distinct(of[1:][same], pair[same], n)
    _, _, line_of, lines = hashed_words(data, offsets, _LINE)
    line_count, (line_kinds, _) = np.bincount(line_of, minlength=n), _distinct(line_of, lines, n)
    last = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    symbol = np.bincount(of[(_CLASS[last] == 4) | (last == 33)], minlength=n)
    capital = np.bincount(of[(_CLASS[data[start]] == 0) & (_CLASS[last] != 1) & (lens > 1)] if len(start) else of, minlength=n)
    return np.stack(
        [
            np.log1p(size), np.log1p(count), (size - kinds[:, 7] * size) / np.maximum(count, 1), longest, *kinds.T, per(seen[:, 10], count),
            np.where(count > 0, per(different, count), 1), per(top, count), per(again, count), np.where(count > 1, per(pairs, count - 1), 1),
            np.where(line_count > 1, per(line_kinds, line_count), 1), per(seen[:, 46] + seen[:, 33] + seen[:, 63], count), per(symbol, count), per(capital, count), entropy,
        ],
        1,
    )


@dataclass
class Trees:
    """Complete trees of one depth: node k's children are 2 k + 1 and 2 k + 2; a row goes right where x > threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosting on the logistic loss; a node without a useful split sends all its rows left."""
    n, inner, width = len(y), (1 << DEPTH) - 1, x.shape[1] if x.ndim == 2 else 1
    share = (y.sum() + 1) / (n + 2)
    base = float(np.log(share / (1 - share)))
    if not n or y.min() == y.max():
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])  # bin b: x <= cuts[b]
    logit, features, thresholds, leaves = np.full(n, base), [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        g, h = p - y, p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = (1 << level) - 1, 1 << level
            best = np.full(many, 1e-6)
            pick = np.full((many, 2), -1)
            total_g, total_h = np.bincount(node - first, g, many), np.bincount(node - first, h, many)
            for j in range(width):
                key = (node - first) * BINS + binned[j]
                left_g, left_h = (np.bincount(key, v, many * BINS).reshape(many, BINS).cumsum(1)[:, : len(cuts[j])] for v in (g, h))
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - (total_g**2 / (total_h + RIDGE))[:, None]
                gain[(left_h < LEAST_WEIGHT) | (right_h < LEAST_WEIGHT)] = 0
                at = gain.argmax(1)
                value = gain[np.arange(many), at]
                better = value > best
                best[better], pick[better, 0], pick[better, 1] = value[better], j, at[better]
            for k in np.flatnonzero(pick[:, 0] >= 0):
                feature[first + k], threshold[first + k] = pick[k, 0], cuts[pick[k, 0]][pick[k, 1]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = -RATE * np.bincount(node - inner, g, inner + 1) / (np.bincount(node - inner, h, inner + 1) + RIDGE)
        logit += leaf[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), base)


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column("text")):
            x = statistics(data, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "y")), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees:
    """Learn from at most ``most`` labelled rows outside the held-out fold (crc32 of the id mod 3 = 1)."""
    rows = training_rows(docs, labels, "quality", *FOLD, most).mapInArrow(_statistics, "doc_id long, y int, x array<double>").toPandas().sort_values("doc_id")
    return grow(np.array(rows["x"].tolist()).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1)), rows["y"].to_numpy(float))


def _scores(shared):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                logit = trees.logit(statistics(data, offsets))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(1 / (1 + np.exp(-logit)))], [*batch.schema.names, "score"])

    return job


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """The columns given (``text`` among them) and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", score double"
    return docs.mapInArrow(_scores(shared), schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> doc_id, held_out, score, predicted: one row per document.

    Null and empty texts have the statistics of no words and are scored by them. Without labels of both classes the score is the smoothed
    share of label 1. Rows that repeat an id are scored each by its own text; a row without an id is scored, is no labelled row,
    and is not held out. Very long texts are read in parts. Other columns of either table are ignored; of repeated labels of an id the larger counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return score(docs, fit(docs, labels)).select("doc_id", held_out(*FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
