"""Edit-aware token counts: a stored segment tree over each document's pre-tokens.

``build_trees`` encodes each document once and stores its tree: leaves are blocks of pre-tokens with their text, their characters and
their tokens, nodes the sums over the leaves below. ``apply_edits`` takes stored trees and edits and returns the next version of the
store. An edit finds its place by descending on the character sums, reads the leaves that it touches and a neighbour, re-encodes the
pre-tokens from two before a special token's length ahead of it until a boundary of the new text falls on an old one, from where all
boundaries agree, splits blocks that grow too large, and updates the sums on the way to the root. Nothing else is read or encoded.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.pretokens import SPECIAL, code_points, cut, encoder, tokenizer
from phrasemill.llm.shared import materialise
from phrasemill.llm.textbytes import LONG, bounds, long_cuts, slices

LEAF, BROADCAST_EDITS = 64, 100_000
EDIT = "struct<at:long,length:long,insert:string>"
#: Characters and tokens of a leaf's pre-tokens are numbers of one byte each, or of four where ``wide``.
LEAVES = "array<struct<wide:boolean,chars:binary,tokens:binary,text:string>>"
STORE = f"doc_id long, n_chars long, n_pretokens long, n_tokens long, sums array<long>, leaves {LEAVES}"
_LEAF = pa.struct([("wide", pa.bool_()), ("chars", pa.binary()), ("tokens", pa.binary()), ("text", pa.string())])
_END = regex.escape(SPECIAL)
#: The public pattern, a special token's string being a pre-token of its own, as the library has it.
PATTERN = regex.compile(rf"{_END}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?(?:(?!{_END})[^\s\p{{L}}\p{{N}}])+|\s+(?={_END})|\s+(?!\S)|\s+")


def tree_sums(leaf_sums: np.ndarray) -> np.ndarray:
    """Node k sums its children 2 k and 2 k + 1; leaves (characters, tokens) stand in the second half."""
    width = 1 << max(0, len(leaf_sums) - 1).bit_length()
    sums = np.zeros((2 * width, 2), np.int64)
    sums[width : width + len(leaf_sums)] = leaf_sums
    while width > 1:
        sums[width // 2 : width] = sums[width : 2 * width].reshape(-1, 2, 2).sum(1)
        width //= 2
    return sums


class CountTree:
    """A document's leaves, each [chars, tokens, text] or the number of a stored one that hasn't been read, and their sums."""

    def __init__(self, leaves: list, sums: np.ndarray, load: Callable[[int], list] | None = None):
        self.leaves, self.sums, self.load, self.read = leaves or [[[], [], ""]], sums, load, 0

    @property
    def width(self) -> int:
        return len(self.sums) // 2

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, b: int) -> list:
        if not isinstance(self.leaves[b], list):
            self.leaves[b] = self.load(self.leaves[b])
            self.read += 1
        return self.leaves[b]

    def find(self, at: int) -> tuple[int, int, int]:
        """Leaf, place in it and first character of the pre-token that holds character ``at`` (the last one at the end)."""
        if not self.chars:
            return 0, 0, 0
        at, k, start = min(max(at, 0), self.chars - 1), 1, 0
        while k < self.width:
            k *= 2
            if at - start >= self.sums[k, 0]:
                start += int(self.sums[k, 0])
                k += 1
        b = k - self.width
        for i, c in enumerate(self.leaf(b)[0]):
            if at < start + c:
                return b, i, start
            start += c
        raise AssertionError("sums of a leaf don't fit its pre-tokens")

    def before(self, b: int, i: int, start: int) -> tuple[int, int, int]:
        """The pre-token before, or the same at the beginning."""
        while i == 0:
            if b == 0:
                return 0, 0, 0
            b -= 1
            i = len(self.leaf(b)[0])
        return b, i - 1, start - self.leaf(b)[0][i - 1]

    def edit(self, at: int, length: int, insert: str, count: Callable[[str], int]) -> int:
        """Replace ``length`` characters from ``at`` on; -> how many pre-tokens were encoded again."""
        at = min(max(at, 0), self.chars)
        length = min(max(length, 0), self.chars - at)
        shift, fixed = len(insert) - length, at + len(insert)
        b, i, start = self.before(*self.before(*self.find(at - len(SPECIAL))))
        upto, ahead = self.find(at + length)[0], 1
        while True:
            last = min(len(self.leaves) - 1, upto + ahead)
            whole = last == len(self.leaves) - 1
            spots, edge, old = {}, start, []
            for k in range(b, last + 1):
                chars, _, text = self.leaf(k)
                first = i if k == b else 0
                for place in range(first, len(chars)):
                    if edge >= at + length:
                        spots[edge + shift] = (k, place)
                    edge += chars[place]
                old.append(text[sum(chars[:first]) :])
            text = "".join(old)
            new = text[: at - start] + insert + text[at + length - start :]
            found, end = [], None
            for m in PATTERN.finditer(new):
                pos = start + m.start()
                if pos >= fixed and pos in spots and (whole or m.start() + len(SPECIAL) <= len(new)):
                    end = spots[pos]
                    break
                found.append(m[0])
            if end is None and whole:
                end = (last, len(self.leaf(last)[0]))
            if end is not None:
                self.replace((b, i), end, found, [count(p) for p in found])
                return len(found)
            ahead *= 2

    def replace(self, first: tuple[int, int], last: tuple[int, int], pieces: list[str], tokens: list[int]) -> None:
        """Pre-tokens from ``first`` up to ``last`` become these."""
        (a, i), (b, j) = first, last
        head, tail = self.leaf(a), self.leaf(b)
        chars = head[0][:i] + [len(p) for p in pieces] + tail[0][j:]
        tokens = head[1][:i] + tokens + tail[1][j:]
        text = head[2][: sum(head[0][:i])] + "".join(pieces) + tail[2][sum(tail[0][:j]) :]
        step, blocks, at = len(chars) if len(chars) <= 2 * LEAF else LEAF, [], 0
        for lo in range(0, max(1, len(chars)), max(1, step)):
            own = chars[lo : lo + step]
            blocks.append([own, tokens[lo : lo + step], text[at : at + sum(own)]])
            at += sum(own)
        new = np.array([[sum(x[0]), sum(x[1])] for x in blocks], np.int64)
        if a == b and len(blocks) == 1:
            node = self.width + a
            self.sums[node] = new[0]
            while node > 1:
                node //= 2
                self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
        else:
            old = self.sums[self.width : self.width + len(self.leaves)]
            self.sums = tree_sums(np.concatenate([old[:a], new, old[b + 1 :]]))
        self.leaves[a : b + 1] = blocks


def unpacked(wide: bool, chars: bytes, tokens: bytes, text: str) -> list:
    kind = "<u4" if wide else "<u1"
    return [np.frombuffer(chars, kind).tolist(), np.frombuffer(tokens, kind).tolist(), text]


def packed(chars: list[int], tokens: list[int], text: str) -> dict:
    wide = max(*chars, *tokens) > 255
    pack = lambda x: np.array(x, "<u4" if wide else "<u1").tobytes()
    return {"wide": wide, "chars": pack(chars), "tokens": pack(tokens), "text": text}


@functools.cache
def _counter(path: str) -> Callable[[str], int]:
    own = tokenizer(path)

    @functools.lru_cache(200_000)
    def count(pretoken: str) -> int:
        return len(own.encode(pretoken, add_special_tokens=False).ids)

    return count


def pretokens(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the pre-tokens of all rows: first byte, characters, tokens; and where each row's begin."""
    if len(offsets) == 2 and len(data) > LONG and len(at := long_cuts(data)) > 2:
        own = [(a, *pretokens(path, data[a:b], np.array([0, b - a]))) for a, b in zip(at[:-1], at[1:])]
        first, chars, tokens = (np.concatenate([o[k] + (o[0] if k == 1 else 0) for o in own]) for k in (1, 2, 3))
        return first, chars, tokens, np.array([0, len(first)])
    cp, at = code_points(data, offsets)
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    starts = cut(cp, at)
    slots = encoder(path)(cp, starts)
    sizes, rows, byte = encoder(path).store.size[slots], np.searchsorted(starts, at), np.flatnonzero((data & 0xC0) != 0x80)
    raw = data.tobytes()
    if SPECIAL.encode() in raw:
        begins, counts, number = [], [], [0]
        for r in range(len(offsets) - 1):
            if SPECIAL.encode() in raw[offsets[r] : offsets[r + 1]]:
                found = [(m.start(), m[0]) for m in PATTERN.finditer(raw[offsets[r] : offsets[r + 1]].decode())]
                begins.append(np.array([s for s, _ in found]) + at[r])
                counts.append(np.array([_counter(path)(p) for _, p in found]))
            else:
                begins.append(starts[rows[r] : rows[r + 1]])
                counts.append(sizes[rows[r] : rows[r + 1]])
            number.append(number[-1] + len(begins[-1]))
        starts, sizes, rows = np.append(np.concatenate(begins), len(cp)), np.concatenate(counts), np.array(number)
    return byte[starts[:-1]], np.diff(starts), sizes, rows


def _trees(path: str):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                first, chars, tokens, rows = pretokens(path, data, offsets)
                begin = np.concatenate([np.arange(a, b, LEAF) for a, b in zip(rows[:-1], rows[1:])]).astype(np.int64)
                of = bounds(begin, len(chars))[rows] if len(chars) else np.zeros(hi - lo + 1, np.int64)
                ends = np.append(begin, len(chars)).astype(np.int32)
                leaf_sums = np.stack([np.add.reduceat(c, begin) if len(begin) else c[:0] for c in (chars, tokens)], 1)
                sums = [tree_sums(leaf_sums[a:b]).ravel() for a, b in zip(of[:-1], of[1:])]
                text = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(first[begin], len(data)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
                kind = "<u1" if max(chars.max(initial=0), tokens.max(initial=0)) < 256 else "<u4"
                at = pa.py_buffer(ends * np.int32(kind[2]))
                packed = [pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, at, pa.py_buffer(c.astype(kind))]) for c in (chars, tokens)]
                wide = pa.array(np.full(len(begin), kind == "<u4"))
                leaves = pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.StructArray.from_arrays([wide, *packed, text], fields=list(_LEAF)))
                total = np.array([s[2:4] for s in sums])
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(total[:, 0]), pa.array(np.diff(rows)), pa.array(total[:, 1])]
                sums_at = np.concatenate([[0], np.cumsum([len(s) for s in sums])]).astype(np.int32)
                cols += [pa.ListArray.from_arrays(pa.array(sums_at), pa.array(np.concatenate(sums))), leaves]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "n_pretokens", "n_tokens", "sums", "leaves"])

    return job


def build_trees(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> STORE, one row per input row, without a shuffle; to be written and kept. Null text counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_trees(tokenizer_path), STORE)


def _edited(path: str, whole: bool):
    """Stored trees after their edits, or only their counts."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in batches:
            stored, sums = batch.column("leaves"), batch.column("sums")
            of, flat = np.asarray(stored.offsets), stored.values
            fields = [flat.field(k) for k in ("wide", "chars", "tokens", "text")]
            load = lambda k: unpacked(*(f[k].as_py() for f in fields))
            out, names = [], ["doc_id", "n_pretokens", "n_tokens", "n_tokens_after", "n_encoded_again"]
            known = batch.select(["doc_id", "n_pretokens", "n_tokens"]).to_pylist()
            for r, edits in enumerate(batch.column("edits").to_pylist()):
                row, again = known[r], 0
                edits = [e for e in edits or [] if e is not None]
                tree = None
                if edits or whole:
                    nodes = np.array(sums[r].values).reshape(-1, 2).copy()
                    tree = CountTree(list(range(of[r], of[r + 1])), nodes, load)
                    for e in edits:
                        again += tree.edit(e["at"] or 0, e["length"] or 0, e["insert"] or "", count)
                if whole:
                    own = [x if isinstance(x, list) else load(x) for x in tree.leaves]
                    own = [x for x in own if x[0]]
                    leaf_sums = np.array([[sum(x[0]), sum(x[1])] for x in own], np.int64).reshape(-1, 2)
                    out.append((row["doc_id"], tree.chars, sum(len(x[0]) for x in own), tree.tokens, tree_sums(leaf_sums).ravel().tolist(), [packed(*x) for x in own], again))
                else:
                    out.append((row["doc_id"], row["n_pretokens"], row["n_tokens"], tree.tokens if tree else row["n_tokens"], again))
            kinds = [pa.int64()] * 5
            if whole:
                names, kinds = ["doc_id", "n_chars", "n_pretokens", "n_tokens", "sums", "leaves", "n_encoded_again"], [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.list_(_LEAF), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names)

    return job


def _prepared(store: DataFrame) -> DataFrame:
    return store.select("doc_id", "n_pretokens", "n_tokens", "sums", "leaves", F.col("edits").cast(f"array<{EDIT}>").alias("edits"))


def with_edits(store: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds the column ``edits`` of a table (doc_id, edits); documents without any have null. The table is sent to all tasks
    if it has BROADCAST_EDITS rows at most."""
    edits = materialise(edits.select("doc_id", F.col("edits").cast(f"array<{EDIT}>").alias("edits")), "edits")
    return store.join(F.broadcast(edits) if edits.count() <= BROADCAST_EDITS else edits, "doc_id", "left")


def apply_edits(store: DataFrame, tokenizer_path: str) -> DataFrame:
    """Stored trees with a column ``edits`` -> the next version of the store, and n_encoded_again."""
    return _prepared(store).mapInArrow(_edited(tokenizer_path, True), f"{STORE}, n_encoded_again long")


def recounted(store: DataFrame, tokenizer_path: str) -> DataFrame:
    """Stored trees with a column ``edits`` -> doc_id, n_pretokens, n_tokens, n_tokens_after, n_encoded_again."""
    return _prepared(store).mapInArrow(_edited(tokenizer_path, False), "doc_id long, n_pretokens long, n_tokens long, n_tokens_after long, n_encoded_again long")


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str | None = None) -> DataFrame:
    """-> doc_id, n_pretokens, n_tokens, n_tokens_after, n_encoded_again: one row per input row, without a shuffle.

    The trees are stored first; the edits are then applied to the stored trees. ``edits_col`` names an expression over the store's
    columns (doc_id, n_chars, ...), by default ``takedown_edits``. Edits are an array of (at, length, insert), applied in order to the text as
    it then stands, in code points and clipped to it; a null array or edit does nothing. Null text counts as empty (0 tokens). The
    string of a special token counts as one token, as in the library's ids. Null ids are kept; rows that repeat an id are edited
    alike. Very long texts are cut at spaces where pre-tokens end in any case. Other columns are ignored.
    """
    store = materialise(build_trees(docs, tokenizer_path, id_col, text_col), "trees", compression="zstd")
    return recounted(store.withColumn("edits", F.expr(edits_col)) if edits_col else takedown_edits(store), tokenizer_path)


def takedown_edits(store: DataFrame) -> DataFrame:
    """Adds ``edits``: a word exchanged at three quarters, a notice in the middle and eight characters cut at a quarter."""
    n = F.col("n_chars")
    one = lambda at, length, insert: F.struct(at.cast("long").alias("at"), F.lit(length).cast("long").alias("length"), insert.alias("insert"))
    notice = F.concat(F.lit(" [notice "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("] "))
    return store.withColumn("edits", F.array(one(F.floor(3 * n / 4), 5, F.lit("it's")), one(F.floor(n / 2), 0, notice), one(F.floor(n / 4), 8, F.lit(""))))
