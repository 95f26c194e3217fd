"""SentencePiece (BPE) encoding and decoding by a merge-type prefix table.

For each prefix of a segment the table holds the one token that a right encoding of the prefix ends with. The tokens
that end at a place come from an automaton over the vocabulary; the right one is that whose pair with the last
token of the shorter prefix is stable, i.e. encoding the two strings together gives the two back. The ids are then
read backwards. Texts are cut where no vocabulary piece holds the two characters side by side (so before each
space), and every distinct segment of a slice is encoded once.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.pretokens import Distinct, code_points, gather
from phrasemill.llm.textbytes import slice_parts, slices

SPACE = "▁"
#: Remembered verdicts on pairs of tokens, forgotten when there are more.
STABLE_MOST = 1_000_000


class PrefixTable:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score, self.piece, self.id_of, self.byte = {}, {}, {}, {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                self.byte[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                p = sp.id_to_piece(i)
                self.piece[i], self.id_of[p], self.score[p] = p, i, sp.get_score(i)
        self.unknown = sp.unk_id()
        self.length = {i: len(p) for i, p in self.piece.items()}
        self.shown = {i: p.replace(SPACE, " ").encode() for i, p in self.piece.items()} | {i: bytes([b]) for b, i in self.byte.items()} | {self.unknown: " \u2047 ".encode()}
        self.decimal = {i: b"%d" % i for i in range(sp.get_piece_size())}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id_of.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.stable: dict[tuple[int, int], bool] = {}
        chars = sorted({ord(c) for p in self.id_of for c in p})
        self.char = np.zeros(0x110000, np.uint16)
        self.char[chars] = np.arange(1, len(chars) + 1)
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in self.id_of:
            k = self.char[[ord(c) for c in p]]
            self.beside[k[:-1], k[1:]] = True

    def merged(self, text: str) -> list[str]:
        """Merge by merge, best score first and then leftmost; for single tokens and pairs only."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == -np.inf:
                break
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fits(self, before: int, token: int) -> bool:
        if before < 0:
            if (-1, token) not in self.stable:
                self.stable[-1, token] = self.merged(self.piece[token]) == [self.piece[token]]
            return self.stable[-1, token]
        found = self.stable.get((before, token))
        if found is None:
            if len(self.stable) >= STABLE_MOST:
                self.stable.clear()
            a, b = self.piece[before], self.piece[token]
            found = self.stable[before, token] = self.fits(-1, token) and self.merged(a + b) == [a, b]
        return found

    def encode(self, segment: str) -> list[int]:
        own = self.id_of.get(segment)
        if own is not None and self.fits(-1, own):
            return [own]
        last: list[int] = [-1] * (len(segment) + 1)  # at -1: the empty prefix
        stable = self.stable
        for end, (size, token) in self.automaton.iter(segment):
            if last[end] < 0:
                before = last[end - size] if size <= end else -1
                if before >= 0 or size > end:
                    fits = stable.get((before, token))
                    if fits if fits is not None else self.fits(before, token):
                        last[end] = token
        ids, end = [], len(segment) - 1
        while end >= 0:
            token = last[end]
            if token < 0:  # a character outside the vocabulary stands alone in its segment
                ids += [self.byte.get(b, self.unknown) for b in reversed(segment[end].encode())]
                end -= 1
            else:
                ids.append(token)
                end -= self.length[token]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> bytes:
        """Pieces and bytes joined, the mark as a space; the space that encoding puts first is the caller's to take off."""
        return b"".join(map(self.shown.__getitem__, ids))

    def cut(self, cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        k = self.char[cp]
        begins = np.ones(len(cp), bool)
        begins[1:] = ~self.beside[k[:-1], k[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.append(np.flatnonzero(begins), len(cp))


class SegmentStore:
    """Per distinct segment: number of ids, ids as decimal text, decoded bytes."""

    def __init__(self, table: PrefixTable):
        self.table = table
        self.clear()

    def clear(self):
        self.size, self.ids, self.text = np.zeros(0, np.int64), [], []

    def add(self, cp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        lens = b - a
        text = cp[gather(a, lens)].tobytes().decode("utf-32-le")
        at = [0, *np.cumsum(lens).tolist()]
        encoded = [self.table.encode(text[x:y]) for x, y in zip(at, at[1:])]
        decimal = self.table.decimal.__getitem__
        self.size = np.concatenate([self.size, [len(e) for e in encoded]])
        self.ids += [b",".join(map(decimal, e)) for e in encoded]
        self.text += [self.table.decode(e) for e in encoded]


@functools.cache
def prefix_table(path: str) -> tuple[PrefixTable, Distinct]:
    own = PrefixTable(path)
    return own, Distinct(SegmentStore(own))


def marked(data: np.ndarray, offsets: np.ndarray, begins: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Code points with the mark for each space and, if texts begin here, one more in front of each row that isn't empty."""
    cp, at = code_points(data, offsets)
    cp = np.where(cp == 32, np.uint32(ord(SPACE)), cp)
    if not begins:
        return cp, at
    cp = np.insert(cp, at[np.flatnonzero(np.diff(at) > 0)], np.uint32(ord(SPACE)))
    return cp, at + np.concatenate([[0], np.cumsum(np.diff(at) > 0)])


def _encoded(path: str):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, distinct = prefix_table(path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                n, id_hash, text_hash = np.zeros(hi - lo, np.int64), [hashlib.sha256() for _ in range(hi - lo)], [hashlib.sha256() for _ in range(hi - lo)]
                for turn, (part, own_at) in enumerate(slice_parts(data, offsets)):
                    cp, at = marked(part, own_at, turn == 0)
                    starts = table.cut(cp, at)
                    slots = distinct(cp, starts) if len(cp) else np.zeros(0, np.int64)
                    ids, texts = distinct.store.ids, distinct.store.text
                    rows = np.searchsorted(starts, at)
                    n += np.diff(np.concatenate([[0], np.cumsum(distinct.store.size[slots])])[rows])
                    slots = slots.tolist()
                    for r, (a, b) in enumerate(zip(rows[:-1].tolist(), rows[1:].tolist())):
                        own = slots[a:b]
                        id_hash[r].update(b"," * (turn > 0) + b",".join([ids[i] for i in own]))
                        text_hash[r].update(b"".join([texts[i] for i in own])[turn == 0 :])
                digests = [pa.array([x.hexdigest() for x in h]) for h in (id_hash, text_hash)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(n, pa.int64()), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return job


def encode_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, ids array<int>, decoded string: the real outputs. Null and empty texts have no ids and decode to ''."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, _ = prefix_table(model_path)
        for batch in batches:
            for lo, hi, data, offsets in slices(batch.column("text")):
                ids: list[list[int]] = [[] for _ in range(hi - lo)]
                for turn, (part, own_at) in enumerate(slice_parts(data, offsets)):
                    cp, at = marked(part, own_at, turn == 0)
                    starts = table.cut(cp, at)
                    rows = np.searchsorted(starts, at)
                    for r, (a, b) in enumerate(zip(rows[:-1], rows[1:])):
                        ids[r] += [i for s, e in zip(starts[a:b], starts[a + 1 : b + 1]) for i in table.encode(cp[s:e].tobytes().decode("utf-32-le"))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(ids, pa.list_(pa.int32())), pa.array([table.decode(i)[1:].decode() for i in ids])], ["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(job, "doc_id long, ids array<int>, decoded string")


def sentencepiece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> doc_id, n_tokens, ids_sha256, decoded_sha256, one row per input row, in one narrow pass without a shuffle.

    Null and empty texts have no ids. Repeated rows are encoded alike, ids are passed on as they are, null too. Very long texts
    are cut before single spaces, where no piece spans. Other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_encoded(model_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
