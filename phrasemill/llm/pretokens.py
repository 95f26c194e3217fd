"""Byte-level BPE counts and ids inside tasks: vectorised pre-tokens, each distinct one encoded once by ``tokenizers``.

Pre-tokens follow the public pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ .
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata

import numpy as np

from phrasemill.llm.textbytes import LONG, _power, long_cuts, mix

SPECIAL = "<|endoftext|>"
CACHE_MOST = 300_000
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_LETTER, _NUMBER, _OTHER, _SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.array([kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)], np.uint8)
    table[_SPACES] = _SPACE
    return table


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the row offsets counted in them."""
    seen = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32), seen[offsets]


def cut(cp: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the pre-tokens of all rows, and the end."""
    n = len(cp)
    if not n:
        return np.zeros(1, np.int64)
    kind = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begins = run.copy()
    last = np.append(run[1:] | first[1:n], True)  # of its run
    closing = first[1:]  # of its row
    begins |= (kind == _SPACE) & last & ~closing
    begins[1:] &= ~(run[1:] & ~first[1:n] & (kind[1:] != _SPACE) & (cp[:-1] == 32))
    for p in np.flatnonzero((cp == 39) & run & last & ~closing):
        if begins[p] and kind[p + 1] == _LETTER:
            two = p + 2 < n and not first[p + 2]
            pair = chr(cp[p + 1]) + (chr(cp[p + 2]) if two else "")
            k = 1 if pair[0] in "stmd" else 2 if pair in ("re", "ve", "ll") else 0
            if k:
                begins[p + 1] = False
                if p + 1 + k < n and not first[p + 1 + k] and kind[p + 1 + k] == _LETTER:
                    begins[p + 1 + k] = True
    return np.append(np.flatnonzero(begins), n)


def code_sums(cp: np.ndarray) -> np.ndarray:
    sums = np.empty(len(cp) + 1, np.uint64)
    sums[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(mix(cp.astype(np.uint64) + np.uint64(0x1234567)) * _power("up", len(cp)), out=sums[1:])
    return sums


def hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[end] - sums[start]) * _power("down", len(sums))[start] + (end - start).astype(np.uint64))


class Distinct:
    """A slot number for each distinct piece of text; emptied when it grows past CACHE_MOST entries.

    ``store.add(cp, starts, ends)`` takes the spans not seen before, in the order of their slots; ``store.clear()`` drops all.
    """

    def __init__(self, store):
        self.store, self.known = store, {}

    def __call__(self, cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The slot of each piece between consecutive starts."""
        a, b = starts[:-1], starts[1:]
        keys, at, which = np.unique(hashes(code_sums(cp), a, b), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_MOST:
            self.known = {}
            self.store.clear()
        find, keys = self.known.get, keys.tolist()
        slots = np.array([find(k, -1) for k in keys], np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            slots[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.store.add(cp, a[at[new]], b[at[new]])
            self.known.update(zip([keys[i] for i in new.tolist()], slots[new].tolist()))
        return slots[which]


def gather(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indexes of the spans laid end to end."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


@functools.cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def pair_encoder(path: str):
    """The JSON file's merges run by ``tiktoken``, about six times as fast on short strings; its ids are in merge order.

    Each line is one pre-token, and so is each line end.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; the others from 256 on
    byte_of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in vocabulary.items() if t != SPECIAL}
    return tiktoken.Encoding("byte_pairs", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})


class TokenStore:
    """Ids of distinct pre-tokens in one flat array. Many are encoded in one call, a line end between them; those of
    white space, which may hold line ends, one by one."""

    def __init__(self, path: str):
        self.own = pair_encoder(path)
        self.line = self.own.encode_ordinary("\n")[0]
        self.blank = tokenizer(path)
        self.clear()

    def clear(self):
        self.flat, self.start, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, cp: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        ids, size = [], np.zeros(len(a), np.int64)
        blank = _classes()[cp[b - 1]] == _SPACE  # only white space ends with it
        order = np.concatenate([np.flatnonzero(~blank), np.flatnonzero(blank)])
        plain = order[: (~blank).sum()]
        for lo in range(0, len(plain), 5000):
            own = plain[lo : lo + 5000]
            lens = b[own] - a[own] + 1
            text = cp[np.minimum(gather(a[own], lens), len(cp) - 1)]
            text[np.cumsum(lens) - 1] = 10
            got = np.array(self.own.encode_ordinary(text[:-1].tobytes().decode("utf-32-le")), np.uint32)
            line = got == self.line
            size[own] = np.diff(np.concatenate([[-1], np.flatnonzero(line), [len(got)]])) - 1
            ids.append(got[~line])
        for i in order[len(plain) :].tolist():
            got = self.blank.encode(cp[a[i] : b[i]].tobytes().decode("utf-32-le"), add_special_tokens=False).ids
            ids.append(np.array(got, np.uint32))
            size[i] = len(got)
        start = np.zeros(len(a), np.int64)
        start[order] = len(self.flat) + np.cumsum(size[order]) - size[order]
        self.flat = np.concatenate([self.flat, *ids])
        self.start, self.size = np.concatenate([self.start, start]), np.concatenate([self.size, size])


@functools.cache
def encoder(path: str) -> Distinct:
    return Distinct(TokenStore(path))


def encode_rows(path: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows, and where each row's begin; rows (or parts of long ones) with a special token's string go to the library."""
    if len(offsets) == 2 and len(data) > LONG and len(at := long_cuts(data)) > 2:
        ids = np.concatenate([encode_rows(path, data[a:b], np.array([0, b - a]))[0] for a, b in zip(at[:-1], at[1:])])
        return ids, np.array([0, len(ids)])
    raw = data.tobytes()
    odd = {}
    if SPECIAL.encode() in raw:
        for r in range(len(offsets) - 1):
            if SPECIAL.encode() in (row := raw[offsets[r] : offsets[r + 1]]):
                odd[r] = np.array(tokenizer(path).encode(row.decode(), add_special_tokens=False).ids, np.uint32)
    cp, at = code_points(data, offsets)
    if not len(cp):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    starts = cut(cp, at)
    slots, store = encoder(path)(cp, starts), encoder(path).store
    lens = store.size[slots]
    ids = store.flat[gather(store.start[slots], lens)]
    rows = np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, at)]
    if odd:
        own = [odd.get(r, ids[rows[r] : rows[r + 1]]) for r in range(len(offsets) - 1)]
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(p) for p in own])])
    return ids, rows
