"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

1. *Rare first.* A pass over all texts finds the shingles that are frequent in the corpus. Each block of
   ``BLOCK`` shingles reports those it saw ``BLOCK_LEAST`` times; the most frequent by their sums are kept, from the least
   count that at most HEAVY_MOST shingles reach, which bounds the broadcast table; shingles beyond it that would still fill
   a bucket are told by a table of hashes, of bounded size too. The class of a shingle (0, or 1 + log2 of that count) stands in the top six bits of its 64-bit key, so that sorted keys are in rare-first order. Any fixed order gives
   the same links; the classes decide only how many candidates are read.
2. *Classes.* Documents with the same set are one class (map-side minimum by fingerprint); only the class
   representative, its smallest id, goes on.
3. *Prefix join.* The first n - ceil(0.8 n) + l keys of each set, l = 1 + n / 20, are dealt into buckets by key, heavy keys
   into several by the document, whose parts are joined again by size. Linked sets share at least l (the smaller one's) of these keys. Of keys that up to PAIR_GROUP
   sets share, the pairs that pass the length filter are counted, and those counted l times go on. Of keys that more sets share
   only a spanning forest leaves the bucket, over the pairs that pass the length and positional filters; the latter allows
   for l - 1 shared keys before this one, as a pair with more has been counted already. Of a key that is dealt into several
   buckets each part leaves a chain by size and its smallest set of each size; these are chained by size over all parts, so
   every pair that passes the length filter is joined, whichever parts it lies in.
4. *Verification.* Candidate clusters are gathered, those of more than SPLIT_KEYS keys cut into cells, and in a cell each set that
   may still join another component is counted exactly against the sets that share a shingle with it, once per pair.
   Cells return forests of verified links. Of a cluster in several cells one set of each component is compared next;
   if components are left after that, each set outside the largest meets all cells of the cluster, so that every two
   sets that aren't in one component yet have been in one task.

Nothing is capped: a link between two sets of at least the threshold always ends in the same component. Shingles are compared
by 58-bit hashes of their words, not by the words: two different ones count as equal with a chance of 2^-58 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.components import components
from phrasemill.llm.pretokens import gather
from phrasemill.llm.shared import BROADCAST_ROWS, counted, materialise, parts, unsent
from phrasemill.llm.textbytes import bounds, hashed_words, mix, slices

WIDTH, SHARE = 5, 80
BLOCK, BLOCK_LEAST, HEAVY_MOST, SLOTS_MOST = 1 << 22, 2, 1 << 19, 1 << 22
BUCKET_KEYS, PAIR_GROUP, GROUP_MOST, CELL_KEYS = 200_000, 64, 20_000, 4_000_000
#: Bits of the table that tells which documents have candidates: so many for each of these, and 8 MB at most.
PRESENT_EACH, PRESENT_MOST = 16, 1 << 26
#: A cluster is cut into cells of so many keys, into SPLIT_MOST at most while cells stay under CELL_KEYS.
SPLIT_KEYS, SPLIT_MOST = 10_000, 64
_CLASS = np.uint64(58)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row and where each row's begin; a shorter text is one shingle of all its words."""
    _, _, row, h = hashed_words(data, offsets)
    n = len(offsets) - 1
    at = bounds(row, n)
    count = np.diff(at)
    with np.errstate(over="ignore"):
        full = np.zeros(0, np.uint64)
        keep = np.zeros(0, bool)
        if len(h) >= width:
            full = h[: len(h) - width + 1].copy()
            for j in range(1, width):
                full = full * np.uint64(0xD6E8FEB86659FD93) + h[j : len(h) - width + 1 + j]
            keep = row[: len(full)] == row[width - 1 :]
        short = np.flatnonzero((count > 0) & (count < width))
        own = np.zeros(len(short), np.uint64)
        for k, r in enumerate(short):
            for x in h[at[r] : at[r + 1]]:
                own[k] = own[k] * np.uint64(0xD6E8FEB86659FD93) + x
            own[k] += np.uint64(0xA5A5A5A5A5A5 * int(count[r]))
    hashes, rows = np.concatenate([mix(full[keep]), mix(own)]), np.concatenate([row[: len(full)][keep], short])
    if len(short):
        order = np.argsort(rows, kind="stable")
        hashes, rows = hashes[order], rows[order]
    return hashes, bounds(rows, n)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _heavy_in_blocks(width: int):
    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            few = n >= BLOCK_LEAST
            return pa.RecordBatch.from_arrays([pa.array(keys[few].view(np.int64)), pa.array(n[few])], ["key", "n"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                hashes, at = shingles(data, offsets, width)
                for lo, hi in zip(at[:-1], at[1:]):
                    own = _distinct(hashes[lo:hi] & np.uint64((1 << 58) - 1))
                    held.append(own)
                    size += len(own)
                if size >= BLOCK:
                    yield report()
                    held, size = [], 0
        if size:
            yield report()

    return job


Heavy = tuple[np.ndarray, np.ndarray, np.ndarray]


def _slot(keys: np.ndarray, slots: int) -> np.ndarray:
    return (mix(keys) & np.uint64(max(1, slots) - 1)).astype(np.int64)


def heavy_shingles(docs: DataFrame, text_col: str, width: int) -> Heavy:
    """Sorted 58-bit keys of the corpus's frequent shingles and their classes, HEAVY_MOST at most; and for the keys beyond these that would still
    fill a bucket the largest class by a hash of the key, SLOTS_MOST slots at most. Slots that several keys share only deal more than is needed.
    """
    seen = materialise(docs.select(text_col).mapInArrow(_heavy_in_blocks(width), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 4"), "shingle-counts")
    step = F.floor(4 * F.log2("n"))
    total, least_step, hot = 0, None, F.col("n") >= max(4, BUCKET_KEYS // 2)
    for k, n in sorted(seen.groupBy(step.alias("step")).count().collect(), reverse=True):  # 4 rows for each doubling
        total += n
        if total > HEAVY_MOST:
            break
        least_step = k
    kept = step >= (least_step if least_step is not None else 1 << 30)
    rows = seen.where(kept).select("key", "n").toPandas().sort_values("key")
    kind = lambda n: np.minimum(63, 1 + np.log2(np.maximum(1, n))).astype(np.uint64)
    rest = seen.where(~kept & hot)
    count = rest.count()
    slots = np.zeros(min(SLOTS_MOST, 1 << (8 * count - 1).bit_length()) if count else 0, np.uint8)
    if count:
        size = len(slots)

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                slot = _slot(b.column("key").to_numpy().view(np.uint64), size)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(kind(b.column("n").to_numpy().astype(float)).astype(np.int64))], ["slot", "kind"])

        found = rest.select("key", "n").mapInArrow(largest, "slot long, kind long").groupBy("slot").agg(F.max("kind").alias("kind")).toArrow()
        slots[found.column("slot").to_numpy()] = found.column("kind").to_numpy()
    return rows["key"].to_numpy(np.int64).view(np.uint64), kind(rows["n"].to_numpy(float)), slots


def ranked(hashes: np.ndarray, heavy: Heavy) -> np.ndarray:
    """Keys whose order is rare first."""
    keys = hashes & np.uint64((1 << 58) - 1)
    known, kinds, slots = heavy
    if not len(keys):
        return keys
    kind = slots[_slot(keys, len(slots))].astype(np.uint64) if len(slots) else np.zeros(len(keys), np.uint64)
    if len(known):
        found = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        kind = np.where(known[found] == keys, kinds[found], kind)
    return keys | (kind << _CLASS)


def present_ids(ids: DataFrame, count: int) -> np.ndarray:
    """A table of bits by a hash of the id: set for each of the ``count`` ids, and by chance for a few others."""
    size = min(PRESENT_MOST, 1 << max(6, (PRESENT_EACH * count - 1).bit_length()))

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = _slot(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), size)
            word, at = np.unique(slot >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.int64)
            np.bitwise_or.at(bits, at, np.int64(1) << (slot & 63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], ["word", "bits"])

    found = ids.mapInArrow(job, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.int64)
    table[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return table


def _among(ids: np.ndarray, table: np.ndarray) -> np.ndarray:
    slot = _slot(ids.view(np.uint64), len(table) << 6)
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def _sets(width: int, share: int, heavy, whole: bool, present=None):
    """Per document, or per document that the table ``present`` may hold: id, set size, fingerprint, and the prefix keys or the whole set as bytes."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if present is not None:
                batch = batch.filter(pa.array(_among(batch.column("doc_id").to_numpy(zero_copy_only=False), present.value)))
            for lo, hi, data, offsets in slices(batch.column("text")):
                hashes, at = shingles(data, offsets, width)
                keys = ranked(hashes, heavy.value)
                sets = [_distinct(keys[a:b]) for a, b in zip(at[:-1], at[1:])]
                n = np.array([len(s) for s in sets], np.int64)
                cols = [batch.column("doc_id").slice(lo, hi - lo), pa.array(n)]
                if whole:
                    yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array([s.tobytes() for s in sets], pa.binary())], [*batch.schema.names[:-1], "keys"])
                    continue
                with np.errstate(over="ignore"):
                    a = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    b = [int(np.bitwise_xor.reduce(mix(s * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))).view(np.int64)) if len(s) else 0 for s in sets]
                prefix = [s[: len(s) - (len(s) * share + 99) // 100 + extra(len(s))].tobytes() if len(s) else b"" for s in sets]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(prefix, pa.binary())], ["doc_id", "n", "print_a", "print_b", "prefix"])

    return job


def spread(keys: np.ndarray, most: int) -> np.ndarray:
    """Into how many parts of about ``most`` sets each key is dealt; its class tells."""
    kind = keys >> _CLASS
    return np.where(kind > 0, 1 + (np.uint64(1) << kind) // np.uint64(most), np.uint64(1))


def _deal(buckets: int, most: int):
    """Prefix keys to buckets: one row of packed keys for each bucket and group of documents."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)
            prefixes = [np.frombuffer(x, np.uint64) for x in batch.column("prefix").to_pylist()]
            lens = np.array([len(x) for x in prefixes])
            keys = np.concatenate([*prefixes, np.zeros(0, np.uint64)])
            who = np.repeat(np.arange(len(ids)), lens)
            pos = np.arange(len(keys)) - np.repeat(np.cumsum(lens) - lens, lens)
            salt = mix(ids[who].astype(np.int64).view(np.uint64)) % spread(keys, most)
            with np.errstate(over="ignore"):
                bucket = (mix(keys + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            ends = np.append(cut[1:], len(order))
            rows = [(int(bucket[order[a]]), keys[i].tobytes(), ids[who[i]].tobytes(), n[who[i]].astype(np.int32).tobytes(), pos[i].astype(np.int32).tobytes()) for a, b in zip(cut, ends) for i in [order[a:b]]]
            names, kinds = ["bucket", "keys", "ids", "ns", "pos"], [pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(5)], names)

    return job


def extra(n):
    """Shared prefix keys that a set of n keys asks of its partners: l."""
    return 1 + n // 20


def least(n_a, n_b, share: int):
    """The overlap that two sets of these sizes need."""
    return -(-(n_a + n_b) * share // (100 + share))


class Forest:
    """Union by smallest id over positions 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _forest(ns: np.ndarray, pos: np.ndarray, lo: int, hi: int, share: int, chain: bool) -> Iterator[tuple[int, int]]:
    """Of the sets lo..hi that hold one key, sorted by size: links that join whatever the filters let pass."""
    if chain or hi - lo > GROUP_MOST:  # neighbours by length: their chain holds every pair that the length filter lets pass
        x = np.arange(lo, hi - 1)
        yield from ((int(i), int(i) + 1) for i in x[ns[x] * 100 >= ns[x + 1] * share])
        return
    left = np.arange(lo, hi)
    while len(left):  # breadth first: each set is compared with those not yet reached
        ring, left = [int(left[0])], left[1:]
        while ring and len(left):
            x = ring.pop()
            reach = np.minimum(ns[x] - pos[x], ns[left] - pos[left]) + extra(np.minimum(ns[x], ns[left])) - 1
            near = (ns[left] * 100 >= ns[x] * share) & (ns[x] * 100 >= ns[left] * share) & (reach >= least(ns[x], ns[left], share))
            if near.any():
                found = left[near].tolist()
                yield from ((x, y) for y in found)
                ring += found
                left = left[~near]


def _tally(a: np.ndarray, b: np.ndarray, need: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal pairs added up."""
    order = np.lexsort((b, a))
    a, b, need, count = a[order], b[order], need[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[first], b[first], need[first], np.add.reduceat(count, first) if len(first) else count


def _candidates(share: int, buckets: int, most: int):
    """Of a bucket: counted pairs of the small groups and forests of the large ones, packed by a hash of the pair.

    The parts of a dealt key also leave rows (key, smallest id, size) with the count -1, packed by a hash of the key.
    """

    def job(table: pa.Table) -> pa.Table:
        load = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])
        keys, ids, ns, pos = load("keys", np.uint64), load("ids", np.int64), load("ns", np.int32).astype(np.int64), load("pos", np.int32)
        order = np.lexsort((ids, ns, keys))
        keys, ids, ns, pos = keys[order], ids[order], ns[order], pos[order]
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size, dealt = np.diff(np.append(cut, len(keys))), spread(keys[cut], most) > 1
        small, large = ~dealt & (size > 1) & (size <= PAIR_GROUP), (size > 1) & (dealt | (size > PAIR_GROUP))
        xs, ys, forest, own = [], [], Forest(len(ids)), np.unique(ids, return_inverse=True)[1]
        for k in np.unique(size[small]).tolist():
            i, j = np.triu_indices(k, 1)
            base = cut[small & (size == k)][:, None]
            x, y = (base + i).ravel(), (base + j).ravel()
            fits = ns[x] * 100 >= ns[y] * share
            xs.append(x[fits]), ys.append(y[fits])
        x, y = np.concatenate([*xs, np.zeros(0, np.int64)]), np.concatenate([*ys, np.zeros(0, np.int64)])
        counted = [np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), extra(ns[x]), np.ones(len(x), np.int64)]
        sure = [(x, y) for lo, k, chain in zip(cut[large], size[large], dealt[large]) for x, y in _forest(ns, pos, lo, lo + k, share, chain) if forest.join(int(own[x]), int(own[y]))]
        p, q = (np.array([e[i] for e in sure], np.int64) for i in (0, 1))
        joined = [np.minimum(ids[p], ids[q]), np.maximum(ids[p], ids[q]), np.zeros(len(p), np.int64), np.full(len(p), 1 << 20)]
        a, b, need, count = _tally(*(np.concatenate(c) for c in zip(counted, joined)))
        with np.errstate(over="ignore"):
            to = (mix(mix(a.view(np.uint64)) + b.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        ends = np.flatnonzero(np.repeat(dealt, size) & np.concatenate([[True], (keys[1:] != keys[:-1]) | (ns[1:] != ns[:-1])]))
        a, b, need, count = (np.concatenate(c) for c in zip((a, b, need, count), (keys[ends].view(np.int64), ids[ends], ns[ends], np.full(len(ends), -1))))
        to = np.concatenate([to, (mix(keys[ends]) % np.uint64(buckets)).astype(np.int64)])
        order = np.argsort(to, kind="stable")
        a, b, need, count, to = a[order], b[order], need[order].astype(np.int32), count[order].astype(np.int32), to[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        cols = [pa.array([c[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(to)))], pa.binary()) for c in (a, b, need, count)]
        return pa.table([pa.array(to[cut], pa.int64()), *cols], names=["bucket", "a", "b", "need", "count"])

    return job


def _counted(share: int):
    """Pairs seen often enough; those of the forests bring a count above any need. Parts of one key are chained by size."""

    def job(table: pa.Table) -> pa.Table:
        load = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]).astype(np.int64)
        a, b, need, count = load("a", np.int64), load("b", np.int64), load("need", np.int32), load("count", np.int32)
        ends = count < 0
        key, ids, ns = a[ends], b[ends], need[ends]
        order = np.lexsort((ids, ns, key))
        key, ids, ns = key[order], ids[order], ns[order]
        next_to = (key[1:] == key[:-1]) & (ns[:-1] * 100 >= ns[1:] * share) & (ids[1:] != ids[:-1])
        a, b, need, count = _tally(a[~ends], b[~ends], need[~ends], count[~ends])
        good = count >= need
        return pa.table({"a": pa.array(np.append(a[good], ids[:-1][next_to])), "b": pa.array(np.append(b[good], ids[1:][next_to]))})

    return job


def verified(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, share: int) -> tuple[list[int], list[int]]:
    """A forest of links between sets, exact for each two sets whose labels differ and that it doesn't join anyway.

    Sets outside the largest component so far are counted in turn against all that hold one of their keys (an
    inverted index), after a length filter; the count takes a key suffix only while the threshold is in reach.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.lexsort((ids, sizes))
    ids, sizes, label, sets = ids[order], sizes[order], label[order], [sets[i] for i in order]
    forest, first = Forest(len(ids)), {}
    for i, x in enumerate(label):
        forest.join(first.setdefault(x, i), i)
    links: tuple[list[int], list[int]] = ([], [])
    if len(first) < 2:
        return links
    if len(ids) == 2:
        if sizes[0] * 100 >= sizes[1] * share and len(np.intersect1d(*sets, assume_unique=True)) >= least(sizes[0], sizes[1], share):
            links[0].append(ids[0]), links[1].append(ids[1])
        return links
    keys, owner = np.concatenate(sets), np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    by = np.argsort(keys, kind="stable")
    first_of = np.concatenate([[True], keys[by][1:] != keys[by][:-1]])
    run = np.cumsum(first_of, dtype=np.int32) - 1
    begin = np.flatnonzero(first_of)
    length = np.diff(np.append(begin, len(by)))
    run_of = np.empty(len(by), np.int32)  # of each key as the sets stand
    run_of[by] = run
    owner_by, at = owner[by], np.concatenate([[0], np.cumsum(sizes)])
    del keys, owner, by, run
    done = np.zeros(len(ids), bool)
    roots = np.array([forest.root(i) for i in range(len(ids))])
    tally = np.bincount(roots, minlength=len(ids))

    def shared_with(x: int, lo: int, hi: int) -> np.ndarray:
        """How many of the keys lo..hi of set x each set holds."""
        runs = run_of[at[x] + lo : at[x] + hi]
        runs = runs[length[runs] > 1]
        return np.bincount(owner_by[gather(begin[runs], length[runs])], minlength=len(ids)) if len(runs) else np.zeros(len(ids), np.int64)

    while True:
        largest = roots == tally.argmax()
        rest = np.flatnonzero(~largest & ~done)
        if not len(rest):
            return links
        x = int(rest[0]) if done[largest].any() else int(np.flatnonzero(largest)[-1])
        done[x] = True
        near = (sizes * 100 >= sizes[x] * share) & (sizes * share <= sizes[x] * 100) & (roots != roots[x])
        if not near.any():
            continue
        need = least(sizes[x], sizes, share)
        head = int(sizes[x] - need[near].min() + 1)  # a partner's first shared key stands among these
        count = shared_with(x, 0, head)
        # suffix filter: what is still to come must suffice
        near &= (count > 0) & (count + np.minimum(sizes[x] - head, sizes - count) >= need)
        if not near.any():
            continue
        count = count + shared_with(x, head, int(sizes[x]))
        for y in np.flatnonzero(near & (count >= need)):
            p, q = roots[x], roots[y]
            if p != q:
                links[0].append(ids[x]), links[1].append(ids[y])
                roots[roots == max(p, q)] = min(p, q)
                tally[min(p, q)] += tally[max(p, q)]
                tally[max(p, q)] = 0


def _verify(share: int):
    def job(table: pa.Table) -> pa.Table:
        label, ids = table.column("label").to_numpy(), table.column("id").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        cluster = table.column("cluster").to_numpy()
        a, b = [], []
        order = np.argsort(cluster, kind="stable")
        cut = np.append(np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1]])), len(order))
        for lo, hi in zip(cut[:-1], cut[1:]):
            own = order[lo:hi]
            x, y = verified(ids[own], [sets[i] for i in own], label[own], share)
            a += x
            b += y
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return job


def _cells(extent):
    """Into how many cells so many keys are cut."""
    return F.greatest(F.ceil(extent / CELL_KEYS), F.least(F.lit(SPLIT_MOST), F.ceil(extent / SPLIT_KEYS)))


def _side(small: DataFrame) -> DataFrame:
    """One side of a join: sent to all tasks only if a count finds it small, so that a hot cluster isn't dealt to one task; a larger
    one is dealt out, and skewed parts are split at run time."""
    small, rows = counted(small, "side")
    return F.broadcast(small) if rows <= BROADCAST_ROWS else unsent(small, rows, BROADCAST_ROWS)


def _in_cells(member: DataFrame, *group: str) -> DataFrame:
    """id, n and the columns ``group`` -> the same with ``cells`` and ``cell`` of each group's rows, dealt by id. Only groups of several cells, each of
    more than SPLIT_KEYS keys, are joined with the rows."""
    extent = member.groupBy(*group).agg(_cells(F.sum("n")).alias("cells")).where("cells > 1")
    return member.join(_side(extent), list(group), "left").withColumn("cells", F.coalesce("cells", F.lit(1))).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells")))


def _verified(sets: DataFrame, share: int, tasks: int) -> DataFrame:
    """Links within cells; small clusters share a task, a cell of a larger one has its own group."""
    group = F.when(F.col("cells") > 1, F.xxhash64("cluster", "cell")).otherwise(F.pmod(F.xxhash64("cluster"), F.lit(16 * tasks)))
    return sets.select("id", "label", F.xxhash64("cluster", "cell").alias("cluster"), "keys", group.alias("task")).groupBy("task").applyInArrow(_verify(share), "a long, b long")


def _relabelled(wide: DataFrame, linked: DataFrame) -> DataFrame:
    """Members of those clusters that are still in several components, labelled with these."""
    own = wide.drop("label").join(linked.withColumnRenamed("component", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = own.groupBy("cluster").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("cluster")
    return materialise(own.join(_side(several), "cluster"), "wide")


def _grid(held: DataFrame, wide: DataFrame, share: int) -> DataFrame:
    """Links of the sets outside a cluster's largest component with each other and with those inside."""
    tally = wide.groupBy("cluster", "label").agg(F.sum("n").alias("keys"))
    largest = tally.groupBy("cluster").agg(F.max_by("label", F.struct("keys", -F.col("label"))).alias("bulk"))
    own = materialise(_in_cells(wide.join(_side(largest), "cluster").withColumn("rest", F.col("label") != F.col("bulk")).drop("bulk"), "cluster", "rest"), "cells")
    size = own.groupBy("cluster").agg(F.max(F.when(F.col("rest"), F.col("cells"))).alias("q"), F.max(F.when(~F.col("rest"), F.col("cells"))).alias("p"))
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    spot = lambda i, j, both: F.struct(i.alias("i"), j.alias("j"), F.lit(both).alias("both"))
    c = F.col("cell")
    outside = F.concat(
        F.transform(upto(F.col("p")), lambda j: spot(c, j, False)),
        F.transform(F.filter(upto(F.col("q")), lambda o: o != c), lambda o: spot(F.greatest(o, c), F.least(o, c), True)),
    )
    at = own.join(_side(size), "cluster").select("id", "label", F.explode(F.when(F.col("rest"), outside).otherwise(F.transform(upto(F.col("q")), lambda i: spot(i, c, False)))).alias("at"))
    sets = held.join(_side(at), "id").select("id", "label", F.xxhash64("cluster", "at").alias("cluster"), "keys")
    return sets.withColumn("task", F.col("cluster")).groupBy("task").applyInArrow(_verify(share), "a long, b long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, share: int = SHARE) -> DataFrame:
    """-> doc_id, n_shingles, component_id: one row per input row.

    A-Z are lower-cased and words are [^\\x20\\x09-\\x0D]+. A set holds the distinct shingles of ``width`` words, or the
    whole sequence where there are fewer. Two documents link when 100 * intersection >= ``share`` * union. Null,
    empty and blank texts have the empty set, 0 shingles, and link with nothing. Rows without an id link with nothing
    and have no component. Rows that repeat an id are one node of the links: each has its own set, and all of them the component.
    An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    heavy = spark.sparkContext.broadcast(heavy_shingles(docs, "text", width))
    sets = materialise(docs.mapInArrow(_sets(width, share, heavy, False), "doc_id long, n long, print_a long, print_b long, prefix binary"), "prefixes")
    some = sets.where("n > 0 and doc_id is not null")
    prints = ["print_a", "print_b", "n"]
    classes, n_classes = counted(some.groupBy(*prints).agg(F.min("doc_id").alias("id")), "classes")
    keys = some.agg(F.sum(F.length("prefix")) / 8).first()[0] or 0
    buckets = max(parts(spark), math.ceil(keys / BUCKET_KEYS))
    one_each = some.groupBy(*prints).agg(F.min(F.struct("doc_id", "prefix")).alias("r")).select("n", "r.*")
    dealt = one_each.select("doc_id", "n", "prefix").mapInArrow(_deal(buckets, BUCKET_KEYS), "bucket long, keys binary, ids binary, ns binary, pos binary")
    pairs = dealt.groupBy("bucket").applyInArrow(_candidates(share, buckets, BUCKET_KEYS), "bucket long, a binary, b binary, need binary, count binary")
    near = components(pairs.groupBy("bucket").applyInArrow(_counted(share), "a long, b long"))

    member = near.join(classes.select("id", "n"), "id").select("id", F.col("component").alias("cluster"), F.col("id").alias("label"), "n")
    member, count = counted(member, "members")
    if count <= BROADCAST_ROWS:
        texts = docs.withColumnRenamed("doc_id", "id").join(F.broadcast(member), "id").select("id", "cluster", "label", "n", F.col("id").alias("doc_id"), "text")
        held = texts.mapInArrow(_sets(width, share, heavy, True), "id long, cluster long, label long, n long, doc_id long, keys binary").drop("doc_id")
    else:  # a table of bits keeps most other texts out of the shuffle
        present = spark.sparkContext.broadcast(present_ids(member.select("id"), count))
        held = docs.where("doc_id is not null").mapInArrow(_sets(width, share, heavy, True, present), "doc_id long, keys binary")
        held = unsent(member, count, BROADCAST_ROWS).join(held.withColumnRenamed("doc_id", "id"), "id").select(*member.columns, "keys")
    held = materialise(held, "sets")
    first = _in_cells(held, "cluster")
    links = materialise(_verified(first, share, parts(spark)), "links")
    linked = components(links)
    wide = materialise(first.where("cells > 1").drop("cells", "cell", "keys"), "wide")
    for turn in ("representatives", "all"):
        wide = _relabelled(wide, linked)
        if wide.isEmpty():
            break
        if turn == "representatives":
            one = materialise(wide.groupBy("cluster", "label").agg(F.min_by(F.struct("id", "n"), F.struct(-F.col("n"), "id")).alias("r")).select("r.*", "cluster", "label"), "one")
            one = _in_cells(one, "cluster")
            more = _verified(held.drop("label").join(_side(one.select("id", "label", "cells", "cell")), "id"), share, parts(spark))
        else:
            more = _grid(held.drop("label"), wide, share)
        links = links.unionByName(materialise(more, "links"))
        linked = components(links)
    owner = classes.join(linked, "id", "left").select(*prints, F.coalesce("component", "id").alias("component"))
    out = some.join(unsent(owner, n_classes, BROADCAST_ROWS), prints).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.unionByName(sets.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
