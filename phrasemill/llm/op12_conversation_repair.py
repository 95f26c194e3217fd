"""Repair of conversations by the lightest derivation (Knuth's generalisation of shortest paths to hypergraphs).

A repaired conversation's roles read ``(s?(ua)+)?``. An item (i, q) says that the first i rows have been turned into a text whose last
role is q; it follows from an item before it together with an edit: K keeps a row, R gives it the role that is due, D deletes it, I inserts
an empty row. An item weighs (cost, audit), the edits' costs and their letters in order. Each deduction adds to both, so none is
lighter than its premises, and of two derivations of one item the lighter stays lighter whatever is added: letters at one cost are never the
beginning of one another, as more inserts cost more. An agenda pops the lightest item, which is then final, until the goal is.

A conversation may hold most rows, so it is cut into chunks of CHUNK rows. A chunk that isn't a whole conversation yields the items of all
pairs of roles before and after it, in parallel; neighbours are joined by deductions of two premises each, (before, between) and (between,
after), two by two. All that meets in one task of a conversation is 16 such items for each chunk, as long as the audit, which is one value of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.shared import materialise

SPACE = r"\x20\x09-\x0D"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Rows of a chunk (a power of two).
CHUNK_BITS = 9
#: What may follow no role, s, u and a, and the role that a new or changed row gets there.
START, STATES = "-", "-sua"
FOLLOWS = {"-": "su", "s": "u", "u": "a", "a": "u"}
DUE = {"-": "u", "s": "u", "u": "a", "a": "u"}
ENDS = "-a"
ROLES = {"u": "user", "a": "assistant"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
Item = tuple[int, str]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by a hash of the address: rows dropped, emptied, without ends, repeated, or of the wrong role."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    own = conversations.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("_copy")


def _deduced(codes: str, start: str) -> Iterator[tuple[str, Item]]:
    """The items of a chunk's rows after ``start``, lightest first: final role and (cost, audit) of those that hold all rows.

    ``codes`` has two letters a row: s, u, a or x for its role, and b (blank), d (duplicate), t (truncated) or - .
    """
    rows, final, agenda = len(codes) // 2, set(), [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        due = DUE[q]
        if i == rows:
            yield q, (cost, audit)
        else:
            role, fault = codes[2 * i], codes[2 * i + 1]
            heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
            if fault not in "bd":
                extra = CUT if fault == "t" else 0
                if role in FOLLOWS[q]:
                    heappush(agenda, (cost + KEEP + extra, audit + "K", i + 1, role))
                heappush(agenda, (cost + REROLE + extra, audit + "R", i + 1, due))
        heappush(agenda, (cost + INSERT, audit + "I", i, due))


@lru_cache(1 << 14)
def lightest(codes: str) -> Item:
    """Cost and audit of the lightest repair of a whole conversation: the first goal that the agenda pops."""
    return next(weight for q, weight in _deduced(codes, START) if q in ENDS)


@lru_cache(1 << 10)
def chunk_items(codes: str) -> dict[str, Item]:
    """The lightest items of a chunk by the roles before and after it."""
    return {q + r: weight for q in STATES for r, weight in _deduced(codes, q)}


def joined(left: dict[str, Item], right: dict[str, Item]) -> dict[str, Item]:
    """Items of two neighbouring spans -> those of both: two premises that share the role between them."""
    out: dict[str, Item] = {}
    for a, (cost, audit) in left.items():
        for b, (more, rest) in right.items():
            if a[1] == b[0]:
                found, key = (cost + more, audit + rest), a[0] + b[1]
                if key not in out or found < out[key]:
                    out[key] = found
    return out


def _illegal(codes: str) -> int:
    roles = codes[::2]
    return sum(x + y not in ("su", "ua", "au") for x, y in zip(roles, roles[1:]))


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (conv_id, chunk, codes, whole) -> conv_id, chunk, whole, first and last role, illegal neighbours, keys, costs, audits."""
    for batch in batches:
        d, out = batch.to_pydict(), []
        for codes, whole in zip(d["codes"], d["whole"]):
            items = {START + ENDS[1]: lightest(codes)} if whole else chunk_items(codes)
            out.append((codes[0], codes[-2], _illegal(codes), list(items), [w[0] for w in items.values()], [w[1] for w in items.values()]))
        cols = [list(c) for c in zip(*out)] or [[]] * 6
        types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.string()))
        arrays = [pa.array(c, t) for c, t in zip(cols, types)]
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("chunk"), batch.column("whole"), *arrays], ["conv_id", "chunk", "whole", "first", "last", "illegal", "keys", "costs", "audits"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans by conversation, in order -> conv_id, cost, audit, illegal. Spans of like length are joined, as carries in a counter."""
    now, stack, illegal, last = None, [], 0, ""

    def done() -> tuple:
        items = stack.pop()[1]
        while stack:
            items = joined(stack.pop()[1], items)
        return (now[0], *min(items[START + r] for r in ENDS if START + r in items), illegal)

    for batch in batches:
        d, out = batch.to_pydict(), []
        for conv, first, end, n, keys, costs, audits in zip(*(d[c] for c in ("conv_id", "first", "last", "illegal", "keys", "costs", "audits"))):
            if now != (conv,):
                if now:
                    out.append(done())
                now, stack, illegal, last = (conv,), [], 0, ""
            illegal += n + (last != "" and last + first not in ("su", "ua", "au"))
            last, size, items = end, 1, dict(zip(keys, zip(costs, audits)))
            while stack and stack[-1][0] == size:
                items, size = joined(stack.pop()[1], items), 2 * size
            stack.append((size, items))
        if out:
            yield _repairs(out)
    if now:
        yield _repairs([done()])


def _repairs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["conv_id", "cost", "audit", "illegal"])


class Repair:
    """The plan of a repair: ``known`` (a row for each conversation: its counts, cost and audit) and ``rows`` (in their order, by ``at``)."""

    def __init__(self, known: DataFrame, rows: DataFrame):
        self.known, self.rows = known, rows

    def _stream(self) -> DataFrame:
        """Each conversation's audit and then its rows in order, in one task; a batch of rows is held at a time."""
        head = self.known.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), *COUNTS)
        rest = self.rows.select("conv_id", "at", "role", "text", *(F.lit(None).cast("long").alias(c) for c in COUNTS))
        return head.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", "at")

    def repaired(self) -> DataFrame:
        """conv_id, place, role, text, edit: the repaired conversations' rows."""
        return self._stream().mapInArrow(_rewritten, "conv_id long, place long, role string, text string, edit string")

    def digests(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation."""
        return self._stream().mapInArrow(_digested, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Streams (conv_id, audit, counts) at the start of each conversation, then (role, text, edit) of its repaired rows; None ends a batch."""
    audit, at, q = "", 0, START

    def inserted() -> Iterator[tuple]:
        nonlocal at, q
        while at < len(audit) and audit[at] == "I":
            at, q = at + 1, DUE[q]
            yield ROLES[q], "", "I"

    for batch in batches:
        d = batch.to_pydict()
        for k, place in enumerate(d["at"]):
            role, text = d["role"][k], d["text"][k]
            if place < 0:
                yield from inserted()
                audit, at, q = text, 0, START
                yield d["conv_id"][k], audit, [d[c][k] for c in COUNTS]
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                q = role[0]
                yield role, text, edit
            elif edit == "R":
                q = DUE[q]
                yield ROLES[q], text, edit
        yield ()
    yield from inserted()


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, place, out = None, 0, []

    def block() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text", "edit"])

    for event in _followed(batches):
        if not event:
            yield block()
            out = []
        elif isinstance(event[2], list):
            conv, place = event[0], 0
        else:
            out.append((conv, place, *event))
            place += 1
    yield block()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, some, out = None, hashlib.sha256(), False, []

    def block() -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * (3 + len(COUNTS))
        types = [pa.int64()] * (1 + len(COUNTS)) + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["conv_id", *COUNTS, "audit", "repaired_sha256"])

    for event in _followed(batches):
        if not event:
            yield block()
            out = []
        elif isinstance(event[2], list):
            if now:
                out.append((now[0], *now[2], now[1], sha.hexdigest()))
            now, sha, some = event, hashlib.sha256(), False
        else:
            sha.update(f"{chr(10) if some else ''}{event[0]}:{event[1]}".encode())
            some = True
    if now:
        out.append((now[0], *now[2], now[1], sha.hexdigest()))
    yield block()


def _code() -> Column:
    """Two letters for a row: its role's initial, and its first fault."""
    role = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("cut"), "t").otherwise("-")
    return F.concat(F.when(role.isin("s", "u", "a"), role).otherwise("x"), fault)


def repair(conversations: DataFrame, every: DataFrame | None = None) -> Repair:
    """Rows (conv_id, turn, role, text) -> the plan of their repair.

    A conversation's rows are taken by turn, nulls first, then by role and a hash of the text. Null roles and texts count as one space, a role that is
    empty or starts with another letter fits nowhere. Rows without a conv_id are a conversation of their own. Conversations of ``every`` (a table
    with their conv_id) that have no rows get zeros and an empty audit. Texts of any length go through in batches of rows; other columns
    are left alone.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"))
    own = own.withColumns({"sha": F.sha2("text", 256), "row": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "role", "sha", "row"]
    own = own.repartitionByRange(*order).sortWithinPartitions(*order)
    seen = f"[^{SPACE}]"
    own = own.withColumns({"at": F.monotonically_increasing_id(), "blank": ~F.col("text").rlike(seen), "cut": ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")})
    rows = materialise(own.drop("row"), "rows")
    # the first row of each role and text: joined by the row's place, so that no text is a hot key
    first = rows.groupBy("conv_id", "role", "sha").agg(F.min("at").alias("first")).select("first")
    codes = rows.select("conv_id", "turn", "role", "at", "blank", "cut").join(first, F.col("at") == F.col("first"), "left")
    codes = materialise(codes.select("conv_id", "turn", "at", _code().alias("code")), "codes")
    fault = lambda k: F.count_if(F.substring("code", 2, 1) == k)
    counts = codes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), fault("b").alias("blank"), fault("d").alias("duplicate"), fault("t").alias("truncated"))
    wide = lambda c: c.cast("decimal(20,0)")
    span = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count(F.lit(1))
    gaps = codes.where("turn is not null").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("k")).groupBy("conv_id").agg(span.alias("gaps"))
    counts = materialise(_by_conversation(counts, gaps.withColumn("gaps", F.expr("try_cast(gaps as bigint)"))), "counts")
    chunk = F.shiftright("at", CHUNK_BITS).alias("chunk")
    chunks = codes.groupBy("conv_id", chunk).agg(F.array_sort(F.collect_list(F.struct("at", "code"))).alias("c"))
    chunks = chunks.select("conv_id", "chunk", F.size("c").alias("k"), F.array_join(F.transform("c", lambda x: x["code"]), "").alias("codes"))
    chunks = _by_conversation(chunks, counts.select("conv_id", "n")).select("conv_id", "chunk", "codes", (F.col("k") == F.col("n")).alias("whole"))
    spans = chunks.mapInArrow(_spans, "conv_id long, chunk long, whole boolean, first string, last string, illegal long, keys array<string>, costs array<long>, audits array<string>")
    spans = materialise(spans, "spans")
    whole = spans.where("whole").select("conv_id", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"), "illegal")
    cut = spans.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").drop("whole", "chunk")
    repairs = whole.unionByName(cut.mapInArrow(_folded, "conv_id long, cost long, audit string, illegal long"))
    known = (conversations if every is None else every).select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    known = _by_conversation(_by_conversation(known, counts.drop("n")), repairs)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return Repair(materialise(known.select("conv_id", *map(zero, COUNTS), F.coalesce("audit", F.lit("")).alias("audit")), "known"), rows.select("conv_id", "at", "role", "text"))


def _by_conversation(left: DataFrame, right: DataFrame) -> DataFrame:
    """A left join by conv_id, of which null is one; ``right`` has a row for each."""
    other = right.withColumnRenamed("conv_id", "_conv")
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")


def conversation_repair(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' digests, with a row for every original conv_id."""
    return repair(damaged(conversations), conversations).digests()
