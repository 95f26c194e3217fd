"""Conversation repair against all sequences of edits, with chunks of one row, null addresses, long conversations."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import pytest

from phrasemill.llm import op12_conversation_repair as op12

RNG = random.Random(5)
TEXTS = ["Fine.", "Yes!", "cut", "", " \t", None, "Why? ", "café.", "a\nb."]
ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "umpire"]
SCHEMA = "conv_id long, turn long, role string, text string, at long, audit string, cost string"


def conversations():
    rows = []
    for conv in [None, *range(-1, 30)]:
        for turn in range(RNG.randint(0, 4)):
            rows.append((conv, RNG.choice([turn, turn, turn, 2 * turn, None]), RNG.choice(ROLES), RNG.choice(TEXTS), 1, "x", "y"))
    return rows


def ordered(rows):
    own = [(t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x, *_ in rows]
    return sorted(own, key=lambda k: (k[0] is not None, k[0] or 0, k[1], hashlib.sha256(k[2].encode()).hexdigest()))


def plain(rows):
    """Counts, and of all sequences of edits with at most two inserts in each gap the cheapest and least."""
    own, faults, seen = ordered(rows), [], set()
    for _, role, text in own:
        last = re.sub(r"[\x20\x09-\x0d]+\Z", "", text)[-1:]
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    best = None
    for letters in itertools.product(*(["D"] if f in ("blank", "duplicate") else ["K", "R", "D"] for f in faults)):
        for gaps in itertools.product(range(3), repeat=len(own) + 1):
            audit = "".join("I" * g + x for g, x in zip(gaps, (*letters, "")))
            cost = sum({"K": 0, "R": 3, "D": 4, "I": 3}[x] for x in audit) + sum(3 for f, x in zip(faults, letters) if f == "truncated" and x != "D")
            if best and (cost, audit) >= best[:2]:
                continue
            made, it, due = [], iter(own), "user"
            for x in audit:
                row = next(it) if x != "I" else (0, "", "")
                if x == "D":
                    continue
                role = row[1] if x == "K" else due
                made.append((role, row[2]))
                due = "assistant" if role[:1] == "u" else "user"
            if re.fullmatch(r"(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in made)):
                best = (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    turns = [t for t, *_ in own if t is not None]
    initials = [r[:1] for _, r, _ in own]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, *best)


@pytest.mark.parametrize("bits", [0, 1, 9])
def test_lightest_repairs(spark, monkeypatch, bits):
    monkeypatch.setattr(op12, "CHUNK_BITS", bits)
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    every = spark.createDataFrame([(c,) for c in [None, *range(-1, 31)]], "conv_id long")
    per = defaultdict(list)
    for r in rows:
        per[r[0]].append(r)
    got = {r.conv_id: tuple(r)[1:] for r in op12.repair(df, every).digests().collect()}
    assert got == {c: plain(per[c]) for c in [None, *range(-1, 31)]}


def test_damage_and_rows(spark, small):
    docs = spark.read.parquet(f"{small}/conversations.parquet")
    kept = op12.damaged(docs).count()
    assert 0.8 * docs.count() < kept and op12.damaged(docs).where("text = ''").count() > 0
    plan = op12.repair(op12.damaged(docs), docs)
    known, made = {r.conv_id: r for r in plan.digests().collect()}, defaultdict(list)
    for r in plan.repaired().orderBy("conv_id", "place").collect():
        made[r.conv_id].append(r)
    assert set(known) == {r.conv_id for r in docs.select("conv_id").distinct().collect()}
    for c, r in known.items():
        text = "\n".join(f"{x.role}:{x.text}" for x in made[c])
        assert hashlib.sha256(text.encode()).hexdigest() == r.repaired_sha256
        assert "".join(x.edit for x in made[c]) == r.audit.replace("D", "") and [x.place for x in made[c]] == list(range(len(made[c])))


def test_long_conversation_is_joined_from_chunks(spark, monkeypatch):
    """One conversation of many chunks in several ranges, with a long text, against the agenda over all of it at once."""
    monkeypatch.setattr(op12, "CHUNK_BITS", 4)
    rows = [(7, i, RNG.choice(ROLES[:5]), RNG.choice(["a", "b."]) + str(RNG.randint(0, 150)) + RNG.choice(["", "."]) if i != 50 else "long " * 400_000, 0, "", "") for i in range(700)]
    got = op12.repair(spark.createDataFrame(rows, SCHEMA).repartition(5)).digests().collect()
    codes, seen = "", set()
    for _, role, text in ordered(rows):
        codes += role[0] + ("d" if (role, text) in seen else "-" if text[-1] in ".!?" else "t")
        seen.add((role, text))
    assert len(got) == 1 and (got[0].cost, got[0].audit) == op12.lightest(codes)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op12.conversation_repair(none).collect() == [] and op12.repair(none).repaired().collect() == []
    gone = op12.repair(none, spark.createDataFrame([(3,)], "conv_id long")).digests().collect()
    assert [tuple(r) for r in gone] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    far = spark.createDataFrame([(1, -(2**63), "user", "a.", 0, "", ""), (1, 2**63 - 1, "assistant", "b.", 0, "", "")], SCHEMA)
    assert op12.repair(far).digests().first().gaps == 0  # a span that no long holds
