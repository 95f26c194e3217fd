"""Mixing sources to target weights, native: blocks of words, multinomial counts per shard, pseudorandom permutations, an index join.

Each source is one stream of words (its documents one after the other), cut into blocks of one length. A source's quota is its target in
blocks of its mean length. Output shards draw how many slots each source gets; a source's slots are numbered through all shards, and
a slot's number is sent through a pseudorandom permutation of the source's blocks (a new one each time all blocks are used), so no
block is used more than once more than another. Everything is column expressions: a permutation is a swap-or-not shuffle of any
domain, keyed by md5, so slots find their blocks without a sort, and reruns agree at any partitioning.

The counts of the shards are multinomial given that all of a source's draws add up to its quota: slots are drawn from the quotas without
replacement. Free draws would miss small targets by their square root and could take a document more than three times.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemill.llm.shared import materialise, parts
from phrasemill.operators.ranges import running

SPACE = r"\x20\x09-\x0D"
#: Weights of the sources in order, repeating; a source gives at most MOST times its size.
WEIGHTS, MOST = (5, 2, 1), 3
#: Words of a block, and the blocks that a source is cut into at least: shorter blocks for a small source.
BLOCK, LEAST_BLOCKS = 512, 128
#: Slots of an output shard; rounds of the permutation; sources up to so many are sent to all tasks.
SHARD, ROUNDS, BROADCAST_ROWS = 4096, 24, 100_000
SALTS = 32


@dataclass
class Mix:
    """rows: row, doc_id, size, no, source, source_size, target, block, start (place of the document in its source's stream), and the text if it
    was kept. sources: no, source, source_size, target, block, blocks, slots. counts: no, blocks, shard, n, first."""

    rows: DataFrame
    sources: DataFrame
    counts: DataFrame


def word_count(text: Column) -> Column:
    """Runs of anything but white space, counted on a text of one letter a word, so that a long text makes no array; null has none."""
    once = F.regexp_replace(text, f"[{SPACE}]*+[^{SPACE}]++", "x")
    return F.coalesce(F.length(F.translate(once, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def _number(*key) -> Column:
    """52 bits of the key's md5."""
    text = F.concat_ws("|", *(k if isinstance(k, Column) else F.lit(str(k)) for k in key))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def permuted(x: Column, n: Column, *key) -> Column:
    """A permutation of 0 to n - 1 for each key: in every round x and its mirror image at a keyed point change places or not, by a bit that
    both of them hash alike."""
    key = F.concat_ws("|", *(k if isinstance(k, Column) else F.lit(str(k)) for k in key))

    def turn(at: Column, i: Column) -> Column:
        mirror = F.pmod(_number(key, "mirror", i) - at, n)
        return F.when(_number(key, "swap", i, F.greatest(at, mirror)) % 2 == 0, at).otherwise(mirror)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, turn)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, size of documents -> no, source, source_size, target: all words shared by weight, in the sources' order by code point with
    null last; what a source can't give (over ``most`` times its size) is shared among the others by weight until none is above.

    Each round is one aggregate of a row for each source; only two sums reach the driver.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = running(per, "count", F.lit(1), [F.col("source").isNull(), F.col("source")], "no")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("no") - 1) % len(weights) + 1).cast("int")).cast("long")
    per = materialise(per.withColumns({"weight": weight, "most": most * F.col("source_size")}), "sources")
    words, shares = per.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(1))).first()
    exact = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("decimal(19,0)")
    full = (0, 0)
    while True:
        above = exact(F.col("most")) * exact(shares - full[1]) < exact(F.col("weight")) * exact(words - full[0])
        found = tuple(per.where(above).agg(F.coalesce(F.sum("most"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first())
        if found == full or found[1] == shares:
            break
        full = found
    level = (words - full[0]) / max(1, shares - full[1])
    target = F.when(above, F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return per.select("no", "source", "source_size", target.alias("target"))


def _with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins each row with its source: broadcast while there are few; of many, each is salted, as one may have most rows."""
    if sources.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sources.withColumnRenamed("source", "_own")), F.col("source").eqNullSafe(F.col("_own"))).drop("_own")
    salted = sources.withColumnRenamed("source", "_own").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    return rows.withColumn("_mine", F.col("row") % SALTS).join(salted, F.col("source").eqNullSafe(F.col("_own")) & (F.col("_mine") == F.col("_salt"))).drop("_own", "_salt", "_mine")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, keep_text: bool = False) -> Mix:
    """Plans the mix of all documents. Documents are identified by row, so ids may be null or repeat; a null text has no words; a null source
    is a source of its own; other columns are left alone. Without any word nothing is taken.
    """
    text = F.col(text_col)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("_hash"), *([text.alias("text")] if keep_text else []))
    own = materialise(own.withColumn("row", F.monotonically_increasing_id()), "sizes")
    per = targets(own.select("source", "size"), weights, most)
    size = F.col("source_size")
    per = per.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(size / LEAST_BLOCKS))).cast("long")).withColumn("blocks", F.ceil(size / F.col("block")))
    slots = F.when(size > 0, F.least(most * F.col("blocks"), F.floor(F.col("blocks") * F.col("target") / size + 0.5))).otherwise(0).cast("long")
    sources = materialise(running(per.withColumn("slots", slots), "sum", F.col("slots"), [F.col("no")], "slots_end"), "quotas")
    rows = running(_with_sources(own, sources.drop("blocks", "slots", "slots_end")), "sum", F.col("size"), [F.col("doc_id"), F.col("_hash"), F.col("row")], "start", ("no",))
    return Mix(rows.withColumn("start", F.col("start") - F.col("size")).drop("_hash"), sources.drop("slots_end"), shard_counts(sources, seed))


def shard_counts(sources: DataFrame, seed: int = 0) -> DataFrame:
    """no, blocks, shard, n, first: how many slots of each shard each source gets, and the number of its first one.

    Every slot of every quota is sent to a place of the output by one permutation of all slots; places are counted by shard. Slots are
    made in chunks dealt over all tasks, so a source with most slots is no task's alone.
    """
    every = sources.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("every"))
    lo, chunk = F.col("slots_end") - F.col("slots"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / SHARD))).alias("chunk")
    chunks = sources.where("slots > 0").select("no", "blocks", "slots", lo.alias("lo"), chunk).repartition(parts(sources.sparkSession), "no", "chunk").crossJoin(F.broadcast(every))
    k = F.explode(F.sequence(F.col("chunk") * SHARD, F.least(F.col("slots"), (F.col("chunk") + 1) * SHARD) - 1)).alias("k")
    drawn = chunks.select("no", "blocks", "lo", "every", k)
    place = permuted(F.col("lo") + F.col("k"), F.col("every"), seed, "place")
    n = drawn.groupBy("no", "blocks", F.floor(place / SHARD).alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    ends = running(n, "sum", F.col("n"), [F.col("shard")], "end", ("no",))
    return materialise(ends.select("no", "blocks", "shard", "n", (F.col("end") - F.col("n")).alias("first")), "shards")


def slots(counts: DataFrame, seed: int = 0) -> DataFrame:
    """no, shard, slot (its number in the source), block: the shards' slots, a row each."""
    dealt = counts.repartition(parts(counts.sparkSession), "no", "shard")  # a few rows make very many: not the one task that reads their file
    own = dealt.select("no", "blocks", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    turn = F.floor(F.col("slot") / F.col("blocks")).cast("string")
    return own.select("no", "shard", "slot", permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), seed, F.col("no").cast("string"), turn).alias("index"))


def pieces(rows: DataFrame) -> DataFrame:
    """The rows, once for each block that they reach into, with its ``index`` and ``lo`` and ``hi``, the words of the document in it."""
    end, block = F.col("start") + F.col("size"), F.col("block")
    reach = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block)))
    own = rows.withColumn("index", F.explode_outer(reach))
    lo, hi = F.greatest(F.lit(0), F.col("index") * block - F.col("start")), F.least(F.col("size"), (F.col("index") + 1) * block - F.col("start"))
    return own.withColumns({"lo": lo, "hi": hi})


def taken(planned: Mix, seed: int = 0) -> DataFrame:
    """doc_id, size, source, source_size, target, taken: a row for each document with the words that the mix takes of it, repeats counted."""
    times = slots(planned.counts, seed).groupBy("no", "index").agg(F.count(F.lit(1)).alias("times"))
    own = pieces(planned.rows).select("row", "doc_id", "size", "source", "source_size", "target", "no", "index", (F.col("hi") - F.col("lo")).alias("words"))
    words = F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken")
    per = own.join(times.hint("merge"), ["no", "index"], "left").groupBy("row", "doc_id", "size", "source", "source_size", "target").agg(words)
    return per.select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed(planned: Mix, seed: int = 0) -> DataFrame:
    """shard, source, slot, index, text: the mix itself, a row for each slot with the words of its block, joined by index. Needs ``keep_text``."""
    words = F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), F.lit(0))
    own = pieces(planned.rows.where("size > 0").withColumn("words", words))
    own = own.select("no", "source", "index", F.struct(F.col("start").alias("start"), F.array_join(F.slice("words", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")), " ").alias("text")).alias("p"))
    whole = own.groupBy("no", "source", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), " ").alias("text"))
    return slots(planned.counts, seed).join(whole.hint("merge"), ["no", "index"]).select("shard", "source", "slot", "index", "text")


def source_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``taken`` of the mix of all documents."""
    return taken(mix(docs, id_col, text_col, source_col, seed), seed)
