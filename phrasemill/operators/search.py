"""Which of many phrases stand anywhere in the texts: automata over shards of the phrases, one pass of the texts for each."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phrasemill.session import materialise, ship

#: Characters of the phrases of a shard, which is broadcast and becomes one automaton in each Python worker.
SHARD_CHARS = 4_000_000


@lru_cache(2)
def _automaton(phrases: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for p in phrases:
        made.add_word(p, p)
    made.make_automaton()
    return made


def _least_ids(shared):
    """The least id of a partition's texts for each phrase that stands in one of them."""

    def job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, int] = {}
        phrases = tuple(p for p in shared.value if p)
        found = _automaton(phrases).iter if phrases else lambda text: ()
        every = "" in shared.value
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                for p in {p for _, p in found(text)}:
                    if i < least.get(p, i + 1):
                        least[p] = i
                if every and i < least.get("", i + 1):
                    least[""] = i
        yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.string()), pa.array(least.values(), pa.int64())], ["phrase", "id"])

    return job


def first_holders(phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """phrase; id, text -> phrase, id: the least id of the texts that hold the phrase anywhere, as ``contains`` does; phrases that none
    holds leave, the empty one stands in every text, null ones in none.

    Phrases are dealt into shards by a hash, as many as keep a shard within SHARD_CHARS (one longer phrase is a shard's most), and each shard goes over all
    texts once. A task returns a row for each phrase that it has found at most. Ids are longs; rows without one are left out.
    """
    spark = texts.sparkSession
    ship(spark)
    own = materialise(phrases.select("phrase").where("phrase is not null").distinct(), "phrases")
    chars = own.agg(F.coalesce(F.sum(F.length("phrase") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-2 * chars // SHARD_CHARS)) if chars > SHARD_CHARS else 1
    texts = texts.select(F.col("id").cast("long").alias("id"), "text").where("id is not null and text is not null")
    out = None
    for k in range(shards):
        few = own.where(F.pmod(F.xxhash64("phrase"), F.lit(shards)) == k) if shards > 1 else own
        shared = spark.sparkContext.broadcast(sorted(few.toPandas()["phrase"]))
        found = texts.mapInArrow(_least_ids(shared), "phrase string, id long")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("phrase").agg(F.min("id").alias("id"))
