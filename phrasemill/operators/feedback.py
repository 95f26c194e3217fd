"""Ratings: validation, filters, incremental pull, summaries, reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from phrasemill.functions import words as lists

LEAST_RATINGS = 10


def tags_of(tags: Column) -> Column:
    """A JSON array of strings; broken JSON counts as none."""
    return F.coalesce(F.from_json(tags, "array<string>"), F.array().cast("array<string>"))


def rating_error(subtitle: Column, thumbs: Column, tone: Column, tags: Column) -> Column:
    """Why a rating is rejected, null for a good one; ``tags`` is an array."""
    return (
        F.when(F.coalesce(subtitle, F.lit("")) == "", "subtitle is required").when(thumbs.isNotNull() & ~thumbs.isin(1, -1), "thumbs must be 1 or -1")
        .when((F.coalesce(tone, F.lit("")) != "") & ~tone.isin(*lists.TIERS), "unknown tone").when(F.size(F.array_except(tags, F.array(*map(F.lit, lists.TAGS)))) > 0, "unknown tag")
    )


def request_error(tone: Column, locks: Column) -> Column:
    """Why a generation request is rejected: ``tone`` is a comma list, ``locks`` a map."""
    tones = F.filter(F.transform(F.split(F.coalesce(tone, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    keys = F.coalesce(F.map_keys(locks), F.array().cast("array<string>"))
    known = F.array(*map(F.lit, ("item1", "item2", "action_noun", "of_object", *lists.PART_SLOTS)))
    has = lambda *names: F.arrays_overlap(keys, F.array(*map(F.lit, names)))
    return (
        F.when(F.size(F.array_except(tones, F.array(*map(F.lit, lists.TIERS)))) > 0, "unknown tone").when(F.size(F.array_except(keys, known)) > 0, "unknown lock")
        .when(has("of_modifier", "of_head") & has("of_topic", "of_complement"), "mixed part locks").when(has("of_object") & has(*lists.PART_SLOTS), "object and part locks")
    )


def select_ratings(ratings: DataFrame, since: str | None = None, source: str | None = None) -> DataFrame:
    if since is not None:
        ratings = ratings.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return ratings if source is None else ratings.where(F.col("source") == source)


def pull_new(remote: DataFrame, held: DataFrame, since, key: str = "row_key") -> DataFrame:
    """Remote rows with a key from ``since`` on that aren't held yet."""
    return remote.where(F.col(key) >= since).join(held.select(key), key, "left_anti")


def newest(ratings: DataFrame, n: int) -> DataFrame:
    """The newest n by time, ties by id (a top-n, not a full sort)."""
    return ratings.orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def summary(ratings: DataFrame, n: int = 50) -> DataFrame:
    """One row over the newest n, none under LEAST_RATINGS: totals, approval rate, tone pairs and accuracy."""
    pair = F.col("system_tone").isNotNull() & F.col("tone_override").isNotNull()
    out = newest(ratings, n).agg(
        F.count(F.lit(1)).alias("total_ratings"), F.count("thumbs").alias("thumbs_rated"),
        F.avg(F.when(F.col("thumbs").isNotNull(), (F.col("thumbs") == 1).cast("int"))).alias("approval_rate"),
        F.count_if(pair).alias("tone_pairs"), F.avg(F.when(pair, (F.col("system_tone") == F.col("tone_override")).cast("int"))).alias("tone_accuracy"),
    )
    return out.where(F.col("total_ratings") >= LEAST_RATINGS)


def mismatches(ratings: DataFrame, n: int = 50, top: int = 5) -> DataFrame:
    """pattern, count: the most common differences, ties by pattern."""
    own = newest(ratings, n).where("system_tone <> tone_override").select(F.concat(F.lit("system="), "system_tone", F.lit(" but human="), "tone_override").alias("pattern"))
    return own.groupBy("pattern").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "pattern").limit(top)


def tag_counts(ratings: DataFrame, n: int | None = 50) -> DataFrame:
    own = ratings if n is None else newest(ratings, n)
    return own.select(F.explode(tags_of(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def recent(ratings: DataFrame, col: str, among: int, keep: int) -> DataFrame:
    """The first ``keep`` non-empty values of ``col`` among the newest rows, newest first."""
    own = newest(ratings, among).where(F.coalesce(F.col(col).cast("string"), F.lit("")) != "")
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(keep).select("id", col)


def review(ratings: DataFrame, n: int = 100) -> DataFrame:
    """direction, count, share of the newest n: ``match`` and each mismatch."""
    own = newest(ratings, n).where("system_tone is not null and tone_override is not null")
    kind = F.when(F.col("system_tone") == F.col("tone_override"), "match").otherwise(F.concat_ws("->", "system_tone", "tone_override"))
    out = own.groupBy(kind.alias("direction")).agg(F.count(F.lit(1)).alias("count"))
    return out.crossJoin(F.broadcast(own.agg(F.count(F.lit(1)).alias("total")))).select("direction", "count", (F.col("count") / F.col("total")).alias("share"))


def mismatch_examples(ratings: DataFrame, n: int = 100, most: int = 10) -> DataFrame:
    own = newest(ratings, n).where("system_tone <> tone_override")
    return own.orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id", "system_tone", "tone_override", "subtitle")


def spot_check_stats(results: DataFrame) -> DataFrame:
    """session, batch, felt, target, skipped -> rated, correct, skipped and accuracy per batch and per session (batch null)."""
    rated = ~F.col("skipped")
    out = results.groupingSets([["session", "batch"], ["session"]], "session", "batch").agg(
        F.count_if(rated).alias("rated"), F.count_if(rated & (F.col("felt") == F.col("target"))).alias("correct"), F.count_if(F.col("skipped")).alias("skipped")
    )
    return out.withColumn("accuracy", F.when(F.col("rated") > 0, F.col("correct") / F.col("rated")).otherwise(0.0))


def spot_check_thumbs(felt: Column, target: Column, skipped: Column) -> Column:
    return F.when(~skipped, F.when(felt == target, 1).otherwise(-1))


def scores_by_filler(texts: DataFrame, fillers: DataFrame) -> DataFrame:
    """id, filler -> freq and popularity by the filler alone, unknown ones (1, null); of several slots the first by name, then id order."""
    dim = fillers.groupBy("filler").agg(F.min_by(F.struct("freq", "popularity"), "slot_type").alias("f"))
    return texts.join(dim, "filler", "left").select("id", "filler", F.coalesce("f.freq", F.lit(1)).alias("freq"), F.col("f.popularity").alias("popularity"))


def scores_by_slot(samples: DataFrame, fillers: DataFrame, missing: float | None = 0.1, case_sensitive: bool = True) -> DataFrame:
    """samples with slot_type and filler -> the same with freq and popularity by both, unknown ones (0, ``missing``).

    Without case, spellings of a filler count together: their frequencies are summed and the highest popularity is taken.
    """
    key = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
    dim = fillers.groupBy(key("filler").alias("k"), F.col("slot_type").alias("st")).agg(F.sum("freq").alias("f"), F.max("popularity").alias("p"))
    found = samples.join(dim, (key("filler") == F.col("k")) & (F.col("slot_type") == F.col("st")), "left")
    return found.select(*samples.columns, F.coalesce("f", F.lit(0)).alias("freq"), (F.col("p") if missing is None else F.coalesce("p", F.lit(missing))).alias("popularity"))


def histogram_overlap(scores: DataFrame, group: str, one: str, other: str, bins: int = 10, lo: float = 0.0, hi: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """overlap and separation of two groups' score histograms (clipped to the range, each summing to 1), for each ``by``."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("score") - lo) / ((hi - lo) / bins)).cast("int")))
    n = scores.where(F.col(group).isin(one, other)).groupBy(*by, b.alias("bin")).agg(F.count_if(F.col(group) == one).alias("x"), F.count_if(F.col(group) == other).alias("y"))
    whole = W.partitionBy(*by)  # ``bins`` rows
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(whole), F.lit(1))
    return n.select(*by, F.least(share("x"), share("y")).alias("m")).groupBy(*by).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("overlap")).withColumn("separation", 1 - F.col("overlap"))


def with_snapshot(ratings: DataFrame, params: DataFrame) -> DataFrame:
    """Adds ``config_snapshot``: the parameters in force, as a map on each rating."""
    one = params.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("config_snapshot"))
    return ratings.crossJoin(F.broadcast(one))
