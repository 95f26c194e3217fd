"""The index of templates kept up to date: new texts are merged into it, removed ones count negatively."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.operators.bibliography import not_yet_analyzed, templates
from phrasemill.operators.tagging import Tagger
from phrasemill.sources.keyed import KeyedTable


class PatternIndex:
    """A folder with the analysed texts (id, phrase, template) by version, the ids removed by version, and a keyed table of template -> count and
    the example of the least id. A version is committed with the table; one that is run again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.spark, self.path = spark, path.rstrip("/")
        self.table = KeyedTable(spark, f"{self.path}/index", f"template string, count long, id {id_type}, phrase string", ("template",), "count")
        self.rows, self.ids = f"id {id_type}, phrase string, template string", f"id {id_type}"

    def _versions(self, name: str, schema: str) -> DataFrame:
        """What the committed versions wrote, with the version."""
        last = max(self.table.versions(), default=-1)
        schema = f"{schema}, version long"
        self.spark.createDataFrame([], schema.rsplit(",", 1)[0]).limit(0).write.mode("append").parquet(f"{self.path}/{name}/version=-1")  # so that there is a folder
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("version").between(0, last))

    def analyzed(self) -> DataFrame:
        """id, phrase, template of the texts that the index counts."""
        gone = self._versions("removed", self.ids).withColumnsRenamed({"id": "_id", "version": "_version"})
        rows = self._versions("analyzed", self.rows)
        return rows.join(gone, (F.col("id") == F.col("_id")) & (F.col("_version") > F.col("version")), "left_anti").drop("version")

    def index(self) -> DataFrame:
        """template, count, example."""
        return self.table.read().select("template", "count", F.col("phrase").alias("example"))

    def add(self, texts: DataFrame, words: DataFrame, version: int, tagger: Tagger | None = None) -> bool:
        """Analyses those of the texts (id, phrase) that the index doesn't count yet, and merges them; False for a version that stands."""
        if version <= max(self.table.versions(), default=-1):
            return False
        new = templates(not_yet_analyzed(texts.select("id", "phrase"), self.analyzed()), words, tagger)
        to = f"{self.path}/analyzed/version={version}"
        new.select("id", "phrase", "template").write.mode("overwrite").parquet(to)
        more = self.spark.read.schema(self.rows).parquet(to).groupBy("template").agg(F.count(F.lit(1)).alias("more"), F.min(F.struct("id", "phrase")).alias("first"))
        merged = more.join(self.table.read(), "template", "left")
        least = F.least(F.col("first"), F.when(F.col("count").isNotNull(), F.struct("id", "phrase")))
        merged = merged.select("template", (F.col("more") + F.coalesce("count", F.lit(0))).alias("count"), least.alias("l"))
        return self.table.upsert(merged.select("template", "count", "l.id", "l.phrase"), version)

    def remove(self, ids: DataFrame, version: int) -> bool:
        """Takes the texts with these ids out: counts fall, and templates whose example goes get that of the least id left."""
        if version <= max(self.table.versions(), default=-1):
            return False
        now = self.analyzed()
        to = f"{self.path}/removed/version={version}"
        now.select("id").join(ids.select("id").distinct(), "id", "left_semi").write.mode("overwrite").parquet(to)
        gone = self.spark.read.schema(self.ids).parquet(to)
        less = now.join(gone, "id", "left_semi").groupBy("template").agg(F.count(F.lit(1)).alias("less"), F.min("id").alias("least"))
        held = less.join(self.table.read(), "template").withColumn("left", F.col("count") - F.col("less"))
        lost = held.where("left > 0 and least <= id").select("template")
        first = now.join(gone, "id", "left_anti").join(lost, "template", "left_semi").groupBy("template").agg(F.min(F.struct("id", "phrase")).alias("first"))
        held = held.join(first, "template", "left").withColumn("e", F.coalesce("first", F.struct("id", "phrase")))
        return self.table.upsert(held.select("template", F.when(F.col("left") > 0, F.col("left")).alias("count"), "e.id", "e.phrase"), version)
