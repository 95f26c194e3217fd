"""Session helpers: the shared scratch folder, materialised tables, table reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from phrasemill.session import ship  # noqa: F401

#: A side of a join with more rows isn't sent through the driver, whatever its files' size.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for an unset local session (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-phrasemill-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/phrasemill/{name}-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)  # with the application
    df.write.option("parquet.block.size", 32 << 20).parquet(path, compression=compression)  # row groups that small executors hold
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written once and read back, and its rows as the write itself counts them."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, seen.get["rows"]


def unsent(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """A side of a join: with more than ``most`` rows the join sorts and merges. Spark would go by bytes on disk, of which a relation in the driver takes many times as many."""
    return df.hint("merge") if rows > (BROADCAST_ROWS if most is None else most) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id written as text: the fold key of the labelled operators."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def tokenizer_file(name: str) -> str:
    """Where the installed public vocabulary file is; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)
