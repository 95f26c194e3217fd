"""Build tables: written once to the folder that driver and executors share, then read by all that follows."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_built: dict[tuple, str] = {}
_rows: dict[tuple, tuple[int, int | None]] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for an unset local session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-phrasemill-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there when the application ends is deleted."""
    path = f"{shared_dir(spark)}/phrasemill/{name}-{uuid.uuid4().hex}"
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    own.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(own)
    return path


def spread(df: DataFrame, least: int = 1 << 20) -> DataFrame:
    """Deals the rows of a table over all cores where its size (by the plan, of ``least`` bytes or more) gives fewer partitions than there are
    cores, for the sake of work that costs much a row; larger inputs have partitions enough and are left alone."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if least <= size < cores * (128 << 20) else df


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a plan that is used several times runs once, and a lost executor
    costs a re-read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, for those that don't have it installed. Spark takes a file name from one path only, so the
    file is named for this call: a copy of this module that was imported again can ship, too."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="spark-phrasemill-")) / f"{root.name}-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(to))
        _shipped.add(app)


def _version(spark: SparkSession, source: str) -> int:
    """A hash of the names, sizes and times of the source's files, so that a changed source is built anew."""
    top = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs, found = top.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for table in fs.listStatus(top):
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(table.getPath()) if table.isDirectory() else [table])]
    return hash(tuple(sorted(found)))


def build_table(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame], reads: Callable[[], DataFrame] | None = None) -> DataFrame:
    """The table ``name`` derived from ``source``, built on first use in this application and after a change of the source; how many rows it has (and
    how many ``reads`` had, the input that ``build`` then takes) is observed by the write itself."""
    key = (spark.sparkContext.applicationId, source, _version(spark, source), name)
    if key not in _built:
        path, n, seen = scratch(spark, name), Observation(), Observation()
        one = F.count(F.lit(1)).alias("rows")
        made = build() if reads is None else build(reads().observe(seen, one))
        made.observe(n, one).write.parquet(path)
        _built[key] = path
        _rows[key] = (n.get["rows"], None if reads is None else seen.get["rows"])
    return spark.read.parquet(_built[key])


def rows_built(spark: SparkSession, source: str, name: str) -> tuple[int, int | None]:
    """The rows of a built table, and of its observed input."""
    return _rows[(spark.sparkContext.applicationId, source, _version(spark, source), name)]


def forget_tables() -> None:
    """The next use of each table builds it anew."""
    _built.clear()
