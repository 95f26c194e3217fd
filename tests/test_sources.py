"""Readers over files written here, streams against batches."""

import gzip
import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from phrasemill import session
from phrasemill.llm import shared
from phrasemill.operators import feedback
from phrasemill.sources import readers, writers
from phrasemill.streaming import jobs


def marc_record(fields, order=None, coding="a", encoding="utf-8", length=None, base=None):
    """A record by hand: ``order`` puts the fields' data into the data area in another order than the directory has."""
    data = [d.encode(encoding) if isinstance(d, str) else d for _, d in fields]
    starts, area = {}, b""
    for k in order or range(len(data)):
        starts[k] = len(area)
        area += data[k] + b"\x1e"
    directory = "".join(f"{tag}{len(d) + 1:04d}{starts[k]:05d}" for k, ((tag, _), d) in enumerate(zip(fields, data))).encode() + b"\x1e"
    at = 24 + len(directory)
    whole = at + len(area) + 1
    leader = f"{whole if length is None else length:05d}nam {coding}22{at if base is None else base:05d} a 4500".encode()
    return leader + directory + area + b"\x1d"


def test_marc(spark, tmp_path):
    title = "10\x1faRace é日 /\x1fbPower, Faith, and the rise of it /"
    good = [("008", "x" * 35 + "eng d"), ("010", "  \x1fa 89-83818 "), ("245", title)]
    old = [("245", b"10\x1faR\xe2ev\xe8olution, \xa1o\xe1\xe2a\x1fbplain")]
    records = [
        marc_record(good), marc_record(good, order=[2, 0, 1]), marc_record([("020", ""), *good, ("500", "")]), marc_record([("245", "00\x1faOnly a title")]), marc_record(old, coding=" "),
        marc_record([("245", b"10\x1fabad \xff byte\x1fbx")]), marc_record([]),
        # skipped: too short, of another length, data that begin elsewhere, a field outside the record
        b"broken\x1d", marc_record(good, length=77), marc_record(good, base=99), marc_record(good, base=99998), marc_record(good)[:-30] + b"\x1d",
    ]
    (tmp_path / "part01.mrc").write_bytes(b"".join(records))
    read = readers.read_marc(spark, str(tmp_path))
    assert read.count() == 7 and sorted(len(r.fields) for r in read.collect()) == [0, 1, 1, 1, 3, 3, 5]
    got = sorted((r.title or "", r.raw_subtitle, r.lccn, r.fixed[35:38] if r.fixed else None) for r in readers.marc_subtitles(read).collect())
    whole = ("Race é日 /", "Power, Faith, and the rise of it /", "89-83818", "eng")
    assert got == [("", None, None, None), ("Only a title", None, None, None), whole, whole, whole, ("Rév\u00f6lution, Ło\u00e0\u0301", "plain", None, None), ("bad \ufffd byte", "x", None, None)]


def test_marc_of_many_splits(spark, tmp_path):
    """A file read in pieces of a few hundred bytes has the records of the whole; what the writer writes has true lengths and starts."""
    rows = [(i, "é" * (i % 50) + f"title {i}") for i in range(300)]
    fields = F.array(F.struct(F.lit("001").alias("tag"), F.col("id").cast("string").alias("data")), F.struct(F.lit("245").alias("tag"), F.concat(F.lit("10\x1fa"), "t").alias("data")))
    writers.write_marc(spark.createDataFrame(rows, "id long, t string").coalesce(1).select(fields.alias("fields")), str(tmp_path / "out"))
    data = next((tmp_path / "out").glob("part*")).read_bytes()
    assert data.split(b"\x1d")[:-1] == [marc_record([("001", str(i)), ("245", f"10\x1fa{t}")])[:-1].replace(b" a 4500", b"   4500") for i, t in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 700)
    try:
        read = readers.read_marc(spark, str(tmp_path / "out"))
        assert read.rdd.getNumPartitions() > 20
        got = sorted((int(r.i), r.t) for r in read.select(readers.field("001").alias("i"), readers.subfield("245", "a").alias("t")).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == rows


def test_editions_dump(spark, tmp_path):
    e = {"title": "T", "subtitle": "a, b, and the c of d", "languages": [{"key": "/languages/eng"}], "isbn_10": [" 123 "], "works": [{"key": "/works/1"}]}
    lines = [f"/type/edition\tk1\t1\t2020\t{json.dumps(e)}", "/type/work\tk2\t1\t2020\t{}", "short line", "/type/edition\tk3\t1\t2020\tnot json", f"/type/edition\tk4\t1\t2020\t{json.dumps({'title': 'no subtitle'})}"]
    with gzip.open(tmp_path / "dump.txt.gz", "wt") as f:
        f.write("\n".join(lines))
    got = readers.edition_rows(readers.read_editions_dump(spark, str(tmp_path / "dump.txt.gz"), 2)).collect()
    assert [(r.title, r.lang, r.isbn, r.work_key, r.lccn) for r in got] == [("T", "eng", "123", "/works/1", None)]


def test_ratings_stream_drops_repeats_and_splits(spark, tmp_path):
    rows = [(f"k{i % 6}", "s" if i else "", 1, None, "[]", 1700000000 + i) for i in range(12)]
    df = spark.createDataFrame(rows, "row_key string, subtitle string, thumbs int, tone_override string, tags string, t long").withColumn("created_at", F.timestamp_seconds("t")).drop("t")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), df.schema)
    jobs.ingest_ratings(stream, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "check")).awaitTermination()
    good, bad = spark.read.parquet(str(tmp_path / "good")), spark.read.parquet(str(tmp_path / "bad"))
    assert good.count() + bad.count() == 6 and bad.first().error == "subtitle is required"


def test_summary_needs_ten(spark):
    rows = [(i, "pop" if i % 3 else None, 1 if i < 5 else -1, ("pop" if i % 2 else "niche"), i) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, system_tone string, thumbs int, tone_override string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    one = feedback.summary(df).first()
    assert (one.total_ratings, one.thumbs_rated, one.tone_pairs, one.tone_accuracy) == (12, 12, 8, 0.5)
    assert feedback.summary(df.where("id < 9")).count() == 0


def test_package_is_sent_once(spark, monkeypatch):
    """Executors take a file name from one path only: engine and operators send one file a session, and one sent later has another name."""
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: sent.append(path.rsplit("/", 1)[-1]))
    monkeypatch.setattr(session, "_shipped", set())
    shared.ship(spark)
    session.ship(spark)
    assert len(sent) == 1
    session._shipped.clear()
    session.ship(spark)
    assert len(set(sent)) == 2


TWO_JVMS = """
import sys
from pyspark import SparkContext
from pyspark.sql import SparkSession
sys.path.insert(0, sys.argv[1])
from phrasemill.sources import readers
for _ in range(2):
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    print([r.fields[0].data for r in readers.read_marc(spark, sys.argv[2]).collect()])
    spark.stop()
    SparkContext._gateway.shutdown()
    SparkContext._gateway.proc.stdin.close()
    SparkContext._gateway = SparkContext._jvm = None
"""


def test_marc_after_a_restart_of_the_jvm(tmp_path):
    """Nothing that readers keep is bound to a JVM that has ended."""
    (tmp_path / "one.mrc").write_bytes(marc_record([("245", b"10\x1faCaf\xe2e")], coding=" "))
    root = str(Path(readers.__file__).resolve().parents[2])
    ran = subprocess.run([sys.executable, "-c", TWO_JVMS, root, str(tmp_path / "one.mrc")], capture_output=True, text=True, timeout=120)
    assert ran.stdout.splitlines() == [str(["10\x1faCafé"])] * 2, ran.stderr[-1000:]
