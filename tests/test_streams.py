"""Streams over several batches: late rows, alerts that go on and off, counters that survive a repeated batch."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from phrasemill.operators import telemetry
from phrasemill.sources.keyed import KeyedTable
from phrasemill.streaming import alerts, jobs

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
LOG = "timestamp timestamp, name string, success boolean, severity_level int, client_type string"


def land(spark, path, rows, schema=LOG):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def failed(minute, name="f", ok=False):
    return (T0 + timedelta(minutes=minute), name, ok, 0, "PC")


#: Failing periods of five minutes 0, 1, 2 and then 6, 8, 9; successes in between and at the end move the watermark.
BATCHES = [
    [failed(1, "b"), failed(2, "a"), failed(7)],
    [failed(12), failed(13, ok=True), failed(6, "slow")],  # out of order, but within ten minutes
    [failed(32), failed(33, ok=True)],
    [failed(41), failed(46)],
    [failed(3, "late"), failed(90, ok=True)],  # the first is later than the watermark allows
    [failed(91, ok=True)],
]


@pytest.fixture
def landed(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in BATCHES:
        land(spark, path, batch)
    return path


def test_windows_close_once_and_drop_late_rows(spark, tmp_path, landed):
    stream = jobs.alert_windows(jobs.file_stream(spark, landed, LOG), "failure")
    got = jobs.drained(stream, str(tmp_path / "out"), str(tmp_path / "check")).select(F.col("window.start").alias("t"), "n", "names").collect()
    minutes = {int((r.t.replace(tzinfo=timezone.utc) - T0).total_seconds() // 60): (r.n, r.names) for r in got}
    assert minutes == {0: (2, "a, b"), 5: (2, "f, slow"), 10: (1, "f"), 30: (1, "f"), 40: (1, "f"), 45: (1, "f")} and len(got) == 6


def test_alert_changes_equal_the_batch_state(spark, tmp_path, landed):
    windows = jobs.alert_windows(jobs.file_stream(spark, landed, LOG), "failure")
    stream = alerts.alert_changes(windows, jobs.WIDTHS["failure"])
    got = sorted((r.t, r.alert) for r in jobs.drained(stream, str(tmp_path / "out"), str(tmp_path / "check")).select(F.col("window_start").alias("t"), "alert").collect())
    on_time = spark.createDataFrame([r for b in BATCHES for r in b if r[1] != "late"], LOG)
    batch = telemetry.alert_state(telemetry.windowed(telemetry.failures(on_time), "5 minutes"), "5 minutes").orderBy("window_start").collect()
    state, want = False, []
    for r in batch:
        if r.alert != state:
            state = r.alert
            want.append((r.window_start, state))
    if state:  # the batch series ends with its last failure; the stream goes on until the alert is off
        want.append((batch[-1].window_start + timedelta(minutes=10), False))
    assert got == want and len(want) == 4


def test_periods_are_judged_alike_at_once_and_step_by_step():
    rng = random.Random(2)
    for _ in range(300):
        failing = sorted(rng.sample(range(40), rng.randint(0, 15)))
        want, on = [], False
        for p in range(50):
            if (sum(p - 2 <= f <= p for f in failing) >= 2) != on:
                on = not on
                want.append((p, on))
        assert alerts.judged(failing, False, 0, 100, 1, 3, 2)[0] == want
        got, left, now, period, seen = [], [], False, 0, 0
        for until in sorted(rng.sample(range(60), 8)) + [100]:
            come = [f for f in failing if seen < f + 1 <= until]
            changes, left, now, period = alerts.judged(sorted({*left, *come}), now, period, until, 1, 3, 2)
            got, seen = got + changes, until
        assert got == want


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Two runs over one checkpoint give the windows of a single run."""
    path, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    for part in (BATCHES[:3], BATCHES[3:]):
        for batch in part:
            land(spark, path, batch)
        rows = jobs.drained(jobs.alert_windows(jobs.file_stream(spark, path, LOG), "failure"), out, check)
    assert rows.count() == 6


def test_keyed_table(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/table", "k string, v long, more string", ("k",), "v", buckets=4)
    df = lambda rows: spark.createDataFrame(rows, "k string, v long, more string, at int")
    look = lambda n=None: {r.k: (r.v, r.more) for r in table.read(n).collect()}
    assert look() == {}
    first = df([(f"k{i}", i, "a", 0) for i in range(20)] + [(None, 5, "null", 0), ("k3", 33, "later", 1)])
    assert table.upsert(first, 0, order="at") and look()["k3"] == (33, "later") and look()[None] == (5, "null") and len(look()) == 21
    assert not table.upsert(df([("k1", 999, "again", 0)]), 0) and look()["k1"] == (1, "a")  # a repeated batch
    assert table.upsert(df([("k1", 10, "b", 0), ("k2", None, "gone", 0), ("new", 7, "b", 0), (None, 6, "b", 0)]), 1)
    now = look()
    assert now["k1"] == (10, "b") and "k2" not in now and now["new"] == (7, "b") and now[None] == (6, "b") and len(now) == 21
    assert look(0)["k1"] == (1, "a") and "k2" in look(0)  # the version before, until compaction
    assert table.upsert(df([(f"k{i}", None, "", 0) for i in range(20)]), 5) and look() == {None: (6, "b"), "new": (7, "b")}
    table.compact()
    assert table.versions() == [5] and look() == {None: (6, "b"), "new": (7, "b")}


def test_counters_over_batches(spark, tmp_path):
    path, check = str(tmp_path / "ratings"), str(tmp_path / "check")
    schema = "source string, system_tone string, tone_override string, tags string"
    table = jobs.counters_table(spark, f"file://{tmp_path}/counters")
    for batch in ([("web", "pop", "niche", '["dull"]'), ("web", None, None, "[]")], [("web", "pop", "niche", "broken"), (None, "pop", "pop", '["dull"]')]):
        land(spark, path, batch, schema)
    for _ in range(2):  # the second run finds nothing new
        jobs.counted_into(jobs.file_stream(spark, path, schema), table, check).awaitTermination()
    want = {("source", "web"): 3, ("source", "unknown"): 1, ("tones", "pop->niche"): 2, ("tones", "pop->pop"): 1, ("tag", "dull"): 2}
    assert {(r.kind, r.value): r.n for r in table.read().collect()} == want and table.versions() == [0, 1]
    table.upsert(spark.createDataFrame([("source", "web", 100)], "kind string, value string, n long"), 1)
    assert {(r.kind, r.value): r.n for r in table.read().collect()} == want
