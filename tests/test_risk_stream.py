"""Risk sessions of a stream against those of the whole table, through a restart, and their expiry."""

from datetime import datetime, timedelta

from lodestrata.streaming.risk import batch_sessions, latest_sessions, risk_stream

EVENTS = "key string, ts timestamp, rank int, score int"
GAP = timedelta(hours=6)
COLUMNS = ["key", "opened", "last_event", "events", "severe", "severity", "score"]


def events(lo, hi):
    start = datetime(2024, 1, 1)
    return [(f"k{i % 7}", start + timedelta(minutes=37 * i + (600 if i % 50 > 40 else 0) * (i // 50)), i * 7 % 5, i * 13 % 100) for i in range(lo, hi)]


def rows(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def test_stream_equals_batch_through_a_restart(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for lo, hi in ((0, 200), (200, 420), (420, 500)):  # each a start of the query from its checkpoint
        spark.createDataFrame(sorted(events(0, 500), key=lambda e: e[1])[lo:hi], EVENTS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        risk_stream(stream, out, state, GAP, "10 minutes").awaitTermination(180)
    expected = rows(batch_sessions(spark.createDataFrame(events(0, 500), EVENTS), GAP))
    found = latest_sessions(spark, out)
    assert rows(found) == expected
    closed = {tuple(r) for r in found.filter("closed").select("key", "opened").collect()}
    last = max(e[1] for e in events(0, 500))
    for key, opened, end, *_ in expected:  # what lies far enough behind the watermark has expired
        assert ((key, opened) in closed) or end + GAP >= last - timedelta(hours=1)
