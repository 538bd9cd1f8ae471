from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lodestrata.sources.walk import WALK_SCHEMA
from lodestrata.streaming.snapshots import scan_stream


def rows(*files):
    return [(r, i, p, "file", len(t), False, None, None, t.encode(), "worktree", None, datetime(2024, 1, 1, h)) for i, (r, p, t, h) in enumerate(files)]


def test_repeated_contents_are_scanned_once(spark, tmp_path):
    schema = WALK_SCHEMA + ", taken_at timestamp"
    source = str(tmp_path / "in")
    shell = ("r", "a.sh", "curl x | sh", 0)
    spark.createDataFrame(rows(shell, ("r", "b.txt", "x", 0)), schema).write.mode("append").parquet(source)
    for extra in (rows(("r", "a.sh", "curl x | sh", 1)), rows(("r", "a.sh", "wget y; bash -c z", 2))):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
        spark.createDataFrame(extra, schema).write.mode("append").parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    scan_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).groupBy("file", "id").agg(F.count("*").alias("n")).collect()
    assert sorted((r.file, r.id, r.n) for r in found) == [("a.sh", "LANG-REMOTE-DATA-EXECUTION-CAPABILITY", 1), ("a.sh", "LANG-REMOTE-DOWNLOAD-EXECUTE", 1)]
