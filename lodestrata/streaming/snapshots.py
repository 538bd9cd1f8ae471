"""Extension, beyond one-off scans: a stream of repository snapshots.

Rows arrive as a walk gives them (see sources/walk.py) with the time at which
each was taken. A snapshot that repeats a file's contents within the watermark
isn't classified again; each micro-batch is scanned as a job of its own, and
its findings are written under its number, so a batch that is run again
replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..limits import DEFAULT, ScanLimits
from ..plans.scan import scan_rows


def first_contents(rows: DataFrame, time_col: str = "taken_at", delay: str = "1 day") -> DataFrame:
    """Rows of a stream without those whose (repository, path, contents) came before within delay; rows without contents pass once."""
    keyed = rows.withColumn("sha256", F.coalesce(F.sha2("content", 256), F.lit("none")))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["repo_id", "path", "kind", "sha256"]).drop("sha256")


def scan_stream(rows: DataFrame, output: str, checkpoint: str, time_col: str = "taken_at", delay: str = "1 day", limits: ScanLimits = DEFAULT) -> StreamingQuery:
    """Starts the scan of a stream; findings of batch n are Parquet files under output/batch=n. Stops by itself when what is there now is done."""

    def scan(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            scan_rows(batch.drop(time_col), limits).findings.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return first_contents(rows, time_col, delay).writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
