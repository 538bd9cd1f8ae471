"""Extension: risk of each key over a stream of scored events, in sessions that end by themselves.

State is one row a key: the session that is open, with its highest severity and
score and its counts. An event-time timer closes a session that nothing has
been added to for `gap` behind the watermark and drops its state, so state
follows the keys that are active, not all that were ever seen. Each micro-batch
writes what changed under its own number; the last row of a session is what it
came to. A batch that is run again after a restart replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import SEVERITIES

STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Built here and not read by Spark, as workers have no session.
STATE = T.StructType([T.StructField(n, T.LongType()) for n in ("opened", "first", "last", "events", "severe", "rank", "score")])
#: Times inside the processor are microseconds since 1970, so that no time zone of a worker matters.
TIMES = ("opened", "first_event", "last_event")
RAW = "key string, opened long, first_event long, last_event long, events long, severe long, severity string, score int, closed boolean"
SESSIONS = "key string, opened timestamp, first_event timestamp, last_event timestamp, events long, severe long, severity string, score int, closed boolean"
#: Events of at least this rank count as severe.
SEVERE = SEVERITIES.index("high")


class RiskSessions(StatefulProcessor):
    def __init__(self, gap: timedelta) -> None:
        self.gap = gap // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", STATE)

    def _row(self, key: Any, s: list, closed: bool) -> tuple:
        opened, first, last, events, severe, rank, score = s
        return key[0], opened, first, last, events, severe, SEVERITIES[rank], score, closed

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SESSIONS.split(", ")])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("at")  # what one batch has for one key
        now = list(self.session.get()) if self.session.exists() else None
        out = []
        for ts, rank, score in zip(events["at"].tolist(), events["rank"].tolist(), events["score"].tolist(), strict=True):
            if now is not None and ts > now[2] + self.gap:
                out.append(self._row(key, now, True))
                now = None
            if now is None:
                now = [ts, ts, ts, 0, 0, 0, 0]
            now[1], now[2], now[3] = min(now[1], ts), max(now[2], ts), now[3] + 1
            now[4], now[5], now[6] = now[4] + (rank >= SEVERE), max(now[5], rank), max(now[6], score)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.session.update(tuple(now))
        self.handle.registerTimer((now[2] + self.gap) // 1000 + 1)
        yield self._frame([*out, self._row(key, now, False)])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.session.exists():
            now = list(self.session.get())
            self.session.clear()
            yield self._frame([self._row(key, now, True)])

    def close(self) -> None:
        pass


def risk_stream(events: DataFrame, output: str, checkpoint: str, gap: timedelta, delay: str = "1 day") -> StreamingQuery:
    """Starts the sessions of a stream of events(key string, ts timestamp, rank int, score int); batch n writes Parquet below output/batch=n. Stops by itself when what is there now is done.

    Events later than delay behind the watermark that belong to a closed session open one of their own.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(STATE_PROVIDER, ""):
        spark.conf.set(STATE_PROVIDER, ROCKS_DB)  # the only one that keeps several states of a key
    keyed = events.select("key", "ts", F.unix_micros("ts").alias("at"), "rank", "score").withWatermark("ts", delay).groupBy("key")
    sessions = keyed.transformWithStateInPandas(RiskSessions(gap), outputStructType=RAW, outputMode="Update", timeMode="EventTime")

    def save(batch: DataFrame, number: int) -> None:
        timed = batch.withColumns({c: F.timestamp_micros(c) for c in TIMES})
        timed.write.mode("overwrite").parquet(f"{output}/batch={number}")

    return sessions.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_sessions(spark: SparkSession, output: str) -> DataFrame:
    """The last row of every session."""
    rows = spark.read.schema(SESSIONS + ", batch long").option("basePath", output).parquet(output)
    newest = Window.partitionBy("key", "opened").orderBy(F.desc("batch"), F.desc("closed"))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n", "batch")


def batch_sessions(events: DataFrame, gap: timedelta) -> DataFrame:
    """The same sessions of a table: key, opened, last_event, events, severe, severity, score."""
    in_time = Window.partitionBy("key").orderBy("ts")
    new = (F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(in_time) > gap.total_seconds()) | F.lag("ts").over(in_time).isNull()
    numbered = events.withColumn("n", F.sum(new.cast("int")).over(in_time))
    severity = F.element_at(F.array(*map(F.lit, SEVERITIES)), F.max("rank") + 1)
    return numbered.groupBy("key", "n").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_event"), F.count("*").alias("events"), F.count_if(F.col("rank") >= SEVERE).alias("severe"), severity.alias("severity"), F.max("score").alias("score")).drop("n")
