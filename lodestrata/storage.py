"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}  # application: folder of this process, for local sessions without a shared folder
_tables: dict[str, str] = {}  # path: name of the catalog's table over it
_noted: list[list[str]] = []  # of each open noting(), innermost last


def work_dir(spark: SparkSession) -> str:
    """The folder for cut lineage, one for each application, below the session's spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder that goes with
    the process; on a cluster no folder of the driver's would do, so that is an
    error.
    """
    application = spark.sparkContext.applicationId
    if shared := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return f"{shared.rstrip('/')}/lodestrata-{application}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if application not in _own:
        _own[application] = tempfile.mkdtemp(prefix="lodestrata-")
        atexit.register(shutil.rmtree, _own[application], ignore_errors=True)
    return _own[application]


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back, so that what follows depends on files and not on executors."""
    path = f"{work_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable_by(df: DataFrame, label: str, key: str | list[str], n: int) -> DataFrame:
    """As durable, dealt by key, or several, into n buckets, which a later join or group by key reads as they are, without a shuffle.

    Spark knows of buckets by name only, so this is an external table of the session's catalog, until it is removed.
    """
    name = f"{label}-{uuid.uuid4().hex}"
    path = f"{work_dir(df.sparkSession)}/{name}"
    for paths in _noted:
        paths.append(path)
    table = f"lodestrata_{name.replace('-', '_')}"
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    _tables[path] = table
    return df.sparkSession.table(table)


@contextlib.contextmanager
def noting() -> Iterator[list[str]]:
    """The paths of the tables that are written inside."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        for table in [p for p in _tables if p == path or p.startswith(f"{path}/")]:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(table)}")
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clean(spark: SparkSession) -> None:
    """Removes what this application has written to the shared folder. Tables that rest on it can't be read afterwards."""
    remove(spark, work_dir(spark))
