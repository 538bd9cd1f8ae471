"""Given tables seen as repositories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals a table that few tasks would read over all cores, for work that costs more than moving the rows; larger tables have partitions enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of the repository named after its source."""
    return spread(table(spark, sf_dir, "documents")).select(
        F.col("source").alias("repo_id"),
        F.col("doc_id").alias("seq"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.lit("file").alias("kind"),
        F.octet_length(F.encode("text", "UTF-8")).cast("long").alias("size"),
        F.lit(False).alias("readonly"),
        F.lit(None).cast("int").alias("mode"),
        F.lit(None).cast("string").alias("symlink_target"),
        F.encode("text", "UTF-8").alias("content"),
        F.lit("worktree").alias("origin"),
    )
