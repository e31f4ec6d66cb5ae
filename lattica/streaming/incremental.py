"""Incremental document texts: a stream of new entity files, embedded once each, upserted by id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lattica.functions.text import doc_text

ENTITY = "qid string, title string, abstract string, version long"


def latest(rows: DataFrame) -> DataFrame:
    """Of each qid the row of the highest version."""
    w = Window.partitionBy("qid").orderBy(F.col("version").desc(), "doc_text")
    return rows.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def upsert_into(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer: each batch is one folder, named by the batch, so a batch that runs twice writes the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run_available(spark: SparkSession, source: str, path: str, checkpoint: str, per_batch: int = 100) -> None:
    """Takes the files of ``source`` that earlier runs haven't taken, and stops."""
    rows = spark.readStream.schema(ENTITY).option("maxFilesPerTrigger", per_batch).parquet(source)
    texts = rows.withColumn("doc_text", doc_text(F.coalesce("title", "qid"), F.col("abstract")))
    texts.writeStream.foreachBatch(upsert_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The index as it stands: the latest version of each qid over all batches."""
    return latest(spark.read.parquet(path).drop("batch"))
