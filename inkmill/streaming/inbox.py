"""Translations that arrive over time: a stream of (doc_id, unit_id, zh) rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "doc_id long, unit_id string, zh string, at timestamp"


def read_inbox(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each unit."""
    return rows.groupBy("doc_id", "unit_id").agg(F.max_by("zh", "at").alias("zh"), F.max("at").alias("at"))


def follow(inbox: DataFrame, store: str, checkpoint: str):
    """Append each batch's latest rows to ``store``, one folder per batch of one checkpoint.

    A repeated batch overwrites itself. Batch numbers begin anew with a new
    checkpoint, so the checkpoint's path is part of the folder's name.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def save(batch: DataFrame, number: int) -> None:
        latest(batch).write.mode("overwrite").parquet(f"{store}/run={run}/batch={number}")

    return inbox.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    return latest(spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(store).select("doc_id", "unit_id", "zh", "at"))
