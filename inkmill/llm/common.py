"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from inkmill.plans.stage import stage_folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder.

    A temporary folder stands in where ``spark.checkpoint.dir`` is unset and the
    master is local, as in tests; a cluster without it is an error.
    """
    stage_folder(spark)


def cut_lineage(df: DataFrame, keep_layout: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back from there.

    A Parquet table by default: later plans then know its size. A checkpoint
    keeps the estimates of the plan it came from (which multiply with each join
    of an iteration) but also its partitioning and order: ``keep_layout``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    if keep_layout:
        return df.checkpoint(eager=True)
    path = f"{df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().get()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches; afterwards a reused worker gives free memory back to the system."""

    def all_batches(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_batches


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library, which has no such call
