"""Shared helpers of the training-data operators: table access, shared scratch tables, Arrow batch bounds."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..sources.storage import shared_dir

#: Rows of whole texts that one Arrow batch may hold; bounds a Python worker's memory by batch, not by partition.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/terrane-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bound what one Arrow batch holds; takes effect when the plan runs, so it stays set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_kept: dict[Any, Any] = {}


def kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task under this key; it takes the place of whatever the worker kept before."""
    if key not in _kept:
        release()
        _kept[key] = make()
    return _kept[key]


def release() -> None:
    """Let go of what earlier stages left in this worker, and give freed memory back to the system. Workers outlive stages,
    so without this an executor holds the sum of what its stages needed, not the most."""
    _kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def text_key(text: Column) -> Column:
    """A 32-byte key that equal texts share; null for null."""
    return F.unhex(F.sha2(text, 256))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def small_side(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast df only where its counted rows stay within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= bound else df
