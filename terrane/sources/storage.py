"""Written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: str | None = None
#: Most buckets of a table, fewer than the 100,000 that Spark allows.
BUCKETS = 50_000
#: How written tables are compressed.
CODEC = "zstd"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is named, on a single machine."""
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or f"file://{tempfile.mkdtemp(prefix='terrane-')}"
    return _own_dir


def scratch(spark: SparkSession, label: str) -> str:
    """A new path there."""
    return f"{shared_dir(spark)}/terrane-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df there as a Parquet table and read it back, so that it is computed once and survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.option("compression", CODEC).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, label: str, key: str, buckets: int, *order: str, dealt: bool = False) -> DataFrame:
    """The same as a bucketed table of a new name: all rows of a key lie in one bucket, sorted.

    Spark knows how they lie, so what is grouped by the key and more is not dealt again. dealt: the rows lie so already.
    """
    path, n = scratch(df.sparkSession, label), min(buckets, BUCKETS)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    (df if dealt else df.repartition(n, key)).write.bucketBy(n, key).sortBy(*order).option("path", path).option("compression", CODEC).saveAsTable(name)
    return df.sparkSession.table(name)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds gapless numbers from 0 in the order of some columns, without a task that takes all rows.

    The sorted rows are written with their partition and their place in it; only one count a partition is summed up.
    """
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in the 33 lower ones
    rows = stored(df.orderBy(*order).withColumns({"part_": F.shiftright(place, 33), "place_": place.bitwiseAND((1 << 33) - 1)}), "numbered")
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", before.alias("before_"))  # one row a partition
    return rows.join(F.broadcast(starts), "part_").withColumn(name, F.col("before_") + F.col("place_")).drop("part_", "place_", "before_")
