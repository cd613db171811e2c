"""Mixing sources to target weights with DataFrame functions only.

Sizes are aggregated per source, targets follow from weights by water-filling, and each document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import saved, small_side

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: The table of sources is broadcast up to this many rows; beyond it the join shuffles and AQE splits hot sources.
BROADCAST_SOURCES = 100_000
#: Seeds tried for the Bernoulli copies; each source keeps the one whose words come closest to its target.
SEEDS = 32


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("null"))


def _uniform(base: Column, seed: Column) -> Column:
    """A hash of the row in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(seed, base), 11) * F.lit(2.0**-53)


def _copies(rate: Column, base: Column, seed: Column) -> Column:
    whole = F.floor(rate)
    return (whole + (_uniform(base, seed) < rate - whole).cast("long")).cast("long")


def _targets(sizes: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Water-filling over the table of sources, in the order in which they reach their cap."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    by_ratio = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    nth = (F.row_number().over(order) - 1) % len(weights)
    filled = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(by_ratio), F.lit(0.0)))
        .withColumn("level", F.col("left") / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))))
    )
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "key", "level"))).over(every)["level"]
    return filled.select("source", "key", "source_size", F.least("limit", F.coalesce(first, F.lit(float("inf"))) * F.col("weight")).alias("target")).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    )


def _measured(docs: DataFrame, text: str, source: str, ident: str) -> DataFrame:
    return docs.select(
        F.col(ident).alias("doc_id"),
        F.col(source).alias("source"),
        _source_key(F.col(source)).alias("key"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _base(F.col(ident), F.col(text)).alias("base"),
    )


def _base(ident: Column, text: Column) -> Column:
    return F.xxhash64(ident, text)


def source_rates(narrow: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seeds: int = SEEDS) -> tuple[DataFrame, int]:
    """One row per source: key, source_size, target, rate and its seed; and the number of sources."""
    sizes = narrow.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    rates = saved(_targets(sizes, share, cap, weights), "rates")
    n = rates.count()
    joined = narrow.join(small_side(rates.select("key", "rate"), n, BROADCAST_SOURCES), "key")
    sums = joined.groupBy("key").agg(*(F.sum(_copies(F.col("rate"), F.col("base"), F.lit(i)) * F.col("size")).alias(f"s{i}") for i in range(seeds)))
    near = F.array_min(F.array(*(F.struct(F.abs(F.col(f"s{i}") - F.col("target")).alias("off"), F.lit(i).alias("seed")) for i in range(seeds))))
    return saved(rates.join(sums, "key").select("key", "source_size", "target", "rate", near["seed"].alias("seed")), "seeds"), n


def mix_table(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", **options) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, rate, copies, taken.

    Null text has size 0, and a very long one is measured whole; null sources are one source, last in order; null ids and repeated rows are rows of their own
    (equal rows share one decision); an empty table gives no rows; a corpus without words gives targets of 0. Other
    columns are ignored, whatever their names.
    """
    narrow = saved(_measured(docs, text, source, ident), "sizes")
    rates, n = source_rates(narrow, **options)
    copies = _copies(F.col("rate"), F.col("base"), F.col("seed"))
    return narrow.join(small_side(rates, n, BROADCAST_SOURCES), "key").select(
        "doc_id", "size", "source", "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def emit_mix(docs: DataFrame, text: str = "text", source: str = "source", ident: str = "doc_id", **options) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it; columns as in docs, whatever their names.

    As in mix_table, a null text has size 0 and null sources are one source; a very long text is one row; equal rows
    share one decision; an empty table gives no rows.
    """
    rates, n = source_rates(saved(_measured(docs, text, source, ident), "sizes"), **options)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, _source_key(F.col(source)).alias("key"), _base(F.col(ident), F.col(text)).alias("base"))
    taken = rows.join(small_side(rates.select("key", "rate", "seed"), n, BROADCAST_SOURCES), "key")
    copies = _copies(F.col("rate"), F.col("base"), F.col("seed")).cast("int")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), copies))).select("row.*")
