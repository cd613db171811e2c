"""Balanced label propagation over documents that share a text, with DataFrame functions only.

Documents start in hash-drawn shards. In each round iterative joins tell every document the shards of those it is linked
to; it asks for the shard that holds most of their bytes among those with room, and as many are let in as the quota
allows, large groups first. Rounds go on until nothing moves. Documents without links fill the shards up at the end, so
sizes stay even; only a group that no shard has room for stays cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_key

#: Priority buckets in which quotas are cut: eight size classes, large ones first, times sub-buckets; finer for levelling.
CLASSES, SUB, FINE = 8, 128, 2048
#: Most rounds of propagation, and passes that level the shards at the end.
ROUNDS, LEVELLING = 12, 3
#: Groups of more than one in so many rows are joined by broadcast: at most so many groups, so their documents are not shuffled.
HOT = 2048
#: Rows that one window of the slot numbering sorts.
SLOT_ROWS = 1000


def _members(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """Narrow rows; grp is the text's 32-byte key, null for a null text, which is linked to nothing."""
    t = F.col(text)
    return docs.select(
        F.col(ident).alias("doc_id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(t, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        text_key(t).alias("grp"),
        F.xxhash64(F.col(ident), t, F.monotonically_increasing_id()).alias("h"),
    )


def _cells(members: DataFrame, shards: int, rows: int) -> DataFrame:
    """(grp, start, bytes, whole, hot, label) of the linked documents: those of one group that start in one shard move
    together, as all of them hear the same votes. At most `shards` rows a group, whatever its size.
    """
    start = F.pmod("h", F.lit(shards)).cast("int")
    cells = members.where("grp is not null").groupBy("grp", start.alias("start")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    linked = cells.groupBy("grp").agg(F.sum("rows").alias("n"), F.sum("bytes").alias("whole")).where("n > 1")
    return cells.join(linked, "grp").select("grp", "start", "bytes", "whole", (F.col("n") * HOT > rows).alias("hot"), F.col("start").alias("label"))


def _priority(whole, size, key, sub: int) -> F.Column:
    """Bucket of an item in the order in which quotas let in: by size class against a whole shard, then by hash."""
    level = F.least(F.lit(CLASSES - 1), F.floor(F.greatest(F.lit(0.0), F.log2(F.lit(max(whole, 1.0)) / F.greatest(size, F.lit(1)) / 4) / 1.5)))
    return (level * sub + F.pmod(key, F.lit(sub))).cast("int")


def quotas(moves: np.ndarray, stay: np.ndarray, cap: float) -> np.ndarray:
    """First bucket that each shard turns away, so that no shard exceeds cap by what it lets in.

    moves: bytes by shard, wished shard and bucket; stay: bytes that wish for nothing else. What is turned away stays
    where it is, which lowers the room there, so cuts are lowered until they agree.
    """
    inflow = np.concatenate([np.zeros((len(stay), 1)), moves.sum(0).cumsum(1)], 1)  # by wish: bytes of the buckets below
    cuts = np.full(len(stay), moves.shape[2])
    while True:
        turned = np.array([sum(moves[s, w, cuts[w] :].sum() for w in range(len(stay))) for s in range(len(stay))])
        room = cap - stay - turned
        fitting = np.array([np.searchsorted(inflow[w], room[w], "right") - 1 for w in range(len(stay))])
        lower = np.minimum(cuts, np.maximum(fitting, 0))
        if (lower == cuts).all():
            return cuts
        cuts = lower


def propagate(cells: DataFrame, shards: int, cap: float, rounds: int = ROUNDS) -> DataFrame:
    """Cells with the labels that propagation ends in.

    A group asks as one for the shard where it has most bytes; once turned away, of those with room for its other bytes,
    or else of those with any room. A hash breaks ties. Every round is a written table of narrow rows, and a
    histogram of at most shards ** 2 * CLASSES * SUB numbers reaches the driver.
    """
    for turn in range(rounds):
        votes = cells.groupBy("grp", "label").agg(F.sum("bytes").alias("b"), F.max("whole").alias("whole"))
        if turn:
            load = {r["label"]: r["b"] for r in cells.groupBy("label").agg(F.sum("bytes").alias("b")).collect()}  # one row per shard
            space = F.element_at(F.array(*(F.lit(float(max(0.0, cap - load.get(s, 0)))) for s in range(shards))), F.col("label") + 1)
            fits = F.when(F.col("whole") - F.col("b") <= space, 2).when(space > 0, 1).otherwise(0)
        else:
            fits = F.when(F.col("whole") <= cap, 2).otherwise(1)
        asked = votes.groupBy("grp").agg(F.max(F.struct(fits.alias("fits"), "b", F.xxhash64("grp", "label"), "label")).alias("v"))
        heard = cells.join(asked.select("grp", F.col("v.label").alias("wish"), "v.fits"), "grp")
        # the cells of a group that fits somewhere are let in together, those of a larger one each for itself
        fit = F.col("fits") == 2
        bucket = _priority(cap, F.when(fit, F.col("whole")).otherwise(F.col("bytes")), F.when(fit, F.xxhash64("grp")).otherwise(F.xxhash64("grp", "start")), SUB)
        heard = saved(heard.select("grp", "start", "bytes", "whole", "hot", "label", F.when(F.col("fits") > 0, F.col("wish")).otherwise(F.col("label")).alias("wish"), bucket.alias("bucket")), "votes")
        found = heard.groupBy("label", "wish", "bucket").agg(F.sum("bytes").alias("b")).toArrow()
        at = [found[c].to_numpy() for c in ("label", "wish", "bucket", "b")]
        moves = np.zeros((shards, shards, CLASSES * SUB))
        moves[at[0], at[1], at[2]] = at[3]
        stay = np.array([moves[s, s].sum() for s in range(shards)])
        moves[range(shards), range(shards)] = 0
        cuts = quotas(moves, stay, cap)
        if not any(moves[:, w, : cuts[w]].any() for w in range(shards)):
            break
        cut = F.element_at(F.array(*map(F.lit, cuts.tolist())), F.col("wish") + 1)
        cells = heard.select("grp", "start", "bytes", "whole", "hot", F.when(F.col("bucket") < cut, F.col("wish")).otherwise(F.col("label")).alias("label"))
    return cells


def _levelled(rows: DataFrame, shards: int, cap: float) -> DataFrame:
    """Rows (label, bucket, size) with new labels: each shard keeps its buckets up to its capacity, and what it turns away
    goes to the shards with room. What shares label and bucket moves together.

    Only the histogram over (label, bucket) is ordered: at most shards * CLASSES * FINE rows whatever the input, and
    of it one row per shard reaches the driver.
    """
    histogram = saved(rows.groupBy("label", "bucket").agg(F.sum("size").alias("b")), "histogram")
    running = F.sum("b").over(Window.partitionBy("label").orderBy("bucket"))
    kept = histogram.withColumn("upto", running).groupBy("label").agg(
        F.coalesce(F.min(F.when(F.col("upto") > cap, F.col("bucket"))), F.lit(CLASSES * FINE)).alias("cut"),
        F.coalesce(F.max(F.when(F.col("upto") <= cap, F.col("upto"))), F.lit(0)).alias("used"),
    )
    state = {r["label"]: (r["cut"], r["used"]) for r in kept.collect()}  # one row per shard
    cuts = F.array(*(F.lit(state.get(s, (CLASSES * FINE, 0))[0]) for s in range(shards)))
    out = F.col("bucket") >= F.element_at(cuts, F.col("label") + 1)
    room, ends = 0.0, []
    for s in range(shards):
        room += max(0.0, cap - state.get(s, (0, 0))[1])
        ends.append(room)
    pool = histogram.where(out).groupBy("bucket").agg(F.sum("b").alias("b"))
    middle = F.sum("b").over(Window.orderBy("bucket")) - F.col("b") / 2  # at most CLASSES * FINE rows
    to = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("middle"))))
    last = pool.withColumn("middle", middle).withColumn("to", to).groupBy("to").agg(F.max("bucket").alias("bucket")).collect()  # one row per shard
    known, bounds, at = {r["to"]: r["bucket"] for r in last}, [], -1
    for s in range(shards):
        at = max(at, known.get(s, -1))
        bounds.append(at)
    goes = F.least(F.lit(shards - 1), F.size(F.filter(F.array(*map(F.lit, bounds)), lambda e: e < F.col("bucket"))))
    return rows.withColumn("label", F.when(out, goes).otherwise(F.col("label")).cast("int"))


def shard_documents(docs: DataFrame, shards: int = 16, rounds: int = ROUNDS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row, under the law "bytes".

    size is the text's UTF-8 bytes plus 1. Rows of equal texts share a shard unless no shard has room for their group
    beside larger ones; it then stays cut over few shards. A null text counts no bytes, has crc 0 and is linked to
    nothing; an empty text is a text; a very long text is one row and makes its shard as much larger than the others as
    it must. Null ids and repeated rows keep a slot each. Other columns are ignored, whatever their names. An empty
    table gives no rows.
    """
    members = saved(_members(docs, ident, text).withColumn("start", F.pmod("h", F.lit(shards)).cast("int")), "members")
    got = members.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    total, rows = got["b"] or 0, got["n"]
    cap = total / shards
    cells = propagate(saved(_cells(members, shards, rows), "cells"), shards, cap, rounds)
    # what is left of a group in one shard moves as one when the shards are levelled; documents without links are free
    parts = cells.groupBy("grp", "label").agg(F.sum("bytes").alias("weight"))
    place = saved(cells.join(parts, ["grp", "label"]).select("grp", "start", "label", "weight", "hot"), "place")
    hot, keys = F.broadcast(place.where("hot").drop("hot")), ["grp", "start"]  # at most HOT * shards rows
    cold = members.join(hot, keys, "left_anti").join(place.where("not hot").drop("hot"), keys, "left")
    linked = members.join(hot, keys).unionByName(cold)
    bucket = _priority(cap, F.coalesce("weight", "size"), F.when(F.col("weight").isNull(), F.col("h")).otherwise(F.xxhash64("grp", "label")), FINE)
    placed = saved(linked.select("doc_id", "size", "text_crc32", "h", F.coalesce("label", "start").alias("label"), bucket.alias("bucket")), "placed")
    for _ in range(LEVELLING):
        placed = _levelled(placed, shards, cap)
    narrow = placed.withColumnRenamed("label", "shard").drop("bucket")
    sizes = {r["shard"]: r["n"] for r in narrow.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # one row per shard
    spread = F.element_at(F.array(*(F.lit(max(1, -(-sizes.get(s, 0) // SLOT_ROWS))) for s in range(shards))), F.col("shard") + 1)
    narrow = narrow.withColumn("part", F.pmod("h", spread))
    counts = narrow.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "part", before.alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "h")) - 1
    return (
        narrow.withColumn("within", within)
        .join(starts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("within") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
