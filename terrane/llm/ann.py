"""Nearest neighbours by inner product: an inverted file with product-quantised residuals, and bounds that lose none.

Coarse centroids route rows to lists, and residuals are product-quantised; with each row goes the length of what its
code leaves out. The most promising lists of a query give it a threshold, its k-th best score there. Of all other lists only
those are opened whose farthest row might reach it, and of their rows only those are scored whose code and error might.
So every neighbour is found, whatever the rows; what their shape decides is the work. Lists lie together in cells of
bounded size, by row and by query, so a list that holds most rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_arrow, saved

NEAREST = 20
#: Vectors the index is fitted on.
SAMPLE = 65_536
#: Coarse lists are so many times the square root of the rows, and at most a quarter of the sample's vectors; components per
#: quantised part; codes per part; rounds of k-means.
SPREAD, PART, CODES, ROUNDS = 3, 4, 256, 8
#: A query's threshold comes from lists of so many times k rows together, and of so many lists at most; rows and queries of
#: one block, and queries that are scored at a time.
FIRST, OPENED, BLOCK_ROWS, BLOCK_QUERIES, SLICE = 8, 64, 4096, 2048, 256
RESULT = "own long, uid long, vec_id long, score double"


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.int64)
    half = (centres**2).sum(1) / 2
    for i in range(0, len(points), 4096):
        out[i : i + 4096] = (half - points[i : i + 4096] @ centres.T).argmin(1)
    return out


def kmeans(points: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[: min(k, len(points))]].copy()
    for _ in range(rounds):
        at = nearest(points, centres)
        count = np.bincount(at, minlength=len(centres))
        total = np.stack([np.bincount(at, points[:, d], len(centres)) for d in range(points.shape[1])], 1)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in component order whatever the batch, so equal vectors score equal."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


@dataclass
class Index:
    centres: np.ndarray
    books: np.ndarray  # parts x codes x components

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = nearest(vectors, self.centres)
        rest = vectors - self.centres[at]
        width = self.books.shape[2]
        rest = np.pad(rest, ((0, 0), (0, len(self.books) * width - rest.shape[1])))
        return at, np.stack([nearest(rest[:, p * width : (p + 1) * width], book) for p, book in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes keep of the vectors."""
        return self.centres[at] + np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], 1)[:, : self.centres.shape[1]]


def fit(sample: np.ndarray, rows: int) -> Index:
    k = int(max(1, min(SPREAD * rows**0.5, len(sample) / 4)))
    centres = kmeans(sample, k)
    rest = sample - centres[nearest(sample, centres)]
    parts = -(-sample.shape[1] // PART)
    rest = np.pad(rest, ((0, 0), (0, parts * PART - rest.shape[1])))
    books = [kmeans(rest[:20_000, p * PART : (p + 1) * PART], CODES, seed=p) for p in range(parts)]
    size = max(len(b) for b in books)
    return Index(centres, np.stack([np.pad(b, ((0, size - len(b)), (0, 0)), mode="edge") for b in books]))


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """(uid, vec_id, v array<double>): the rows that take part, each with a number of its own; written once.

    Null ids, null or zero vectors and those with null or non-finite components take no part. Repeated rows all do.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    return saved(rows.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "v"), "vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _rounding(lengths: np.ndarray, most: float, components: int) -> np.ndarray:
    """More than the rounding of the inner products of vectors of these lengths with others of at most that length."""
    return 1e-15 * (components + 8) * lengths * most


def _encode(index: Index) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"))
            at, codes = index.encode(v)
            error, far = np.linalg.norm(v - index.decode(at, codes), axis=1), np.linalg.norm(v - index.centres[at], axis=1)
            yield pa.record_batch([*batch.columns, pa.array(at.astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(far)], [*batch.schema.names, "list", "codes", "error", "far"])

    return run


def build_index(vectors: DataFrame) -> tuple[Index, DataFrame]:
    """The index fitted on a sample, and every row with its list, its codes, their error and its distance from the list's centre."""
    bounded_arrow(vectors.sparkSession, 4096)
    n = vectors.count()
    part = min(1.0, SAMPLE / max(n, 1))
    drawn = vectors.where(F.shiftrightunsigned(F.xxhash64(F.lit("ann"), "vec_id"), 11) * F.lit(2.0**-53) < part).orderBy("vec_id", "uid").limit(2 * SAMPLE).toArrow()
    sample = _matrix(drawn["v"].combine_chunks()) if drawn.num_rows else np.zeros((1, 1))
    index = fit(sample, n)
    return index, saved(vectors.mapInArrow(_encode(index), "uid long, vec_id long, v array<double>, list long, codes binary, error double, far double"), "index")


@dataclass
class Lists:
    """By list: rows, distance of the farthest from the centre, and cell. A list of many rows is a cell of several blocks."""

    sizes: np.ndarray
    far: np.ndarray
    cells: np.ndarray


def measure_lists(index: Index, rows: DataFrame) -> Lists:
    found = rows.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).toArrow()  # one row a list: at most a quarter of SAMPLE
    sizes, far = np.zeros(len(index.centres), np.int64), np.zeros(len(index.centres))
    sizes[found["list"].to_numpy()], far[found["list"].to_numpy()] = found["n"].to_numpy(), found["far"].to_numpy()
    cells, cell, held = np.zeros(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > BLOCK_ROWS:
            cell, held = cell + 1, 0
        cells[i], held = cell, held + n
    return Lists(sizes, far, cells)


def _cells(lists: Lists, chosen: np.ndarray) -> pa.Array:
    """The cells of each query's lists (queries x lists)."""
    return pa.array([np.unique(lists.cells[row]) for row in chosen], pa.list_(pa.int64()))


def _first(index: Index, lists: Lists, k: int) -> Callable:
    """Adds each query's most promising lists, and their cells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(-(_matrix(batch.column("v")) @ index.centres.T), 1, kind="stable")[:, :OPENED]
            before = np.cumsum(lists.sizes[order], 1) - lists.sizes[order]
            opened = [o[b < FIRST * k] for o, b in zip(order, before, strict=True)]
            chosen = np.zeros((len(opened), len(lists.sizes)), bool)
            for row, o in zip(chosen, opened, strict=True):
                row[o] = True
            yield pa.record_batch([*batch.columns, pa.array([-np.inf] * len(opened)), pa.array(opened, pa.list_(pa.int64())), _cells(lists, chosen & (lists.sizes > 0))], [*batch.schema.names, "bar", "lists", "cells"])

    return run


def _others(index: Index, lists: Lists) -> Callable:
    """The cells of the lists that were not opened and whose farthest row might reach the query's threshold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.linalg.norm(index.centres, axis=1) + lists.far
        for batch in batches:
            v = _matrix(batch.column("v"))
            lengths = np.linalg.norm(v, axis=1)
            reach = v @ index.centres.T + lengths[:, None] * lists.far + _rounding(lengths, most.max(), v.shape[1])[:, None]
            chosen = ~(reach < batch.column("bar").to_numpy()[:, None]) & (lists.sizes > 0)
            for row, o in zip(chosen, batch.column("lists").to_pylist(), strict=True):
                row[o] = False
            names = ["uid", "v", "bar", "lists"]
            yield pa.record_batch([*(batch.column(n) for n in names), _cells(lists, chosen)], [*names, "cells"])

    return run


def _search(index: Index, k: int, opened: bool) -> Callable:
    """The best k of one block of rows for one block of queries, within the queries' lists or outside them.

    Codes and their errors say which rows might reach a query's threshold; those are scored. The scores that count are
    summed in component order, so that equal vectors score equal whatever their block.
    """

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if rows.num_rows and queries.num_rows:
            uids, ids, at, error = (rows[c].to_numpy() for c in ("uid", "vec_id", "list", "error"))
            vectors = _matrix(rows["v"].combine_chunks())
            codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
            kept, most = index.decode(at, codes), np.linalg.norm(vectors, axis=1).max() + error.max()
            own, bars, points = queries["uid"].to_numpy(), queries["bar"].to_numpy(), _matrix(queries["v"].combine_chunks())
            lists = queries["lists"].to_pylist()
            for i in range(0, len(own), SLICE):
                part, names, bar = points[i : i + SLICE], own[i : i + SLICE], bars[i : i + SLICE, None]
                within = np.zeros((len(part), len(index.centres)), bool)
                for row, o in zip(within, lists[i : i + SLICE], strict=True):
                    row[o] = True
                lengths = np.linalg.norm(part, axis=1)
                slack = _rounding(lengths, most, part.shape[1])[:, None]
                may = (within[:, at] == opened) & ~(part @ kept.T + lengths[:, None] * error + slack < bar) & (uids != names[:, None])
                some = np.flatnonzero(may.any(0))
                if not len(some):
                    continue
                near = np.where(may[:, some], part @ vectors[some].T, -np.inf)
                if len(some) > k:
                    bar = np.maximum(bar, np.partition(near, len(some) - k, 1)[:, len(some) - k, None])
                q, r = np.nonzero(may[:, some] & ~(near + 2 * slack < bar))
                r = some[r]
                score = np.concatenate([dots(vectors[r[j : j + (1 << 16)]], part[q[j : j + (1 << 16)]]) for j in range(0, len(q), 1 << 16)] or [np.zeros(0)])
                order = np.lexsort((uids[r], ids[r], -score, q))
                q, r, score = q[order], r[order], score[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                found.append((names[q[best]], uids[r[best]], ids[r[best]], score[best]))
        return pa.table({n: pa.array(np.concatenate([f[j] for f in found])) for j, n in enumerate(("own", "uid", "vec_id", "score"))})

    return run


def _hits(index: Index, lists: Lists, rows: DataFrame, queries: DataFrame, k: int, opened: bool) -> DataFrame:
    """(own, uid, vec_id, score) of queries (uid, v, bar, lists, cells): their best rows within the cells they ask."""
    spark = rows.sparkSession
    asked = queries.select("uid", "v", "bar", "lists", F.explode("cells").alias("cell"))
    asks = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    cells = np.bincount(lists.cells, lists.sizes).astype(int)
    plan = spark.createDataFrame([(c, max(1, -(-int(n) // BLOCK_ROWS)), max(1, -(-asks.get(c, 0) // BLOCK_QUERIES))) for c, n in enumerate(cells)], "cell long, cuts int, shares int")
    place = spark.createDataFrame([(i, int(c)) for i, c in enumerate(lists.cells)], "list long, cell long")
    draw = lambda n: F.pmod(F.xxhash64("uid"), n).cast("int")
    left = rows.join(F.broadcast(place), "list").join(F.broadcast(plan), "cell")
    left = left.withColumn("block", draw(F.col("cuts"))).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = asked.join(F.broadcast(plan), "cell").withColumn("turn", draw(F.col("shares"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    keys = ["cell", "block", "turn"]
    left = left.select(*keys, "uid", "vec_id", "v", "list", "codes", "error")
    right = right.select(*keys, "uid", "v", "bar", "lists")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(index, k, opened), RESULT)


def _best(found: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "uid"))
    return found.withColumn("rank", nth).where(F.col("rank") <= k)


def _searched(vectors: DataFrame, every: int, k: int) -> DataFrame:
    """The neighbours within vectors of one length."""
    index, rows = build_index(vectors)
    lists = measure_lists(index, rows)
    queries = vectors.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = "uid long, v array<double>, bar double, lists array<bigint>, cells array<bigint>"
    routed = saved(queries.select("uid", "v").mapInArrow(_first(index, lists, k), asked), "routed")
    first = saved(_best(_hits(index, lists, rows, routed, k, True), k), "first")
    bars = first.where(F.col("rank") == k).select(F.col("own").alias("uid"), F.col("score").alias("reached"))
    barred = routed.join(bars, "uid", "left").select("uid", "v", F.coalesce("reached", "bar").alias("bar"), "lists")
    others = saved(barred.mapInArrow(_others(index, lists), asked), "barred")
    best = _best(first.drop("rank").unionByName(_hits(index, lists, rows, others, k, False)), k)
    return best.join(queries.select(F.col("uid").alias("own"), F.col("vec_id").alias("query_id")), "own").select("query_id", "rank", "vec_id", "score")


def search(vectors: DataFrame, every: int = 20, k: int = NEAREST) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, its k nearest other rows, all of them.

    vectors: valid_vectors, which says what takes no part. A vector is compared with those of its length; each length has
    an index of its own. Repeated rows are candidates and queries of their own. Ties go to the smaller id. Fewer than k
    rows give fewer neighbours; no vectors, no rows. Vectors of many components are bounded by blocks of rows.
    """
    lengths = sorted(r["d"] for r in vectors.select(F.size("v").alias("d")).distinct().collect())  # the few lengths in use
    parts = [_searched(vectors.where(F.size("v") == d), every, k) for d in lengths or [0]]
    return reduce(DataFrame.unionByName, parts)
