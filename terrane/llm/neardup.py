"""Near-duplicate classes with DartMinHash signatures.

Documents are weighted sets of five-word shingles. Hashed darts fall on each shingle's region (its weight times the
rank axis), each dart belongs to a random coordinate, and the earliest dart of every coordinate is the signature.
Bands of coordinates give candidates: most copies are first gathered around pivots, then all pairs of different classes in
each wide bucket are compared. A pair is a link if its weighted Jaccard similarity is at least 0.8, judged from
the signatures where they leave no doubt and from the shingles themselves elsewhere. Classes are connected components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import bounded_arrow, release, saved, small_side

SHINGLE, SIMILAR = 5, 0.8
#: Coordinates of a signature, two bytes each.
COORDINATES = 256
#: (bands, coordinates in each): few narrow buckets first, so most copies are of one class before more are searched. A pair
#: at 0.8 shares none of the wide buckets with probability 5e-6; at 0.9, none of the narrow ones with 0.03.
LEVELS = ((4, 16), (16, 16), (40, 6))
#: Signature agreement that decides a pair by itself: five standard deviations from 0.8 on either side.
SURELY, HARDLY = 0.92, 0.68
#: Sets to be compared exactly are found by a broadcast of at most this many keys; beyond it by a shuffle.
BROADCAST_NODES = 500_000
#: Members of a bucket, and shingles in them, that are compared with as many others at a time; bounds a task's memory, not
#: what is compared.
BLOCK, BLOCK_PIECES = 512, 1 << 20

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (constants of a public finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate([[U(1)], np.cumprod(np.full(size - 1, b, U))]) for b in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def cells(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of the shingles of a text, an occurrence each: unit pieces of the weighted set.

    Words are lower-cased runs between ASCII white space; a text of one to four words is one shingle.
    """
    data = np.frombuffer(text.lower().encode(), np.uint8)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, U)
    power, inverse = _tables(len(data) + 1)
    sums = np.concatenate([[U(0)], np.cumsum(_BYTES[data] * power[: len(data)])])
    words = mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))
    n = max(1, len(words) - SHINGLE + 1)
    total = np.zeros(n, U)
    for k in range(min(SHINGLE, len(words))):
        total = mix(total + words[k : k + n])
    total.sort()
    first = np.concatenate([[True], total[1:] != total[:-1]])
    nth = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    out = mix(total + nth.astype(U) * U(_BASE))
    out.sort()
    return out


def darts(cell: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank and hash of every dart of rank up to `reach` on the unit cells: a Poisson process along each cell's ranks."""
    ranks, hashes = [], []
    base, done = np.zeros(len(cell)), 0
    width = max(1, int(reach))
    while len(cell):
        number = np.arange(done + 1, done + width + 1, dtype=U) * U(0xD1B54A32D192ED03)
        hashed = mix(cell[:, None] + number)
        rank = base[:, None] + np.cumsum(-np.log(((hashed >> U(12)).astype(np.float64) + 0.5) * 2.0**-52), 1)
        fine = rank <= reach
        ranks.append(rank[fine])
        hashes.append(hashed[fine])
        open_ = fine[:, -1]
        cell, base, done = cell[open_], rank[open_, -1], done + width
        width = max(1, int(reach**0.5))
    return np.concatenate(ranks), np.concatenate(hashes)


def signature(cell: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of every coordinate, two bytes of its hash; the agreement of two signatures estimates their similarity."""
    reach = k * (np.log(k) + 3) / len(cell)
    while True:
        rank, hashed = darts(cell, reach)
        again = mix(hashed)
        coordinate = ((again >> U(32)) * U(k) >> U(32)).astype(np.int64)
        least = np.full(k, np.inf)
        np.minimum.at(least, coordinate, rank)
        if np.isfinite(least).all():
            out = np.zeros(k, np.uint16)
            won = rank == least[coordinate]
            out[coordinate[won]] = (again[won] & U(0xFFFF)).astype(np.uint16)
            return out
        reach *= 2


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        sizes, signs = [], []
        for text in batch.column(2):
            cell = cells(text.as_py()) if text.is_valid else np.zeros(0, U)
            sizes.append(len(cell))
            signs.append(signature(cell).tobytes() if len(cell) else None)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "node", "cells", "sig"])


def _node(text: Column) -> Column:
    """A 64-bit key of equal texts; null for null."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def sign_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, node, cells, sig) for every row, in the shared folder."""
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), _node(F.col(text)).alias("node"), F.col(text).alias("text"))
    return saved(rows.mapInArrow(_sign, "doc_id long, node long, cells long, sig binary"), "signatures")


def _keys(nodes: DataFrame, bands: int, width: int, labels: DataFrame | None) -> DataFrame:
    """(node, label, band, bucket): the buckets of every node."""
    label = F.col("node")
    if labels is not None:
        nodes, label = nodes.join(labels, "node", "left"), F.coalesce("label", "node")
    return nodes.select("node", label.alias("label"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (2 * width) + 1, F.lit(2 * width))))).alias("band", "bucket"))


def _candidates(nodes: DataFrame, bands: int, width: int, labels: DataFrame | None) -> DataFrame:
    """Pairs (a, b): every member of a bucket with the bucket's hash-drawn pivots, one at first and then two, unless of one class.

    Pivots are minima, so they are found by partial aggregation, and a bucket yields twice its members at most; each
    band draws its own. Nothing collects a bucket, and buckets of one class yield nothing. Pairs that this passes over
    are left to _all_pairs.
    """
    keys = _keys(nodes, bands, width, labels)
    drawn = F.struct(F.xxhash64("bucket", "node").alias("draw"), "node", "label")
    pivots = keys.groupBy("bucket").agg(F.min(drawn).alias("p"), F.max(drawn).alias("q"), F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    ends = F.array("p") if labels is None else F.array("p", "q")  # one pivot is enough to gather the first classes
    pairs = keys.join(pivots.select("bucket", "p", "q"), "bucket").select("node", "label", F.explode(ends).alias("b")).where("label != b.label")
    return pairs.select(F.least("node", "b.node").alias("a"), F.greatest("node", "b.node").alias("b")).distinct()


def _agree(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in batch.columns[2:4])
        small, large = (np.minimum, np.maximum)
        sizes = [c.to_numpy() for c in batch.columns[4:6]]
        bound = small(*sizes) / large(*sizes)  # no pair is more similar than its sizes are
        agree = np.where(bound < SIMILAR, 0.0, (a == b).mean(1) if batch.num_rows else 0.0)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(agree, pa.float64())], ["a", "b", "agree"])


def _compared(bands: int, width: int):
    """Links among the rows of two blocks that join different classes; rows come sorted by (bucket, i, j), and k is the row's
    own block. What one link joins is one class from there on, so a group yields fewer links than it has rows."""

    def links(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        i, j, k, band, node, label, cells = (rows.column(c).to_numpy() for c in ("i", "j", "k", "band", "node", "label", "cells"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(k), -1)
        ends = np.concatenate([[0], np.cumsum(cells)])
        piece = np.unique(np.frombuffer(b"".join(rows.column("pieces").to_pylist()), U), return_inverse=True)[1]
        own = np.zeros(piece.max() + 1, bool)  # pieces of the text at hand
        root = np.unique(label, return_inverse=True)[1]
        one = i[0] == j[0]
        right = np.arange(len(k)) if one else np.flatnonzero(k == j[0])
        found = []
        for x in right if one else np.flatnonzero(k == i[0]):
            near = right[(root[right] != root[x]) & (np.minimum(cells[right], cells[x]) >= SIMILAR * np.maximum(cells[right], cells[x]))]
            if one:
                near = near[node[near] > node[x]]
            same = sig[near] == sig[x]
            agree = np.count_nonzero(same, 1) / sig.shape[1]
            fine = agree >= HARDLY
            # two texts are compared in the first bucket that they share only
            fine[fine] = same[fine, : bands * width].reshape(-1, bands, width).all(2).argmax(1) == band[x]
            near, agree = near[fine], agree[fine]
            if not len(near):
                continue
            own[piece[ends[x] : ends[x + 1]]] = True
            both = np.add.reduceat(own[piece], ends[:-1], dtype=np.int64)[near]  # shingles shared with every text at once
            own[piece[ends[x] : ends[x + 1]]] = False
            for y in near[(agree >= SURELY) | (both >= SIMILAR * (cells[near] + cells[x] - both))]:
                if root[x] != root[y]:
                    root[root == root[y]] = root[x]
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
        if found:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for at, stop in zip(cuts, cuts[1:], strict=False):
                if held and tuple(key[at]) != last:
                    yield from links(held)
                    held = []
                last = tuple(key[at])
                held.append(batch.slice(at, stop - at))
        if held:
            yield from links(held)

    return run


def _all_pairs(docs: DataFrame, text: str, nodes: DataFrame, bands: int, width: int, labels: DataFrame) -> DataFrame:
    """(a, b): links that join what is still of different classes, from all pairs that share a bucket.

    A bucket is dealt into blocks of about BLOCK members or BLOCK_PIECES shingles, and each two blocks are compared by
    one group of rows, except two blocks of the bucket's commonest class. So no task takes a whole bucket. Rows carry
    their shingles, so doubtful pairs are settled where they meet: comparisons grow with the square of a bucket's members
    outside that class, which is what telling them all apart takes, but what is written and moved grows with its members.
    """
    keys = _keys(nodes, bands, width, labels)
    shared = keys.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("bucket")
    members = saved(keys.join(shared, "bucket").join(nodes.select("node", "cells"), "node"), "members")
    sets = _pieces(docs, text, members.select("node").distinct())
    sizes = members.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("cells").alias("c"))
    sizes = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max(F.struct("n", "label", "c")).alias("top"))
    blocks = lambda n, c: F.ceil(F.greatest(n / BLOCK, c / BLOCK_PIECES)).cast("int")
    dealt = sizes.select("bucket", F.col("top.label").alias("top"), blocks(F.col("top.n"), F.col("top.c")).alias("own"), blocks(F.col("n") - F.col("top.n"), F.col("c") - F.col("top.c")).alias("rest"))
    common, drawn = F.col("label") == F.col("top"), F.xxhash64("bucket", "node")
    k = F.when(common, F.pmod(drawn, F.col("own"))).otherwise(F.col("own") + F.pmod(drawn, F.col("rest"))).cast("int")
    others = F.sequence(F.when(common, F.col("own")).otherwise(0), F.col("own") + F.col("rest") - 1)
    rows = members.join(dealt, "bucket").select("bucket", "band", "node", "label", "cells", k.alias("k"), F.explode(others).alias("o"))
    rows = rows.select("bucket", F.least("k", "o").alias("i"), F.greatest("k", "o").alias("j"), "k", "band", "node", "label", "cells")
    rows = rows.join(nodes.select("node", "sig"), "node").join(sets, "node")
    rows = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.select("bucket", "i", "j", "k", "band", "node", "label", "cells", "sig", "pieces").mapInArrow(_compared(bands, width), "a long, b long").distinct()


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([cells(x.as_py()).tobytes() for x in batch.column(1)], pa.binary())], ["node", "pieces"])


def _pieces(docs: DataFrame, text: str, wanted: DataFrame) -> DataFrame:
    """(node, pieces): the shingles of the wanted nodes' texts, computed once for each text."""
    wanted = saved(wanted, "wanted")
    texts = docs.select(_node(F.col(text)).alias("node"), F.col(text).alias("text")).join(small_side(wanted, wanted.count(), BROADCAST_NODES), "node", "left_semi")
    return saved(texts.groupBy("node").agg(F.first("text").alias("text")).mapInArrow(_sets, "node long, pieces binary"), "sets")


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted sets of cells."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        found = [similarity(np.frombuffer(a.as_py(), U), np.frombuffer(b.as_py(), U)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])


def _judged(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, agree) of the pairs, but those whose signatures leave no doubt."""
    sig = lambda x: nodes.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("cells").alias(f"n_{x}"))
    joined = pairs.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b")
    return joined.mapInArrow(_agree, "a long, b long, agree double").where(f"agree >= {HARDLY}")


def _links(docs: DataFrame, judged: DataFrame, text: str) -> DataFrame:
    """The judged pairs that are links."""
    judged = saved(judged, "agreement")
    sure, unsure = judged.where(f"agree >= {SURELY}").select("a", "b"), judged.where(f"agree < {SURELY}").select("a", "b")
    sets = _pieces(docs, text, unsure.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    side = lambda x: sets.select(F.col("node").alias(x), F.col("pieces").alias(f"c{x}"))
    exact = unsure.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "cb").mapInArrow(_exact, "a long, b long, similarity double")
    return sure.unionByName(exact.where(f"similarity >= {SIMILAR}").select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): one label for each connected component, for every node that has an edge.

    Each round every node takes its least neighbour, and the edges are contracted to those between different takers,
    so few are left after the first round; then the rounds are composed. Each round is a written table.
    """
    now = saved(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while True:
        ends = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = saved(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "taken")
        rounds.append(taken)
        side = lambda x: taken.select(F.col("node").alias(x), F.col("label").alias(f"t{x}"))  # noqa: B023, E731
        left = now.join(side("a"), "a").join(side("b"), "b").where("ta != tb")
        now = saved(left.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        if not now.limit(1).count():
            break
    labels = rounds.pop()
    while rounds:
        labels = saved(_relabelled(rounds.pop(), labels), "labels")
    return labels


def _relabelled(labels: DataFrame, further: DataFrame) -> DataFrame:
    """Labels that are nodes of `further` get their labels from there."""
    further = further.select(F.col("node").alias("label"), F.col("label").alias("to"))
    return labels.join(further, "label", "left").select("node", F.coalesce("to", "label").alias("label"))


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The signed rows, and (node, label) of all nodes in classes of more than one text."""
    signed = sign_documents(docs, ident, text)
    nodes = saved(signed.where("sig is not null").groupBy("node").agg(F.min(F.struct("cells", "sig")).alias("s")).select("node", "s.cells", "s.sig"), "nodes")
    labels = None
    for bands, width in (*LEVELS, (0, 0)):
        if bands:
            links = _links(docs, _judged(nodes, saved(_candidates(nodes, bands, width, labels), "pairs")), text)
        else:  # most copies are of one class now; all pairs that still are not
            links = _all_pairs(docs, text, nodes, *LEVELS[-1], labels)
        if labels is None:
            labels = components(links)
            continue
        for x in ("a", "b"):  # links between classes
            links = links.join(labels.select(F.col("node").alias(x), F.col("label").alias("l")), x, "left").withColumn(x, F.coalesce("l", x)).drop("l")
        joined = components(links)
        alone = joined.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti")
        labels = saved(_relabelled(labels.unionByName(alone), joined), "labels")
    return signed, labels


def _class_ids(signed: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, class_id, leads, doc) per node: doc is its least id, and the node with the least id leads its class."""
    own = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc"))
    labelled = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    whole = labelled.groupBy("label").agg(F.min("doc").alias("class_id"), F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("node"))).alias("least"))
    return labelled.join(whole, "label").select("node", "class_id", (F.col("least")["node"] == F.col("node")).alias("leads"), "doc")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id of every row: the least id among the documents it is linked to, directly or through others.

    Equal texts are one class. Texts without words are linked to equal ones only; a null text to nothing, its class is
    its own id. A very long text is compared whole. Null ids never name a class unless all of its ids are null. Repeated rows keep a row each; other
    columns are ignored; no documents, no rows.
    """
    signed, labels = classes(docs, ident, text)
    ids = saved(_class_ids(signed, labels), "classes").select("node", "class_id")
    return signed.select("doc_id", "node").join(ids, "node", "left").select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def drop_near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the least id; rows with a null text all stay; columns as in docs, whatever their names.

    Empty texts are one class; a very long text is compared whole; of repeated rows one stays; a null id is the least of
    its class only if all are null; no documents, no rows.
    """
    signed, labels = classes(docs, ident, text)
    leads = saved(_class_ids(signed, labels).where("leads").select("node", F.col("doc").alias("lead")), "leads")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(whole, _node(F.col(text)).alias("node"), F.col(ident).cast("long").alias("id"))
    firsts = rows.join(leads, "node").where(F.col("id").eqNullSafe(F.col("lead")))  # more than one only of repeated rows
    firsts = firsts.withColumn("nth", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where("nth = 1")
    return firsts.select("row.*").unionByName(rows.where("node is null").select("row.*"))
