"""Hierarchical best-fit packing of token sequences.

Tasks best-fit their documents locally and emit nearly full bins; underfull bins become items of the next level, where
fewer tasks best-fit them again, up a tree. Texts are tokenised word by word with a memory of known words, which gives
the tokenizer's own ids (its pre-tokens never span white space and its byte pairs never span pre-tokens).
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, kept, saved

CAPACITY, END = 4096, 1
#: Items that one task packs at a time; bounds its memory whatever the input.
GROUP = 16_384
#: A bin with at most this much room is emitted before the last level.
NEARLY = 32
#: Levels of merging after the local one that are always gone through; more follow while they lower the number of bins.
LEVELS = 4
#: Known words that one worker remembers before it starts anew.
MEMORY = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, item long"
BINS = "id long, bin long, offset long, fill long"

# Texts of these characters only are split by WORDS below just as the tokenizer splits them; others go to it whole.
LETTERS = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœ"
OTHER = re.compile(rf"[^\t\n\r -~{LETTERS}{LETTERS.replace('ß', '').replace('ÿ', '').upper()}€£§°«»¿¡–—‘’“”…]|<\|")
WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LETTERS}]+|[0-9]|[^ \t\n\r0-9a-z{LETTERS}]+")


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        if len(self.known) > MEMORY:
            self.known.clear()
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words):
            self.known.update((w, self.whole(w)) for w in words)
            return
        raw, start = ids.tobytes(), 0
        for word, stop in zip(words, (cuts * 4).tolist(), strict=True):
            self.known[word] = raw[start:stop]
            start = stop

    def __call__(self, text: str) -> bytes:
        if OTHER.search(text):
            return self.whole(text)
        words = WORDS.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > MEMORY:
                self.known.clear()
            self.learn([w for w in dict.fromkeys(words) if w not in self.known])
            return b"".join(map(self.known.__getitem__, words))


def word_ids(path: str) -> WordIds:
    """One per worker, kept from task to task until the worker turns to another operator."""
    return kept(("tokenizer", path), lambda: WordIds(path))


def pieces_of(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc) of one document's ids, END included."""
    step = capacity * 4
    return [(k, k * capacity, len(part) // 4, zlib.crc32(part)) for k, i in enumerate(range(0, len(ids), step)) if (part := ids[i : i + step])]


def _tokenise(path: str, capacity: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, end = word_ids(path), struct.pack("<I", END)
        item = TaskContext.get().partitionId() << 33
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for piece in pieces_of(ids(text.as_py() or "") + end, capacity):
                    rows.append((doc, *piece, item))
                    item += 1
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return run


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: each size's bin, its offset there, and the bins' fills. Ties: first in input order."""
    order = np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist()
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r: a bin with r of room is open
    bins, offsets, fills = [0] * len(sizes), [0] * len(sizes), []
    for i in order:
        size = sizes[i]
        fitting = some >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                some &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        if room > size:
            rooms[room - size].append(b)
            some |= 1 << (room - size)
    return bins, offsets, fills


def _fit(level: int, capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by("id")
        bins, offsets, fills = best_fit(group.column("length").to_pylist(), capacity)
        first = (level << 52) + (group.column("g")[0].as_py() << 24)
        return pa.table({"id": group.column("id"), "bin": pa.array([first + b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int64()), "fill": pa.array([fills[b] for b in bins], pa.int64())})

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, group: int = GROUP, levels: int = LEVELS, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A null or empty text is the single end id; a very long one is read whole and cut into full pieces and a last one. Rows with equal or null ids stay documents of their own; other columns
    are ignored; an empty table gives no rows.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = saved(rows.mapInArrow(_tokenise(tokenizer, capacity), PIECES), "tokens")
    items = pieces.where(F.col("length") < capacity).select(F.col("item").alias("id"), "length")
    placed = None
    level, before = 0, None
    while True:
        left = items.count()
        groups = max(1, -(-left // group))
        dealt = items.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
        fitted = saved(dealt.groupBy("g").applyInArrow(_fit(level, capacity), BINS), f"level{level}")
        if placed is None:
            placed = fitted.select("id", "bin", "offset")
        else:
            upper = fitted.select(F.col("id").alias("bin"), F.col("bin").alias("to"), F.col("offset").alias("shift"))
            placed = placed.join(upper, "bin", "left").select("id", F.coalesce("to", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
        items = fitted.where(F.col("fill") < capacity - NEARLY).groupBy(F.col("bin").alias("id")).agg(F.first("fill").alias("length"))
        if groups == 1 or (level >= levels and before is not None and left >= before):
            break  # all underfull bins met, or, past the usual levels, the last one merged none
        level, before = level + 1, left
    found = pieces.join(placed.withColumnRenamed("id", "item"), "item", "left")
    full = F.lit(15 << 58 >> 1) + F.col("item")  # pieces of full length are sequences of their own
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("bin", full).alias("sequence_id"), F.coalesce("offset", F.lit(0)).cast("long").alias("offset"))
