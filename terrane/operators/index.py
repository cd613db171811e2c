"""The BM25 index as tables, and searches over whole batches of queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions.text import keeps, stem, words
from ..sources.storage import BUCKETS, stored, stored_by
from .batch import K1, B, best_of_areas

#: Turns of a conversation that count, and the weight of words of the last and of earlier ones.
TURNS, LAST, EARLIER = 6, 1.0, 0.4
#: Characters of a chunk that a context shows.
PASSAGE_CHARS = 1200
#: So many distinct words of a batch of queries are given to the scan of the weights as a filter, a few in each part of it,
#: as Parquet readers look up only short lists word by word.
PUSHED, LISTED = 100, 10
#: Weights in a bucket; words of queries, and bitmaps of sets, that are sent to every task instead of dealing the weights.
BUCKET_ROWS, SENT_TERMS, SENT_BITMAPS = 125_000, 500_000, 5_000
#: Characters of chunks that one task counts the words of, and rows of postings that one task joins or adds up.
TASK_CHARS, TASK_ROWS = 4_000_000, 1_000_000
#: Terms with more than one in so many of the postings go to every task, so these are at most as many terms.
OFTEN = 50_000


@dataclass
class Index:
    """chunks(chunk_id, doc, title, section, text), postings(chunk_id, term, f), lengths(chunk_id, dl, chars), terms(term, df, idf),
    corpus(n, avgdl), and what searches read: weights(term, chunk_id, w, id), where id is the chunk's area or null. packed: the
    postings as rows of chunks, if there are such: searches for the best of each area then read these instead of weights."""

    chunks: DataFrame
    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame
    corpus: DataFrame
    weights: DataFrame
    packed: DataFrame | None = None


def chunk_words(chunks: DataFrame) -> DataFrame:
    """(chunk_id, word) of every word that counts in title, section and text."""
    body = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("section", F.lit("")), F.coalesce("text", F.lit("")))
    return chunks.select("chunk_id", F.explode(words(body)).alias("word")).where(keeps(F.col("word")))


def count_tasks(chunks: DataFrame) -> int:
    """Tasks that count the words of chunks, as many as the characters ask for."""
    return min(chunks.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // TASK_CHARS + 1, BUCKETS)


def term_frequencies(chunks: DataFrame, n: int | None = None) -> DataFrame:
    """(chunk_id, term, f). Chunks are dealt by their id first, so neither of the two counts shuffles words; words are
    counted before they are stemmed, each once a chunk. The tasks are as many as the characters ask for, so that what one
    of them counts does not grow with the corpus."""
    dealt = chunks.select("chunk_id", "title", "section", "text").repartition(n or count_tasks(chunks), "chunk_id")
    counted = chunk_words(dealt).groupBy("chunk_id", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("chunk_id", stem(F.col("word")).alias("term")).agg(F.sum("n").alias("f"))


def stored_postings(chunks: DataFrame) -> DataFrame:
    """Term frequencies, written in buckets by chunk as they were counted: joins by chunk deal only their other side."""
    n = count_tasks(chunks)
    return stored_by(term_frequencies(chunks, n), "postings", "chunk_id", n, "chunk_id", dealt=True)


def tasks(rows: int) -> int:
    """Partitions for so many rows: what one task takes does not grow with the corpus."""
    return min(rows // TASK_ROWS + 1, BUCKETS)


def with_terms(rows: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """The join of n rows (.., term, ..) with a written table of all their terms (term, df, ..).

    Frequent terms, which most rows hold, go to every task; only rows of the others are dealt by term, so that no term
    makes a task large.
    """
    bar = n // OFTEN
    often, names = F.broadcast(terms.where(F.col("df") > bar)), [c for c in terms.columns if c != "term"]
    known = rows.join(often, "term", "left")
    rare = known.where("df is null").drop(*names).repartition(tasks(n), "term").join(terms.where(F.col("df") <= bar), "term")
    return rows.join(often, "term").unionByName(rare)


def passage_text(text: Column) -> Column:
    """What a context shows of a chunk."""
    return F.when(F.length(text) <= PASSAGE_CHARS, text).otherwise(F.concat(F.substring(text, 1, PASSAGE_CHARS), F.lit(" ...")))


def chunk_lengths(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """(chunk_id, dl, chars): terms, and characters of the passage. Chunks without any term have length 0."""
    sums = postings.groupBy("chunk_id").agg(F.sum("f").alias("dl"))
    shown = chunks.select("chunk_id", F.coalesce(F.length(passage_text(F.col("text"))), F.lit(0)).alias("chars"))
    return shown.join(sums, "chunk_id", "left").select("chunk_id", F.coalesce("dl", F.lit(0)).cast("long").alias("dl"), "chars")


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_statistics(postings: DataFrame, corpus: DataFrame) -> DataFrame:
    counted = postings.groupBy("term").agg(F.count("*").alias("df"))
    return counted.crossJoin(F.broadcast(corpus)).select("term", "df", inverse_frequency(F.col("n"), F.col("df")).alias("idf"))  # corpus is one row


def surface_forms(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """The most frequent spelling of each stem; ties go to the first in alphabetical order. terms: only the stems in it."""
    spelt = chunk_words(chunks).select(stem(F.col("word")).alias("term"), F.col("word").alias("surface"))
    if terms is not None:
        spelt = spelt.join(terms.select("term").distinct(), "term", "left_semi")
    counted = spelt.groupBy("term", "surface").agg(F.count("*").alias("n"))
    best = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("n"), "surface"))
    return counted.withColumn("nth", best).where("nth = 1").select("term", "surface")


def weight() -> Column:
    """What one use of a term in a query adds to a chunk's score."""
    return F.col("idf") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))


def term_weights(postings: DataFrame, lengths: DataFrame, terms: DataFrame, corpus: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id, w, id): what one use of a term in a query adds to a chunk's score, and the chunk's area.

    Postings of a chunk lie together, as the last exchange is by chunk, and are sorted by term: a search adds up a chunk's
    score where it lies, a term of many chunks is many tasks, and a question that names few terms reads only the row
    groups that hold them.
    members: (id, chunk_id), at most one area a chunk.
    """
    sized = lengths.select("chunk_id", "dl")
    sized = sized.withColumn("id", F.lit(None).cast("string")) if members is None else sized.join(members.select("chunk_id", "id"), "chunk_id", "left")
    joined = postings.join(terms.select("term", "idf"), "term").crossJoin(F.broadcast(corpus)).join(sized, "chunk_id")  # corpus is one row
    return joined.select("term", "chunk_id", weight().alias("w"), "id").sortWithinPartitions("term", "chunk_id")


def stored_weights(weights: DataFrame, rows: int) -> DataFrame:
    """So many weights, written so that all of a chunk lie in one bucket: a search adds up and sifts where they lie, in tasks
    whose size does not depend on the corpus."""
    return stored_by(weights, "weights", "chunk_id", rows // BUCKET_ROWS + 1, "term", "chunk_id")


def build_index(chunks: DataFrame, members: DataFrame | None = None) -> Index:
    postings = term_frequencies(chunks)
    lengths = chunk_lengths(chunks, postings)
    corpus = corpus_statistics(lengths)
    terms = term_statistics(postings, corpus)
    return Index(chunks, postings, lengths, terms, corpus, term_weights(postings, lengths, terms, corpus, members))


def query_terms(turns: DataFrame) -> DataFrame:
    """(query_id, term, weight, pos) of the last turns of each conversation; pos is the place of first use.

    turns: (query_id, turn, text). Empty turns are dropped before the window is taken.
    """
    recent = Window.partitionBy("query_id").orderBy(F.desc("turn"))
    kept = turns.where("text <> ''").withColumn("back", F.row_number().over(recent)).where(f"back <= {TURNS}")
    spoken = kept.select("query_id", "turn", (F.col("back") == 1).alias("last"), F.posexplode(words(F.col("text"))).alias("at", "word")).where(keeps(F.col("word")))
    weight = F.sum(F.when(F.col("last"), LAST).otherwise(EARLIER))
    found = spoken.groupBy("query_id", stem(F.col("word")).alias("term")).agg(weight.alias("weight"), F.min(F.struct("turn", "at")).alias("first"))
    return found.select("query_id", "term", "weight", F.row_number().over(Window.partitionBy("query_id").orderBy("first")).alias("pos"))


def sought(queries: DataFrame, index: Index) -> DataFrame:
    """The weights of the terms that the queries name: where these are few, the scan itself gets them as a filter."""
    terms = [r["term"] for r in queries.select("term").distinct().limit(PUSHED + 1).collect()]  # at most PUSHED + 1 words
    if len(terms) > PUSHED:
        return index.weights
    return index.weights.where(reduce(or_, (F.col("term").isin(terms[i : i + LISTED]) for i in range(0, len(terms), LISTED)), F.lit(False)))


def chunk_sets(sets: DataFrame) -> DataFrame:
    """(set_id, bucket, bits) of sets (set_id, chunk_id): a bitmap for each 32,768 ids that a set reaches into."""
    at = F.bitmap_construct_agg(F.bitmap_bit_position("chunk_id")).alias("bits")
    return sets.where("chunk_id is not null").groupBy("set_id", F.bitmap_bucket_number("chunk_id").alias("bucket")).agg(at)


def has_bit(bits: Column, at: Column) -> Column:
    """Whether a bitmap has a bit at a place; a null one has none."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def _in_sets(hits: DataFrame, sets: DataFrame) -> DataFrame:
    """Hits (.., set_id, chunk_id) that lie in their set; those without a set stay.

    A bitmap is 4 KB for up to 32,768 chunks and belongs to all questions that share the set, so it is the small side:
    hits are sifted before they are added up and dealt.
    """
    bitmaps = stored(chunk_sets(sets), "sets")
    bitmaps = F.broadcast(bitmaps) if bitmaps.count() <= SENT_BITMAPS else bitmaps
    known = hits.withColumn("bucket", F.bitmap_bucket_number("chunk_id")).join(bitmaps, ["set_id", "bucket"], "left")
    return known.where(F.col("set_id").isNull() | has_bit(F.col("bits"), F.bitmap_bit_position("chunk_id")))


def score_chunks(queries: DataFrame, index: Index, keys: tuple[str, ...] = ("query_id",), within: bool = False, sets: DataFrame | None = None) -> DataFrame:
    """BM25 sums: (*keys, chunk_id, score, id) of queries (*keys, term, weight). within: only chunks of the area domain_id.
    sets: (set_id, chunk_id); a query with a set_id finds only chunks of that set, none if it is empty, and one with null all.

    One join, and no exchange behind it where the weights lie in buckets by chunk: see `stored_weights`. The queries are the
    small side of the join and go to every task; more than SENT_TERMS words are left to Spark, which deals both sides by
    term where they are too large, and then each pair of query and chunk.
    """
    asked = queries.where("weight > 0")
    asked = F.broadcast(asked) if asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS else asked
    weights = sought(queries, index)
    hits = asked.join(weights, [F.col("domain_id") == F.col("id"), asked["term"] == weights["term"]]) if within else asked.join(weights, "term")
    if sets is not None:
        hits = _in_sets(hits, sets)
    return hits.groupBy(*keys, "chunk_id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"), F.first("id").alias("id"))


def best_chunks(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(query_id, id, chunk_id, score): the k best chunks of every query within each area, and outside any.

    All that rankings of up to k chunks and the relevance of areas draw on. Scores of other chunks are dropped by each
    task before they are dealt by area, so neither the exchange nor what is written of it grows with the corpus.
    """
    if index.packed is not None:
        scores = best_of_areas(queries, index.packed, index.terms, index.corpus, k, ("query_id",), SENT_TERMS)
    else:
        scores = score_chunks(queries, index)
    return ranked(scores, ("query_id", "id"), k).select("query_id", "id", "chunk_id", "score")


def best_within(queries: DataFrame, index: Index, keys: tuple[str, ...], k: int) -> DataFrame:
    """(*keys, chunk_id, score, rank): the k best chunks of every query (*keys, term, weight) in its area, the key domain_id."""
    if index.packed is not None:
        scores = best_of_areas(queries, index.packed, index.terms, index.corpus, k, keys, SENT_TERMS)
    else:
        scores = score_chunks(queries, index, keys, True)
    return ranked(scores.drop("id"), keys, k)


def ranked(scores: DataFrame, keys: tuple[str, ...] = ("query_id",), k: int | None = None) -> DataFrame:
    """Adds rank within the keys: higher score first, ties by chunk_id; scores count to nine places."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    out = scores.withColumn("rank", nth)
    return out if k is None else out.where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, k: int = 8, sets: DataFrame | None = None) -> DataFrame:
    """The k best chunks of every query; with sets, queries have a set_id: see `score_chunks`."""
    return ranked(score_chunks(queries, index, sets=sets), k=k)
