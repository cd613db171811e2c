"""Published sources under watch, line differences, evaluation reports and model replies."""

from __future__ import annotations

import difflib
import json
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..sources.documents import html_to_text

# The most that is read of a source, and how long an answer may take.
FETCH_BYTES, FETCH_SECONDS = 10 << 20, 60
#: Words of an item that are looked up, and characters of shorter items that one automaton seeks.
QUOTED, BLOCK_CHARS = 4, 4_000_000
_DECODER = json.JSONDecoder()


def fetch_page(url: str) -> tuple[str, bool]:
    """A published source, and whether it is HTML by its content type or its beginning."""
    request = urllib.request.Request(url, headers={"user-agent": "terrane-watch/1"})
    with urllib.request.urlopen(request, timeout=FETCH_SECONDS) as answer:
        kind, raw = answer.headers.get("content-type", ""), answer.read(FETCH_BYTES).decode("utf-8", "ignore")
    return raw, "html" in kind or "<html" in raw[:500].lower()


def fetch_sources(watched: DataFrame, fetch=fetch_page) -> DataFrame:
    """(id, url, text, error) of watched (id, url); executors fetch, and a source that fails gives its error.

    fetch gives the source and whether it is HTML, or plain text alone.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for key, url in zip(frame["id"], frame["url"], strict=True):
                try:
                    got = fetch(url)
                    raw, page = got if isinstance(got, tuple) else (got, False)
                    rows.append((key, url, raw, page, None))
                except Exception as e:  # whatever a source does wrong must not stop the others
                    rows.append((key, url, None, False, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["id", "url", "raw", "page", "error"])

    rows = watched.select("id", "url").mapInPandas(run, "id string, url string, raw string, page boolean, error string")
    read = html_to_text(rows.withColumn("html", F.when(F.col("page"), F.col("raw"))))
    return read.select("id", "url", F.when(F.col("page"), F.col("text")).otherwise(F.col("raw")).alias("text"), "error")


def watch_status(state: DataFrame, fetched: DataFrame) -> DataFrame:
    """(id, status, sha256) per fetched source: error, new, changed, awaiting review or unchanged.

    state: (id, sha256, accepted_sha, latest_text); fetched: (id, text, error). A changed source whose earlier text was
    empty counts as new.
    """
    digest = F.sha2("text", 256)
    joined = fetched.select("id", "text", "error").join(state, "id", "left")
    same = F.col("sha256").eqNullSafe(digest)
    status = (
        F.when(F.col("error").isNotNull(), "error")
        .when(same & F.col("accepted_sha").eqNullSafe(digest), "unchanged")
        .when(same, "awaiting review")
        .when(F.coalesce("latest_text", F.lit("")) == "", "new")
        .otherwise("changed")
    )
    return joined.select("id", status.alias("status"), F.when(F.col("error").isNull(), digest).alias("sha256"))


def changed_lines(old: str, new: str) -> tuple[list[str], list[str]]:
    """Lines added and removed, by the longest matching blocks."""
    a, b = (old or "").splitlines(), (new or "").splitlines()
    added, removed = [], []
    for kind, i, j, k, n in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if kind != "equal":
            removed += a[i:j]
            added += b[k:n]
    return added, removed


def line_diff(pairs: DataFrame) -> DataFrame:
    """(id, lines_added, lines_removed, sample_added, sample_removed) of (id, old, new); samples are five lines with text."""

    def run(frames):
        for frame in frames:
            found = [changed_lines(o, n) for o, n in zip(frame["old"], frame["new"], strict=True)]
            some = lambda lines: [x for x in lines if x.strip()][:5]
            yield pd.DataFrame({"id": frame["id"], "lines_added": [len(a) for a, _ in found], "lines_removed": [len(r) for _, r in found], "sample_added": [some(a) for a, _ in found], "sample_removed": [some(r) for _, r in found]})

    kind = pairs.schema["id"].dataType.simpleString()
    return pairs.select("id", "old", "new").mapInPandas(run, f"id {kind}, lines_added int, lines_removed int, sample_added array<string>, sample_removed array<string>")


def quotations(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, doc) of the chunks that hold an item's whole text, whatever its length; an empty item is held by none.

    Four words inside an item of six or more stand between spaces in any text that holds it, so their hash is looked up
    among the text's runs of four words; what is found is compared in full. Only ids and hashes meet in that join.
    Shorter items are sought in every text: see `short_quotations`.
    """
    hashed = lambda words, i: F.xxhash64(*(F.get(words, i + j) for j in range(QUOTED)))
    said = F.split("item", r"\s+")
    keys = items.where(F.size(said) >= QUOTED + 2).select("query_id", "item", hashed(said, F.lit(1)).alias("key"))
    # the words as a variable of a function are split once, not once for each run
    hashes = F.transform(F.array(F.split("text", r"\s+")), lambda words: F.when(F.size(words) >= QUOTED, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - QUOTED), lambda i: hashed(words, i)))))
    runs = chunks.select("chunk_id", F.explode(hashes[0]).alias("key"))
    found = runs.join(keys.select("query_id", "key"), "key").select("query_id", "chunk_id").distinct()
    held = chunks.select("chunk_id", "doc", "text").join(found, "chunk_id").join(items.select("query_id", "item"), "query_id")
    return held.where(F.expr("contains(text, item)")).select("query_id", "chunk_id", "doc").unionByName(short_quotations(items.where(F.size(said) < QUOTED + 2), chunks))


def short_quotations(items: DataFrame, chunks: DataFrame) -> DataFrame:
    """The same for items that words cannot be looked up for: one automaton of many items runs over every text.

    Items are dealt into blocks of about BLOCK_CHARS characters, which are counted while the plan is built; the texts
    are read once for each block, and a task holds the automaton of one block. Texts do not move.
    """
    short = items.where("item <> ''")
    total = short.select("item").distinct().agg(F.coalesce(F.sum(F.length("item") + 1), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_CHARS)
    ids = chunks.schema["chunk_id"].dataType.simpleString()
    block = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    groups = ([r["item"] for r in short.where(block == b).select("item").distinct().collect()] for b in range(blocks))
    found = [chunks.select("chunk_id", "doc", "text").mapInArrow(_holding(group), f"chunk_id {ids}, doc string, item string") for group in groups if group]
    if not found:
        return items.join(chunks.select("chunk_id", "doc").limit(0), F.lit(False)).select("query_id", "chunk_id", "doc")
    return reduce(DataFrame.unionByName, found).join(short, "item").select("query_id", "chunk_id", "doc")


def _holding(patterns: list[str]) -> Callable:
    """(chunk_id, doc, item) of texts (chunk_id, doc, text): a row for each pattern that a text holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for p in patterns:
            machine.add_word(p, p)
        machine.make_automaton()
        for batch in batches:
            for i, text in enumerate(batch.column(2)):
                held = sorted({p for _, p in machine.iter(text.as_py() or "")})
                if held:
                    row = pa.array([i] * len(held))
                    yield pa.record_batch([batch.column(0).take(row), batch.column(1).take(row), pa.array(held, pa.string())], ["chunk_id", "doc", "item"])

    return run


def evaluation_rows(questions: DataFrame, plain: DataFrame, packed: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(query_id, baseline_hit, engine_hit, active): whether any returned document's path holds the expected string, and the
    labels of the areas that were active, in their order; active: (query_id, state, nth, label)."""
    hits = lambda found, name: found.join(questions.select("query_id", "expect"), "query_id").groupBy("query_id").agg(F.max(F.expr("contains(doc, expect)")).alias(name))
    rows = questions.join(hits(plain, "baseline_hit"), "query_id", "left").join(hits(packed, "engine_hit"), "query_id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("baseline_hit", "engine_hit")})
    if active is None:
        return rows
    labels = F.transform(F.array_sort(F.collect_list(F.struct("nth", "label"))), lambda x: x["label"])  # of at most four areas
    shown = active.where("state = 'active'").groupBy("query_id").agg(labels.alias("active"))
    return rows.join(shown, "query_id", "left").withColumn("active", F.coalesce("active", F.array().cast("array<string>")))


def recall(rows: DataFrame) -> DataFrame:
    share = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 6)
    return rows.agg(F.count("*").alias("questions"), share("baseline_hit").alias("baseline_recall"), share("engine_hit").alias("engine_recall"))


def outcome(rows: DataFrame) -> DataFrame:
    """Adds bucket: rescued, lost, both_missed or both_hit."""
    b, e = F.col("baseline_hit"), F.col("engine_hit")
    return rows.withColumn("bucket", F.when(e & ~b, "rescued").when(b & ~e, "lost").when(~b & ~e, "both_missed").otherwise("both_hit"))


def json_part(reply: Column) -> Column:
    """The part of a model's reply that holds its object, or else its array, as a variant; null without either.

    A part reaches from the first opening to the last closing bracket, so fences and chatter around it do not matter.
    """

    def value(pattern: str) -> Column:
        part = F.nullif(F.regexp_extract(reply, pattern, 0), F.lit(""))
        # the parser passes over what follows a value, but not within brackets
        items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), part, F.lit("]"))), "$", "array<variant>")
        return F.when(F.size(items) == 1, items[0])

    return F.coalesce(value(r"(?s)\{.*\}"), value(r"(?s)\[.*\]"))


def extract_json(reply: str):
    """The same for one reply on the driver, as Python values."""
    for opening, closing in ("{}", "[]"):
        start = reply.find(opening)
        if start < 0:
            continue
        try:
            found, end = _DECODER.raw_decode(reply, start)
        except json.JSONDecodeError:
            continue
        if reply.find(closing, end) < 0:  # otherwise the last bracket lies beyond the value
            return found
    raise ValueError("the reply holds no JSON")
