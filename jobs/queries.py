"""The jobs as registered queries, each run twice into one new folder, and their SQL."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from jobs import context_packs, index_feed
from terrane.plans import oracle
from terrane.sources.storage import scratch

CONFIG = json.loads(Path(__file__).with_name("context_packs.json").read_text(encoding="utf-8"))


def job1_context_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds the first one's tables and replaces them."""
    out = scratch(spark, "packs")
    for _ in range(2):
        packs = context_packs.pack(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/conversations.parquet", out, CONFIG)
    return packs


def job2_index_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new. A stream reads a folder or a pattern; this one also finds a single file."""
    out = scratch(spark, "feed")
    for _ in range(2):
        index = index_feed.feed(spark, f"{sf_dir}/documents.parque[t]", f"{out}/index", f"{out}/checkpoint")
    return index


QUERIES = {"job1_context_packs": job1_context_packs, "job2_index_feed": job2_index_feed}

_TURNS = {
    "kept": "SELECT conv_id AS query_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE text <> ''",
    "heard": "SELECT query_id, turn, back, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS place FROM kept WHERE back <= 6",
    "q": f"SELECT query_id, {oracle._stem('word')} AS term, sum(CASE WHEN back = 1 THEN 1e0 ELSE 0.4e0 END) AS weight FROM heard WHERE {oracle._keeps('word')} GROUP BY 1, 2",
    "said": f"SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(turn * 1000000 + place)) AS pos FROM (SELECT query_id, turn, place, {oracle._stem('word')} AS term FROM heard WHERE {oracle._keeps('word')}) GROUP BY 1, 2",
    "signals": f"SELECT * FROM (VALUES {oracle._values([(k, i, p) for k, v in CONFIG['areas'].items() for i, p in enumerate(v.get('signals', []))])}) AS t(id, nth, phrase)",
    "modes": f"SELECT * FROM (VALUES {oracle._values([(k, v.get('authority', 'project')) for k, v in CONFIG['areas'].items()])}) AS t(id, authority)",
}

ORACLES = {
    "job1_context_packs": oracle.composed("SELECT query_id, n, doc, section, " + oracle._PASSAGE + f", via, CASE WHEN domain_id = '' THEN '{context_packs.NONE}' ELSE domain_id END AS area FROM packed JOIN chunks USING (chunk_id)", **oracle.CUT, **_TURNS),
    "job2_index_feed": oracle.composed(
        "SELECT doc, chunk_id, term, f, dl, df, round(idf * f * 2.4e0 / (f + 1.4e0 * (0.25e0 + 0.75e0 * dl / avgdl)), 6) AS weight FROM postings JOIN lengths USING (chunk_id) JOIN terms USING (term) JOIN chunks USING (chunk_id), corpus", **oracle.CUT
    ),
}
