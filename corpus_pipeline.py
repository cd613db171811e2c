"""The corpus pipeline: rate, identify, deduplicate, mix and pack the documents; each stage is one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import language, mixing, neardup, packing, quality
from terrane.llm.common import saved, table
from terrane.llm.queries import tokenizer_path


# What all stages share: columns stay as they are, whatever their names; an empty table stays empty; null ids and repeated
# rows are rows like others; very long texts are read whole.


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade reaches the model's bar stay. Null texts, and texts without words
    or punctuation, go; without any label nothing can be graded and the bar is one half."""
    return quality.keep_selected(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one language for at least half of their letters stay; all stay where no language can be learned.
    Null texts and texts without letters go."""
    return language.keep_identified(docs, language.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the least id; documents with a null text all stay."""
    return neardup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target asks for. A null text has size 0, null sources are one source,
    and equal rows share one decision."""
    return mixing.emit_mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents as pieces in sequences of 4096 tokens, a row for each piece; a null text is an empty one, and
    each copy of a document is packed by itself."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", select_quality),
    ("language identification", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("sequence packing", pack_sequences),
]

#: The stages learn models and compare shingles, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; between two stages the rows are a written table."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs, f"stage{number}")
    return docs
