"""Keep a search index up to date with a folder of document tables: each run indexes the files that came since the last.

    python -m jobs.index_feed --documents IN --output OUT --checkpoint CHECKPOINT [--config jobs/index_feed.json] [--compact TO]

Every micro-batch of new files becomes one segment of the index under OUT; a batch that is tried again replaces its own
segment, and the checkpoint says which files are done, so runs can be stopped and repeated. A document that comes again
replaces its earlier form; one that comes without text is withdrawn.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import shared
from terrane.operators import segments as S

log = logging.getLogger("terrane.jobs.index_feed")

DEFAULTS = {
    "columns": {"number": "doc_id", "folder": "source", "text": "text"},  # of the document tables
    "files_per_batch": 1000,  # new files that become one segment
}


def feed(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Index the new Parquet files at documents (a folder, or a pattern of paths), and return the index as it stands: see `contents`.

    Of rows with one number within a batch, that of the newest file counts, and within a file that with the greatest text
    digest; rows without a number are left out. Only new files are read.
    """
    chosen = DEFAULTS | (config or {})
    columns = chosen["columns"]
    types = {"number": "long", "folder": "string", "text": "string"}
    schema = ", ".join(f"`{columns[c]}` {t}" for c, t in types.items())

    def add(batch: DataFrame, number: int) -> None:
        S.add_segment(S.newest(shared.documents_of(batch, columns, "file_modification_time"), "file_modification_time"), output, number)
        log.info("segment %d: %d documents", number, S.read_table(spark, output, "documents").where(F.col("segment") == number).count())

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", chosen["files_per_batch"]).parquet(documents)
    rows = stream.select(*(f"`{columns[c]}`" for c in types), "_metadata.file_modification_time")
    query = rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    done = [p for p in query.recentProgress if p.numInputRows]
    log.info("read %d rows in %d batches from %s", sum(p.numInputRows for p in done), len(done), documents)
    found = S.read_table(spark, output, "postings")
    shared.partition_counts(found, "segment", log, f"{output}/postings")
    return contents(spark, output)


def contents(spark: SparkSession, output: str) -> DataFrame:
    """(doc, chunk_id, term, f, dl, df, weight): the live postings with the statistics and weights that searches use."""
    index = S.open_index(spark, output)
    rows = S.live_postings(index).join(index.chunks.select("chunk_id", "doc"), "chunk_id")
    return rows.select("doc", "chunk_id", "term", "f", "dl", "df", F.round("w", 6).alias("weight"))


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    for name in ("documents", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    parser.add_argument("--compact", metavar="TO", help="then write the live documents as one segment of a new index")
    given = parser.parse_args(arguments)
    spark = shared.session("index_feed")
    try:
        feed(spark, given.documents, given.output, given.checkpoint, shared.settings(spark, given.config, DEFAULTS))
        log.info("the index holds %d documents", S.live_documents(spark, given.output).count())
        if given.compact:
            S.compact(spark, given.output, given.compact)
            log.info("wrote one segment to %s", given.compact)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
