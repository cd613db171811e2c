"""Fill-in-the-middle arrangements of whole texts, and their way back, as SQL expressions alone.

A text is an array of units (white space with the word behind it); digits of a hash of the document's id choose two cuts
and a form, and slices of the array make prefix, middle and suffix. What was arranged is read back by its sentinels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: A word with the white space before it, or white space that ends the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 42, 50, 80


def _digits(key: Column, nth: int) -> Column:
    """The nth group of eight hexadecimal digits as an unsigned number."""
    return F.conv(F.substring(key, 8 * nth + 1, 8), 16, 10).cast("long")


def _sound(sentinels: tuple[str, str, str]) -> None:
    """Sentinels can be told apart in any text only if none is empty, holds another, or ends as one begins."""
    pairs = [(a, b) for i, a in enumerate(sentinels) for j, b in enumerate(sentinels) if i != j]
    if not all(sentinels) or any(a in b for a, b in pairs) or any(a.endswith(b[:k]) for a in sentinels for b in sentinels for k in range(1, len(b))):
        raise ValueError("sentinels must be three different texts of which none ends as another begins")


def _made(rows: DataFrame, seed: int, rate: int, spm: int, sentinels: tuple[str, str, str]) -> DataFrame:
    """(row, n, form, prefix_chars, middle_chars, output) of (row, id, text); row is carried along unread."""
    _sound(sentinels)
    first, last, middle = map(F.lit, sentinels)
    # what a step makes is used several times by the next, and so computed once a row
    rows = rows.select("row", F.coalesce("text", F.lit("")).alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("key"))
    rows = rows.select("row", "text", "key", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"))
    at = [F.pmod(_digits(F.col("key"), i), F.size("units") + 1).cast("int") for i in (0, 1)]
    plain = (F.col("text") == "") | (_digits(F.col("key"), 2) % 100 >= rate)
    for s in (first, last, middle):
        plain = plain | F.contains("text", s)
    form = F.when(plain, "plain").when(_digits(F.col("key"), 3) % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("row", "text", "units", F.size("units").alias("n"), form.alias("form"), F.least(*at).alias("a"), F.greatest(*at).alias("b"))
    part = lambda start, length: F.array_join(F.slice("units", start, length), "")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    parts = F.struct(part(F.lit(1), a).alias("p"), part(a + 1, b - a).alias("m"), part(b + 1, n - b).alias("s"))
    rows = rows.select("row", "text", n.cast("long").alias("n"), "form", F.when(F.col("form") != "plain", parts).alias("parts"))
    p, m, s = F.col("parts.p"), F.col("parts.m"), F.col("parts.s")
    output = F.when(F.col("form") == "psm", F.concat(first, p, last, s, middle, m)).when(F.col("form") == "spm", F.concat(last, s, first, p, middle, m)).otherwise(F.col("text"))
    return rows.select("row", "n", "form", F.length(p).cast("long").alias("prefix_chars"), F.length(m).cast("long").alias("middle_chars"), output.alias("output"))


def arranged(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of documents (doc_id, text), a row for each row.

    rate of 100 documents are arranged, and spm of 100 of these with the suffix first. A null text is an empty one, a null
    id is hashed as an empty one; empty texts and texts that hold a sentinel stay plain. Equal rows get equal results, very
    long texts are cut whole, an empty table gives none, and other columns, whatever their names, play no part.
    """
    made = _made(docs.select(F.col("doc_id").alias("row"), F.col("doc_id").alias("id"), "text"), seed, rate, spm, sentinels)
    return made.withColumnRenamed("row", "doc_id")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of a form was made from, by its sentinels alone; null for null."""
    _sound(sentinels)
    pieces = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    return F.when(form == "psm", F.concat(pieces[1], pieces[3], pieces[2])).when(form == "spm", F.concat(pieces[2], pieces[3], pieces[1])).otherwise(output)


def transform(docs: DataFrame, form_column: str = "form", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """The documents with their texts arranged, and one more column that names the form, by which `restored` goes.

    Rows and cases as in `arranged`; the other columns stay as they are, carried as one, so that no name can clash. A
    table that already has a column of the form's name is refused.
    """
    if form_column.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"the table has a column {form_column} already")
    made = _made(docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), "text"), seed, rate, spm, sentinels)
    return made.select(F.col("row").withField("text", F.col("output")).alias("row"), F.col("form").alias(form_column)).select("row.*", form_column)


def infill_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): digests of outputs and of what they
    are read back as; rows and cases as in `arranged`."""
    rows = arranged(docs)
    digest = lambda c: F.sha2(c, 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
