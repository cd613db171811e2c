"""Licence notices and licence expressions in whole texts.

One Aho-Corasick automaton finds all notice phrases and identifier tags in a text's words; what follows a tag is read as
an expression of and, or and with, by a shunting-yard parser. Every licence has a level of what it asks of those who
reuse a text: alternatives count by the lightest, conjunctions by the heaviest, and an exception lightens what it limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases whose places are counted as base, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notices by their words; one within the place of another phrase does not count.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge to any person obtaining a copy": "mit", "isc license": "isc",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "boost software license": "bsl",
    "apache license": "apache", "apache software license": "apache", "mozilla public license": "mpl", "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl", "eclipse public license version 2": "epl-2", "eclipse public license v2": "epl-2",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3", "gnu gpl": "gpl", "gplv2": "gpl-2", "gplv3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu lesser general public license version 3": "lgpl-3", "gnu lesser general public license version 2": "lgpl-2", "lgplv3": "lgpl-3",
    "gnu affero general public license": "agpl", "gnu affero general public license version 3": "agpl-3", "agplv3": "agpl-3",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd", "cc0 1 0": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense", "all rights reserved": "all-rights-reserved",
}

#: Words of a tag, and whether any identifier may follow it or only known licences, after a colon or an equals sign.
TAGS = {"spdx license identifier": True, "license": False, "licence": False}

#: What the licences of a family ask for: 0 nothing, 1 that a text be left alone. A family is the longest beginning of an id.
LEVELS = {
    "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0, "mit": 0.2, "isc": 0.2, "bsd": 0.2, "bsl": 0.2, "zlib": 0.2, "apache": 0.2, "cc-by": 0.3, "python": 0.2, "postgresql": 0.2,
    "mpl": 0.5, "epl": 0.5, "cddl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.8, "agpl": 0.9, "sspl": 0.9, "cc-by-nc": 1.0, "cc-by-nd": 1.0, "all-rights-reserved": 1.0,
}
#: Of an identifier without a known family, and the most that a licence with an exception asks for.
UNKNOWN, EXCEPTED = 0.7, 0.5

#: Bytes of texts that one batch from Spark holds, besides the text that exceeds it.
BATCH_BYTES = 16 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_TABLE = bytes(c if chr(c).isdigit() and c < 128 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_TOKEN = re.compile(rb"[ \t]*([()]|[0-9a-z][0-9a-z.+:_-]*)")
_AFTER = {True: re.compile(rb"[ \t]*:?"), False: re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")}
_ORDER = {"or": 1, "and": 2, "with": 3}

FOUND = "doc_id {id}, n_words long, places array<struct<word:long,words:int,label:string,base:boolean>>, expressions array<struct<word:long,rpn:string,labels:array<string>,level:double>>"
_PLACE = pa.struct([("word", pa.int64()), ("words", pa.int32()), ("label", pa.string()), ("base", pa.bool_())])
_EXPRESSION = pa.struct([("word", pa.int64()), ("rpn", pa.string()), ("labels", pa.list_(pa.string())), ("level", pa.float64())])


class Place(NamedTuple):
    """A phrase in a text: its first word and their number."""

    word: int
    words: int
    label: str
    base: bool


class Expression(NamedTuple):
    """An expression behind a tag: the tag's first word, the parsed expression operators last, its licences, its level."""

    word: int
    rpn: list[str]
    labels: list[str]
    level: float


# ------------------------------------------------------------------ identifiers


def family(name: str) -> str | None:
    """The longest family that an identifier or label belongs to."""
    parts = re.split("[-_]", name)
    joined = ("-".join(parts[:n]) for n in range(len(parts), 0, -1))
    return next((f for f in joined if f in LEVELS), None)


def label_of(name: str) -> str:
    """An identifier without what only tells versions apart: apache-2.0 is apache-2, gpl-2.0-or-later gpl-2, cc-by-4.0 cc-by."""
    bare = re.sub(r"(-only|-or-later|\+)$", "", name)
    return re.sub(r"-\d+(\.\d+)*$", "", bare) if bare.startswith("cc") else re.sub(r"(?<=\d)\.0$", "", bare)


def level_of(name: str) -> float:
    known = family(name)
    return UNKNOWN if known is None else LEVELS[known]


def _operand(token: str, any_: bool) -> bool:
    """Whether a token can name a licence; behind a plain tag only those of known families do."""
    return family(token) is not None or any_ and ("-" in token or token.startswith("licenseref"))


# ------------------------------------------------------------------ expressions


def parse(tokens: Iterable[str], any_: bool = True) -> list[str]:
    """The longest expression at the start of the tokens, operators last; [] without any.

    Shunting-yard: with binds closer than and, and closer than or; equal operators from the left. The expression ends
    before the first token that cannot go on with it; an operator without a right side, and brackets that are never
    closed, count as not there.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether a licence must come next
    for token in tokens:
        if operand and token == "(" and (not stack or stack[-1] != "with"):
            stack.append(token)
        elif not operand and token in _ORDER:
            if token == "with" and out[-1] in _ORDER:  # an exception limits one licence
                break
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        elif not operand and token == ")" and "(" in stack:
            while (top := stack.pop()) != "(":
                out.append(top)
        elif operand and token not in _ORDER and token not in "()" and (stack[-1:] == ["with"] or _operand(token, any_)):
            out.append(token)
            operand = False
        else:
            break
    if operand:  # brackets opened last, and the operator before them, lead nowhere
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def evaluate(rpn: list[str]) -> tuple[float, list[str]]:
    """The level of a parsed expression, and the labels of its licences in order; exceptions are no licences."""
    stack: list[tuple[float, list[str]]] = []
    for token in rpn:
        if token not in _ORDER:
            stack.append((level_of(token), [label_of(token)]))
            continue
        (right, own), (left, labels) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((min(left, EXCEPTED), labels))
        else:
            stack.append((min(left, right) if token == "or" else max(left, right), labels + own))
    return stack[0]


def _tokens(raw: bytes, at: int) -> Iterator[str]:
    while m := _TOKEN.match(raw, at):
        at = m.end()
        yield m[1].decode().rstrip(".:")


# ------------------------------------------------------------------ texts


@lru_cache(maxsize=8)
def automaton(base: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...]) -> ahocorasick.Automaton:
    """Finds phrases of words between spaces: of each, its number of words, its label as base, as notice, and as tag."""
    found: dict[str, list] = {}
    for kind, phrases in enumerate((dict(base), dict(notices), TAGS)):
        for phrase, value in phrases.items():
            found.setdefault(phrase.encode().decode("latin-1"), [phrase.count(" ") + 1, None, None, None])[kind + 1] = value
    built = ahocorasick.Automaton()
    for phrase, value in found.items():
        built.add_word(f" {phrase} ", (len(phrase) + 2, *value))
    built.make_automaton()
    return built


def scan_text(text: str, machine: ahocorasick.Automaton) -> tuple[int, list[Place], list[Expression]]:
    """(words, places, expressions) of a text, in order. Words are runs of digits, lower-cased letters A-Z and all that is not ASCII."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(_TABLE).split()
    joined = b" %b " % b" ".join(words) if words else b""
    places: list[Place] = []
    tags: list[tuple[int, int, bool]] = []
    notices: list[Place] = []
    at = word = 0
    hits = sorted((end - size + 1, n, base, notice, tag) for end, (size, n, base, notice, tag) in machine.iter(joined.decode("latin-1")))
    for start, n, base, notice, tag in hits:
        word, at = word + joined.count(b" ", at, start), start
        if base is not None:
            places.append(Place(word, n, base, True))
        if notice is not None:
            notices.append(Place(word, n, notice, False))
        if tag is not None:
            tags.append((word, n, tag))
    kept, reach = [], -1
    for p in sorted(places + notices, key=lambda p: (p.word, -p.words, not p.base)):  # first those that begin before or reach further
        if p.base or p.word + p.words > reach:
            kept.append(p)
        reach = max(reach, p.word + p.words)
    return len(words), kept, list(_expressions(raw.lower(), tags)) if tags else []


def _expressions(raw: bytes, tags: list[tuple[int, int, bool]]) -> Iterator[Expression]:
    """The expressions behind tags (first word, words, whether any identifier counts), which stand in order."""
    ends, seen = _WORD.finditer(raw), 0
    for word, n, any_ in tags:
        last = word + n - 1
        if last < seen:  # a shorter tag within a longer one
            continue
        end = next(islice(ends, last - seen, None)).end()
        seen = last + 1
        if not (after := _AFTER[any_].match(raw, end)):
            continue
        if rpn := parse(_tokens(raw, after.end()), any_):
            level, labels = evaluate(rpn)
            yield Expression(word, rpn, labels, level)


def scan(docs: DataFrame, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, places, expressions) of documents (doc_id, text), a row for each row.

    places: (word, words, label, base) of every base phrase, and of notices that lie in no other place, by first word; expressions:
    (word, rpn, labels, level) behind identifier tags. A null text is an empty one; null ids, ties and repeated rows are
    rows like others; an empty table gives none; other columns, whatever their names, play no part. Very long texts are
    read whole: a task holds one batch, bounded by bytes, and of the text at hand a few copies.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    given = tuple(base.items()), tuple(notices.items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(*given)
        for batch in batches:
            found = [scan_text(t.as_py() or "", machine) for t in batch.column(1)]
            places = [[p._asdict() for p in f[1]] for f in found]
            expressions = [[e._asdict() | {"rpn": " ".join(e.rpn)} for e in f[2]] for f in found]
            yield pa.record_batch([batch.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array(places, pa.list_(_PLACE)), pa.array(expressions, pa.list_(_EXPRESSION))], ["doc_id", "n_words", "places", "expressions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, FOUND.format(id=kind))


def license_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_expressions) of `scan`'s rows.

    labels are distinct, in code-point order and joined by commas, empty without any; score is the heaviest level of
    what a text states, 0 if it states nothing.
    """
    found = scan(docs)
    levels = F.create_map(*(F.lit(x) for name in sorted({*BASE.values(), *NOTICES.values()}) for x in (name, level_of(name))))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    labels = F.concat(F.transform("places", lambda p: p["label"]), F.flatten(F.transform("expressions", lambda e: e["labels"])))
    all_levels = F.concat(F.transform("places", lambda p: levels[p["label"]]), F.transform("expressions", lambda e: e["level"]))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(F.transform(base, lambda p: p["label"])).alias("base_labels"), joined(labels).alias("labels"),
        F.coalesce(F.array_max(all_levels), F.lit(0.0)).alias("score"), F.size("expressions").cast("long").alias("n_expressions"),
    )
