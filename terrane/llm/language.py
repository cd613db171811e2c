"""Language identification of mixed-language text.

Script ranges narrow the candidate languages of each word, hashed character n-grams score it per candidate, and
Viterbi with a switching penalty labels spans; a document's language is the one with most letters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, release

#: About so many labelled documents of each language are used to fit the word model.
DOCS_PER_LANGUAGE = 1500
BUCKETS = 1 << 16
#: Log-probability that a change of language costs, and what a word in a script a language does not use costs it.
SWITCH, WRONG_SCRIPT = 12.0, 40.0
#: A language uses a script that holds at least this part of its letters.
SCRIPT_SHARE = 0.01
#: Characters labelled at a time, and words that one worker remembers before it starts anew.
CHARS, MEMORY = 6_000_000, 400_000
UND = "und"
# Words: letters by their Unicode category, each with the combining marks behind it. Word characters of Python's that are
# numbers (as fractions and superscripts) are no letters.
# Nothing but the two strings is held: a list of all characters would take 147 MB of the driver and of each Python worker.
_NUMBERS, _MARKS = ("".join(re.escape(c) for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c)[0] == wanted) for wanted in "NM")
WORD = re.compile(f"(?:[^\\W\\d_{_NUMBERS}][{_MARKS}]*)+")
# The same where a text has no such number and no mark, which is told in two steps: by ranges, then exactly.
_PLAIN, _MAYBE, _SURELY = re.compile(r"[^\W\d_]+"), re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\u0300-\U0010ffff]"), re.compile(f"[{_NUMBERS}{_MARKS}]")


def pattern_of(text: str) -> re.Pattern:
    """The pattern of the text's words: the plain one wherever it finds the same."""
    return WORD if _MAYBE.search(text) and _SURELY.search(text) else _PLAIN


def words_of(text: str) -> list[str]:
    return pattern_of(text).findall(text)
# Starts of script ranges (code points), each up to the next start, with a name for each.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"),
    (0x3040, "kana"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = sorted({n for _, n in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS], np.uint32)
_SCRIPT_OF = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])


def scripts_of(points: np.ndarray) -> np.ndarray:
    return _SCRIPT_OF[np.searchsorted(_STARTS, points, "right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number and bucket of every n-gram of one to four characters (edges marked), and each word's script."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32)
    gap = points == 32
    word = np.cumsum(gap) - 1
    numbers, buckets = [], []
    hashed = np.full(len(points), 2166136261, np.uint32)
    for n in range(1, 5):
        m = len(points) - n + 1
        hashed = (hashed[:m] ^ points[n - 1 :]) * np.uint32(16777619)
        hashed ^= hashed >> np.uint32(15)
        fine = ~gap[:m] if n == 1 else np.ones(m, bool)
        if n == 2:
            fine = ~(gap[:m] & gap[1:])
        for k in range(1, n - 1):
            fine &= ~gap[k : k + m]
        numbers.append(word[:m][fine])
        buckets.append((hashed[fine] * np.uint32(2654435769)) >> np.uint32(16))
    first = np.flatnonzero(gap[:-1]) + 1
    return np.concatenate(numbers), np.concatenate(buckets).astype(np.int64), scripts_of(points[first])[: len(words)]


@dataclass
class WordModel:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages, log-probabilities
    allowed: np.ndarray  # scripts x languages

    def scores(self, words: list[str]) -> np.ndarray:
        """words x languages: mean log-probability per n-gram size, best language at 0."""
        word, bucket, script = grams(words)
        out = np.stack([np.bincount(word, self.table[bucket, i], len(words)) for i in range(len(self.languages))], 1) / 3
        ok = self.allowed[script]
        out -= WRONG_SCRIPT * (~ok & ok.any(1, keepdims=True))
        return out - out.max(1, keepdims=True)


def fit(counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]) -> WordModel:
    languages = sorted(counts)
    matrix = np.stack([counts[x] for x in languages], 1) + 0.5 if languages else np.zeros((BUCKETS, 0))
    allowed = np.stack([scripts[x] >= SCRIPT_SHARE * max(scripts[x].sum(), 1) for x in languages], 1) if languages else np.zeros((len(SCRIPT_NAMES), 0), bool)
    return WordModel(languages, np.log(matrix / matrix.sum(0)), allowed)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Best label of every word of several documents at once; scores are stacked by document. Ties: smaller label."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents with more than t words
    labels = np.zeros(len(scores), np.int16)
    total = np.zeros((len(sizes), scores.shape[1]))
    stays: list[np.ndarray] = []
    froms: list[np.ndarray] = []
    for t in range(longest):
        n = live[t]
        now = total[:n]
        if t:
            best = now.max(1, keepdims=True) - penalty
            stays.append(now >= best)
            froms.append(now.argmax(1))
            np.maximum(now, best, out=now)
        now += scores[starts[:n] + t]
    at = total.argmax(1) if longest else np.zeros(0, int)
    rows = np.arange(len(sizes))
    for t in range(longest - 1, -1, -1):
        n = live[t]
        labels[starts[:n] + t] = at[:n]
        if t:
            at[:n] = np.where(stays[t - 1][rows[:n], at[:n]], at[:n], froms[t - 1])
    return labels


class Labeller:
    """Scores and labels texts; remembers the scores of words it has seen."""

    def __init__(self, model: WordModel):
        self.model, self.known, self.rows = model, {}, np.zeros((0, len(model.languages)), np.float32)

    def ids(self, words: list[str]) -> list[int]:
        known = self.known
        new = [w for w in dict.fromkeys(words) if w not in known]
        if len(known) + len(new) > MEMORY:
            known.clear()
            self.rows, new = self.rows[:0], list(dict.fromkeys(words))
        if new:
            known.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
            self.rows = np.concatenate([self.rows, *(self.model.scores(new[i : i + 50_000]).astype(np.float32) for i in range(0, len(new), 50_000))])
        return list(map(known.__getitem__, words))

    def labels(self, texts: list[list[str]]) -> np.ndarray:
        ids = self.ids([w for t in texts for w in t])
        return viterbi(self.rows[ids], np.array([len(t) for t in texts], np.int64))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        words = [words_of(t.lower()) for t in texts]
        if not self.model.languages:
            return [(UND, 0.0)] * len(texts)
        labels, sizes, at = self.labels(words), np.fromiter((len(w) for t in words for w in t), np.int64), 0
        out = []
        for t in words:
            if not t:
                out.append((UND, 0.0))
                continue
            share = np.bincount(labels[at : at + len(t)], sizes[at : at + len(t)], len(self.model.languages))
            at += len(t)
            best = int(share.argmax())
            out.append((self.model.languages[best], float(share[best] / share.sum())))
        return out

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, language) of maximal runs of words of one language, as character offsets."""
        found = list(pattern_of(text).finditer(text))
        if not found or not self.model.languages:
            return []
        labels, out = self.labels([[m[0].lower() for m in found]]), []
        for m, label in zip(found, labels, strict=True):
            language = self.model.languages[label]
            if out and out[-1][2] == language:
                out[-1] = (out[-1][0], m.end(), language)
            else:
                out.append((m.start(), m.end(), language))
        return out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    counts: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py().lower())
            if words:
                _, bucket, script = grams(words)
                counts[lang] = counts.get(lang, 0) + np.bincount(bucket, minlength=BUCKETS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount(script, [len(w) for w in words], len(SCRIPT_NAMES))
    for lang, values in counts.items():
        used = np.flatnonzero(values)
        chars = np.flatnonzero(scripts[lang])
        keys = np.concatenate([used, -1 - chars])
        yield pa.record_batch([pa.array([lang] * len(keys)), pa.array(keys, pa.int64()), pa.array(np.concatenate([values[used], scripts[lang][chars]]).astype(np.int64))], ["lang", "key", "n"])


def held_out(ident: str) -> F.Column:
    """Documents whose label is never learned from; a null id is not one of them."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(ident).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, ident: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCS_PER_LANGUAGE) -> WordModel:
    """Fit from about per_language labelled documents of each language, drawn by hash; held-out ones are not read.

    What reaches the driver is bounded by BUCKETS counts for each language.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.where(~held_out(ident) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(ident).alias("id"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return fit({}, {})
    rates = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))))
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("language"), "id"), 11) * F.lit(2.0**-53) < rates[F.col("lang")])
    found = drawn.select("lang", "text").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    counts, scripts = {}, {}
    langs, keys, values = np.array(found["lang"].to_pylist(), object), found["key"].to_numpy(), found["n"].to_numpy()
    for lang_ in sorted(set(langs)):
        own = langs == lang_
        grams_, chars = own & (keys >= 0), own & (keys < 0)
        counts[lang_] = np.bincount(keys[grams_], values[grams_], BUCKETS)
        scripts[lang_] = np.bincount(-1 - keys[chars], values[chars], len(SCRIPT_NAMES))
    return fit(counts, scripts)


def _grouped(batches: Iterable[pa.RecordBatch], column: int = 1, most: int = CHARS) -> Iterator[pa.RecordBatch]:
    """Batches whose texts, in the numbered column, have about so many bytes, cut where a batch holds more."""
    kept: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        at, lengths = 0, np.array([len(x.as_buffer() or b"") if x.is_valid else 0 for x in batch.column(column)])
        for i, n in enumerate(lengths):
            size += n
            if size > most:
                kept.append(batch.slice(at, i + 1 - at))
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size, at = [], 0, i + 1
        if at < batch.num_rows:
            kept.append(batch.slice(at))
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def _predict(model: WordModel) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        labeller = Labeller(model)
        for batch in _grouped(batches):
            found = labeller.predict([x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch([*(c for i, c in enumerate(batch.columns) if i != 1), pa.array([x for x, _ in found]), pa.array([s for _, s in found], pa.float64())], [*(n for i, n in enumerate(batch.schema.names) if i != 1), "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: WordModel, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; only the text decides.

    score is the part of the letters in words labelled lang_pred. A null or empty text, or one without letters, is `und`
    with score 0, as is everything where no label could be learned. A very long text is labelled whole, in a batch of its
    own. Languages with equal parts: the first by name. Null ids and repeated rows keep a row each; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), held_out(ident).alias("held_out"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def _spans(model: WordModel) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        labeller = Labeller(model)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = labeller.spans(text.as_py() or "")
                if found:
                    starts, ends, languages = zip(*found, strict=True)
                    yield pa.record_batch([pa.array([doc] * len(found), pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(languages)], ["doc_id", "start", "end", "lang"])

    return run


def language_spans(docs: DataFrame, model: WordModel, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, lang of the labelled spans of every text (character offsets).

    A null or empty text, or one without letters, has no span; a very long one is labelled whole. Null ids and repeated
    rows give spans each; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_spans(model), "doc_id long, start long, end long, lang string")


def keep_identified(docs: DataFrame, model: WordModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose text has a language that covers at least this part of its letters; columns as in docs, whatever
    their names.

    A null or empty text, or one without letters, goes; a very long one is labelled whole. Null ids and repeated rows are
    judged by their text alone. Where no label could be learned nothing can be told, and every row stays. An empty table
    gives no rows.
    """
    if not model.languages:
        return docs
    bounded_arrow(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    column = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        labeller = Labeller(model)
        for part in _grouped(batches, column, CHARS // 3):
            found = labeller.predict([x or "" for x in part.column(column).to_pylist()])
            yield part.filter(pa.array([x != UND and s >= least for x, s in found]))

    return docs.mapInArrow(run, kinds)
