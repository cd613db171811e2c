"""Ordinal cumulative-link regression of graded ratings on hashed text.

One weight vector over hashed words and word beginnings serves all grades; ordered thresholds cut the score into
grades. The expected grade ranks documents and the tail probability of the best grade selects them. Every bucket keeps a
weight of either sign; how far it may move shrinks with the weakness of its evidence.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_arrow, release

#: About so many labelled documents of each grade are used to fit the model.
LABELLED = (1500, 1500, 5000)
BUCKETS = 1 << 22
#: Strength of association (mean square contingency with the grade) at which a bucket's evidence counts for a half: weaker
#: buckets are shrunk, none is left out. A text's buckets weigh UNIT times its number of them to the power of minus LENGTH.
HALF, UNIT, LENGTH = 0.06, 5.0, 1 / 3
RIDGE, STEPS, RATE = 3e-3, 120, 0.1
#: Selection starts at the tail probability where, of the rated documents fitted on, the part of the sound ones lost (so
#: many times) and the part of the others let through are least together.
LOST = 5.0
GRADES = 3
TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]{1,3}")
#: A beginning that so many different tokens of a text share, as inflected and compound forms of one word do, is a mark of its own.
SHARED = (2, 3)
#: Entries of documents that one block of the fit takes.
ENTRIES = 250_000
#: Tokens and marks whose weights one worker remembers before it starts anew.
MEMORY = 200_000


def bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def marks_of(text: str) -> tuple[set[str], set[str]]:
    """Distinct tokens, and their distinct first four characters behind a ^, again with each number of SHARED that is
    reached by the different tokens that begin so; where a tenth of the tokens or more repeat the two before,
    that and the share in tenths are marks too."""
    found = TOKEN.findall(text.lower())
    tokens = set(found)
    begun = Counter("^" + t[:4] for t in tokens)
    marks = set(begun)
    for least in SHARED:
        marks |= {f"{b} {least}" for b, n in begun.items() if n >= least}
    share = sum(a == b == c for a, b, c in zip(found, found[1:], found[2:])) * 10 // max(len(found), 1)
    if share:
        marks |= {"repeated", f"repeated {share}"}
    return tokens, marks


def features(text: str) -> np.ndarray:
    """The hash buckets of the tokens and marks, ascending."""
    tokens, marks = marks_of(text)
    return np.sort(np.array([*map(bucket, tokens), *map(bucket, marks)], np.int32))


@dataclass
class OrdinalModel:
    buckets: np.ndarray  # all that the labelled documents show
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; P(grade <= j) = sigmoid(thresholds[j] - score)
    bar: float = 0.5  # least tail probability of the selected

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """rows x (grades - 1): P(grade > j)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - np.asarray(scores)[:, None], -60, 60)))


def evidence(shown: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far each bucket's weight may move: its largest log-ratio between a lower grade and the best one, shrunk where
    the association with the grade is weak. shown: grades x buckets, documents with the bucket; sizes: documents."""
    rate = (shown + 1) / (sizes[:, None] + 2)
    ratio = np.abs(np.log(rate[:-1] / rate[-1])).max(0)
    expected = sizes[:, None] / max(sizes.sum(), 1) * shown.sum(0)
    strength = ((shown - expected) ** 2 / (expected + 0.5)).sum(0) / max(sizes.sum(), 1)
    return ratio * strength / (strength + HALF)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def thresholds_of(free: np.ndarray) -> np.ndarray:
    """Ordered thresholds of free parameters: the first, and the logarithms of the gaps."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def loss(scores: np.ndarray, free: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood, and its gradient by score and by free parameters."""
    cuts = np.concatenate([[-np.inf], thresholds_of(free), [np.inf]])
    upper = np.where(grades == GRADES - 1, 1.0, sigmoid(cuts[grades + 1] - scores))
    lower = np.where(grades == 0, 0.0, sigmoid(cuts[grades] - scores))
    weight = 1.0 / len(grades)
    prob = np.maximum(upper - lower, 1e-12)
    at_upper, at_lower = upper * (1 - upper) / prob * weight, lower * (1 - lower) / prob * weight
    cut = np.array([at_lower[grades == j + 1].sum() - at_upper[grades == j].sum() for j in range(GRADES - 1)])
    by_free = np.cumsum(cut[::-1])[::-1].copy()
    by_free[1:] *= np.exp(free[1:])
    return float(-weight * np.log(prob).sum()), at_upper - at_lower, by_free


def fit(rows: list[np.ndarray], grades: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> OrdinalModel:
    """Full-batch Adam on the loss and a ridge on how far each bucket uses its evidence; documents of equal content count each.

    The entries lie in two narrow arrays and are gone through in blocks, so that the driver holds little more than the rows."""
    if not rows:
        return OrdinalModel(np.zeros(0, np.int32), np.zeros(0), np.arange(GRADES - 1.0))
    lengths = np.array([len(r) for r in rows])
    ends = np.cumsum(lengths)
    used, n = np.unique(np.concatenate(rows)), len(rows)
    k = len(used)
    column, value = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    cuts = [*np.unique([0, *np.searchsorted(ends, np.arange(0, ends[-1], ENTRIES))]).tolist(), n]
    blocks = [(slice(a, b), slice(int(ends[a] - lengths[a]), int(ends[b - 1]))) for a, b in zip(cuts, cuts[1:]) if a < b]
    sizes = np.bincount(grades, minlength=GRADES).astype(float)
    shown = np.zeros((GRADES, k), np.int64)
    for docs, entries in blocks:
        column[entries] = np.searchsorted(used, np.concatenate(rows[docs]))
        np.add.at(shown, (np.repeat(grades[docs], lengths[docs]), column[entries]), 1)
    reach = evidence(shown, sizes)
    for docs, entries in blocks:
        value[entries] = reach[column[entries]] * np.repeat(scale_of(lengths[docs]), lengths[docs])

    def scores_of(weights: np.ndarray) -> np.ndarray:
        parts = (np.bincount(np.repeat(np.arange(d.stop - d.start), lengths[d]), weights[column[e]] * value[e], d.stop - d.start) for d, e in blocks)
        return np.concatenate([*parts])

    at = np.concatenate([np.zeros(k), [-1.0], np.zeros(GRADES - 2)])
    first, second = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        _, by_score, by_free = loss(scores_of(at[:k]), at[k:], grades)
        pulled = np.zeros(k)
        for docs, entries in blocks:
            np.add.at(pulled, column[entries], np.repeat(by_score[docs], lengths[docs]) * value[entries])
        grad = np.concatenate([pulled + ridge * at[:k], by_free])
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        at -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model = OrdinalModel(used, at[:k] * reach, thresholds_of(at[k:]))
    model.bar = least_cost(model.tails(scores_of(at[:k]))[:, -1], grades == GRADES - 1)
    return model


def least_cost(tails: np.ndarray, sound: np.ndarray) -> float:
    """The bar of least cost, halfway to the next lower probability; one half unless both kinds are there."""
    if not sound.any() or sound.all():
        return 0.5
    bars = np.unique(tails)
    good, bad = np.sort(tails[sound]), np.sort(tails[~sound])
    cost = LOST * np.searchsorted(good, bars) / len(good) + 1 - np.searchsorted(bad, bars) / len(bad)
    best = int(cost.argmin())
    return float((bars[best] + bars[max(best - 1, 0)]) / 2)


def scale_of(lengths):
    return UNIT * np.maximum(lengths, 1) ** -LENGTH


class Scorer:
    def __init__(self, model: OrdinalModel):
        self.model = model
        self.known: dict[str, float] = {}

    def weights_of(self, words: list[str]) -> np.ndarray:
        """The weights of the words' buckets; 0 where the labelled documents do not show the bucket."""
        buckets, weights = self.model.buckets, self.model.weights
        if not len(buckets):
            return np.zeros(len(words))
        wanted = np.array([bucket(w) for w in words], buckets.dtype)
        at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
        return np.where(buckets[at] == wanted, weights[at], 0.0)

    def score(self, text: str) -> float | None:
        """Summed weight of the buckets, scaled by their number; None without any token."""
        tokens, marks = marks_of(text)
        if not tokens:
            return None
        words = [*tokens, *marks]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            self.known.update(zip(new, self.weights_of(new).tolist(), strict=True))
        return math.fsum(map(self.known.__getitem__, words)) * float(scale_of(len(words)))

    def grade(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the best grade; 0 and 0 without any token."""
        scores = [self.score(t or "") for t in texts]
        tails = self.model.tails(np.array([s or 0.0 for s in scores]))
        tails[[s is None for s in scores]] = 0.0
        return tails.sum(1), tails[:, -1]


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 poor, 1 sound but toxic, 2 sound; the lowest where a document has several labels."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade).alias("grade")).where("grade is not null")


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([features(x.as_py() or "").tobytes() for x in batch.column(1)], pa.binary())], ["grade", "buckets"])


def learn(docs: DataFrame, labels: DataFrame, labelled: tuple[int, ...] = LABELLED, ident: str = "doc_id", text: str = "text") -> OrdinalModel:
    """Fit on about so many rated documents of each grade, drawn by hash of their id; that also bounds what is broadcast.

    Documents without a label, labels without a document and null ids are left out; a document that occurs several
    times counts as often; without labels the model rates every text alike. Other columns are ignored.
    """
    bounded_arrow(docs.sparkSession)
    grades = graded(labels)
    sizes = {r["grade"]: r["n"] for r in grades.groupBy("grade").agg(F.count("*").alias("n")).collect()}  # at most GRADES rows
    rates = F.element_at(F.array(*(F.lit(min(1.0, labelled[g] / sizes.get(g, 1))) for g in range(GRADES))), F.col("grade") + 1)
    drawn = grades.where(F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "doc_id"), 11) * F.lit(2.0**-53) < rates)
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(drawn), "doc_id")
    found = rows.select(F.col("grade").cast("int").alias("grade"), "text").mapInArrow(_features, "grade int, buckets binary").toArrow()
    grades_, rows_ = found["grade"].to_numpy().astype(np.int64), [np.frombuffer(b, np.int32) for b in found["buckets"].to_pylist()]
    del found
    order = sorted(range(len(rows_)), key=lambda i: (grades_[i], rows_[i].tobytes()))  # rows come in any order
    rows_, grades_ = [rows_[i] for i in order], grades_[order]
    model = fit(rows_, grades_)
    del rows_
    release()  # the driver, too
    return model


def _grade(model: OrdinalModel) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(model)
        for batch in batches:
            expected, tail = scorer.grade(x.as_py() for x in batch.column(1))
            yield pa.record_batch([batch.column(0), pa.array(expected), pa.array(tail), pa.array(tail >= model.bar)], ["doc_id", "expected_grade", "tail_probability", "selected"])

    return run


def grade_documents(docs: DataFrame, model: OrdinalModel, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, expected_grade (0 to 2), tail_probability (of grade 2), selected, for every row.

    A null text, or one without words and punctuation, has grade 0 and is not selected. A very long text is read whole.
    Equal texts score alike. Null ids and repeated rows keep a row each; other columns are ignored, whatever their
    names; no documents, no rows; without labels every score is 0.
    """
    bounded_arrow(docs.sparkSession)
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_grade(model), "doc_id long, expected_grade double, tail_probability double, selected boolean")


def keep_selected(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """The selected rows, repeated ones and those with null ids included; columns as in docs, whatever their names. Null and
    empty texts are not selected, very long ones are read whole, and no documents give no rows."""
    bounded_arrow(docs.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array(scorer.grade(x.as_py() for x in batch.column(text))[1] >= model.bar))

    return docs.mapInArrow(run, kinds)
