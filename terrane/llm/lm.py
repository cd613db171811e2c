"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the tokens on both sides of it. A network trained in numpy gives the distribution over
leaves: the frequent words, and one leaf for the rarer words of each group of last characters. A rarer word is then
told apart by how often the other documents use it, mixed with a spelling model, so the whole is a distribution over
words of any kind. The sum of the conditional log-probabilities scores a document; its own uses of rarer words never
speak for it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import bounded_arrow, saved, scratch

#: Words with a leaf of their own, groups of the others by last character, and leaves in a class.
FREQUENT, GROUPS, PER = 4096, 64, 64
LEAVES = FREQUENT + GROUPS
CLASSES = LEAVES // PER
EDGE = LEAVES  # the context beyond the text's ends
#: Words whose counts every worker holds; the counts of all others are joined as a table.
KNOWN = 1 << 17
#: Context words on each side; hidden units.
SIDE, HIDDEN = 2, 24
OFFSETS = (*range(-SIDE, 0), *range(1, SIDE + 1))
INPUTS = len(OFFSETS) * (LEAVES + 1)
#: Rows of parameters: context words, the hidden bias, classes, leaves. The last column is the bias of a class or leaf.
ROWS = INPUTS + 1 + CLASSES + LEAVES
#: Every token of every document is masked once and predicted. Tokens of one task; tasks of the first round.
TASK_TOKENS, FIRST_TASKS = 2_000_000, 4
#: Tokens of one step, its length, and the parts that a task's changes are sent in.
STEP, RATE, BLOCKS = 16_384, 0.2, 32
#: Tokens encoded or scored at a time, and distinct words counted before a task passes them on.
TOKENS, CHUNK, PENDING = 200_000, 16_384, 400_000
#: Symbols of the spelling model: code points below 256, one for all others (each of 2 ** 20), the word's start.
OTHER, START = 256, 257
SYMBOLS, OTHERS = 258, 20 * np.log(2)
SEED = 42  # of the hash that Spark's xxhash64 computes

ENCODED = "doc_id long, rid long, round int, tokens long, ids binary, within double, unseen long, keys array<long>, own array<int>, base array<double>, rest array<double>"


def words_of(text: str) -> list[str]:
    return text.lower().split()


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of the words, a START before and after each, and the places of the STARTs."""
    points = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    gaps = points == 32
    return np.where(gaps, START, np.minimum(points, OTHER)).astype(np.int64), np.flatnonzero(gaps)


def groups_of(words: list[str]) -> np.ndarray:
    """Group of each word: its last symbol modulo GROUPS."""
    if not words:
        return np.zeros(0, np.int64)
    codes, gaps = symbols(words)
    return codes[gaps[1:] - 1] % GROUPS


def spelling(counts: np.ndarray) -> np.ndarray:
    """SYMBOLS x SYMBOLS log-probabilities from pair counts, read from a word's end.

    Row START: of the last symbol within its group. Other rows: of the symbol before (START where there is none).
    """
    out = np.full((SYMBOLS, SYMBOLS), -np.inf)
    soft = counts + 0.5
    out[:START] = np.log(soft[:START] / soft[:START].sum(1, keepdims=True))
    last = soft[START, :START]
    out[START, :START] = np.log(last / np.bincount(np.arange(START) % GROUPS, last)[np.arange(START) % GROUPS])
    return out


def spelled(table: np.ndarray, words: list[str]) -> np.ndarray:
    """Log-probability of each word's spelling, given its group."""
    if not words:
        return np.zeros(0)
    codes, gaps = symbols(words)
    cost = np.concatenate([[0.0], table[codes[1:], codes[:-1]] - OTHERS * (codes[:-1] == OTHER)])
    return np.add.reduceat(cost, gaps[:-1] + 1) if len(gaps) > 1 else np.zeros(0)


@dataclass
class Vocabulary:
    words: list[str]  # the known ones by falling count; the first FREQUENT have a leaf of their own
    counts: np.ndarray
    used: np.ndarray  # tokens of the rarer words, by group
    types: np.ndarray  # distinct rarer words, by group
    spell: np.ndarray

    def leaf_counts(self) -> np.ndarray:
        out = np.zeros(LEAVES)
        out[: min(FREQUENT, len(self.words))] = self.counts[:FREQUENT]
        out[FREQUENT:] = self.used
        return out


def window(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """tokens x offsets: leaves around every token, EDGE beyond the text's ends."""
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(ids)) - np.repeat(first, lengths)
    size = np.repeat(lengths, lengths)
    out = np.full((len(ids), len(OFFSETS)), EDGE, np.int32)
    for k, o in enumerate(OFFSETS):
        fine = np.flatnonzero((place + o >= 0) & (place + o < size))
        out[fine, k] = ids[fine + o]
    return out


class Network:
    """Parameters as one matrix; a distribution over leaves is that over classes times that within the class."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        at = INPUTS + 1
        self.inputs = np.ascontiguousarray(rows[:INPUTS, :HIDDEN]).reshape(len(OFFSETS), LEAVES + 1, HIDDEN)
        self.hidden_bias = rows[INPUTS, :HIDDEN].copy()
        self.classes, self.class_bias = np.ascontiguousarray(rows[at : at + CLASSES, :HIDDEN].T), rows[at : at + CLASSES, HIDDEN].copy()
        leaves = rows[at + CLASSES :].reshape(CLASSES, PER, HIDDEN + 1)
        self.leaves, self.leaf_bias = np.ascontiguousarray(leaves[:, :, :HIDDEN].transpose(0, 2, 1)), leaves[:, :, HIDDEN].copy()
        self.steep = max(np.abs(w).sum(-2).max() + np.abs(b).max() for w, b in ((self.classes, self.class_bias), (self.leaves, self.leaf_bias))) > 80

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 7) -> Network:
        """Random small weights, and biases that give every leaf its share of the corpus; leaves never used get next to none."""
        rng = np.random.default_rng(seed)
        rows = np.zeros((ROWS, HIDDEN + 1), np.float32)
        rows[:, :HIDDEN] = rng.normal(0, 0.1, (ROWS, HIDDEN))
        soft = np.where(counts > 0, counts, 1e-6)
        by_class = soft.reshape(CLASSES, PER).sum(1)
        rows[INPUTS + 1 : INPUTS + 1 + CLASSES, HIDDEN] = np.log(by_class / by_class.sum())
        rows[INPUTS + 1 + CLASSES :, HIDDEN] = np.log(soft / np.repeat(by_class, PER))
        return cls(rows)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        total = self.inputs[0].take(context[:, 0], 0)
        for k in range(1, len(OFFSETS)):
            total += self.inputs[k].take(context[:, k], 0)
        total += self.hidden_bias
        return np.tanh(total, out=total)

    @staticmethod
    def _log_softmax(logits: np.ndarray) -> np.ndarray:
        """Logits with the logarithm of their sum of exponentials taken off, in place."""
        logits -= logits.max(1, keepdims=True)
        logits -= np.log(np.exp(logits).sum(1, keepdims=True))
        return logits

    def distribution(self, hidden: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, log-probabilities of its leaves) for all tokens, class by class: for tests and small inputs."""
        of = self._log_softmax(hidden @ self.classes + self.class_bias)
        for c in range(CLASSES):
            yield c, of[:, c : c + 1] + self._log_softmax(hidden @ self.leaves[c] + self.leaf_bias[c])

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target leaf."""
        out = np.empty(len(target))
        for i in range(0, len(target), CHUNK):
            out[i : i + CHUNK] = self._parts(self.hidden(context[i : i + CHUNK]), target[i : i + CHUNK])
        return out

    def _parts(self, hidden: np.ndarray, target: np.ndarray) -> np.ndarray:
        own = (target // PER).astype(np.uint16)
        logits = hidden @ self.classes
        logits += self.class_bias
        out = self._picked(logits, own)
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(CLASSES + 1))
        dealt, at, more = hidden[order], target[order] % PER, np.empty(len(target))
        for c in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[c], cuts[c + 1])
            within = dealt[part] @ self.leaves[c]
            within += self.leaf_bias[c]
            more[part] = self._picked(within, at[part])
        out[order] += more
        return out

    def _picked(self, logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-probability of one column of each row of logits, which are used up."""
        if self.steep:  # otherwise no exponential can overflow
            logits -= logits.max(1, keepdims=True)
        found = logits[np.arange(len(at)), at]
        return found - np.log(np.exp(logits, out=logits).sum(1))

    def _misses(self, logits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One column of each row is the target: 1 there and 0 elsewhere, less the probabilities of logits, in their place."""
        if self.steep:
            logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= -logits.sum(1, keepdims=True)
        logits[np.arange(len(at)), at] += 1
        return logits

    def gradient(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows that the tokens touch, ascending, and the gradient of their summed log-probability there."""
        hidden = self.hidden(context)
        own = (target // PER).astype(np.uint16)
        missed = hidden @ self.classes
        missed += self.class_bias
        missed = self._misses(missed, own)
        back = missed @ self.classes.T
        class_rows = np.concatenate([missed.T @ hidden, missed.sum(0)[:, None]], 1)
        order = np.argsort(own, kind="stable")  # by class, so that each takes a slice
        cuts = np.searchsorted(own[order], np.arange(CLASSES + 1))
        dealt, at, moved = hidden[order], target[order] % PER, np.empty_like(hidden)
        touched = np.flatnonzero(np.diff(cuts))
        leaf_rows = np.empty((len(touched), PER, HIDDEN + 1), hidden.dtype)
        for rows, c in zip(leaf_rows, touched, strict=True):
            part = slice(cuts[c], cuts[c + 1])
            missed = dealt[part] @ self.leaves[c]
            missed += self.leaf_bias[c]
            missed = self._misses(missed, at[part])
            np.matmul(missed, self.leaves[c].T, out=moved[part])
            np.matmul(missed.T, dealt[part], out=rows[:, :HIDDEN])
            missed.sum(0, out=rows[:, HIDDEN])
        back[order] += moved
        back *= 1 - hidden**2
        names, sums = [], []
        for k, column in enumerate(context.astype(np.uint16).T):
            order = np.argsort(column, kind="stable")
            seen = column[order].astype(np.int64)
            first = np.flatnonzero(np.diff(seen, prepend=-1))
            names.append(k * (LEAVES + 1) + seen[first])
            sums.append(np.add.reduceat(back[order], first, 0))
        names += [[INPUTS], INPUTS + 1 + np.arange(CLASSES), (INPUTS + 1 + CLASSES + touched[:, None] * PER + np.arange(PER)).ravel()]
        inputs = np.concatenate([*sums, back.sum(0, keepdims=True)])
        return np.concatenate(names), np.concatenate([np.pad(inputs, ((0, 0), (0, 1))), class_rows, leaf_rows.reshape(-1, HIDDEN + 1)])


def ascend(network: Network, context: np.ndarray, target: np.ndarray, squares: np.ndarray, rate: float = RATE) -> Network:
    """Steps of Adagrad by rows over the tokens in order; squares holds the rows' summed squares and is changed."""
    for i in range(0, len(target), STEP):
        rows, grad = network.gradient(context[i : i + STEP], target[i : i + STEP])
        squares[rows] += (grad**2).mean(1)
        network.rows[rows] += rate * grad / np.sqrt(squares[rows] + 1e-6)[:, None]
        network = Network(network.rows)
    return network


class Encoder:
    """Leaves of texts, and what their rarer words cost as far as it can be told without the other words' counts."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.at = {w: i for i, w in enumerate(vocab.words)}
        rare = vocab.words[FREQUENT:]
        self.leaf = np.concatenate([np.arange(min(FREQUENT, len(vocab.words))), FREQUENT + groups_of(rare)]).astype(np.int64)
        self.base = np.concatenate([np.zeros(min(FREQUENT, len(vocab.words))), np.exp(spelled(vocab.spell, rare))])

    def __call__(self, texts: list[list[str]]) -> Iterator[tuple]:
        """Per text: leaves, summed log-probability of its known rarer words, how many of those no other text has, and
        of the other words: key, uses here, smoothing mass, logarithm of the denominator."""
        at, vocab = self.at, self.vocab
        words = list(chain.from_iterable(texts))
        ids = np.array([at.get(w, -1) for w in words], np.int64)
        lengths = np.array([len(t) for t in texts], np.int64)
        text = np.repeat(np.arange(len(texts)), lengths)
        places = np.flatnonzero(ids < 0)
        number: dict[str, int] = {}
        others = np.array([number.setdefault(words[i], len(number)) for i in places.tolist()], np.int64)
        names = list(number)
        group, mass = groups_of(names), np.exp(spelled(vocab.spell, names))
        keys = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), SEED) for w in names], np.uint64).astype(np.int64)
        leaves = self.leaf[np.maximum(ids, 0)] if len(self.leaf) else np.zeros(len(ids), np.int64)
        leaves[places] = FREQUENT + group[others]
        grouped = np.flatnonzero(leaves >= FREQUENT)
        within = np.bincount(text[grouped] * GROUPS + leaves[grouped] - FREQUENT, minlength=len(texts) * GROUPS).reshape(-1, GROUPS)
        rest = np.log(np.maximum(np.maximum(vocab.used - within, 0) + vocab.types, 1))  # of each group's denominator

        rare = np.flatnonzero(ids >= FREQUENT)
        pair, uses = np.unique(text[rare] * (len(at) + 1) + ids[rare], return_counts=True)
        doc, word = np.divmod(pair, len(at) + 1)
        left, own = vocab.counts[word] - uses, self.leaf[word] - FREQUENT
        known = np.bincount(doc, uses * (np.log(left + vocab.types[own] * self.base[word]) - rest[doc, own]), len(texts))
        alone = np.bincount(doc, uses * (left <= 0), len(texts)).astype(np.int64)

        pair, uses = np.unique(text[places] * (len(names) + 1) + others, return_counts=True)
        doc, word = np.divmod(pair, len(names) + 1)
        columns = [keys[word], uses, vocab.types[group[word]] * mass[word], rest[doc, group[word]]]
        cuts, ends = np.searchsorted(doc, np.arange(len(texts) + 1)), np.concatenate([[0], np.cumsum(lengths)])
        for i in range(len(texts)):
            yield leaves[ends[i] : ends[i + 1]], known[i], alone[i], *(c[cuts[i] : cuts[i + 1]] for c in columns)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            seen.update(words_of(text.as_py() or ""))
            if len(seen) > PENDING:
                yield out()
                seen = Counter()
    if seen:
        yield out()


def _spell_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    for batch in batches:
        codes, _ = symbols(batch.column(0).to_pylist())
        total += np.bincount(codes[1:] * SYMBOLS + codes[:-1], minlength=len(total))
    used = np.flatnonzero(total)
    yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["pair", "n"])


def _group(word: Column) -> Column:
    last = F.ascii(F.substring(word, -1, 1))  # its code point
    return F.pmod(F.least(last, F.lit(OTHER)), F.lit(GROUPS))


def gather(docs: DataFrame, text: str = "text", known: int = KNOWN) -> tuple[Vocabulary, DataFrame]:
    """Count every word of every document: the vocabulary, and (key, n) of all words that it does not hold.

    The driver gets at most `known` words, those from the least count up with which so few remain, and tables of fixed
    size; the counts of all other words stay a table, which grows with the corpus.
    """
    bounded_arrow(docs.sparkSession)
    words = docs.select(F.col(text).alias("text")).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = saved(words, "words")
    level = F.least("n", F.lit(1 << 14))
    sizes = sorted(((r["level"], r["k"]) for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)  # at most 2 ** 14 rows
    least, held = 1 << 14, 0
    for value, k in sizes:
        if held + k > known:
            break
        least, held = value, held + k
    if not held and sizes:  # more words than that are used 2 ** 14 times: the largest powers of two that fit
        least = 1 << 15
        while words.where(F.col("n") >= least).count() > known:
            least <<= 1
    top = words.where(F.col("n") >= least).toArrow().to_pydict()
    order = sorted(range(len(top["word"])), key=lambda i: (-top["n"][i], top["word"][i].encode("utf-8", "surrogatepass")))
    names, counts = [top["word"][i] for i in order], np.array([top["n"][i] for i in order], np.int64)
    tail = words.where(F.col("n") < least)
    by_group = tail.groupBy(_group(F.col("word")).alias("g")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect()  # GROUPS rows
    rare = groups_of(names[FREQUENT:])
    used, types = (np.bincount(rare, w, GROUPS) for w in (counts[FREQUENT:], None))
    for r in by_group:
        used[r["g"]] += r["n"]
        types[r["g"]] += r["k"]
    pairs = words.select("word").mapInArrow(_spell_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most SYMBOLS ** 2 rows
    spell = np.bincount(pairs["pair"].to_numpy(), pairs["n"].to_numpy(), SYMBOLS * SYMBOLS).reshape(SYMBOLS, SYMBOLS)
    return Vocabulary(names, counts, used, types.astype(float), spelling(spell)), tail.select(F.xxhash64("word").alias("key"), "n")


def _encode(vocab: Vocabulary, rounds: int, first: int) -> Callable:
    ends = np.cumsum(first * 2.0 ** np.arange(rounds))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, rid = Encoder(vocab), TaskContext.get().partitionId() << 33
        docs: list = []
        texts: list = []

        def out() -> pa.RecordBatch:
            nonlocal rid
            rows = list(encoder(texts))
            raw = [r[0].astype("<u2").tobytes() for r in rows]
            draw = np.array([xxhash.xxh64_intdigest(b, rid + i) for i, b in enumerate(raw)], np.uint64) / 2.0**64 * ends[-1]
            columns = [docs, range(rid, rid + len(rows)), np.searchsorted(ends, draw, "right").tolist(), [len(r[0]) for r in rows], raw, *([r[k] for r in rows] for k in (1, 2)), *([r[k].tolist() for r in rows] for k in (3, 4, 5, 6))]
            rid += len(rows)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in ENCODED.split(", ")])

        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append(doc)
                texts.append(words_of(text.as_py() or ""))
                size += len(texts[-1])
                if size > TOKENS:
                    yield out()
                    docs, texts, size = [], [], 0
        if docs:
            yield out()

    return run


def schedule(tokens: int) -> int:
    """Rounds of training: each has twice the tasks of the one before, so the tasks of all rounds take all tokens."""
    rounds = 1
    while FIRST_TASKS * (2**rounds - 1) * TASK_TOKENS < tokens:
        rounds += 1
    return rounds


def encode_documents(docs: DataFrame, vocab: Vocabulary, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document, written by training round: its leaves and what its rarer words cost."""
    bounded_arrow(docs.sparkSession)
    rounds = schedule(int(vocab.leaf_counts().sum()))
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    encoded = rows.mapInArrow(_encode(vocab, rounds, FIRST_TASKS), ENCODED)
    path = scratch(docs.sparkSession, "encoded")
    encoded.write.partitionBy("round").parquet(path)
    return docs.sparkSession.read.schema(encoded.schema).parquet(path)


def _leaves(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = [x.as_buffer() for x in column]
    lengths = np.array([x.size // 2 for x in raw], np.int64)
    return np.frombuffer(b"".join(raw), "<u2").astype(np.int32), lengths


def _train(rows: np.ndarray, rate: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, squares = Network(rows.copy()), np.zeros(ROWS)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, lengths = _leaves(part.column(0))
                network = ascend(network, window(ids, lengths), ids, squares, rate)
        touched = np.flatnonzero(squares)
        for block in np.array_split(touched, BLOCKS):
            if len(block):
                delta = (network.rows[block] - rows[block]).astype("<f4")
                yield pa.record_batch([pa.array([int(block[0] * BLOCKS // ROWS)], pa.int32()), pa.array([block.astype("<i4").tobytes()], pa.binary()), pa.array([delta.tobytes()], pa.binary())], ["block", "rows", "delta"])

    return run


def _mean(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean change of every row over the tasks that touched it."""
    total, tasks = np.zeros((ROWS, HIDDEN + 1)), np.zeros(ROWS)
    for batch in group:
        for names, delta in zip(batch.column(1), batch.column(2), strict=True):
            at = np.frombuffer(names.as_py(), "<i4")
            total[at] += np.frombuffer(delta.as_py(), "<f4").reshape(len(at), -1)
            tasks[at] += 1
    at = np.flatnonzero(tasks)
    yield pa.record_batch([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([(total[at] / tasks[at, None]).astype("<f4").tobytes()], pa.binary())], ["rows", "delta"])


def train(encoded: DataFrame, vocab: Vocabulary, rate: float = RATE) -> Network:
    """Train on every token of all documents, each document in one round. Tasks start from the same parameters; what a row of parameters
    gains is averaged over the tasks that touched it. Rounds grow in number with the corpus, and each doubles the tasks,
    so the parameters move further on a larger corpus and rare words learn from wherever they occur.
    """
    bounded_arrow(encoded.sparkSession)
    network = Network.start(vocab.leaf_counts())
    for r in range(schedule(int(vocab.leaf_counts().sum()))):
        docs = encoded.where((F.col("round") == r) & (F.col("tokens") > 0)).select("ids").coalesce(FIRST_TASKS << r)
        deltas = docs.mapInArrow(_train(network.rows, rate / (1 + r / 4)), "block int, rows binary, delta binary")
        found = deltas.groupBy("block").applyInArrow(_mean, "rows binary, delta binary").toArrow()
        rows = network.rows.copy()
        for names, delta in zip(found["rows"].to_pylist(), found["delta"].to_pylist(), strict=True):
            at = np.frombuffer(names, "<i4")
            rows[at] += np.frombuffer(delta, "<f4").reshape(len(at), -1)
        network = Network(rows)
    return network


def _score(rows: np.ndarray) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids, lengths = _leaves(part.column(4))
                found = np.bincount(np.repeat(np.arange(len(lengths)), lengths), network.log_probability(window(ids, lengths), ids), len(lengths))
                yield pa.record_batch([*part.columns[:4], pa.array(found + part.column(2).to_numpy()), part.column(5)], ["doc_id", "rid", "within", "tokens", "log", "unseen"])

    return run


def score_encoded(encoded: DataFrame, tail: DataFrame, network: Network) -> DataFrame:
    """doc_id, tokens, log_likelihood, mean_log_likelihood, unseen of every encoded document."""
    bounded_arrow(encoded.sparkSession)
    leaves = encoded.select("doc_id", "rid", "within", "tokens", "ids", "unseen").mapInArrow(_score(network.rows), "doc_id long, rid long, within double, tokens long, log double, unseen long")
    rare = encoded.where(F.size("keys") > 0).select("rid", F.inline(F.arrays_zip("keys", "own", "base", "rest")))
    left = F.greatest(F.col("n") - F.col("own"), F.lit(0))
    cost = F.col("own") * (F.log(left + F.col("base")) - F.col("rest"))
    joined = rare.join(tail.withColumnRenamed("key", "keys"), "keys")
    sums = joined.groupBy("rid").agg(F.sum(cost).alias("more"), F.sum(F.when(left == 0, F.col("own")).otherwise(0)).alias("alone"))
    total = F.col("log") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("tokens") > 0, total / F.col("tokens")).otherwise(0.0)
    return leaves.join(sums, "rid", "left").select("doc_id", "tokens", total.alias("log_likelihood"), mean.alias("mean_log_likelihood"), (F.col("unseen") + F.coalesce("alone", F.lit(0))).alias("unseen"))


def score_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the documents and score them: doc_id, tokens, log_likelihood (sum over the tokens), its mean per token,
    and unseen (tokens whose word no other document has), for every row.

    A null or empty text has 0 tokens and scores 0. A very long text is one row like any other. Equal texts train once
    for each row. Null ids and repeated rows keep a row each; other columns are ignored, whatever their names; no
    documents, no rows.
    """
    vocab, tail = gather(docs, text)
    encoded = encode_documents(docs, vocab, ident, text)
    return score_encoded(encoded, tail, train(encoded, vocab))
