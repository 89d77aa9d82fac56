"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams are scaled by the log-count ratio of the two classes and a
linear hinge-loss model is fitted to them by dual coordinate descent. The n-grams
are words and pairs of words, and single and paired word shapes (case, digits and
punctuation, runs collapsed) by the share of the text they make up, so that they
tell a text that is shouted, garbled or repeated throughout from one that merely
contains a line of it. Margins become scores by a logistic curve fitted to margins
of rows that the fold's model has not seen.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those of smallest
seeded hash, and on all their n-grams that LEAST_DOCS of them hold; every row is
scored on its whole text.

Defined results
  * null or empty text: scored by the model like a text whose one n-gram is its
    being empty; texts of any length: memory follows the longest;
  * null doc_id: never a training row, held_out false;
  * documents that repeat a doc_id: the one of smallest text hash is trained on;
  * labels that repeat a doc_id: its smallest label; null labels: not used;
  * no labels, or one class only: that class's share is every row's score;
  * repeated rows: each is scored; empty table: no rows;
  * extra columns: left out by ``scored``, passed through by ``accepted``, the
    pipeline's stage, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.session import docs_of, kept, packed, prepare, texts

TRAIN_ROWS = 6_000
THRESHOLD = 0.7
#: The pipeline rejects what scores below this.
REJECT_BELOW = 0.5
#: Documents of the sample that hold an n-gram at least: one that a single document holds says nothing of a class.
LEAST_DOCS = 2
SHARES = (0.0, 0.01, 0.03, 0.1, 0.3, 0.6, 0.9)
COST = 0.1
EPOCHS = 30
SEED = 10
#: Text whose n-grams a training task lists at once; a longer text is listed alone.
PIECE_BYTES = 256 << 10

_CLASSES = bytearray(range(256))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = ord("a") if _b >= 0x80 or _c.islower() and _b < 0x80 else ord("A") if _c.isupper() else ord("0") if _c.isdigit() else _b
_CLASSES = bytes(_CLASSES)
_RUNS = re.compile(rb"(.)\1\1+", re.S)
_shape_of: dict[bytes, bytes] = {}


def _shape(word: bytes) -> bytes:
    found = _shape_of.get(word)
    if found is None:
        found = _RUNS.sub(rb"\1\1", word)
        if len(word) <= 64:  # what is remembered stays small
            if len(_shape_of) > 100_000:
                _shape_of.clear()
            _shape_of[word] = found
    return found


EMPTY = (b"", b"")


def grams(text: bytes, vocabulary: Vocabulary | None = None) -> set | np.ndarray:
    """The n-grams that a text's indicators are about: words (bytes) and pairs of words, and (shape, level); the places of those in the vocabulary if one is given.

    A shape is a word's or a pair's; its level is how many of SHARES its share of the text's words exceeds.
    """
    if vocabulary is not None:
        return vocabulary.places(text)
    words = text.lower().split()
    n = len(words)
    if not n:
        return {EMPTY}
    found = set(words)
    found.update(zip(words, words[1:]))  # noqa: B905
    shapes = [_shape(w) for w in text.translate(_CLASSES).split()]
    for gram, c in [*Counter(shapes).items(), *Counter(zip(shapes, shapes[1:])).items()]:  # noqa: B905
        share = c / n
        for k, s in enumerate(SHARES):
            if share <= s:
                break
            found.add((gram, k))
    return found


def coded(gram: object) -> bytes:
    """An n-gram as bytes, in which no other has the same form; words and shapes hold no white space."""
    if isinstance(gram, bytes):
        return b"w " + gram
    if isinstance(gram[1], bytes):
        return b"b " + b" ".join(gram)
    shape, level = gram
    return b"s %d " % level + shape if isinstance(shape, bytes) else b"p %d " % level + b" ".join(shape)


def decoded(code: bytes) -> object:
    kind, rest = code[:1], code[2:]
    if kind == b"w":
        return rest
    if kind == b"b":
        return tuple(rest.split(b" "))
    level, shape = rest.split(b" ", 1)
    return (shape if kind == b"s" else tuple(shape.split(b" "))), int(level)


class Vocabulary:
    """The places of coded n-grams in a list of them, held in arrays: each Python worker has its own, and 380,000 n-grams as Python objects take it 140 MB.

    Words and shapes have numbers; a pair is a number too, found in a sorted array.
    """

    def __init__(self, names: list[bytes]) -> None:
        told = [(code[:1], decoded(code), at) for at, code in enumerate(names)]
        self.empty = [at for kind, gram, at in told if kind == b"b" and gram == EMPTY]
        self.words, self.word_at = self._singles([(g, 0, at) for kind, g, at in told if kind == b"w"], [g for kind, g, _ in told if kind == b"b" and g != EMPTY], 1)
        self.pairs, self.pair_at = self._pairs([(g, 0, at) for kind, g, at in told if kind == b"b" and g != EMPTY], self.words, 1)
        self.shapes, self.shape_at = self._singles([(*g, at) for kind, g, at in told if kind == b"s"], [g[0] for kind, g, _ in told if kind == b"p"], len(SHARES))
        self.shape_pairs, self.shape_pair_at = self._pairs([(*g, at) for kind, g, at in told if kind == b"p"], self.shapes, len(SHARES))

    @staticmethod
    def _singles(found: list[tuple[bytes, int, int]], pairs: list[tuple[bytes, bytes]], levels: int) -> tuple[dict[bytes, int], np.ndarray]:
        """Numbers of words, those of pairs too, and by number and level the places (-1: none)."""
        number = {g: k for k, g in enumerate(dict.fromkeys([*(g for g, _, _ in found), *(g for pair in pairs for g in pair)]))}
        at = np.full((len(number), levels), -1, np.int32)
        for g, level, place in found:
            at[number[g], level] = place
        return number, at

    @staticmethod
    def _pairs(found: list[tuple[tuple[bytes, bytes], int, int]], number: dict[bytes, int], levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of pairs, ascending, and by their rank and level the places (-1: none)."""
        keys = np.array([number[a] * len(number) + number[b] for (a, b), _, _ in found], np.int64)
        known, rank = np.unique(keys, return_inverse=True)
        at = np.full((len(known), levels), -1, np.int32)
        for r, (_, level, place) in zip(rank.tolist(), found, strict=True):
            at[r, level] = place
        return known, at

    @staticmethod
    def _met(ids: np.ndarray, width: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Single numbers of a text and their counts, then ranks of its known pairs and their counts."""
        single, n_single = np.unique(ids[ids >= 0], return_counts=True)
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        pair, n_pair = np.unique(ids[:-1][both] * width + ids[1:][both], return_counts=True)
        rank = np.searchsorted(known, pair)
        there = np.flatnonzero(rank < len(known))
        there = there[known[rank[there]] == pair[there]]
        return single, n_single, rank[there], n_pair[there]

    def places(self, text: bytes) -> np.ndarray:
        """The places of a text's n-grams, each once."""
        words = text.lower().split()
        n = len(words)
        if not n:
            return np.array(self.empty, np.int32)
        ids = np.fromiter((self.words.get(w, -1) for w in words), np.int64, n)
        single, _, pair, _ = self._met(ids, len(self.words), self.pairs)
        del words
        ids = np.fromiter((self.shapes.get(_shape(w), -1) for w in text.translate(_CLASSES).split()), np.int64, n)
        shape, n_shape, shape_pair, n_shape_pair = self._met(ids, len(self.shapes), self.shape_pairs)
        found = [self.word_at[single].ravel(), self.pair_at[pair].ravel()]
        for at, c in ((self.shape_at[shape], n_shape), (self.shape_pair_at[shape_pair], n_shape_pair)):
            # As many levels as there are SHARES below the share.
            found.append(at[np.arange(len(SHARES)) < np.searchsorted(SHARES, c / n)[:, None]])
        found = np.concatenate(found)
        return found[found >= 0]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, width: int, smooth: float = 1.0) -> np.ndarray:
    """log of (share of an indicator in class 1 / its share in class 0), smoothed."""
    p, q = (np.bincount(np.concatenate([np.zeros(0, np.int64), *[r for r, v in zip(rows, y, strict=True) if v == side]]).astype(np.int64), minlength=width) + smooth for side in (1, -1))
    return np.log((p / p.sum()) / (q / q.sum()))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Weights (the last is the bias) of min |w|^2/2 + sum cost * max(0, 1 - y w.x)."""
    w, alpha = np.zeros(width + 1), np.zeros(len(y))
    square = np.array([float(v @ v) for v in values]) + 1.0
    draw = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in draw.permutation(len(y)):
            at, v, s = rows[i], values[i], y[i]
            gradient = s * (w[at] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * s
            if step:
                w[at] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def logistic_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))), with targets drawn in as Platt's method has it."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, math.log((up + 1) / (down + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([(g * margins).sum() + 1e-6 * a, g.sum()])
        hess = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(documents: list[tuple[set, int]]) -> dict:
    """A model, as plain values, from (grams, label) rows."""
    df = Counter(g for found, _ in documents for g in map(coded, found))
    names = sorted(g for g, c in df.items() if c >= LEAST_DOCS)
    known = {decoded(g): k for k, g in enumerate(names)}
    return fitted([sorted(known[g] for g in found if g in known) for found, _ in documents], [label for _, label in documents], names)


def fitted(rows: list, labels: list[int], names: list[bytes]) -> dict:
    """A model from rows of places in ``names``, the coded n-grams."""
    y = np.array([1 if label else -1 for label in labels])
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).mean()) * len(y) + 1) / (len(y) + 2) if len(y) else 0.5
        return {"weights": np.zeros(0), "squares": np.zeros(0), "vocabulary": Vocabulary([]), "bias": 0.0, "a": 0.0, "b": math.log(share / (1 - share))}
    rows, known = [np.array(r, dtype=np.int64) for r in rows], names
    cost = np.where(y > 0, COST * len(y) / (2 * (y > 0).sum()), COST * len(y) / (2 * (y < 0).sum()))

    def trained(on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ratios = log_count_ratios([rows[i] for i in on], y[on], len(known))
        values = []
        for i in on:
            v = ratios[rows[i]]
            values.append(v / max(float(np.sqrt(v @ v)), 1e-9))
        return ratios, dual_coordinate_descent([rows[i] for i in on], values, y[on], len(known), cost[on])

    def margin(i: int, ratios: np.ndarray, w: np.ndarray) -> float:
        v = ratios[rows[i]]
        return float(w[rows[i]] @ v) / max(float(np.sqrt(v @ v)), 1e-9) + float(w[-1])

    fold = np.random.default_rng(SEED).permutation(len(y)) % 3
    margins = np.zeros(len(y))
    for k in range(3):
        on = np.flatnonzero(fold != k)
        if len(set(y[on].tolist())) < 2:
            on = np.arange(len(y))
        model = trained(on)
        for i in np.flatnonzero(fold == k):
            margins[i] = margin(i, *model)
    a, b = logistic_fit(margins, y)
    ratios, w = trained(np.arange(len(y)))
    return {"vocabulary": Vocabulary(names), "weights": w[:-1] * ratios, "squares": ratios**2, "bias": float(w[-1]), "a": a, "b": b}


def score(model: dict, found: np.ndarray) -> float:
    """The score of a text by the places of its n-grams."""
    # fsum is exact, so the sums do not hang on the order.
    m = math.fsum(model["weights"][found].tolist()) / max(math.sqrt(math.fsum(model["squares"][found].tolist())), 1e-9) + model["bias"]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, model["a"] * m + model["b"]))))


# -- Spark ------------------------------------------------------------------


def remainder(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % parts, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, rows: int) -> DataFrame:
    """text, y, _id of at most ``rows`` labelled documents that are not held out, by seeded hash."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min(label).cast("int").alias("y"))
    chosen = known.where(remainder(F.col("_id"), parts) != held).orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(rows)
    text = F.col("text").cast("string")
    # At most ``rows`` rows of two numbers, whatever the size of the tables.
    drawn = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("text"), F.xxhash64(text).alias("_hash")).join(F.broadcast(chosen), "_id")
    # One row for each id, however many share it, so that no row is left to chance.
    return drawn.groupBy("_id").agg(F.min_by("text", "_hash").alias("text"), F.first("y").alias("y")).select("text", "y", "_id")


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, size, first = [], 0, 0
        for k, t in enumerate(texts(batch), 1):
            found.append(list(map(coded, grams(t))))
            size += len(t)
            if size >= PIECE_BYTES or k == batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(2)[first:k], batch.column(1)[first:k], pa.array(found, pa.list_(pa.binary()))], ["doc_id", "y", "grams"])
                found, size, first = [], 0, k


def _numbered(column: pa.Array, names: pa.Array) -> pa.Array:
    """Lists of n-grams as ascending lists of their places in ``names``, those that are there."""
    place = pc.index_in(column.flatten(), value_set=names).fill_null(-1).to_numpy()
    row = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy())
    row, place = row[place >= 0], place[place >= 0]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(column)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[np.lexsort((place, row))], pa.int32()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, rows: int = TRAIN_ROWS) -> dict:
    """The model of the sample. The driver sees n-grams that LEAST_DOCS documents hold, and rows of their numbers."""
    spark = prepare(docs.sparkSession)
    drawn = kept(sample(docs, labels, label, parts, held, rows).mapInArrow(_gram_rows, "doc_id long, y int, grams array<binary>"), "grams")
    shared = drawn.select(F.explode("grams").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    names = pa.array(sorted(shared.select("g").toArrow().column("g").to_pylist()), pa.binary())
    # Bounded by the sample: what TRAIN_ROWS documents share.
    sent = spark.sparkContext.broadcast(names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _numbered(batch.column(2), sent.value)], ["doc_id", "y", "at"])

    got = drawn.mapInArrow(numbered, "doc_id long, y int, at array<int>").toArrow().combine_chunks().sort_by("doc_id")
    column = got.column("at").combine_chunks()
    at, ends = (column.values.to_numpy(), column.offsets.to_numpy()) if got.num_rows else ([], [0])
    model = fitted([at[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], got.column("y").to_pylist(), names.to_pylist())
    sent.unpersist()
    return model


def scored(docs: DataFrame, model: dict, parts: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [score(sent.value, grams(t, sent.value["vocabulary"])) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, columns as before."""
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = batch.filter(pa.array([score(sent.value, grams(t, sent.value["vocabulary"])) >= reject_below for t in texts(batch)], pa.bool_()))
            row = stay.column(1)
            yield pa.RecordBatch.from_arrays(row.flatten(), schema=pa.schema(list(row.type)))

    return packed(docs).select("text", "row").mapInArrow(run, docs.schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return scored(docs, train(docs, docs_of(spark, sf_dir, "labels")))
