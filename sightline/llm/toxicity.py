"""Toxicity: a counterfactual-regularised classifier.

A logistic model of word indicators. Sentences of the labelled training rows that
name a group are paired with copies in which the name is swapped for each other of
its kind; the squared change of the score's logit over those pairs is added to the
loss, so that neither a group's name nor a word beside it raises the score of a
sentence that is otherwise neutral. Where texts seldom name a group, there is
nothing to swap: one in INSERT_EVERY texts without a name therefore gets one put
into a sentence, chosen by the text's hash alone, keeps its label, and is paired
with its swaps and with the sentence as it was.

The model is fitted on at most ``TRAIN_ROWS`` labelled rows, those of smallest
seeded hash; every row is scored on its whole text.

Defined results
  * null or empty text: scored by the model like a text without words;
  * texts of any length: memory follows the longest;
  * null doc_id: never a training row, held_out false;
  * documents that repeat a doc_id: the one of smallest text hash is trained on;
  * labels that repeat a doc_id: its smallest label; null labels: not used;
  * no labels, or one class only: that class's share is every row's score;
  * repeated rows: each is scored; extra columns: left out; empty table: no rows.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.quality import remainder, sample
from sightline.llm.session import docs_of, prepare, texts

TRAIN_ROWS = 8_000
THRESHOLD = 0.7
#: A word is an indicator if its shares in the two classes differ by so many standard deviations.
LEAST_Z = 3.0
L2 = 1e-5
FAIRNESS = 5.0
ROUNDS = 600
#: One in so many training texts that name no group gets a name put in.
INSERT_EVERY = 4
#: Names of groups by kind, in four languages; a name is swapped for the others of its kind.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("deaf", "blind", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("mujeres", "hombres"),
    ("niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos", "indígenas"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("femmes", "hommes"),
    ("filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "autochtones"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("frauen", "männer"),
    ("mädchen", "buben"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
)

_SPACED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_SENTENCE = bytes(0x0A if chr(b) in ".!?\n" else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def kinds(identities: tuple = IDENTITIES) -> dict[bytes, tuple[bytes, ...]]:
    return {w.encode(): tuple(o.encode() for o in group) for group in identities for w in group}


def features(words: list[bytes], known: dict) -> set[bytes]:
    """Words, and each group's name with the words beside it."""
    out = set(words)
    if not out.isdisjoint(known):
        for a, b in zip(words, words[1:]):  # noqa: B905
            if a in known or b in known:
                out.add(a + b" " + b)
    return out


def lower(text: bytes) -> bytes:
    return text.lower() if text.isascii() else text.decode().lower().encode()


def words_of(text: bytes) -> list[bytes]:
    return lower(text).translate(_SPACED).split()


def _change(words: list[bytes], other: list[bytes], known: dict) -> tuple[set[bytes], set[bytes]]:
    """Features that ``other`` has and ``words`` has not, and the reverse."""
    a, b = features(words, known), features(other, known)
    return b - a, a - b


def swaps(text: bytes, known: dict) -> list[tuple[set[bytes], set[bytes]]]:
    """(features gained, features lost) for each swap of the names in a sentence that holds one."""
    out = []
    for sentence in lower(text).translate(_SENTENCE).split(b"\n"):
        words = sentence.split()
        if known.keys().isdisjoint(words):
            continue
        for k in range(1, max(len(known[w]) for w in words if w in known)):
            turn = [known[w][(known[w].index(w) + k) % len(known[w])] if w in known else w for w in words]
            if turn != words:
                out.append(_change(words, turn, known))
    return out


def inserted(text: bytes, known: dict, every: int = INSERT_EVERY) -> tuple[bytes, list[tuple[set[bytes], set[bytes]]]] | None:
    """A text with a name put into one of its sentences, and the pairs that follow; None for those left as they are."""
    body = lower(text)
    draw = zlib.crc32(body)
    sentences = body.translate(_SENTENCE).split(b"\n")
    spoken = [k for k, s in enumerate(sentences) if s.split()]
    if draw % every or not spoken or not known.keys().isdisjoint(words_of(body)):
        return None
    names = sorted(known)
    # The quotient's digits, so that the choices do not hang together.
    draw, k = divmod(draw // every, len(spoken))
    draw, name = divmod(draw, len(names))
    words = sentences[spoken[k]].split()
    place = draw % (len(words) + 1)
    told = [*words[:place], names[name], *words[place:]]
    sentences[spoken[k]] = b" ".join(told)
    return b"\n".join(sentences), [_change(words, told, known), *swaps(b" ".join(told), known)]


def prepared(text: bytes, known: dict) -> tuple[set[bytes], list[tuple[set[bytes], set[bytes]]]]:
    """A training row's features and counterfactual pairs."""
    put = inserted(text, known)
    body, pairs = put if put else (text, swaps(text, known))
    return features(words_of(body), known), pairs


def fit(documents: list[tuple[set[bytes], int]], pairs: list[tuple[set[bytes], set[bytes]]] = (), fairness: float = FAIRNESS, rounds: int = ROUNDS) -> dict:
    """A model, as plain values, from (features, label) rows and counterfactual pairs (gained, lost).

    It minimises mean log loss + L2 |w|^2 / 2 + fairness * mean squared change of logit over the pairs.
    """
    y = np.array([float(bool(label)) for _, label in documents])
    n, ups = len(y), y.sum()
    if not 0 < ups < n:
        share = (ups + 1) / (n + 2)
        return {"weights": {}, "bias": math.log(share / (1 - share))}
    up, down = Counter(), Counter()
    for found, label in documents:
        (up if label else down).update(found)
    kept = []
    for g in up.keys() | down.keys():
        a, b = up[g], down[g]
        p = (a + b + 1) / (n + 2)
        z = (a / ups - b / (n - ups)) / math.sqrt(p * (1 - p) * (1 / ups + 1 / (n - ups)))
        if abs(z) >= LEAST_Z and a + b > 1:
            kept.append((-abs(z), g))
    named = sorted({g for gained, lost in pairs for g in gained | lost})
    at = {g: k for k, g in enumerate(dict.fromkeys([g for _, g in sorted(kept)] + named))}
    rows = [[at[g] for g in found if g in at] for found, _ in documents]
    of, col = np.repeat(np.arange(n), [len(r) for r in rows]), np.array([k for r in rows for k in r], dtype=np.int64)
    # A pair's change of logit is linear: +1 for what the swap brings, -1 for what it takes away.
    change = [[(at[g], 1.0) for g in sorted(gained)] + [(at[g], -1.0) for g in sorted(lost)] for gained, lost in pairs]
    c_of = np.repeat(np.arange(len(pairs)), [len(r) for r in change])
    c_col = np.array([k for r in change for k, _ in r], dtype=np.int64)
    c_sign = np.array([s for r in change for _, s in r])
    w, bias, width = np.zeros(len(at)), math.log(ups / (n - ups)), len(at)
    # Steps by coordinate: diagonal bounds of the curvature, with momentum.
    most = max(1, max(map(len, rows), default=1))
    curve = 0.25 * np.bincount(col, minlength=width) * most / n + L2
    if len(pairs):
        longest = max(1, max(map(len, change)))
        curve += 2 * fairness * np.bincount(c_col, minlength=width) * longest / len(pairs)
    look, before, t = w.copy(), w.copy(), 1.0
    for _ in range(rounds):
        m = np.bincount(of, weights=look[col], minlength=n) + bias
        g = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y
        grad = np.bincount(col, weights=g[of], minlength=width) / n + L2 * look
        if len(pairs):
            d = np.bincount(c_of, weights=look[c_col] * c_sign, minlength=len(pairs))
            grad += 2 * fairness * np.bincount(c_col, weights=d[c_of] * c_sign, minlength=width) / len(pairs)
        bias -= g.mean() / 0.25
        w = look - grad / curve
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, before, t = w + (t - 1) / t_next * (w - before), w, t_next
    return {"weights": {g: float(w[k]) for g, k in at.items() if w[k]}, "bias": float(bias)}


def score(model: dict, text: bytes, known: dict) -> float:
    weights = model["weights"]
    m = model["bias"] + math.fsum(weights[g] for g in features(words_of(text), known) & weights.keys())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, m))))


# -- Spark ------------------------------------------------------------------


def train(docs: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, rows: int = TRAIN_ROWS, identities: tuple = IDENTITIES, fairness: float = FAIRNESS) -> dict:
    prepare(docs.sparkSession)
    known = kinds(identities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [pickle.dumps(prepared(t, known), protocol=5) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(told, pa.binary())], ["doc_id", "y", "told"])

    drawn = sample(docs, labels, "toxic", parts, held, rows).mapInArrow(run, "doc_id long, y int, told binary")
    pool: dict[bytes, bytes] = {}  # one object for each feature
    shared = lambda found: {pool.setdefault(g, g) for g in found}
    table = drawn.toArrow().sort_by("doc_id")
    rows_of, pairs = [], []
    for y, told in zip(table.column("y").to_pylist(), table.column("told"), strict=True):
        found, own = pickle.loads(told.as_py())
        rows_of.append((shared(found), y))
        pairs += [(shared(gained), shared(lost)) for gained, lost in own]
    return fit(rows_of, pairs, fairness)


def scored(docs: DataFrame, model: dict, parts: int = 3, held: int = 1, threshold: float = THRESHOLD, identities: tuple = IDENTITIES) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``."""
    spark = prepare(docs.sparkSession)
    sent, known = spark.sparkContext.broadcast(model), kinds(identities)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [score(sent.value, t, known) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = slim.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (remainder(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = docs_of(spark, sf_dir)
    return scored(docs, train(docs, docs_of(spark, sf_dir, "labels")))
