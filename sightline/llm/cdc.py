"""Substring dedup by content-defined chunking with a gear rolling hash.

A gear hash of the last 32 bytes runs over each text. A word's end is a chunk's
end where the hash falls under a threshold and the chunk has enough words, so
boundaries hang on the bytes nearby only and come back soon after an insertion.
Chunks are compared by a 128-bit digest of their words. Every digest keeps its
first occurrence (smallest doc_id, then place); runs of neighbouring later
occurrences that are long enough are repeated passages, which ``without_repeats``
cuts out of the text. A passage may be glued of stretches that different rows
keep; each of them is named with its keeper.

One document's digests travel as arrays, written once to the shared folder. Rows
of fixed width are then dealt by digest once, and each learns its digest's first
row there. Digests that are frequent in a sample are not dealt: their first rows
combine on the map side, a row a task, and are sent to where the occurrences are.
The sample decides about the way only, the result is the same on both.

``passage_words`` is the least length of a run that is reported (PASSAGE_WORDS);
0 reports every repeated chunk.

Defined results
  * null or empty text: no chunks, nothing repeats;
  * a null doc_id orders last, so it keeps a chunk only if no other document has it;
  * repeated rows and doc_ids: occurrences of their own, in an order by row
    and place; exact copies repeat from end to end;
  * chunks are whole words; white space between words does not count;
  * texts of any length: memory follows the longest;
  * extra columns: passed through by ``without_repeats`` whatever their names,
    left out by ``repeats``; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.session import docs_of, kept, packed, prepare, rewritten, texts

#: Words of a chunk at least, and one in so many later word ends closes it.
LEAST_WORDS = 4
ONE_IN = 4
#: Words of a run of repeated chunks that make it a passage.
PASSAGE_WORDS = 16
SEED = 5
#: A digest with HOT_HITS among the sampled chunks, up to twice SAMPLE_ROWS, is hot; of these there are 2 * SAMPLE_ROWS / HOT_HITS, about, at most.
SAMPLE_ROWS = 1 << 18
HOT_HITS = 32
#: The gear table: one 32-bit number for each byte, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), SEED) for b in range(256)], dtype=np.uint32)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR over it and the 31 before, each shifted by its distance."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunks(text: bytes) -> tuple[list[int], list[int], list[int], list[bytes]]:
    """from, to (bytes), words and digest of each chunk; chunks begin and end with a word."""
    data = np.frombuffer(text, dtype=np.uint8)
    blank = _SPACE[data]
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return [], [], [], []
    # Words joined by one space are what is hashed, so that white space does not matter.
    line = text if (ends[:-1] + 1 == starts[1:]).all() and not (blank & (data != 32)).any() else b" " * int(starts[0]) + b" ".join(text.split())
    if line is text:
        s, e = starts, ends
    else:
        shrunk = starts - np.concatenate(([0], np.cumsum(starts[1:] - ends[:-1] - 1)))
        s, e = shrunk, shrunk + (ends - starts)
    first = int(s[0])
    h = gear(np.frombuffer(line, dtype=np.uint8)[first:])
    closes = np.flatnonzero(h[e - 1 - first] < np.uint32(2**32 // ONE_IN)).tolist()
    cuts, last = [], -1
    for w in closes:
        if w - last >= LEAST_WORDS:
            cuts.append(w)
            last = w
    if last != len(s) - 1:
        cuts.append(len(s) - 1)
    begin = [0, *[w + 1 for w in cuts[:-1]]]
    digest = xxhash.xxh3_128_digest
    a, b = s[begin].tolist(), e[cuts].tolist()
    return starts[begin].tolist(), ends[cuts].tolist(), [y - x + 1 for x, y in zip(begin, cuts, strict=True)], [digest(line[x:y]) for x, y in zip(a, b, strict=True)]


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [chunks(t) for t in texts(batch)]
        halves = [np.frombuffer(b"".join(f[3]), dtype="<i8").reshape(-1, 2) for f in found]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2),
                *[pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in range(3)],
                *[pa.array([h[:, k].tolist() for h in halves], pa.list_(pa.int64())) for k in range(2)],
            ],
            ["doc_id", "text_hash", "begin", "end", "words", "d1", "d2"],
        )


def chunked(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and arrays begin, end, words, d1, d2 with an element for each chunk."""
    prepare(docs.sparkSession)
    return packed(docs).drop("row").mapInArrow(_chunked, "doc_id long, text_hash long, begin array<int>, end array<int>, words array<int>, d1 array<long>, d2 array<long>")


def _later(each: DataFrame, total: int, hot_hits: int) -> DataFrame:
    """row, at, first of every occurrence but its digest's first; ``each`` has doc, row, at, d1, d2 for ``total`` occurrences."""
    key, place = ["d1", "d2"], F.struct("doc", "row", "at")
    one_in = max(1, total // SAMPLE_ROWS)
    sample = each.where(F.pmod(F.xxhash64("row", "at", F.lit(SEED)), F.lit(one_in)) == 0)
    hot = kept(sample.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= hot_hits).select(*key), "hot")
    order = Window.partitionBy(*key).orderBy("doc", "row", "at").rowsBetween(Window.unboundedPreceding, 0)
    later = lambda df: df.where(place != F.col("first")).select("row", "at", "first")
    if hot.isEmpty():
        return later(each.withColumn("first", F.first(place).over(order)))
    rare = each.join(F.broadcast(hot), key, "left_anti").withColumn("first", F.first(place).over(order))
    firsts = kept(each.join(F.broadcast(hot), key).groupBy(*key).agg(F.min(place).alias("first")), "hot")
    return later(rare).unionByName(later(each.join(F.broadcast(firsts), key)))


def repeats(docs: DataFrame, passage_words: int = PASSAGE_WORDS, hot_hits: int = HOT_HITS) -> DataFrame:
    """doc_id, text_hash, row, begin, n_bytes, n_words, first_doc_id, keepers for each repeated passage.

    ``begin`` and ``n_bytes`` are bytes of the text; ``first_doc_id`` is the
    document that keeps the passage's first chunk; ``row`` tells rows apart that
    share doc_id and text. ``keepers`` has begin, n_bytes, n_words, first_doc_id
    of each stretch of the passage whose chunks one row keeps, in their order.
    """
    # A written table rather than a checkpoint: encoded columns are a fraction of its size.
    table = kept(chunked(docs).withColumn("row", F.monotonically_increasing_id()), "chunks")
    # Nothing but keys is dealt by digest: no null doc_id needs a flag, as nulls take the largest number.
    each = table.select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc"), "row", F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "d"))
    each = each.select("doc", "row", "at", F.col("d.d1").alias("d1"), F.col("d.d2").alias("d2"))
    total = table.agg(F.sum(F.size("words"))).first()[0] or 0
    owner = F.when(F.col("first.doc") < F.lit(2**63 - 1), F.col("first.doc"))
    again = _later(each, total, hot_hits).select("row", "at", owner.alias("first_doc_id"), F.col("first.row").alias("first_row"))
    lists = again.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "first_doc_id", "first_row"))).alias("again"))
    back = lists.join(table.select("row", "doc_id", "text_hash", "begin", "end", "words"), "row")
    # Neighbouring chunks have the same difference of chunk number and place in the list.
    each = back.select("row", "doc_id", "text_hash", "begin", "end", "words", F.posexplode("again").alias("k", "c"))
    each = each.select("row", "doc_id", "text_hash", (F.col("c.at") - F.col("k")).alias("run"), "c.at", "c.first_doc_id", "c.first_row", F.expr("begin[c.at]").alias("b"), F.expr("end[c.at]").alias("e"), F.expr("words[c.at]").alias("w"))
    # A stretch begins where the keeper changes; all is dealt by row already.
    before = Window.partitionBy("row").orderBy("at")
    turn = F.coalesce(F.col("first_row") != F.lag("first_row").over(before), F.lit(True)).cast("int")
    own = ("row", "doc_id", "text_hash", "run")
    stretches = (
        each.withColumn("turn", turn)
        .withColumn("stretch", F.sum("turn").over(before))
        .groupBy(*own, "stretch")
        .agg(F.min("b").alias("begin"), F.max("e").alias("_end"), F.sum("w").alias("n_words"), F.first("first_doc_id").alias("first_doc_id"))
    )
    runs = (
        stretches.groupBy(*own)
        .agg(
            F.min("begin").alias("begin"), F.max("_end").alias("_end"), F.sum("n_words").alias("n_words"), F.min_by("first_doc_id", "begin").alias("first_doc_id"),
            F.sort_array(F.collect_list(F.struct(F.col("begin").cast("long").alias("begin"), (F.col("_end") - F.col("begin")).cast("long").alias("n_bytes"), "n_words", "first_doc_id"))).alias("keepers"),
        )
        .where(F.col("n_words") >= passage_words)
    )
    return runs.select("doc_id", "text_hash", "row", F.col("begin").cast("long").alias("begin"), (F.col("_end") - F.col("begin")).cast("long").alias("n_bytes"), "n_words", "first_doc_id", "keepers")


def without_repeats(docs: DataFrame, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """The rows and columns of ``docs`` with repeated passages cut out of text (n_chars set anew)."""
    spans = repeats(docs, passage_words)
    lists = spans.groupBy("doc_id", "text_hash", "row").agg(F.sort_array(F.collect_list(F.struct("begin", "n_bytes"))).alias("spans"))
    # Rows that share doc_id and text are told apart by their number; nulls meet by a flag and a zero.
    named = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "text_hash"]
    same = ["_id", "_none", "text_hash", "_k"]
    # The first of equal rows may keep its text: it is then the one beyond the lists' number.
    lists = lists.select(*named, "spans", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("row")).alias("_k"))
    rows = packed(docs).withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy(F.lit(0))))
    met = rows.select("text", "row", *named, "_k").join(lists, same, "left").select("text", "row", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept_texts = []
            for old, body, spans in zip(batch.column(0).to_pylist(), texts(batch), batch.column(2).to_pylist(), strict=True):
                parts, at = [], 0
                for s in spans or ():
                    parts.append(body[at : s["begin"]])
                    at = s["begin"] + s["n_bytes"]
                kept_texts.append((b"".join(parts) + body[at:]).decode() if spans else old)
            yield rewritten(batch, kept_texts)

    return met.mapInArrow(run, docs.schema)


def op5_cdc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(docs_of(spark, sf_dir)).select("doc_id", "begin", "n_bytes", "n_words", "first_doc_id", "keepers")
