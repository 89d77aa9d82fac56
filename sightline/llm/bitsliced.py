"""Exact top-k search on a bit-sliced index.

Vectors are quantised to integers. A block of candidates is stored as bit slices:
for each attribute and each bit of its two's complement one bitmap over the
block's rows. A query's integer inner product is a sum of slices shifted by the
set bits of its own components, added with bitmap arithmetic (full adders over
words of 64 rows); the sums are themselves slices. The top rows are then taken
from the most significant slice downward: rows that are surely in, rows still
tied, and when the slices end the boundary rows, all of equal score, are resolved
exactly by their ids. Sums are as wide as they need: only a score that is
returned must fit into 64 bits, and the job fails if one does not.

The index is made once, as rows of blocks of bounded bytes; where the queries take
more than one pass it is written to the shared folder. The queries go to the
executors in parts of bounded size, one pass over the index for each part; a task
returns at most k rows for each query and block.

Defined results
  * vectors null or holding null or non-finite components, and rows without an
    id, take no part; a vector without components does, with score 0;
  * vectors of unequal lengths: missing components count as zero;
  * components of any finite size: rows with large ones form blocks of their own;
  * equal scores: the smaller id first; repeated rows: each is a candidate;
    a query id that occurs more than once: its smallest vector asks once;
  * fewer than k candidates: all of them; empty table: no rows;
  * extra columns: left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.session import cut, docs_of, kept, prepare

SCALE = 1024
K = 10
#: Rows of one block of the index and queries of one pass.
BLOCK_ROWS = 1 << 16
PASS_QUERIES = 1 << 14
#: Bytes of one block's slices, about.
BLOCK_BYTES = 16 << 20
#: Components beyond this many bits make a row a wide one.
WIDE_BITS = 30
SEED = 3
LEAST, MOST = -(2**63), 2**63 - 1

Slices = dict[int, np.ndarray]


class BitSliced:
    """Bitmaps (uint64 words over rows) of every bit of every attribute of a block of integers."""

    def __init__(self, rows: int, slices: np.ndarray) -> None:
        self.rows, self.slices = rows, slices
        self.width, self.bits, self.words = slices.shape

    @classmethod
    def of(cls, values: np.ndarray) -> BitSliced:
        """``values``: rows x attributes, of int64 or of Python's integers."""
        rows, width = values.shape
        words = -(-rows // 64)
        low, high = (int(f(initial=0)) for f in (values.min, values.max))
        bits = max(high.bit_length(), (-low - 1).bit_length() if low < 0 else 0) + 1
        padded = np.zeros((words * 64, width), dtype=values.dtype)
        padded[:rows] = values
        slices = np.empty((width, bits, words), dtype=np.uint64)
        for b in range(bits):
            packed = np.packbits(((padded >> b) & 1).astype(bool).T, axis=1, bitorder="little")
            slices[:, b] = np.ascontiguousarray(packed).view("<u8").reshape(width, words)
        return cls(rows, slices)

    def products(self, query: np.ndarray) -> tuple[np.ndarray, int]:
        """Slices (least significant first) of query . row + offset, which is never negative, and the offset.

        A negative coefficient takes the complement of a slice: -s = not(s) - 1.
        The top bit of a component counts negatively.
        """
        waiting: dict[int, list[np.ndarray]] = {}
        offset = 0
        ones = ~np.uint64(0)
        q = np.abs(query)
        for shift in range(int(q.max(initial=0)).bit_length()):
            at = np.flatnonzero((q >> shift) & 1)
            if not len(at):
                continue
            down = query[at] < 0
            for b in range(self.bits):
                part = self.slices[at, b]
                flip = ~down if b == self.bits - 1 else down
                part[flip] ^= ones
                offset += int(flip.sum()) << (shift + b)
                waiting.setdefault(shift + b, []).append(part)
        out, weight = [], 0
        while waiting:
            stack = waiting.pop(weight, [])
            rows = np.concatenate(stack) if stack else np.zeros((0, self.words), np.uint64)
            while len(rows) > 1:
                n = len(rows) // 3
                if n:
                    a, b, c = rows[:n], rows[n : 2 * n], rows[2 * n : 3 * n]
                    x = a ^ b
                    rows, carry = np.concatenate((x ^ c, rows[3 * n :])), (a & b) | (x & c)
                else:
                    rows, carry = (rows[0] ^ rows[1])[None], (rows[0] & rows[1])[None]
                waiting.setdefault(weight + 1, []).append(carry)
            out.append(rows[0] if len(rows) else np.zeros(self.words, np.uint64))
            weight += 1
        return np.array(out) if out else np.zeros((1, self.words), np.uint64), offset

    def top(self, query: np.ndarray, k: int, ids: np.ndarray, own: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k largest products, ties to smaller ids, without rows of id ``own``."""
        sums, offset = self.products(query)
        tied = np.full(self.words, ~np.uint64(0))
        if self.rows % 64:
            tied[-1] = np.uint64((1 << (self.rows % 64)) - 1)
        if own is not None:
            for r in np.flatnonzero(ids == own):
                tied[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        surely, n = np.zeros(self.words, np.uint64), 0
        for s in sums[::-1]:
            with_bit = tied & s
            m = int(np.bitwise_count(with_bit).sum())
            if n + m <= k:
                surely |= with_bit
                n += m
                tied &= ~s
                if n == k:
                    tied[:] = 0
                    break
            else:
                tied = with_bit
        at, edge = _rows_of(surely), _rows_of(tied)
        if n < k and len(edge):
            edge = edge[np.lexsort((edge, ids[edge]))][: k - n]
            at = np.concatenate((at, edge))
        bit = (sums[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        if len(sums) <= 62:
            return at, (bit.astype(np.int64) << np.arange(len(sums))[:, None]).sum(axis=0) - offset
        return at, np.array([sum(1 << int(w) for w in np.flatnonzero(column)) - offset for column in bit.T], dtype=object)


def _rows_of(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    if not len(words):
        return words
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return words[w] * 64 + b


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(scale * x)


def quantised(batch: pa.RecordBatch, scale: int = SCALE) -> tuple[list[int], list[np.ndarray]]:
    """ids and integer vectors of the batch's rows that take part; wide ones as Python's integers."""
    ids, rows = [], []
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is None or not v.is_valid:
            continue
        values = v.values
        if values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if not np.isfinite(x).all():
            continue
        ids.append(i)
        if len(x) and np.abs(x).max() * scale >= 2.0**WIDE_BITS:
            rows.append(np.array([_whole(c, scale) for c in x.tolist()], dtype=object))
        else:
            rows.append(np.floor(scale * x).astype(np.int64))
    return ids, rows


def _table(rows: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=rows[0].dtype)
    for k, r in enumerate(rows):
        out[k, : len(r)] = r
    return out


def _indexer(scale: int, most: int):
    """Vectors to rows (rows, width, bits, ids, slices), one for each block."""

    def block(ids: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
        values = _table(rows)
        index = BitSliced.of(values)
        cells = [len(ids), index.width, index.bits, np.array(ids, dtype="<i8").tobytes(), index.slices.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int64()] * 3 + [pa.binary()] * 2, strict=True)], [c.split()[0] for c in INDEX.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Blocks of narrow rows, and of wide ones, whose many slices would else be paid for every row.
        held = {False: ([], [], [0]), True: ([], [], [0])}
        for batch in batches:
            for i, v in zip(*quantised(batch, scale), strict=True):
                ids, rows, size = held[v.dtype == object]
                bits = max((int(c).bit_length() for c in v), default=0) + 1 if v.dtype == object else WIDE_BITS
                ids.append(i)
                rows.append(v)
                size[0] += len(v) * bits // 8 + 8
                if len(ids) >= most or size[0] >= BLOCK_BYTES:
                    yield block(ids, rows)
                    held[v.dtype == object] = ([], [], [0])
        for ids, rows, _ in held.values():
            if ids:
                yield block(ids, rows)

    return run


INDEX = "n long, width long, bits long, ids binary, slices binary"


def index_of(vectors: DataFrame, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index of (vec_id, embedding): a row for each block."""
    prepare(vectors.sparkSession)
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return slim.mapInArrow(_indexer(scale, block_rows), INDEX)


def search(candidates: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, pass_queries: int = PASS_QUERIES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query but itself (rows vec_id, embedding)."""
    spark = prepare(candidates.sparkSession)
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # Vectors that take no part ask nothing; of several with one id the smallest that takes part asks.
    able = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = cut(asked.where(able).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    passes = max(1, -(-asked.count() // pass_queries))
    index = index_of(candidates, scale, block_rows)
    if passes > 1:
        index = kept(index, "slices")
    found = []
    for turn in range(passes):
        # About pass_queries rows: what the driver holds and sends at a time has this bound.
        part = asked.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(passes)) == turn)
        sent = spark.sparkContext.broadcast([quantised(b, scale) for b in part.toArrow().to_batches()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, width, bits, ids, slices in zip(*batch.to_pydict().values(), strict=True):
                    ids = np.frombuffer(ids, dtype="<i8")
                    block = BitSliced(n, np.frombuffer(slices, dtype=np.uint64).reshape(width, bits, -(-n // 64)))
                    for q_ids, q_values in sent.value:
                        out = []
                        for q, query in zip(q_ids, q_values, strict=True):
                            at, scores = block.top(query[:width], k, ids, q)
                            # A score beyond 64 bits goes on as the nearest that fits, and is refused if it stays among the best.
                            beyond = np.array([not LEAST <= x <= MOST for x in scores], dtype=bool)
                            out.append((np.full(len(at), q), ids[at], np.clip(scores, LEAST, MOST).astype(np.int64), beyond))
                        if out:
                            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score", "beyond"])

        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        rows = index.mapInArrow(run, "query_id long, vec_id long, score long, beyond boolean")
        told = F.when(F.col("beyond"), F.raise_error("an inner product among the best leaves 64 bits")).otherwise(F.col("score"))
        ranked = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", told.alias("score"))
        found.append(ranked if passes == 1 else cut(ranked))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = docs_of(spark, sf_dir, "embeddings")
    return search(table, table.where("vec_id % 100 = 0"))


ORACLE_OP3 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q, true), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
