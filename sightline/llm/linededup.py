"""Line dedup by a sharded minimal perfect hash.

The keys of all lines (two 64-bit hashes of each) are dealt into shards; each shard
is a minimal perfect hash over its distinct keys whose slots index compact arrays:
a 64-bit fingerprint, the number of documents (one byte, which stops at 255) and,
for the keys that reach ``min_docs``, the document that keeps the line. Documents
probe the arrays instead of joining lines: fixed-width rows (row, hash) are routed
to the shards' tasks, a shard's arrays coming first and its probes streaming past
them, one shard in memory at a time; what is found goes back to the row as a list
of the keys that go. A shard that many rows probe, as that of a line which a third
of all documents share, is sent to several tasks, each with a part of its probes.

Only hashes travel by key. Texts are read twice, and meet their lists by row.

Defined results
  * null or empty text: one empty line, which stays;
  * null doc_id: is not counted as a document and keeps no line;
  * repeated doc_ids: one document when counted; each row is rewritten;
  * texts of any length: a text's lines are hashed one by one;
  * extra columns: passed through by ``without_shared_lines`` whatever their
    names; ``shared_lines`` returns its own columns only;
  * empty table: no rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.session import docs_of, kept, packed, prepare, rewritten, texts

MIN_CODE_POINTS = 20
MIN_DOCS = 3
BLANK = b"\t\n\x0b\x0c\r "
#: Keys of one shard, about; its arrays take some 10 bytes a key.
SHARD_KEYS = 8_192
#: Probes of a shard that one task takes, or one in MOST_SPLIT of all, if that is more.
PROBES = 16_384
MOST_SPLIT = 100_000
#: Counts are bytes that stop here.
MOST_COUNT = 255

def _long_enough(key: bytes) -> bool:
    n = MIN_CODE_POINTS
    return len(key) >= 4 * n or len(key) >= n and (key.isascii() or len(key.decode()) >= n)


def line_hashes(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lines; which of them have a key; an (n, 2) array of those keys' hashes, signed."""
    lines = text.split(b"\n")
    at, digests = [], []
    for i, line in enumerate(lines):
        key = line.strip(BLANK).lower()
        if _long_enough(key):
            at.append(i)
            digests.append(xxhash.xxh3_128_digest(key))
    return lines, np.array(at, dtype=np.int64), np.frombuffer(b"".join(digests), dtype=">u8").astype(np.int64).reshape(-1, 2)


# -- minimal perfect hash ---------------------------------------------------


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (keys + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key sits at the first level where no other key meets it.

    Its slot is the number of set bits before it, so n keys fill slots 0..n-1.
    """

    def __init__(self, keys: np.ndarray) -> None:
        left, self.levels, self.n = keys, [], 0
        while len(left):
            size = 64 * (1 + len(left) // 32)
            at = _slots(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            ranks = self.n + np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.levels.append((size, words, ranks))
            self.n += int(alone.sum())
            left = left[~alone[at]]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Slots; for keys that were never put in, any slot or -1."""
        out, rest = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = _slots(keys[rest], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[rest[hit]] = (ranks[at >> 6] + np.bitwise_count(below))[hit]
            rest = rest[~hit]
        return out


class Shard:
    """Minimal perfect hash of a shard's distinct keys and the arrays it indexes."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, keeper: np.ndarray, min_docs: int = MIN_DOCS) -> None:
        # Two keys may share h1; the first of them is hashed by it, the others are listed.
        order = np.lexsort((h2, h1))
        h1, h2, docs, keeper = h1[order], h2[order], docs[order], keeper[order]
        first = np.concatenate(([True], h1[1:] != h1[:-1])) if len(h1) else np.zeros(0, bool)
        self.more = {(int(a), int(b)): (int(n), int(k)) for a, b, n, k in zip(h1[~first], h2[~first], docs[~first], keeper[~first], strict=True)}
        h1, h2, docs, keeper = h1[first], h2[first], docs[first], keeper[first]
        self.min_docs, self.hash = min_docs, PerfectHash(h1.astype(np.uint64))
        at = self.hash(h1.astype(np.uint64))
        self.prints, self.counts = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.uint8 if min_docs <= MOST_COUNT else np.int64)
        # h1 is fixed by h2 and the rotated mix, so a print that agrees is the key but for a chance of 2**-64.
        self.prints[at] = h2 ^ (h1 << 1)
        self.counts[at] = np.minimum(docs, MOST_COUNT) if min_docs <= MOST_COUNT else docs
        # Keepers only of the slots whose count reaches min_docs, in slot order.
        shared = docs >= min_docs
        slots = np.argsort(at[shared])
        self.shared, self.keeper = at[shared][slots], keeper[shared][slots]

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether min_docs documents hold each key, by the count array, and the document that keeps it."""
        at = self.hash(h1.astype(np.uint64))
        keeper = np.zeros(len(h1), np.int64)
        ok = at >= 0
        if self.hash.n:
            slot = np.maximum(at, 0)
            known = ok & (self.prints[slot] == h2 ^ (h1 << 1))
            ok = known & (self.counts[slot] >= self.min_docs)
            keeper[ok] = self.keeper[np.searchsorted(self.shared, slot[ok])]
        else:
            known = ok
        if self.more:
            for i in np.flatnonzero(~known):
                n, k = self.more.get((int(h1[i]), int(h2[i])), (0, 0))
                ok[i], keeper[i] = n >= self.min_docs, k
        return ok, keeper

    def pack(self) -> bytes:
        return pickle.dumps(self, protocol=5)


# -- Spark ------------------------------------------------------------------


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash) rows to a row for each distinct key of a text."""
    for batch in batches:
        found = [np.zeros((0, 2), np.int64)]
        for text in texts(batch):
            _, _, h = line_hashes(text)
            found.append(np.unique(h, axis=0) if len(h) > 1 else h)
        of = pa.array(np.repeat(np.arange(batch.num_rows), [len(h) for h in found[1:]]))
        h = np.concatenate(found)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["doc_id", "text_hash", "h1", "h2"])


def line_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, h1, h2: a row for each distinct line key of each row."""
    return packed(docs).drop("row").mapInArrow(_keys, "doc_id long, text_hash long, h1 long, h2 long")


def counted_lines(keys: DataFrame) -> DataFrame:
    """h1, h2, docs, keeper, probes of every line key: its documents, the largest of them, and rows that hold it."""
    each = keys.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("h1", "h2").agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("keeper"), F.sum("n").alias("probes"))


def shard_index(counted: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """shard, probes and blob (its packed arrays) of each shard, and the number of shards."""
    n = max(1, -(-counted.count() // shard_keys))

    def shards(table: pa.Table) -> pa.Table:
        h1, h2, docs, keeper, probes = (table.column(c).fill_null(0).to_numpy() for c in ("h1", "h2", "docs", "keeper", "probes"))
        return pa.table([pa.array([table.column("shard")[0].as_py()]), pa.array([int(probes.sum())]), pa.array([Shard(h1, h2, docs, keeper, min_docs).pack()], pa.binary())], ["shard", "probes", "blob"])

    dealt = counted.withColumn("shard", F.pmod(F.col("h1"), F.lit(n)).cast("long"))
    return kept(dealt.groupBy("shard").applyInArrow(shards, "shard long, probes long, blob binary"), "shards"), n


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, part, blob, doc_id, text_hash, h1, h2), a part's blob before its probes, to the keys that go."""
    here, shard = None, None
    for batch in batches:
        where = batch.column(0).to_numpy() * (1 << 20) + batch.column(1).to_numpy()
        has = np.array(batch.column(2).is_valid())
        cuts = np.unique(np.concatenate(([0, batch.num_rows], np.flatnonzero(where[1:] != where[:-1]) + 1)))
        for a, b in zip(cuts, cuts[1:], strict=False):
            while a < b and has[a]:
                here, shard = where[a], pickle.loads(batch.column(2)[int(a)].as_py())
                a += 1
            if a == b:
                continue
            if where[a] != here:
                raise ValueError("probes without their shard")
            part = batch.slice(int(a), int(b - a))
            h1, h2 = part.column(5).to_numpy(), part.column(6).to_numpy()
            ok, keeper = shard.probe(h1, h2)
            nobody = np.array(part.column(3).is_null())
            gone = ok & (nobody | (part.column(3).fill_null(0).to_numpy() != keeper))
            at = pa.array(np.flatnonzero(gone))
            yield pa.RecordBatch.from_arrays([part.column(c).take(at) for c in (3, 4, 5, 6)], ["doc_id", "text_hash", "h1", "h2"])


def shared_keys(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """doc_id, text_hash and gone (pairs of hashes): the keys whose lines leave the rows with that doc_id and text."""
    keys = kept(line_keys(docs), "lines")
    index, n = shard_index(counted_lines(keys), min_docs, shard_keys)
    total = index.agg(F.sum("probes")).first()[0] or 0
    # At most MOST_SPLIT shards have more probes than this: a bound on what is sent.
    most = max(probes, total // MOST_SPLIT)
    parts = F.ceil(F.col("probes") / most).cast("int")
    split = index.where(F.col("probes") > most).select("shard", parts.alias("parts"))
    routed = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(n)).cast("long")).join(F.broadcast(split), "shard", "left")
    part = F.pmod(F.xxhash64("doc_id", "text_hash"), F.coalesce("parts", F.lit(1))).cast("int")
    routed = routed.select("shard", part.alias("part"), F.lit(None).cast("binary").alias("blob"), "doc_id", "text_hash", "h1", "h2")
    none = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "text_hash", "h1", "h2")]
    arrays = index.select("shard", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("part"), "blob", *none)
    dealt = arrays.unionByName(routed).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("blob").isNull())
    found = dealt.mapInArrow(_probed, "doc_id long, text_hash long, h1 long, h2 long")
    # A row's list is as long as its text has lines.
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))


def _masks(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each text's lines and which of them go."""
    for text, gone in zip(texts(batch), batch.column(batch.schema.get_field_index("gone")).to_pylist(), strict=True):
        if not gone:
            lines = text.split(b"\n")
            yield lines, np.zeros(len(lines), dtype=bool)
            continue
        lines, at, h = line_hashes(text)
        listed = {(g["h1"], g["h2"]) for g in gone}
        mask = np.zeros(len(lines), dtype=bool)
        mask[at] = [(a, b) in listed for a, b in h.tolist()]
        yield lines, mask


def _kept_text(lines: list[bytes], gone: np.ndarray) -> bytes:
    return b"\n".join(line for line, g in zip(lines, gone, strict=True) if not g) if gone.any() else b"\n".join(lines)


def _with_lists(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """``rows`` (packed) with the list of keys that go, null where none does."""
    # Many rows may share doc_id and text; lists are one a pair. Nulls meet by a flag and a number.
    flag = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "text_hash"]
    return rows.select("*", *flag[:2]).join(gone.select(*flag, "gone"), ["_id", "_none", "text_hash"], "left")


def shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of ``docs``."""
    prepare(docs.sparkSession)

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(len(g), int(g.sum()), hashlib.sha256(_kept_text(lines, g)).hexdigest()) for lines, g in _masks(batch)]
            n, d, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    met = _with_lists(packed(docs).drop("row"), shared_keys(docs, min_docs, shard_keys, probes))
    return met.select("doc_id", "text", "gone").mapInArrow(report, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_shared_lines(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, probes: int = PROBES) -> DataFrame:
    """The rows and columns of ``docs`` with shared lines gone from text (and n_chars set anew)."""
    prepare(docs.sparkSession)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(0).to_pylist()
            yield rewritten(batch, [old if not gone.any() else _kept_text(lines, gone).decode() for old, (lines, gone) in zip(given, _masks(batch), strict=True)])

    met = _with_lists(packed(docs), shared_keys(docs, min_docs, shard_keys, probes))
    return met.select("text", "row", "gone").mapInArrow(rewrite, docs.schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_lines(docs_of(spark, sf_dir))


ORACLE_OP6 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT doc_id, i, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.i, k.line, c.key IS NOT NULL AND c.keeper <> k.doc_id AS gone
  FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
