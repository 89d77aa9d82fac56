"""SimHash near-dedup by a binary trie self-join.

Equal fingerprints collapse first. Two fingerprints within the error budget agree
on enough of some blocks of bits, so the trie is walked once for each choice of
blocks with those bits first: there the error budget is zero, which is an
equality and deals the subtrees to tasks. Below it pairs of nodes are walked
together; a pair's differing bits add up and the pair is dropped as soon as they
exceed the budget. A subtree with more than ``TASK`` fingerprints is not given to
one task: Spark walks its node pairs one bit at a time, as rows, until each pair
is small enough. What a task finds goes out as a spanning forest, so a dense
group costs a row for each fingerprint, not for each pair.

``near_copies`` links fingerprints of ``words``-word shingles within ``bits``
bits. With ``similar`` set a link needs more: the Jaccard similarity of the two
texts' five-word shingles, told by a sketch of 128 one-bit minima that travels
with the fingerprint, must reach it but for SLACK (two and a half deviations of
the sketch); fingerprint and sketch then come from one hash of each word. ``representatives``, the pipeline's stage, works like that: pairs of
two-word shingles and ``NEAR_BITS`` bits find what five-word similarity of 0.8
then confirms.

Defined results
  * null text, or one without words: fingerprint zero, linked like any other;
  * null doc_id: has a fingerprint; its component_id is the smallest doc_id
    that is not null, and null if there is none;
  * repeated rows: each is returned, with the same component;
  * equal fingerprints are one node, whose sketch is that of its first row;
  * texts of any length: hashed in slices of SLICE shingles;
  * extra columns: passed through by ``representatives`` whatever their names,
    left out by the others; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.llm.components import components
from sightline.llm.hot import hot_join, hot_limit
from sightline.llm.session import docs_of, kept, packed, prepare, texts

WORDS = 3
HASH_SEED = 42
BITS = 2
#: Fingerprints in one task's pair of nodes, at most.
TASK = 50_000
#: The stage's shingles, error budget and similarity of five-word shingles.
NEAR_WORDS = 2
NEAR_BITS = 6
SIMILAR = 0.8
SKETCH_WORDS = 5
SKETCH_BITS = 128
SLACK = 0.13
#: Node pairs walked at once.
FRONTIER = 1 << 13
#: Shingles hashed at once, a bound on the memory of one long text.
SLICE = 100_000


def _shingles(text: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, SLICE at a time; the whole sequence is the shingle of a shorter text."""
    found = text.lower().split()
    if not found:
        return
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(found) <= words:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(found) - words + 1], ends[words - 1 :]
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), SLICE):
        yield np.array([digest(line[a:b], HASH_SEED) for a, b in zip(starts[k : k + SLICE].tolist(), ends[k : k + SLICE].tolist(), strict=True)], dtype=np.uint64)


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits; a bit is set if over half of the shingles' hashes have it."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in _shingles(text, words):
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int((counts * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


_MIX = np.array([xxhash.xxh64_intdigest(bytes([k]), HASH_SEED) | 1 for k in range(8)], dtype=np.uint64)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX[0]
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, HASH_SEED) for w in text.lower().split()], dtype=np.uint64)


def shingle_hashes(hashes: np.ndarray, words: int) -> np.ndarray:
    """Hashes of runs of ``words`` words from the words' own; the whole sequence is the shingle of a shorter text."""
    words = min(words, len(hashes))
    if not words:
        return hashes
    n = len(hashes) - words + 1
    total = hashes[:n] * _MIX[1]
    for k in range(1, words):
        total = total + hashes[k : k + n] * _MIX[1 + k]
    return _scrambled(total)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits as words of 64, one from the least hash of each of as many bins of the shingles' hashes.

    An empty bin takes the bit of the next one that is not, as one permutation hashing has it.
    """
    if not len(hashes):
        return np.zeros(2, dtype=np.int64)
    ordered = np.sort(hashes)
    bins = (ordered >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    at = np.searchsorted(bins[first], np.arange(SKETCH_BITS)) % len(first)
    bits = (_scrambled(ordered[first]) & np.uint64(1)).astype(np.uint8)[at]
    return np.packbits(bits).view(np.int64)


def print_and_sketch(text: bytes, words: int) -> tuple[int, np.ndarray]:
    """Fingerprint and sketch from one hash of each word, where the fingerprint need not be that of whole shingles' hashes."""
    hashes = word_hashes(text)
    h = shingle_hashes(hashes, words)
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), SLICE):
        counts += np.unpackbits(h[k : k + SLICE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((counts * 2 > len(h)).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))), sketch(shingle_hashes(hashes, SKETCH_WORDS))


def differing_bits(similar: float | None) -> int:
    """Bits in which two sketches may differ at most; all of them without a similarity."""
    return SKETCH_BITS if similar is None else int(SKETCH_BITS * (1 - similar + SLACK) / 2)


def fingerprints(docs: DataFrame, words: int = WORDS, sketched: bool = False) -> DataFrame:
    """doc_id, text_hash, fp of each row, and s0, s1: its sketch, or zeros."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = texts(batch)
            both = [print_and_sketch(t, words) if sketched else (fingerprint(t, words), (0, 0)) for t in bodies]
            prints = np.array([p for p, _ in both], dtype=np.uint64).view(np.int64)
            told = np.array([k for _, k in both], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints), pa.array(told[:, 0].copy()), pa.array(told[:, 1].copy())], ["doc_id", "text_hash", "fp", "s0", "s1"])

    return packed(docs).drop("row").mapInArrow(run, "doc_id long, text_hash long, fp long, s0 long, s1 long")


# -- the trie walk ----------------------------------------------------------


def orders(bits: int) -> list[tuple[int, list[int]]]:
    """(width, bit positions) of each trie: the first ``width`` bits read are those of some blocks.

    Of m blocks at least m - bits agree where ``bits`` bits differ at most. Up to
    three bits one block of bits + 1 must; beyond, two blocks of bits + 2, so that
    the equal part stays long enough to part the fingerprints.
    """
    agree = 1 if bits <= 3 else 2
    m = bits + agree
    edges = [64 * k // m for k in range(m + 1)]
    out = []
    for chosen in combinations(range(m), agree):
        own = [i for k in chosen for i in range(edges[k], edges[k + 1])]
        out.append((len(own), own + [i for i in range(64) if i not in set(own)]))
    return out


def arranged(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """Fingerprints with bit ``order[0]`` moved to the top, and so on."""
    out = np.zeros_like(fp)
    k = 0
    while k < 64:  # runs of neighbouring bits move together
        n = 1
        while k + n < 64 and order[k + n] == order[k] + n:
            n += 1
        # bit position i counts from the top
        chunk = (fp << np.uint64(order[k])) >> np.uint64(64 - n) if n < 64 else fp
        out |= chunk << np.uint64(64 - k - n)
        k += n
    return out


def walk(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], codes: np.ndarray, used: np.ndarray, depth: int, budget: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``codes`` within ``budget`` differing bits, in batches.

    ``left`` and ``right`` are (from, to) ranges of nodes whose codes are sorted
    and share their first ``depth`` bits; ``used`` are the bits that the two
    prefixes of a pair differ in. A pair of a node with itself yields i < j. Node
    pairs are walked level by level, at most FRONTIER at a time.
    """
    ones: dict[int, np.ndarray] = {}
    todo = [(depth, (*left, *right, used))]
    while todo:
        bit, (a0, a1, b0, b1, used) = todo.pop()
        live = (a1 > a0) & (b1 > b0) & (used <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, used = (x[live] for x in (a0, a1, b0, b1, used))
        if len(a0) > FRONTIER:
            todo += [(bit, tuple(x[k : k + FRONTIER] for x in (a0, a1, b0, b1, used))) for k in range(0, len(a0), FRONTIER)]
            continue
        small = (a1 - a0) * (b1 - b0) <= 32 if bit < 64 else np.ones(len(a0), bool)
        if small.any():
            yield _compare(*(x[small] for x in (a0, a1, b0, b1)), codes, budget)
            a0, a1, b0, b1, used = (x[~small] for x in (a0, a1, b0, b1, used))
        if not len(a0):
            continue
        # The first code of each node with this bit set: zeros come first.
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((codes >> np.uint64(63 - bit)) & np.uint64(1)))).astype(np.int32)
        am, bm = a1 - (ones[bit][a1] - ones[bit][a0]), b1 - (ones[bit][b1] - ones[bit][b0])
        other = a0 != b0
        todo.append(
            (
                bit + 1,
                (
                    np.concatenate((a0, am, a0, am[other])),
                    np.concatenate((am, a1, am, a1[other])),
                    np.concatenate((b0, bm, bm, b0[other])),
                    np.concatenate((bm, b1, b1, bm[other])),
                    np.concatenate((used, used, used + 1, used[other] + 1)),
                ),
            )
        )


def _compare(a0, a1, b0, b1, codes, budget):
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    i, j = a0[of] + k // nb[of], b0[of] + k % nb[of]
    ok = (np.bitwise_count(codes[i] ^ codes[j]) <= budget) & ((a0 != b0)[of] | (i < j))
    return i[ok], j[ok]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (each node's smallest known node) with the links i, j taken in."""
    while len(i):
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        rest = low != high
        i, j, low, high = i[rest], j[rest], low[rest], high[rest]
        np.minimum.at(label, high, low)
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def _linker(budget: int, most: int):
    """Rows (pair, used, depth, side, code, fp, s0, s1), sorted by pair, side, code, to forest edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        held = 0
        for batch in batches:
            rest.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            if held >= 1 << 19:
                table = pa.concat_tables(rest).combine_chunks()
                pairs = table.column("pair").to_numpy()
                ends = np.flatnonzero(pairs[1:] != pairs[:-1]) + 1
                cut_at = int(ends[-1]) if len(ends) else 0
                if cut_at:
                    yield _edges(table.slice(0, cut_at), budget, most)
                rest, held = [table.slice(cut_at)], table.num_rows - cut_at
        if held:
            yield _edges(pa.concat_tables(rest).combine_chunks(), budget, most)

    return run


def _edges(table: pa.Table, budget: int, most: int) -> pa.RecordBatch:
    pair, side = table.column("pair").to_numpy(), table.column("side").to_numpy()
    used, depth = table.column("used").to_numpy(), table.column("depth").to_numpy()
    codes, fp = table.column("code").to_numpy().view(np.uint64), table.column("fp").to_numpy()
    s0, s1 = (table.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1"))
    new = np.concatenate(([True], (pair[1:] != pair[:-1]) | (side[1:] != side[:-1])))
    start = np.flatnonzero(new)
    end = np.concatenate((start[1:], [len(pair)]))
    s, p, u, d = side[start], pair[start], used[start], depth[start]
    self_at = np.flatnonzero(s == 0)  # a node with itself
    a_at = np.flatnonzero((s[:-1] == 1) & (s[1:] == 2) & (p[:-1] == p[1:])) if len(s) > 1 else np.zeros(0, np.int64)
    left = np.concatenate((self_at, a_at))
    right = np.concatenate((self_at, a_at + 1))
    values, node = np.unique(fp, return_inverse=True)
    label = np.arange(len(values))
    for level in np.unique(d[left]):
        at = d[left] == level
        for i, j in walk((start[left[at]], end[left[at]]), (start[right[at]], end[right[at]]), codes, u[left[at]], int(level), budget):
            if most < SKETCH_BITS:
                ok = np.bitwise_count(s0[i] ^ s0[j]).astype(np.int64) + np.bitwise_count(s1[i] ^ s1[j]) <= most
                i, j = i[ok], j[ok]
            label = joined(label, node[i], node[j])
    moved = np.flatnonzero(label != np.arange(len(values)))
    return pa.RecordBatch.from_arrays([pa.array(values[moved]), pa.array(values[label[moved]])], ["a", "b"])


def near_links(prints: DataFrame, task: int = TASK, bits: int = BITS, most: int = SKETCH_BITS) -> DataFrame:
    """Edges a, b of a forest with the components of all pairs of distinct ``fp`` within ``bits`` bits.

    ``prints`` has fp, s0, s1; sketches of a pair may differ in ``most`` bits.
    """
    tries = orders(bits)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for band, (_, order) in enumerate(tries):
                code = arranged(fp.view(np.uint64), order).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), band)), pa.array(code), *batch.columns], ["band", "code", "fp", "s0", "s1"])

    width = F.element_at(F.array(*[F.lit(w) for w, _ in tries]), (F.col("band") + 1).cast("int"))
    top = F.expr("shiftrightunsigned(code, cast(64 - depth as int))")
    # A trie's own nodes have exact numbers, those that Spark splits a hash of 63 bits, below zero.
    rows = prints.select("fp", "s0", "s1").mapInArrow(coded, "band long, code long, fp long, s0 long, s1 long").withColumn("depth", width.cast("long"))
    rows = rows.select((F.shiftleft("band", 40) + top).alias("pair"), F.lit(0).cast("long").alias("used"), "depth", F.lit(0).alias("side"), "code", "fp", "s0", "s1")
    small, rows = [], kept(rows, "tries")
    while True:
        # Pairs of nodes that one task can take, and those that Spark splits by their next bit.
        counts = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("sides"), F.min("side").alias("least"))
        large = kept(counts.where((F.col("n") > task) & F.expr("sides = 0 or least < sides")).select("pair"), "tries")
        if not large.limit(1).count():
            small.append(rows)
            break
        # Of the large nodes there are rows / task at most.
        small.append(rows.join(F.broadcast(large), "pair", "left_anti"))
        rows = kept(_split(rows.join(F.broadcast(large), "pair"), bits), "tries")
    ready = small[0]
    for more in small[1:]:
        ready = ready.unionByName(more)
    dealt = ready.repartition("pair").sortWithinPartitions("pair", "side", F.expr("code ^ cast(-9223372036854775808 as bigint)"))
    return dealt.mapInArrow(_linker(bits, most), "a long, b long")


def _split(rows: DataFrame, bits: int) -> DataFrame:
    """The child pairs of each pair of nodes, one bit further down, within the budget."""
    bit = F.expr("cast(shiftrightunsigned(code, cast(63 - depth as int)) & 1 as int)")
    child = lambda a, b: F.xxhash64("pair", F.lit(a), F.lit(b)).bitwiseOR(F.lit(-(2**63)).cast("long"))
    row = lambda a, b, side, more: F.struct(
        child(a, b).alias("pair"), (F.col("used") + more).alias("used"), (F.col("depth") + 1).alias("depth"), side.cast("int").alias("side"), "code", "fp", "s0", "s1"
    )
    x = F.col("_bit")
    own = F.when(x == 0, F.array(row(0, 0, F.lit(0), 0), row(0, 1, F.lit(1), 1))).otherwise(F.array(row(1, 1, F.lit(0), 0), row(0, 1, F.lit(2), 1)))
    # A row on side 1 goes to the pairs (its bit, 0) and (its bit, 1); one on side 2 to (0, its bit) and (1, its bit).
    of_left = F.when(x == 0, F.array(row(0, 0, F.lit(1), 0), row(0, 1, F.lit(1), 1))).otherwise(F.array(row(1, 0, F.lit(1), 1), row(1, 1, F.lit(1), 0)))
    of_right = F.when(x == 0, F.array(row(0, 0, F.lit(2), 0), row(1, 0, F.lit(2), 1))).otherwise(F.array(row(0, 1, F.lit(2), 1), row(1, 1, F.lit(2), 0)))
    made = rows.withColumn("_bit", bit).select(
        F.explode(F.when(F.col("side") == 0, own).when(F.col("side") == 1, of_left).otherwise(of_right)).alias("r")
    )
    return made.select("r.*").where(F.col("used") <= bits)


# -- operators --------------------------------------------------------------


def near_copies(docs: DataFrame, task: int = TASK, words: int = WORDS, bits: int = BITS, similar: float | None = None) -> DataFrame:
    """doc_id, text_hash, fp, component_id and, for the group, its first row (first_text).

    ``words`` is the length of a shingle, ``bits`` the error budget of a link and
    ``similar`` the similarity of five-word shingles that it needs as well.
    """
    prints = kept(fingerprints(docs, words, similar is not None), "prints")
    total = prints.count()
    row = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "text_hash", "s0", "s1")
    first = kept(prints.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    labels = components(near_links(first.select("fp", "first.s0", "first.s1"), task, bits, differing_bits(similar)))
    named = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("label"), "first", "n")
    # Every member of a group learns the group's first row: aggregated by label, then joined by it.
    named = kept(named, "groups")
    heads = named.groupBy("label").agg(F.min("first").alias("head"))
    known = kept(hot_join(named.select("fp", "label", "n"), heads, ["label"], total).select("fp", "head", "n"), "groups")
    heavy = known.where(F.col("n") > hot_limit(total)).select("fp")
    out = hot_join(prints.drop("s0", "s1"), known.drop("n"), ["fp"], total, heavy=heavy)
    return out.select("doc_id", "text_hash", "fp", F.col("head.doc_id").alias("component_id"), F.col("head.text_hash").alias("first_text"))


def representatives(docs: DataFrame, task: int = TASK, words: int = NEAR_WORDS, bits: int = NEAR_BITS, similar: float | None = SIMILAR) -> DataFrame:
    """The rows of ``docs`` of which each is the first of its group: smallest doc_id, then text hash, then the other columns.

    Columns are passed through, whatever their names.
    """
    groups = near_copies(docs, task, words, bits, similar)
    first = groups.select(F.col("component_id").alias("doc_id"), F.col("first_text").alias("text_hash")).distinct()
    first = first.select(F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), "text_hash")
    rows = packed(docs).drop("text").withColumn("_id", F.coalesce("doc_id", F.lit(0))).withColumn("_none", F.col("doc_id").isNull())
    met = rows.join(first, ["_id", "_none", "text_hash"], "left_semi")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    one = Window.partitionBy("_id", "_none", "text_hash").orderBy(F.to_json(F.struct(*others)) if others else F.lit(0))
    return met.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(docs_of(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
