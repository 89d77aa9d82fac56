"""Bounded-space online packing of token ids into training sequences.

Each partition keeps a fixed number of open windows. A piece goes to the fullest
window that still has room for it (best fit). If none has, the fullest window
takes the head of the piece, when its gap is worth a cut, and is emitted; else it
is emitted as it is and a new window opens. What is still open when a partition
ends is merged: those pieces meet in groups of bounded size and are packed again,
largest first; three windows of four are then done, the emptiest go to the next
round, until one group is left. Tokens are made once;
later rounds move pieces, rows of a few numbers, only.

Defined results
  * null or empty text: the end id alone, a piece of one id;
  * a text of any length: cut wherever a window is full;
  * null doc_id: packed like any other, returned with a null doc_id;
  * repeated rows: each is a document of its own;
  * extra columns: left out; empty table: no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.session import cut, docs_of, prepare, texts

LENGTH = 4096
END = 2
OPEN = 32
#: A gap of fewer ids is not worth cutting a document for.
LEAST_CUT = 16
#: Open windows that one merging task packs at most, about.
MERGE = 2048
TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a Python worker remembers.
REMEMBERED = 900_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_workers: dict = {}


class Tokens:
    """Ids of texts. White space parts words for this vocabulary, so words are looked up one by one.

    A word that is not remembered is letters and a tail of ASCII marks, which the
    tokenizer parts as well: the letters go straight to its merges and the tail is
    a word of its own. Any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.merge = self.tokenizer.model.tokenize

    def __call__(self, text: str) -> np.ndarray:
        if any(c in text for c in _ODD):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        # Below U+0100 lower-casing is what the tokenizer does itself; other texts keep their case.
        latin = _latin(text)
        words = (text.lower() if latin else text).split()
        known = self.known
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4")
        except KeyError:
            pass
        distinct = set(words)
        if len(known) + len(distinct) > REMEMBERED:
            known.clear()
        for w in distinct:
            if w not in known:
                known[w] = self.word(w, latin)
        return np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4")

    def word(self, w: str, latin: bool) -> bytes:
        letters = w.rstrip(_MARKS)
        if latin and letters.isalpha():
            found = self.known.get(letters)
            if found is None:
                shown = letters if letters.isascii() else "".join([_SHOWN[b] for b in letters.encode()])
                found = self.known[letters] = np.array([t.id for t in self.merge(shown)], dtype="<u4").tobytes()
            if letters is w or len(letters) == len(w):
                return found
            return found + self.whole(w[len(letters) :])
        return self.whole(w)

    def whole(self, w: str) -> bytes:
        found = self.known.get(w)
        if found is None:
            found = self.known[w] = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return found


#: Marks that the tokenizer parts from letters before them; an apostrophe is not one.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"


def _shown_bytes() -> dict[int, str]:
    """The character by which byte-level vocabularies show each byte: itself if printable, else one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


_SHOWN = _shown_bytes()


#: str.split() takes these for white space, the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"


def _latin(text: str) -> bool:
    try:
        return text.isascii() or text.encode("latin-1") is not None
    except UnicodeEncodeError:
        return False


def tokens_for(path: str) -> Tokens:
    """One tokenizer for each Python worker."""
    if path not in _workers:
        _workers[path] = Tokens(path)
    return _workers[path]


class Windows:
    """At most ``most`` open windows, ordered by fill."""

    def __init__(self, most: int, length: int) -> None:
        self.most, self.length, self.fills, self.open = most, length, [], []

    def add(self, n: int) -> int:
        """Place of the fullest window with room for n ids, or -1."""
        return bisect.bisect_right(self.fills, self.length - n) - 1

    def put(self, at: int, piece: tuple) -> list | None:
        """Put a piece into window ``at`` (-1: a new one); the window if that fills it."""
        fill, pieces = (self.fills.pop(at), self.open.pop(at)) if at >= 0 else (0, [])
        pieces.append(piece)
        fill += piece[2]
        if fill == self.length:
            return pieces
        k = bisect.bisect_left(self.fills, fill)
        self.fills.insert(k, fill)
        self.open.insert(k, pieces)
        return None

    def fullest(self) -> list:
        self.fills.pop()
        return self.open.pop()


def stream(documents: Iterator[tuple], windows: Windows, least_cut: int = LEAST_CUT) -> Iterator[list]:
    """Full windows, as lists of (doc_id, start, length, crc, doc_tokens), of (doc_id, ids)."""
    for doc_id, ids in documents:
        start, total = 0, len(ids)
        while start < total:
            n = min(total - start, windows.length)
            at = windows.add(n)
            if at < 0 and len(windows.fills) >= windows.most:
                gap = windows.length - windows.fills[-1]
                if gap < least_cut or n - gap < least_cut:
                    yield windows.fullest()
                    continue
                n, at = gap, len(windows.fills) - 1
            crc = zlib.crc32(ids[start : start + n].tobytes())
            full = windows.put(at, (doc_id, start, n, crc, total))
            start += n
            if full:
                yield full


def _packer(path: str, length: int, end: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens, windows = tokens_for(path), Windows(most, length)
        part = TaskContext.get().partitionId()
        last = np.array([end], dtype="<u4")
        count = 0

        def documents(batch):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                yield doc_id, np.concatenate((tokens(text.decode()), last))

        for batch in batches:
            done = list(stream(documents(batch), windows))
            if done:
                yield _rows(done, [(part << 32) + count + k for k in range(len(done))])
                count += len(done)
        if windows.open:
            yield _rows(windows.open, [-1 - (part * most + k) for k in range(len(windows.open))])

    return run


def _rows(windows: list[list], names: list[int]) -> pa.RecordBatch:
    """Rows of SCHEMA; a negative sequence_id marks a window that is still open."""
    out = []
    for pieces, name in zip(windows, names, strict=True):
        offset = 0
        for p in pieces:
            out.append((*p, name, offset))
            offset += p[2]
    columns = list(zip(*out, strict=True)) if out else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def merged(pieces: list[tuple], length: int) -> list[list]:
    """Pieces (doc_id, start, length, crc, doc_tokens) in windows: largest first, each to the best fit."""
    windows, done = Windows(1 << 62, length), []
    for p in sorted(pieces, key=lambda p: (-p[2], p[0] is None, p[0] or 0, p[1], p[3])):
        full = windows.put(windows.add(p[2]), p)
        if full:
            done.append(full)
    return [*done, *windows.open[::-1]]


def _merger(length: int, round_no: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        windows = merged([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows], length)
        base = (round_no << 56) + (int(key[0].as_py()) << 24)
        windows.sort(key=lambda w: -sum(p[2] for p in w))
        done = len(windows) if last else len(windows) - len(windows) // 4
        keep = [k < done for k in range(len(windows))]
        names, open_no = [], 0
        for k, ok in enumerate(keep):
            names.append(base + k if ok else -1 - (int(key[0].as_py()) * (1 << 20) + open_no))
            open_no += not ok
        return pa.Table.from_batches([_rows(windows, names)])

    return run


def pack(docs: DataFrame, length: int = LENGTH, end: int = END, most: int = OPEN, path: str | None = None, merge: int = MERGE) -> DataFrame:
    """One row of SCHEMA for each piece of a document (doc_id, text)."""
    prepare(docs.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = cut(slim.mapInArrow(_packer(path, length, end, most), SCHEMA))
    parts = [placed.where("sequence_id >= 0")]
    rest, round_no = placed.where("sequence_id < 0"), 1
    while True:
        # Open windows are numbered -1, -2, ...; neighbours meet in groups of at most ``merge``.
        low = rest.agg(F.min("sequence_id")).first()[0]
        if low is None:
            break
        groups = -(-(-low) // merge)
        dealt = rest.withColumn("_group", F.expr(f"(-1 - sequence_id) div {merge}"))
        made = dealt.groupBy("_group").applyInArrow(_merger(length, round_no, groups == 1), SCHEMA)
        if groups == 1:
            parts.append(made)
            break
        made = cut(made)
        parts.append(made.where("sequence_id >= 0"))
        # The windows that stay open are renumbered without gaps, some for each group.
        still = made.where("sequence_id < 0")
        kept = still.select("sequence_id").distinct().withColumn("_g", F.expr(f"(-1 - sequence_id) div {1 << 20}"))
        room = kept.groupBy("_g").count().agg(F.max("count")).first()[0]
        if room is None:
            break
        rest = still.withColumn("sequence_id", F.expr(f"-1 - (((-1 - sequence_id) div {1 << 20}) * {room} + (-1 - sequence_id) % {1 << 20})"))
        round_no += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(docs_of(spark, sf_dir))
