"""GIF media columns: decode GIF files into timed frames with colour histograms.

``decode`` reads a GIF: LZW code streams, global and local palettes, interlacing,
frame offsets, transparency, and the disposal rules (leave, restore to background,
restore to previous). Where a code lies and how wide it is hangs on the number of
codes since the last clear code only, so codes are unpacked by whole arrays; the
strings they stand for are then built one by one.

``store`` keeps bytes losslessly as the 8-bit samples of a GIF: frames 24 samples
wide under a palette of 256 colours, compressed by the usual greedy LZW encoder.
Sample 255, which no UTF-8 text holds, is transparent, so padding is not seen and
no histogram counts it; frames take turns in disposal and every other one is
interlaced. Everything is made row by row, so memory follows the longest text.

Defined results
  * null or empty text: one block of 576 bytes 255;
  * a file cut short or no GIF at all: ``decode`` raises ValueError; such a row
    has no ``frames``, and in ``features`` media_bytes and media_sha256 only;
  * null media: no frames, and no features but doc_id and n_bytes;
  * null doc_id: kept; repeated rows: each is stored;
  * extra columns: left out; empty table: no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.session import docs_of, prepare, texts

BLOCK = 576
WIDTH = 24
#: Rows of one stored frame at most; longer payloads take more frames.
ROWS = 24 * 16
DELAY_CS = 4
#: The sample that is not seen.
PAD = 255
MOST_CODES = 4096
#: Levels of red, green and blue in a histogram's bins.
LEVELS = (8, 8, 4)
#: A colour's bin is the sum of what each of its channels adds.
_LEVEL_OF = [np.arange(256) * n // 256 * step for n, step in zip(LEVELS, (LEVELS[1] * LEVELS[2], LEVELS[2], 1), strict=True)]


@dataclass
class Frame:
    """One composed picture: palette indices as stored, and the canvas after them."""

    samples: np.ndarray
    canvas: np.ndarray
    delay_ms: int
    disposal: int
    transparent: int | None


# -- LZW --------------------------------------------------------------------


@lru_cache(maxsize=16)
def _all_widths(size: int, entries: int) -> np.ndarray:
    known = np.minimum(np.maximum(np.arange(2 * MOST_CODES) - 1, 0) + entries, MOST_CODES - 1)
    return np.maximum(np.floor(np.log2(known)).astype(np.int64) + 1, size + 1)


def _widths(n: int, size: int, entries: int) -> np.ndarray:
    """Bits of the n codes after a clear code; each but the first adds an entry to a table of ``entries``."""
    known = _all_widths(size, entries)
    return known[:n] if n <= len(known) else np.concatenate((known, np.full(n - len(known), 12)))


def _packed_bits(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes one behind the other, least significant bits first."""
    ends = np.cumsum(widths)
    at, n = ends - widths, -(-int(ends[-1]) // 8)
    shifted = codes.astype(np.int64) << (at & 7)
    out = sum(np.bincount((at >> 3) + k, weights=(shifted >> 8 * k) & 255, minlength=n + 3) for k in range(3))
    return out[:n].astype(np.uint8).tobytes()


def lzw_encode(samples: bytes, size: int = 8) -> bytes:
    """The usual greedy encoder: the longest known string each time, a clear code when the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    # A known string is its prefix's code and its last sample in one number.
    groups, codes, table, following = [], [], {}, end + 1
    add, known, prefix = codes.append, table.get, samples[0] if samples else None
    for s in samples[1:]:
        string = prefix << 8 | s
        code = known(string)
        if code is not None:
            prefix = code
            continue
        add(prefix)
        prefix = s
        if following < MOST_CODES:
            table[string] = following
            following += 1
        else:
            groups.append(codes)
            codes, following = [], end + 1
            add = codes.append
            table.clear()
    if samples:
        add(prefix)
    groups.append(codes)
    # A clear code opens the stream and follows each full group at that group's own width.
    parts, widths = [np.array([clear])], [np.array([size + 1])]
    for k, group in enumerate(groups):
        parts.append(np.array([*group, end if k == len(groups) - 1 else clear], dtype=np.int64))
        widths.append(_widths(len(group) + 1, size, end + 1))
    return _packed_bits(np.concatenate(parts), np.concatenate(widths))


def _unpacked(data: np.ndarray, at: int, widths: np.ndarray) -> np.ndarray:
    """The codes of these widths from bit ``at`` on, as many as there are whole ones; data has three spare bytes."""
    ends = at + np.cumsum(widths)
    n = int(np.searchsorted(ends, 8 * (len(data) - 3), side="right"))
    first, widths = ends[:n] - widths[:n], widths[:n]
    byte = first >> 3
    word = data[byte].astype(np.int64) | data[byte + 1].astype(np.int64) << 8 | data[byte + 2].astype(np.int64) << 16
    return (word >> (first & 7)) & ((1 << widths) - 1)


def _samples(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clear codes.

    The entry made by code k is what that code put out and one sample more, so a
    code past the literals copies earlier output: lengths, then places, are
    followed to literals by pointer doubling instead of one string at a time.
    """
    n = len(codes)
    entry = codes - (clear + 2)  # the code whose output an entry repeats; negative for literals
    literal = codes < clear
    if n and not literal[0]:
        raise ValueError("a stream's first code is not a sample")
    if (entry >= np.minimum(np.arange(n), MOST_CODES - clear - 2)).any():
        raise ValueError("a code beyond the table")
    to = np.where(literal, np.arange(n), entry)
    length = np.where(literal, 0, 1)
    while (to != to[to]).any():
        length, to = length + length[to], to[to]
    length = length + 1
    ends = np.cumsum(length)
    starts = ends - length
    of = np.repeat(np.arange(n), length)
    at = np.arange(len(of))
    source = np.where(literal[of], at, starts[np.maximum(entry, 0)][of] + at - starts[of])
    while True:
        further = source[source]
        if (further == source).all():
            return codes[of[source]].astype(np.uint8)
        source = further


def lzw_decode(data: bytes, size: int, most: int) -> np.ndarray:
    """At most ``most`` samples of a code stream whose first codes stand for 2**size samples."""
    clear, end = 1 << size, (1 << size) + 1
    raw = np.frombuffer(data + b"\x00\x00\x00", dtype=np.uint8)
    out, got, at, ended = [], 0, 0, False
    while got < most and not ended:
        # Codes until the next clear code: their widths follow from how many came since the last one.
        reach = MOST_CODES
        while True:
            widths = _widths(reach, size, end + 1)
            codes = _unpacked(raw, at, widths)
            stop = np.flatnonzero((codes == clear) | (codes == end))
            if len(stop) or len(codes) < reach:
                break
            reach *= 4
        n = int(stop[0]) if len(stop) else len(codes)
        ended = not len(stop) or codes[n] == end
        # A code gives a sample at least: those beyond ``most`` are not needed.
        out.append(_samples(codes[: min(n, most - got)], clear))
        got += len(out[-1])
        at += int(widths[: n + 1].sum())
    return np.concatenate([np.zeros(0, np.uint8), *out])[:most]


# -- files ------------------------------------------------------------------


def palette_332() -> np.ndarray:
    """256 colours: three bits of red, three of green, two of blue."""
    k = np.arange(256)
    return np.stack([(k >> 5) * 255 // 7, (k >> 2 & 7) * 255 // 7, (k & 3) * 85], axis=1).astype(np.uint8)


def _chopped(data: bytes) -> bytes:
    """Sub-blocks of up to 255 bytes, each behind its length, and the empty one."""
    whole = len(data) // 255
    body = np.empty((whole, 256), dtype=np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(data, dtype=np.uint8, count=whole * 255).reshape(whole, 255)
    rest = data[whole * 255 :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\x00"


def _interlaced(h: int) -> np.ndarray:
    """The rows of an interlaced picture in the order in which they are sent."""
    return np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def _sent_rows(samples: np.ndarray, interlaced: bool) -> np.ndarray:
    return samples[_interlaced(len(samples))] if interlaced else samples


def picture(samples: np.ndarray, at: tuple[int, int] = (0, 0), delay_cs: int = DELAY_CS, disposal: int = 1, transparent: int | None = None, palette: np.ndarray | None = None, stream: bytes | None = None, interlaced: bool = False) -> bytes:
    """The blocks of one frame (rows x columns of palette indices)."""
    h, w = samples.shape
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay_cs, transparent or 0, 0)
    flags = (0x80 | (len(palette) - 1).bit_length() - 1 if palette is not None else 0) | (0x40 if interlaced else 0)
    own = palette.astype(np.uint8).tobytes() if palette is not None else b""
    return control + struct.pack("<BHHHHB", 0x2C, *at, w, h, flags) + own + b"\x08" + _chopped(lzw_encode(_sent_rows(samples, interlaced).astype(np.uint8).tobytes()) if stream is None else stream)


def file_of(width: int, height: int, pictures: list[bytes], palette: np.ndarray | None = None, background: int = 0) -> bytes:
    table = palette_332() if palette is None else palette
    head = b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF0 | (len(table) - 1).bit_length() - 1, background, 0)
    return b"".join([head, table.astype(np.uint8).tobytes(), *pictures, b"\x3b"])


def store(payload: bytes) -> bytes:
    """A payload of whole blocks of 576 bytes as the samples of a GIF's frames."""
    samples = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    height = min(len(samples), ROWS)
    cuts = range(0, len(samples), ROWS)
    return file_of(WIDTH, height, [picture(samples[at : at + ROWS], disposal=1 + k % 3, transparent=PAD, interlaced=bool(k % 2)) for k, at in enumerate(cuts)])


def _joined(data: bytes, at: int) -> tuple[bytes, int]:
    """The bytes of sub-blocks from ``at`` and the place behind them."""
    parts = []
    while True:
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, each with the canvas (rows x columns x RGBA) it leaves on the screen."""
    try:
        if data[:6] not in (b"GIF87a", b"GIF89a"):
            raise ValueError("not a GIF")
        width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
        at, common = 13, None
        if flags & 0x80:
            n = 2 << (flags & 7)
            common = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
            at += 3 * n
        canvas = np.zeros((height, width, 4), dtype=np.uint8)
        disposal, delay, transparent = 0, 0, None
        while True:
            kind = data[at]
            if kind == 0x3B:
                return
            if kind == 0x21:
                label = data[at + 1]
                body, behind = _joined(data, at + 2)
                if label == 0xF9:
                    packed, delay, index = struct.unpack_from("<BHB", body)
                    disposal, transparent = packed >> 2 & 7, index if packed & 1 else None
                at = behind
                continue
            if kind != 0x2C:
                raise ValueError("an unknown block")
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if flags & 0x80:
                n = 2 << (flags & 7)
                palette = np.frombuffer(data, dtype=np.uint8, count=3 * n, offset=at).reshape(n, 3)
                at += 3 * n
            size = data[at]
            stream, at = _joined(data, at + 1)
            samples = lzw_decode(stream, size, w * h)
            if len(samples) < w * h:
                raise ValueError("a frame is cut short")
            samples = samples.reshape(h, w)
            if flags & 0x40:
                straight = np.empty_like(samples)
                straight[_interlaced(h)] = samples
                samples = straight
            if palette is None or int(samples.max(initial=0)) >= len(palette):
                raise ValueError("a sample without a colour")
            earlier = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            seen = samples[: area.shape[0], : area.shape[1]]
            shown = np.full((len(palette), 4), 255, dtype=np.uint8)
            shown[:, :3] = palette
            colours = shown.view(np.uint32)[:, 0][seen]
            np.copyto(area.view(np.uint32)[..., 0], colours, where=True if transparent is None else seen != transparent)
            yield Frame(samples, canvas.copy(), delay * 10, disposal, transparent)
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = earlier
            disposal, delay, transparent = 0, 0, None
    except (IndexError, struct.error) as e:
        raise ValueError("the file is cut short") from e


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of visible pixels by level of red, green and blue, 8 x 8 x 4 bins."""
    seen = canvas[canvas[..., 3] > 0]
    bins = _LEVEL_OF[0][seen[:, 0]] + _LEVEL_OF[1][seen[:, 1]] + _LEVEL_OF[2][seen[:, 2]]
    return np.bincount(bins, minlength=LEVELS[0] * LEVELS[1] * LEVELS[2])


# -- Spark ------------------------------------------------------------------


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % BLOCK if text else BLOCK)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's payload as a GIF."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, held = batch.column(0), [], 0
            first = 0
            for k, text in enumerate(texts(batch)):
                rows.append((len(text), store(payload_of(text))))
                held += len(rows[-1][1])
                if held > 8 << 20 or k == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "n_bytes", "media"])
                    first, rows, held = k + 1, [], 0

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each frame: key, frame, at_ms, delay_ms, width, height, rgba and histogram."""
    prepare(media.sparkSession)
    names = [key, "frame", "at_ms", "delay_ms", "width", "height", "rgba", "histogram"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows, at = [], 0
                try:
                    for i, f in enumerate(decode(data) if data is not None else ()):
                        rows.append((k.as_py(), i, at, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], f.canvas.tobytes(), histogram(f.canvas).tolist()))
                        at += f.delay_ms
                except ValueError:
                    rows = []
                if rows:
                    columns = list(zip(*rows, strict=True))
                    kinds = [k.type, *[pa.int64()] * 5, pa.binary(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, column).mapInArrow(run, f"{key} {kind}, frame long, at_ms long, delay_ms long, width long, height long, rgba binary, histogram array<long>")


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, read back: payload, digests and a feature line."""
    prepare(media.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        parts, total, n, ms = [], np.zeros(LEVELS[0] * LEVELS[1] * LEVELS[2], dtype=np.int64), 0, 0
        try:
            for f in decode(data):
                parts.append(f.samples.tobytes())
                total += histogram(f.canvas)
                n, ms = n + 1, ms + f.delay_ms
        except ValueError:
            return None, None, None, len(data), hashlib.sha256(data).hexdigest(), None
        payload = b"".join(parts)
        bins = total.reshape(LEVELS)
        line = ";".join(f"{c}=" + ",".join(map(str, bins.sum(axis=axes).tolist())) for c, axes in (("r", (1, 2)), ("g", (0, 2)), ("b", (0, 1))))
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), f"frames={n};ms={ms};{line}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(zip(*(one(x.as_py()) for x in batch.column(2)), strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(made, kinds, strict=True)]], [x.split()[0] for x in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(stored(docs_of(spark, sf_dir)))
