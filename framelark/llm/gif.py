"""GIF columns: bytes stored as 8-bit samples of timed frames, read back, and described by colour histograms.

The writer is greedy LZW: the longest run of samples that the table holds is one code, of nine bits at first and twelve
at most, and gives the table its next entry; a full table is cleared. The reader takes any GIF: it finds code widths from
the distance to the last clear code, resolves table entries as copies of earlier output by pointer doubling, and applies
palettes, interlacing, disposal and transparency.

Defined cases: a null text is empty and stores 64 zero bytes; a null image gives no frames; equal texts give equal
values; truncated or foreign bytes raise ValueError; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import table

#: Samples in a row, rows in a frame, hundredths of a second that a frame stays.
WIDTH, HEIGHT, DELAY = 64, 1024, 10
#: The first entry's code, codes that a table can hold.
CLEAR, STOP, FIRST, CODES = 256, 257, 258, 4096
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


@dataclass
class Frame:
    """left, top; samples (h, w); palette (n, 3); delay in hundredths; disposal; transparent index or -1."""
    left: int
    top: int
    samples: np.ndarray
    palette: np.ndarray
    delay: int
    disposal: int
    transparent: int


#: Bits of the code at each distance from a clear code: a code more than the table can name makes them grow.
WIDTHS = np.minimum(12, 9 + np.searchsorted([255, 767, 1791], np.arange(CODES), side="right"))


def pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of these many bits (12 at most), lowest bit first."""
    at = np.cumsum(widths) - widths
    byte, v = at >> 3, codes.astype(np.int64) << (at & 7)
    size = int(at[-1] + widths[-1] + 7) >> 3
    # codes share bytes but no bits, so sums are the joined bits
    return sum(np.bincount(byte + k, v >> 8 * k & 255, size + 2) for k in range(3))[:size].astype(np.uint8).tobytes()


def codes_of(data: np.ndarray, bit: int, width: int, count: int) -> np.ndarray:
    """`count` codes of `width` bits from a bit position on; bits past the end are 0."""
    at = bit + width * np.arange(count, dtype=np.int64)
    byte = at >> 3
    d = np.concatenate([data[byte[0] : byte[-1] + 4], np.zeros(4, np.uint8)]).astype(np.uint32) if count else data[:0].astype(np.uint32)
    byte = byte - byte[0] if count else byte
    return ((d[byte] | d[byte + 1] << 8 | d[byte + 2] << 16) >> (at & 7).astype(np.uint32)) & ((1 << width) - 1)


def write_lzw(samples: np.ndarray) -> bytes:
    """The code stream of 8-bit samples."""
    codes, begins = [CLEAR], [0]
    table: dict[int, int] = {}
    put, known, after, run = codes.append, table.get, FIRST, -1
    for s in samples.tobytes():
        if run < 0:
            run = s
            continue
        longer = run << 8 | s
        if (code := known(longer)) is not None:
            run = code
            continue
        put(run)
        if after < CODES:
            table[longer] = after
            after += 1
        else:
            begins.append(len(codes))
            put(CLEAR)
            table.clear()
            after = FIRST
        run = s
    if run >= 0:
        put(run)
    put(STOP)
    # a clear code still has the width of the table that it ends
    begin = np.array(begins)
    since = np.arange(len(codes)) - np.repeat(begin, np.diff(np.append(begin, len(codes)))) - 1
    since[begin[1:]] = np.diff(begin) - 1
    since[0] = 0
    return pack(np.array(codes), WIDTHS[since])


def _expand(codes: np.ndarray, first: int) -> np.ndarray:
    """Samples of codes since a clear code; `first` is the first table code. Entry j is output j and one sample more."""
    n = len(codes)
    ref = codes.astype(np.int64) - first  # the entry, or negative for a literal
    own = np.arange(n)
    if (ref >= own).any():
        raise ValueError("a code that is not in the table yet")
    lit = ref < 0
    if lit.all():
        return codes.astype(np.uint8)
    # depth: how many times an entry extends another, down to a literal
    depth, up = np.where(lit, 0, 1), np.where(lit, own, ref)
    while (hop := up[up]) is not None and (hop != up).any():
        depth, up = depth + depth[up], hop
    size = depth + 1
    start = np.concatenate([[0], np.cumsum(size)])
    # every sample comes from a literal's place, or from the same place in the output that its entry copies
    total = int(start[-1])
    code = np.repeat(own, size)
    src = np.arange(total)
    inner = ~lit[code]
    src[inner] = start[ref[code[inner]]] + (src[inner] - start[code[inner]])
    while (hop := src[src]) is not None and (hop != src).any():
        src = hop
    out = np.zeros(total, np.uint8)
    out[start[:-1][lit]] = codes[lit]
    return out[src]


def read_lzw(data: bytes, least: int, count: int) -> np.ndarray:
    """`count` samples of a code stream whose literals have `least` bits."""
    d = np.frombuffer(data, np.uint8)
    clear, bit, bits, out, got = 1 << least, 0, 8 * len(d), [], 0
    ended = False
    while not ended and got < count and bit + least + 1 <= bits:
        parts, width, known, room = [], least + 1, clear + 2, 0
        while True:  # until a clear or end code; entry n comes with code n + 1
            n = (1 << width) - known + (not parts) if width < 12 else bits // width + 1
            n = min(n, (bits - bit) // width)
            c = codes_of(d, bit, width, n)
            stop = np.flatnonzero((c == clear) | (c == clear + 1))
            if len(stop):
                parts.append(c[: stop[0]])
                bit, ended = bit + width * (int(stop[0]) + 1), bool(c[stop[0]] == clear + 1)
                break
            parts.append(c)
            bit += width * n
            room += n
            if room >= count or bit + width > bits:
                ended = bit + width > bits
                break
            known += n - (len(parts) == 1)
            if width < 12 and known >= 1 << width:
                width += 1
        c = np.concatenate(parts)
        if len(c):
            out.append(_expand(c, clear + 2))
            got += len(out[-1])
    have = np.concatenate(out) if out else np.zeros(0, np.uint8)
    if len(have) < count:
        raise ValueError("the code stream ends early")
    return have[:count]


def blocks(data: bytes) -> bytes:
    """Data as sub-blocks of up to 255 bytes and the empty one."""
    full = len(data) // 255
    head = np.empty((full, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def unblock(gif: bytes, at: int) -> tuple[bytes, int]:
    """The joined sub-blocks from `at` on, and where they end."""
    run = 0
    while at + 256 * run < len(gif) and gif[at + 256 * run] == 255:
        run += 1
    parts = [np.frombuffer(gif, np.uint8, 256 * run, at).reshape(run, 256)[:, 1:].tobytes()] if run and at + 256 * run <= len(gif) else []
    at += 256 * run
    while True:
        if at >= len(gif):
            raise ValueError("the file ends within a block")
        n = gif[at]
        if not n:
            return b"".join(parts), at + 1
        parts.append(gif[at + 1 : at + 1 + n])
        at += n + 1


def encode(payload: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """A GIF of grey frames that hold the payload, whose length is a positive multiple of `width`, row by row."""
    rows = len(payload) // width
    out = [b"GIF89a", struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0), GREY]
    samples = np.frombuffer(payload, np.uint8)
    for k in range(0, rows, height):
        part = samples[k * width : (k + height) * width]
        out += [b"\x21\xf9\x04\x04", struct.pack("<H", delay), b"\0\0", b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0), b"\x08", blocks(write_lzw(part))]
    return b"".join([*out, b"\x3b"])


def decode(gif: bytes) -> tuple[tuple[int, int, int], list[Frame]]:
    """(canvas width, height, background index) and the frames as stored."""
    if gif[:3] != b"GIF" or len(gif) < 13:
        raise ValueError("not a GIF")
    w, h, flags, background, _ = struct.unpack_from("<HHBBB", gif, 6)
    at, shared = 13, np.zeros((0, 3), np.uint8)
    if flags & 128:
        n = 2 << (flags & 7)
        shared, at = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
    frames, delay, disposal, transparent = [], 0, 0, -1
    while at < len(gif) and gif[at] != 0x3B:
        if gif[at] == 0x21:
            label = gif[at + 1]
            data, after = unblock(gif, at + 2)
            if label == 0xF9 and len(data) >= 4:
                disposal, delay, transparent = data[0] >> 2 & 7, data[1] | data[2] << 8, data[3] if data[0] & 1 else -1
            at = after
        elif gif[at] == 0x2C:
            left, top, fw, fh, own = struct.unpack_from("<HHHHB", gif, at + 1)
            at, palette = at + 10, shared
            if own & 128:
                n = 2 << (own & 7)
                palette, at = np.frombuffer(gif, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n
            least = gif[at]
            data, at = unblock(gif, at + 1)
            samples = read_lzw(data, least, fw * fh).reshape(fh, fw)
            if own & 64:
                order = np.concatenate([np.arange(a, fh, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples = samples[np.argsort(order)]
            frames.append(Frame(left, top, samples, palette, delay, disposal, transparent))
            delay, disposal, transparent = 0, 0, -1
        else:
            raise ValueError("an unknown block")
    return (w, h, background), frames


def compose(size: tuple[int, int, int], frames: list[Frame]) -> Iterator[np.ndarray]:
    """The RGBA canvas (h, w, 4) as shown in each frame's time."""
    w, h, _ = size
    canvas = np.zeros((h, w, 4), np.uint8)
    for f in frames:
        before = canvas.copy() if f.disposal == 3 else None
        part = canvas[f.top : f.top + f.samples.shape[0], f.left : f.left + f.samples.shape[1]]
        s = f.samples[: part.shape[0], : part.shape[1]]
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(f.palette), :3], colours[:, 3] = f.palette, 255
        seen = s != f.transparent
        part[seen] = colours[s[seen]]
        yield canvas
        if f.disposal == 2:
            part[:] = 0
        elif f.disposal == 3:
            canvas = before


def histogram(shown: np.ndarray, bins: int = 4) -> np.ndarray:
    """Visible pixels by `bins` steps of each of red, green and blue."""
    seen = shown[shown[..., 3] > 0].astype(np.int64) * bins // 256
    return np.bincount((seen[:, 0] * bins + seen[:, 1]) * bins + seen[:, 2], minlength=bins**3)


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    return text + bytes(-len(text) % unit or (0 if text else unit))


FRAMES = "doc_id long, frame int, delay_cs int, disposal int, width int, height int, histogram array<long>"


def frame_columns(images: DataFrame) -> DataFrame:
    """FRAMES of (doc_id, media binary): one row for each timed frame as shown, with its colour histogram."""
    kinds = pa.schema([("doc_id", pa.int64()), *((n, pa.int32()) for n in ("frame", "delay_cs", "disposal", "width", "height")), ("histogram", pa.list_(pa.int64()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if media.is_valid:
                    size, frames = decode(media.as_py())
                    found = [(doc_id, k, f.delay, f.disposal, f.samples.shape[1], f.samples.shape[0], histogram(shown).tolist()) for k, (f, shown) in enumerate(zip(frames, compose(size, frames), strict=True))]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)

    return images.select("doc_id", "media").mapInArrow(rows, FRAMES)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros, as a GIF."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], schema=kinds)

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(rows, "doc_id long, n_bytes long, media binary")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, delay_cs long"


def describe(stored: DataFrame) -> DataFrame:
    """DIGEST of (doc_id, n_bytes, media): what the stored images hold when read back."""
    kinds = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in DIGEST.split(", ")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, n, media in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                size, frames = decode(media)
                payload = b"".join(f.samples.tobytes() for f in frames)
                counts = sum(histogram(shown) for shown in compose(size, frames))
                feature = ",".join(f"{k}:{v}" for k, v in enumerate(counts.tolist()) if v)
                found.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature, len(frames), sum(f.delay for f in frames)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds.types, strict=True)], schema=kinds)

    return stored.mapInArrow(rows, DIGEST)


def op7_gif_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(table(spark, sf_dir, "documents")))


QUERIES = {"op7_gif_columns": op7_gif_columns}
ORACLE: dict[str, str] = {}
