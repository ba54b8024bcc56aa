"""Media columns: motion-JPEG in AVI, its intra frames and its shots.

``write_avi`` stores 8-bit samples losslessly as baseline JPEG frames: a sample is the DC coefficient of a flat
8 x 8 block, quantised by 8, so that any baseline decoder gives the sample back.  The DC code lengths are chosen so
that code and magnitude bits make nine bits for every sample; the frame can be packed and unpacked as a bit matrix.

``read_avi`` parses RIFF: the stream header, the idx1 index, and the frames it points to.  ``decode_frame`` reads the luma of any
baseline JPEG frame, grey or colour, of any size and subsampling, with or without restart intervals and tables of its own; frames of flat blocks with a
fixed-width code are decoded together.  ``shots`` cuts where the histogram difference of neighbouring frames stands out from those around it.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudloom.llm import _words

#: Blocks across and down a frame; a frame holds their product of samples.
ACROSS, DOWN = 16, 12
SAMPLES = ACROSS * DOWN
FPS = 12
#: Histogram bins, neighbouring differences that set the local level, and how far above it (in deviations) a cut stands.
BINS, AROUND, DEVIATIONS = 16, 8, 2.5
#: A payload is filled up with spaces to a positive multiple of this.
UNIT = 192

# DC codes: category c (0..8) has 9 - c bits, so that code and magnitude together have nine.
_CATEGORY = np.array([0 if d == 0 else int(abs(d)).bit_length() for d in range(-255, 256)])


def _dc_codes() -> np.ndarray:
    """The canonical Huffman code of each category, shortest (category 8) first."""
    codes, code = np.zeros(9, np.int64), 0
    for length in range(1, 10):
        c = 9 - length
        codes[c] = code
        code = (code + 1) << 1
    return codes


_DC = _dc_codes()
_MAGNITUDE = np.array([d if d >= 0 else d + (1 << _CATEGORY[d + 255]) - 1 for d in range(-255, 256)])
#: Nine code bits and then the one-bit end of block, of each difference -255..255.
_TEN = ((_DC[_CATEGORY] << _CATEGORY | _MAGNITUDE) << 1).astype(np.uint16)
_DIFFERENCE = np.full(1 << 9, 1 << 14, np.int32)
_DIFFERENCE[_TEN >> 1] = np.arange(-255, 256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _frame_head() -> bytes:
    tables = _segment(0xDB, bytes([0]) + bytes([8] * 64))
    size = _segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00]) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1)))
    ac = _segment(0xC4, bytes([0x10]) + bytes([1] + [0] * 15) + bytes([0]))
    return b"\xff\xd8" + tables + size + dc + ac + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


_HEAD, _TAIL = _frame_head(), b"\xff\xd9"


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """JPEG frames of an array (frames, SAMPLES) of bytes."""
    level = samples.astype(np.int16) - 128
    step = np.diff(level, axis=1, prepend=np.int16(0))
    ten = _TEN[step + 255].reshape(len(samples), -1, 4)  # four samples are five bytes
    a, b, c, d = (ten[:, :, i] for i in range(4))
    packed = np.stack([a >> 2, a << 6 | b >> 4, b << 4 | c >> 6, c << 2 | d >> 8, d], axis=2).astype(np.uint8).reshape(len(samples), -1)
    return [_HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + _TAIL for row in packed]


def write_avi(samples: np.ndarray) -> bytes:
    """An AVI file of an array (frames, SAMPLES) of bytes."""
    frames = encode_frames(samples)
    chunks, index, at = [], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        chunks.append(struct.pack("<4sI", b"00dc", len(f)) + f + b"\0" * (len(f) % 2))
        at += len(chunks[-1])
    width, height, n = ACROSS * 8, DOWN * 8, len(frames)
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, most, 10000, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    body = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl) + chunk(b"LIST", b"movi" + b"".join(chunks)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", b"AVI " + body)


class AviError(ValueError):
    """The bytes are no AVI file with motion-JPEG frames."""


def _chunks(data: bytes, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while begin + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, begin)
        if begin + 8 + size > end:
            raise AviError(f"chunk {name!r} runs past its list")
        yield name, begin + 8, begin + 8 + size
        begin += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames per second and the frames, by the index; without one, in the order of the movi list."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise AviError("no AVI file")
    fps, movi, index = 0.0, None, None
    for name, a, b in _chunks(data, 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[a : a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for x, c, _ in _chunks(data, a + 4, b):
                if x == b"avih":
                    micros = struct.unpack_from("<I", data, c)[0]
                    fps = fps or (1e6 / micros if micros else 0.0)
                elif x == b"LIST" and data[c : c + 4] == b"strl":
                    for y, d, e in _chunks(data, c + 4, b):
                        if y == b"strh" and data[d : d + 4] == b"vids":
                            scale, rate = struct.unpack_from("<II", data, d + 20)
                            fps = rate / scale if scale else fps
        elif kind == b"movi":
            movi = (a, b)
        elif name == b"idx1":
            index = (a, b)
    if movi is None:
        raise AviError("no movi list")
    if index is None:
        return fps, [data[a:b] for name, a, b in _chunks(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")]
    frames = []
    for i in range(index[0], index[1] - 15, 16):
        name, _, at, size = struct.unpack_from("<4sIII", data, i)
        if name[2:] in (b"dc", b"db"):
            begin = movi[0] + at + 8
            if data[begin - 8 : begin - 4] != name:  # some writers count from the start of the file
                begin = at + 8
            frames.append(data[begin : begin + size])
    return fps, frames


def _parse(frame: bytes) -> tuple[dict, bytes]:
    """The tables and sizes of a baseline frame, and its entropy-coded bytes."""
    if frame[:2] != b"\xff\xd8":
        raise AviError("no JPEG frame")
    head: dict = {"q": {}, "h": dict(USUAL_TABLES)}
    at = 2
    while at + 4 <= len(frame):
        _, marker, size = struct.unpack_from(">BBH", frame, at)
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                head["q"][body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = body[1:17]
                n = sum(counts)
                head["h"][body[0]] = (tuple(counts), tuple(body[17 : 17 + n]))
                body = body[17 + n :]
        elif marker == 0xC0:
            _, head["height"], head["width"], n = struct.unpack_from(">BHHB", body)
            head["components"] = [(body[6 + 3 * i], body[7 + 3 * i], body[8 + 3 * i]) for i in range(n)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise AviError("only baseline JPEG is read")
        elif marker == 0xDD:
            head["restart"] = struct.unpack_from(">H", body)[0]
        elif marker == 0xDA:
            head["scan"] = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            end = frame.rfind(b"\xff\xd9")
            return head, frame[at : end if end > at else len(frame)]
    raise AviError("no scan")


#: Restart markers between intervals.
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


# The usual Huffman tables of baseline JPEG, codes of each length and their values: DC and AC of luma (0), of chroma (1).
_DC_VALUES = tuple(range(12))
_AC_LUMA = (
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1,
    0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39,
    0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75,
    0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7,
    0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8,
    0xD9, 0xDA, 0xE1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)
_AC_CHROMA = (
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1, 0x09,
    0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1, 0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38,
    0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74,
    0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5,
    0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6,
    0xD7, 0xD8, 0xD9, 0xDA, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
)
USUAL_TABLES = {
    0x00: ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), _DC_VALUES),
    0x10: ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), _AC_LUMA),
    0x01: ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), _DC_VALUES),
    0x11: ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), _AC_CHROMA),
}


_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COS = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _codebook(table: tuple) -> dict[tuple[int, int], int]:
    counts, values = table
    book, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            book[length, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return book


class _Bits:
    """Reads codes and numbers from entropy-coded bytes."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = 0

    def take(self, n: int) -> int:
        """The next n bits, 16 at most."""
        begin, self.at = self.at, self.at + n
        if self.at > 8 * len(self.data):
            raise AviError("too few bits")
        return int.from_bytes(self.data[begin >> 3 : (begin >> 3) + 3].ljust(3, b"\0"), "big") >> (24 - (begin & 7) - n) & (1 << n) - 1

    def symbol(self, book: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in book:
                return book[length, code]
        raise AviError("bad code")

    def value(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if n == 0 or v >> (n - 1) else v - (1 << n) + 1


def decode_frame(frame: bytes) -> np.ndarray:
    """The luma (height, width) of a baseline JPEG frame.

    Frames without Huffman tables, as cameras store them in AVI, are read with the usual ones.  A scan holds all components, or luma alone.
    """
    head, data = _parse(frame)
    books = {k: _codebook(t) for k, t in head["h"].items()}
    kinds = {c: (size >> 4, size & 15, q) for c, size, q in head["components"]}
    scan = [(c, tables, *kinds[c][:2]) for c, tables in head["scan"]]
    luma = head["components"][0][0]
    if luma not in [c for c, *_ in scan]:
        raise AviError("the first scan has no luma")
    if len(scan) == 1:
        scan = [(luma, scan[0][1], 1, 1)]
    across, down = (max(x[k] for x in scan) for k in (2, 3))
    own_across, own_down = next((x[2], x[3]) for x in scan if x[0] == luma)
    # units across and down a frame, each of all components' blocks; luma has the finest grid in every usual frame
    cols, rows = -(-head["width"] // (8 * across)), -(-head["height"] // (8 * down))
    out = np.zeros((rows * own_down * 8, cols * own_across * 8))
    q = head["q"][kinds[luma][2]]
    every = head.get("restart") or rows * cols
    parts = _RESTART.split(data)
    for unit in range(rows * cols):
        if unit % every == 0:
            if unit // every >= len(parts):
                raise AviError("an interval is missing")
            bits, last = _Bits(parts[unit // every]), {}
        for c, tables, h, v in scan:
            for block in range(h * v):
                zz = np.zeros(64)
                last[c] = zz[0] = last.get(c, 0) + bits.value(bits.symbol(books[tables >> 4]))
                k = 1
                while k < 64:
                    s = bits.symbol(books[0x10 | tables & 15])
                    if s == 0:
                        break
                    k += s >> 4
                    if k > 63:
                        raise AviError("bad run")
                    zz[k] = bits.value(s & 15)
                    k += 1
                if c == luma:
                    grid = np.zeros(64)
                    grid[_ZIGZAG] = zz * q
                    y, x = unit // cols * v + block // h, unit % cols * h + block % h
                    out[y * 8 : y * 8 + 8, x * 8 : x * 8 + 8] = _COS @ grid.reshape(8, 8) @ _COS.T
    picture = np.clip(np.rint(out + 128), 0, 255).astype(np.uint8)
    height, width = -(-head["height"] * own_down // down), -(-head["width"] * own_across // across)
    return picture[:height, :width]


def decode_frames(frames: list[bytes]) -> list[np.ndarray]:
    """Of each frame the samples: of this module's frames one for each flat block, of others the luma, whatever its size."""
    out: list[np.ndarray | None] = [None] * len(frames)
    own = [i for i, f in enumerate(frames) if f.startswith(_HEAD)]
    for i, samples in zip(own, decode_samples([frames[i] for i in own])):
        out[i] = samples
    return [decode_frame(f).ravel() if x is None else x for f, x in zip(frames, out)]


def decode_samples(frames: list[bytes]) -> np.ndarray:
    """The samples (frames, SAMPLES) of frames of flat blocks as ``encode_frames`` lays them out: one level for each 8 x 8 block.

    Frames with this module's header hold ten bits a block and are decoded together; others one by one.
    """
    out = np.zeros((len(frames), SAMPLES), np.uint8)
    fixed = [i for i, f in enumerate(frames) if f.startswith(_HEAD)]
    if fixed:
        data = b"".join([frames[i][len(_HEAD) : frames[i].rfind(_TAIL)].replace(b"\xff\x00", b"\xff") for i in fixed])
        if len(data) != len(fixed) * SAMPLES * 10 // 8:
            raise AviError("a frame has too few or too many bits")
        five = np.frombuffer(data, np.uint8).reshape(len(fixed), -1, 5).astype(np.uint16)
        a, b, c, d, e = (five[:, :, i] for i in range(5))
        ten = np.stack([a << 2 | b >> 6, (b & 63) << 4 | c >> 4, (c & 15) << 6 | d >> 2, (d & 3) << 8 | e], axis=2)
        nine = ten.reshape(len(fixed), SAMPLES) >> 1
        out[fixed] = (np.cumsum(_DIFFERENCE[nine], axis=1) + 128).astype(np.uint8)
    for i in set(range(len(frames))) - set(fixed):
        levels = decode_frame(frames[i])[::8, ::8].reshape(-1)
        if len(levels) != SAMPLES:
            raise AviError("a frame of another size")
        out[i] = levels
    return out


def shots(samples: np.ndarray | list[np.ndarray]) -> list[tuple[int, int]]:
    """(first, last + 1) frames of each shot, of one row of samples a frame; frames may differ in size.

    The difference of two neighbouring frames is half the sum of the absolute differences of their histograms, in samples of the larger one.  A cut is a difference that exceeds
    the mean of the AROUND differences on either side by DEVIATIONS of their deviations, and a sixteenth of the samples.
    """
    n = len(samples)
    if n < 2:
        return [(0, n)] if n else []
    if isinstance(samples, np.ndarray):
        at = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
        hist, size = np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS), samples.shape[1]
    else:
        size = max(map(len, samples))
        hist = np.stack([np.bincount(x >> 4, minlength=BINS) * size // max(1, len(x)) for x in samples])
    diff = np.abs(np.diff(hist, axis=0)).sum(1) // 2  # whole numbers: equal texts, equal values
    one, two = np.concatenate(([0], np.cumsum(diff))), np.concatenate(([0], np.cumsum(diff * diff)))
    lo, hi = np.maximum(0, np.arange(n - 1) - AROUND), np.minimum(n - 1, np.arange(n - 1) + AROUND + 1)
    near = np.maximum(hi - lo - 1, 1)
    mean = (one[hi] - one[lo] - diff) / near
    spread = np.sqrt(np.maximum((two[hi] - two[lo] - diff * diff) / near - mean * mean, 0))
    cuts = np.flatnonzero((diff > mean + DEVIATIONS * spread) & (diff > size // 16)) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:]))


def payload(text: bytes) -> bytes:
    """The text, filled up with spaces to a positive multiple of UNIT."""
    return text + b" " * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def with_media(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` (text) as the struct ``row``, with media (an AVI file of its text) and n_bytes.

    A null text is empty, and an empty one is stored as a frame of spaces.  Equal texts give equal files.  Rows that repeat are rows of their own, an
    empty table gives an empty one.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("t"))

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _words.to_bytes(batch.column(1))
            for g in _words.groups(texts, 64 << 20):  # far below the 2 GB of an Arrow column
                media = [write_avi(np.frombuffer(payload(t), np.uint8).reshape(-1, SAMPLES)) for t in texts[g]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(g.start, len(media)), pa.array(media, pa.binary()), pa.array(map(len, texts[g]), pa.int64())], ["row", "media", "n_bytes"])

    return rows.mapInArrow(stored, T.StructType([rows.schema["row"], *T._parse_datatype_string("media binary, n_bytes long").fields]))


_CLIP = pa.struct([("begin_s", pa.float64()), ("end_s", pa.float64()), ("first", pa.int64()), ("frames", pa.int64())])


def read_media(rows: DataFrame, column: str = "media") -> DataFrame:
    """Each row of ``rows`` as the struct ``row``, with samples (the stored bytes; of foreign files the luma of all frames), fps, clips and error.

    ``column`` holds AVI files; a clip is (begin_s, end_s, first, frames), a shot with its times.  A null file and one that can't be read give no
    samples and clips, and the reason in error.  Rows that repeat are rows of their own, an empty table gives an empty one.
    """
    packed = rows.select(F.struct("*").alias("row"), F.col(column).alias("m"))
    schema = T.StructType([packed.schema["row"], *T._parse_datatype_string("samples binary, fps double, clips array<struct<begin_s:double,end_s:double,first:long,frames:long>>, error string").fields])

    def one(data: bytes | None) -> tuple:
        try:
            if data is None:
                return None, None, None, "no file"
            fps, frames = read_avi(data)
            samples = decode_frames(frames)
        except (AviError, struct.error, ValueError, KeyError, IndexError) as e:
            return None, None, None, str(e)
        rate = fps or 1.0
        clips = [{"begin_s": a / rate, "end_s": b / rate, "first": a, "frames": b - a} for a, b in shots(samples)]
        return b"".join([x.tobytes() for x in samples]), fps, clips, None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(m) for m in batch.column(1).to_pylist()]
            kinds = (pa.binary(), pa.float64(), pa.list_(_CLIP), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds))], ["row", "samples", "fps", "clips", "error"])

    return packed.mapInArrow(read, schema)


def clips(read: DataFrame) -> DataFrame:
    """One row for each clip of ``read_media``'s result: row, clip number and its times."""
    return read.select("row", F.posexplode("clips").alias("clip", "at")).select("row", "clip", "at.*")


def media_digest(docs: DataFrame) -> DataFrame:
    """Digests of the stored and the read-back form of each text of ``docs`` (doc_id, text), both steps in one pass.

    Null and empty texts store one frame of spaces.  Rows that repeat are rows of their own.  An empty table gives an empty table.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.large_binary()).to_pylist():
                text = text or b""
                media = write_avi(np.frombuffer(payload(text), np.uint8).reshape(-1, SAMPLES))
                _, frames = read_avi(media)
                samples = decode_samples(frames)
                back = samples.tobytes()
                feature = ";".join(f"{a}-{b}" for a, b in shots(samples))
                out.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", *[x.split()[0] for x in schema.split(", ")[1:]]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digest, schema)
