"""AVI files with motion-JPEG video as column values.

A payload of whole 64-byte units is stored without loss: each unit is one 8x8 block and each byte
one quantised coefficient of it (the format's own unit), in scan order. The Huffman tables give a
coefficient of s bits a code of 9 - s bits (differences of the first: 10 - s), so every block takes
the same number of bits and whole frames pack and unpack by array operations; the streams stay
baseline JPEG. Reading parses the RIFF tree and its index, decodes the intra frames, and cuts clips
where the histogram difference of neighbouring frames stands out from those before it. A text of any
length up to RIFF's 4 GB takes memory for itself, its file and some frames.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

UNIT = 64
FRAME_BLOCKS = 64
FPS = 25
GROUP = 64  # frames encoded or decoded at a time


def zigzag() -> np.ndarray:
    """Row-major place of each coefficient in scan order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


_ZIGZAG = zigzag()


def _magnitude(v: int) -> tuple[int, int]:
    s = abs(v).bit_length()
    return s, v if v > 0 else v + (1 << s) - 1


def _field(v: int, width: int, top: int) -> int:
    """Code and extra bits of a value: size s has the code of top - s ones and a zero."""
    s, extra = _magnitude(v)
    code = (1 << (top - s + 1)) - 2
    return code << s | extra if s else code


#: Coefficients are never zero: bytes below 128 are -128 to -1, the others 1 to 128.
_VALUE = np.array([b - 128 if b < 128 else b - 127 for b in range(256)], np.int32)
_AC = np.array([_field(int(v), 9, 8) for v in _VALUE])
_DC = np.array([_field(d, 10, 9) for d in range(-256, 257)])


def _bits(fields: np.ndarray, width: int) -> np.ndarray:
    return (fields[:, None] >> np.arange(width - 1, -1, -1) & 1).astype(np.uint8)


_AC_BITS, _DC_BITS = _bits(_AC, 9), _bits(_DC, 10)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=256)
def _jpeg_head(width: int, height: int) -> bytes:
    dqt = _segment(0xDB, b"\0" + b"\1" * 64)
    sof = _segment(0xC0, struct.pack(">BHHB", 8, height, width, 1) + b"\1\x11\0")
    dc = _segment(0xC4, b"\x00" + bytes([1] * 10 + [0] * 6) + bytes(range(9, -1, -1)))
    ac = _segment(0xC4, b"\x10" + bytes([1] * 8 + [0] * 8) + bytes(range(8, 0, -1)))
    sos = _segment(0xDA, b"\1\1\0\0\x3f\0")
    return b"\xff\xd8" + dqt + sof + dc + ac + sos


def encode_frames(blocks: np.ndarray, width: int, height: int) -> list[bytes]:
    """blocks: bytes of (frames, blocks of a frame, 64)."""
    frames, n, _ = blocks.shape
    first = _VALUE[blocks[:, :, 0]]
    diff = np.diff(first, axis=1, prepend=0)
    bits = np.empty((frames, n, 10 + 63 * 9), np.uint8)
    bits[:, :, :10] = _DC_BITS[diff + 256]
    bits[:, :, 10:] = _AC_BITS[blocks[:, :, 1:]].reshape(frames, n, -1)
    bits = bits.reshape(frames, -1)
    if bits.shape[1] % 8:
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)), constant_values=1)
    head = _jpeg_head(width, height)
    return [head + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in np.packbits(bits, axis=1)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(payload: bytes, fps: int = FPS) -> bytes:
    """payload: a positive multiple of 64 bytes. Short payloads are one frame of a row of blocks; longer
    ones fill square frames, the last padded with zero bytes. A comment chunk holds the length."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    per = min(len(units), FRAME_BLOCKS)
    width, height = (64, 64) if per == FRAME_BLOCKS else (8 * per, 8)
    frames = -(-len(units) // per)
    coded = []
    for f in range(0, frames, GROUP):
        part = units[f * per : min(frames, f + GROUP) * per]
        if len(part) % per:
            part = np.concatenate([part, np.zeros((-len(part) % per, UNIT), np.uint8)])
        coded += encode_frames(part.reshape(-1, per, UNIT), width, height)
    most = max(map(len, coded))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, frames, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, frames, most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    info = _list(b"INFO", _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    chunks, index, at = [], [], 4
    for c in coded:
        chunks.append(_chunk(b"00dc", c))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(c)))
        at += len(chunks[-1])
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _list(b"movi", *chunks) + _chunk(b"idx1", b"".join(index)))


def riff(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the chunks in a span; a list's name is its kind and its span its inside."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        name, size = bytes(data[start : start + 4]), struct.unpack_from("<I", data, start + 4)[0]
        a, b = start + 8, start + 8 + size
        if b > end:
            raise ValueError("a chunk runs over its end")
        if name in (b"RIFF", b"LIST"):
            yield bytes(data[a : a + 4]), a + 4, b
        else:
            yield name, a, b
        start = b + (size & 1)


class Avi:
    """Frames by the file's index, or in file order where it has none."""

    def __init__(self, raw: bytes):
        data = memoryview(raw)
        kind, a, b = next(riff(data), (b"", 0, 0))
        if kind != b"AVI ":
            raise ValueError("not an AVI file")
        self.payload_bytes: int | None = None
        self.width = self.height = 0
        self.frame_us = 1_000_000 // FPS
        movi, index = None, None
        for name, x, y in riff(data, a, b):
            if name == b"hdrl":
                for inner, p, _ in riff(data, x, y):
                    if inner == b"avih":
                        self.frame_us = struct.unpack_from("<I", data, p)[0] or self.frame_us
                        self.width, self.height = struct.unpack_from("<II", data, p + 32)
            elif name == b"INFO":
                for inner, p, q in riff(data, x, y):
                    text = bytes(data[p:q]).rstrip(b"\0")
                    if inner == b"ICMT" and text.startswith(b"payload="):
                        self.payload_bytes = int(text[8:])
            elif name == b"movi":
                movi = (x, y)
            elif name == b"idx1":
                index = (x, y)
        if movi is None:
            raise ValueError("no frames")
        if index:
            entries = struct.iter_unpack("<4sIII", data[index[0] : index[0] + (index[1] - index[0]) // 16 * 16])
            base = movi[0] - 4
            found = [(base + at, n) for name, _, at, n in entries if name[2:] in (b"dc", b"db")]
            if found and found[0][0] + 8 > len(raw):  # offsets from the file's start
                found = [(at - base, n) for at, n in found]
            self.frames = [data[at + 8 : at + 8 + n] for at, n in found]
        else:
            self.frames = [data[p:q] for name, p, q in riff(data, *movi) if name[2:] in (b"dc", b"db")]


class _Tables:
    """Huffman tables of a frame: codes by (length, code), and where the rate is fixed, a flat table."""

    def __init__(self, body: bytes):
        counts, symbols = body[:16], body[16:]
        self.codes: dict[tuple[int, int], int] = {}
        code = at = 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                self.codes[length, code] = symbols[at]
                code, at = code + 1, at + 1
            code <<= 1
        widths = {length + s for (length, _), s in self.codes.items()}
        self.width = widths.pop() if len(widths) == 1 and all(s < 16 for s in self.codes.values()) else 0
        if self.width:
            self.flat = np.zeros(1 << self.width, np.int32)
            for (length, c), s in self.codes.items():
                x = np.arange(1 << s)
                self.flat[(c << s) + x] = np.where(x >= (1 << s >> 1), x, x - (1 << s) + 1) if s else 0


@lru_cache(maxsize=64)
def _table(body: bytes) -> _Tables:
    return _Tables(body)


def _fields(bits: np.ndarray, width: int) -> np.ndarray:
    """Numbers of `width` bits along the last axis."""
    wide = np.zeros((*bits.shape[:-1], 16), np.uint8)
    wide[..., 16 - width :] = bits
    return np.packbits(wide, axis=-1).view(">u2")[..., 0]


#: The tables of frames without any of their own, as motion-JPEG files leave them out (ISO 10918-1, annex K; fixed
#: values): numbers of codes by length, and symbols in order, of which the last ones ascend.
_DC_LENGTHS = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0))
_AC_LENGTHS = ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119))
_AC_FIRST = (
    "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a",
    "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1",
)


@lru_cache(maxsize=1)
def default_tables() -> dict[int, _Tables]:
    """By class and number, as frames name them: luma's are 0, colours' are 1."""
    out = {}
    every = [run << 4 | size for run in range(16) for size in range(1, 11)]
    for i in range(2):
        first = [int(x, 16) for x in _AC_FIRST[i].split()]
        out[i] = _table(bytes(_DC_LENGTHS[i]) + bytes(range(12)))
        out[0x10 | i] = _table(bytes(_AC_LENGTHS[i]) + bytes([*first, *(x for x in every if x not in first)]))
    return out


def decode_coefficients(jpeg: bytes) -> tuple[np.ndarray, int, int, np.ndarray]:
    """Quantised coefficients (blocks, 64) in scan order, width, height, quantiser, of a baseline frame's first
    component, which is luma: grey frames, and colour frames of any sampling in one scan, whose blocks come unit by
    unit. Restart markers and missing tables are allowed."""
    at, tables, quant, width, height, restart = 2, dict(default_tables()), {}, 0, 0, 0
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    parts: list[tuple[int, int, int, int]] = []  # id, blocks across and down, quantiser
    while True:
        if at + 4 > len(jpeg) or jpeg[at] != 0xFF:
            raise ValueError("a frame's header ends early")
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = _table(body[1:n])
                body = body[n:]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            height, width = struct.unpack_from(">HH", body, 1)
            parts = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDA:
            break
    if not parts or not width or not height or any(not 1 <= x <= 4 for _, h, v, _ in parts for x in (h, v)):
        raise ValueError("a frame without a size")
    if body[0] != len(parts):
        raise ValueError("only frames of one scan are read")
    named = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    use = [(tables[named[p[0]] >> 4], tables[0x10 | named[p[0]] & 15]) for p in parts]
    if len(parts) == 1:
        parts = [(parts[0][0], 1, 1, parts[0][3])]  # one component is never in units
    across, down = (-(-size // (8 * max(p[k] for p in parts))) for size, k in ((width, 1), (height, 2)))
    units = across * down
    order = [i for i, (_, h, v, _) in enumerate(parts) for _ in range(h * v)]
    end = jpeg.rindex(b"\xff\xd9")
    data = jpeg[at:end]
    dc, ac = use[0]
    if len(parts) == 1 and not restart and dc.width and ac.width:
        block = dc.width + 63 * ac.width
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))[: units * block]
        if len(bits) < units * block:
            raise ValueError("a frame ends early")
        bits = bits.reshape(units, block)
        out = np.zeros((units, 64), np.int32)
        out[:, 0] = np.cumsum(dc.flat[_fields(bits[:, : dc.width], dc.width)])
        out[:, 1:] = ac.flat[_fields(bits[:, dc.width :].reshape(units, 63, ac.width), ac.width)]
        return out, width, height, quant[parts[0][3]]
    out = np.zeros((units * len(order), 64), np.int32)
    stretches = re.split(rb"\xff[\xd0-\xd7]", data) if restart else [data]
    step = restart or units
    if len(stretches) < -(-units // step):
        raise ValueError("a frame ends early")
    for k, stretch in enumerate(stretches[: -(-units // step)]):
        bits = np.unpackbits(np.frombuffer(stretch.replace(b"\xff\0", b"\xff"), np.uint8)).tolist()
        rows = out[k * step * len(order) : (k + 1) * step * len(order)]
        _decode_serial(bits, use, order, rows)
    own = np.tile(np.array(order) == 0, units)
    return out[own], width, height, quant[parts[0][3]]


def _decode_serial(bits: list[int], use: list[tuple[_Tables, _Tables]], order: list[int], out: np.ndarray) -> None:
    """Any Huffman tables, symbol by symbol. order: the component of each block of a unit."""
    at = 0

    def symbol(codes: dict[tuple[int, int], int]) -> int:
        nonlocal at
        code = 0
        for length in range(1, 17):
            if at >= len(bits):
                raise ValueError("a frame ends early")
            code = code << 1 | bits[at]
            at += 1
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("no such code")

    def extra(s: int) -> int:
        nonlocal at
        x = 0
        for b in bits[at : at + s]:
            x = x << 1 | b
        at += s
        return x if not s or x >= 1 << s - 1 else x - (1 << s) + 1

    last = [0] * len(use)
    for i, block in enumerate(out):
        which = order[i % len(order)]
        dc, ac = use[which]
        last[which] += extra(symbol(dc.codes))
        block[0] = last[which]
        k = 1
        while k < 64:
            s = symbol(ac.codes)
            if s == 0:
                break
            k += s >> 4
            if s & 15:
                if k > 63:
                    raise ValueError("a block runs over its end")
                block[k] = extra(s & 15)
            k += 1


_COS = np.rint((1 << 11) * np.array([[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)]))


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """8-bit samples (blocks, 64). Whole numbers throughout, exact in double precision, so a frame's
    samples don't depend on what is computed beside it."""
    grid = np.zeros((len(coefficients), 64))
    grid[:, _ZIGZAG] = coefficients * quant
    rows = (grid.reshape(-1, 8) @ _COS.T).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 8)
    out = np.floor((rows @ _COS.T + (1 << 21)) / (1 << 22)).reshape(-1, 8, 8).transpose(0, 2, 1)
    return np.clip(out + 128, 0, 255).astype(np.uint8).reshape(-1, 64)


def shots(histograms: np.ndarray, window: int = 12, sigmas: float = 3.0, floor: float = 0.1) -> tuple[list[int], np.ndarray]:
    """First frames of the clips, and the differences of neighbours (halved sum of shares). A cut stands
    `sigmas` deviations above the mean of up to `window` differences since the last cut, and above `floor`."""
    share = histograms / np.maximum(1, histograms.sum(1, keepdims=True))
    diff = np.abs(np.diff(share, axis=0)).sum(1) / 2
    starts = [0] if len(histograms) else []
    for f in range(1, len(histograms)):
        past = diff[max(starts[-1], f - 1 - window) : f - 1]
        limit = max(floor, past.mean() + sigmas * past.std()) if len(past) else max(floor, 0.5)
        if diff[f - 1] > limit:
            starts.append(f)
    return starts, diff


class Decoded:
    """A stored file read back, some frames at a time: the payload, frame histograms and clips."""

    def __init__(self, raw: bytes):
        avi = Avi(raw)
        payload, histograms, self.luma = bytearray(), [np.zeros((0, 16), np.int64)], []
        for a in range(0, len(avi.frames), GROUP):
            coefficients, quants = [], []
            for f in avi.frames[a : a + GROUP]:
                c, _, _, q = decode_coefficients(bytes(f))
                coefficients.append(c)
                quants.append(q)
            every, counts = np.concatenate(coefficients), [len(c) for c in coefficients]
            payload += (every + (every < 0) + 127).astype(np.uint8).tobytes()
            samples = pixels(every, np.repeat(np.array(quants).reshape(-1, 64), counts, axis=0))
            owner = np.repeat(np.arange(len(counts)), counts)[:, None]
            histograms.append(np.bincount((owner * 16 + (samples >> 4)).reshape(-1), minlength=16 * len(counts)).reshape(-1, 16))
            self.luma += [int(s.sum()) // max(1, s.size) for s in np.split(samples, np.cumsum(counts)[:-1])]
        self.payload = bytes(payload[: avi.payload_bytes])
        self.histograms = np.concatenate(histograms)
        self.starts, self.differences = shots(self.histograms)
        self.frame_us = avi.frame_us
        self.frames = len(avi.frames)

    def clips(self) -> list[tuple[int, int, int, int, int]]:
        """(clip, first frame, frames, start and end in milliseconds)."""
        edges = [*self.starts, self.frames]
        return [(i, a, b - a, a * self.frame_us // 1000, b * self.frame_us // 1000) for i, (a, b) in enumerate(zip(edges, edges[1:]))]

    def feature(self) -> str:
        cuts = "|".join(map(str, self.starts[1:]))
        clips = zlib.crc32(repr(self.clips()).encode())
        return f"frames={self.frames};clips={len(self.starts)};cuts={cuts};luma={sum(self.luma) // max(1, self.frames)};hist={zlib.crc32(self.histograms.astype('<i8').tobytes())};timed={clips}"


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", max_rows=512, max_bytes=4 << 20):
        media = [write_avi(payload_of(t)[0]) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], names=["doc_id", "media"])


_CLIPS = "doc_id long, clip long, first_frame long, n_frames long, start_ms long, end_ms long, error string"
#: What a file that isn't as it should be raises on the way.
_BROKEN = (ValueError, KeyError, IndexError, struct.error, OverflowError)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media", max_rows=64):
        rows: list[tuple] = []
        for key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist()):
            if raw is None:
                continue
            try:
                rows += [(key, *clip, None) for clip in Decoded(raw).clips()]
            except _BROKEN as e:
                rows.append((key, None, None, None, None, None, str(e) or type(e).__name__))
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _CLIPS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split()[0] for x in _CLIPS.split(", ")])


_DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clips long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    for batch in slices(batches, "text", max_rows=512, max_bytes=4 << 20):
        rows = []
        for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
            payload, n = payload_of(text)
            media = write_avi(payload)
            back = Decoded(media)
            p = back.payload
            rows.append((key, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media), hashlib.sha256(media).hexdigest(), back.feature(), len(back.starts)))
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an AVI file in a column; null text counts as empty."""
    return _input(docs).mapInArrow(_store, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """One timed row for each clip of the files in column media (doc_id, media); null media has none. A file that
    can't be read has one row, with its error in place of clips. Luma alone decides about clips."""
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_clips, _CLIPS)


def digest(docs: DataFrame) -> DataFrame:
    """Stores each text as a media value, reads the value back and computes its digests and features, in
    one pass: the files stay in the batch that made them."""
    return _input(docs).mapInArrow(_digest, _DIGEST)


