"""Token ids in fixed-width bit-packed segments.

A segment is one self-describing byte string:

    magic "KBP1", then little-endian: u16 version, u16 bits per id, u32 vocabulary size,
    u32 ids per block, u64 ids, u64 documents;
    i64 document ids; u64 document starts (one more than documents); u64 block byte offsets (one
    more than blocks, from the payload's start); the payload, whose blocks start on whole bytes
    and hold each id in the same number of bits, lowest bit first.

The width is the fewest bits that hold every id of the vocabulary. Block offsets let a reader take
any range of ids without touching the rest.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, slices, texts
from .wordpieces import encoder

_HEAD = struct.Struct("<4sHHIIQQ")
_MAGIC = b"KBP1"
NO_ID = -(1 << 63)


def width_of(vocabulary_size: int) -> int:
    return max(1, (vocabulary_size - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    ids = np.ascontiguousarray(ids, "<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
    return np.packbits(bits.reshape(-1), bitorder="little").tobytes()


def unpack_bits(raw: bytes, width: int, n: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_segment(doc_ids: list[int | None], docs: list[bytes], vocabulary_size: int, block: int = 4096) -> bytes:
    """docs: each document's ids as little-endian unsigned 32-bit integers."""
    width = width_of(vocabulary_size)
    ids = np.frombuffer(b"".join(docs), "<u4")
    if len(ids) and int(ids.max()) >> width:
        raise ValueError("an id is not of the vocabulary")
    starts = np.zeros(len(docs) + 1, "<u8")
    np.cumsum([len(d) // 4 for d in docs], out=starts[1:])
    blocks = [pack_bits(ids[i : i + block], width) for i in range(0, len(ids), block)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    keys = np.array([NO_ID if d is None else d for d in doc_ids], "<i8")
    return b"".join([_HEAD.pack(_MAGIC, 1, width, vocabulary_size, block, len(ids), len(docs)), keys.tobytes(), starts.tobytes(), offsets.tobytes(), *blocks])


class Segment:
    def __init__(self, raw: bytes):
        magic, version, self.width, self.vocabulary_size, self.block, self.n_ids, n_docs = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a packed segment")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(raw, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(raw, "<u8", n_blocks + 1, at).astype(np.int64)
        self.payload = memoryview(raw)[at + 8 * (n_blocks + 1) :]
        if len(self.payload) != self.offsets[-1]:
            raise ValueError("the segment is cut short")

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids start to end; reads only the blocks that hold them."""
        end = self.n_ids if end is None else end
        if start >= end:
            return np.zeros(0, "<u4")
        first, last = start // self.block, (end - 1) // self.block
        parts = [unpack_bits(self.payload[self.offsets[b] : self.offsets[b + 1]], self.width, min(self.block, self.n_ids - b * self.block)) for b in range(first, last + 1)]
        return np.concatenate(parts)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


_SEGMENT = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary())])


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, segment_bytes: int) -> Iterator[pa.RecordBatch]:
    enc, part, seg = encoder(path), TaskContext.get().partitionId(), 0
    tail = np.asarray([end_id], "<u4").tobytes()
    keys: list = []
    docs: list[bytes] = []
    held = 0

    def segment() -> pa.RecordBatch:
        raw = write_segment(keys, docs, enc.vocabulary_size)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((part, seg, len(keys), held // 4, raw), _SEGMENT.types)], schema=_SEGMENT)

    for batch in slices(batches, "text", max_rows=512, max_bytes=1 << 20):
        for key, ids in zip(batch.column("doc_id").to_pylist(), enc.encode(texts(batch))):
            if docs and held + len(ids) > segment_bytes:
                yield segment()
                seg, keys, docs, held = seg + 1, [], [], 0
            keys.append(key)
            docs.append(ids + tail)
            held += len(ids) + 4
    if docs:
        yield segment()


_READ = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, seg, raw in zip(*(batch.column(c).to_pylist() for c in ("part", "seg", "payload"))):
            s = Segment(raw)
            data = memoryview(s.ids().tobytes())
            edges = s.starts.tolist()
            n = len(edges) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.full(n, seg, np.int32)),
                    pa.array(s.doc_ids, mask=s.doc_ids == NO_ID),
                    pa.array(s.starts[:-1]),
                    pa.array(np.diff(s.starts)),
                    pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges, edges[1:])], pa.int64()),
                ],
                schema=_READ,
            )


def write_packed(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, segment_bytes: int = 8 << 20) -> None:
    """Writes documents (doc_id, text) as segments under path, in ascending doc_id order (nulls
    first, equal ids by a hash of their text, so one id's rows may be in several ranges). A range shuffle orders
    the texts once; each task then encodes and
    packs its own range, holding one segment at a time. Null text: only the end id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    ordered.mapInArrow(partial(_pack, path=tokenizer, end_id=end_id, segment_bytes=segment_bytes), "part int, seg int, n_docs long, n_ids long, payload binary").write.parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.
    Starts come from the segments' id counts: summed by part, then within a part. There are no more
    parts than shuffle partitions, so their table is broadcast."""
    files = spark.read.parquet(path)
    heads = files.select("part", "seg", "n_ids")
    parts = heads.groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("part_start"))
    w = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    segs = heads.select("part", "seg", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).alias("seg_start"))
    rows = files.select("part", "seg", "payload").mapInArrow(_read, "part int, seg int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    rows = rows.join(F.broadcast(parts), "part").join(segs, ["part", "seg"])
    return rows.select("doc_id", (F.col("part_start") + F.col("seg_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def pack_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/packed"
    write_packed(docs, path, tokenizer, end_id)
    return read_packed(spark, path)
