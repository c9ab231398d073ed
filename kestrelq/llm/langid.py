"""Language identification by prediction by partial matching (PPM).

Each language has a byte context tree of variable order, learned once and then frozen. The
probability of a byte is that of the longest context seen in training; a byte new to a context
costs an escape (method C: distinct followers over followers plus distinct) and falls to the next
shorter context, with the bytes already ruled out excluded. Below order 0 all 256 bytes are alike.
A text's code length is the exact sum over all its bytes, and the language with the shortest code
is the prediction.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import claim, slices, texts

UNKNOWN = "und"
_WORDY = re.compile(r"[^\W\d_]")
_PAD = b"\n\n\n"
_TABLES: dict[str, list[tuple[np.ndarray, ...]]] = {}


class Model:
    """Frozen counts of grams up to four bytes, for each language. Symbols are the bytes seen in
    training, and one more for all others."""

    order = 3

    def __init__(self, samples: dict[str, list[bytes]]):
        self.key = uuid.uuid4().hex
        self.languages = sorted(samples)
        seen = sorted({10}.union(*(set(t) for ts in samples.values() for t in ts)))
        self.symbol = np.full(256, len(seen), np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.size = len(seen) + 1
        self.others = max(1, 256 - len(seen))
        self.grams = [self._count(samples[x]) for x in self.languages]

    def _count(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(_PAD + d for d in docs), np.uint8)
        real = np.ones(len(data), bool)
        at = 0
        for d in docs:
            real[at : at + 3] = False
            at += 3 + len(d)
        s = self.symbol[data].astype(np.int64)
        n = self.size
        gram = ((s[:-3] * n + s[1:-2]) * n + s[2:-1]) * n + s[3:] if len(s) > 3 else np.zeros(0, np.int64)
        return np.unique(gram[real[3:]], return_counts=True)

    def _extend(self, lower: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Probabilities at an order from its counts (contexts, symbols) and those of the order below."""
        total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        rest = np.where(counts > 0, 0.0, lower)
        left = rest.sum(1, keepdims=True)
        closed = left <= 0
        seen = counts / np.maximum(1, np.where(closed, total, total + kinds))
        escape = kinds / np.maximum(1, total + kinds)
        p = np.where(counts > 0, seen, escape * rest / np.where(closed, 1, left))
        return np.where(total > 0, p, lower)

    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each language: the block of the nearer two symbols, the row of a block and the third symbol, and bits by
        row and symbol. Only contexts that training has seen have rows of their own, so memory follows the sample."""
        if self.key not in _TABLES:
            _TABLES.clear()
            claim("langid", _TABLES.clear)
            _TABLES[self.key] = [self._table(*g) for g in self.grams]
        return _TABLES[self.key]

    def _table(self, gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = self.size
        p = np.full((1, n), 1 / 256)
        p[0, -1] = self.others / 256
        p /= p.sum()
        for k in range(2):
            width = n ** (k + 1)
            flat = np.bincount(gram % width, count, width).reshape(-1, n)
            p = self._extend(np.tile(p, (len(flat) // len(p), 1)), flat)
        rows = [p]  # of order 1, for every symbol; then of orders 2 and 3, for contexts that training has seen
        two, at = np.unique(gram // n % (n * n), return_inverse=True)
        seen = np.zeros((len(two), n))
        np.add.at(seen, (at, gram % n), count)
        rows.append(self._extend(p[two % n], seen))
        three, where = np.unique(gram // n, return_inverse=True)
        seen = np.zeros((len(three), n))
        seen[where, gram % n] = count
        pair = np.searchsorted(two, three % (n * n))
        rows.append(self._extend(rows[1][pair], seen))
        # block of the nearer two symbols: one for each nearest symbol where the pair is new, then one for each pair seen
        block = np.tile(np.arange(n, dtype=np.int32), n)
        block[two] = n + np.arange(len(two), dtype=np.int32)
        # row of (block, third symbol): the longest context that training has seen
        row = np.repeat(np.arange(n + len(two), dtype=np.int32), n)
        row[(n + pair) * n + three // (n * n)] = n + len(two) + np.arange(len(three), dtype=np.int32)
        bits = -np.log2(np.maximum(np.concatenate(rows), 1e-30))
        bits[:, -1] += np.log2(self.others)
        return block * n, row * n, bits.astype(np.float32).reshape(-1)

    def code_lengths(self, docs: list[bytes]) -> np.ndarray:
        """Bits of each document (rows) under each language."""
        out = np.zeros((len(docs), len(self.languages)))
        full = [i for i, d in enumerate(docs) if d]
        if not full or not self.languages:
            return out
        s = self.symbol[np.frombuffer(b"".join([_PAD + docs[i] for i in full]), np.uint8)]
        n = self.size
        near, third, last = s[1:-2] * n + s[2:-1], s[:-3], s[3:]
        starts = np.cumsum([0, *(3 + len(docs[i]) for i in full)])[:-1]
        ends = starts + [len(docs[i]) for i in full]
        edges = np.stack([starts, np.minimum(ends, len(last))], 1).reshape(-1)
        if edges[-1] == len(last):
            edges = edges[:-1]
        for k, (block, row, bits) in enumerate(self.tables()):
            cost = bits[row[block[near] + third] + last]
            out[full, k] = np.add.reduceat(cost, edges, dtype=np.float64)[::2]
        return out


def sample(docs: DataFrame, per_language: int, max_bytes: int, most_bytes: int = 1 << 20, salt: int = 17, max_languages: int = 500) -> dict[str, list[bytes]]:
    """At most per_language texts and about most_bytes of each language, drawn evenly by a hash of id and text; of a
    text longer than max_bytes a window of that size at a drawn place, without characters cut in two. Null and
    empty texts take no part. What reaches the driver is bounded by max_languages x (most_bytes + max_bytes). The
    rate for each language comes from its count, so about four times as many rows as wanted meet for ranking,
    however many the table has. More than max_languages labels are an error."""
    docs = docs.where("lang is not null and octet_length(text) > 0")
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError("more languages than max_languages")
    if not counts:
        return {}
    rate = F.create_map(*chain.from_iterable((F.lit(r.lang), F.lit(min(1.0, 4.0 * per_language / r._n))) for r in counts))
    # rows that share or lack an id are told apart by size and a stretch of their text
    draw = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 64), F.lit(salt)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    raw = F.col("text").cast("binary")
    start = F.floor(F.greatest(F.octet_length("text") - max_bytes, F.lit(0)) * F.pmod(F.xxhash64("doc_id", F.lit(salt + 1)), F.lit(1 << 20)) / F.lit(1 << 20)).cast("int")
    piece = F.substring(raw, start + 1, F.lit(max_bytes)).alias("text")
    picked = docs.withColumn("_u", draw).where(F.col("_u") <= F.element_at(rate, F.col("lang"))).select("lang", piece, "_u", "doc_id")
    order = Window.partitionBy("lang").orderBy("_u", "doc_id", "text")
    first = picked.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language)
    before = F.sum(F.length("text")).over(Window.partitionBy("lang").orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)) - F.length("text")
    out: dict[str, list[bytes]] = {}
    for r in first.withColumn("_before", before).where(F.col("_before") < most_bytes).select("lang", "text").collect():
        out.setdefault(r.lang, []).append(bytes(r.text).decode(errors="ignore").encode())
    return out


def train(docs: DataFrame, per_language: int = 250, max_bytes: int = 1 << 15) -> Model:
    """docs: doc_id, text, lang; rows without either of the last two teach nothing."""
    return Model(sample(docs.select("doc_id", "text", "lang"), per_language, max_bytes))


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _WORDY.finditer(text))


def _predict(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    names = [*m.languages, UNKNOWN]
    for batch in slices(batches, "text", max_bytes=1 << 20):
        found = texts(batch)
        raw = [t.encode() for t in found]
        bits = m.code_lengths(raw)
        lettered = np.array([bool(m.languages) and has_letter(t) for t in found], bool)
        if m.languages:
            best = bits.argmin(1)  # ties: the first by name
            score = 1 / np.exp2(bits.min(1, keepdims=True) - bits).sum(1)
            per_byte = bits.min(1) / np.maximum(1, [len(r) for r in raw])
        else:
            best, score, per_byte = np.zeros(len(found), int), np.zeros(len(found)), np.zeros(len(found))
        best, score = np.where(lettered, best, len(names) - 1), np.where(lettered, score, 0.0)
        extra = {"lang_pred": pa.array([names[i] for i in best]), "score": pa.array(score, pa.float64()), "bits_per_byte": pa.array(per_byte, pa.float64())}
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *extra.values()], names=["doc_id", *extra])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of every whole text, from the text alone. score: the
    posterior of the prediction under equal priors. Null texts and texts without a letter: `und`, 0.
    Rows stay one for one; one pass without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_predict, model=shared), "doc_id long, lang_pred string, score double, bits_per_byte double")


def _keep(batches: Iterator[pa.RecordBatch], model, max_bits: float) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", max_bytes=1 << 20):
        only = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column("text")], names=["doc_id", "text"])
        known: list[bool] = []
        for out in _predict(iter([only]), model):
            known += [x != UNKNOWN and b <= max_bits for x, b in zip(out.column("lang_pred").to_pylist(), out.column("bits_per_byte").to_pylist())]
        yield batch.filter(pa.array(known, pa.bool_()))


def identified(docs: DataFrame, model: Model, max_bits: float = 6.0) -> DataFrame:
    """The documents in a known language, all columns as they were. Rejected: `und`, and texts that cost
    more than max_bits for each byte in every language (noise, or a language never learned)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_keep, model=shared, max_bits=max_bits), docs.schema)
