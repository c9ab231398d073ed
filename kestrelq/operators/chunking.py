"""Splitting documents into chunks at natural ends."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"\n|[.?!] ")
_WORD_REST, _BLANKS = re.compile(r"\S*"), re.compile(r"\s*")


def chunk_spans(text: str, size: int = 900, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of chunks that tile the text. A chunk ends after a blank line in its last 30 %, else after a
    sentence or line there, else after its last white space, else at `size`. The next one begins `overlap`
    characters earlier, moved on to a word's start."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be at least 1, and overlap from 0 up to below it")
    spans: list[tuple[int, int]] = []
    start, total = 0, len(text)
    while start < total:
        limit = start + size
        if limit >= total:
            spans.append((start, total))
            break
        tail = limit - size * 30 // 100
        blank = text.rfind("\n\n", tail, limit)
        sentences = [m.end() for m in _SENTENCE.finditer(text, tail, limit)] if blank < 0 else [blank + 2]
        if sentences:
            end = sentences[-1]
        else:
            words = text[start + 1 : limit]
            kept = len(words) - len(re.split(r"\s", words)[-1])
            end = start + 1 + kept if kept else limit
        spans.append((start, end))
        start = _resume(text, start, end, overlap) if overlap else end
    return spans


def _resume(text: str, start: int, end: int, overlap: int) -> int:
    at = max(end - overlap, start + 1)
    if not text[at - 1].isspace():
        at = _WORD_REST.match(text, at, end).end()
    return _BLANKS.match(text, at, end).end()


def _chunks(batches: Iterator[pa.RecordBatch], size: int, overlap: int, heading: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for seq, (a, b) in enumerate(chunk_spans(text, size, overlap) if text else ()):
                rows.append((key, seq, (heading + "\n\n" if heading else "") + text[a:b], a, b - a))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["id", "seq", "chunk", "start", "length"])


def chunk_text(docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = 900, overlap: int = 0, heading: str | None = None) -> DataFrame:
    """id, seq, chunk, start, length; null texts have no chunks."""
    chunk_spans("", size, overlap)
    rows = docs.select(F.col(id_).cast("long"), F.col(text).cast("string"))
    return rows.mapInArrow(partial(_chunks, size=size, overlap=overlap, heading=heading), "id long, seq int, chunk string, start int, length int")
