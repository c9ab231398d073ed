"""Byte-level BPE: whole texts to ids and back.

Text splits by the vocabulary's pattern; a piece is one merge problem. Short pieces are leaves,
merged directly. A longer piece is a tree: its halves are encoded on their own and concatenated.
A concatenation is exact when the two tokens at the join, merged together, stay apart; otherwise
windows around the join are encoded anew, growing until both window edges stay apart too. That test
on neighbours is enough: a token sequence is the encoding of its bytes if each neighbouring pair is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
from collections.abc import Iterator
from concurrent.futures import Executor, ThreadPoolExecutor
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, same_plan, slices, texts

#: The pattern of this vocabulary family, a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How files of this family prepare, split and merge text; fixed values.
PLAN = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t\n\x0b\f\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ODD = ("  ", "\n ", " \n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_LONG = 64

_CODERS: dict[tuple[str, int], Coder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def coder(path: str, leaf: int = 32) -> Coder:
    """One for each process, vocabulary and leaf size."""
    if (path, leaf) not in _CODERS:
        _CODERS[path, leaf] = Coder(path, leaf)
    claim("bpe", _CODERS.clear)
    return _CODERS[path, leaf]


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: printable Latin-1 bytes
    stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    def __init__(self, path: str, leaf: int = 32, cache_entries: int = 400_000, threads: int = 2, side_by_side: int = 1 << 16):
        """Pieces of side_by_side characters or more have their halves encoded by this many threads."""
        import regex

        self.threads, self.side_by_side = threads, side_by_side

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not same_plan(spec, PLAN):
            raise ValueError(f"{path} does not split or merge text in the way that this encoder knows")
        letters = byte_letters()
        vocab = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.single = [vocab[bytes([b])] for b in range(256)]
        get = {t: i for t, i in spec["model"]["vocab"].items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges[get[a], get[b]] = (rank, get[a + b])
        self.merge = self._native_merge(vocab) or self._merge
        self.one = {i: i for i in self.bytes_of}  # one int object for each id, however often it is cached
        self.pattern = regex.compile(PATTERN)
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.leaf = max(2, leaf)
        self.cache_entries = cache_entries
        self.chunks: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.apart_cache: dict[tuple[int, int], bool] = {}

    # merging

    def _native_merge(self, vocab: dict[bytes, int]):
        """The same merging by compiled code, where ids rise with merge ranks, as rank files assume."""
        made = [m[1] for m in sorted(self.merges.values())]
        if made != sorted(made) or max(self.single) > min(made, default=1 << 31):
            return None
        try:
            import tiktoken
        except ImportError:
            return None
        native = tiktoken.Encoding("leaf", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        return native._core_bpe.encode_single_piece

    def _merge(self, data: bytes) -> list[int]:
        """Applies the lowest-ranked merge, leftmost first, until none applies."""
        ids = [self.single[b] for b in data]
        merges = self.merges
        while len(ids) > 1:
            best = None
            for pair in zip(ids, ids[1:]):
                found = merges.get(pair)
                if found and (best is None or found < best):
                    best, at = found, pair
            if best is None:
                break
            out, i, n, made = [], 0, len(ids), best[1]
            a, b = at
            while i < n:
                if ids[i] == a and i + 1 < n and ids[i + 1] == b:
                    out.append(made)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def apart(self, a: int, b: int) -> bool:
        """Whether the bytes of two neighbouring tokens, encoded together, give just these two."""
        key = (a, b)
        if key not in self.apart_cache:
            if len(self.apart_cache) > self.cache_entries:
                self.apart_cache = {}
            self.apart_cache[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.apart_cache[key]

    def tree(self, data: bytes, pool: Executor | None = None) -> list[int]:
        """pool: the data is cut in two, four, eight, ... parts, as long as each has 512 leaves, whose trees are encoded
        side by side and joined in pairs."""
        if pool:
            cuts = 1
            while len(data) // (2 * cuts) >= 512 * self.leaf and cuts < 64:
                cuts *= 2
            size = -(-len(data) // cuts)
            parts = list(pool.map(self.tree, [data[i : i + size] for i in range(0, len(data), size)]))
            while len(parts) > 1:
                pairs = list(zip(parts[::2], parts[1::2]))
                parts = [*pool.map(lambda p: self.join(*p), pairs), *parts[len(pairs) * 2 :]]
            return parts[0]
        if len(data) <= self.leaf:
            return self.merge(data)
        # levels from the leaves up, so depth never meets the interpreter's stack limit
        step = self.leaf
        leaves = [data[i : i + step] for i in range(0, len(data), step)]
        parts = list(map(self.merge, leaves))
        while len(parts) > 1:
            pairs = list(zip(parts[::2], parts[1::2]))
            rest = parts[len(pairs) * 2 :]
            parts = [*(self.join(*p) for p in pairs), *rest]
        return parts[0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.apart(left[-1], right[0]):
            return left + right
        window = 1
        while True:
            a, b = max(0, len(left) - window), min(len(right), window)
            raw = b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b]))
            # a window that spans everything is the whole problem
            mid = self.merge(raw)
            if (a == 0 or self.apart(left[a - 1], mid[0])) and (b == len(right) or self.apart(mid[-1], right[b])):
                return left[:a] + mid + right[b:]
            window *= 2

    # texts

    def piece(self, text: str) -> tuple[int, ...]:
        if len(text) >= self.side_by_side:
            with ThreadPoolExecutor(self.threads) as pool:
                return tuple(self.tree(text.encode(), pool))
        if len(text) > _LONG:
            return tuple(self.tree(text.encode()))
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= self.cache_entries:
                self.pieces.clear()
            found = self.pieces[text] = tuple(map(self.one.__getitem__, self.tree(text.encode())))
        return found

    def chunk(self, text: str) -> tuple[int, ...]:
        found = self.chunks.get(text)
        if found is None:
            found = tuple(chain.from_iterable(map(self.piece, _LATIN.findall(text))))
            if len(text) <= _LONG:
                if len(self.chunks) >= self.cache_entries:
                    self.chunks.clear()
                self.chunks[text] = found
        return found

    def _latin(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _span(self, text: str) -> list[int]:
        """Ids of text without special tokens. Single spaces between chunks start pieces, so chunks
        that begin with one are encoded by themselves; other white space needs the full pattern."""
        if not self._latin(text):
            return list(chain.from_iterable(map(self.piece, self.pattern.findall(text))))
        if any(s in text for s in _ODD):
            return list(chain.from_iterable(map(self.piece, _LATIN.findall(text))))
        parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else [x if i == 0 else " " + x for i, x in enumerate(text.split(" "))]
        found = map(self.chunks.get, parts)
        return list(chain.from_iterable([self.chunk(c) if f is None else f for f, c in zip(found, parts)]))

    def encode(self, text: str) -> list[int]:
        if self.special_split and any(s in text for s in self.special):
            parts = self.special_split.split(text)
            return list(chain.from_iterable([self.special[p]] if i % 2 else self._span(p) for i, p in enumerate(parts) if p))
        return self._span(text) if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def rank_file(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _round_trip(batches: Iterator[pa.RecordBatch], tokenizer: str, leaf: int) -> Iterator[pa.RecordBatch]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    c = coder(tokenizer, leaf)
    for batch in slices(batches, "text", max_rows=1024, max_bytes=4 << 20):
        n, ids_hash, text_hash = [], [], []
        for text in texts(batch):
            ids = c.encode(text)
            n.append(len(ids))
            ids_hash.append(hashlib.sha256(",".join(map(c.text_of.__getitem__, ids)).encode()).hexdigest())
            text_hash.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _encode(batches: Iterator[pa.RecordBatch], tokenizer: str, leaf: int) -> Iterator[pa.RecordBatch]:
    c = coder(tokenizer, leaf)
    for batch in slices(batches, "text", max_rows=1024, max_bytes=4 << 20):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.encode(t) for t in texts(batch)], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], tokenizer: str, leaf: int) -> Iterator[pa.RecordBatch]:
    c = coder(tokenizer, leaf)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()])], names=["doc_id", "text"])


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def encode(docs: DataFrame, tokenizer: str, leaf: int = 32) -> DataFrame:
    """doc_id, ids. Null text counts as empty and has no ids; rows stay one for one."""
    return _input(docs).mapInArrow(partial(_encode, tokenizer=tokenizer, leaf=leaf), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, leaf: int = 32) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); bytes that are not UTF-8 become replacement characters."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, tokenizer=tokenizer, leaf=leaf), "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer: str, leaf: int = 32) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass, without moving any text."""
    return _input(docs).mapInArrow(partial(_round_trip, tokenizer=tokenizer, leaf=leaf), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
