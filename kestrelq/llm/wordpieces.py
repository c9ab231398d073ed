"""Word-level byte-pair encoding through the tokenizers library, with each distinct piece encoded once.

The vocabulary's splitter cuts text into words, digits and runs of marks, and the ids of a text are
those of its pieces in turn. Pieces repeat; a bounded cache holds their ids. Texts that are not
plain Latin-1, or hold a special token's string or a separator that the two regex dialects treat
differently, go to the library whole. So does every text where the file splits in another way.
"""

from __future__ import annotations

import json
import os
import re
from itertools import islice

import numpy as np

from .common import claim, same_plan

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = "\t\n\x0b\f\r \x85\xa0"
# letters first, as the most common; no other kind begins with a letter
_PIECES = re.compile(rf"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
#: How files of this family prepare, split and merge text; fixed values.
PLAN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
_ODD = re.compile("[\x1c-\x1f]")
_LONG = 64

_ENCODERS: dict[str, WordEncoder] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder(path: str) -> WordEncoder:
    """One for each process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    claim("wordpieces", _ENCODERS.clear)
    return _ENCODERS[path]


class WordEncoder:
    def __init__(self, path: str, cache_entries: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.known = same_plan(json.load(f), PLAN)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = tuple(str(t) for t in (x.content for x in self.tokenizer.get_added_tokens_decoder().values()))
        self.vocabulary_size = self.tokenizer.get_vocab_size()
        ends = np.zeros(self.vocabulary_size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            ends[i] = token.endswith("</w>")
        self.ends = ends
        self.cache_entries = cache_entries
        self.pieces: dict[str, bytes] = {}
        self.long: list[str] = []

    def _plain(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not (_ODD.search(text) or any(s in text for s in self.special))

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        """Adds the ids of pieces to the cache."""
        known = self.pieces
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # a piece without an end mark: each by itself
                known.update((p, self._whole(p)) for p in part)
            else:
                raw, edges = ids.tobytes(), (cuts * 4).tolist()
                known.update((p, raw[x:y]) for p, x, y in zip(part, [0, *edges], edges))
        self.long += [p for p in pieces if len(p) > _LONG]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.known:
            return [self._whole(t) for t in texts]
        split = [_PIECES.findall(t.lower()) if self._plain(t) else None for t in texts]
        get = self.pieces.get
        found = [x and list(map(get, x)) for x in split]
        holes = [[i for i, ids in enumerate(f) if ids is None] if f else () for f in found]
        missing = list(dict.fromkeys(x[i] for x, hs in zip(split, holes) for i in hs))
        if missing:
            if len(self.pieces) + len(missing) > self.cache_entries:
                # words met first are the most frequent ones: a quarter of the cache stays
                self.pieces = dict(islice(self.pieces.items(), self.cache_entries // 4))
            self._learn(missing)
            known = self.pieces
            for x, f, hs in zip(split, found, holes):
                for i in hs:
                    f[i] = known[x[i]]
        out = [self._whole(t) if x is None else b"".join(f) for t, x, f in zip(texts, split, found)]
        for p in self.long:
            self.pieces.pop(p, None)
        self.long.clear()
        return out
