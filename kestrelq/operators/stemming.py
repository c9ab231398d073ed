"""English stems by Porter's suffix rules (1980), and snippets around query words.

Stems are computed once for each distinct term: the vocabulary is aggregated first, so Python sees
terms and not texts.
"""

from __future__ import annotations

import bisect
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fulltext

# The suffixes of steps 2, 3 and 4 with what replaces them.
_STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(stem: str) -> str:
    """v and c for each letter; y is a vowel behind a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    """Vowel runs that a consonant follows."""
    return len(re.findall(r"v+c", _shape(stem)))


def _short(stem: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    cut = next((len(s) for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), 0)
    if not cut:
        return w
    w = w[:-cut]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
        return w[:-1]
    return w + "e" if _measure(w) == 1 and _short(w) else w


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Words of other letters than a to z, and of up to two letters, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    w = _past(_plural(word))
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP2, _STEP3):
        s = _longest(w, table)
        if s and _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + table[s]
    s = _longest(w, _STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[-4] in "st"):
        w = w[: -len(s)]
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed(term: Column) -> Column:
    @F.pandas_udf("string")
    def run(found: pd.Series) -> pd.Series:
        return found.map(stem, na_action="ignore")

    return run(term)


def stem_vocabulary(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """stem, forms (distinct terms), hits. Terms are counted before they are stemmed."""
    hits = docs.select(F.explode(fulltext.terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("hits"))
    return hits.groupBy(stemmed(F.col("term")).alias("stem")).agg(F.count(F.lit(1)).alias("forms"), F.sum("hits").alias("hits"))


def search(docs: DataFrame, word: str, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, hits of documents with any form of the word. Forms come from the corpus vocabulary and join
    the postings, so stems are not computed for each text."""
    found = fulltext.postings(docs, id_, text)
    forms = found.select("term").distinct().where(stemmed(F.col("term")) == stem(word.lower()))
    return found.join(forms, "term").groupBy(id_).agg(F.sum("tf").alias("hits"))


#: What a window's words count: the first of each, each repeat, and a start at the text's or at another sentence's begin.
_WORD, _REPEAT, _TEXT, _SENTENCE = 1000, 1, 120, 100
_SENTENCE_END = re.compile(r"[.:][ \t\n\r]+$")


def _window(hits: list[tuple[int, str]], sentences: list[int], tokens: int, size: int) -> int:
    """Where the best stretch of `size` tokens begins. A stretch from a hit on is shown with its hits in the middle; one
    from the begin of a hit's sentence is shown as it is and is worth more. The first of equals wins."""
    at = [i for i, _ in hits]

    def worth(start: int) -> tuple[int, int]:
        inside = hits[bisect.bisect_left(at, start) : bisect.bisect_left(at, start + size)]
        kinds = len({w for _, w in inside})
        wide = inside[-1][0] + 1 - inside[0][0]
        return kinds * _WORD + (len(inside) - kinds) * _REPEAT, max(0, min(inside[0][0] - (size - wide) // 2, tokens - size))

    best, shown = 0, 0
    for i in at:
        score, middle = worth(i)
        if score > best:
            best, shown = score, middle
        start = sentences[bisect.bisect_right(sentences, i) - 1]
        if tokens > size and start < i < start + size:
            score = worth(start)[0] + (_SENTENCE if start else _TEXT)
            if score > best:
                best, shown = score, start
    return shown


def snippet(text: Column, words: list[str], before: str = "[", after: str = "]", ellipsis: str = "...", size: int = 16) -> Column:
    """The best stretch of `size` terms (see _window; a sentence begins behind a full stop or a colon and white space),
    its hits marked, with an ellipsis at cut ends. Null for null; the beginning without a hit."""
    wanted = {w.lower() for w in words}
    term = re.compile(r"[^\W_]+")

    def one(t: str) -> str:
        spans = [m.span() for m in term.finditer(t)]
        hits = [(i, w) for i, (a, b) in enumerate(spans) if (w := t[a:b].lower()) in wanted]
        hit = [i for i, _ in hits]
        sentences = [0] + [i for i in range(1, len(spans)) if _SENTENCE_END.search(t, spans[i - 1][1], spans[i][0])]
        start = _window(hits, sentences, len(spans), size)
        if not spans:
            return t
        end = min(start + size, len(spans))
        left, right = (spans[start][0] if start else 0), (spans[end - 1][1] if end < len(spans) else len(t))
        out, at = "", left
        for j in hit:
            if start <= j < end:
                a, b = spans[j]
                out += t[at:a] + before + t[a:b] + after
                at = b
        return (ellipsis if start else "") + out + t[at:right] + (ellipsis if end < len(spans) else "")

    @F.pandas_udf("string")
    def run(found: pd.Series) -> pd.Series:
        return found.map(one, na_action="ignore")

    return run(text)
