"""Secret scan: fixed shapes, and values in credential contexts weighed by how hard they are to guess.

The fixed shapes are the base spans. The guess-cost scan adds spans of kind "guess": after a
credential word and an assignment sign, the value is split into words, dates, repeats, keyboard
walks and brute-force stretches so that the guesses needed are fewest (a dynamic programme over the
value). Values that stay expensive are secrets; placeholders and plain words are cheap and go free.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# a run of word letters is matched from its first AKIA to its end, so the bounds can stand in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?"""
    r"""|(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass|pwd|auth|authorization|bearer|pin))["']?\x20*(?::=|=>|[:=])\x20*"""
    # a scheme word before the value is read past
    r"""(?:"(?:(?:bearer|basic|digest|token|apikey)\x20+)?([^"\n]+)"|'(?:(?:bearer|basic|digest|token|apikey)\x20+)?([^'\n]+)'|(?:(?:bearer|basic|digest|token|apikey)\x20+)?([^\s"'<>,;]+))""",
    re.I | re.A,
)

#: Frequent password words by rank, a fixed list; the position is the guess number.
WORDS = (
    "password admin letmein welcome monkey dragon master login secret changeme default test guest root user "
    "hello qwerty iloveyou sunshine princess football baseball shadow superman batman trustno starwars freedom "
    "whatever michael jordan jennifer hunter ranger thomas robert soccer hockey killer george charlie andrew "
    "summer winter spring autumn monday friday january march june july august september october november december "
    "love money happy flower cheese computer internet server example sample demo your token pass key none null "
    "true false placeholder insert here this that the and for you with from have not are all one two three four "
    "five orange banana apple purple yellow green black white silver golden tiger lion eagle falcon phoenix "
    "diamond ginger pepper cookie matrix merlin thunder mustang harley yankees dallas access service account "
    "config private public change temp temporary company office home house family friend angel nicole jessica "
    "bearer basic digest required optional missing invalid expired unknown disabled enabled encrypted hidden removed "
    "redacted masked string number integer boolean value field format length reset update updated enter provide please "
    "contact incorrect wrong correct changed rejected accepted denied granted failed success forgotten protected "
    "manager policy storage history generator authentication authorization credentials login username undefined empty "
    "nothing something anything always never should before after again because between during about their there which "
    "would could other people first second through environment variable settings details support security request "
    "response header cookies session client device numbers letters characters minimum maximum already shared public"
).split()
#: Rows of a common keyboard, fixed values; walks run along them either way.
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Dates by the form of their start, with or without one kind of separator, and the guesses for each: 119 years.
_DATES = (
    (re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])", re.A), math.log10(119 * 366)),
    (re.compile(r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\1(?:19|20)\d\d", re.A), math.log10(119 * 366)),
    (re.compile(r"(?:19|20)\d\d", re.A), math.log10(119)),
)

_STEP = math.log10(2)


def _neighbours(rows: tuple[str, ...]) -> set[str]:
    pairs = {a + b for row in rows for a, b in zip(row, row[1:])}
    return pairs | {p[::-1] for p in pairs}


class _Runs:
    """Open starts of one regular run (a repeat or a walk), oldest first. A start's price is what leads to it plus
    its unit; a segment adds the log of its length in units. An older start that is no dearer than a younger one
    stays so, as lengths grow alike, so the younger one goes: few starts stay open however long the run is."""

    __slots__ = ("prices", "starts")

    def __init__(self):
        self.prices: list[float] = []
        self.starts: list[int] = []

    def clear(self) -> None:
        if self.starts:
            self.prices.clear()
            self.starts.clear()

    def end(self, at: int, unit: int) -> tuple[float, int]:
        """The cheapest segment that ends here, and its start."""
        prices, starts = self.prices, self.starts
        if len(starts) == 1:
            return prices[0] + math.log10((at - starts[0]) // unit), starts[0]
        least, kept = math.inf, []
        for i, start in enumerate(starts):
            now = prices[i] + math.log10((at - start) // unit)
            if now < least:
                least = now
                kept.append(i)
        if len(kept) < len(starts):
            prices[:], starts[:] = [prices[i] for i in kept], [starts[i] for i in kept]
        return least, starts[-1]

    def open(self, price: float, start: int, at: int, unit: int) -> None:
        """Adds a start unless an older one is no dearer where its shortest segment ends."""
        if not self.starts or self.end(at, unit)[0] > price + math.log10((at - start) // unit):
            self.prices.append(price)
            self.starts.append(start)


class GuessCost:
    """log10 of the guesses for a value under the cheapest segmentation, over all segmentations into:

    a word (three characters or more): its rank; ten times more where digits or signs stand for letters; twice for
    each capital, up to two. A date: 119 years, times 366 where it has a day. A repeat: a character three times or
    more, or a unit of 2 to 8 characters twice or more, its guesses times the number. A keyboard walk of three keys
    or more: its first key, length and direction. Anything else: the alphabet of each character's class. Each
    segment after the first is twice as much, for not knowing where it starts.

    Work and memory are linear in the value. With a limit the scan stops once no segmentation can stay below it.
    """

    #: Digits and signs that stand for letters, fixed values.
    LEET = str.maketrans("013457@$!", "oieastasi")
    UNITS = range(2, 9)

    def __init__(self, words: list[str] | tuple[str, ...] = tuple(WORDS), keyboard: tuple[str, ...] = KEYBOARD):
        self.rank = {}
        for i, w in enumerate(words):
            if len(w) >= 3:
                self.rank.setdefault(w.lower(), i + 2)
        by: dict[str, set[int]] = {}
        for w in self.rank:
            by.setdefault(w[:3], set()).add(len(w))
        self.sizes = {k: sorted(v) for k, v in by.items()}  # lengths of words by their first three letters
        self.longest = max(map(len, self.rank), default=0)
        self.near = _neighbours(keyboard)
        self.parts = {u: [d for d in range(1, u) if u % d == 0] for u in self.UNITS}

    @staticmethod
    def brute(c: str) -> float:
        if c.isdigit():
            return 1.0
        if c.isascii() and c.isalpha():
            return math.log10(26)
        return math.log10(33) if c.isascii() else 3.0

    def _forward(self, value: str, low: str, plain: str, i: int):
        """Words and dates that start at i: (end, cost, kind)."""
        for form, extra in ((low, 0.0), (plain, 1.0)):
            for n in self.sizes.get(form[i : i + 3], ()):
                rank = self.rank.get(form[i : i + n])
                if rank and (not extra or low[i : i + n] not in self.rank):
                    capitals = sum(c.isupper() for c in value[i : i + n])
                    yield i + n, math.log10(rank) + extra + min(capitals, 2) * _STEP, "word"
        if value[i] in "0123":
            for form, cost in _DATES:
                if m := form.match(value, i):
                    yield m.end(), cost, "date"

    def _scan(self, value: str, limit: float, back: list | None) -> float:
        n = len(value)
        low = value.lower() if len(value.lower()) == n else value
        plain = low.translate(self.LEET)
        inf, near, sizes, step, brute, units, parts = math.inf, self.near, self.sizes, _STEP, self.brute, self.UNITS, self.parts
        price: dict[str, float] = {}
        cost = [0.0]  # of the last positions, cheapest split that ends there
        shift = 0  # the position of cost[0]
        window = max(self.longest, 2 * units[-1], 10)
        ahead: dict[int, list[tuple[float, int, str]]] = {}  # by end: words and dates
        same, walk = _Runs(), _Runs()
        period = {(u, r): _Runs() for u in units for r in range(u)}
        streak = [0] * (units[-1] + 1)  # characters up to here that equal the one so far before them
        walked, stretch, stretch_from, deep = 0, inf, 0, 3 * units[-1]
        for j in range(1, n + 1):
            i = j - 1
            c = value[i]
            if c in "0123" or low[i : i + 3] in sizes or plain[i : i + 3] in sizes:
                for end, x, kind in self._forward(value, low, plain, i):
                    ahead.setdefault(end, []).append((cost[i - shift] + x + (step if i else 0.0), i, kind))
            b = price.get(c)
            if b is None:
                b = price[c] = brute(c)
            new = cost[i - shift] + (step if i else 0.0) + b
            stretch += b
            if new < stretch:
                stretch, stretch_from = new, i
            best, start, kind = stretch, stretch_from, "brute"
            if ahead:
                for x, at, what in ahead.pop(j, ()):
                    if x < best:
                        best, start, kind = x, at, what
            c = low[i]
            run = streak[1]
            streak[1] = run + 1 if i and low[i - 1] == c else 0
            if streak[1] >= 2:
                at = j - 3
                same.open(cost[at - shift] + (step if at else 0.0) + price[value[at]], at, j, 1)
                x, at = same.end(j, 1)
                if x < best:
                    best, start, kind = x, at, "repeat"
            else:
                same.clear()
            walked = walked + 1 if i and low[i - 1 : j] in near else 0
            if walked >= 2:
                at = j - 3
                walk.open(cost[at - shift] + (step if at else 0.0) + price[value[at]] + step, at, j, 1)
                x, at = walk.end(j, 1)
                if x < best:
                    best, start, kind = x, at, "walk"
            else:
                walk.clear()
            # deep in a run of one character every unit is such a run, which is never dearer: counted when it ends
            if run >= deep and not streak[1]:
                for u in units:
                    streak[u] = run + 1 - u
            for u in units if streak[1] < deep else ():
                if i < u or low[i - u] != c:
                    if streak[u] >= u:
                        for r in range(u):
                            period[u, r].clear()
                    streak[u] = 0
                    continue
                streak[u] += 1
                if streak[u] < u:
                    continue
                for d in parts[u]:
                    if streak[d] + d >= streak[u] + u:
                        break  # a unit that repeats a shorter one is never cheaper
                else:
                    d = 0
                if d:
                    continue
                runs, at = period[u, j % u], j - 2 * u
                runs.open(cost[at - shift] + (step if at else 0.0) + sum(brute(y) for y in low[at : at + u]), at, j, u)
                x, at = runs.end(j, u)
                if x < best:
                    best, start, kind = x, at, "repeat"
            cost.append(best)
            if back is not None:
                back.append((start, kind))
            if not j % 64:
                del cost[: len(cost) - window - 1]
                shift = j + 1 - len(cost)
                if min(cost) >= limit and stretch >= limit:
                    # nothing that is still open at this position can end below the limit either
                    still = [x for x, *_ in (*(e for es in ahead.values() for e in es),)]
                    still += [r.end(j, u)[0] for (u, k), r in period.items() if r.starts and k == j % u]
                    still += [p for (u, k), r in period.items() if k != j % u for p in r.prices]
                    still += [p for r in (same, walk) for p in r.prices]
                    if not still or min(still) >= limit:
                        return max(limit, min(best, stretch))
        return cost[-1] if n else 0.0

    def segments(self, value: str) -> tuple[float, list[tuple[int, int, str]]]:
        back: list[tuple[int, str]] = [(0, "")]
        total = self._scan(value, math.inf, back)
        out, j = [], len(value)
        while j:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        return total, out[::-1]

    def __call__(self, value: str, limit: float = math.inf) -> float:
        """The cost, or, once it is known to be the limit or more, a number of at least the limit."""
        return self._scan(value, limit, None)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Fixed shapes: leftmost, non-overlapping within a kind; code points, end exclusive."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return out


def guess_spans(text: str, cost: GuessCost, least: float) -> list[tuple[int, int, str]]:
    """Values in credential contexts of at least six characters that cost 10^least guesses."""
    out = []
    if ":" in text or "=" in text:
        for m in _CONTEXT.finditer(text):
            g = m.lastindex
            value = m[g]
            if len(value) >= 6 and cost(value, least) >= least:
                out.append((m.start(g), m.end(g), "guess"))
    return out


def find_secrets(text: str, cost: GuessCost, least: float) -> list[tuple[int, int, str]]:
    """All spans by start, then kind."""
    spans = base_spans(text) + guess_spans(text, cost, least)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """Each union of overlapping spans becomes the mark; an assignment keeps its name."""
    parts, at = [], 0
    cut: list[list[int]] = []
    for start, end, kind in spans:
        if kind == "assign" and (m := _ASSIGN.match(text, start)):
            start = m.start(2)
        cut.append([start, end])
    for start, end in sorted(cut):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_SPANS = "array<struct<start:int,end:int,kind:string>>"


def _scan(batches: Iterator[pa.RecordBatch], words: tuple[str, ...], least: float) -> Iterator[pa.RecordBatch]:
    cost = GuessCost(words)
    for batch in slices(batches, "text"):
        found = [find_secrets(t, cost, least) for t in texts(batch)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        rows = [[{"start": a, "end": b, "kind": k} for a, b, k in spans] for spans in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])


def _redact(batches: Iterator[pa.RecordBatch], words: tuple[str, ...], least: float) -> Iterator[pa.RecordBatch]:
    cost = GuessCost(words)
    for batch in slices(batches, "text"):
        out = []
        for t in batch.column("text").to_pylist():
            spans = find_secrets(t, cost, least) if t else []
            out.append(redact(t, spans) if spans else t)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(out, pa.string()))


def scan(docs: DataFrame, words: tuple[str, ...] = tuple(WORDS), least: float = 8.0) -> DataFrame:
    """doc_id, spans (start, end, kind) of every document; null text counts as empty, rows stay one for one. Texts and
    values may be of any length: a value takes time linear in its length, and memory for a few positions."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_scan, words=tuple(words), least=least), f"doc_id long, spans {_SPANS}")


def redacted(docs: DataFrame, words: tuple[str, ...] = tuple(WORDS), least: float = 8.0) -> DataFrame:
    """The same rows and columns with secrets replaced in text; null texts stay null. Other columns may be
    of any type that Arrow carries."""
    return docs.mapInArrow(partial(_redact, words=tuple(words), least=least), docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""

    def joined(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return scanned.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"))


def sha256(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
