"""Keyword search: terms, postings, BM25, and a boolean query language, as DataFrame operations."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .recursion import checkpoints

_TOKEN = r"[^\p{L}\p{N}]+"
_ASCII = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def _folds() -> tuple[str, str]:
    """Latin letters with marks, and the same without: those that decompose into one letter and marks."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0].isalpha() and all(unicodedata.combining(c) for c in parts[1:]):
            pairs[chr(code)] = parts[0]
    return "".join(pairs), "".join(pairs.values())


def folded(text: Column) -> Column:
    """Without diacritics."""
    return F.translate(text, *_folds())


def terms(text: Column, tokenizer: str = "unicode", diacritics: bool = True) -> Column:
    """Lower-cased runs of letters and digits, with or without diacritics. ascii: only A-Z is lower-cased, and every
    other character is part of a word."""
    if tokenizer == "ascii":
        cut = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), _ASCII)
    else:
        cut = F.split(F.lower(text if diacritics else folded(text)), _TOKEN)
    return F.filter(cut, lambda x: x != "")


def postings(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """id, term, tf."""
    return docs.select(id_, F.explode(terms(F.col(text))).alias("term")).groupBy(id_, "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """term, docs, hits. A row is a document, so ids need not meet: tasks sum terms before they are shuffled."""
    t = terms(F.col(text))
    count = lambda words, name: docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias(name))
    return count(t, "hits").join(count(F.array_distinct(t), "docs"), "term").select("term", "docs", "hits")


def vocabulary_by_column(docs: DataFrame, columns: list[str]) -> DataFrame:
    """term, col, docs, hits."""
    out = None
    for c in columns:
        part = vocabulary(docs, "", c).select("term", F.lit(c).alias("col"), "docs", "hits")
        out = part if out is None else out.unionByName(part)
    return out


def instances(docs: DataFrame, columns: list[str], id_: str = "doc_id") -> DataFrame:
    """term, id, col, offset (from 0) of every word."""
    out = None
    for c in columns:
        part = docs.select(id_, F.posexplode(terms(F.col(c))).alias("offset", "term")).select("term", id_, F.lit(c).alias("col"), "offset")
        out = part if out is None else out.unionByName(part)
    return out


def _line(t: Column) -> Column:
    """Terms between single spaces."""
    return F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))


def _times(t: str, line: str, phrase: str) -> Column:
    """How often a word or a phrase stands in a list of terms, also overlapping."""
    words = re.findall(r"\w+", phrase.lower())
    if len(words) == 1:
        return F.size(F.filter(t, lambda x: x == F.lit(words[0])))
    return F.regexp_count(F.col(line), F.lit("(?= " + " ".join(map(re.escape, words)) + " )"))


def counted(docs: DataFrame, phrases: list[str], id_: str = "doc_id", columns: dict[str, float] | None = None) -> DataFrame:
    """id, _n (terms), _f0, _f1, ... (how often each phrase occurs, by column weights): the one pass over the texts,
    written to a checkpoint, so statistics and scores read numbers only."""
    columns = columns or {"text": 1.0}
    checkpoints(docs.sparkSession)
    spaced = any(len(re.findall(r"\w+", p)) > 1 for p in phrases)
    rows = docs.select(id_, *(terms(F.col(c)).alias(f"_t{k}") for k, c in enumerate(columns)))
    if spaced:
        rows = rows.select("*", *(_line(F.col(f"_t{k}")).alias(f"_s{k}") for k in range(len(columns))))
    total = lambda parts: sum(parts[1:], parts[0])
    n = total([F.greatest(F.size(f"_t{k}"), F.lit(0)) for k in range(len(columns))])
    seen = [total([F.coalesce(_times(f"_t{k}", f"_s{k}", p), F.lit(0)) * F.lit(w) for k, w in enumerate(columns.values())]).alias(f"_f{i}") for i, p in enumerate(phrases)]
    return rows.select(id_, n.alias("_n"), *seen).checkpoint()


def bm25(docs: DataFrame, words: list[str], id_: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, weights: dict[str, float] | None = None) -> DataFrame:
    """id, score (negative: smaller is better) of documents with any of the words or phrases. weights: of several
    columns, whose occurrences count by weight before they saturate; a column of weight 0 still finds."""
    words = list(dict.fromkeys(w.lower() for w in words))
    base = counted(docs, words, id_, weights or {text: 1.0})
    found = base if not weights or all(weights.values()) else counted(docs, words, id_, dict.fromkeys(weights, 1.0)).select(id_, *(F.col(f"_f{i}").alias(f"_h{i}") for i in range(len(words))))
    if found is base:
        base = base.select("*", *(F.col(f"_f{i}").alias(f"_h{i}") for i in range(len(words))))
    else:
        base = base.join(found, id_)
    stats = base.agg(F.count(F.lit(1)).alias("_docs"), F.avg("_n").alias("_mean"), *(F.sum((F.col(f"_h{i}") > 0).cast("int")).alias(f"_d{i}") for i in range(len(words))))
    hit = F.lit(False)
    for i in range(len(words)):
        hit = hit | (F.col(f"_h{i}") > 0)
    scored = base.where(hit).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(words)):
        idf = F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
        tf = F.col(f"_f{i}")
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_n") / F.col("_mean")))).otherwise(F.lit(0.0))
    return scored.select(id_, (-score).alias("score"))


def ceiling(docs: DataFrame, words: list[str], text: str = "text", k1: float = 1.2) -> DataFrame:
    """One row: the greatest score that documents could have for the words; words of no document count 0."""
    words = list(dict.fromkeys(w.lower() for w in words))
    has = [F.sum(F.array_contains("_t", w).cast("int")).alias(f"_d{i}") for i, w in enumerate(words)]
    stats = docs.select(terms(F.col(text)).alias("_t")).agg(F.count(F.lit(1)).alias("_docs"), *has)
    total = F.lit(0.0)
    for i in range(len(words)):
        d = F.col(f"_d{i}")
        idf = F.log((F.col("_docs") - d + 0.5) / (d + 0.5))
        total = total + F.when(d > 0, F.greatest(idf, F.lit(1e-6)) * (k1 + 1)).otherwise(F.lit(0.0))
    return stats.select(total.alias("ceiling"))


class Query:
    """OR < AND < NOT < neighbours; "phrases", prefix*, ^first, NEAR(a b c, n), parentheses; column filters:
    col: x, {col other}: x, - {col}: x (in any column but these)."""

    def __init__(self, text: str):
        self.tokens = re.findall(r'-?\s*\{[\w\s]+\}\s*:|-?\s*\b\w+\s*:|"[^"]*"\*?|NEAR\s*\(|[()]|,|\^?[\w]+\*?', text)
        self.at = 0
        self.tree = self._or()
        if self.at < len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]!r}")

    def _peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def _next(self) -> str:
        if self.at >= len(self.tokens):
            raise ValueError("the query ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _chain(self, word: str, below):
        out = below()
        while self._peek() == word:
            self._next()
            out = (word, out, below())
        return out

    def _or(self):
        return self._chain("OR", self._and)

    def _and(self):
        return self._chain("AND", self._not)

    def _not(self):
        return self._chain("NOT", self._neighbours)

    def _neighbours(self):
        out = self._one()
        while (p := self._peek()) is not None and p not in ("OR", "AND", "NOT", ")", ","):
            out = ("AND", out, self._one())
        return out

    def _one(self):
        t = self._next()
        if t.endswith(":"):
            return ("COLUMNS", re.findall(r"\w+", t), t.startswith("-"), self._one())
        if t == "(":
            out = self._or()
            if self._next() != ")":
                raise ValueError("a parenthesis is open")
            return out
        if t.startswith("NEAR"):
            parts, gap = [], 10
            while (x := self._next()) != ")":
                if x == ",":
                    gap = int(self._next())
                else:
                    parts.append(x.strip('"').lower())
            return ("NEAR", parts, gap)
        if t in ("AND", "OR", "NOT", ")", ","):
            raise ValueError(f"unexpected {t!r}")
        first, prefix = t.startswith("^"), t.endswith("*")
        return ("PHRASE", re.findall(r"\w+", t.lower()), prefix, first)

    def predicate(self, *texts: Column, names: tuple[str, ...] = ()) -> Column:
        """True for texts (columns of a row, with names) that match. A phrase stands within one column; AND, OR and NOT
        look into all of them."""
        lines = {names[i] if i < len(names) else str(i): _line(terms(x)) for i, x in enumerate(texts)}
        return F.coalesce(self._at(self.tree, lines), F.lit(False))

    def _at(self, node, lines: dict[str, Column]) -> Column:
        kind = node[0]
        if kind == "AND":
            return self._at(node[1], lines) & self._at(node[2], lines)
        if kind == "OR":
            return self._at(node[1], lines) | self._at(node[2], lines)
        if kind == "NOT":
            return self._at(node[1], lines) & ~self._at(node[2], lines)
        if kind == "COLUMNS":
            if unknown := set(node[1]) - set(lines):
                raise ValueError(f"no such column: {unknown.pop()}")
            kept = {c: x for c, x in lines.items() if (c in node[1]) != node[2]}
            return self._at(node[3], kept) if kept else F.lit(False)
        found = F.lit(False)
        for line in lines.values():
            found = found | F.coalesce(self._within(node, line), F.lit(False))
        return found

    def _within(self, node, line: Column) -> Column:
        if node[0] == "NEAR":
            words, gap = node[1:]
            if len(words) == 2:
                a, b = map(re.escape, words)
                between = rf" (?:\S+ ){{0,{gap}}}"
                return line.rlike(f" {a}{between}{b} ") | line.rlike(f" {b}{between}{a} ")
            # a stretch of the words and at most gap others has them all; the terms are bound once, as a lambda's argument
            def near(t: Column) -> Column:
                here = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"].isin(*words))
                return F.exists(here, lambda s: F.size(F.array_intersect(F.slice(t, s["i"] + 1, F.lit(len(words) + gap)), F.array(*map(F.lit, words)))) == len(set(words)))

            return F.element_at(F.transform(F.array(F.filter(F.split(line, " "), lambda x: x != "")), near), 1)
        words, prefix, first = node[1:]
        want = " " + " ".join(words) + ("" if prefix else " ")
        return line.startswith(want) if first else line.contains(want)


OPERATORS = re.compile(r'["()*^:{}+]|(?<!\S)(?:AND|OR|NOT|NEAR)(?!\S)|(?<!\S)-')


def plain_words(query: str) -> list[str]:
    """The words of a retrieval query, which is plain text: operators of the query language are refused."""
    if m := OPERATORS.search(query):
        raise ValueError(f"a retrieval query takes plain words, not {m[0]!r}")
    return re.findall(r"\w+", query.lower())


# a stored index


def write_index(docs: DataFrame, path: str, id_: str = "doc_id", text: str = "text", buckets: int = 64) -> None:
    """Postings (term, id, tf, length of the document) in folders by term hash, and one row of statistics. A frequent
    term's postings are in one folder, in as many files as tasks wrote it."""
    t = terms(F.col(text))
    rows = docs.select(F.col(id_).alias("id"), F.size(t).alias("n"), F.explode(t).alias("term")).groupBy("term", "id", "n").agg(F.count(F.lit(1)).alias("tf"))
    rows.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.select(F.greatest(F.size(t), F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{path}/statistics")


def search_index(spark: SparkSession, path: str, words: list[str], k: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, score by BM25 (negative), from the postings of the words alone: only their folders are read."""
    stats = spark.read.parquet(f"{path}/statistics").first()
    words = list(dict.fromkeys(w.lower() for w in words))
    table = spark.read.parquet(f"{path}/postings")
    hashes = spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(w)), F.lit(stats.buckets)) for w in words)).first()
    rows = table.where(F.col("bucket").isin(*set(hashes)) & F.col("term").isin(*words))
    held = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each word
    idf = F.greatest(F.log((stats.docs - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / (stats.mean or 1.0)))
    out = rows.join(F.broadcast(held), "term").groupBy("id").agg((-F.sum(part)).alias("score"))
    return out if k is None else out.orderBy("score", "id").limit(k)


def search(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    return docs.where(Query(query).predicate(F.col(text)))


def _literal(mark: str) -> str:
    """For the right side of a replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def highlight(text: Column, word: str, before: str = "[", after: str = "]") -> Column:
    return F.regexp_replace(text, rf"(?i)(?<![\p{{L}}\p{{N}}])({re.escape(word)})(?![\p{{L}}\p{{N}}])", f"{_literal(before)}$1{_literal(after)}")


def trigrams(text: Column) -> Column:
    """All windows of three characters."""
    n = F.length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
