"""Similarity join on word n-gram sets: MinHash banding, then exact verification.

Words are the lower-cased text between white space; a document's set holds its runs of five words
(a shorter document has one run, all its words). Documents with the same words share a key and count
as one text from there on. Band and row counts follow from the threshold and the wanted recall.
Equal band hashes meet in a shuffle. Texts that share a band compare their signatures there, in
blocks of bounded size, and those whose estimate is within five standard deviations of the threshold
are candidates, so passages that many documents share don't chain them together. Every pair of a
candidate group is verified on its full sets, again in blocks of bounded size: no pair is emitted and
no group sits in one task. A text is shingled once for its signature and once for verification; its
set is copied once for each block of its own group, which is one but for groups above the block size.
The result has a row for each document: its class and its number of links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hubs, slices, texts, written
from .components import components

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def choose_bands(threshold: float, recall: float, most_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, whose bands find a pair at the
    threshold with the wanted probability within most_hashes hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("the recall needs more hashes")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size, _PRIME), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_spans(docs: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents joined, where each word begins and ends there, 64-bit hashes of all words, and each
    document's first word (one more entry than documents)."""
    joined = b" ".join(docs) + b" "
    data = np.frombuffer(joined, np.uint8)
    blank = _BLANK[data]
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    after = np.flatnonzero(blank & ~np.concatenate([[True], blank[:-1]]))
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    words = _mixed((total[after] - total[first]) * down[first])
    edges = np.cumsum([0, *(len(d) + 1 for d in docs)])
    return joined, first, after, words, np.searchsorted(first, edges)


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return word_spans(docs)[3:]


def shingles(docs: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each document."""
    if not docs:
        return []
    words, at = word_hashes(docs)
    return [np.unique(x) for x in _grams(words, at, n)]


def _grams(words: np.ndarray, at: np.ndarray, n: int) -> list[np.ndarray]:
    every = np.zeros(max(0, len(words) - n + 1), np.uint64)
    weight = 1
    for j in range(n):
        every += words[j : len(words) - n + 1 + j] * np.uint64(weight)
        weight = weight * 0xD6E8FEB86659FD93 % (1 << 64)
    every = _mixed(every)
    out = []
    for a, b in zip(at, at[1:]):
        if b - a >= n:
            out.append(every[a : b - n + 1])
        elif b > a:
            whole = np.uint64(xxhash.xxh64_intdigest(words[a:b].tobytes(), seed=n))
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lower(batch: pa.RecordBatch) -> list[bytes]:
    return [t.lower().encode() for t in texts(batch)]


_SIGNED = "doc_id long, raw long, key binary, n int, bands array<long>, marks binary"


def _sign(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    draw = np.random.default_rng(20240607)
    a = draw.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
    b = draw.integers(0, 1 << 63, bands * rows, np.uint64)
    for batch in slices(batches, "text", max_rows=2048, max_bytes=1 << 20):
        words, at = word_hashes(docs := _lower(batch))
        grams = _grams(words, at, n)
        full = [i for i, g in enumerate(grams) if len(g)]
        hashes = np.zeros((bands, len(docs)), np.int64)
        marks = np.zeros((len(docs), bands * rows), np.uint8)
        if full:
            flat = np.concatenate([grams[i] for i in full])
            starts = np.cumsum([0, *(len(grams[i]) for i in full)])[:-1]
            for band in range(bands):
                mixed = np.full(len(full), band + 1, np.uint64)
                for k in range(band * rows, band * rows + rows):
                    least = _mixed(np.minimum.reduceat(flat * a[k] + b[k], starts))
                    marks[full, k] = least.astype(np.uint8)
                    mixed = _mixed(mixed * _PRIME + least)
                hashes[band, full] = mixed.view(np.int64)
        keys = [xxhash.xxh3_128_digest(words[x:y].tobytes()) for x, y in zip(at, at[1:])]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands, dtype=np.int32)), pa.array(hashes.T.reshape(-1)))
        columns = [batch.column("doc_id"), batch.column("raw"), pa.array(keys, pa.binary()), pa.array([len(g) for g in grams], pa.int32()), lists, pa.array([m.tobytes() for m in marks], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in _SIGNED.split(", ")])


def least_equal(threshold: float, hashes: int, deviations: float = 5.0) -> int:
    """How many of their signatures' entries a pair at the threshold shares, but for one pair in millions."""
    return max(1, math.floor(hashes * threshold - deviations * math.sqrt(hashes * threshold * (1 - threshold))))


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Boolean matrix of pairs with Jaccard similarity of at least the threshold, without the diagonal."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    if m <= 6:
        common = np.zeros((m, m), np.int64)
        for i in range(m):
            for j in range(i):
                small, large = min(size[i], size[j]), max(size[i], size[j])
                if small >= threshold * large:
                    common[i, j] = common[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(m), size)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        column, owner = column[shared], owner[shared]
        _, column = np.unique(column, return_inverse=True)
        common = np.zeros((m, m), np.float64)
        width = 4096
        edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
        for k, (x, y) in enumerate(zip(edges, edges[1:])):
            part = np.zeros((m, width), np.float32)
            part[owner[x:y], column[x:y] - k * width] = 1
            common += part @ part.T
        common = np.rint(common).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    out = common >= threshold * union - 1e-9
    out &= common > 0
    np.fill_diagonal(out, False)
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys from sorted batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or values[i] != values[start]:
                if held and now != values[start]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(start, i - start))
                now, start = values[start], i
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Least label of everything joined so far."""

    def __init__(self, labels: list[int]):
        self.labels, self.above = labels, list(range(len(labels)))

    def root(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = self.above[i]
        return i

    def join(self, i: int, j: int) -> None:
        x, y = self.root(i), self.root(j)
        if self.labels[x] > self.labels[y]:
            x, y = y, x
        self.above[y] = x

    def label(self, i: int) -> int:
        return self.labels[self.root(i)]


_EDGES = "u long, v long"


def _candidates(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links between texts of a bucket with at least `least` equal signature entries, as trees."""
    for group in _groups(batches, ("band", "hash", "left", "right")):
        node = group.column("node").to_numpy()
        block = group.column("block").to_numpy()
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(len(node), -1)
        forest = _Forest(node.tolist())
        across = block[0] != block[-1]  # pairs within a block are met on the diagonal
        first = int(np.searchsorted(block, block[-1])) if across else len(node)
        for i in range(first):
            start = first if across else i + 1
            for j in start + np.flatnonzero((marks[start:] == marks[i]).sum(1) >= least):
                forest.join(i, int(j))
        linked = [(n, forest.label(i)) for i, n in enumerate(forest.labels) if forest.label(i) != n]
        if linked:
            u, v = zip(*linked)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


_SETS = "comp long, many int, block int, node long, copies long, grams binary"


def _shingle(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", max_rows=2048, max_bytes=1 << 20):
        sets = pa.array([g.tobytes() for g in shingles(_lower(batch), n)], pa.binary())
        names = [x.split()[0] for x in _SETS.split(", ")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), sets], names=names)


_VERIFIED = "node long, links long, label long"


def _verify(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches, ("comp", "left", "right")):
        nodes = group.column("node").to_numpy()
        new = np.concatenate([[True], nodes[1:] != nodes[:-1]])  # rows that share id and text are one
        group = group.filter(pa.array(new))
        nodes = nodes[new].tolist()
        copies = np.array(group.column("copies").to_pylist(), np.int64)
        block = np.array(group.column("block").to_pylist())
        linked = similar([np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()], threshold)
        if group.column("left")[0] != group.column("right")[0]:  # pairs within a block are met on the diagonal
            linked &= block[:, None] != block[None, :]
        links = linked @ copies
        forest = _Forest(nodes)
        for i, j in zip(*np.nonzero(np.triu(linked))):
            forest.join(int(i), int(j))
        labels = [forest.label(i) for i in range(len(nodes))]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(links, pa.int64()), pa.array(labels, pa.int64())], names=["node", "links", "label"])


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with node and many (blocks of its group) -> a row for each pair of blocks that the node takes part in,
    together and in order by keys, left and right."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    every = every.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "many")
    return every.repartition(parts, *keys, "left", "right").sortWithinPartitions(*keys, "left", "right", "block", "node")


def _classes(docs: DataFrame, threshold: float, n: int, recall: float, block: int, block_grams: int) -> tuple[DataFrame, DataFrame]:
    """(signed, known). signed: doc_id, raw (hash of the text as it is), key, n for each row of docs. known: for
    each key with words its label, class_id, links and copies, and the least (missing, doc_id, raw) of its rows."""
    bands, rows = choose_bands(threshold, recall)
    texts_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts_ = texts_.withColumn("raw", F.xxhash64("text"))
    signed = written(texts_.mapInArrow(partial(_sign, n=n, bands=bands, rows=rows), _SIGNED), "signed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "raw")).alias("first")
    reps = signed.where("n > 0").groupBy("key").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("marks").alias("marks"))
    # written, so a text keeps its number; ids may be missing or shared by several texts
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    hashed = reps.select("node", F.posexplode("bands").alias("band", "hash"))
    buckets = hashed.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = written(buckets.select(F.struct("band", "hash").alias("bucket"), "size"), "buckets")
    met = join_hubs(hashed.select(F.struct("band", "hash").alias("bucket"), "node"), buckets, "bucket", "size", reps.count() * bands)
    met = met.select("bucket.band", "bucket.hash", "node", F.ceil(F.col("size") / block).cast("int").alias("many"))
    met = met.withColumn("block", F.pmod(F.xxhash64("node"), F.col("many")).cast("int")).join(reps.select("node", "marks"), "node")
    edges = _dealt(met, "band", "hash").mapInArrow(partial(_candidates, least=least_equal(threshold, bands * rows)), _EDGES)
    group = written(components(edges), "groups")
    forget(buckets)
    # candidates with their sets; a group of many or long texts is dealt to blocks, and pairs of blocks to tasks
    group = group.join(reps.select("node", "copies", "n", "first"), "node")
    sizes = written(group.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("n").cast("long")).alias("grams")), "sizes")
    many = F.ceil(F.greatest(F.col("size") / block, F.col("grams") / block_grams)).cast("int")
    group = join_hubs(group, sizes, "label", "size", reps.count())
    group = group.select("node", "copies", "first", F.col("label").alias("comp"), many.alias("many"), F.pmod(F.xxhash64("node"), many).cast("int").alias("block"))
    source = texts_.withColumn("first", F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "raw")).select("first", "text")
    sets = group.join(source, "first").drop("first").mapInArrow(partial(_shingle, n=n), _SETS)
    verified = written(_dealt(sets, "comp").mapInArrow(partial(_verify, threshold=threshold), _VERIFIED), "verified")
    forget(sizes)
    final = components(verified.select(F.col("node").alias("u"), F.col("label").alias("v")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    known = reps.select("key", "node", "copies", "first").join(links, "node", "left").join(final, "node", "left")
    known = known.select("key", "copies", "first", F.coalesce("label", "node").alias("label"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    known = written(known, "known")
    classes = known.groupBy("label").agg(F.min("first.doc_id").alias("class_id"), F.count(F.lit(1)).alias("size"))
    known = join_hubs(known, written(classes, "classes"), "label", "size", reps.count())
    return signed.select("doc_id", "raw", "key", "n"), written(known, "known")


def similarity_classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = 192, block_grams: int = 1 << 20) -> DataFrame:
    """docs (doc_id, text) -> doc_id, class_id, n_links, n_copies; one row for each row of docs.

    class_id: the least id among the documents reached over links (its own, without any; null where none has
    one); n_links: how many other rows are at least `threshold` similar, exact copies included; n_copies: rows
    with the same words, itself included. Empty or null texts have no words, so no links. Repeated rows, rows
    that share an id and rows without one are documents each. Texts may be of any length: a group's sets are
    dealt to blocks of about `block` texts and `block_grams` n-grams, and one longer text is a block by itself."""
    signed, known = _classes(docs, threshold, n, recall, block, block_grams)
    some = signed.where("n > 0")
    found = join_hubs(some, known, "key", "copies", some.count())
    none = signed.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    return found.select("doc_id", "class_id", F.col("links").cast("long").alias("n_links"), F.col("copies").cast("long").alias("n_copies")).unionByName(none)


def one_of_each(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, block: int = 192, block_grams: int = 1 << 20) -> DataFrame:
    """One row of each class, all columns as they were: the one of the least id (a missing id comes last), then of
    the least hash of its text; among rows equal in both any one. Texts without words stay, each row. A row is
    known by its id and its text, so texts that share an id have fates of their own."""
    signed, known = _classes(docs, threshold, n, recall, block, block_grams)
    who = [F.col("doc_id").isNull().alias("missing"), F.coalesce("doc_id", F.lit(0)).alias("id"), "raw"]
    rows = signed.where("n > 0").groupBy(*who).agg(F.count(F.lit(1)).alias("times"))
    best = known.groupBy("label").agg(F.min("first").alias("first")).select("first.missing", F.coalesce("first.doc_id", F.lit(0)).alias("id"), "first.raw", F.lit(True).alias("stays"))
    fate = written(rows.join(best, ["missing", "id", "raw"], "left").where("stays is null or times > 1"), "fate")
    prefix = "_kq"  # longer than every clashing name
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    keys = [f"{prefix}{i}" for i in range(3)]
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    tagged = docs.select("*", id_.isNull().alias(keys[0]), F.coalesce(id_, F.lit(0)).alias(keys[1]), F.xxhash64(text).alias(keys[2]))
    named = fate.toDF(*keys, f"{prefix}times", f"{prefix}stays")
    once = tagged.join(named.select(*keys), keys, "left_anti")
    repeated = named.where(F.col(f"{prefix}stays")).select(*keys)
    out = once.select(*(F.col(f"`{c}`") for c in docs.columns))
    if repeated.isEmpty():
        return out
    whole = F.first(F.struct(*(F.col(f"`{c}`") for c in docs.columns))).alias(f"{prefix}row")
    one = tagged.join(repeated, keys, "left_semi").groupBy(*keys).agg(whole)
    return out.unionByName(one.select(f"{prefix}row.*"))
