"""Language-model scores from a log-bilinear neural model.

A context of two words predicts a feature vector, the elementwise-weighted sum of its words' vectors;
a word's score is its product with the word's own vector, plus a bias. Training is noise-contrastive
estimation over every token of the training documents: each partition trains on its own documents
from one start, and the weights are averaged, a word's by its occurrences. The model's vocabulary is
every word above a count, so it grows with the corpus. Words are dealt by rank to classes, which have
vectors of their own: the probability of a token is that of its class among all classes times that of
the word among its class, both normalised exactly for each token, so token probabilities sum to 1.
Words below the count share the probability of <unk> by their add-one counts, which cover the
whole corpus and meet the documents' words in a shuffle.

Tokens: A-Z lower-cased, runs without ASCII white space, then one end, counted as a token. Words are
counted as they are; those of the model, and the frequent ones, are found by a 64-bit hash. Texts may be of
any length: a batch holds at least one whole text, and its memory is a fixed multiple of its words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, slices, texts, written
from .ngramjoin import word_hashes, word_spans

END = b"\n"  # no word holds white space


def tokens(text: str) -> list[bytes]:
    """bytes.lower and bytes.split know ASCII only, as wanted."""
    return [*text.encode().lower().split(), END]


# counts


def _count(batches: Iterator[pa.RecordBatch], flush: int) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c.keys()), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    seen: Counter = Counter()
    for batch in slices(batches, "text"):
        for t in texts(batch):
            seen.update(tokens(t))
        if len(seen) > flush:
            yield out(seen)
            seen = Counter()
    if seen:
        yield out(seen)


def word_counts(docs: DataFrame, flush: int = 300_000) -> DataFrame:
    """word, c over all documents; each task sums its own first."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(partial(_count, flush=flush), "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


# the model


def class_bounds(k: int, least: int = 32, width: float = 3.0) -> np.ndarray:
    """Where classes of words by rank begin, and k. Frequent words have small classes: width * sqrt(rank)."""
    out = [0]
    while out[-1] < k:
        out.append(min(k, out[-1] + max(least, int(width * out[-1] ** 0.5))))
    return np.array(out, np.int64)


def _log_softmax(q: np.ndarray, vectors: np.ndarray, bias: np.ndarray, at: np.ndarray, cells: int = 1 << 17) -> np.ndarray:
    """Log softmax of each row of q over vectors and bias, at one column; by blocks that stay in the cache."""
    out = np.empty(len(q))
    step = max(16, cells // len(bias))
    down, ones = np.ascontiguousarray(vectors.T), np.ones(len(bias), np.float32)
    # where no score can leave the range of exponentials, the largest need not be taken off
    safe = len(q) and np.sqrt(np.einsum("ij,ij->i", q, q).max() * np.einsum("ij,ij->i", vectors, vectors).max()) + np.abs(bias).max() < 60
    for a in range(0, len(q), step):
        b = slice(a, a + step)
        score = q[b] @ down
        score += bias
        if not safe:
            score -= score.max(1, keepdims=True)
        own = score[np.arange(len(score)), at[b]].astype(np.float64)
        out[b] = own - np.log(np.exp(score, out=score) @ ones)
    return out


class Model:
    """Vocabulary: word 0 is <unk>, word 1 the end, which also stands before a text; the others by rank."""

    def __init__(self, words: list[bytes], share: np.ndarray, dims: int = 16, seed: int = 5):
        self.words, self.counts, self.share, self.dims = words, share, share / share.sum(), dims
        rng = np.random.default_rng(seed)
        k = len(words)
        self.first = class_bounds(k)
        self.class_of = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        self.class_share = np.add.reduceat(self.share, self.first[:-1])
        self.weights = {
            "context": rng.standard_normal((k, dims), np.float32) * np.float32(0.1),
            "target": rng.standard_normal((k, dims), np.float32) * np.float32(0.1),
            "bias": np.log(self.share).astype(np.float32),
            "mix": np.ones((2, dims), np.float32),
            "class": rng.standard_normal((len(self.class_share), dims), np.float32) * np.float32(0.1),
            "class_bias": np.log(self.class_share).astype(np.float32),
        }

    def rows(self, at: np.ndarray) -> np.ndarray:
        """What belongs to words: their context and target vectors, and how far their bias went from its start."""
        w = self.weights
        return np.concatenate([w["context"][at], w["target"][at], (w["bias"][at] - np.log(self.share[at]))[:, None]], 1)

    def set_rows(self, at: np.ndarray, x: np.ndarray) -> None:
        w, d = self.weights, self.dims
        w["context"][at], w["target"][at], w["bias"][at] = x[:, :d], x[:, d : 2 * d], x[:, -1] + np.log(self.share[at])

    def flat(self) -> np.ndarray:
        """What all words share; the classes' biases as those of words."""
        w = self.weights
        return np.concatenate([w["mix"].reshape(-1), w["class"].reshape(-1), w["class_bias"] - np.log(self.class_share)])

    def set_flat(self, x: np.ndarray) -> None:
        at = 0
        for k in ("mix", "class", "class_bias"):
            w = self.weights[k]
            self.weights[k] = x[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        self.weights["class_bias"] += np.log(self.class_share).astype(np.float32)

    def predicted(self, c1: np.ndarray, c2: np.ndarray) -> np.ndarray:
        w = self.weights
        out, two = w["context"][c1], w["context"][c2]
        out *= w["mix"][0]
        two *= w["mix"][1]
        out += two
        return out

    def log_probability(self, c1: np.ndarray, c2: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Natural log; c1 is the nearer word. Normalised over all classes and over all words of the class."""
        w, kind = self.weights, self.class_of[word]
        order = np.argsort(kind.astype(np.uint16) if len(self.class_share) < 1 << 16 else kind, kind="stable")  # 16 bits sort by radix
        q, word, kind = self.predicted(c1[order], c2[order]), word[order], kind[order]
        found = _log_softmax(q, w["class"], w["class_bias"], kind)
        ends = np.cumsum(np.bincount(kind, minlength=len(self.class_share)))
        for k, (lo, hi) in enumerate(zip(self.first[:-1], self.first[1:])):
            b = slice(ends[k - 1] if k else 0, ends[k])
            if b.start < b.stop:
                found[b] += _log_softmax(q[b], w["target"][lo:hi], w["bias"][lo:hi], word[b] - lo)
        out = np.empty(len(word))
        out[order] = found
        return out


class Trainer:
    """Noise-contrastive estimation of words and of classes with noise shared by a batch, and Adagrad steps
    on the rows that a batch touches."""

    def __init__(self, model: Model, noise: int = 32, batch: int = 8192, rate: float = 0.05, seed: int = 9):
        self.m, self.noise, self.batch, self.rate = model, noise, batch, rate
        self.rng = np.random.default_rng(seed)
        self.shares = {"target": model.share, "class": model.class_share}
        self.log_noise = {k: np.log(noise * s).astype(np.float32) for k, s in self.shares.items()}
        self.cumulative = {k: np.cumsum(s) for k, s in self.shares.items()}
        self.past = {k: np.full(w.shape, 1e-2, np.float32) for k, w in model.weights.items()}

    def _update(self, name: str, at, g: np.ndarray, scale: float) -> None:
        g = (g * scale).astype(np.float32)
        past = self.past[name][at] + g * g
        self.past[name][at] = past
        np.sqrt(past, out=past)
        g *= self.rate
        g /= past
        self.m.weights[name][at] -= g

    def _contrast(self, name: str, bias: str, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list]:
        """The gradient of q, and the updates to make. at ascends."""
        w, n, log_noise, k = self.m.weights, len(at), self.log_noise[name], len(self.shares[name])
        noise = np.searchsorted(self.cumulative[name], self.rng.random(self.noise)).clip(0, k - 1)
        own, other = w[name][at], w[name][noise]
        up = 1 / (1 + np.exp(log_noise[at] - w[bias][at] - np.einsum("ij,ij->i", q, own))) - 1
        down = q @ other.T
        down += w[bias][noise] - log_noise[noise]
        np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.reciprocal(down, out=down)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        touched, g, g_bias = at[first], np.add.reduceat(up[:, None] * q, first), np.add.reduceat(up, first)
        # noise joins the words of the batch
        drawn, place = np.unique(noise, return_inverse=True)
        mine = (place == np.arange(len(drawn))[:, None]).astype(np.float32)
        g_drawn, g_drawn_bias = mine @ (down.T @ q), mine @ down.sum(0)
        where = np.searchsorted(touched, drawn)
        met = touched[np.minimum(where, len(touched) - 1)] == drawn
        g[where[met]] += g_drawn[met]
        g_bias[where[met]] += g_drawn_bias[met]
        touched = np.concatenate([touched, drawn[~met]])
        g, g_bias = np.concatenate([g, g_drawn[~met]]), np.concatenate([g_bias, g_drawn_bias[~met]])
        own *= up[:, None]
        own += down @ other
        return own, [(name, touched, g, k / n), (bias, touched, g_bias, 1 / n)]

    def step(self, c1: np.ndarray, c2: np.ndarray, word: np.ndarray) -> None:
        order = np.argsort(word)  # classes ascend with their words
        c1, c2, word = c1[order], c2[order], word[order]
        w, n = self.m.weights, len(word)
        one, two = w["context"][c1], w["context"][c2]
        q = one * w["mix"][0] + two * w["mix"][1]
        dq, updates = self._contrast("target", "bias", q, word)
        more, others = self._contrast("class", "class_bias", q, self.m.class_of[word])
        dq += more
        mix = np.stack([np.einsum("ij,ij->j", dq, one), np.einsum("ij,ij->j", dq, two)])
        at = np.concatenate([c1, c2])
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        g = np.add.reduceat(np.concatenate([dq * w["mix"][0], dq * w["mix"][1]])[order], first)
        for x in (*updates, *others, ("context", at[first], g, len(self.m.words) / n), ("mix", slice(None), mix, 1 / n)):
            self._update(*x)

    def run(self, words: np.ndarray, before: np.ndarray, before2: np.ndarray) -> None:
        for a in range(0, len(words), self.batch):
            b = slice(a, a + self.batch)
            self.step(before[b], before2[b], words[b])


def contexts(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The one and two words before each token; before a text stand ends. ends: where texts end, exclusive."""
    starts = np.concatenate([[0], ends[:-1]])
    one = np.concatenate([[1], ids[:-1]])
    two = np.concatenate([[1, 1], ids[:-2]])[: len(ids)]
    one[starts] = 1
    two[starts] = 1
    second = starts + 1
    two[second[second < ends]] = 1
    return one, two


class Index:
    """Numbers of words by their 64-bit hashes: sorted, and entered by their upper bits."""

    def __init__(self, words: list[bytes]):
        self.size = len(words)
        hashes, _ = word_hashes([b" ".join(words)])  # no word holds white space
        order = np.argsort(hashes)
        self.keys = np.append(hashes[order], np.uint64((1 << 64) - 1))
        self.number = np.append(order, self.size)
        self.shift = np.uint64(63 - max(1, self.size).bit_length())
        slots = np.arange(1 << (64 - int(self.shift)), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(self.keys, slots).astype(np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers; those of unknown words are the size."""
        at = self.start[hashes >> self.shift]
        key = self.keys[at]
        on = np.flatnonzero(key < hashes)
        while len(on):
            at[on] += 1
            key[on] = self.keys[at[on]]
            on = on[key[on] < hashes[on]]
        return np.where(key == hashes, self.number[at], self.size)


def _placed(found: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens from those of the words, an end after each text; and where texts end."""
    size = np.diff(at)
    out = np.full(len(found) + len(size), end, np.int64)
    out[np.arange(len(found)) + np.repeat(np.arange(len(size)), size)] = found
    return out, np.cumsum(size + 1)


def _lower(batch: pa.RecordBatch) -> list[bytes]:
    return [t.encode().lower() for t in texts(batch)]


#: Weights of words w with w % blocks == part; part -1: those that all words share. They travel as 16-bit numbers.
_WEIGHTS = "part int, ids binary, n binary, weights binary"


def _weights(part: int, ids: np.ndarray, n: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    columns = (ids.astype("<i4"), n.astype("<f4"), w.astype("<f2"))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["part", "ids", "n", "weights"])


def _blocks(words: int) -> int:
    return -(-words // 512)


def _train(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    m = Model(*shared.value)
    part = TaskContext.get().partitionId()
    trainer, index = Trainer(m, seed=part), Index(m.words[2:])
    seen = np.zeros(len(m.words), np.int64)
    for batch in slices(batches, "text", max_rows=1024, max_bytes=1 << 20):
        *_, hashes, at = word_spans(_lower(batch))
        found = index.find(hashes)
        ids, ends = _placed(np.where(found < index.size, found + 2, 0), at, 1)
        one, two = contexts(ids, ends)
        trainer.run(ids, one, two)
        seen += np.bincount(ids, minlength=len(seen))
    if seen.any():
        blocks = _blocks(len(seen))
        for k in range(blocks):
            ids = np.arange(k, len(seen), blocks)
            ids = ids[seen[ids] > 0]
            if len(ids):
                yield _weights(k, ids, seen[ids], m.rows(ids))
        yield _weights(-1, np.zeros(1), seen.sum(keepdims=True), m.flat())


def _average(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    blocks = _blocks(words)
    for batch in batches:
        for part, ids, n, w in zip(*(c.to_pylist() for c in batch.columns)):
            ids, n = np.frombuffer(ids, "<i4"), np.frombuffer(n, "<f4").astype(np.float64)
            w = np.frombuffer(w, "<f2").astype(np.float64).reshape(len(ids), -1)
            at = ids // blocks
            if part not in sums:
                size = -(-words // blocks) if part >= 0 else 1
                sums[part] = np.zeros((size, w.shape[1])), np.zeros(size)
            sums[part][0][at] += w * n[:, None]
            sums[part][1][at] += n
    for part, (w, n) in sums.items():
        at = np.flatnonzero(n)
        yield _weights(part, at * blocks + max(part, 0), n[at], w[at] / n[at, None])


def least_count(n_tokens: int) -> int:
    """How often a word of the model is seen: five times, and more often from 25 million tokens on, as the
    root of their number, so the vocabulary grows with the corpus but every worker can hold the model."""
    return max(5, int(n_tokens**0.5 / 1000))


def train(docs: DataFrame, counts: DataFrame, n_tokens: int, size: int | None = None, dims: int = 16) -> Model:
    """docs: the training documents. The vocabulary is all words of least_count, or the size - 2 most frequent.
    Weights meet by blocks of words; the driver gets one average of each block."""
    spark = docs.sparkSession
    plain = counts.where(F.col("word") != F.lit(END))
    if size is None:
        top = plain.where(F.col("c") >= least_count(n_tokens)).toArrow()
    else:
        top = plain.orderBy(F.desc("c"), "word").limit(size - 2).toArrow()
    top = top.sort_by([("c", "descending"), ("word", "ascending")])
    times = top.column("c").to_numpy()
    ends = n_tokens and counts.where(F.col("word") == F.lit(END)).first().c
    words = [b"", END, *top.column("word").to_pylist()]
    share = np.concatenate([[max(1, n_tokens - ends - int(times.sum())), max(1, ends)], times]).astype(np.float64)
    model = Model(words, share, dims)
    shared = spark.sparkContext.broadcast((words, share, dims))
    trained = docs.select(F.col("text").cast("string")).mapInArrow(partial(_train, shared=shared), _WEIGHTS)
    for r in trained.repartition("part").mapInArrow(partial(_average, words=len(words)), _WEIGHTS).toLocalIterator():
        ids = np.frombuffer(r.ids, "<i4")
        w = np.frombuffer(r.weights, "<f2").reshape(len(ids), -1)
        if r.part < 0:
            model.set_flat(w[0])
        else:
            model.set_rows(ids, w)
    return model


# scores

_SCORED = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:binary,n:long>>"


def _score(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model, head, count, end_count, to_model, n_all, v_all, n_rest, v_rest = shared.value
    # frequent words: number, add-one log count, model word; the last two numbers: all others, and the end
    index = Index(head)
    log_count = np.append(np.log10(count + 1), [0.0, np.log10(end_count + 1)])
    known = np.append(np.ones(len(head), np.int64), [0, int(end_count > 0)])
    other, end = len(head), len(head) + 1
    base_down, rest_down = np.log10(n_all + v_all + 1), np.log10(n_rest + v_rest + 1)
    row, names = TaskContext.get().partitionId() << 40, [x.split()[0] for x in _SCORED.split(", ")]
    for batch in slices(batches, "text", max_rows=1024, max_bytes=1 << 20):
        joined, first, after, hashes, at = word_spans(_lower(batch))
        found = index.find(hashes)
        ids, ends = _placed(found, at, end)
        starts = np.concatenate([[0], ends[:-1]])
        words = to_model[ids]
        one, two = contexts(words, ends)
        logp = model.log_probability(one, two, words) / np.log(10)
        counted = log_count[ids]
        outside = words == 0
        score = np.add.reduceat(logp + np.where(outside, counted - rest_down, 0.0), starts)
        base = np.add.reduceat(counted - base_down, starts)
        n = batch.num_rows
        rare = np.flatnonzero(found == other)
        many = Counter(zip((np.searchsorted(at, rare, "right") - 1).tolist(), (joined[a:b] for a, b in zip(first[rare].tolist(), after[rare].tolist()))))
        some = sorted(many)
        whose = np.fromiter((i for i, _ in some), np.int64, len(some))
        lists = pa.array(np.searchsorted(whose, np.arange(n + 1)), pa.int32())
        pairs = pa.StructArray.from_arrays([pa.array([w for _, w in some], pa.binary()), pa.array([many[x] for x in some], pa.int64())], names=["word", "n"])
        columns = [pa.array(np.arange(row, row + n)), batch.column("doc_id"), pa.array(ends - starts), pa.array(np.add.reduceat(known[ids], starts)), pa.array(base), pa.array(score)]
        yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(lists, pairs)], names=names)
        row += n


def scores(docs: DataFrame, held_out_of: int = 7, held_out: int = 2, size: int | None = None, head_words: int = 100_000) -> DataFrame:
    """docs (doc_id, text; null text counts as empty) -> doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. Training leaves out documents whose crc32(doc_id) modulo held_out_of is held_out.
    Rows stay one for one, also where ids repeat; without training documents every count is 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = id_bucket(F.col("doc_id"), held_out_of) == held_out
    training = rows.where(~out)
    counts = written(word_counts(training), "counts")
    n_all, v_all = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n_ends = (counts.where(F.col("word") == F.lit(END)).first() or (END, 0))[1]
    model = train(training, counts, n_all, size)
    if len(model.words) > head_words:
        head, count, inside = model.words[2:], model.counts[2:], model.counts[1:]
        to_model = np.arange(2, len(model.words))
    else:
        # only words about as frequent as the last one wanted meet for the ranking, so tasks send few rows
        least = 0
        if v_all > head_words:
            least = counts.agg(F.percentile_approx("c", 1 - head_words / v_all, 100_000)).first()[0] - 1
        plain = counts.where(F.col("word") != F.lit(END))
        found = plain.where(F.col("c") > least).orderBy(F.desc("c"), "word").limit(head_words).toArrow()  # bounded by head_words
        head, count = found.column("word").to_pylist(), found.column("c").to_numpy()
        mine = {w: i for i, w in enumerate(model.words)}
        to_model = np.array([mine.get(w, 0) for w in head], np.int64)
        inside = np.append(count[to_model > 0], n_ends) if n_ends else count[to_model > 0]
    model.words = []  # from here on words are known by number
    shared = spark.sparkContext.broadcast((model, head, count, n_ends, np.append(to_model, [0, 1]), n_all, v_all, n_all - int(inside.sum()), v_all - len(inside)))
    scored = written(rows.mapInArrow(partial(_score, shared=shared), _SCORED), "scored")
    rare = scored.select("row", F.explode("rare").alias("w")).select("row", "w.word", "w.n").join(counts, "word", "left")
    log_count = F.log10(F.coalesce("c", F.lit(0)) + 1) * F.col("n")
    rare = rare.select("row", log_count.alias("more"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"))
    whole = scored.select("row", "doc_id", "n_tokens", F.col("n_known").alias("known"), "base", "score", F.lit(0.0).alias("more"))
    # a document's own row and its rare words' meet in one aggregation
    sums = whole.unionByName(rare, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *(F.sum(c).alias(c) for c in ("n_tokens", "known", "base", "score", "more")))
    return sums.select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more")).alias("base_score"),
        (F.col("score") + F.col("more")).alias("score"),
    )
