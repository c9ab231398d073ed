"""Nearest neighbours through stable projections and kd-trees.

Vectors are projected on a few Gaussian directions, a 2-stable law: the squared projected distance
of a pair is its squared distance times a chi-square variable. A kd-tree over the projections gives a
query's projected neighbours one by one in order of distance; each is verified on the original
vectors, and the search stops at the first one that fails the chi-square test: a vector nearer than
the k-th found would have shown up by now with the wanted probability. A true neighbour passes with
at least that probability, so it is also the recall to expect.

Vectors are dealt to cells by the upper splits of one kd-tree, fitted on a bounded sample; each cell
holds about `block` of them and its own tree, and every vector is in one. A query searches its own
cell first and takes its k-th best distance along to those other cells whose region passes the same
test, so near uniform vectors meet most cells and clustered ones few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written


def chi_square_cdf(x: float, degrees: int) -> float:
    """For even degrees, in closed form."""
    term = total = 1.0
    for i in range(1, degrees // 2):
        term *= x / 2 / i
        total += term
    return 1.0 - math.exp(-x / 2) * total if x < 1400 else 1.0


def chi_square_point(p: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, degrees) < p else (low, mid)
    return high


def axes(dim: int, dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, dims))


class KdTree:
    """Median splits along the widest side. Leaf i holds rows order[starts[i]:starts[i + 1]] in the box low[i] to
    high[i]; a row goes left of a split when it is not above it."""

    def __init__(self, points: np.ndarray, leaf: int = 32):
        order, edges, low, high = np.arange(len(points)), [0], [], []
        self.axis, self.value, self.child = [], [], []  # of a leaf: its number in child, axis -1
        stack = [(0, len(points), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            if parent >= 0:
                self.child[parent][side] = len(self.child)
            rows = order[a:b]
            box = points[rows]
            least, most = (box.min(0), box.max(0)) if b > a else (np.zeros(points.shape[1]),) * 2
            at = int((most - least).argmax())
            cut = float(np.partition(box[:, at], (b - a - 1) // 2)[(b - a - 1) // 2]) if b > a else 0.0
            left = box[:, at] <= cut
            if b - a <= leaf or not most[at] > cut:  # more than half are equal at the top: split below them
                below = box[:, at][box[:, at] < cut]
                if b - a <= leaf or not len(below):
                    self.axis.append(-1)
                    self.value.append(0.0)
                    self.child.append([len(low), len(low)])
                    edges.append(b)
                    low.append(least)
                    high.append(most)
                    continue
                cut = float(below.max())
                left = box[:, at] <= cut
            order[a:b] = np.concatenate([rows[left], rows[~left]])
            self.axis.append(at)
            self.value.append(cut)
            self.child.append([0, 0])
            mid = a + int(left.sum())
            node = len(self.child) - 1
            stack += [(mid, b, node, 1), (a, mid, node, 0)]  # left first, so leaves are in order
        self.order, self.starts, self.low, self.high = order, np.array(edges), np.array(low), np.array(high)

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        axis, value, child = np.array(self.axis), np.array(self.value), np.array(self.child)
        at = np.zeros(len(points), np.int64)
        inner = np.flatnonzero(axis[at] >= 0)
        while len(inner):
            node = at[inner]
            at[inner] = child[node, (points[inner, axis[node]] > value[node]).astype(int)]
            inner = inner[axis[at[inner]] >= 0]
        return child[at, 0]

    def regions(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of all points that leaf_of sends to each leaf, also of such as the tree wasn't fitted on."""
        low, high = np.full(self.low.shape, -np.inf), np.full(self.high.shape, np.inf)
        stack = [(0, np.full(self.low.shape[1], -np.inf), np.full(self.low.shape[1], np.inf))]
        while stack:
            node, a, b = stack.pop()
            at = self.axis[node]
            if at < 0:
                low[self.child[node][0]], high[self.child[node][0]] = a, b
                continue
            under, over = b.copy(), a.copy()
            under[at] = over[at] = self.value[node]
            stack += [(self.child[node][0], a, under), (self.child[node][1], over, b)]
        return low, high


def squared_bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of a point to each box."""
    out = np.maximum(np.maximum(low - q, q - high), 0)
    return np.einsum("ij,ij->i", out, out)


def distances(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    diff = vectors - q
    return np.sqrt((diff * diff).sum(1))


class Block:
    """Index of some vectors. Equal vectors are one point with its ids ascending."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dims: int, leaf: int = 64):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        unique, where = np.unique(vectors, axis=0, return_inverse=True)
        where = where.reshape(-1)
        by = np.argsort(where, kind="stable")
        found = np.split(ids[by], np.cumsum(np.bincount(where, minlength=len(unique)))[:-1])
        self.axes = axes(vectors.shape[1], dims)
        self.tree = KdTree(unique @ self.axes, leaf)
        self.vectors = unique[self.tree.order]
        self.projected = self.vectors @ self.axes
        self.ids = [np.unique(found[i]) for i in self.tree.order]
        self.verified = 0

    def neighbours(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(points, squared projected distances) in order of distance, in runs. Twice as many leaves are opened
        each time; points up to the bound of the next leaf are in their final order."""
        to, starts = q @ self.axes, self.tree.starts
        bound = squared_bounds(self.tree.low, self.tree.high, to)
        leaves = np.argsort(bound, kind="stable")
        rows, far, opened = np.zeros(0, np.int64), np.zeros(0), 0
        while opened < len(leaves) or len(rows):
            more = leaves[opened : opened + max(4, opened)]
            opened += len(more)
            if len(more):
                new = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in more])
                diff = self.projected[new] - to
                rows, far = np.concatenate([rows, new]), np.concatenate([far, np.einsum("ij,ij->i", diff, diff)])
            ready = far <= (bound[leaves[opened]] if opened < len(leaves) else np.inf)
            order = np.argsort(far[ready], kind="stable")
            yield rows[ready][order], far[ready][order]
            rows, far = rows[~ready], far[~ready]

    def search(self, q: np.ndarray, own: int | None, k: int, stop: float, worst: float = math.inf, first: int = 32, run: int = 256) -> list[tuple[float, int]]:
        """The k nearest found but those of the query's own id, none beyond `worst`. stop: the chi-square point of
        the test. An id counts once, at its nearest vector. Neighbours are tested by the k-th best before their
        run; runs begin with `first` and grow to `run`."""
        best: dict[int, float] = {}
        size = first
        for rows, far in self.neighbours(q):
            edges = [0]
            while edges[-1] < len(rows):
                edges.append(min(len(rows), edges[-1] + size))
                size = min(run, size + first)
            for a, end in zip(edges, edges[1:]):
                n = int(np.searchsorted(far[a:end], stop * worst * worst, "right")) if worst < math.inf else end - a
                part = rows[a : a + n]
                self.verified += len(part)
                d = distances(self.vectors[part], q)
                for i in np.flatnonzero(d <= worst):
                    x = float(d[i])
                    for v in self.ids[part[i]][: k + 1].tolist():
                        if v != own and x < best.get(v, math.inf):
                            best[v] = x
                if len(best) >= k:
                    best = dict(sorted(best.items(), key=lambda b: (b[1], b[0]))[:k])
                    worst = min(worst, max(best.values()))
                if n < end - a:
                    return sorted((x, v) for v, x in best.items())
        return sorted((x, v) for v, x in best.items())[:k]


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dim = batch.column("dim").to_numpy()
    for d in np.unique(dim):
        yield int(d), batch.filter(pa.array(dim == d))


_FOUND = "query_id long, key long, vec_id long, score double"


def _search(key, candidates: pa.Table, queries: pa.Table, k: int, dims: int, stop: float) -> pa.Table:
    out: list[tuple[int, int, int, float]] = []
    if candidates.num_rows and queries.num_rows:
        dim = key[1].as_py()
        block = Block(candidates.column("vec_id").to_numpy(), _matrix(candidates.column("embedding"), dim), dims)
        asked = zip(*(queries.column(c).to_pylist() for c in ("vec_id", "key", "worst")), _matrix(queries.column("embedding"), dim))
        for own, which, worst, q in asked:
            out += [(own, which, v, d) for d, v in block.search(q, own, k, stop, worst)]
    q, h, v, d = zip(*out) if out else ((), (), (), ())
    return pa.table({"query_id": pa.array(q, pa.int64()), "key": pa.array(h, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.float64())})


def _sampled(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part in _by_dim(batch):
            flat = (_matrix(part.column("embedding"), dim) @ axes(dim, dims)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(flat), dims).cast(pa.list_(pa.float64()))], names=["at"])


def _place(batches: Iterator[pa.RecordBatch], dims: int, tree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim, part in _by_dim(batch):
            cell = tree.value.leaf_of(_matrix(part.column("embedding"), dim) @ axes(dim, dims))
            yield part.append_column("cell", pa.array(cell, pa.int32()))


def _others(batches: Iterator[pa.RecordBatch], dims: int, regions, stop: float) -> Iterator[pa.RecordBatch]:
    """A row for each other cell that may hold a nearer vector."""
    low, high = regions.value
    for batch in batches:
        for dim, part in _by_dim(batch):
            worst, home = part.column("worst").to_numpy(), part.column("cell").to_numpy()
            rows, cells = [], []
            for i, q in enumerate(_matrix(part.column("embedding"), dim) @ axes(dim, dims)):
                at = np.flatnonzero(squared_bounds(low, high, q) <= stop * worst[i] * worst[i])
                at = at[at != home[i]]
                rows.append(np.full(len(at), i))
                cells.append(at)
                if sum(map(len, rows[-64:])) > 4096 or len(rows) >= 64:
                    yield _visits(part, rows, cells)
                    rows, cells = [], []
            if rows:
                yield _visits(part, rows, cells)


def _visits(part: pa.RecordBatch, rows: list[np.ndarray], cells: list[np.ndarray]) -> pa.RecordBatch:
    out = part.take(pa.array(np.concatenate(rows), pa.int64()))
    return out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(np.concatenate(cells), pa.int32()))


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    limit = F.lit(float("inf"))
    return embedding.isNotNull() & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)) & F.exists(embedding, lambda x: x != 0)


def _met(candidates: DataFrame, queries: DataFrame, per_task: int, **search) -> DataFrame:
    """Queries search the vectors of their cell; a cell with many queries is dealt to several tasks."""
    many = queries.groupBy("cell", "dim").agg(F.ceil(F.count(F.lit(1)) / per_task).cast("int").alias("many"))
    left = candidates.join(many, ["cell", "dim"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    right = queries.join(many, ["cell", "dim"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "key"), F.col("many")).cast("int"))
    keys = ("cell", "dim", "part")
    left, right = left.select(*keys, "vec_id", "embedding"), right.select(*keys, "vec_id", "key", "worst", "embedding")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(partial(_search, **search), _FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, dims: int = 16, probability: float = 0.95, block: int = 16384, most_cells: int = 65536, per_cell: int = 32, per_task: int = 4096) -> DataFrame:
    """vectors (vec_id, embedding) -> query_id, rank, vec_id, score: each query's k nearest found by
    Euclidean distance (all, if fewer), ties to the smaller id. A query meets vectors of its own
    dimension only. Rows with a null id take no part. Repeated rows count once; of rows that share an
    id but not the vector each is a query of its own, and as a candidate the id counts at its nearest vector.

    Every vector is indexed. The splits of the cells are fitted on about per_cell vectors for each cell,
    most_cells cells at most (which bounds what is sent to the driver and broadcast); with more than
    most_cells * block vectors the cells grow."""
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.groupBy("vec_id", "embedding").agg(F.max("asks").alias("asks"))
    rows = written(rows.select("vec_id", "embedding", "asks", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("key")), "vectors")
    n = rows.count()
    cells = min(most_cells, max(1, math.ceil(n / block)))
    projected = []
    if cells > 1:
        every = max(1, n // (per_cell * cells))
        picked = rows.where(F.pmod(F.xxhash64("key", "vec_id"), F.lit(every)) == 0).select("dim", "embedding")
        projected = picked.mapInArrow(partial(_sampled, dims=dims), "at array<double>").toArrow().column("at")
    points = _matrix(projected, dims) if len(projected) else np.zeros((1, dims))
    tree = KdTree(points, max(1, math.ceil(len(points) / cells)))
    shared = spark.sparkContext.broadcast(tree)
    placed = rows.mapInArrow(partial(_place, dims=dims, tree=shared), "vec_id long, embedding array<double>, asks boolean, dim int, key long, cell int")
    # of equal vectors no query can need more than the k + 1 with the smallest ids
    copy = F.row_number().over(Window.partitionBy("cell", "dim", "key", "embedding").orderBy("vec_id"))
    candidates = placed.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("vec_id", "embedding", "dim", "cell")
    candidates = written(candidates, "candidates")
    queries = written(placed.where("asks").select("vec_id", "key", "dim", "cell", "embedding", F.lit(math.inf).alias("worst")), "queries")
    stop = chi_square_point(probability, dims)
    found = written(_met(candidates, queries, per_task, k=k, dims=dims, stop=stop), "home")
    if len(tree.starts) > 2:
        reach = found.groupBy(F.col("query_id").alias("vec_id"), "key").agg(F.when(F.count(F.lit(1)) >= k, F.max("score")).otherwise(F.lit(math.inf)).alias("worst"))
        away = queries.drop("worst").join(reach, ["vec_id", "key"], "left").fillna(math.inf, ["worst"])
        regions = spark.sparkContext.broadcast(tree.regions())
        visits = away.select("vec_id", "key", "dim", "cell", "embedding", "worst").mapInArrow(partial(_others, dims=dims, regions=regions, stop=stop), queries.schema)
        found = found.unionByName(_met(candidates, written(visits, "visits"), per_task, k=k, dims=dims, stop=stop))
    forget(rows)
    found = found.groupBy("query_id", "key", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
