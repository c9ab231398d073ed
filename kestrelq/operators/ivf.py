"""Inverted lists of vectors: centroids from a bounded sample, every vector in the list of its nearest.

The index is a table with a list number, written partitioned by it, so a probe reads only its lists.
Candidates of the probed lists are ranked exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranking


def sample(table: DataFrame, rows: int, id_: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """At most that many vectors, the first by a hash of the id."""
    found = table.where(F.col(vector).isNotNull()).orderBy(F.xxhash64(F.col(id_)), id_).limit(rows).select(vector).collect()
    return np.array([r[0] for r in found], np.float64)


def train(table: DataFrame, lists: int, per_list: int = 256, rounds: int = 12, id_: str = "vec_id", vector: str = "embedding") -> np.ndarray:
    """Centroids (lists, width). The sample has at most lists * per_list rows, the first by a hash of the id."""
    points = sample(table, lists * per_list, id_, vector)
    if not len(points):
        raise ValueError("no vectors to learn from")
    centres = points[:: max(1, len(points) // lists)][:lists].copy()
    for _ in range(rounds):
        owner = nearest_list(points, centres)
        for k in np.unique(owner):  # an empty list keeps its centre
            centres[k] = points[owner == k].mean(0)
    return centres


def nearest_list(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * points @ centres.T).argmin(1)


def enough_probes(points: np.ndarray, centres: np.ndarray, query: list[float], k: int = 10, recall: float = 0.95, asked: int = 64) -> int:
    """The fewest lists to probe so that both the query and, on average, `asked` of the points find that share
    of their k nearest points; all lists, if no fewer do."""
    owner = nearest_list(points, centres)
    need = []  # for each query the probe that finds each neighbour, from 1
    for q in np.vstack([np.array(query, np.float64), points[:asked]]):
        near = ((points - q) ** 2).sum(1).argsort(kind="stable")[:k]
        place = ((centres - q) ** 2).sum(1).argsort(kind="stable").argsort()
        need.append(place[owner[near]] + 1)
    for probes in range(1, len(centres)):
        found = [(n <= probes).mean() for n in need]
        if found[0] >= recall and np.mean(found[1:]) >= recall:
            return probes
    return len(centres)


def assigned(table: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """The table and `list` (null where the vector is null or of another width). One pass, no shuffle."""
    width = centres.shape[1]

    @F.pandas_udf("int")
    def where(found):
        fits = np.array([v is not None and len(v) == width for v in found], bool)
        out = np.full(len(found), -1, np.int32)
        if fits.any():
            out[fits] = nearest_list(np.array(list(found[fits]), np.float64), centres)
        return found.__class__(out)

    return table.withColumn("list", F.nullif(where(F.col(vector)), F.lit(-1)))


def search(index: DataFrame, centres: np.ndarray, query: list[float], k: int = 10, probes: int = 4, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, distance of the k nearest in the lists nearest to the query; with all lists probed, exact."""
    near = ((centres - np.array(query)) ** 2).sum(1).argsort(kind="stable")[:probes].tolist()
    return ranking.nearest(index, query, k, "l2", id_, vector, where=F.col("list").isin(near))
