"""Connected components of an edge table, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, join_hubs, written


def _state(edges: DataFrame) -> tuple[int, int, int]:
    r = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.sum(F.crc32(F.concat_ws(",", "u", "v").cast("binary"))), F.lit(0))).first()
    return r[0], int(r[1]), int(r[2])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (u, v) of integers -> node, label: the least node that each node reaches. Nodes without an
    edge to another have no row. Alternating large-star and small-star steps; each links nodes to
    minima that aggregation finds, and a hub's edges meet its minimum by broadcast of the hubs, so
    they never gather in one task. Each round is written, which cuts lineage, and the tables of the
    round before are removed; rounds are logarithmic in practice."""
    edges = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = written(edges, "edges")
    state = _state(edges)
    for _ in range(rounds):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")).select("u", F.least("u", "m").alias("m"), "many"), "least")
        # large star: each node's larger neighbours link to its least neighbour
        large = join_hubs(both.where("v > u"), least, "u", "many", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        # small star: each node's smaller neighbours, and itself, link to the least of them
        low = written(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("many")), "low")
        small = join_hubs(large, low, "u", "many", state[0]).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before, edges = edges, written(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        now = _state(edges)
        forget(before, least, large, low)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    labels = edges.groupBy("u").agg(F.min("v").alias("label"))
    roots = labels.select(F.col("label").alias("node"), "label").distinct()
    return labels.select(F.col("u").alias("node"), "label").unionByName(roots)
