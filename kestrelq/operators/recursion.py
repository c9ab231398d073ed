"""Recursive queries whose UNION removes duplicates, so cycles end."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoints(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder: the one that spark.checkpoint.dir names, which a cluster
    must set; on one machine a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="kestrelq-"))


def _new(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows that aren't among the found ones; nulls are alike."""
    known = found.toDF(*(f"_f{i}" for i in range(len(found.columns))))
    on = [rows[c].eqNullSafe(known[f"_f{i}"]) for i, c in enumerate(rows.columns)]
    return rows.join(known, on, "left_anti")


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 1000) -> DataFrame:
    """Rows reachable from seed: step sees the new rows of the last round only (semi-naive). Each round's new
    rows are checkpointed, which cuts lineage; all found rows are brought together every few rounds."""
    checkpoints(seed.sparkSession)
    parts = int(seed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = fresh = seed.distinct().checkpoint()
    for i in range(rounds):
        fresh = _new(step(fresh).toDF(*found.columns).distinct(), found).checkpoint()
        if fresh.isEmpty():
            return found
        found = found.unionByName(fresh)
        if i % 4 == 3:
            found = found.coalesce(parts).checkpoint()
    raise RuntimeError("the recursion did not end")


def rounds(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None = None, most: int = 1000) -> DataFrame:
    """UNION ALL recursion: every round's rows with their number in `_round`, until a round is empty. With a limit,
    until that many rows are found (an outer LIMIT ends the recursion): rows come round by round, and the last
    round is cut to the first ones by their values. step may use its rows more than once."""
    checkpoints(seed.sparkSession)
    found = fresh = seed.withColumn("_round", F.lit(0)).checkpoint()
    have = found.count() if limit is not None else 0
    for i in range(1, most):
        if limit is not None and have >= limit:
            break
        fresh = step(fresh.drop("_round")).toDF(*seed.columns).withColumn("_round", F.lit(i)).checkpoint()
        new = fresh.count()
        if not new:
            break
        have += new
        found = found.unionByName(fresh)
    else:
        raise RuntimeError("the recursion did not end")
    return found if limit is None else found.orderBy("_round", *seed.columns).limit(limit)


def tree_order(nodes: DataFrame, id_: str, parent: str, order: str, depth_first: bool = True) -> DataFrame:
    """id, depth, position of all nodes below the roots (a null parent): the order in which a queue sorted by depth
    gives them, deepest first or, breadth first, nearest first; siblings by `order`, then id."""
    base = nodes.select(F.col(id_).alias("id"), F.col(parent).alias("parent"), F.col(order).alias("by"))
    path = lambda *before: F.concat(*before, F.array(F.struct("by", "id")))
    seed = base.where("parent is null").select("id", path().alias("path"))
    below = base.where("parent is not null")
    step = lambda d: d.select(F.col("id").alias("_up"), F.col("path").alias("_path")).join(below, F.col("_up") == F.col("parent")).select("id", path(F.col("_path")).alias("path"))
    found = rounds(seed, step).select("id", F.col("_round").alias("depth"), "path")
    by = ["path"] if depth_first else ["depth", F.element_at("path", -1)]
    return found.select("id", "depth", F.row_number().over(Window.orderBy(*by)).alias("position"))
