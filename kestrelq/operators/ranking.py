"""Vector search and hybrid ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors

_MEASURES = {"cosine": (vectors.cosine_distance, True), "l2": (vectors.l2, True), "l1": (vectors.l1, True), "dot": (vectors.dot, False)}


def nearest(table: DataFrame, query: list[float], k: int = 10, measure: str = "cosine", id_: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """id, distance of the k best, exactly; the filter runs before the ranking, so k come if k exist. Each task
    keeps its own k."""
    f, ascending = _MEASURES[measure]
    rows = table if where is None else table.where(where)
    d = f(F.col(vector), F.array(*(F.lit(float(x)) for x in query))).alias("distance")
    out = rows.where(F.size(vector) == len(query)).select(id_, d)
    return out.orderBy(F.col("distance").asc() if ascending else F.col("distance").desc(), id_).limit(k)


def nearest_each(table: DataFrame, is_query: Column, k: int = 10, id_: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """query_id, id, distance, rank: the k nearest of each query but itself, exactly, by Euclidean distance.
    Candidates and queries are dealt to blocks; each pair of blocks is a task that keeps k rows a query."""
    rows = table.where(F.col(vector).isNotNull() & F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("i"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("q"))
    asked = rows.where("q").agg(F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-asked // block))
    pieces = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = F.size("v").alias("width")
    deal = lambda n, salt: F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    ours = rows.select(deal(pieces, 1).alias("c"), each(blocks).alias("b"), width, "i", "v")
    theirs = rows.where("q").select(each(pieces).alias("c"), deal(blocks, 2).alias("b"), width, "i", "v")

    def meet(key, found: pa.Table, queries: pa.Table) -> pa.Table:
        none = ([], [], [])
        parts = [none]
        if found.num_rows and queries.num_rows:
            read = lambda t: np.array(t.column("v").to_pylist(), np.float64)
            ids, points = found.column("i").to_numpy(), read(found)
            for own, q in zip(queries.column("i").to_pylist(), read(queries)):
                d = np.sqrt(((points - q) ** 2).sum(1))
                near = [j for j in np.lexsort((ids, d))[: k + 1] if ids[j] != own][:k]
                parts.append(([own] * len(near), ids[near].tolist(), d[near].tolist()))
        q, i, d = (sum((p[n] for p in parts), []) for n in range(3))
        return pa.table({"query_id": pa.array(q, pa.int64()), "i": pa.array(i, pa.int64()), "distance": pa.array(d, pa.float64())})

    keys = ("c", "b", "width")
    met = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInArrow(meet, "query_id long, i long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "i"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("i").alias(id_), "distance", "rank")


def reciprocal_rank(lists: list[DataFrame], id_: str, constant: int = 60) -> DataFrame:
    """lists: (id, position from 1), each bounded. Sum of 1 / (constant + position)."""
    parts = [x.select(id_, (1.0 / (constant + F.col("position"))).alias("s")) for x in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(id_).agg(F.sum("s").alias("score"))


def _whole(name: str):
    """An aggregate over a short list, which is one partition already."""
    return getattr(F, name)("score").over(Window.partitionBy(F.lit(1)))


def scaled(scores: DataFrame, id_: str, score: str) -> DataFrame:
    """Scores mapped to 0..1 by their least and greatest; 1 where all are alike. The list is read once."""
    x = scores.select(id_, F.col(score).alias("score"))
    low, high = _whole("min"), _whole("max")
    return x.select(id_, F.when(high - low > 1e-12, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)).alias("s"))


def minmax(vector_scores: DataFrame, word_scores: DataFrame, id_: str, weight: float = 0.35) -> DataFrame:
    """weight of the vector side; a side without the row counts 0. origin: vector, lexical or both."""
    v = scaled(vector_scores, id_, "score").withColumnRenamed("s", "v")
    w = scaled(word_scores, id_, "score").withColumnRenamed("s", "w")
    both = v.join(w, id_, "full")
    origin = F.when(F.col("v").isNull(), "lexical").when(F.col("w").isNull(), "vector").otherwise("both")
    score = weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("w", F.lit(0.0))
    return both.select(id_, score.alias("score"), origin.alias("origin"))


def capped(ranked: DataFrame, group: str, score: str, id_: str, most: int = 2) -> DataFrame:
    """At most `most` rows of each group, best first."""
    w = Window.partitionBy(group).orderBy(F.desc(score), id_)
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def convex(vector_scores: DataFrame, word_scores: DataFrame, id_: str, weight: float = 0.35) -> DataFrame:
    """Each side divided by its greatest score; a side without the row counts 0."""

    def part(x: DataFrame, name: str) -> DataFrame:
        top = _whole("max")
        return x.select(id_, F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0)).alias(name))

    both = part(vector_scores, "v").join(part(word_scores, "w"), id_, "full")
    return both.select(id_, (weight * F.coalesce("v", F.lit(0.0)) + (1 - weight) * F.coalesce("w", F.lit(0.0))).alias("score"))


def confidence(cosine: Column, bm25: Column, ceiling: Column, weight: float = 0.35) -> Column:
    """On an absolute scale: cosine and the share of the greatest possible word score, both held to 0..1.
    A missing side counts 0, and so do words that no document has."""
    held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))
    return weight * held(cosine) + (1 - weight) * held(F.when(ceiling > 0, bm25 / ceiling))


def diversified(candidates: DataFrame, group: str, id_: str, score: str, vector: str, k: int = 10, balance: float = 0.7, most: int = 100) -> DataFrame:
    """group, id, rank: maximal marginal relevance. The `most` best of a group are cut by score first, then
    each pick has the greatest balance * score - (1 - balance) * cosine to the nearest picked; ties to
    the smaller id. Candidates are few for each group, as a search returned them."""
    w = Window.partitionBy(group).orderBy(F.desc(score), id_)
    cut = candidates.where(F.col(vector).isNotNull()).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most)
    rows = cut.select(F.col(group).alias("g"), F.col(id_).cast("long").alias("i"), F.col(score).cast("double").alias("s"), F.col(vector).cast("array<double>").alias("v"))

    def pick(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        v = np.array(table.column("v").to_pylist(), np.float64)
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
        s = table.column("s").to_numpy()
        picked: list[int] = []
        closest, free = np.zeros(len(s)), np.ones(len(s), bool)
        for _ in range(min(k, len(s))):
            worth = balance * s - (1 - balance) * closest
            best = int(np.where(free, worth, -np.inf).argmax())
            free[best] = False
            sims = v @ v[best]
            closest = np.maximum(closest, sims) if picked else sims
            picked.append(best)
        out = table.select(["g", "i"]).take(pa.array(picked, pa.int64()))
        return out.append_column("rank", pa.array(range(1, len(picked) + 1), pa.int32()))

    kind = rows.schema["g"].dataType.simpleString()
    found = rows.groupBy("g").applyInArrow(pick, f"g {kind}, i long, rank int")
    return found.select(F.col("g").alias(group), F.col("i").alias(id_), "rank")


def theoretical(vector_scores: DataFrame, word_scores: DataFrame, id_: str, ceiling: float, weight: float = 0.35) -> DataFrame:
    """Each side divided by a bound that no result has a say in: a cosine held to 0..1, words by the greatest score
    that the query could have (0 where no document has its words)."""
    both = vector_scores.select(id_, F.col("score").alias("v")).join(word_scores.select(id_, F.col("score").alias("w")), id_, "full")
    return both.select(id_, confidence(F.col("v"), F.col("w"), F.lit(float(ceiling)), weight).alias("score"))


def separation(scores: DataFrame, name: str = "separation") -> DataFrame:
    """One row: how far the best of a list's scores stands above the mean of the others, as a share of it, from 0 to
    1; 0 for lists of fewer than two, and where the best isn't positive."""
    first, n = F.max("score"), F.count("score")
    rest = (F.sum("score") - first) / (n - 1)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (first - rest) / first))
    return scores.agg(F.coalesce(F.when((n >= 2) & (first > 1e-7), share), F.lit(0.0)).alias(name))


def adaptive_weight(vector_separation: Column, word_separation: Column, unknown_share: Column, identifier_share: Column, coverage: Column, base: float = 0.35, gains: tuple[float, float, float, float] = (0.1, 0.1, 0.1, 0.1), low: float = 0.05, high: float = 0.95) -> Column:
    """The vector side's weight for one query: more for words that no document has and for a vector list whose best
    stands out further; less for words that look like identifiers and for a best text that has all the words.
    gains: of unknown words, identifiers, separation, coverage."""
    w = base + gains[0] * unknown_share - gains[1] * identifier_share + gains[2] * (vector_separation - word_separation) - gains[3] * coverage
    return F.greatest(F.lit(low), F.least(F.lit(high), w))


def reranked(hits: DataFrame, score: Column, id_: str, k: int | None = None) -> DataFrame:
    """hits ordered anew by another score, such as a cross-encoder's as a pandas UDF; ties to the smaller id."""
    out = hits.withColumn("score", score).orderBy(F.desc("score"), id_)
    return out if k is None else out.limit(k)


def one_sided(id_: str, vector_scores: DataFrame | None = None, word_scores: DataFrame | None = None, ceiling: float = 0.0, weight: float = 0.35) -> DataFrame:
    """id, confidence for a query of words, of a vector, or of both: a side that is absent counts 0."""
    if vector_scores is None and word_scores is None:
        raise ValueError("a query needs words or a vector")
    none = (vector_scores if vector_scores is not None else word_scores).limit(0)
    found = theoretical(vector_scores if vector_scores is not None else none, word_scores if word_scores is not None else none, id_, ceiling, weight)
    return found.withColumnRenamed("score", "confidence")


def exact_first(passing: int, total: int, width: int = 16, effort: int = 40) -> bool:
    """Whether a filtered search should measure all passing rows rather than ask an index: when they are 1,000 or
    fewer, or fewer than the root of what a search of the index touches times the rows."""
    return passing <= 1000 or passing < (effort * 2 * width * total) ** 0.5


def int8_rescored(rows: DataFrame, query: list[float], k: int, id_: str = "vec_id", vector: str = "embedding", wide: int = 4) -> DataFrame:
    """id, distance: cosine distance on components of 8 bits picks wide * k rows, exact distances order them."""
    short = rows.select(id_, vector, vectors.int8(F.col(vector)).alias("_short"))
    top = max(map(abs, query)) or 1.0
    coarse = vectors.cosine_distance(F.col("_short"), F.array(*(F.lit(float(round(x * 127 / top))) for x in query)))
    picked = short.where(F.col(vector).isNotNull()).orderBy(coarse, id_).limit(wide * k)
    exact = vectors.cosine_distance(F.col(vector), F.array(*map(F.lit, map(float, query))))
    return picked.select(id_, exact.alias("distance")).orderBy("distance", id_).limit(k)
