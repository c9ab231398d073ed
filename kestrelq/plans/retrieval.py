"""Keyword search, vector search, hybrid ranking, chunking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import chunking, fulltext, ivf, ranking, stemming
from .registry import query

_TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
_LINE = f"(' ' || array_to_string({_TERMS}, ' ') || ' ')"
QUERY_VECTOR = [(-1) ** i * (i % 7 + 1) / 8 for i in range(64)]
_Q = "([" + ", ".join(f"{x}::DOUBLE" for x in QUERY_VECTOR) + "])"
_E = "(embedding::DOUBLE[])"


@query("fts_vocab", f"SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term", "documents")
def _vocab(documents):
    return fulltext.vocabulary(documents)


@query("fts_bm25", f"""
WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'the')) AS f0, len(list_filter(w, lambda x: x = 'les')) AS f1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM d)
SELECT doc_id, round(-(greatest(ln((docs - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean))
  + greatest(ln((docs - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
FROM d, s WHERE f0 > 0 OR f1 > 0""", "documents")
def _bm25(documents):
    return fulltext.bm25(documents, ["the", "les"]).withColumn("score", F.round("score", 6))


@query("fts_boolean", f"SELECT doc_id FROM documents WHERE (contains({_LINE}, ' the ') AND contains({_LINE}, ' was ') AND NOT contains({_LINE}, ' by ')) OR contains({_LINE}, ' der ')", "documents")
def _boolean(documents):
    return fulltext.search(documents, "the was NOT by OR der").select("doc_id")


@query("fts_phrase", f"SELECT doc_id FROM documents WHERE contains({_LINE}, ' of the ') AND contains({_LINE}, ' tion')", "documents")
def _phrase(documents):
    return fulltext.search(documents, '"of the" AND tion*').select("doc_id")


@query("fts_near", f"SELECT doc_id FROM documents WHERE regexp_matches({_LINE}, ' was (?:\\S+ ){{0,2}}for ') OR regexp_matches({_LINE}, ' for (?:\\S+ ){{0,2}}was ')", "documents")
def _near(documents):
    return fulltext.search(documents, "NEAR(was for, 2)").select("doc_id")


@query("fts_highlight", "SELECT item_id, regexp_replace(text, '\\b(the)\\b', '[\\1]', 'gi') AS marked FROM benchmark", "benchmark")
def _highlight(benchmark):
    return benchmark.select("item_id", fulltext.highlight(F.col("text"), "the").alias("marked"))


@query("fts_facets", f"SELECT lang, source, count(*) AS n FROM documents WHERE contains({_LINE}, ' the ') GROUP BY lang, source", "documents")
def _facets(documents):
    return fulltext.search(documents, "the").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("chunk_documents", None, "documents")
def _chunk(documents):
    return chunking.chunk_text(documents, size=900, overlap=90)


def _topk(name: str, measure: str, distance: str, order: str = "ASC") -> None:
    @query(name, f"SELECT vec_id, round({distance}, 6) AS distance FROM embeddings ORDER BY {distance} {order}, vec_id LIMIT 10", "embeddings")
    def run(embeddings):
        return ranking.nearest(embeddings, QUERY_VECTOR, 10, measure).withColumn("distance", F.round("distance", 6))


_topk("vec_cosine_topk", "cosine", f"1 - list_cosine_similarity({_E}, {_Q})")
_topk("vec_l2_topk", "l2", f"list_distance({_E}, {_Q})")
_topk("vec_ip_topk", "dot", f"list_dot_product({_E}, {_Q})", "DESC")
_topk("vec_l1_topk", "l1", f"list_sum(list_transform(list_zip({_E}, {_Q}), lambda p: abs(p[1] - p[2])))")


@query("vec_filtered_topk", f"SELECT vec_id, round(list_distance({_E}, {_Q}), 6) AS distance FROM embeddings WHERE label = 3 ORDER BY list_distance({_E}, {_Q}), vec_id LIMIT 10", "embeddings")
def _filtered(embeddings):
    return ranking.nearest(embeddings, QUERY_VECTOR, 10, "l2", where=F.col("label") == 3).withColumn("distance", F.round("distance", 6))


@query("vec_functions", f"SELECT vec_id, len(embedding) AS dims, round(sqrt(list_dot_product({_E}, {_E})), 6) AS norm, round({_E}[1] + {_Q}[1], 6) AS s1, len(list_filter(embedding, lambda x: x > 0)) AS positive FROM embeddings", "embeddings")
def _functions(embeddings):
    e, q = F.col("embedding"), F.array(*map(F.lit, QUERY_VECTOR))
    return embeddings.select("vec_id", vectors.dims(e).cast("long").alias("dims"), F.round(vectors.norm(e), 6).alias("norm"), F.round(vectors.add(e, q)[0], 6).alias("s1"), F.size(F.filter(vectors.bits(e), lambda x: x == 1)).cast("long").alias("positive"))


@query("vec_avg_by_label", "SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i", "embeddings")
def _average(embeddings):
    rows = embeddings.select("label", F.posexplode(vectors.doubles(F.col("embedding"))).alias("p", "x"))
    return rows.groupBy("label", (F.col("p") + 1).cast("long").alias("i")).agg(F.round(F.avg("x"), 6).alias("m"))


@query("vec_matryoshka", f"SELECT vec_id FROM embeddings ORDER BY 1 - list_cosine_similarity({_E}[1:16], {_Q}[1:16]), vec_id LIMIT 10", "embeddings")
def _matryoshka(embeddings):
    short = embeddings.select("vec_id", vectors.truncated(F.col("embedding"), 16).alias("embedding"))
    return ranking.nearest(short, QUERY_VECTOR[:16], 10, "cosine").select("vec_id")


def _sides(documents, embeddings):
    words = fulltext.bm25(documents, ["les", "der"]).withColumn("score", -F.round("score", 9)).orderBy(F.desc("score"), "doc_id").limit(50)
    near = ranking.nearest(embeddings, QUERY_VECTOR, 50, "cosine").select(F.col("vec_id").alias("doc_id"), (1 - F.round("distance", 9)).alias("score"))
    return near, words


_SIDES = f"""
WITH t AS (SELECT doc_id, {_TERMS} AS w FROM documents),
d AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'les')) AS f0, len(list_filter(w, lambda x: x = 'der')) AS f1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM d),
l AS (SELECT doc_id, round(greatest(ln((docs - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean))
  + greatest(ln((docs - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean)), 9) AS score
  FROM d, s WHERE f0 > 0 OR f1 > 0 ORDER BY score DESC, doc_id LIMIT 50),
v AS (SELECT vec_id AS doc_id, 1 - round(1 - list_cosine_similarity({_E}, {_Q}), 9) AS score FROM embeddings ORDER BY 1 - list_cosine_similarity({_E}, {_Q}), vec_id LIMIT 50)"""


@query("hybrid_rrf", _SIDES + """
SELECT doc_id, round(sum(1.0 / (60 + p)), 9) AS score FROM (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS p FROM l UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM v) GROUP BY doc_id""", "documents", "embeddings")
def _rrf(documents, embeddings):
    placed = [x.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))) for x in _sides(documents, embeddings)]
    return ranking.reciprocal_rank(placed, "doc_id").withColumn("score", F.round("score", 9))


@query("hybrid_minmax", _SIDES + """,
a AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM v),
b AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS y FROM l)
SELECT doc_id, round(0.35 * coalesce(x, 0) + 0.65 * coalesce(y, 0), 6) AS score,
  CASE WHEN x IS NULL THEN 'lexical' WHEN y IS NULL THEN 'vector' ELSE 'both' END AS origin FROM a FULL JOIN b USING (doc_id)""", "documents", "embeddings")
def _minmax(documents, embeddings):
    return ranking.minmax(*_sides(documents, embeddings), "doc_id").withColumn("score", F.round("score", 6))


@query("hybrid_cap_per_source", _SIDES + """
SELECT doc_id, source FROM (SELECT l.doc_id, source, row_number() OVER (PARTITION BY source ORDER BY score DESC, l.doc_id) AS r FROM l JOIN documents USING (doc_id)) WHERE r <= 2""", "documents", "embeddings")
def _cap(documents, embeddings):
    _, words = _sides(documents, embeddings)
    return ranking.capped(words.join(documents.select("doc_id", "source"), "doc_id"), "source", "score", "doc_id").select("doc_id", "source")


@query("hybrid_convex", _SIDES + """,
a AS (SELECT doc_id, score / max(score) OVER () AS x FROM v),
b AS (SELECT doc_id, score / max(score) OVER () AS y FROM l)
SELECT doc_id, round(0.35 * coalesce(x, 0) + 0.65 * coalesce(y, 0), 6) AS score FROM a FULL JOIN b USING (doc_id)""", "documents", "embeddings")
def _convex(documents, embeddings):
    return ranking.convex(*_sides(documents, embeddings), "doc_id").withColumn("score", F.round("score", 6))


_CEILING = "2.2 * (greatest(ln((docs - d0 + 0.5) / (d0 + 0.5)), 1e-6) + greatest(ln((docs - d1 + 0.5) / (d1 + 0.5)), 1e-6))"


@query("hybrid_confidence", _SIDES + f"""
SELECT doc_id, round(0.35 * greatest(0, least(1, coalesce(v.score, 0))) + 0.65 * greatest(0, least(1, coalesce(l.score / c, 0))), 6) AS confidence
FROM (v FULL JOIN l USING (doc_id)), (SELECT {_CEILING} AS c FROM s)
WHERE 0.35 * greatest(0, least(1, coalesce(v.score, 0))) + 0.65 * greatest(0, least(1, coalesce(l.score / c, 0))) >= 0.2""", "documents", "embeddings")
def _confidence(documents, embeddings):
    near, words = _sides(documents, embeddings)
    ceiling = fulltext.ceiling(documents, ["les", "der"])  # one row
    both = near.withColumnRenamed("score", "v").join(words.withColumnRenamed("score", "w"), "doc_id", "full").join(F.broadcast(ceiling))
    out = both.select("doc_id", ranking.confidence(F.col("v"), F.col("w"), F.col("ceiling")).alias("confidence"))
    return out.where(F.col("confidence") >= 0.2).withColumn("confidence", F.round("confidence", 6))


@query("fts_trigrams", "SELECT g, count(*) AS n FROM (SELECT substr(n_name, i, 3) AS g FROM nation, generate_series(1, 40) t(i) WHERE i <= length(n_name) - 2) GROUP BY g", "nation")
def _trigrams(nation):
    return nation.select(F.explode(fulltext.trigrams(F.col("n_name"))).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query("fts_match_join", f"""
SELECT item_id, doc_id, count(*) AS shared FROM
  (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 12)) AS term FROM benchmark)
  JOIN (SELECT DISTINCT doc_id, unnest({_TERMS}) AS term FROM documents) USING (term) GROUP BY item_id, doc_id""", "documents", "benchmark")
def _match_join(documents, benchmark):
    asked = benchmark.select("item_id", F.explode(F.array_distinct(fulltext.terms(F.col("text")))).alias("term")).where(F.length("term") > 12)
    return fulltext.postings(documents).join(asked, "term").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("shared"))


@query("fts_porter_vocab", None, "documents")
def _porter(documents):
    return stemming.stem_vocabulary(documents, "doc_id")


@query("fts_snippet", None, "documents")
def _snippet(documents):
    return documents.select("doc_id", stemming.snippet(F.col("text"), ["the", "was"], size=12).alias("snippet"))


@query("vec_ivf_topk", None, "embeddings")
def _ivf(embeddings):
    centres = ivf.train(embeddings, 16)
    probes = ivf.enough_probes(ivf.sample(embeddings, 16 * 256), centres, QUERY_VECTOR)
    return ivf.search(ivf.assigned(embeddings, centres), centres, QUERY_VECTOR, 10, probes)


@query("vec_batch_knn", f"""
SELECT query_id, vec_id FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS r
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) WHERE r <= 5""", "embeddings")
def _batch(embeddings):
    return ranking.nearest_each(embeddings, F.col("vec_id") % 50 == 0, 5).select("query_id", "vec_id")


@query("vec_mmr", None, "embeddings")
def _mmr(embeddings):
    near = ranking.nearest(embeddings, QUERY_VECTOR, 50, "cosine").withColumn("score", 1 - F.col("distance"))
    found = near.join(embeddings, "vec_id").withColumn("g", F.lit(0))
    return ranking.diversified(found, "g", "vec_id", "score", "embedding").select("vec_id", "rank")
