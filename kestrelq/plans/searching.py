"""More of text, vector and hybrid search: columns, weights, folding, vector forms, signals, one-sided queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import fulltext, ranking
from .registry import query
from .retrieval import _CEILING, _E, _LINE, _Q, _SIDES, _TERMS, QUERY_VECTOR, _sides

_SOURCE_LINE = _LINE.replace("lower(text)", "lower(source)")
_SOURCE_TERMS = _TERMS.replace("lower(text)", "lower(source)")


@query("fts_columns", f"SELECT doc_id FROM documents WHERE (contains({_LINE}, ' the ') AND contains({_SOURCE_LINE}, ' site')) OR contains({_LINE}, ' der ')", "documents")
def _columns(documents):
    return documents.where(fulltext.Query("text: the AND source: site* OR - {source}: der").predicate(F.col("text"), F.col("source"), names=("text", "source"))).select("doc_id")


@query("fts_near_three", f"SELECT doc_id FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(list_filter(range(1, len(t) + 1), lambda i: list_contains(['the', 'was', 'of'], t[i]) AND list_has_all(t[i:i + 7], ['the', 'was', 'of']))) > 0", "documents")
def _near(documents):
    return fulltext.search(documents, "NEAR(the was of, 5)").select("doc_id")


@query("fts_weighted_bm25", f"""
WITH t AS (SELECT doc_id, {_TERMS} AS w, {_SOURCE_TERMS} AS s FROM documents),
d AS (SELECT doc_id, len(w) + len(s) AS n, 1.0 * len(list_filter(w, lambda x: x = 'the')) + 4.0 * len(list_filter(s, lambda x: x = 'the')) AS f0,
  1.0 * len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) + 4.0 * len(list_filter(range(1, len(s)), lambda i: s[i] = 'of' AND s[i + 1] = 'the')) AS f1 FROM t),
s AS (SELECT count(*) AS docs, avg(n) AS mean, sum((f0 > 0)::INT) AS d0, sum((f1 > 0)::INT) AS d1 FROM d)
SELECT doc_id, round(-(greatest(ln((docs - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * n / mean))
  + greatest(ln((docs - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
FROM d, s WHERE f0 > 0 OR f1 > 0""", "documents")
def _weighted(documents):
    return fulltext.bm25(documents, ["the", "of the"], weights={"text": 1.0, "source": 4.0}).withColumn("score", F.round("score", 6))


@query("fts_folded_vocab", "SELECT term, count(*) AS hits FROM (SELECT unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term", "documents")
def _folded(documents):
    return documents.select(F.explode(fulltext.terms(F.col("text"), diacritics=False)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("hits"))


@query("fts_ascii_vocab", "SELECT term, count(*) AS hits FROM (SELECT unnest(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term", "documents")
def _ascii(documents):
    return documents.select(F.explode(fulltext.terms(F.col("text"), "ascii")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("hits"))


@query("fts_vocab_columns", f"""
SELECT term, col, count(DISTINCT doc_id) AS docs, count(*) AS hits FROM (SELECT doc_id, 'text' AS col, unnest({_TERMS}) AS term FROM documents
  UNION ALL SELECT doc_id, 'source', unnest({_SOURCE_TERMS}) FROM documents) GROUP BY term, col""", "documents")
def _by_column(documents):
    return fulltext.vocabulary_by_column(documents, ["text", "source"])


@query("fts_vocab_instances", f"SELECT term, doc_id, 'source' AS col, CAST(i - 1 AS INTEGER) AS \"offset\" FROM (SELECT doc_id, unnest({_SOURCE_TERMS}) AS term, generate_subscripts({_SOURCE_TERMS}, 1) AS i FROM documents)", "documents")
def _instances(documents):
    return fulltext.instances(documents, ["source"])


# vectors


@query("vec_from_text", "SELECT vec_id, len(embedding) AS dims, round(list_sum(embedding::DOUBLE[]), 6) AS total, true AS wrong_width, true AS no_vector FROM embeddings", "embeddings")
def _from_text(embeddings):
    text = F.concat(F.lit("["), F.concat_ws(", ", F.col("embedding").cast("array<double>").cast("array<string>")), F.lit("]"))
    v = vectors.from_text(text, 64)
    total = F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)
    return embeddings.select("vec_id", F.size(v).cast("long").alias("dims"), total.alias("total"), vectors.from_text(text, 3).isNull().alias("wrong_width"), vectors.from_text(F.lit("[1, x]")).isNull().alias("no_vector"))


_BITS = "list_transform(embedding, lambda x: (x > 0)::INT)"
_QBITS = "[" + ", ".join(str(int(x > 0)) for x in QUERY_VECTOR) + "]"


@query("vec_bit_distances", f"""
SELECT vec_id, CAST(list_sum(list_transform(list_zip({_BITS}, {_QBITS}), lambda p: (p[1] <> p[2])::INT)) AS INTEGER) AS hamming,
  round(1 - list_sum(list_transform(list_zip({_BITS}, {_QBITS}), lambda p: p[1] * p[2])) / list_sum(list_transform(list_zip({_BITS}, {_QBITS}), lambda p: greatest(p[1], p[2])))::DOUBLE, 6) AS jaccard FROM embeddings""", "embeddings")
def _bits(embeddings):
    b, q = vectors.bits(F.col("embedding")), F.array(*(F.lit(int(x > 0)) for x in QUERY_VECTOR))
    return embeddings.select("vec_id", vectors.hamming(b, q).alias("hamming"), F.round(vectors.jaccard(b, q), 6).alias("jaccard"))


@query("vec_normalised", f"SELECT vec_id, round({_E}[1] / sqrt(list_dot_product({_E}, {_E})), 6) AS first, 1.0::DOUBLE AS norm FROM embeddings", "embeddings")
def _normalised(embeddings):
    v = vectors.normalised(F.col("embedding"))
    return embeddings.select("vec_id", F.round(v[0], 6).alias("first"), F.round(vectors.norm(v), 6).alias("norm"))


@query("vec_concat_subvector", f"SELECT vec_id, len({_E} || {_Q}) AS dims, round(list_sum(({_E} || {_Q})[61:68]), 6) AS s, round(list_sum(list_transform(list_zip({_E}, {_Q}), lambda p: p[1] - p[2])), 6) AS d, round(list_sum(list_transform(list_zip({_E}, {_Q}), lambda p: p[1] * p[2])), 6) AS m FROM embeddings", "embeddings")
def _parts(embeddings):
    e, q = F.col("embedding"), F.array(*map(F.lit, QUERY_VECTOR))
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6)
    both = vectors.concat(e, q)
    return embeddings.select("vec_id", F.size(both).cast("long").alias("dims"), total(vectors.subvector(both, 61, 8)).alias("s"), total(vectors.subtract(e, q)).alias("d"), total(vectors.multiply(e, q)).alias("m"))


@query("vec_sparse", f"SELECT vec_id, len(list_filter({_E}, lambda x: abs(x) > 0.1)) AS kept, round(list_sum(list_transform(list_zip({_E}, {_Q}), lambda p: CASE WHEN abs(p[1]) > 0.1 THEN p[1] * p[2] ELSE 0 END)), 6) AS product FROM embeddings", "embeddings")
def _sparse(embeddings):
    cut = F.transform(vectors.doubles(F.col("embedding")), lambda x: F.when(F.abs(x) > 0.1, x).otherwise(F.lit(0.0)))
    s, q = vectors.sparse(cut), vectors.sparse(F.array(*map(F.lit, QUERY_VECTOR)))
    return embeddings.select("vec_id", F.size(s).cast("long").alias("kept"), F.round(vectors.sparse_dot(s, q), 6).alias("product"))


@query("vec_int8_topk", f"SELECT vec_id FROM embeddings ORDER BY 1 - list_cosine_similarity({_E}, {_Q}), vec_id LIMIT 10", "embeddings")
def _int8(embeddings):
    return ranking.int8_rescored(embeddings, QUERY_VECTOR, 10, wide=8).select("vec_id")


# hybrid


@query("hybrid_theoretical", _SIDES + f"""
SELECT doc_id, round(0.35 * greatest(0, least(1, coalesce(v.score, 0))) + 0.65 * greatest(0, least(1, coalesce(l.score / c, 0))), 6) AS score
FROM (v FULL JOIN l USING (doc_id)), (SELECT {_CEILING} AS c FROM s)""", "documents", "embeddings")
def _theoretical(documents, embeddings):
    near, words = _sides(documents, embeddings)
    ceiling = fulltext.ceiling(documents, ["les", "der"]).first()[0]  # one number
    return ranking.theoretical(near, words, "doc_id", ceiling).withColumn("score", F.round("score", 6))


@query("hybrid_one_sided", _SIDES + "SELECT doc_id, round(0.35 * greatest(0, least(1, score)), 6) AS confidence FROM v", "documents", "embeddings")
def _one_sided(documents, embeddings):
    near, _ = _sides(documents, embeddings)
    return ranking.one_sided("doc_id", vector_scores=near).withColumn("confidence", F.round("confidence", 6))


_APART = "greatest(0, least(1, (max(score) - (sum(score) - max(score)) / (count(*) - 1)) / max(score)))"


@query("hybrid_separation", _SIDES + f"SELECT 'vector' AS side, round({_APART}, 6) AS separation FROM v UNION ALL SELECT 'lexical', round({_APART}, 6) FROM l", "documents", "embeddings")
def _separation(documents, embeddings):
    near, words = _sides(documents, embeddings)
    part = lambda x, side: ranking.separation(x).select(F.lit(side).alias("side"), F.round("separation", 6).alias("separation"))
    return part(near, "vector").unionByName(part(words, "lexical"))


@query("hybrid_adaptive", _SIDES + f""",
w AS (SELECT greatest(0.05, least(0.95, 0.35 + 0.1 * (sv - sl) - 0.1 * 1.0)) AS w FROM (SELECT {_APART} AS sv FROM v), (SELECT {_APART} AS sl FROM l)),
a AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x FROM v),
b AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS y FROM l)
SELECT doc_id, round(w * coalesce(x, 0) + (1 - w) * coalesce(y, 0), 6) AS score FROM (a FULL JOIN b USING (doc_id)), w""", "documents", "embeddings")
def _adaptive(documents, embeddings):
    near, words = _sides(documents, embeddings)
    signals = ranking.separation(near, "v").join(F.broadcast(ranking.separation(words, "w")))  # one row each
    zero = F.lit(0.0)
    weight = signals.select(ranking.adaptive_weight(F.col("v"), F.col("w"), zero, zero, F.lit(1.0)).alias("x")).first()[0]
    return ranking.minmax(near, words, "doc_id", weight).select("doc_id", F.round("score", 6).alias("score"))


@query("hybrid_rerank", _SIDES + "SELECT doc_id, CAST(length(text) AS INTEGER) AS score FROM v JOIN documents USING (doc_id) ORDER BY length(text) DESC, doc_id LIMIT 7", "documents", "embeddings")
def _rerank(documents, embeddings):
    near, _ = _sides(documents, embeddings)
    return ranking.reranked(near.join(documents.select("doc_id", "text"), "doc_id"), F.length("text"), "doc_id", 7).select("doc_id", "score")
