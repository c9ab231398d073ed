"""Cross-site boilerplate: lines that stand on many distinct sites, by HyperLogLog.

Lines are known by a 64-bit hash of their trimmed text. A sketch of sites per line hash merges by
aggregation (map-side first, so a hot line costs one row a task). Sketches decide lines far from
the threshold; lines within the sketch's error of it get an exact distinct count. A line over the
threshold goes from every document but the first (by document id) that has it, so no text is lost
from the corpus. Native expressions throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hubs, written


def line_hashes(text: Column) -> Column:
    """Hashes of the trimmed lines of a text; blank lines are null. Null text has no lines."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def error(lg_k: int) -> float:
    """Relative error of a sketch with 2^lg_k registers, one standard deviation."""
    return 1.04 / (1 << lg_k) ** 0.5


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """doc_id, site, line: each distinct line of each document once, written to the shared folder as
    two numbers and the site, since several steps read it."""
    lines = F.explode(F.array_distinct(line_hashes(F.col("text")))).alias("line")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(site).cast("string").alias("site"), lines).where("line is not null"), "lines")


def spread_lines(lines: DataFrame, min_sites: int, lg_k: int, sigmas: float = 5.0) -> DataFrame:
    """line, first_doc, many (documents) of lines on at least min_sites distinct sites. A null site counts as no site.
    The rows of a line that a large share of the documents has meet its result by broadcast, in no one task."""
    low, high = min_sites * (1 - sigmas * error(lg_k)), min_sites * (1 + sigmas * error(lg_k))
    spread = lines.groupBy("line").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("many"), F.hll_sketch_agg("site", lg_k).alias("sketch"))
    spread = spread.select("line", "first_doc", "many", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = written(spread.where(F.col("sites") >= F.lit(low)), "spread")
    sure = spread.where(F.col("sites") > F.lit(high)).select("line", "first_doc", "many")
    near = spread.where(F.col("sites") <= F.lit(high)).select("line", "first_doc", "many")
    # distinct (line, site) pairs of the few near lines; a line keeps one row for each site
    pairs = join_hubs(lines, near, "line", "many", lines.count()).select("line", "site", "first_doc", "many").where("site is not null").distinct()
    exact = pairs.groupBy("line", "first_doc", "many").agg(F.count("site").alias("sites"))
    return written(sure.unionByName(exact.where(F.col("sites") >= min_sites).select("line", "first_doc", "many")), "cut")


def deduplicated(docs: DataFrame, min_sites: int = 10, lg_k: int = 10, site: str = "source") -> DataFrame:
    """docs with boilerplate lines removed from text, plus n_lines (lines that are not blank) and
    n_removed. Kept lines stay in order and as they were. Null text stays null; documents that share
    an id share their fate for a line; the first document of a line keeps every copy of it."""
    taken = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    mark = "_kq"  # longer than every clashing name
    while any(c.lower().startswith(mark) for c in taken):
        mark += "_"
    id_, cuts = f"{mark}_id", f"{mark}_cut"
    lines = site_lines(docs, site)
    spread = spread_lines(lines, min_sites, lg_k)
    # documents far outnumber the flagged lines of one: the list is no longer than a document
    cut = join_hubs(lines, spread, "line", "many", lines.count()).where("doc_id > first_doc").groupBy("doc_id").agg(F.collect_set("line").alias(cuts))
    out = docs.select(*(F.col(f"`{c}`") for c in taken)).join(cut.withColumnRenamed("doc_id", id_), F.col("doc_id").cast("long") == F.col(id_), "left")
    parts = F.split(F.col("text"), "\n")
    gone = lambda x: F.coalesce(F.array_contains(cuts, F.xxhash64(F.trim(x))) & (F.trim(x) != ""), F.lit(False))
    n_lines = F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0))
    n_cut = F.when(F.col(cuts).isNull() | F.col("text").isNull(), 0).otherwise(F.size(F.filter(parts, gone)))
    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(F.array_join(F.filter(parts, lambda x: ~gone(x)), "\n"))
    cleaned = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in taken]
    return out.select(*cleaned, F.when(F.col("text").isNull(), 0).otherwise(n_lines).alias("n_lines"), n_cut.alias("n_removed"))


ORACLE = """
WITH lines AS (SELECT doc_id, source, trim(unnest(string_split(text, chr(10)))) AS line FROM documents),
spread AS (SELECT line, min(doc_id) AS first_doc FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10),
parts AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
marked AS (SELECT p.doc_id, p.part, p.pos, s.line IS NOT NULL AND p.doc_id > s.first_doc AS gone
  FROM parts p LEFT JOIN spread s ON trim(p.part) = s.line)
SELECT doc_id, CAST(count(*) FILTER (WHERE trim(part) <> '') AS INTEGER) AS n_lines,
  CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed,
  coalesce(string_agg(part, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
