"""Operator 3, line dedup by distinct-site spread.

Every non-blank line, trimmed, is hashed; a HyperLogLog sketch of the sites it stands on is built per hash and merged by
aggregation. Lines whose estimate is far above the threshold are boilerplate, far below are not; those near it get the
exact number of distinct sites. Boilerplate is removed everywhere but at its first place, so that no content leaves the
corpus with the last of its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, written

#: Distinct sites from which a line is boilerplate.
SITES = 8
#: Lines whose estimate is within this factor of the threshold are counted exactly; the sketch's standard error is 1.6 %.
NEAR = 1.25
LOG_K = 12
#: What a line is trimmed of, and what a blank line consists of.
BLANK = " \t\r\x0b\x0c"


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, place, line_hash) of every non-blank line of every row that has a doc_id."""
    parts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    line = F.trim("line", F.lit(BLANK))
    return parts.filter(line != "").select("doc_id", "text_hash", "site", "place", F.xxhash64(line).alias("line_hash"))


def boilerplate(lines: DataFrame, sites: int = SITES) -> DataFrame:
    """(line_hash, first) of lines on at least `sites` distinct sites; first is the least (doc_id, place). A null site is none."""
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", LOG_K).alias("sketch"), F.min(F.struct("doc_id", "place")).alias("first"))
    spread = spread.select("line_hash", "first", F.hll_sketch_estimate("sketch").alias("estimate")).filter(F.col("estimate") >= sites / NEAR)
    spread = written(lines.sparkSession, spread, "spread")
    sure = spread.filter(F.col("estimate") > sites * NEAR).select("line_hash", "first")
    near = spread.filter(F.col("estimate") <= sites * NEAR)
    exact = lines.join(near.select("line_hash"), "line_hash", "left_semi").groupBy("line_hash").agg(F.count_distinct("site").alias("exact")).filter(F.col("exact") >= sites)
    return sure.union(near.join(exact, "line_hash").select("line_hash", "first"))


def dedup_lines(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with boilerplate lines removed from text, and the columns lines_removed and lines_left (non-blank ones).

    A line counts trimmed of spaces, tabs, carriage returns and feeds, lines of nothing else are left alone, and the lines that stay keep their order and their spaces. The first
    place of a line is its least doc_id and line number; of repeated rows each keeps it. A null or empty text stays
    as it is with 0 lines; a row with a null doc_id is not judged and stays as it is, with lines_removed 0. A null source
    is no site. An empty table gives an empty table; other columns pass through.
    """
    doc, hashed, gone, left, removed = fresh(docs, "_doc", "_text_hash", "_gone", "lines_left", "lines_removed")
    lines = written(docs.sparkSession, line_table(docs), "lines")
    spread = boilerplate(lines, sites)
    bad = lines.join(spread, "line_hash").filter((F.col("doc_id") != F.col("first.doc_id")) | (F.col("place") != F.col("first.place")))
    bad = bad.groupBy(F.col("doc_id").alias(doc), F.col("text_hash").alias(hashed)).agg(F.collect_set("place").alias(gone))
    joined = docs.join(bad, (docs["doc_id"] == F.col(doc)) & (F.xxhash64(docs["text"]) == F.col(hashed)), "left")
    parts = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone)), lambda i: F.get(parts, i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumn("text", text)
    some = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x, F.lit(BLANK)) != ""))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).alias(removed), some.alias(left))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return dedup_lines(docs).select("doc_id", "text", "lines_removed", "lines_left")


_TRIMMED = f"trim({{}}, {' || '.join(f'chr({ord(c)})' for c in BLANK)})"
OP3_SQL = f"""
WITH parts AS (
  SELECT doc_id, source, generate_subscripts(string_split(text, chr(10)), 1) AS place, unnest(string_split(text, chr(10))) AS line
  FROM documents WHERE text IS NOT NULL
), spread AS (
  SELECT {_TRIMMED.format('line')} AS line, min((doc_id, place)) AS first FROM parts WHERE {_TRIMMED.format('line')} <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {SITES}
), marked AS (
  SELECT p.doc_id, p.place, p.line, coalesce((p.doc_id, p.place) <> s.first, false) AS gone
  FROM parts p LEFT JOIN spread s ON {_TRIMMED.format('p.line')} = s.line
)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '') AS text,
  CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS lines_removed,
  CAST(count(*) FILTER (WHERE NOT gone AND {_TRIMMED.format('line')} <> '') AS INTEGER) AS lines_left
FROM marked GROUP BY doc_id
"""


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """docs with boilerplate removed and n_chars made right; rows that had lines and lost the last of them go."""
    out = dedup_lines(docs)
    removed, left = out.columns[-2:]
    out = out.filter((F.col(removed) == 0) | (F.col(left) > 0))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
