"""Property graphs over the driver's tables, as DataFrames and as the SQL that says the same.

link: pages and the addresses that they refer to. keys: region, nation, customer and supplier as files, orders and parts as
symbols. steps: event types and what the same user did next. lines: parts and the part on the next line of the same order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def link_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    pages = table(spark, sf, "pages")
    edges = pages.select(_id("p", "page_id").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("dst")).distinct().withColumn("etype", F.lit("imports")).withColumn("evidence", F.lit("regex"))
    named = pages.select(_id("p", "page_id").alias("id"), F.col("url").alias("name"), F.regexp_extract("html", '<html lang="([^"]*)"', 1).alias("language"), F.regexp_extract("url", "https?://([^/]+)", 1).alias("subproject"))
    nodes = named.union(edges.select(F.col("dst").alias("id"), F.col("dst").alias("name"), F.lit("").alias("language"), F.lit("").alias("subproject")).distinct())
    return PropertyGraph(nodes.withColumn("ntype", F.lit("file")).withColumn("path", F.col("id")).withColumn("seq", F.col("id")), edges)


#: Rows of which one task makes pairs distinct.
ROWS = 500_000


def _pairs(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct pairs, in tasks of a bounded number of rows if the table is so large that the session's would hold more."""
    parts = rows.count() // ROWS
    pairs = rows.select(*columns)
    return (pairs.repartition(parts, *columns) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else pairs).distinct()


def key_graph(spark: SparkSession, sf: str) -> PropertyGraph:
    t = {n: table(spark, sf, n) for n in ("region", "nation", "customer", "supplier", "orders", "part", "lineitem")}

    def files(name: str, prefix: str, key: str, label: str, sub) -> DataFrame:
        return t[name].select(_id(prefix, key).alias("id"), F.lit("file").alias("ntype"), F.col(label).alias("name"), _id(prefix, key).alias("path"), F.lit(name).alias("language"), sub.alias("subproject"), F.lit("").alias("stype"))

    nodes = files("region", "r", "r_regionkey", "r_name", F.lit(""))
    nodes = nodes.union(files("nation", "n", "n_nationkey", "n_name", _id("r", "n_regionkey")))
    nodes = nodes.union(files("customer", "c", "c_custkey", "c_name", F.col("c_mktsegment"))).union(files("supplier", "s", "s_suppkey", "s_name", F.lit("")))
    nodes = nodes.union(t["orders"].select(_id("o", "o_orderkey"), F.lit("symbol"), F.col("o_orderpriority"), _id("c", "o_custkey"), F.lit(""), F.lit(""), F.lit("order")))
    nodes = nodes.union(t["part"].select(_id("p", "p_partkey"), F.lit("symbol"), F.col("p_name"), F.col("p_brand"), F.lit(""), F.lit(""), F.col("p_type")))

    def edges(df: DataFrame, src, dst, etype: str) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(etype).alias("etype"), F.lit("ast").alias("evidence"))

    e = edges(t["nation"], _id("n", "n_nationkey"), _id("r", "n_regionkey"), "imports")
    e = e.union(edges(t["customer"], _id("c", "c_custkey"), _id("n", "c_nationkey"), "imports")).union(edges(t["supplier"], _id("s", "s_suppkey"), _id("n", "s_nationkey"), "imports"))
    e = e.union(edges(t["orders"], _id("c", "o_custkey"), _id("o", "o_orderkey"), "defines"))
    e = e.union(edges(_pairs(t["lineitem"], "l_orderkey", "l_partkey"), _id("o", "l_orderkey"), _id("p", "l_partkey"), "calls"))
    e = e.union(edges(_pairs(t["lineitem"], "l_suppkey", "l_partkey"), _id("s", "l_suppkey"), _id("p", "l_partkey"), "uses"))
    return PropertyGraph(nodes.withColumn("seq", F.col("id")), e)


def step_edges(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).filter("dst is not null").distinct()


def line_edges(spark: SparkSession, sf: str) -> DataFrame:
    """A part and the part on the next line of the same order, from all lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    rows = table(spark, sf, "lineitem")
    return rows.select(_id("p", "l_partkey").alias("src"), F.concat(F.lit("p:"), F.lead("l_partkey").over(w).cast("string")).alias("dst")).filter("dst is not null and src != dst").distinct()


def document_files(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Documents as files (path, language, chars, size), and imports (src, dst) between them by arithmetic on their ids."""
    docs = table(spark, sf, "documents")
    n = docs.count()
    files = docs.select(_id("d", "doc_id").alias("path"), F.when(F.col("lang") == "en", "python").when(F.col("lang") == "de", "go").otherwise(F.col("lang")).alias("language"), F.length("text").cast("bigint").alias("chars"), F.length("text").cast("bigint").alias("size"))
    ids = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 4)).alias("j"))
    to = (F.col("doc_id") * 7 + F.col("j") * 13 + 1) % n
    imports = ids.filter(to != F.col("doc_id")).select(_id("d", "doc_id").alias("src"), F.concat(F.lit("d:"), to.cast("string")).alias("dst")).distinct()
    return files, imports


LINK_SQL = """
le AS (SELECT DISTINCT 'p:' || page_id AS src, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS dst, 'imports' AS etype, 'regex' AS evidence FROM pages),
ln AS (
  SELECT 'p:' || page_id AS id, url AS name, regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, regexp_extract(url, 'https?://([^/]+)', 1) AS subproject FROM pages
  UNION ALL SELECT DISTINCT dst, dst, '', '' FROM le
)"""
KEY_SQL = """
kn AS (
  SELECT 'r:' || r_regionkey AS id, 'file' AS ntype, r_name AS name, 'r:' || r_regionkey AS path, 'region' AS language, '' AS subproject, '' AS stype FROM region
  UNION ALL SELECT 'n:' || n_nationkey, 'file', n_name, 'n:' || n_nationkey, 'nation', 'r:' || n_regionkey, '' FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'file', c_name, 'c:' || c_custkey, 'customer', c_mktsegment, '' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'file', s_name, 's:' || s_suppkey, 'supplier', '', '' FROM supplier
  UNION ALL SELECT 'o:' || o_orderkey, 'symbol', o_orderpriority, 'c:' || o_custkey, '', '', 'order' FROM orders
  UNION ALL SELECT 'p:' || p_partkey, 'symbol', p_name, p_brand, '', '', p_type FROM part
),
ke AS (
  SELECT 'n:' || n_nationkey AS src, 'r:' || n_regionkey AS dst, 'imports' AS etype FROM nation
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'imports' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'imports' FROM supplier
  UNION ALL SELECT 'c:' || o_custkey, 'o:' || o_orderkey, 'defines' FROM orders
  UNION ALL SELECT DISTINCT 'o:' || l_orderkey, 'p:' || l_partkey, 'calls' FROM lineitem
  UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'p:' || l_partkey, 'uses' FROM lineitem
),
kd AS (SELECT id, count(e) AS degree FROM kn LEFT JOIN (SELECT unnest([src, dst]) AS e FROM ke) ON id = e GROUP BY id)"""
STEP_SQL = "te AS (SELECT DISTINCT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL)"
LINE_SQL = """
ce AS (SELECT DISTINCT src, dst FROM (
  SELECT 'p:' || l_partkey AS src, 'p:' || lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS dst
  FROM lineitem) WHERE dst IS NOT NULL AND src <> dst)"""
DOC_SQL = """
df AS (SELECT 'd:' || doc_id AS path, CASE lang WHEN 'en' THEN 'python' WHEN 'de' THEN 'go' ELSE lang END AS language, length(text) AS chars, greatest(1, length(text) // 4) AS tokens FROM documents),
di AS (
  SELECT DISTINCT 'd:' || doc_id AS src, 'd:' || to_id AS dst
  FROM (SELECT doc_id, (doc_id * 7 + j * 13 + 1) % (SELECT count(*) FROM documents) AS to_id FROM (SELECT doc_id, unnest(range(0, doc_id % 4 + 1)) AS j FROM documents)) WHERE to_id <> doc_id
)"""
