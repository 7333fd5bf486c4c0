"""The registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import PropertyGraph, one_edge_per_pair, tokens
from ..operators import analytics, components, context, graph, link, report, resolve, search, snapshot
from . import ingest
from .adapters import DOC_SQL, KEY_SQL, LINE_SQL, LINK_SQL, STEP_SQL, document_files, key_graph, line_edges, link_graph, step_edges, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def one(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


# edges, degrees, counts


@query("""
SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, arg_max(etype, rank) AS etype
FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN 'imports' WHEN 'N' THEN 'calls' ELSE 'tests' END AS etype, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 4 END AS rank FROM lineitem)
GROUP BY 1, 2""")
def edge_dedupe_priority(spark, sf):
    kind = F.when(F.col("l_returnflag") == "A", "imports").when(F.col("l_returnflag") == "N", "calls").otherwise("tests")
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"), kind.alias("etype"), F.lit("ast").alias("evidence"))
    return one_edge_per_pair(rows).select("src", "dst", "etype")


@query(f"WITH {KEY_SQL} SELECT id, degree FROM kd")
def node_degree(spark, sf):
    return graph.degrees(key_graph(spark, sf))


@query(f"""WITH {KEY_SQL}
SELECT 'files' AS key, count(*) AS value FROM kn WHERE ntype = 'file' UNION ALL SELECT 'symbols', count(*) FROM kn WHERE ntype = 'symbol'
UNION ALL SELECT 'subprojects', count(DISTINCT subproject) FROM kn WHERE ntype = 'file' AND subproject <> ''
UNION ALL SELECT 'edges', count(*) FROM ke UNION ALL SELECT 'edges_' || etype, count(*) FROM ke GROUP BY etype""")
def graph_stats(spark, sf):
    return graph.stats(key_graph(spark, sf))


@query(f"WITH {KEY_SQL} SELECT subproject FROM kn WHERE ntype = 'file' AND subproject <> '' GROUP BY 1")
def available_subprojects(spark, sf):
    return search.subprojects(key_graph(spark, sf))


# traversals

_HOP1 = "h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'p:0')"
_BOTH = "b AS (SELECT src, dst FROM le UNION ALL SELECT dst, src FROM le)"


@query(f"""WITH {LINK_SQL}, {_BOTH}, {_HOP1}, h2 AS (SELECT DISTINCT b.dst AS id FROM b JOIN h1 ON b.src = h1.id)
SELECT id, min(hop) AS hop FROM (SELECT 'p:0' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""")
def khop_neighbors(spark, sf):
    return graph.khop(link_graph(spark, sf), one(spark, "p:0"), 2)


@query(f"""WITH {LINK_SQL}, {_BOTH}, {_HOP1}, h2 AS (SELECT DISTINCT b.dst AS id FROM b JOIN h1 ON b.src = h1.id), k AS (SELECT 'p:0' AS id UNION SELECT id FROM h1 UNION SELECT id FROM h2)
SELECT src, dst, etype FROM le WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def induced_subgraph(spark, sf):
    g = link_graph(spark, sf)
    return graph.induced(g, graph.khop(g, one(spark, "p:0"), 2)).edges.select("src", "dst", "etype")


_IMPACT = """WITH RECURSIVE {key}, r AS (SELECT '{seed}' AS id, 0 AS hop UNION SELECT src, hop + 1 FROM r JOIN ke ON dst = r.id AND etype <> 'defines' WHERE hop < {depth})
SELECT r.id, ntype, min(hop) AS hops FROM r JOIN kn USING (id) WHERE r.id <> '{seed}' GROUP BY 1, 2"""


@query(_IMPACT.format(key=KEY_SQL, seed="r:0", depth=6))
def impact_closure(spark, sf):
    return graph.impact(key_graph(spark, sf), one(spark, "r:0"))


@query(_IMPACT.format(key=KEY_SQL, seed="r:1", depth=2))
def impact_depth2(spark, sf):
    return graph.impact(key_graph(spark, sf), one(spark, "r:1"), 2)


@query(_IMPACT.format(key=KEY_SQL, seed="p:5", depth=4))
def impact_symbols(spark, sf):
    return graph.impact(key_graph(spark, sf), one(spark, "p:5"))


@query("SELECT 0 AS hop, 'c:7' AS id UNION ALL SELECT 1, 'n:' || c_nationkey FROM customer WHERE c_custkey = 7 UNION ALL SELECT 2, 'r:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def shortest_path_hops(spark, sf):
    region = table(spark, sf, "customer").filter("c_custkey = 7").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).first()["n_regionkey"]
    nodes, _ = graph.shortest_path(key_graph(spark, sf), "c:7", f"r:{region}")
    return spark.createDataFrame(list(enumerate(nodes)), "hop int, id string")


@query(f"""WITH RECURSIVE {LINE_SQL}, cm AS MATERIALIZED (SELECT * FROM ce), s AS (SELECT min(src) AS id FROM cm), r AS (SELECT id, 0 AS hop FROM s UNION SELECT dst, hop + 1 FROM r JOIN cm ON src = r.id WHERE hop < 64)
SELECT id, min(hop) AS hop FROM r GROUP BY id""")
def reachable_hops(spark, sf):
    edges = line_edges(spark, sf)
    return graph.reach(edges, edges.agg(F.min("src").alias("id")))


# analytics

#: Rounds that the SQL writes out: the most that the operator takes.
ROUNDS = 100


def _rank_sql(base: str, nodes: str, edges: str) -> str:
    """Power iteration, round by round; the rank is that of the first round that changes the ranks by less than 1e-6 in all."""
    parts = [f"WITH {base}, n AS MATERIALIZED (SELECT id FROM {nodes}), c AS MATERIALIZED (SELECT count(*) AS n FROM n), o AS MATERIALIZED (SELECT src, count(*) AS o FROM (SELECT DISTINCT src, dst FROM {edges}) GROUP BY src), l AS MATERIALIZED (SELECT DISTINCT e.src, e.dst, o.o FROM {edges} e JOIN o USING (src)), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM n, c)"]
    for i in range(ROUNDS):
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, (0.15 + 0.85 * (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o))) / (SELECT n FROM c) + 0.85 * coalesce(sum(r.rank / l.o), 0) AS rank FROM n LEFT JOIN l ON l.dst = n.id LEFT JOIN r{i} r ON r.id = l.src GROUP BY n.id)")
    parts.append("moved AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS round, sum(abs(b.rank - a.rank)) AS moved FROM r{i} a JOIN r{i + 1} b USING (id)" for i in range(ROUNDS)) + ")")
    parts.append("ranks AS (" + " UNION ALL ".join(f"SELECT {i + 1} AS round, id, rank FROM r{i + 1}" for i in range(ROUNDS)) + ")")
    parts.append("r AS (SELECT id, rank FROM ranks WHERE round = (SELECT coalesce(min(round) FILTER (WHERE moved < 1e-6), max(round)) FROM moved))")
    return ", ".join(parts)


@query(_rank_sql(LINK_SQL, "ln", "le") + f" SELECT id, round(rank, 6) AS rank FROM r")
def pagerank_fixed(spark, sf):
    g = link_graph(spark, sf)
    files, edges = graph.file_graph(g)
    return analytics.pagerank(files, edges).select("id", F.round("rank", 6).alias("rank"))


@query(_rank_sql(KEY_SQL, "(SELECT id FROM kn WHERE ntype = 'file')", "(SELECT src, dst FROM ke WHERE etype = 'imports')") + f""",
t AS (SELECT id AS path, round(rank, 6) AS pagerank, (SELECT count(*) FROM l WHERE dst = id) AS in_degree, (SELECT count(*) FROM l WHERE src = id) AS out_degree FROM r)
SELECT * FROM t ORDER BY pagerank DESC, path LIMIT 20""")
def centrality_topn(spark, sf):
    files, edges = graph.file_graph(key_graph(spark, sf))
    ranks = analytics.pagerank(files, edges).select("id", F.round("rank", 6).alias("pagerank"))
    return ranks.join(graph.in_out_degrees(files, edges), "id").select(F.col("id").alias("path"), "pagerank", "in_degree", "out_degree").orderBy(F.desc("pagerank"), "path").limit(20)


@query("""WITH t AS (
  SELECT 'r:' || r_regionkey AS node, r_regionkey AS r FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'n:' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'c:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 's:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT node, min(node) OVER (PARTITION BY r) AS component FROM t""")
def connected_components(spark, sf):
    return components.connected_components(key_graph(spark, sf).of_types("imports"))


_CYCLES = f"""WITH RECURSIVE {STEP_SQL}, w AS (
  SELECT [src] AS chain, dst FROM te WHERE src < dst
  UNION ALL SELECT list_append(chain, w.dst), te.dst FROM w JOIN te ON te.src = w.dst WHERE NOT list_contains(chain, w.dst) AND w.dst > chain[1] AND te.dst >= chain[1])
, f AS (SELECT len(chain) AS length, array_to_string(chain, ' ') AS chain FROM w WHERE dst = chain[1] AND len(chain) >= 2)"""


@query(_CYCLES + " SELECT CAST(length AS INTEGER) AS length, chain FROM f")
def cycles_list(spark, sf):
    edges = step_edges(spark, sf)
    return analytics.cycles(nodes_of(edges), edges).select("length", F.array_join("chain", " ").alias("chain"))


@query(_CYCLES + " SELECT CAST(length AS INTEGER) AS length, count(*) AS cycles FROM f GROUP BY 1")
def cycles_by_length(spark, sf):
    edges = step_edges(spark, sf)
    return analytics.cycles(nodes_of(edges), edges).groupBy("length").agg(F.count("*").alias("cycles"))


@query()
def betweenness(spark, sf):
    files, edges = graph.file_graph(link_graph(spark, sf))
    return analytics.betweenness(files, edges)


@query()
def louvain(spark, sf):
    files, edges = graph.file_graph(key_graph(spark, sf))
    return analytics.louvain(files, edges)


# search and resolution

def _score_sql(hay: str, needle: str) -> str:
    return f"CASE WHEN {hay} = '{needle}' THEN 3 WHEN starts_with({hay}, '{needle}') THEN 2 WHEN contains({hay}, '{needle}') THEN 1 ELSE 0 END"


@query(f"""WITH {LINK_SQL}, d AS (SELECT e AS id, count(*) AS degree FROM (SELECT unnest([src, dst]) AS e FROM le) GROUP BY 1),
h AS (SELECT ln.id AS path, language, {_score_sql("lower(ln.id)", "/the")} AS score, coalesce(degree, 0) AS degree FROM ln LEFT JOIN d USING (id))
SELECT path, language, CAST(0 AS BIGINT) AS exports, (SELECT count(*) FROM le WHERE dst = path) AS imported_by, CAST(score AS INTEGER) AS score, degree FROM h WHERE score > 0 ORDER BY score DESC, degree DESC, path LIMIT 20""")
def search_files(spark, sf):
    return search.search_files(link_graph(spark, sf), "/The ")


def _symbol_sql(needle: str, more: str = "") -> str:
    return f"""WITH {KEY_SQL}, h AS (SELECT kn.*, {_score_sql("lower(name)", needle)} AS score, degree FROM kn JOIN kd USING (id) WHERE ntype = 'symbol' {more})
SELECT name, stype AS type, path AS file, '' AS signature, (SELECT count(*) FROM ke WHERE dst = h.id AND etype IN ('uses', 'calls')) AS callers, '' AS intent, '' AS via, CAST(score AS INTEGER) AS score, degree
FROM h WHERE score > 0 ORDER BY score DESC, degree DESC, id LIMIT 20"""


@query(_symbol_sql("ring"))
def search_symbols(spark, sf):
    return search.search_symbols(key_graph(spark, sf), "Ring")


@query(_symbol_sql("1-urgent", "AND path IN (SELECT id FROM kn WHERE subproject = 'MACHINERY')"))
def search_by_subproject(spark, sf):
    return search.search_symbols(key_graph(spark, sf), "1-URGENT", subproject="MACHINERY")


@query(f"""WITH {KEY_SQL}, s AS (SELECT kn.id, name, {_score_sql("lower(name)", "economy")} AS a, {_score_sql("lower(p_brand)", "economy")} AS b, {_score_sql("lower(p_type)", "economy")} AS c, p_brand, p_type, degree FROM kn JOIN kd USING (id) JOIN part ON kn.id = 'p:' || p_partkey),
h AS (SELECT *, greatest(a, b, c) AS score, CASE WHEN c > greatest(a, b) THEN '@' || p_brand || '(' || p_type || ')' WHEN b > a THEN '@' || p_brand ELSE '' END AS via FROM s)
SELECT name, via, CAST(score AS INTEGER) AS score, degree FROM h WHERE score > 0 ORDER BY score DESC, degree DESC, id LIMIT 20""")
def search_decorators(spark, sf):
    g = key_graph(spark, sf)
    decs = table(spark, sf, "part").select(F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.struct(F.col("p_brand").alias("name"), F.array("p_type").alias("args"))).alias("decorators"))
    return search.search_symbols(PropertyGraph(g.nodes.join(decs, "id", "left"), g.edges), "economy").select("name", "via", "score", "degree")


def _literals(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "value"))
    return docs.filter(F.length("value") >= 8).select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), "value", F.col("n").alias("line"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("seq"))


_LITERALS = "v AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS value FROM documents), l AS (SELECT * FROM v WHERE length(value) >= 8)"


@query(f"WITH {_LITERALS} SELECT lower(value) AS key, count(*) AS places, count(DISTINCT doc_id) AS symbols FROM l GROUP BY 1")
def literal_index(spark, sf):
    return search.literal_index(_literals(spark, sf)).groupBy("key").agg(F.count("*").alias("places"), F.count_distinct("id").alias("symbols"))


@query(f"WITH {_LITERALS} SELECT value, 'doc ' || doc_id AS symbol, (SELECT source FROM documents d WHERE d.doc_id = l.doc_id) AS file, CAST(line AS INTEGER) AS line FROM l WHERE contains(lower(value), 'token = ') ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0'), line, value LIMIT 20")
def literal_search(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("name"), F.col("source").alias("path"))
    return search.search_literals(search.literal_index(_literals(spark, sf)), docs, '"Token = "')


@query(f"""WITH {KEY_SQL}, h AS (SELECT id, CASE WHEN ntype = 'file' THEN 'file: ' || id ELSE 'symbol: ' || name || ' (' || path || ')' END AS label,
regexp_replace(lower(CASE WHEN ntype = 'file' THEN id ELSE name END), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS n, degree FROM kn JOIN kd USING (id)),
s AS (SELECT id, label, {_score_sql("n", "smallring")} AS score, degree FROM h)
SELECT label, CAST(score AS INTEGER) AS score, degree FROM s WHERE score > 0 ORDER BY score DESC, degree DESC, id LIMIT 3""")
def did_you_mean(spark, sf):
    return search.did_you_mean(key_graph(spark, sf), "Small_Ring")


@query(f"WITH {KEY_SQL} SELECT name, stype AS type, path AS file, CAST(0 AS INTEGER) AS line FROM kn WHERE ntype = 'symbol' AND name = 'small ring'")
def resolve_ambiguous(spark, sf):
    return resolve.candidates(resolve.resolve(key_graph(spark, sf), "small ring"))


@query(f"WITH {KEY_SQL} SELECT id, path FROM kn WHERE ntype = 'symbol' AND name = 'red widget' AND path IN (SELECT path FROM kn WHERE ntype = 'symbol' AND name = 'small ring') ORDER BY id LIMIT 1")
def resolve_dotted(spark, sf):
    return resolve.resolve_dotted(key_graph(spark, sf), "small ring.red widget").select("id", "path")


# context

_NEAR = """h1 AS (SELECT DISTINCT dst AS id FROM b WHERE src = 'c:5'), k AS (SELECT 'c:5' AS id UNION SELECT id FROM h1 UNION SELECT b.dst FROM b JOIN h1 ON b.src = h1.id),
se AS (SELECT ke.* FROM ke WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)), sn AS (SELECT kn.* FROM kn WHERE id IN (SELECT id FROM k))"""
_KEY_BOTH = "b AS (SELECT src, dst FROM ke UNION ALL SELECT dst, src FROM ke)"


@query(f"""WITH {KEY_SQL}, {_KEY_BOTH}, {_NEAR}, r AS (SELECT e AS id, count(*) AS refs FROM (SELECT unnest([src, dst]) AS e FROM se) GROUP BY 1)
SELECT id, name, path, coalesce(refs, 0) AS refs FROM sn LEFT JOIN r USING (id) WHERE ntype = 'symbol' AND path <> 'c:5' ORDER BY refs DESC, id LIMIT 30""")
def neighbor_symbol_cap(spark, sf):
    g = key_graph(spark, sf)
    return context.neighbor_symbols(graph.induced(g, graph.khop(g, one(spark, "c:5"), 2)), "c:5").select("id", "name", "path", "refs")


@query(f"""WITH {KEY_SQL}, {_KEY_BOTH}, {_NEAR}
SELECT 'neighbors' AS section, id || '|' || language AS cells FROM sn WHERE ntype = 'file' AND id <> 'c:5'
UNION ALL SELECT 'exports', name || '|' || stype || '|0||' FROM sn WHERE ntype = 'symbol' AND path = 'c:5'
UNION ALL SELECT 'neighbor_symbols', name || '|' || stype || '|' || path || '|' FROM sn WHERE ntype = 'symbol' AND path <> 'c:5'
UNION ALL SELECT 'imports', src || '|' || dst FROM se WHERE etype = 'imports' AND src = 'c:5'
UNION ALL SELECT 'calls', src || '|' || dst FROM se WHERE etype = 'calls' AND src IN (SELECT id FROM sn WHERE path = 'c:5' AND ntype = 'symbol')""")
def context_sections(spark, sf):
    g = key_graph(spark, sf)
    found = context.context_sections(g, resolve.find(g, "c:5"), 2, most=0)
    return found.select("section", F.array_join("cells", "|").alias("cells"))


@query(f"""WITH {LINK_SQL} SELECT 'files' AS section, id || '|' || language || '|' || subproject AS cells FROM ln UNION ALL SELECT 'imports', src || '|' || dst FROM le""")
def index_dump(spark, sf):
    return context.dump(link_graph(spark, sf)).select("section", F.array_join("cells", "|").alias("cells"))


# edge derivation: parts as definitions in files named after brands

def _code(spark, sf):
    """A listing of brands, their symbols (of several parts of a name in a brand the last counts; each extends the name of
    the part after it and calls that of the second after it) and imports from a part's brand to that of the next part."""
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    listing = part.select(F.col("p_brand").alias("path")).distinct().select("path", F.lit("python").alias("language"), F.lit("").alias("subproject"), F.expr("cast(substring(path, 7) as bigint)").alias("file_seq"))
    after = [part.select((F.col("p_partkey") - i).alias("p_partkey"), F.col("p_name").alias(f"name{i}"), F.col("p_brand").alias(f"brand{i}")) for i in (1, 2)]
    rows = part.join(after[0], "p_partkey", "left").join(after[1], "p_partkey", "left")
    last = rows.groupBy(F.col("p_brand").alias("path"), F.col("p_name").alias("name")).agg(F.max_by("name1", "p_partkey").alias("extends_name"), F.min("p_partkey").alias("sym_seq"), F.array_compact(F.collect_list("name2")).alias("raw_calls"))
    symbols = last.join(listing, "path").withColumn("id", F.concat("name", F.lit("@"), "path"))
    imports = rows.filter("brand1 is not null").select(F.col("p_brand").alias("path"), F.col("brand1").alias("target"), F.array("name1").alias("names"))
    return listing, symbols, imports


_CODE = """rows AS (SELECT a.p_partkey AS k, a.p_name AS name, a.p_brand AS path, b.p_name AS name1, b.p_brand AS brand1, c.p_name AS name2 FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey + 1 LEFT JOIN part c ON c.p_partkey = a.p_partkey + 2),
sy AS (SELECT name || '@' || path AS id, name, path, arg_max_null(name1, k) AS parent, min(k) AS ss, CAST(path[7:] AS BIGINT) AS fs FROM rows GROUP BY name, path),
im AS (SELECT DISTINCT path AS src, brand1 AS dst, 'imports' AS etype, 1 AS p FROM rows WHERE brand1 <> path),
us AS (SELECT DISTINCT path AS src, name1 || '@' || brand1 AS dst, 'uses' AS etype, 1 AS p FROM rows WHERE brand1 <> path),
ex AS (SELECT src, arg_min(dst, (far, fs, ss)) AS dst, 'extends' AS etype, 2 AS p FROM (SELECT a.id AS src, b.id AS dst, CASE WHEN a.path = b.path THEN 0 ELSE 1 END AS far, b.fs, b.ss FROM sy a JOIN sy b ON a.parent = b.name) GROUP BY src),
cl AS (SELECT DISTINCT name || '@' || path AS src, path, name2 FROM rows WHERE name2 IS NOT NULL),
c1 AS (SELECT src, name2, sy.id AS dst FROM cl JOIN sy ON sy.name = cl.name2 AND sy.path = cl.path),
c2 AS (SELECT cl.src, cl.name2, arg_min(sy.id, (fs, ss)) AS dst FROM cl JOIN us ON us.src = cl.path JOIN sy ON sy.id = us.dst AND sy.name = cl.name2 WHERE (cl.src, cl.name2) NOT IN (SELECT src, name2 FROM c1) GROUP BY 1, 2),
al AS (SELECT path AS src, id AS dst, 'defines' AS etype, 0 AS p FROM sy UNION ALL FROM im UNION ALL FROM us UNION ALL FROM ex UNION ALL SELECT DISTINCT src, dst, 'calls', 3 FROM (SELECT src, dst FROM c1 UNION ALL SELECT src, dst FROM c2)),
de AS (SELECT src, dst, arg_max(etype, p) AS etype FROM al GROUP BY 1, 2)"""


def _derived(kind: str):
    def run(spark, sf):
        return link.derive_edges(*_code(spark, sf)).filter(F.col("etype") == kind).select("src", "dst", "evidence")

    return run


for _name, _kind in (("imports_edges", "imports"), ("uses_edges", "uses"), ("extends_local_first", "extends"), ("calls_resolved", "calls"), ("defines_edges", "defines")):
    QUERIES[_name] = _derived(_kind)
    ORACLE_SQL[_name] = f"WITH {_CODE} SELECT src, dst, {'NULL::VARCHAR' if _kind == 'defines' else repr('ast')} AS evidence FROM de WHERE etype = '{_kind}'"


@query("""WITH f AS (SELECT p_partkey AS k FROM part WHERE p_partkey % 3 = 0 AND p_partkey + 1 IN (SELECT p_partkey FROM part)),
t AS (SELECT 'pkg' || k % 7 || '/m' || k || '.py' AS a, 'pkg' || k % 7 || '/test_m' || k || '.py' AS b FROM f)
SELECT a AS src, b AS dst, 'tested_by' AS etype FROM t UNION ALL SELECT b, a, 'tests' FROM t""")
def test_pairing(spark, sf):
    k = F.col("p_partkey")
    part = k % 3
    n = (k - part).cast("string")
    folder = F.concat(F.lit("pkg"), ((k - part) % 7).cast("string"))
    path = F.when(part == 0, F.concat(folder, F.lit("/m"), n)).when(part == 1, F.concat(folder, F.lit("/test_m"), n)).otherwise(F.concat(F.lit("tests/test_m"), n))
    return link.test_edges(table(spark, sf, "part").select(F.concat(path, F.lit(".py")).alias("path"))).select("src", "dst", "etype")


# change tracking

def _snapshots(spark, sf) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf, "orders").select(F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey", "o_custkey", F.col("o_totalprice").alias("mtime"), F.col("o_orderpriority").alias("print"))
    old = orders.filter("o_custkey % 10 != 0")
    new = orders.filter("o_orderkey % 7 != 0").withColumn("mtime", F.when(F.col("o_orderkey") % 11 == 0, F.col("mtime") + 1).otherwise(F.col("mtime"))).withColumn("print", F.when(F.col("o_orderkey") % 13 == 0, F.concat("print", F.lit("!"))).otherwise(F.col("print")))
    return old, new


_STATUS = """s AS (SELECT 'o:' || o_orderkey AS path, o_orderkey AS k, o_orderpriority AS print, CASE WHEN o_custkey % 10 = 0 THEN 'added' WHEN o_orderkey % 7 = 0 THEN 'deleted' WHEN o_orderkey % 11 = 0 THEN 'modified' ELSE 'unchanged' END AS status FROM orders WHERE o_custkey % 10 <> 0 OR o_orderkey % 7 <> 0)"""


@query(f"WITH {_STATUS} SELECT path, status FROM s")
def snapshot_diff(spark, sf):
    return snapshot.snapshot_diff(*_snapshots(spark, sf))


@query(f"WITH {_STATUS} SELECT " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in ("added", "modified", "deleted", "unchanged")) + " FROM s")
def incremental_summary(spark, sf):
    return snapshot.summary(snapshot.snapshot_diff(*_snapshots(spark, sf)))


@query(f"WITH {_STATUS} SELECT path, CASE WHEN k % 13 = 0 AND status IN ('added', 'modified') THEN print || '!' ELSE print END AS print FROM s WHERE status <> 'deleted'")
def incremental_upsert(spark, sf):
    old, new = _snapshots(spark, sf)
    return snapshot.upsert(old.select("path", "print"), new.select("path", "print"), snapshot.snapshot_diff(old, new))


@query(f"WITH {_STATUS} SELECT true AS indexed, CAST(0 AS DOUBLE) AS age_s, true AS stale, count(*) AS files_changed FROM s WHERE status <> 'unchanged'")
def freshness_counts(spark, sf):
    return snapshot.freshness(*_snapshots(spark, sf))


@query(f"""WITH {_STATUS} SELECT path, CASE status WHEN 'added' THEN 'new' WHEN 'deleted' THEN 'deleted' ELSE 'changed' END AS status,
CASE WHEN status IN ('added', 'deleted') THEN '-' ELSE print || '!' END AS added, CASE WHEN status IN ('added', 'deleted') THEN '-' ELSE print END AS removed FROM s WHERE status IN ('added', 'deleted') OR k % 13 = 0""")
def symbol_diff(spark, sf):
    return snapshot.symbol_diff(*_snapshots(spark, sf))


@query("SELECT o_orderpriority AS key, CAST(count(*) FILTER (WHERE o_orderkey % 7 <> 0) - count(*) FILTER (WHERE o_custkey % 10 <> 0) AS BIGINT) AS delta FROM orders GROUP BY 1")
def index_delta(spark, sf):
    orders = table(spark, sf, "orders")
    counted = [orders.filter(c).groupBy(F.col("o_orderpriority").alias("key")).agg(F.count("*").alias("value")) for c in ("o_custkey % 10 != 0", "o_orderkey % 7 != 0")]
    return snapshot.index_delta(*counted)


# reports

def _covered(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("path"), F.length("text").alias("size"), "lang", "source")
    return report.coverage(docs, F.col("lang").isin("en", "de", "fr"), 6000)


_COVERED = "c AS (SELECT 'd:' || doc_id AS path, source, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'no_parser' WHEN length(text) > 6000 THEN 'too_large' ELSE 'indexed' END AS bucket FROM documents)"


@query(f"WITH {_COVERED} SELECT source, bucket, count(*) AS files FROM c GROUP BY 1, 2")
def coverage_buckets(spark, sf):
    return report.coverage_buckets(_covered(spark, sf), "source")


@query(f"WITH {_COVERED}, t AS (SELECT count(*) FILTER (WHERE bucket = 'indexed') AS indexed, count(*) AS total FROM c) SELECT indexed, total, round_even(indexed * 100.0 / total, 1)::DOUBLE AS percent FROM t")
def coverage_pct(spark, sf):
    return report.coverage_percent(_covered(spark, sf))


@query(f"WITH {_COVERED}, t AS (SELECT bucket, path, CAST(row_number() OVER (PARTITION BY bucket ORDER BY path) AS INTEGER) AS n FROM c WHERE bucket <> 'indexed') SELECT bucket, n, path FROM t WHERE n <= 5")
def coverage_examples(spark, sf):
    return report.coverage_examples(_covered(spark, sf))


@query("SELECT count(*) AS files, count(*) * 500 AS est_tokens, CASE WHEN count(*) < 120 THEN 'small' WHEN count(*) < 150 THEN 'medium' ELSE 'large' END AS verdict FROM pages")
def codebase_fit(spark, sf):
    return link.codebase_fit(table(spark, sf, "pages"))


@query("SELECT lang, count(*) AS files, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens FROM documents GROUP BY 1")
def token_cost(spark, sf):
    return table(spark, sf, "documents").select("lang", tokens(F.length("text")).alias("t")).groupBy("lang").agg(F.count("*").alias("files"), F.sum("t").alias("tokens"))


@query(f"""WITH {DOC_SQL}, r AS (SELECT src, sum(tokens) AS others FROM di JOIN df ON dst = path GROUP BY 1), h AS (SELECT dst, count(*) AS callers FROM di GROUP BY 1),
t AS (SELECT path, CAST(tokens + coalesce(others, 0) AS BIGINT) AS manual, tokens + 300 AS query, coalesce(callers, 0) AS callers FROM df LEFT JOIN r ON src = path LEFT JOIN h ON dst = path)
SELECT path, manual AS manual_tokens, query AS query_tokens, manual - query AS saved_tokens, round_even((manual - query) * 100.0::DOUBLE / manual, 1) AS saved_pct, callers AS hidden_callers FROM t""")
def benchmark_savings(spark, sf):
    files, imports = document_files(spark, sf)
    return report.savings(files, imports, files.select("path", F.lit(300).cast("bigint").alias("context_tokens")))


@query("""WITH l AS (SELECT doc_id, length(text) AS chars, unnest(string_split(text, chr(10))) AS line FROM documents),
h AS (SELECT doc_id, count(*) AS lines, sum(length(line) + length('d:' || doc_id) + 2) AS shown, max(chars) AS chars FROM l WHERE regexp_matches(line, 'token\\s*=') GROUP BY 1)
SELECT count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, greatest(1, CAST(sum(shown) AS BIGINT) // 4) AS output_tokens, CAST(sum(greatest(1, chars // 4)) AS BIGINT) AS read_tokens FROM h""")
def grep_compare(spark, sf):
    return report.grep_cost(table(spark, sf, "documents").select(F.concat(F.lit("d:"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content")), r"token\s*=")


@query(f"""WITH {DOC_SQL}, o AS (SELECT src, count(*) AS imports FROM di GROUP BY 1),
r AS (SELECT path, imports, tokens, row_number() OVER (ORDER BY imports DESC, path) - 1 AS n, count(*) OVER () AS total FROM df JOIN o ON src = path WHERE language IN ('python', 'go'))
SELECT path, imports, tokens FROM r WHERE n % greatest(1, total // 10) = 0 AND tokens >= 500 ORDER BY n LIMIT 5""")
def audit_stride_sample(spark, sf):
    return report.audit_sample(*document_files(spark, sf))


@query("SELECT role AS call_type, count(*) AS calls, CAST(sum(greatest(1, length(text) // 4)) AS BIGINT) AS tokens, count(*) FILTER (WHERE greatest(1, length(text) // 4) < 200) AS small FROM conversations GROUP BY 1")
def usage_rollup(spark, sf):
    return report.usage(table(spark, sf, "conversations").select(F.col("role").alias("call_type"), tokens(F.length("text")).alias("response_tokens")))


@query("WITH t AS (SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY 1) SELECT conv_id, tokens, CASE WHEN tokens <= 1500 THEN 'healthy' WHEN tokens <= 2000 THEN 'warn' ELSE 'over' END AS verdict FROM t")
def baseline_verdict(spark, sf):
    cost = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.floor(F.length("text") / 4)).cast("bigint").alias("tokens"))
    return cost.select("conv_id", "tokens", report.tax_verdict(F.col("tokens")).alias("verdict"))


@query(f"WITH {KEY_SQL} SELECT id, degree FROM kn JOIN kd USING (id) WHERE ntype = 'file' ORDER BY degree DESC, id LIMIT 1")
def top_connected(spark, sf):
    return graph.top_connected(key_graph(spark, sf))


@query(f"""WITH {KEY_SQL}, r AS (SELECT id, (SELECT count(*) FROM ke WHERE etype = 'imports' AND dst = id) / 1000.0::DOUBLE AS pagerank FROM kn WHERE ntype = 'file'),
m AS (SELECT min(pagerank) AS low, max(pagerank) AS high FROM r), i AS (SELECT dst, count(*) AS n FROM ke GROUP BY 1), o AS (SELECT src, count(*) AS n FROM ke GROUP BY 1),
x AS (SELECT src, array_to_string(list(name || ':' || stype ORDER BY id)[1:8], ' ') AS exports FROM ke JOIN kn ON dst = id WHERE ntype = 'symbol' GROUP BY src)
SELECT kn.id, kn.id AS label, language, subproject, -1 AS community, '#4C566A' AS color, round(CAST(6 + 22 * (pagerank - low) / (high - low) AS DECIMAL(38, 16)), 2)::DOUBLE AS radius, pagerank, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree, coalesce(exports, '') AS exports
FROM kn JOIN r ON kn.id = r.id CROSS JOIN m LEFT JOIN i ON i.dst = kn.id LEFT JOIN o ON o.src = kn.id LEFT JOIN x ON x.src = kn.id""")
def viz_nodes(spark, sf):
    g = key_graph(spark, sf)
    ranks = g.files.select("id").join(g.of_types("imports").groupBy(F.col("dst").alias("id")).agg((F.count("*") / 1000.0).alias("pagerank")), "id", "left").fillna(0.0, ["pagerank"])
    return report.viz_nodes(g, ranks)


@query(f"WITH {KEY_SQL} SELECT src AS source, dst AS target, etype, 'ast' AS evidence, 1.0::DOUBLE AS weight FROM ke WHERE etype = 'imports'")
def viz_links(spark, sf):
    return report.viz_links(key_graph(spark, sf))


QUERIES |= ingest.QUERIES
ORACLE_SQL |= ingest.ORACLE_SQL


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: the two-hop context of a page in the link graph, all sections in one result."""
    g = link_graph(spark, sf)
    return context.context_sections(g, resolve.find(g, "p:0")).select("section", "ord", F.array_join("cells", "|").alias("cells"))
