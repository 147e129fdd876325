"""Graph queries: neighbourhoods, amendment impact, degrees, cycles, density, components."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import graph as g
from lexloom.plans.catalog import query
from lexloom.sources.tables import edges, laws, nodes, versions, with_tables

T = with_tables
SEED = 5

_STEPS = """p AS (
  SELECT src AS node, 1 AS length, [{'s': src, 'd': dst, 't': rel_type}] AS trail FROM edges WHERE dst = 5
  UNION ALL
  SELECT e.src, p.length + 1, list_append(p.trail, {'s': e.src, 'd': e.dst, 't': e.rel_type}) FROM p JOIN edges e ON e.dst = p.node
  WHERE p.length < 3 AND NOT list_contains(p.trail, {'s': e.src, 'd': e.dst, 't': e.rel_type}))"""
_IMPACT = f"WITH {_STEPS}, i AS (SELECT node, min(length) AS impact_level, count(*) AS path_count FROM p GROUP BY node)"


def seed(spark):
    return spark.createDataFrame([(SEED,)], "node long")


@query(T("SELECT src, dst, rel_type, 'out' AS direction FROM edges WHERE src = 5 UNION ALL SELECT src, dst, rel_type, 'in' FROM edges WHERE dst = 5", "edges"))
def g01_one_hop(spark, d):
    e = edges(spark, d)
    side = lambda where: g.hop(e, seed(spark), where).select("src", "dst", "rel_type", F.lit(where).alias("direction"))
    return side("out").unionByName(side("in"))


@query(T(f"{_IMPACT} SELECT node, impact_level::INTEGER AS impact_level, path_count FROM i", "edges", recursive=True))
def g02_impact_paths(spark, d):
    """Amendment impact by paths: no edge twice in a path, shortest distance, number of paths."""
    return g.impact_by_paths(edges(spark, d), seed(spark), 3)


_USED = "u AS (SELECT * FROM edges WHERE confidence >= 0.8)"


def _level(k: int) -> str:
    """SQL of one breadth-first level: of the edges that reach a node, the strongest, then the least source, counts."""
    seen = " UNION ALL ".join(f"SELECT node FROM l{i}" for i in range(1, k)) or "SELECT -1"
    path = "f.path" if k > 1 else "[5::BIGINT]"
    source = f"JOIN l{k - 1} f ON f.node = u.dst" if k > 1 else "JOIN (SELECT 5 AS node) f ON f.node = u.dst"
    return f"""l{k} AS (SELECT node, {k} AS depth, c, rel_type, list_append(path, node) AS path FROM (
      SELECT u.src AS node, u.confidence AS c, u.rel_type, {path} AS path,
        row_number() OVER (PARTITION BY u.src ORDER BY u.confidence DESC, u.dst, u.rel_type DESC) AS r FROM u {source} WHERE u.src NOT IN ({seen})) WHERE r = 1)"""


@query(T(f"WITH {_USED}, {_level(1)}, {_level(2)}, {_level(3)}, a AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) SELECT node, depth, round(c * pow(0.9, depth - 1), 6) AS confidence, CASE rel_type WHEN 'APPLIES' THEN 'DirectApplication' WHEN 'REPLACES' THEN 'TextReplacement' ELSE 'General' END AS impact_type, array_to_string(path, ',') AS path FROM a", "edges"))
def g03_impact_levels(spark, d):
    """Amendment impact by levels: first visit counts, confidence falls by a tenth a level."""
    return g.impact_by_levels(edges(spark, d), seed(spark), 3, 0.8).withColumn("path", F.array_join(F.col("path").cast("array<string>"), ","))


@query(T(f"{_IMPACT}, s AS (SELECT *, round(least(0.7 / (0.5 * impact_level) + 0.3 * least(path_count / 10, 1.0), 1.0), 6) AS score FROM i) SELECT node, impact_level::INTEGER AS impact_level, path_count, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS band, n.law, n.title FROM s JOIN nodes n ON n.node_id = s.node", "edges", "nodes", recursive=True))
def g04_impact_scored(spark, d):
    found = g.impact_score(g.impact_by_paths(edges(spark, d), seed(spark), 3))
    return found.join(nodes(spark, d).select(F.col("node_id").alias("node"), "law", "title"), "node")


_CHAIN = """e2 AS (SELECT * FROM edges WHERE rel_type = 'APPLIES'), p AS (
  SELECT dst AS node, 1 AS length, [[src, dst]] AS trail FROM e2 WHERE src = 5
  UNION ALL SELECT e2.dst, p.length + 1, list_append(p.trail, [e2.src, e2.dst]) FROM p JOIN e2 ON e2.src = p.node WHERE p.length < 5 AND NOT list_contains(p.trail, [e2.src, e2.dst]))"""


@query(T(f"WITH {_CHAIN} SELECT node, min(length)::INTEGER AS shortest, max(length)::INTEGER AS longest, count(*) AS chains FROM p GROUP BY node", "edges", recursive=True))
def g05_chains(spark, d):
    """Reference chains of one to five edges of one type, none used twice."""
    found = g.paths(edges(spark, d).where("rel_type = 'APPLIES'"), seed(spark), 5)
    return found.groupBy("node").agg(F.min("length").alias("shortest"), F.max("length").alias("longest"), F.count("*").alias("chains"))


_SAME = "({0}.src = {1}.src AND {0}.dst = {1}.dst AND {0}.rel_type = {1}.rel_type)"


@query(
    T(
        f"WITH s AS (SELECT src, dst, rel_type FROM edges WHERE confidence >= 0.95), x AS (SELECT src AS first, dst AS last, 1 AS length FROM s UNION ALL SELECT a.src, b.dst, 2 FROM s a JOIN s b ON b.src = a.dst WHERE NOT {_SAME.format('a', 'b')} "
        f"UNION ALL SELECT a.src, c.dst, 3 FROM s a JOIN s b ON b.src = a.dst JOIN s c ON c.src = b.dst WHERE NOT {_SAME.format('a', 'b')} AND NOT {_SAME.format('b', 'c')} AND NOT {_SAME.format('a', 'c')}) SELECT first, last, length, count(*) AS chains FROM x GROUP BY ALL",
        "edges",
    )
)
def g06_strong_chains(spark, d):
    """Chains of one to three edges from every node, each edge passing a predicate: edges are filtered before they are joined."""
    strong = edges(spark, d).where("confidence >= 0.95")
    found = g.walk_counts(strong, strong.select(F.col("src").alias("node")).distinct(), 3)
    return found.select(F.col("seed").alias("first"), F.col("node").alias("last"), "length", F.col("walks").alias("chains"))


@query(T(f"WITH {_STEPS} SELECT length::INTEGER AS length, count(*) AS n FROM p GROUP BY length", "edges", recursive=True))
def g07_depths(spark, d):
    return g.walk_counts(edges(spark, d), seed(spark), 3, reverse=True).groupBy("length").agg(F.sum("walks").alias("n"))


@query(T("WITH x AS (SELECT src AS node, 0 AS i, 1 AS o FROM edges WHERE src <> dst UNION ALL SELECT dst, 1, 0 FROM edges WHERE src <> dst) SELECT node, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM x GROUP BY node ORDER BY in_degree DESC, node LIMIT 10", "edges"))
def g08_degrees_top(spark, d):
    return g.degrees(edges(spark, d)).orderBy(F.desc("in_degree"), "node").limit(10)


@query(T("SELECT dst AS node, count(*) AS n, title FROM edges JOIN nodes ON node_id = dst GROUP BY dst, title ORDER BY n DESC, node LIMIT 10", "edges", "nodes"))
def g09_most_referenced(spark, d):
    top = edges(spark, d).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(10)
    return top.join(nodes(spark, d).select(F.col("node_id").alias("node"), "title"), "node")


@query(T("SELECT node_id, law FROM nodes WHERE node_id NOT IN (SELECT src FROM edges WHERE confidence = 1 UNION ALL SELECT dst FROM edges WHERE confidence = 1)", "edges", "nodes"))
def g10_isolated(spark, d):
    return g.isolated(nodes(spark, d), edges(spark, d).where("confidence = 1")).select("node_id", "law")


@query(T("SELECT DISTINCT least(a.src, a.dst) AS a, greatest(a.src, a.dst) AS b FROM edges a JOIN edges b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst", "edges"))
def g11_mutual(spark, d):
    return g.mutual_pairs(edges(spark, d))


@query(T("WITH x AS (SELECT DISTINCT src, dst FROM edges WHERE src <> dst AND confidence >= 0.9) SELECT a.src AS a, b.src AS b, c.src AS c FROM x a JOIN x b ON b.src = a.dst JOIN x c ON c.src = b.dst AND c.dst = a.src WHERE a.src < b.src AND a.src < c.src", "edges"))
def g12_triangles(spark, d):
    return g.triangles(edges(spark, d).where("confidence >= 0.9"))


@query(T("SELECT a.law AS law_a, b.law AS law_b, count(*) AS n FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE a.law <> b.law GROUP BY ALL", "edges", "nodes"))
def g13_density(spark, d):
    return g.density(edges(spark, d), nodes(spark, d))


@query(T("SELECT src, dst, count(*) AS n, sum(mentions)::BIGINT AS mentions FROM edges GROUP BY src, dst HAVING count(*) > 2", "edges"))
def g14_dense_pairs(spark, d):
    return edges(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions")).where("n > 2")


@query(T("SELECT 5 AS node, (SELECT string_agg(DISTINCT dst::VARCHAR, ',' ORDER BY dst::VARCHAR) FROM edges WHERE src = 5) AS out_set, (SELECT string_agg(DISTINCT src::VARCHAR, ',' ORDER BY src::VARCHAR) FROM edges WHERE dst = 5) AS in_set", "edges"))
def g15_ego(spark, d):
    e = g.hop(edges(spark, d), seed(spark), "both")
    out, into = F.when(F.col("src") == SEED, F.col("dst")), F.when(F.col("dst") == SEED, F.col("src"))
    return e.agg(F.array_join(F.sort_array(F.collect_set(out.cast("string"))), ",").alias("out_set"), F.array_join(F.sort_array(F.collect_set(into.cast("string"))), ",").alias("in_set")).select(F.lit(SEED).alias("node"), "out_set", "in_set")


@query(T("WITH c AS (SELECT node_id FROM nodes WHERE law = 'Brand#2' ORDER BY number, node_id LIMIT 50) SELECT e.src, e.dst, e.rel_type, a.title AS src_title, b.title AS dst_title FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE e.src IN (FROM c) OR e.dst IN (FROM c)", "edges", "nodes"))
def g16_subgraph(spark, d):
    return g.subgraph(spark, edges(spark, d), nodes(spark, d), "Brand#2").select("src", "dst", "rel_type", "src_title", "dst_title")


@query(
    T(
        "WITH b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), r(node, m) USING KEY (node) AS (SELECT DISTINCT a, a FROM b "
        "UNION SELECT b.b, min(r.m) FROM r JOIN b ON b.a = r.node JOIN recurring.r AS o ON o.node = b.b WHERE r.m < o.m GROUP BY b.b) SELECT node, m AS component FROM r",
        "edges", recursive=True,
    )
)
def g17_components(spark, d):
    """Weakly connected components of the whole graph."""
    return g.connected(edges(spark, d))


@query(T("SELECT l.law_id, count(DISTINCT v.version_id) AS versions FROM laws l LEFT JOIN versions v USING (law_id) GROUP BY l.law_id", "laws", "versions"))
def g19_hierarchy(spark, d):
    v = versions(spark, d).groupBy("law_id").agg(F.countDistinct("version_id").alias("versions"))
    return laws(spark, d).select("law_id").join(v, "law_id", "left").fillna(0, ["versions"])


@query(T("SELECT DISTINCT rel_type, CASE rel_type WHEN 'APPLIES' THEN 'application' WHEN 'REPLACES' THEN 'replacement' ELSE lower(rel_type) END AS app_type FROM edges", "edges"))
def g20_edge_types(spark, d):
    names = {"APPLIES": "application", "REPLACES": "replacement", "RELATIVE_REF": "relative"}
    kind = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return edges(spark, d).select("rel_type").distinct().select("rel_type", F.coalesce(kind[F.col("rel_type")], F.lower("rel_type")).alias("app_type"))


@query(T("SELECT b.node_id AS src, a.node_id AS dst, 'DELEGATION' AS rel_type, 0.8::DOUBLE AS confidence FROM nodes a JOIN nodes b ON b.law = a.law AND b.number = a.number + 1 AND b.kind = 'PROMO' AND a.kind = 'ECONOMY'", "nodes"))
def g21_reverse_delegation(spark, d):
    """Edges from a decree's article back to the law's article it serves, by an equi-join on the inferred parent."""
    n = nodes(spark, d)
    decree = n.where("kind = 'PROMO'").select(F.col("node_id").alias("src"), "law", (F.col("number") - 1).alias("number"))
    parent = n.where("kind = 'ECONOMY'").select(F.col("node_id").alias("dst"), "law", "number")
    return decree.join(parent, ["law", "number"]).select("src", "dst", F.lit("DELEGATION").alias("rel_type"), F.lit(0.8).alias("confidence"))


@query(T("SELECT 'node' AS what, kind AS label, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', rel_type, count(*) FROM edges GROUP BY rel_type", "nodes", "edges"))
def a28_census(spark, d):
    return g.census(nodes(spark, d), edges(spark, d))


@query(T(f"{_IMPACT} SELECT n.law, count(*) AS articles, count(*) FILTER (impact_level = 1) AS direct, count(*) FILTER (impact_level > 1) AS indirect, max(impact_level)::INTEGER AS deepest FROM i JOIN nodes n ON n.node_id = i.node GROUP BY n.law", "edges", "nodes", recursive=True))
def a23_impact_summary(spark, d):
    found = g.impact_by_paths(edges(spark, d), seed(spark), 3).join(nodes(spark, d).select(F.col("node_id").alias("node"), "law"), "node")
    return found.groupBy("law").agg(F.count("*").alias("articles"), F.count_if(F.col("impact_level") == 1).alias("direct"), F.count_if(F.col("impact_level") > 1).alias("indirect"), F.max("impact_level").alias("deepest"))
