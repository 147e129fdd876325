"""Table maintenance and evaluation queries over the logical tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.operators import evaluation as ev
from lexloom.operators import tables as tb
from lexloom.plans.catalog import query
from lexloom.sources.tables import articles, edges, laws, nodes, versions, with_tables

T = with_tables


@query(T("WITH n AS (SELECT 999 AS version_id, node_id, min(length) AS length FROM articles WHERE version_id = 7 GROUP BY node_id) SELECT version_id, node_id, length FROM articles WHERE version_id <> 7 UNION ALL SELECT 7, node_id, length + 1 FROM n", "articles"))
def k01_replace_part(spark, d):
    """Delete and reload the rows of one version."""
    a = articles(spark, d).select("version_id", "node_id", "length")
    fresh = a.where("version_id = 7").groupBy("version_id", "node_id").agg((F.min("length") + 1).alias("length"))
    return tb.replace_part(a, fresh, "version_id")


@query(T("WITH n AS (SELECT law_id + 10 AS law_id, 'New ' || law_id AS title FROM laws), t AS (SELECT law_id, title FROM laws) SELECT coalesce(t.law_id, n.law_id) AS law_id, coalesce(n.title, t.title) AS title FROM t FULL OUTER JOIN n ON n.law_id = t.law_id", "laws"))
def k02_upsert(spark, d):
    t = laws(spark, d).select("law_id", "title")
    new = t.select((F.col("law_id") + 10).alias("law_id"), F.concat(F.lit("New "), "law_id").alias("title"))
    return tb.upsert(t, new, ["law_id"])


@query(T("WITH t AS (SELECT src, dst, rel_type, confidence FROM edges WHERE rel_type <> 'REPLACES'), n AS (SELECT src, dst, rel_type, confidence FROM edges) SELECT * FROM t UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.src = n.src AND t.dst = n.dst AND t.rel_type = n.rel_type)", "edges"))
def k04_insert_if_absent(spark, d):
    e = edges(spark, d).select("src", "dst", "rel_type", "confidence")
    return tb.insert_if_absent(e.where("rel_type <> 'REPLACES'"), e, ["src", "dst", "rel_type"])


@query(T("SELECT version_id, status, version_id = 42 AS is_active FROM versions", "versions"))
def k06_single_active(spark, d):
    return tb.single_active(versions(spark, d).select("version_id", "status"), 42, "version_id")


@query(T("WITH v AS (SELECT node_id AS id, arg_max(line_status = 'F', (enforced, line_status = 'F')) AS good FROM articles GROUP BY node_id) SELECT n.node_id AS id, CASE WHEN good THEN 'confirmed' WHEN NOT good THEN 'rejected' ELSE 'new' END AS status FROM nodes n LEFT JOIN v ON v.id = n.node_id", "nodes", "articles"))
def k07_validation(spark, d):
    """The last validation sets the status."""
    found = nodes(spark, d).select(F.col("node_id").alias("id"), F.lit("new").alias("status"))
    checks = articles(spark, d).select(F.col("node_id").alias("id"), F.col("enforced").alias("at"), (F.col("line_status") == "F").alias("is_correct"))
    return tb.record_validation(found, checks)


@query(T("SELECT DISTINCT law, number, law || '-' || number AS key, '第' || number || '条' AS shown FROM nodes", "nodes"))
def k08_merge_nodes(spark, d):
    return nodes(spark, d).select("law", "number").distinct().select("law", "number", F.concat("law", F.lit("-"), "number").alias("key"), F.concat(F.lit("第"), "number", F.lit("条")).alias("shown"))


@query(T("SELECT src, dst, rel_type, confidence, CASE WHEN mentions > 1 AND position > 25 THEN 'paragraph-paragraph' WHEN mentions > 1 THEN 'paragraph-article' WHEN position > 25 THEN 'article-paragraph' ELSE 'article-article' END AS level FROM edges", "edges"))
def k09_edge_granularity(spark, d):
    many, late = F.col("mentions") > 1, F.col("position") > 25
    level = F.when(many & late, "paragraph-paragraph").when(many, "paragraph-article").when(late, "article-paragraph").otherwise("article-article")
    return edges(spark, d).select("src", "dst", "rel_type", "confidence", level.alias("level"))


@query(T("SELECT DISTINCT node_id, chapter, flag, line_status FROM articles", "articles"))
def k10_merge_edges(spark, d):
    return articles(spark, d).select("node_id", "chapter", "flag", "line_status").dropDuplicates(["node_id", "chapter", "flag", "line_status"])


@query(T("SELECT count(*) AS n FROM nodes n LEFT JOIN (SELECT node_id, min(flag) AS flag FROM articles GROUP BY node_id) a USING (node_id) WHERE flag IS NULL OR flag <> 'A'", "nodes", "articles"))
def k13_publishable(spark, d):
    a = articles(spark, d).groupBy("node_id").agg(F.min("flag").alias("flag"))
    rows = nodes(spark, d).join(a, "node_id", "left").withColumn("status", F.when(F.col("flag") == "A", "rejected").otherwise(F.col("flag")))
    return tb.publishable(rows).agg(F.count("*").alias("n"))


@query(T("SELECT law_id, version_id, version_date FROM versions QUALIFY row_number() OVER (PARTITION BY law_id ORDER BY version_date DESC, version_id DESC) = 1", "versions"))
def k14_last_wins(spark, d):
    return tb.last_wins(versions(spark, d).select("law_id", "version_id", "version_date"), "law_id", "version_date")


@query(T("SELECT src, dst, rel_type FROM edges WHERE dst NOT IN (SELECT node_id FROM nodes WHERE law <> 'Brand#3')", "edges", "nodes"))
def k15_invalid(spark, d):
    """Edges whose target is gone, were one law's nodes dropped."""
    return tb.invalid(edges(spark, d), nodes(spark, d).where("law != 'Brand#3'")).select("src", "dst", "rel_type")


@query(T("SELECT law, count(*) FILTER (trim(title) <> upper(title)) AS changed, count(*) AS n FROM nodes GROUP BY law", "nodes"))
def k16_normalise_counted(spark, d):
    n = nodes(spark, d).withColumn("new", F.upper("title"))
    return n.groupBy("law").agg(F.count_if(F.trim("title") != F.col("new")).alias("changed"), F.count("*").alias("n"))


_OVERLAP = T("WITH x AS (SELECT chapter AS doc, node_id AS text FROM articles WHERE flag = 'A'), y AS (SELECT chapter AS doc, node_id AS text FROM articles WHERE flag = 'N'), a AS (SELECT doc, text, count(*) AS d FROM x GROUP BY ALL), b AS (SELECT doc, text, count(*) AS e FROM y GROUP BY ALL), o AS (SELECT coalesce(a.doc, b.doc) AS doc_id, count(*) FILTER (d IS NOT NULL AND e IS NOT NULL) AS matched, count(*) FILTER (d IS NULL) AS missed, count(*) FILTER (e IS NULL) AS extra, coalesce(sum(d), 0)::BIGINT AS detected_rows, coalesce(sum(e), 0)::BIGINT AS expected_rows FROM a FULL OUTER JOIN b ON a.doc = b.doc AND a.text = b.text GROUP BY 1) ", "articles")


def _overlap(spark, d):
    a = articles(spark, d)
    side = lambda f: a.where(F.col("flag") == f).select(F.col("chapter").alias("doc_id"), F.col("node_id").alias("text"))
    return ev.text_overlap(side("A"), side("N"))


@query(_OVERLAP + "SELECT * FROM o")
def e01_text_overlap(spark, d):
    return _overlap(spark, d)


@query(_OVERLAP + ", t AS (SELECT sum(matched)::BIGINT AS matched, sum(missed)::BIGINT AS missed, sum(extra)::BIGINT AS extra, sum(detected_rows)::BIGINT AS detected_rows, sum(expected_rows)::BIGINT AS expected_rows FROM o), s AS (SELECT *, matched / detected_rows AS p, matched / expected_rows AS r FROM t) SELECT matched, missed, extra, detected_rows, expected_rows, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s")
def e01_scores(spark, d):
    return ev.scores(_overlap(spark, d))


@query(_OVERLAP + ", t AS (SELECT sum(matched)::BIGINT AS matched, sum(missed)::BIGINT AS missed, sum(extra)::BIGINT AS extra, sum(detected_rows)::BIGINT AS detected_rows, sum(expected_rows)::BIGINT AS expected_rows FROM o), s AS (SELECT *, matched / (matched + extra) AS p, matched / (matched + missed) AS r FROM t) SELECT matched, missed, extra, detected_rows, expected_rows, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM s")
def e02_batch_scores(spark, d):
    return ev.scores(_overlap(spark, d), by_rows=False)


@query(T("WITH c AS (SELECT chapter, count(*) FILTER (flag = 'A') AS f, count(*) FILTER (flag = 'N') AS w FROM articles GROUP BY chapter) SELECT chapter, CASE WHEN f > 0 THEN round(least(f, w) / f, 6) ELSE 0 END AS of_found, CASE WHEN w > 0 THEN round(least(f, w) / w, 6) ELSE 0 END AS of_wanted FROM c", "articles"))
def e03_count_ratio(spark, d):
    c = articles(spark, d).groupBy("chapter").agg(F.count_if(F.col("flag") == "A").alias("f"), F.count_if(F.col("flag") == "N").alias("w"))
    found, wanted = ev.count_ratio(F.col("f"), F.col("w"))
    return c.select("chapter", F.round(found, 6).alias("of_found"), F.round(wanted, 6).alias("of_wanted"))


@query(T("SELECT law_id, CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (status <> 'P') / count(*), 4) ELSE 100 END AS accuracy FROM versions GROUP BY law_id", "versions"))
def e04_mapping_accuracy(spark, d):
    return versions(spark, d).groupBy("law_id").agg(F.round(ev.mapping_accuracy(F.count_if(F.col("status") != "P"), F.count("*")), 4).alias("accuracy"))
