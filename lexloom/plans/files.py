"""Files written from the tables into the shared folder and read back by the library's sources; rule sets by version; small steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators import evaluation as ev
from lexloom.operators.rulesets import compare_versions, rule_table
from lexloom.operators.tables import flat_references, replace_references
from lexloom.plans.catalog import query
from lexloom.plans.made import w
from lexloom.sources.folders import new_path, write_files
from lexloom.sources.statutes import batch_results, law_list, law_list_named, page_of_files
from lexloom.sources.tables import articles, edges, laws, versions, with_tables

T = with_tables


@query(T("WITH n AS (SELECT count(*) AS n FROM laws) SELECT law_id, title, (SELECT n FROM n) > 120 AS has_more, CASE WHEN (SELECT n FROM n) > 120 THEN 120 END AS next_offset FROM laws ORDER BY lpad(law_id::VARCHAR, 12, '0') LIMIT 80 OFFSET 40", "laws"))
def s07_page_of_files(spark, d):
    """One XML file for each law, and the page of eighty files from the forty-first on, by name."""
    path = new_path(spark, "statutes")
    number = F.lpad(F.col("law_id").cast("string"), 12, "0")
    made = laws(spark, d).select(F.concat(number, F.lit(".xml")).alias("name"), w('<Law Num="', F.col("law_id"), '"><LawTitle>', F.col("title"), "</LawTitle></Law>").alias("value"))
    write_files(made, path)
    page = page_of_files(spark, path, 40, 80)
    return page.select(F.regexp_extract("xml", 'Num="([0-9]+)"', 1).cast("long").alias("law_id"), F.regexp_extract("xml", "<LawTitle>(.*?)</LawTitle>", 1).alias("title"), "has_more", "next_offset")


@query(T("SELECT 'A,' || law_id AS law_id, title || ', \"' || law_type || '\"' AS title, law_type, ministry::VARCHAR AS law_number FROM laws WHERE law_id % 10 <> 0", "laws"))
def s10_law_list(spark, d):
    """A law list of quoted fields with commas and quotes, by position; rows without an id are left out."""
    empty = F.lit("")
    cols = [F.col("law_type"), F.col("ministry").cast("string"), w(F.col("title"), ', "', F.col("law_type"), '"'), empty, empty, empty, empty, empty, empty, empty, empty, F.when(F.col("law_id") % 10 != 0, w("A,", F.col("law_id"))).otherwise(""), empty, empty]
    path = new_path(spark, "law-list")
    laws(spark, d).select(*[c.alias(f"h{i}") for i, c in enumerate(cols)]).write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return law_list(spark, path).select("law_id", "title", "law_type", "law_number")


@query(T("SELECT law_id::VARCHAR AS law_id, CASE WHEN law_id % 3 = 0 THEN title ELSE title || '（' || law_type || '）' END AS title, CASE WHEN law_id % 3 <> 0 THEN title END AS short FROM laws WHERE law_id % 7 <> 0", "laws"))
def s11_named_law_list(spark, d):
    """Law lists by header names, half of the rows under the Japanese names and half under their fallbacks."""
    title = F.when(F.col("law_id") % 3 == 0, F.col("title")).otherwise(w(F.col("title"), "（", F.col("law_type"), "）"))
    law = F.when(F.col("law_id") % 7 == 0, "").otherwise(F.col("law_id").cast("string"))
    out, rows = [], laws(spark, d).select("law_id", law.alias("id"), title.alias("t"))
    for even, names in ((0, ("法令ID", "法令名")), (1, ("law_id", "law_title"))):
        path = new_path(spark, "named-law-list")
        rows.where(F.col("law_id") % 2 == even).select(F.col("id").alias(names[0]), F.col("t").alias(names[1])).write.option("header", True).csv(path)
        out.append(law_list_named(spark, path))
    return out[0].unionByName(out[1])


@query(T("SELECT (version_id // 500)::INT AS batch, count(*) AS n, min(version_id) AS first FROM versions GROUP BY ALL ORDER BY batch LIMIT 10", "versions"))
def s22_batches_in_order(spark, d):
    """The first ten result files in numeric order (so that batch 10 doesn't come before batch 2), their rows counted.

    Each file is one JSON array of at most 500 rows, so a batch fits a row however many there are.
    """
    path = new_path(spark, "batches")
    held = versions(spark, d).groupBy(F.floor(F.col("version_id") / 500).cast("int").alias("b")).agg(F.to_json(F.collect_list(F.struct("version_id"))).alias("value"))
    held.select(F.concat(F.lit("batch_"), "b", F.lit("_results")).alias("file"), "value").write.partitionBy("file").text(path)
    return batch_results(spark, f"{path}/*", "version_id long").groupBy("batch").agg(F.count("*").alias("n"), F.min("version_id").alias("first")).orderBy("batch").limit(10)


@query(
    T(
        "SELECT 'external' AS type, 'both' AS status, count(*) AS n FROM versions UNION ALL SELECT 'internal', 'both', count(*) FROM versions UNION ALL SELECT 'relative', 'first', count(*) FROM versions "
        "UNION ALL SELECT 'structural', 'first', count(*) FROM versions UNION ALL SELECT 'internal', 'second', count(*) FROM versions WHERE version_id % 2 = 0",
        "versions",
    )
)
def d10_rule_sets_compared(spark, d):
    """The spans of two rule sets over one text of each version: found by both, or by one alone."""
    v = F.col("version_id")
    text = F.concat(w("民法第", v % 60 + 1, "条と第", v % 50 + 1, "条による。前条を除く。第三章を見る。"), F.when(v % 2 == 0, "第2十条。").otherwise(""))
    docs = versions(spark, d).select(v.alias("doc_id"), text.alias("text"))
    return compare_versions(docs, rule_table(spark), "statute", "baseline").groupBy("type", "status").agg(F.count("*").alias("n"))


@query(T("WITH n AS (SELECT DISTINCT law_id AS src, version_id % 40 AS dst FROM versions WHERE law_id % 5 = 0) SELECT src, dst FROM n UNION ALL SELECT DISTINCT src, dst FROM edges WHERE src NOT IN (SELECT src FROM n)", "versions", "edges"))
def k03_replace_references(spark, d):
    """All references of the laws that were read anew are replaced by what was found, repeats once."""
    found = versions(spark, d).where("law_id % 5 = 0").select(F.col("law_id").alias("src"), (F.col("version_id") % 40).alias("dst"))
    return replace_references(edges(spark, d).select("src", "dst").distinct(), found, "src")


@query("SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM conversations")
def f23_escaped(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", tx.html_escaped("text").alias("html"))


@query(T("SELECT src AS source_law, dst AS target_law, rel_type AS type, confidence, position::BIGINT AS start, position::BIGINT + mentions AS stop FROM edges", "edges"))
def f32_flat_references(spark, d):
    """Nested references to the flat columns of the reference table."""
    nested = edges(spark, d).select(
        F.struct(F.struct(F.col("src").alias("law_id")).alias("structural"), F.struct(F.col("position").cast("long").alias("start"), (F.col("position").cast("long") + F.col("mentions")).alias("end")).alias("position")).alias("source"),
        F.struct(F.struct(F.col("dst").alias("law_id")).alias("structural")).alias("target"),
        F.struct(F.col("rel_type").alias("type"), "confidence").alias("metadata"),
    )
    flat = flat_references(nested)
    return flat.select("source_law", "target_law", "type", "confidence", "start", F.col("end").alias("stop"))


@query(
    T(
        "WITH d AS (SELECT DISTINCT chapter, node_id FROM articles WHERE flag = 'A'), e AS (SELECT DISTINCT chapter, node_id FROM articles WHERE flag = 'N'), c AS (SELECT chapter FROM d UNION SELECT chapter FROM e), "
        "x AS (SELECT chapter, (SELECT count(*) FROM d WHERE d.chapter = c.chapter) AS nd, (SELECT count(*) FROM e WHERE e.chapter = c.chapter) AS ne, (SELECT count(*) FROM d JOIN e USING (chapter, node_id) WHERE d.chapter = c.chapter) AS m FROM c), "
        "p AS (SELECT *, CASE WHEN nd > 0 THEN m / nd ELSE 0 END AS p, CASE WHEN ne > 0 THEN m / ne ELSE 0 END AS r FROM x) SELECT chapter AS doc_id, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, p = 1 AND r = 1 AS passed FROM p",
        "articles",
    )
)
def e06_case_scores(spark, d):
    """Precision, recall and F1 of each case by which of its expected texts are among the detected ones."""
    a = articles(spark, d)
    side = lambda f: a.where(F.col("flag") == f).select(F.col("chapter").alias("doc_id"), F.col("node_id").alias("text"))
    return ev.case_scores(side("A"), side("N"))
