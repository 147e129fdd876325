"""Lookups, joins, aggregates, ordering and windows over the logical tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexloom.functions.japanese import confidence_band, japanese_date
from lexloom.plans.catalog import query
from lexloom.sources.tables import articles, edges, laws, nodes, versions, with_tables

T = with_tables


# --- projections, filters and predicates ---


@query(T("SELECT v.version_id, string_agg(a.article_number::VARCHAR, ',' ORDER BY a.article_number, a.node_id) AS numbers, count(*) AS n FROM versions v JOIN articles a USING (version_id) WHERE v.law_id = 7 GROUP BY v.version_id", "versions", "articles"))
def p01_law_with_articles(spark, d):
    """Point lookup with nested children in order."""
    v = versions(spark, d).where("law_id = 7").select("version_id")
    a = articles(spark, d).join(v, "version_id")
    return a.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("article_number", "node_id"))).alias("_a"), F.count("*").alias("n")).select("version_id", F.array_join(F.col("_a.article_number").cast("array<string>"), ",").alias("numbers"), "n")


@query(T("SELECT law_id, title FROM laws", "laws"))
def p02_columns(spark, d):
    return laws(spark, d).select("law_id", "title")


@query(T("SELECT law_id, title FROM laws WHERE contains(title, '77') OR contains(law_type, 'BUILD')", "laws"))
def p03_contains(spark, d):
    return laws(spark, d).where(F.col("title").contains("77") | F.col("law_type").contains("BUILD")).select("law_id", "title")


@query(T("SELECT law_id, coalesce(law_type, '未分類') AS category FROM laws WHERE contains(lower(title), 'customer#00000001')", "laws"))
def p04_folded_search(spark, d):
    return laws(spark, d).where(F.lower("title").contains("customer#00000001")).select("law_id", F.coalesce("law_type", F.lit("未分類")).alias("category"))


@query(T("SELECT version_id, law_id FROM versions WHERE law_id IN (1, 5, 9, 20, 77) AND status = 'F'", "versions"))
def p05_in_list(spark, d):
    return versions(spark, d).where(F.col("law_id").isin(1, 5, 9, 20, 77) & (F.col("status") == "F")).select("version_id", "law_id")


@query(T("SELECT src, dst, rel_type FROM edges WHERE src = 3 OR dst = 3", "edges"))
def p06_either_end(spark, d):
    """Optional-filter dispatch: the branch for a given article on either end."""
    return edges(spark, d).where("src = 3 or dst = 3").select("src", "dst", "rel_type")


@query(T("SELECT src, dst, rel_type, confidence FROM edges WHERE confidence < 0.8", "edges"))
def p07_low_confidence(spark, d):
    return edges(spark, d).where("confidence < 0.8").select("src", "dst", "rel_type", "confidence")


@query(T("SELECT src, dst, position FROM edges WHERE position >= 10 AND position <= 12", "edges"))
def p08_position_interval(spark, d):
    return edges(spark, d).where(F.col("position").between(10, 12)).select("src", "dst", "position")


@query(T("SELECT count(*) AS n, count(law_type) AS with_type FROM laws", "laws"))
def p09_null_predicate(spark, d):
    return laws(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("law_type").isNotNull()).alias("with_type"))


@query(T("SELECT rel_type, count(*) AS n FROM edges WHERE src <> dst GROUP BY rel_type", "edges"))
def p10_not_equal(spark, d):
    return edges(spark, d).where("src != dst").groupBy("rel_type").agg(F.count("*").alias("n"))


@query(T("SELECT law_id FROM laws l WHERE EXISTS (SELECT 1 FROM versions v WHERE v.law_id = l.law_id AND v.status = 'P')", "laws", "versions"))
def p11_exists(spark, d):
    return laws(spark, d).join(versions(spark, d).where("status = 'P'"), "law_id", "left_semi").select("law_id")


@query(T("SELECT src, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS types FROM edges GROUP BY src HAVING min(confidence) >= 0.55", "edges"))
def p12_all_edges(spark, d):
    """Universal predicate over a node's edges."""
    return edges(spark, d).groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("rel_type")), ",").alias("types"), F.min("confidence").alias("c")).where("c >= 0.55").select("src", "types")


@query(
    r"""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
    SELECT doc_id FROM w WHERE list_contains(w, 'the') AND list_contains(w, 'tion')"""
)
def p13_full_text(spark, d):
    """Every query word among the text's words."""
    has = lambda word: F.lower("text").rlike(f"(?<![a-z]){word}(?![a-z])")
    return spark.read.parquet(f"{d}/documents.parquet").where(has("tion") & has("the")).select("doc_id")


@query(T("SELECT law_id FROM laws WHERE contains(law_id::VARCHAR, '12') OR contains(title, '099')", "laws"))
def p14_decree_selection(spark, d):
    return laws(spark, d).where(F.col("law_id").cast("string").contains("12") | F.col("title").contains("099")).select("law_id")


@query(T("SELECT count(*) AS n FROM articles WHERE flag IS NULL OR flag <> 'R'", "articles"))
def p15_unverified_or_right(spark, d):
    return articles(spark, d).where("flag is null or flag != 'R'").agg(F.count("*").alias("n"))


@query(T("SELECT a.* FROM articles a WHERE NOT EXISTS (SELECT 1 FROM versions v WHERE v.version_id = a.version_id AND v.status = 'F') AND a.chapter = 5", "articles", "versions"))
def p16_visible(spark, d):
    return articles(spark, d).where("chapter = 5").join(versions(spark, d).where("status = 'F'"), "version_id", "left_anti")


@query(T("WITH r AS (SELECT law_id, coalesce(max(version_id) FILTER (status = 'P'), arg_max(version_id, (version_date, version_id))) AS version_id FROM versions GROUP BY law_id) SELECT * FROM r", "versions"))
def p17_version_choice(spark, d):
    """The current pointer if there is one, else the newest."""
    newest = F.max_by("version_id", F.struct("version_date", "version_id"))
    return versions(spark, d).groupBy("law_id").agg(F.coalesce(F.max(F.when(F.col("status") == "P", F.col("version_id"))), newest).alias("version_id"))


@query(T("SELECT src, dst, rel_type, confidence FROM edges WHERE confidence >= 0.7 AND rel_type IN ('APPLIES', 'REPLACES') ORDER BY confidence DESC, src, dst, rel_type LIMIT 200", "edges"))
def p18_reference_repository(spark, d):
    return edges(spark, d).where((F.col("confidence") >= 0.7) & F.col("rel_type").isin("APPLIES", "REPLACES")).orderBy(F.desc("confidence"), "src", "dst", "rel_type").limit(200).select("src", "dst", "rel_type", "confidence")


@query(T("SELECT law_id, max(version_date) AS updated FROM versions GROUP BY law_id HAVING max(version_date) >= TIMESTAMP '1998-06-01'", "versions"))
def p19_updated_since(spark, d):
    return versions(spark, d).groupBy("law_id").agg(F.max("version_date").alias("updated")).where("updated >= timestamp '1998-06-01'")


@query(T("SELECT node_id, law || ' 第' || number || '条' AS label, number > 25 AS is_late FROM nodes", "nodes"))
def p20_labels(spark, d):
    return nodes(spark, d).select("node_id", F.concat("law", F.lit(" 第"), "number", F.lit("条")).alias("label"), (F.col("number") > 25).alias("is_late"))


# --- joins ---


@query(T("SELECT l.law_id, count(v.version_id) AS n FROM laws l LEFT JOIN versions v USING (law_id) GROUP BY l.law_id", "laws", "versions"))
def j01_parent_child(spark, d):
    per = versions(spark, d).groupBy("law_id").agg(F.count("*").alias("n"))
    return laws(spark, d).select("law_id").join(per, "law_id", "left").select("law_id", F.coalesce("n", F.lit(0)).alias("n"))


@query(T("SELECT a.law AS from_law, b.law AS to_law, rel_type, count(*) AS n FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst GROUP BY ALL", "edges", "nodes"))
def j02_edge_pattern(spark, d):
    a = nodes(spark, d).select(F.col("node_id").alias("src"), F.col("law").alias("from_law"))
    b = nodes(spark, d).select(F.col("node_id").alias("dst"), F.col("law").alias("to_law"))
    return edges(spark, d).join(a, "src").join(b, "dst").groupBy("from_law", "to_law", "rel_type").agg(F.count("*").alias("n"))


@query(T("SELECT n.node_id, count(e.src) AS n FROM nodes n LEFT JOIN edges e ON e.dst = n.node_id AND e.confidence >= 0.95 GROUP BY n.node_id", "nodes", "edges"))
def j03_optional_match(spark, d):
    into = edges(spark, d).where("confidence >= 0.95").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("n"))
    return nodes(spark, d).select("node_id").join(into, "node_id", "left").fillna(0, ["n"])


@query(T("WITH b AS (SELECT src AS node, dst AS other FROM edges UNION SELECT dst, src FROM edges) SELECT node, count(*) AS neighbours FROM b GROUP BY node", "edges"))
def j04_undirected(spark, d):
    e = edges(spark, d)
    both = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select(F.col("dst").alias("node"), F.col("src").alias("other"))).distinct()
    return both.groupBy("node").agg(F.count("*").alias("neighbours"))


@query(T("SELECT count(*) AS n, count(DISTINCT b.law) AS laws FROM nodes a JOIN edges e ON e.src = a.node_id JOIN nodes b ON b.node_id = e.dst WHERE a.law <> b.law AND a.number = 1", "nodes", "edges"))
def j05_law_article_article_law(spark, d):
    a = nodes(spark, d).where("number = 1").select(F.col("node_id").alias("src"), F.col("law").alias("x"))
    b = nodes(spark, d).select(F.col("node_id").alias("dst"), F.col("law").alias("y"))
    return edges(spark, d).join(a, "src").join(b, "dst").where("x != y").agg(F.count("*").alias("n"), F.countDistinct("y").alias("laws"))


@query(T("SELECT s.node_id AS article, count(*) AS members FROM nodes s JOIN nodes m ON m.law = s.law AND m.number BETWEEN s.number AND s.number + 2 WHERE s.kind = 'ECONOMY' GROUP BY s.node_id", "nodes"))
def j09_range_members(spark, d):
    """Range join: the range is exploded to its numbers, so the join is an equi-join on law and number."""
    n = nodes(spark, d)
    ranges = n.where("kind = 'ECONOMY'").select(F.col("node_id").alias("article"), "law", F.explode(F.sequence("number", F.col("number") + 2)).alias("number"))
    members = n.groupBy("law", "number").agg(F.count("*").alias("m"))
    return ranges.join(members, ["law", "number"]).groupBy("article").agg(F.sum("m").alias("members"))


@query(T("SELECT v.version_id, coalesce(l.title, '不明') AS title FROM versions v LEFT JOIN laws l ON l.law_id = v.law_id AND l.law_type = 'BUILDING'", "versions", "laws"))
def j10_titles(spark, d):
    return versions(spark, d).join(laws(spark, d).where("law_type = 'BUILDING'").select("law_id", "title"), "law_id", "left").select("version_id", F.coalesce("title", F.lit("不明")).alias("title"))


@query(T("SELECT l.law_id, coalesce(c.n, 0) AS references_made FROM laws l LEFT JOIN (SELECT law_id, count(*) AS n FROM versions JOIN articles USING (version_id) WHERE flag = 'R' GROUP BY law_id) c USING (law_id)", "laws", "versions", "articles"))
def j11_reference_counts(spark, d):
    c = articles(spark, d).where("flag = 'R'").select("version_id").join(versions(spark, d).select("version_id", "law_id"), "version_id").groupBy("law_id").agg(F.count("*").alias("n"))
    return laws(spark, d).select("law_id").join(c, "law_id", "left").select("law_id", F.coalesce("n", F.lit(0)).alias("references_made"))


@query(T("WITH f AS (SELECT title, min(law_id) AS id FROM laws GROUP BY title), s AS (SELECT replace(title, 'Customer#', 'C') AS short, min(law_id) AS id FROM laws GROUP BY 1), m AS (SELECT law_id, CASE WHEN law_id % 3 = 0 THEN title ELSE replace(title, 'Customer#', 'C') END AS mention FROM laws) SELECT m.law_id, coalesce(f.id, s.id) AS resolved FROM m LEFT JOIN f ON f.title = m.mention LEFT JOIN s ON s.short = m.mention", "laws"))
def j13_dictionary(spark, d):
    """Exact name first, then abbreviation."""
    n = laws(spark, d)
    full = n.groupBy(F.col("title").alias("mention")).agg(F.min("law_id").alias("a"))
    short = n.groupBy(F.replace("title", F.lit("Customer#"), F.lit("C")).alias("mention")).agg(F.min("law_id").alias("b"))
    m = n.select("law_id", F.when(F.col("law_id") % 3 == 0, F.col("title")).otherwise(F.replace("title", F.lit("Customer#"), F.lit("C"))).alias("mention"))
    return m.join(full, "mention", "left").join(short, "mention", "left").select("law_id", F.coalesce("a", "b").alias("resolved"))


@query(T("SELECT law_id, version_id, last_value(CASE WHEN status = 'F' THEN version_id END IGNORE NULLS) OVER (PARTITION BY law_id ORDER BY version_date, version_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_final FROM versions", "versions"))
def j17_as_of(spark, d):
    """The nearest preceding row of a kind: last non-null over the rows before."""
    w = Window.partitionBy("law_id").orderBy("version_date", "version_id").rowsBetween(Window.unboundedPreceding, -1)
    return versions(spark, d).select("law_id", "version_id", F.last(F.when(F.col("status") == "F", F.col("version_id")), ignorenulls=True).over(w).alias("previous_final"))


@query(T("WITH a AS (SELECT DISTINCT node_id FROM articles WHERE flag = 'A'), b AS (SELECT DISTINCT node_id FROM articles WHERE flag = 'R') SELECT coalesce(a.node_id, b.node_id) AS node_id, a.node_id IS NOT NULL AND b.node_id IS NOT NULL AS matched FROM a FULL OUTER JOIN b ON a.node_id = b.node_id", "articles"))
def j18_set_comparison(spark, d):
    a = articles(spark, d).where("flag in ('A', 'R')").groupBy("node_id").agg(F.max((F.col("flag") == "A").cast("int")).alias("x"), F.max((F.col("flag") == "R").cast("int")).alias("y"))
    return a.select("node_id", ((F.col("x") == 1) & (F.col("y") == 1)).alias("matched"))


@query(T("SELECT e.src, e.dst, n.title, a.n AS mentions_in_articles FROM edges e JOIN nodes n ON n.node_id = e.dst JOIN (SELECT node_id, count(*) AS n FROM articles GROUP BY node_id) a ON a.node_id = e.src WHERE e.rel_type = 'REPLACES' AND e.confidence = 1", "edges", "nodes", "articles"))
def j16_rows_and_edges(spark, d):
    a = articles(spark, d).groupBy(F.col("node_id").alias("src")).agg(F.count("*").alias("mentions_in_articles"))
    n = nodes(spark, d).select(F.col("node_id").alias("dst"), "title")
    return edges(spark, d).where("rel_type = 'REPLACES' and confidence = 1").join(n, "dst").join(a, "src").select("src", "dst", "title", "mentions_in_articles")


# --- aggregates ---


@query(T("SELECT count(*) AS n, count(*) FILTER (status = 'F') AS final FROM versions", "versions"))
def a01_counts(spark, d):
    return versions(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "F").alias("final"))


@query(T("SELECT count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets, count(DISTINCT rel_type) AS types FROM edges", "edges"))
def a02_distinct_counts(spark, d):
    return edges(spark, d).agg(F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"), F.countDistinct("rel_type").alias("types"))


@query(T("SELECT rel_type, src, count(*) AS n FROM edges GROUP BY rel_type, src", "edges"))
def a03_group_count(spark, d):
    return edges(spark, d).groupBy("rel_type", "src").agg(F.count("*").alias("n"))


@query(T("SELECT rel_type, count(*) AS n, round(avg(confidence), 4) AS mean FROM edges GROUP BY rel_type", "edges"))
def a04_count_and_mean(spark, d):
    return edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean"))


@query(T("SELECT dst, string_agg(DISTINCT rel_type, ',' ORDER BY rel_type) AS types FROM edges GROUP BY dst", "edges"))
def a05_distinct_types(spark, d):
    return edges(spark, d).groupBy("dst").agg(F.array_join(F.sort_array(F.collect_set("rel_type")), ",").alias("types"))


@query(T("SELECT law, string_agg(number::VARCHAR, ',' ORDER BY number) AS numbers FROM nodes WHERE number BETWEEN 10 AND 12 GROUP BY law", "nodes"))
def a06_numbers_in_range(spark, d):
    return nodes(spark, d).where(F.col("number").between(10, 12)).groupBy("law").agg(F.array_join(F.sort_array(F.collect_list("number")).cast("array<string>"), ",").alias("numbers"))


@query(T("SELECT rel_type, min(position) AS least, max(position) AS most, round(avg(position), 4) AS mean, round(stddev_samp(position), 4) AS deviation FROM edges GROUP BY rel_type", "edges"))
def a08_position_statistics(spark, d):
    return edges(spark, d).groupBy("rel_type").agg(F.min("position").alias("least"), F.max("position").alias("most"), F.round(F.avg("position"), 4).alias("mean"), F.round(F.stddev_samp("position"), 4).alias("deviation"))


@query(T("SELECT law_id, sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END)::BIGINT AS confirmed, sum(CASE WHEN status = 'O' THEN 1 ELSE 0 END)::BIGINT AS open_rows, count(*) AS n FROM versions GROUP BY law_id", "versions"))
def a09_conditional_counts(spark, d):
    return versions(spark, d).groupBy("law_id").agg(F.count_if(F.col("status") == "F").alias("confirmed"), F.count_if(F.col("status") == "O").alias("open_rows"), F.count("*").alias("n"))


@query(T("SELECT round((SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes), 6) AS per_node", "edges", "nodes"))
def a11_ratio(spark, d):
    e = edges(spark, d).agg(F.count("*").alias("e"))
    n = nodes(spark, d).agg(F.count("*").alias("n"))
    return e.join(F.broadcast(n)).select(F.round(F.col("e") / F.col("n"), 6).alias("per_node"))


@query(T("SELECT rel_type, round(avg(n), 6) AS mean, sum(n)::BIGINT AS total FROM (SELECT rel_type, src, count(*) AS n FROM edges GROUP BY ALL) GROUP BY rel_type", "edges"))
def a12_two_levels(spark, d):
    return edges(spark, d).groupBy("rel_type", "src").agg(F.count("*").alias("n")).groupBy("rel_type").agg(F.round(F.avg("n"), 6).alias("mean"), F.sum("n").alias("total"))


@query(T("SELECT src, count(*) AS n FROM edges GROUP BY src HAVING count(*) > 35", "edges"))
def a13_having(spark, d):
    return edges(spark, d).groupBy("src").agg(F.count("*").alias("n")).where("n > 35")


@query(T("SELECT rel_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM edges GROUP BY rel_type", "edges"))
def a14_percent(spark, d):
    per = edges(spark, d).groupBy("rel_type").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("t"))
    return per.join(F.broadcast(total)).select("rel_type", "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("percent"))


@query(T("SELECT rel_type, count(*) FILTER (confidence >= 0.9) AS high, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.7) AS low FROM edges GROUP BY rel_type", "edges"))
def a15_bands(spark, d):
    e = edges(spark, d).withColumn("band", confidence_band("confidence"))
    return e.groupBy("rel_type").agg(*[F.count_if(F.col("band") == b).alias(b) for b in ("high", "medium", "low")])


@query(T("WITH r AS (SELECT law_id, round(100.0 * count(*) FILTER (status = 'F') / count(*), 4) AS accuracy FROM versions GROUP BY law_id) SELECT law_id, accuracy FROM r ORDER BY accuracy, law_id LIMIT 10", "versions"))
def a16_bottom_ten(spark, d):
    r = versions(spark, d).groupBy("law_id").agg(F.round(100.0 * F.count_if(F.col("status") == "F") / F.count("*"), 4).alias("accuracy"))
    return r.orderBy("accuracy", "law_id").limit(10)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def a17_percentiles(spark, d):
    """Nearest-rank percentiles."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(*[F.expr(f"percentile_disc({p}) within group (order by value)").alias(n) for n, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


@query("SELECT event_type, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def a18_operation_statistics(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 4).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"))


@query(T("SELECT law_type, count(*) AS n, round(sum(score), 2) AS total FROM laws GROUP BY law_type", "laws"))
def a20_categories(spark, d):
    return laws(spark, d).groupBy("law_type").agg(F.count("*").alias("n"), F.round(F.sum("score"), 2).alias("total"))


@query(T("SELECT src, dst, arg_max(rel_type, (confidence, rel_type)) AS rel_type, max(confidence) AS confidence FROM edges GROUP BY src, dst", "edges"))
def a21_best_of_group(spark, d):
    return edges(spark, d).groupBy("src", "dst").agg(F.max_by("rel_type", F.struct("confidence", "rel_type")).alias("rel_type"), F.max("confidence").alias("confidence"))


@query(T("WITH p AS (SELECT DISTINCT ministry, law_type, law_id FROM laws) SELECT ministry, count(DISTINCT law_type) AS types, string_agg(DISTINCT law_type, ',' ORDER BY law_type) AS type_list, count(*) AS n FROM p GROUP BY ministry", "laws"))
def a24_rollup_with_children(spark, d):
    """Structure rollup: distinct children in order, with counts."""
    per = laws(spark, d).groupBy("ministry", "law_type").agg(F.count("*").alias("n"))
    return per.groupBy("ministry").agg(F.count("law_type").alias("types"), F.array_join(F.sort_array(F.collect_list("law_type")), ",").alias("type_list"), F.sum("n").alias("n"))


@query(T("SELECT 'rate' AS what, '' AS label, round(count(*) FILTER (confidence < 0.7) / count(*), 6) AS value FROM edges UNION ALL SELECT 'type', rel_type, count(*)::DOUBLE FROM edges WHERE confidence < 0.7 GROUP BY rel_type", "edges"))
def a25_ambiguity(spark, d):
    e = edges(spark, d)
    weak = F.col("confidence") < 0.7
    rate = e.agg(F.round(F.count_if(weak) / F.count("*"), 6).alias("value")).select(F.lit("rate").alias("what"), F.lit("").alias("label"), "value")
    return rate.union(e.where(weak).groupBy("rel_type").agg(F.count("*").cast("double").alias("value")).select(F.lit("type").alias("what"), F.col("rel_type").alias("label"), "value"))


@query(T("SELECT round(avg(confidence), 2) AS mean FROM edges", "edges"))
def a26_rounded_mean(spark, d):
    return edges(spark, d).agg(F.round(F.avg("confidence"), 2).alias("mean"))


@query(T("SELECT n.law, e.src AS article, e.position AS line, count(*) AS heat FROM edges e JOIN nodes n ON n.node_id = e.src GROUP BY ALL", "edges", "nodes"))
def a27_heat_map(spark, d):
    n = nodes(spark, d).select(F.col("node_id").alias("src"), "law")
    return edges(spark, d).join(n, "src").groupBy("law", F.col("src").alias("article"), F.col("position").alias("line")).agg(F.count("*").alias("heat"))


@query(T("SELECT flag AS version, count(*) AS n, count(*) FILTER (line_status = 'F') AS correct, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (line_status = 'F') / count(*), 6) ELSE 0 END AS precision, NULL::DOUBLE AS recall FROM articles GROUP BY flag", "articles"))
def a30_version_metrics(spark, d):
    """Precision of each version; recall can't be known from detections alone, so it is null."""
    right = F.count_if(F.col("line_status") == "F")
    return articles(spark, d).groupBy(F.col("flag").alias("version")).agg(F.count("*").alias("n"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("precision"), F.lit(None).cast("double").alias("recall"))


@query(T("WITH m AS (SELECT flag, count(*) FILTER (line_status = 'F') AS right_rows, count(*) AS n FROM articles GROUP BY flag) SELECT a.n - b.n AS more_rows, round(a.right_rows / a.n - b.right_rows / b.n, 6) AS more_precision FROM m a JOIN m b ON a.flag = 'R' AND b.flag = 'A'", "articles"))
def a31_version_delta(spark, d):
    a = articles(spark, d).agg(*[F.count_if(F.col("flag") == f).alias(f"n_{f}") for f in "RA"], *[F.count_if((F.col("flag") == f) & (F.col("line_status") == "F")).alias(f"r_{f}") for f in "RA"])
    return a.select((F.col("n_R") - F.col("n_A")).alias("more_rows"), F.round(F.col("r_R") / F.col("n_R") - F.col("r_A") / F.col("n_A"), 6).alias("more_precision"))


# --- order, limits, windows, sets ---


@query(T("SELECT law_id, count(*) AS n FROM versions GROUP BY law_id ORDER BY n DESC, law_id LIMIT 10", "versions"))
def t02_top_ten(spark, d):
    return versions(spark, d).groupBy("law_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "law_id").limit(10)


@query(T("SELECT law_id, title FROM laws ORDER BY title, law_id LIMIT 20 OFFSET 40", "laws"))
def t03_page(spark, d):
    return laws(spark, d).select("law_id", "title").orderBy("title", "law_id").offset(40).limit(20)


@query(T("SELECT version_id, article_number, node_id FROM articles QUALIFY row_number() OVER (PARTITION BY version_id ORDER BY article_number, node_id) <= 3", "articles"))
def t10_first_articles(spark, d):
    w = Window.partitionBy("version_id").orderBy("article_number", "node_id")
    return articles(spark, d).select("version_id", "article_number", "node_id").withColumn("r", F.row_number().over(w)).where("r <= 3").drop("r")


@query(T("SELECT law_id, version_id, coalesce(array_to_string(list(change_type) OVER (PARTITION BY law_id ORDER BY version_date, version_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), ','), '') AS recent FROM versions", "versions"))
def t12_recent_five(spark, d):
    """Bounded recency list: the five rows before."""
    w = Window.partitionBy("law_id").orderBy("version_date", "version_id").rowsBetween(-5, -1)
    recent = F.collect_list("change_type").over(w)
    return versions(spark, d).select("law_id", "version_id", F.array_join(recent, ",").alias("recent"))


@query(T("SELECT law_id, version_id, version_date, row_number() OVER (PARTITION BY law_id ORDER BY version_date DESC, version_id DESC) AS age FROM versions", "versions"))
def w01_version_age(spark, d):
    w = Window.partitionBy("law_id").orderBy(F.desc("version_date"), F.desc("version_id"))
    return versions(spark, d).select("law_id", "version_id", "version_date", F.row_number().over(w).alias("age"))


@query(T("SELECT version_id, article_number, node_id, lag(node_id) OVER w AS previous, lead(node_id) OVER w AS next FROM articles WINDOW w AS (PARTITION BY version_id ORDER BY article_number, node_id, chapter, length, enforced)", "articles"))
def w02_neighbour_articles(spark, d):
    """Relative article lookup over the articles that exist."""
    w = Window.partitionBy("version_id").orderBy("article_number", "node_id", "chapter", "length", "enforced")
    return articles(spark, d).select("version_id", "article_number", "node_id", F.lag("node_id").over(w).alias("previous"), F.lead("node_id").over(w).alias("next"))


@query(T("SELECT src AS node FROM edges WHERE rel_type = 'APPLIES' UNION SELECT dst FROM edges WHERE rel_type = 'APPLIES'", "edges"))
def u01_union(spark, d):
    e = edges(spark, d).where("rel_type = 'APPLIES'")
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query(T("SELECT node_id FROM articles WHERE flag = 'A' INTERSECT SELECT node_id FROM articles WHERE flag = 'R'", "articles"))
def u02_intersect(spark, d):
    a = articles(spark, d)
    return a.where("flag = 'A'").select("node_id").intersect(a.where("flag = 'R'").select("node_id"))


@query(T("SELECT node_id FROM nodes EXCEPT SELECT node_id FROM articles WHERE chapter = 1", "nodes", "articles"))
def u03_except(spark, d):
    return nodes(spark, d).select("node_id").subtract(articles(spark, d).where("chapter = 1").select("node_id"))


@query(T("SELECT version_id, year(version_date) || '年' || month(version_date) || '月' || day(version_date) || '日' AS shown FROM versions", "versions"))
def f24_dates(spark, d):
    return versions(spark, d).select("version_id", japanese_date("version_date").alias("shown"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT >= 50")
def f25_json(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")).where("k >= 50")
