"""Sources, presentation and the remaining scalar functions and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import japanese as jp
from lexloom.operators import spans as sp
from lexloom.operators.conflicts import first_by
from lexloom.operators.text_links import expand_abbreviations, segments
from lexloom.plans.catalog import query
from lexloom.sources import statutes
from lexloom.sources.tables import articles, edges, laws, nodes, versions, with_tables

T = with_tables

#: The same order of a version's articles on both sides.
_PLACE = ("article_number", "node_id", "chapter", "flag", "length")


def _statutes(spark, d):
    """A statute XML of each version: its articles in one chapter, items under those that apply, and reference tags."""
    a = articles(spark, d).withColumn("length", F.col("length").cast("int"))

    def one(r):
        x = lambda c: r[c].cast("string")
        item = F.concat(F.lit("<Item Num='1'><ItemTitle>一</ItemTitle><ItemSentence><Sentence>丙"), x("length"), F.lit("</Sentence></ItemSentence><Subitem1 Num='1'><Subitem1Title>イ</Subitem1Title><Subitem1Sentence><Sentence>丁"), x("chapter"), F.lit("</Sentence></Subitem1Sentence></Subitem1></Item>"))
        first = F.when(x("flag") == "R", F.lit("削除")).otherwise(F.concat(F.lit("甲"), x("node_id"), F.lit("。")))
        return F.concat(
            F.lit("<Article Num='"), x("article_number"), F.lit("'><ArticleTitle>第"), x("article_number"), F.lit("条</ArticleTitle><Paragraph Num='1'><ParagraphSentence><Sentence>"), first,
            F.lit("</Sentence><Sentence>乙"), x("chapter"), F.lit("。</Sentence></ParagraphSentence>"), F.when(x("flag") == "A", item).otherwise(F.lit("")), F.lit("</Paragraph></Article>"),
        )

    held = a.groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct(*_PLACE))).alias("all"))
    body = held.select("version_id", F.array_join(F.transform("all", one), "").alias("body"))
    v = versions(spark, d).join(body, "version_id", "left")
    n = F.col("version_id")
    head = F.format_string("<Law Era='Heisei' Year='%d' Num='1' LawType='Act' PromulgateMonth='%d' PromulgateDay='%d'><LawNum>第%d号</LawNum><Note><b><LawRef>法%d</LawRef></b></Note><ArticleRef>第%d条</ArticleRef>", (n % 30 + 1).cast("int"), (n % 12 + 1).cast("int"), (n % 28 + 1).cast("int"), n, F.col("law_id"), (n % 9).cast("int"))
    main = F.format_string("<LawBody><LawTitle>法%d</LawTitle><MainProvision><Chapter Num='1'><ChapterTitle>第%d章</ChapterTitle>%s</Chapter></MainProvision></LawBody></Law>", n, (n % 9).cast("int"), F.coalesce("body", F.lit("")))
    return v.select(n.cast("string").alias("law_id"), F.concat(head, main).alias("xml"))


_IN_ORDER = f"row_number() OVER (PARTITION BY version_id ORDER BY {', '.join(_PLACE[:4])}, length::INT)::INT"
_CONTENT = "CASE WHEN flag = 'R' THEN '削除' ELSE '甲' || node_id || '。' END || chr(10) || '乙' || chapter || '。'"


@query(T("SELECT version_id::VARCHAR AS law_id, '法' || version_id AS title, '第' || version_id || '号' AS law_number, 'Act' AS law_type, make_date((1988 + version_id % 30 + 1)::BIGINT, (version_id % 12 + 1)::BIGINT, (version_id % 28 + 1)::BIGINT)::VARCHAR AS promulgated FROM versions", "versions"))
def s01_law_heads(spark, d):
    return statutes.law_heads(statutes.parse_laws(_statutes(spark, d), schema=statutes.HEAD_SCHEMA)).drop("enact_statements").withColumn("promulgated", F.col("promulgated").cast("string"))


@query(T(f"SELECT version_id::VARCHAR AS law_id, article_number::VARCHAR AS article_number, '第' || article_number || '条' AS article_title, '第' || (version_id % 9) || '章' AS chapter, {_CONTENT} AS content, flag = 'R' AS is_deleted, {_IN_ORDER} AS sort_order FROM articles", "articles"))
def s03_articles(spark, d):
    return statutes.articles_of(_statutes(spark, d), paragraphs=False).select("law_id", "article_number", "article_title", "chapter", "content", "is_deleted", "sort_order")


@query(T(f"SELECT version_id::VARCHAR AS law_id, article_number::VARCHAR AS article_number, 1 AS paragraph_number, {_CONTENT} AS content FROM articles", "articles"))
def s04_paragraphs(spark, d):
    return statutes.paragraphs(statutes.articles_of(_statutes(spark, d))).select("law_id", "article_number", "paragraph_number", "content")


@query(T("SELECT version_id::VARCHAR AS law_id, article_number::VARCHAR AS article_number, 1 AS level, '一' AS titles, '丙' || length::INT AS content FROM articles WHERE flag = 'A' UNION ALL SELECT version_id::VARCHAR, article_number::VARCHAR, 2, '一/イ', '丁' || chapter FROM articles WHERE flag = 'A'", "articles"))
def s05_items(spark, d):
    found = statutes.items(statutes.paragraphs(statutes.articles_of(_statutes(spark, d))))
    return found.select("law_id", "article_number", "level", F.array_join("titles", "/").alias("titles"), "content")


@query(T("SELECT law_id, title FROM laws ORDER BY law_id LIMIT 100 OFFSET 200", "laws"))
def s07_source_page(spark, d):
    return laws(spark, d).select("law_id", "title").orderBy("law_id").offset(200).limit(100)


@query(T("SELECT law_id, max(version_date::VARCHAR || '-' || version_id) AS name FROM versions GROUP BY law_id", "versions"))
def s13_latest_file(spark, d):
    """The newest version by the greatest name."""
    v = versions(spark, d).select("law_id", F.concat(F.date_format("version_date", "yyyy-MM-dd HH:mm:ss"), F.lit("-"), "version_id").alias("name"))
    return statutes.latest_file(v)


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[\s　]+', ' ', 'g')) AS text FROM pages")
def s15_stripped_pages(spark, d):
    """Text of raw pages without tags."""
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", statutes.stripped("html").alias("text"))


@query(T("SELECT version_id::VARCHAR AS law_id, 'LawRef' AS tag, '法' || law_id AS text FROM versions UNION ALL SELECT version_id::VARCHAR, 'ArticleRef', '第' || (version_id % 9) || '条' FROM versions", "versions"))
def s17_embedded_references(spark, d):
    return statutes.embedded_references(_statutes(spark, d)).select("law_id", "tag", "text")


@query(T("SELECT n.node_id, (SELECT count(*) FROM edges WHERE src = n.node_id) AS made, (SELECT count(*) FROM edges WHERE dst = n.node_id) AS received FROM nodes n", "nodes", "edges"))
def s21_rows_with_edges(spark, d):
    return statutes.hybrid_source(nodes(spark, d).select("node_id"), edges(spark, d))


@query(T("WITH d AS (SELECT law_id, replace(title, 'Customer', '') AS short FROM laws) SELECT l.law_id, min(d.law_id) AS matched FROM laws l JOIN d ON contains(l.title, d.short) GROUP BY l.law_id", "laws"))
def j14_substring(spark, d):
    """Names found within titles. The names are keyed by their text, and each title offers its possible substrings of the same length, so the join is an equi-join; the least match counts."""
    n = laws(spark, d)
    short = n.select(F.replace("title", F.lit("Customer"), F.lit("")).alias("part"), F.col("law_id").alias("m"))
    lengths = short.select(F.length("part").alias("n")).distinct()
    # the different lengths are one row: an array no longer than the longest name
    parts = n.join(F.broadcast(lengths.agg(F.collect_set("n").alias("all")))).select("law_id", "title", F.explode(F.filter("all", lambda x: x <= F.length("title"))).alias("n"))
    parts = parts.select("law_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("title") - F.col("n") + 1), lambda i: F.substring(F.col("title"), i, F.col("n")))).alias("part"))
    return parts.join(short, "part").groupBy("law_id").agg(F.min("m").alias("matched"))


@query(T("SELECT a.law_id AS decree, min(b.law_id) AS parent FROM laws a JOIN laws b ON b.title = 'Customer#0000' || substr(a.title, 14) GROUP BY a.law_id", "laws"))
def j15_title_inference(spark, d):
    """A decree's parent by a title made from its own."""
    n = laws(spark, d)
    parent = n.select(F.col("title").alias("t"), F.col("law_id").alias("p"))
    child = n.select(F.col("law_id").alias("decree"), F.concat(F.lit("Customer#0000"), F.substring("title", 14, 100)).alias("t"))
    return child.join(parent, "t").groupBy("decree").agg(F.min("p").alias("parent"))


@query(T("SELECT a.node_id, a.article_number, count(e.dst) AS shown FROM articles a LEFT JOIN (SELECT src, dst, rel_type FROM edges WHERE rel_type = 'APPLIES') e ON e.src = a.node_id AND e.dst = a.version_id GROUP BY ALL", "articles", "edges"))
def j20_nested_matching(spark, d):
    """References matched to where they are shown, on several keys."""
    e = edges(spark, d).where("rel_type = 'APPLIES'").select(F.col("src").alias("node_id"), F.col("dst").alias("version_id"), F.lit(1).alias("hit"))
    a = articles(spark, d).select("node_id", "version_id", "article_number")
    return a.join(e, ["node_id", "version_id"], "left").groupBy("node_id", "article_number").agg(F.count("hit").alias("shown"))


@query(T("SELECT src, string_agg(dst || ':' || rel_type, ',' ORDER BY dst, rel_type) AS targets FROM edges GROUP BY src", "edges"))
def a07_collect_structs(spark, d):
    found = edges(spark, d).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "rel_type"))).alias("t"))
    return found.select("src", F.array_join(F.transform("t", lambda x: F.concat(x["dst"], F.lit(":"), x["rel_type"])), ",").alias("targets"))


@query(T("SELECT (SELECT count(*) FROM articles) AS articles, (SELECT sum(mentions)::BIGINT FROM edges) AS mentions", "articles", "edges"))
def a19_grand_totals(spark, d):
    a = articles(spark, d).agg(F.count("*").alias("articles"))
    return a.join(F.broadcast(edges(spark, d).agg(F.sum("mentions").alias("mentions"))))


@query(T("SELECT version_id, chapter, string_agg(DISTINCT node_id::VARCHAR, ',' ORDER BY node_id::VARCHAR) AS members FROM articles GROUP BY version_id, chapter", "articles"))
def a22_by_article_key(spark, d):
    found = articles(spark, d).groupBy("version_id", "chapter").agg(F.sort_array(F.collect_set(F.col("node_id").cast("string"))).alias("m"))
    return found.select("version_id", "chapter", F.array_join("m", ",").alias("members"))


@query(T("SELECT kind, count(DISTINCT title) AS names, count(DISTINCT law) AS laws, count(*) FILTER (number > 40) AS with_numbers FROM nodes GROUP BY kind", "nodes"))
def a29_dictionary_statistics(spark, d):
    return nodes(spark, d).groupBy("kind").agg(F.countDistinct("title").alias("names"), F.countDistinct("law").alias("laws"), F.count_if(F.col("number") > 40).alias("with_numbers"))


@query(T("SELECT version_id, law_id, size FROM versions ORDER BY status, size DESC, version_id LIMIT 25", "versions"))
def t01_two_keys(spark, d):
    return versions(spark, d).orderBy("status", F.desc("size"), "version_id").limit(25).select("version_id", "law_id", "size")


@query(T("SELECT src, dst, rel_type FROM edges ORDER BY position, src, dst, rel_type LIMIT 100", "edges"))
def t04_hard_cap(spark, d):
    """A cap with an order that decides."""
    return edges(spark, d).orderBy("position", "src", "dst", "rel_type").limit(100).select("src", "dst", "rel_type")


@query(T("SELECT node_id FROM nodes ORDER BY md5('7:' || node_id), node_id LIMIT 50", "nodes"))
def t09_seeded_sample(spark, d):
    """A sample of fifty: the least by a seeded hash, the same in every run."""
    return nodes(spark, d).orderBy(F.md5(F.concat(F.lit("7:"), "node_id")), "node_id").limit(50).select("node_id")


@query("SELECT l_orderkey AS id, translate(l_orderkey::VARCHAR, '0123456789', '0123456789') AS half FROM lineitem")
def f08_half_width(spark, d):
    wide = F.translate(F.col("l_orderkey").cast("string"), "0123456789", jp.FULL_WIDTH)
    return spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), jp.half_width_digits(wide).alias("half"))


@query("SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 1925 WHEN 1 THEN 1988 ELSE 2018 END + p_size AS year FROM part")
def f10_era_years(spark, d):
    era = F.when(F.col("p_size") % 3 == 0, "昭和").when(F.col("p_size") % 3 == 1, "平成").otherwise("令和")
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), jp.era_year(era, "p_size").alias("year"))


@query(T("WITH i AS (SELECT version_id, lpad((version_id % 1000)::VARCHAR, 3, '0') AS y, CASE version_id % 3 WHEN 0 THEN 'AC' WHEN 1 THEN 'CO' ELSE 'bad' END AS t, lpad(version_id::VARCHAR, 10, '0') AS n FROM versions) SELECT y || t || n AS law_id, CASE WHEN t <> 'bad' THEN y END AS era_year, CASE WHEN t <> 'bad' THEN t END AS type_code, CASE WHEN t <> 'bad' THEN n END AS number, CASE t WHEN 'AC' THEN '法律' WHEN 'CO' THEN '政令' ELSE 'その他' END AS kind FROM i", "versions"))
def f11_law_id_parts(spark, d):
    """Ids of two kinds and ids of no known form."""
    n = F.col("version_id")
    kind = F.when(n % 3 == 0, "AC").when(n % 3 == 1, "CO").otherwise("bad")
    made = F.concat(F.lpad((n % 1000).cast("string"), 3, "0"), kind, F.lpad(n.cast("string"), 10, "0"))
    df = versions(spark, d).select(made.alias("law_id")).withColumn("p", jp.law_id_parts("law_id"))
    return df.select("law_id", "p.era_year", "p.type_code", "p.number", jp.law_type_of("law_id").alias("kind"))


@query("SELECT doc_id, (length(substr(text, 1, 300)) - length(replace(substr(text, 1, 300), chr(10), '')) + 1) AS line, length(string_split(substr(text, 1, 300), chr(10))[-1]) AS col FROM documents")
def f21_line_and_column(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", jp.line_of("text", F.lit(300)).alias("line"), jp.column_of("text", F.lit(300)).alias("col"))


@query(T("SELECT src, dst, CASE WHEN dst % 2 = 0 THEN '#article-' || dst ELSE '/laws/' || dst || '#article-' || dst END AS target FROM edges", "edges"))
def f28_link_targets(spark, d):
    e = edges(spark, d)
    law = F.when(F.col("dst") % 2 == 0, F.lit("own")).otherwise(F.col("dst").cast("string"))
    return e.select("src", "dst", jp.link_target(law, F.col("dst").cast("string"), F.lit("own")).alias("target"))


@query(T("SELECT rel_type, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM edges GROUP BY ALL", "edges"))
def f30_confidence_bands(spark, d):
    return edges(spark, d).groupBy("rel_type", jp.confidence_band("confidence").alias("band")).agg(F.count("*").alias("n"))


@query(T("SELECT version_id, CASE WHEN status = 'P' THEN 'in force' WHEN status = 'F' THEN 'repealed' ELSE status END AS state, CASE WHEN status = 'F' THEN 1.0::DOUBLE ELSE 0.6 END AS confidence, status <> 'F' AS needs_review FROM versions", "versions"))
def f33_state_changes(spark, d):
    """Domain transitions: verifying sets confidence to one, below 0.7 a row needs review."""
    s = F.col("status")
    confidence = F.when(s == "F", 1.0).otherwise(0.6)
    return versions(spark, d).select("version_id", F.when(s == "P", "in force").when(s == "F", "repealed").otherwise(s).alias("state"), confidence.alias("confidence"), (confidence < 0.7).alias("needs_review"))


@query(T("SELECT round(count(*) FILTER (flag = 'R') / count(*), 6) AS filter_rate FROM articles", "articles"))
def e07_filter_rate(spark, d):
    return articles(spark, d).agg(F.round(F.count_if(F.col("flag") == "R") / F.count("*"), 6).alias("filter_rate"))


@query(T("SELECT version_id, article_number, node_id, flag FROM articles QUALIFY row_number() OVER (PARTITION BY version_id, article_number ORDER BY CASE flag WHEN 'A' THEN 0 ELSE 1 END, node_id, chapter, length, enforced) = 1", "articles"))
def r09_source_rank(spark, d):
    """One row for each place; rows of the first source win over the others."""
    a = articles(spark, d).withColumn("rank", F.when(F.col("flag") == "A", 0).otherwise(1))
    return first_by(a, ["version_id", "article_number"], ["rank", "node_id", "chapter", "length", "enforced"]).select("version_id", "article_number", "node_id", "flag")
