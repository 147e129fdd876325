"""Citation detection and its scalar functions, on inline statute texts and on the document tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import japanese as jp
from lexloom.operators import conflicts as cf
from lexloom.operators import spans as sp
from lexloom.operators.dictionary import build, resolve_names
from lexloom.operators.relative import resolve
from lexloom.plans.catalog import query
from lexloom.sources.tables import laws, versions, with_tables

def docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _rows(values) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in values)


@query("SELECT n AS version_id, '第' || n || '条' AS display, n::VARCHAR AS numeric FROM (SELECT o_orderkey AS n FROM orders)")
def f01_article_numbers(spark, d):
    """Numbers to kanji article numbers, and those normalised back."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("version_id"))
    a = o.withColumn("a", jp.article_number(F.concat(F.lit("第"), jp.int_to_kanji("version_id"), F.lit("条"))))
    return a.select("version_id", "a.display", "a.numeric")


@query("SELECT p_partkey AS id, array_to_string(list_transform(range(p_size, p_size + 4), lambda x: x::VARCHAR), ',') AS numbers FROM part")
def f04_article_range(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select(F.col("p_partkey").alias("id"), jp.article_range(F.concat(F.lit("第"), "p_size", F.lit("条")), (F.col("p_size") + 3).cast("string")).alias("numbers")).select("id", F.array_join("numbers", ",").alias("numbers"))


@query("SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]{4}'))[1] AS first_year, len(list_distinct(regexp_extract_all(text, '[0-9]{4}'))) AS years FROM documents WHERE len(regexp_extract_all(text, '[0-9]{4}')) = 1")
def f05_number_mentions(spark, d):
    found = F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]{4})"), 1))
    return docs(spark, d).select("doc_id", found.alias("y"), F.size(F.regexp_extract_all("text", F.lit("([0-9]{4})"), 1)).alias("n")).where("n = 1").select("doc_id", F.col("y")[0].alias("first_year"), F.size("y").cast("long").alias("years"))


@query("SELECT doc_id, substr(text, 11, 20) AS around, (length(substr(text, 1, 200)) - length(replace(substr(text, 1, 200), chr(10), '')) + 1) AS line FROM documents")
def f20_context_and_line(spark, d):
    """Context around an offset, and the offset's line."""
    return docs(spark, d).select("doc_id", jp.context_around("text", F.lit(15), F.lit(25), 5).alias("around"), jp.line_of("text", F.lit(200)).alias("line"))


@query("WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, '.', '。'), '。'), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, len(s) AS n, s[1] || '。' AS first FROM s WHERE len(s) > 0")
def f27_sentences(spark, d):
    s = docs(spark, d).select("doc_id", jp.sentences(F.replace("text", F.lit("."), F.lit("。"))).alias("s"))
    return s.where("size(s) > 0").select("doc_id", F.size("s").cast("long").alias("n"), F.col("s")[0].alias("first"))


@query("SELECT doc_id, CASE WHEN length(lower(trim(text)) || ':' || source) > 100 THEN sha256(lower(trim(text)) || ':' || source) ELSE lower(trim(text)) || ':' || source END AS key FROM documents")
def f22_cache_keys(spark, d):
    return docs(spark, d).select("doc_id", jp.cache_key("text", "source").alias("key"))


@query("SELECT p_partkey AS id, greatest(1, p_size - 2)::VARCHAR AS before_two, (p_size + 1)::VARCHAR AS after_one FROM part")
def v10_relative_batch(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("string").alias("a"), F.lit(1).alias("p"), F.lit(None).cast("string").alias("i"))
    at = lambda t: resolve(F.lit(t), "a", "p", "i")["article_number"]
    return p.select("id", at("前二条").alias("before_two"), at("次条").alias("after_one"))


_MADE = "'この法律は、顧客' || law_id || '法第' || (version_id % 50 + 1) || '条により、第' || (version_id % 40 + 2) || '条に従う。前条を除く。'"
_AT = "t || '' AS full_text, version_id, law_id, version_id % 50 + 1 AS n, version_id % 40 + 2 AS m"


@query(
    with_tables(
        f"WITH x AS (SELECT {_AT} FROM (SELECT *, {_MADE} AS t FROM versions)) "
        "SELECT version_id, 'この法律' AS text, 'internal' AS type, 0 AS start, NULL::BIGINT AS target_law_id, NULL::VARCHAR AS target_article FROM x "
        "UNION ALL SELECT version_id, '顧客' || law_id || '法第' || n || '条', 'external', 6, law_id, n::VARCHAR FROM x "
        "UNION ALL SELECT version_id, '第' || m || '条', 'internal', (strpos(full_text, 'により、第') + 3)::INT, NULL, '第' || m || '条' FROM x "
        "UNION ALL SELECT version_id, '前条', 'relative', (strpos(full_text, '前条') - 1)::INT, NULL, (m - 1)::VARCHAR FROM x",
        "versions",
    )
)
def d03_detect_versions(spark, d):
    """The whole detector over a text of each version: this law, a named law's article, an article of its own, the one before.

    The law itself is an internal reference, as the rule that may add an article comes before the contextual one.
    """
    v = versions(spark, d)
    n, m = F.col("version_id") % 50 + 1, F.col("version_id") % 40 + 2
    text = F.concat(F.lit("この法律は、顧客"), "law_id", F.lit("法第"), n.cast("string"), F.lit("条により、第"), m.cast("string"), F.lit("条に従う。前条を除く。"))
    none = F.lit(None)
    made = v.select(F.col("version_id").alias("doc_id"), text.alias("text"), none.cast("long").alias("law_id"), none.cast("string").alias("law_name"), m.cast("string").alias("article"), F.lit(1).alias("paragraph"))
    dictionary = laws(spark, d).select(F.concat(F.lit("顧客"), "law_id", F.lit("法")).alias("name"), F.col("law_id").cast("long").alias("law_id"))
    found = sp.detect(made, dictionary)
    return found.select(F.col("doc_id").alias("version_id"), "text", "type", "start", "target_law_id", "target_article")


@query("SELECT doc_id, count(*) AS n, min(x) AS least FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[^\\s\"''<>]+')) AS x FROM (SELECT conv_id AS doc_id, text FROM conversations UNION ALL SELECT page_id, html FROM pages)) GROUP BY doc_id")
def d01_spans_of_pages(spark, d):
    """Links in pages and conversations by the generic rules."""
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "text")
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return sp.extract(c.unionByName(p), sp.GENERIC_RULES[:1]).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("text").alias("least"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][a-z]+(?: [A-Z][a-z]+)+')) AS x FROM documents) GROUP BY doc_id")
def d02_spans_of_documents(spark, d):
    return sp.extract(docs(spark, d).select("doc_id", F.regexp_replace("text", "[^\\x00-\\x7F]", "é").alias("text")), (sp._one("names", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+", "name", 0.5),)).groupBy("doc_id").agg(F.count("*").alias("n"))


_SPANS = "s AS (SELECT l_orderkey AS doc_id, (l_quantity * 4)::INTEGER AS start, (l_quantity * 4 + 1 + l_suppkey % 60)::INTEGER AS stop, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS seq, l_returnflag AS text, 0.5 + l_discount AS confidence FROM lineitem)"


def spans(spark, d):
    from pyspark.sql import Window

    i = spark.read.parquet(f"{d}/lineitem.parquet")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    start = (F.col("l_quantity") * 4).cast("int")
    return i.select(F.col("l_orderkey").alias("doc_id"), start.alias("start"), (start + 1 + (F.col("l_suppkey") % 60).cast("int")).alias("end"), F.row_number().over(w).alias("seq"), F.col("l_returnflag").alias("text"), (0.5 + F.col("l_discount")).alias("confidence"))


@query(f"WITH {_SPANS} SELECT doc_id, start, stop, seq FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.doc_id = a.doc_id AND b.seq <> a.seq AND b.start <= a.start AND b.stop >= a.stop AND (b.start < a.start OR b.stop > a.stop OR b.seq < a.seq))")
def r01_containment_maximal(spark, d):
    return cf.containment_maximal(spans(spark, d)).select("doc_id", "start", F.col("end").alias("stop"), "seq")


@query(f"WITH {_SPANS} SELECT doc_id, text, seq, round(confidence, 4) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY seq) = 1")
def r08_first_by_text(spark, d):
    return cf.first_by(spans(spark, d), ["doc_id", "text"], ["seq"]).select("doc_id", "text", "seq", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_SPANS} SELECT doc_id, start, text, seq FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, start, text ORDER BY seq) = 1")
def r05_first_by_place(spark, d):
    return cf.first_by(spans(spark, d), ["doc_id", "start", "text"], ["seq"]).select("doc_id", "start", "text", "seq")


@query(f"WITH {_SPANS} SELECT doc_id, text, seq, round(confidence, 4) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, text ORDER BY confidence DESC, seq) = 1")
def r06_strongest(spark, d):
    return cf.strongest_by(spans(spark, d), ["doc_id", "text"]).select("doc_id", "text", "seq", F.round("confidence", 4).alias("confidence"))


@query(f"WITH {_SPANS}, p AS (SELECT *, CASE text WHEN 'A' THEN 3 WHEN 'N' THEN 5 ELSE 7 END AS priority, CASE WHEN text = 'R' THEN 'range' ELSE 'internal' END AS type FROM s), k AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.start <= a.start AND b.stop >= a.stop AND b.priority > a.priority AND a.type = 'internal' AND a.priority <= 5)) SELECT doc_id, start, stop, text, seq FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, start, stop, text ORDER BY priority DESC, seq) = 1")
def r02_priority(spark, d):
    s = spans(spark, d).withColumns({"priority": F.when(F.col("text") == "A", 3).when(F.col("text") == "N", 5).otherwise(7), "type": F.when(F.col("text") == "R", "range").otherwise("internal"), "target": F.col("text"), "is_range_member": F.lit(False)})
    return cf.by_priority(s).select("doc_id", "start", F.col("end").alias("stop"), "text", "seq")


@query()
def r03_greedy_longest(spark, d):
    return cf.greedy_longest(spans(spark, d))


@query(f"WITH {_SPANS} SELECT doc_id, seq, round(confidence * CASE WHEN text = 'A' THEN 0.95 ELSE 1 END * CASE WHEN text = 'N' THEN 0.9 ELSE 1 END, 4) AS confidence FROM s")
def r04_adjusted(spark, d):
    s = spans(spark, d).withColumn("sentence", F.when(F.col("text") == "A", "ただし、").when(F.col("text") == "N", "準用する").otherwise("本文"))
    return cf.adjusted_confidence(s).select("doc_id", "seq", F.round("confidence", 4).alias("confidence"))


@query("WITH l AS (SELECT c_custkey AS law_id, c_name AS title FROM customer) SELECT l.law_id AS mention, l.title AS name, m.law_id FROM l JOIN (SELECT title, max(law_id) AS law_id FROM l GROUP BY title) m USING (title)")
def f18_dictionary_lookup(spark, d):
    """Dictionary built from the laws, then every title looked up in it."""
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("law_id"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("law_number"), F.col("c_custkey").alias("position"))
    made = build(c.withColumn("law_id", F.col("law_id").cast("string")))
    return resolve_names(c.select(F.col("law_id").alias("mention"), F.col("title").alias("name")), made).select("mention", "name", F.col("law_id").cast("long").alias("law_id"))


@query("SELECT s_suppkey AS id, 'M' || s_suppkey AS item FROM supplier ORDER BY s_suppkey % 50, s_suppkey LIMIT 30")
def t07_item_order(spark, d):
    """Items in the order of their kanji numbers."""
    s = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("id"), jp.int_to_kanji((F.col("s_suppkey") % 50) + 1).alias("k"))
    return s.orderBy(jp.item_order("k"), "id").limit(30).select("id", F.concat(F.lit("M"), "id").alias("item"))
