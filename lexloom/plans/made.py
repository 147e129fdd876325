"""Scalar functions and detection on rows made of table columns: numerals, law numbers, titles, links, relative references, order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import japanese as jp
from lexloom.operators import spans as sp
from lexloom.operators.conflicts import first_by
from lexloom.operators.ranges import article_rank
from lexloom.operators.relative import resolve, resolve_in_turn
from lexloom.operators.structure import enclosing, headings
from lexloom.operators.text_links import expand_abbreviations, segments
from lexloom.plans.catalog import query
from lexloom.sources.tables import articles, laws, nodes, versions, with_tables

T = with_tables
_DIGITS, _UNITS = ("一", "二", "三", "四", "五", "六", "七", "八", "九"), ((1000, "千"), (100, "百"), (10, "十"))


def w(*parts) -> Column:
    """Texts and columns joined; text parts are literals."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def kanji(n: Column) -> Column:
    """A numeral below ten thousand spelled digit by digit, apart from the library's own."""
    digit = lambda u: F.floor(n / u).cast("int") % 10
    name = lambda x: F.element_at(F.array(*map(F.lit, _DIGITS)), F.greatest(x, F.lit(1)))
    parts = [F.when(digit(u) == 0, "").when(digit(u) == 1, unit).otherwise(F.concat(name(digit(u)), F.lit(unit))) for u, unit in _UNITS]
    return F.concat(*parts, F.when(digit(1) == 0, "").otherwise(name(digit(1))))


def kanji_sql(n: str) -> str:
    digits = "[" + ", ".join(f"'{d}'" for d in _DIGITS) + "]"
    parts = [f"CASE (({n}) // {u}) % 10 WHEN 0 THEN '' WHEN 1 THEN '{unit}' ELSE {digits}[(({n}) // {u}) % 10] || '{unit}' END" for u, unit in _UNITS]
    return "(" + " || ".join([*parts, f"CASE ({n}) % 10 WHEN 0 THEN '' ELSE {digits}[({n}) % 10] END"]) + ")"


@query(T(f"SELECT node_id, {kanji_sql('node_id % 9999 + 1')} AS numeral, node_id % 9999 + 1 AS value FROM nodes", "nodes"))
def f06_kanji_to_int(spark, d):
    made = nodes(spark, d).select("node_id", kanji(F.col("node_id") % 9999 + 1).alias("numeral"))
    return made.withColumn("value", jp.kanji_to_int("numeral").cast("long"))


@query(T(f"SELECT node_id, {kanji_sql('node_id % 9999 + 1')} AS numeral FROM nodes", "nodes"))
def f07_int_to_kanji(spark, d):
    return nodes(spark, d).select("node_id", jp.int_to_kanji(F.col("node_id") % 9999 + 1).alias("numeral"))


@query(
    T(
        f"WITH x AS (SELECT version_id, version_id % 3 AS e, version_id % 30 + 1 AS y, version_id % 500 + 1 AS n, version_id % 2 = 0 AS law FROM versions) SELECT version_id, CASE WHEN version_id % 7 = 0 THEN '不明' ELSE ['昭和', '平成', '令和'][e + 1] || CASE WHEN version_id % 5 = 0 THEN {kanji_sql('y')} ELSE y::VARCHAR END || '年' || CASE WHEN law THEN '法律' ELSE '政令' END || '第' || CASE WHEN version_id % 5 = 0 THEN {kanji_sql('n')} ELSE n::VARCHAR END || '号' END AS law_number, "
        "CASE WHEN version_id % 7 <> 0 THEN (e + 3) || lpad(y::VARCHAR, 2, '0') || CASE WHEN law THEN 'AC' ELSE 'CO' END || lpad(n::VARCHAR, 10, '0') END AS law_id FROM x",
        "versions",
    )
)
def f09_law_number_ids(spark, d):
    """Law numbers in arabic and kanji numerals to ids; what is no law number has none."""
    v = F.col("version_id")
    y, n, spelled = v % 30 + 1, v % 500 + 1, v % 5 == 0
    era = F.element_at(F.array(*map(F.lit, ("昭和", "平成", "令和"))), (v % 3 + 1).cast("int"))
    number = w(era, F.when(spelled, kanji(y)).otherwise(y.cast("string")), "年", F.when(v % 2 == 0, "法律").otherwise("政令"), "第", F.when(spelled, kanji(n)).otherwise(n.cast("string")), "号")
    return versions(spark, d).select("version_id", F.when(v % 7 == 0, "不明").otherwise(number).alias("law_number")).withColumn("law_id", jp.law_number_to_id("law_number"))


@query(T("SELECT law_id, CASE law_id % 4 WHEN 0 THEN '甲' || law_id || '法' WHEN 1 THEN '甲 （' || law_id || '） 附則' WHEN 2 THEN '甲' || law_id || '法改正法' ELSE '甲' || law_id || '等法' END AS short, CASE law_id % 4 WHEN 0 THEN '甲' || law_id || 'に関する法律' WHEN 1 THEN '甲(' || law_id || ')付則' WHEN 2 THEN '甲' || law_id || '法の一部を改正する法律' ELSE '甲' || law_id || '等に関する法律' END AS key FROM laws", "laws"))
def f13_titles(spark, d):
    i = F.col("law_id")
    title = F.when(i % 4 == 0, w("甲", i, "に関する法律")).when(i % 4 == 1, w("甲 （", i, "） 附則")).when(i % 4 == 2, w("甲", i, "法の一部を改正する法律")).otherwise(w("甲", i, "等に関する法律"))
    return laws(spark, d).select("law_id", jp.short_title(title).alias("short"), jp.title_key(title).alias("key"))


@query(T("SELECT law_id, CASE law_id % 3 WHEN 0 THEN '個人' || law_id || '情報の保護法' WHEN 1 THEN '甲' || law_id || '及び乙法|甲' || law_id || '法' ELSE '' END AS forms FROM laws", "laws"))
def f14_abbreviations(spark, d):
    i = F.col("law_id")
    title = F.when(i % 3 == 0, w("個人", i, "情報の保護に関する法律")).when(i % 3 == 1, w("甲", i, "及び乙に関する法律")).otherwise(w("甲", i, "法"))
    return laws(spark, d).select("law_id", F.array_join(jp.title_abbreviations(title), "|").alias("forms"))


@query(T("SELECT law_id, (law_id % 5)::INT AS start, (law_id % 5 + 2)::INT AS stop, '民訴' AS text, '民事訴訟法' AS full_name FROM laws UNION ALL SELECT law_id, (law_id % 5 + 4)::INT, (law_id % 5 + 7)::INT, '労基法', '労働基準法' FROM laws", "laws"))
def f16_abbreviations(spark, d):
    docs = laws(spark, d).select(F.col("law_id").alias("doc_id"), F.concat(F.expr("repeat('あ', int(law_id % 5))"), F.lit("民訴及び労基法")).alias("text"))
    found = expand_abbreviations(docs, [("民訴", "民事訴訟法"), ("労基法", "労働基準法"), ("労基", "労働基準法")])
    return found.select(F.col("doc_id").alias("law_id"), "start", F.col("end").alias("stop"), "text", F.col("full").alias("full_name"))


@query(T("SELECT version_id, '[甲' || law_id || ']と[第' || (version_id % 90 + 1) || '条]を' AS shown FROM versions", "versions"))
def f29_auto_links(spark, d):
    """A text cut at its references, linked parts in brackets; a reference that overlaps an earlier one is left out."""
    v = versions(spark, d).select(F.col("version_id").alias("doc_id"), w("甲", F.col("law_id")).alias("a"), w("第", F.col("version_id") % 90 + 1, "条").alias("b"))
    docs = v.select("doc_id", w(F.col("a"), "と", F.col("b"), "を").alias("text"))
    first, second = F.struct(F.lit(0).alias("start"), F.length("a").alias("end")), F.struct((F.length("a") + 1).alias("start"), (F.length("a") + 1 + F.length("b")).alias("end"))
    within = F.struct((F.length("a") + 2).alias("start"), (F.length("a") + 1 + F.length("b")).alias("end"))
    spans = v.select("doc_id", F.inline(F.array(first, second, within)))
    shown = F.array_join(F.transform("segments", lambda s: F.when(s["is_link"], F.concat(F.lit("["), s["text"], F.lit("]"))).otherwise(s["text"])), "")
    return segments(docs, spans).select(F.col("doc_id").alias("version_id"), shown.alias("shown"))


@query(T(f"SELECT number FROM (SELECT node_id::VARCHAR AS number, node_id::DOUBLE AS key FROM nodes WHERE node_id % 3 = 0 UNION SELECT {kanji_sql('node_id % 50 + 1')}, node_id % 50 + 1 FROM nodes WHERE node_id % 3 = 1 UNION SELECT {kanji_sql('node_id % 50 + 1')} || 'の二', node_id % 50 + 1.02 FROM nodes WHERE node_id % 3 = 2) ORDER BY key, number LIMIT 90", "nodes"))
def t06_article_order(spark, d):
    """The first ninety of arabic and kanji article numbers, branches behind their articles."""
    i, spelled = F.col("node_id"), kanji(F.col("node_id") % 50 + 1)
    made = nodes(spark, d).select(F.when(i % 3 == 0, i.cast("string")).when(i % 3 == 1, spelled).otherwise(w(spelled, "の二")).alias("number")).distinct()
    return made.orderBy(*jp.article_order("number")).limit(90)


@query(T("WITH x AS (SELECT DISTINCT version_id, article_number AS n, chapter % 4 AS b FROM articles), y AS (SELECT version_id, n, b, lag(n * 1000 + b) OVER (PARTITION BY version_id ORDER BY n DESC, b DESC) AS after FROM x) SELECT version_id, count(*) AS numbers, count(*) FILTER (after > n * 1000 + b) AS rising, max(n * 1000 + b)::BIGINT AS last FROM y GROUP BY version_id", "articles"))
def f03_article_compare(spark, d):
    """Article numbers with branches compared by rank: the last of each version, and every number below the one after it."""
    from pyspark.sql import Window

    n, b = F.col("article_number"), F.col("chapter") % 4
    number = F.when(b == 0, w("第", kanji(n), "条")).otherwise(w("第", n, "条の", b))
    x = articles(spark, d).select("version_id", number.alias("number")).distinct().withColumn("rank", article_rank("number"))
    after = F.lag("rank").over(Window.partitionBy("version_id").orderBy(F.desc("rank")))
    value = F.max("rank")
    return x.withColumn("after", after).groupBy("version_id").agg(F.count("rank").alias("numbers"), F.count_if(F.col("after") > F.col("rank")).alias("rising"), (value[0] * 1000 + F.coalesce(F.try_element_at(value, F.lit(2)), F.lit(0))).cast("long").alias("last"))


_TITLES = "['あ', 'ア', 'か', 'カ', 'さ']"


@query(T(f"SELECT {_TITLES}[law_id % 5 + 1] || lpad(law_id::VARCHAR, 8, '0') AS title FROM laws ORDER BY [1, 1, 2, 2, 3][law_id % 5 + 1], law_id LIMIT 40", "laws"))
def t05_collated_order(spark, d):
    """Titles in Japanese order: hiragana and katakana of one sound stand together, unlike in the order of code points."""
    title = w(F.element_at(F.expr(f"array({_TITLES[1:-1]})"), (F.col("law_id") % 5 + 1).cast("int")), F.lpad(F.col("law_id").cast("string"), 8, "0"))
    made = laws(spark, d).select(title.alias("title"))
    return made.orderBy(F.collate("title", "ja")).limit(40)


@query(
    T(
        "WITH x AS (SELECT node_id, number + 0 AS a, node_id % 4 + 1 AS q, node_id % 5 + 1 AS i, node_id % 8 AS f FROM nodes) SELECT node_id, "
        "CASE WHEN f IN (0, 6) AND a <= 1 THEN CASE WHEN f = 0 THEN a END WHEN f IN (0, 6) THEN a - 1 WHEN f = 1 THEN a + 1 WHEN f = 2 THEN greatest(1, a - 3) WHEN f = 7 AND q <= 1 THEN NULL ELSE a END::VARCHAR AS to_article, "
        "CASE f WHEN 3 THEN greatest(1, q - 1) WHEN 4 THEN q + 2 WHEN 5 THEN q WHEN 6 THEN CASE WHEN a > 1 THEN 2 END WHEN 7 THEN CASE WHEN q > 1 THEN q - 1 END END::BIGINT AS to_paragraph, "
        "CASE f WHEN 5 THEN greatest(1, i - 1) WHEN 7 THEN CASE WHEN q > 1 THEN 3 END END::VARCHAR AS to_item, "
        "CASE f WHEN 0 THEN CASE WHEN a <= 1 THEN 0.3 ELSE 0.95 END WHEN 1 THEN 0.95 WHEN 2 THEN 0.9 WHEN 3 THEN CASE WHEN q <= 1 THEN 0.4 ELSE 0.95 END WHEN 4 THEN 0.9 WHEN 5 THEN CASE WHEN i <= 1 THEN 0.3 ELSE 0.95 END WHEN 6 THEN CASE WHEN a > 1 THEN 0.9 END ELSE CASE WHEN q > 1 THEN 0.9 END END::DOUBLE AS confidence FROM x",
        "nodes",
    )
)
def v01_relative(spark, d):
    """Eight forms of relative references from the article, paragraph and item of each node."""
    forms = F.array(*map(F.lit, ("前条", "次条", "前三条", "前項", "次二項", "前号", "前条第二項", "前項第三号")))
    i = F.col("node_id")
    x = nodes(spark, d).select("node_id", F.element_at(forms, (i % 8 + 1).cast("int")).alias("text"), F.col("number").cast("string").alias("a"), (i % 4 + 1).alias("q"), (i % 5 + 1).cast("string").alias("i"))
    r = x.withColumn("r", resolve("text", "a", "q", "i"))
    return r.select("node_id", F.col("r.article_number").alias("to_article"), F.col("r.paragraph_number").alias("to_paragraph"), F.col("r.item_number").alias("to_item"), F.col("r.confidence").alias("confidence"))


@query(T("WITH a AS (SELECT version_id, article_number AS n, min(flag) AS flag FROM articles GROUP BY ALL) SELECT version_id, n AS position, (version_id % 20 + 9 + sum(CASE flag WHEN 'A' THEN -1 ELSE 1 END) OVER (PARTITION BY version_id ORDER BY n))::BIGINT::VARCHAR AS article_number FROM a", "articles"))
def v11_relative_in_turn(spark, d):
    """Each resolved reference moves the context that the next is resolved in: 前条 and 次条 by the flags of a version's articles."""
    a = articles(spark, d).groupBy("version_id", "article_number").agg(F.min("flag").alias("flag"))
    rows = a.select("version_id", F.col("article_number").alias("position"), F.when(F.col("flag") == "A", "前条").otherwise("次条").alias("text"), (F.col("version_id") % 20 + 9).cast("string").alias("article"), F.lit(1).alias("paragraph"))
    return resolve_in_turn(rows, "version_id").select("version_id", "position", "article_number")


@query(T("SELECT version_id, [NULL, 'deletion', 'old_law', 'draft', 'amendment', 'explanation'][version_id % 6 + 1] AS family FROM versions", "versions"))
def n01_negative_contexts(spark, d):
    n = F.col("version_id") % 90 + 1
    forms = F.array(w("第", n, "条の規定による"), w("第", n, "条を削除し"), w("旧商法の第", n, "条"), w("草案の第", n, "条"), w("第", n, "条を第", n + 1, "条とする"), w("第", n, "条について述べる"))
    made = versions(spark, d).select("version_id", F.element_at(forms, (F.col("version_id") % 6 + 1).cast("int")).alias("context"))
    return made.select("version_id", sp.negative_family("context").alias("family"))


_BASE_SQL = "'民法第' || (version_id % 90 + 1) || '条による。第五条と商法第' || " + kanji_sql("version_id % 40 + 1") + " || '条' || repeat('を見る。乙法第三条', (version_id % 3)::INT)"


@query(T(f"WITH x AS (SELECT version_id, {_BASE_SQL} AS t FROM versions) SELECT version_id, (len(regexp_extract_all(t, '[^、。\\s（）「」]+法第[0-9一二三四五六七八九十百千]+条')) + len(regexp_extract_all(t, '第[0-9一二三四五六七八九十百千]+条')))::BIGINT AS n FROM x", "versions"))
def e05_baseline_spans(spark, d):
    v = F.col("version_id")
    text = F.concat(w("民法第", v % 90 + 1, "条による。第五条と商法第", kanji(v % 40 + 1), "条"), F.expr("repeat('を見る。乙法第三条', int(version_id % 3))"))
    return sp.extract(versions(spark, d).select("version_id", text.alias("text")), sp.BASELINE_RULES).groupBy("version_id").agg(F.count("*").alias("n"))


@query(
    T(
        "WITH x AS (SELECT version_id, law_id, '顧客' || law_id || '法' AS name, version_id % 50 + 1 AS a, version_id % 40 + 2 AS b, version_id % 30 + 3 AS c FROM versions), "
        "y AS (SELECT *, 5 + length(name || '第' || a || '条、') AS p, 5 + length(name || '第' || a || '条、第' || b || '条及び') AS q FROM x) "
        "SELECT version_id, name || '第' || a || '条' AS text, 5 AS start, law_id AS target_law_id, '第' || a || '条' AS target_article FROM y UNION ALL SELECT version_id, '第' || b || '条', p::INT, law_id, '第' || b || '条' FROM y UNION ALL SELECT version_id, '第' || c || '条', q::INT, law_id, '第' || c || '条' FROM y",
        "versions",
    )
)
def d00_detect(spark, d):
    """The whole detector over a list of three articles of a named law, after other words: each member is the law's."""
    v, name = F.col("version_id"), w("顧客", F.col("law_id"), "法")
    text = w("前に述べた", name, "第", v % 50 + 1, "条、第", v % 40 + 2, "条及び第", v % 30 + 3, "条を見る。")
    none = F.lit(None).cast("string")
    made = versions(spark, d).select(v.alias("doc_id"), text.alias("text"), none.cast("long").alias("law_id"), none.alias("law_name"), none.alias("article"), F.lit(1).alias("paragraph"))
    found = sp.detect(made, laws(spark, d).select(name.alias("name"), "law_id"))
    return found.select(F.col("doc_id").alias("version_id"), "text", "start", "target_law_id", "target_article")


_LINES = """WITH a AS (SELECT version_id, article_number AS n FROM articles GROUP BY ALL),
l AS (SELECT version_id, n, CASE WHEN n % 3 = 1 THEN '第' || n || '章　総則' || chr(10) ELSE '' END AS c, CASE WHEN n % 2 = 0 THEN '　第' || n || '節　通則' || chr(10) ELSE '' END AS s, '第' || n || '条　前条に従う。' || chr(10) AS t FROM a),
o AS (SELECT *, coalesce(sum(length(c || s || t)) OVER (PARTITION BY version_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(c || s) + length('第' || n || '条　') AS place,
  max(CASE WHEN c <> '' THEN n END) OVER (PARTITION BY version_id ORDER BY n) AS chapter, max(CASE WHEN s <> '' THEN n END) OVER (PARTITION BY version_id ORDER BY n) AS section FROM l)
SELECT version_id, place::INTEGER AS start, '第' || chapter || '章' AS chapter, CASE WHEN section >= coalesce(chapter, 0) THEN '第' || section || '節' END AS section, '第' || n || '条' AS article FROM o"""


@query(T(_LINES, "articles"))
def d09_enclosing_units(spark, d):
    """The chapter, section and article that hold each relative reference of a text with headings; a chapter ends the sections before it."""
    n = F.col("article_number")
    line = F.concat(F.when(n % 3 == 1, w("第", n, "章　総則\n")).otherwise(""), F.when(n % 2 == 0, w("　第", n, "節　通則\n")).otherwise(""), w("第", n, "条　前条に従う。\n"))
    held = articles(spark, d).select("version_id", "article_number").distinct().groupBy("version_id").agg(F.sort_array(F.collect_list(F.struct("article_number", line.alias("t")))).alias("p"))
    docs = held.select("version_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"))
    spans = sp.extract(docs, tuple(r for r in sp.STATUTE_RULES if r.name == "relative_前条")).select("version_id", "start")
    return enclosing(spans, headings(docs, "version_id"), "version_id").select("version_id", "start", "chapter", "section", "article")


@query(T("SELECT version_id, chapter AS law, article_number AS article, min(node_id) AS node_id FROM (SELECT *, row_number() OVER (PARTITION BY version_id, article_number, chapter ORDER BY node_id) AS r FROM articles) WHERE r = 1 GROUP BY ALL", "articles"))
def r07_first_by_law_and_article(spark, d):
    """The first reference of each (start, law, article)."""
    a = articles(spark, d).select("version_id", F.col("chapter").alias("law"), F.col("article_number").alias("article"), "node_id")
    return first_by(a, ["version_id", "article", "law"], ["node_id"])
