"""Escapes, replaced references, flat references, rule tables and law lists."""

import re

import pytest
from pyspark.sql import functions as F

from lexloom.functions import text as tx
from lexloom.operators.evaluation import case_scores
from lexloom.operators.rulesets import compare_versions, rule_table, rules_of
from lexloom.operators.spans import VERSIONS
from lexloom.operators.tables import flat_references, replace_references
from lexloom.sources.statutes import law_list_named, page_of_files


def test_escapes(spark):
    df = spark.createDataFrame([("<a href='x'>&\"</a>",), (None,), ("a.b*(c)[d]{2}^$|\\",)], "t string")
    got = [(r.h, r.p) for r in df.select(tx.html_escaped("t").alias("h"), tx.pattern_escaped("t").alias("p")).collect()]
    assert got[0][0] == "&lt;a href=&#39;x&#39;&gt;&amp;&quot;&lt;/a&gt;" and got[1] == (None, None)
    assert re.fullmatch(got[2][1], "a.b*(c)[d]{2}^$|\\")


def test_references_of_laws_read_anew_are_replaced(spark):
    old = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "x"), (None, "z")], "law string, to string")
    new = spark.createDataFrame([("A", "w"), ("A", "w"), ("C", "x")], "law string, to string")
    got = sorted(map(tuple, replace_references(old, new, "law").collect()), key=repr)
    assert got == sorted([("A", "w"), ("B", "x"), ("C", "x"), (None, "z")], key=repr)


def test_flat_references_of_partial_structs(spark):
    df = spark.range(1).select(F.struct(F.struct(F.lit("L").alias("law_id")).alias("structural")).alias("source"), F.struct(F.lit(0.5).alias("confidence")).alias("metadata"))
    r = flat_references(df).first()
    assert (r.source_law, r.confidence, r.target_law, r.start) == ("L", 0.5, None, None)


def test_rules_survive_the_table(spark):
    table = rule_table(spark)
    for version, rules in VERSIONS.items():
        assert rules_of(table, version) == rules
    with pytest.raises(ValueError):
        rules_of(table, "none")


def test_versions_compared(spark):
    docs = spark.createDataFrame([(1, "民法第3条による。"), (2, "第2十条"), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.type, r.status) for r in compare_versions(docs, rule_table(spark), "statute", "baseline").collect()}
    assert got == {(1, "external", "both"), (2, "internal", "second")}


def test_case_scores(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "x")], "doc_id int, text string")
    wanted = spark.createDataFrame([(1, "a"), (2, "a"), (4, "y")], "doc_id int, text string")
    got = {r.doc_id: (r.precision, r.recall, r.passed) for r in case_scores(found, wanted).collect()}
    assert got == {1: (0.5, 1.0, False), 2: (1.0, 1.0, True), 3: (0.0, 0.0, False), 4: (0.0, 0.0, False)}


def test_law_list_by_either_name(spark, tmp_path):
    path = tmp_path / "laws.csv"
    path.write_text('法令ID,法令名,law_id,law_title\n1,"甲法（乙）",,\n,,2,丙法\n3,,,\n,無し,,\n', encoding="utf-8")
    got = sorted(tuple(r) for r in law_list_named(spark, str(path)).collect())
    assert got == [("1", "甲法（乙）", "甲法"), ("2", "丙法", None)]


def test_pages_of_files(spark, tmp_path):
    for i in (3, 1, 2, 10):
        (tmp_path / f"law{i:03}.xml").write_text(f"<Law>{i}</Law>", encoding="utf-8")
    page = lambda offset, limit: [(r.xml, r.has_more, r.next_offset) for r in page_of_files(spark, str(tmp_path), offset, limit).orderBy("path").collect()]
    assert page(0, 3) == [("<Law>1</Law>", True, 3), ("<Law>2</Law>", True, 3), ("<Law>3</Law>", True, 3)]
    assert page(3, 3) == [("<Law>10</Law>", False, None)]
    assert page(9, 3) == []
