"""Names, defined terms, lists and ranges against plain re-tellings."""

import re
import random

import pytest
from pyspark.sql import functions as F

from lexloom.operators import spans as sp
from lexloom.operators.mentions import defined_term_citations, enumerations, find_names, lists_in, value_of
from lexloom.operators.ranges import article_rank, range_members


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


class TestNames:
    @pytest.mark.parametrize("names_a_shard", [100_000, 3])
    def test_equals_all_occurrences_that_lie_in_no_longer_one(self, spark, names_a_shard):
        r = random.Random(4)
        names = sorted({"".join(r.choice("甲乙法") for _ in range(r.randrange(1, 5))) for _ in range(25)})
        docs = ["".join(r.choice("甲乙法 丙") for _ in range(r.randrange(40))) for _ in range(80)] + ["", None]
        got = find_names(texts(spark, docs), spark.createDataFrame([(n,) for n in [*names, names[0], ""]], "name string"), names_a_shard=names_a_shard)
        want = set()
        for i, t in enumerate(docs):
            spans = {(s, s + len(n), n) for n in names for s in range(len(t or "")) if t.startswith(n, s)}
            want |= {(i, *s) for s in spans if not any(o != s and o[0] <= s[0] and o[1] >= s[1] for o in spans)}
        rows = [tuple(x) for x in got.collect()]
        assert set(rows) == want and len(rows) == len(want)

    def test_no_names(self, spark):
        assert find_names(texts(spark, ["民法"]), spark.createDataFrame([], "name string")).collect() == []


class TestDefinedTerms:
    def test_the_longest_term_that_ends_at_the_article(self, spark):
        docs = texts(spark, ["新会社法第3条、会社法第4条、法第5条、第6条", "会社法第3条", None, ""])
        terms = spark.createDataFrame([(0, "会社法", "甲"), (0, "新会社法", "乙"), (1, "新会社法", "丙"), (2, "会社法", "丁")], "doc_id long, term string, stands_for string")
        got = [(r.doc_id, r.text, r.stands_for, r.start) for r in defined_term_citations(docs, terms).orderBy("start").collect()]
        assert got == [(0, "新会社法第3条", "乙", 0), (0, "会社法第4条", "甲", 8)]

    def test_in_the_detector(self, spark):
        rows = [(1, "顧客一法（以下「本則法」という。）に従い、本則法第3条を適用する。", None, None, "1", 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, law_id string, law_name string, article string, paragraph int")
        names = spark.createDataFrame([("顧客一法", "A")], "name string, law_id string")
        found = {(r.text, r.rule, r.target_law_id) for r in sp.detect(docs, names, terms=sp.definitions(docs)).collect()}
        assert ("本則法第3条", "defined_term", "A") in found


def members(text):
    return [[(m[2], m[3], m[6], m[8], m[9], *m[10:13]) for m in x] for x in lists_in(text)]


class TestLists:
    def test_of_articles(self):
        assert members("第3条、第5条及び第7条の規定により処理する。") == [[("第3条", None, "3", None, None, None, None, None), ("第5条", None, "5", None, None, None, None, None), ("第7条", None, "7", None, None, None, None, None)]]

    def test_levels_are_inherited_and_laws_change(self):
        (got,) = members("民法第九十条第1項及び第2項、第三条の二第4号並びに商法第10条から第12条まで")
        assert got == [
            ("民法第九十条第1項", "民法", "90", 1, None, None, None, None), ("第2項", "民法", "90", 2, None, None, None, None),
            ("第三条の二第4号", "民法", "3の2", None, 4, None, None, None), ("商法第10条から第12条まで", "商法", "10", None, None, "12", None, None),
        ]

    @pytest.mark.parametrize("n", range(2, 21))
    def test_of_any_length(self, spark, n):
        r = random.Random(n)
        text = "見よ、民法" + "".join(("" if i == 0 else r.choice(["、", "及び", "又は", "並びに", "若しくは", "、及び"])) + f"第{i + 1}条" for i in range(n)) + "。第9条を除く。"
        (got,) = members(text)
        assert [(m[1], m[2]) for m in got] == [("民法", str(i + 1)) for i in range(n)]

    def test_single_members_and_other_texts_are_no_lists(self, spark):
        assert members("第3条を見よ。第4条から第6条まで。法第、及び第") == []
        assert enumerations(texts(spark, ["", None, "第1条", "x" * 5000])).collect() == []

    def test_numerals(self):
        assert [value_of(x) for x in ("十", "二十一", "百三", "千九百八十九", "7", "", None)] == [10, 21, 103, 1989, 7, None, None]

    def test_the_detector_gives_members_the_list_s_law(self, spark):
        rows = [(1, "これは会社法第2条、第5条及び第7条の規定に従う。", "X", None, "1", 1)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, law_id string, law_name string, article string, paragraph int")
        names = spark.createDataFrame([("会社法", "A")], "name string, law_id string")
        found = [(r.text, r.target_law_id, r.target_article) for r in sp.detect(docs, names).orderBy("start").collect()]
        assert found == [("会社法第2条", "A", "第2条"), ("第5条", "A", "第5条"), ("第7条", "A", "第7条")]


class TestRanges:
    def test_ranks(self, spark):
        values = ["第3条の2", "3の2", "第三条の二", "１２", "第十条", "無効", None, "第3条の2の十"]
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", article_rank("v").alias("r")).orderBy("i").collect()
        assert [r.r for r in rows] == [[3, 2], [3, 2], [3, 2], [12], [10], None, None, [3, 2, 10]]

    def test_members_with_branches_across_bins(self, spark):
        have = ["1", "2", "3", "3の2", "3の2の4", "3の10", "4", "4の2", "5", "40", "十", "別表"]
        rank = lambda x: [int(p) for p in x.replace("十", "10").split("の")]
        asked = [("3の2", "4"), ("第一条", "第40条"), ("4", "3"), ("x", "4"), (None, "4"), ("3の3", "3の9")]
        ranges = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(asked)], "version_id int, i int, first string, last string")
        got = range_members(ranges, spark.createDataFrame([(v, x) for v in (1, 2) for x in have], "version_id int, article_number string"), bin_size=2)
        want = {(i, x) for i, (a, b) in enumerate(asked) if a and a != "x" for x in have[:-1] if rank(a.strip("第条").replace("一", "1")) <= rank(x) <= rank(b.strip("第条"))}
        assert {(r.i, r.member) for r in got.collect()} == want and got.count() == len(want)


def test_bounds_leave_unknown_laws_and_own_articles(spark):
    rows = [(1, "甲法第99条、乙法第99条を見る。第5000条と丙法第1001条と丙法第1000条を見る。", None, None, "1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, law_id string, law_name string, article string, paragraph int")
    names = spark.createDataFrame([("甲法", "A"), ("乙法", "B"), ("丙法", "C")], "name string, law_id string")
    bounds = spark.createDataFrame([("A", 26), ("B", 99)], "law_id string, last_article long")
    found = {r.text for r in sp.detect(docs, names, bounds=bounds).select(F.col("text")).collect()}
    assert {"乙法第99条", "第5000条", "丙法第1000条"} <= found and not {"甲法第99条", "丙法第1001条", "第99条"} & found


def test_needed_characters_are_in_every_match():
    from lexloom.plans.mentions import SENTENCES

    text = "".join(SENTENCES).replace("{n}", "3").replace("{m}", "7").replace("{k}", "二")
    for rules in sp.VERSIONS.values():
        for r in rules:
            for m in re.finditer(r.pattern, text + ' "a" Ab Cd 1999 https://x', re.A):
                assert sp.needed(r.pattern) <= set(m[0]), r
    assert sp.needed("第([0-9]+)条(?:の([0-9]+))?から") == set("第条から") and not sp.needed("新法|旧法") and not sp.needed("あ?(い|う)*え{0,2}")


def test_templates():
    m = re.match("(a)(b)?(c)?", "ac")
    assert [sp._filler(t)(m) for t in ("{0}", "{2}", "", "x{1}[y{2}][z{3}]{2}", "{3}の{1}")] == ["ac", "", "", "xazc", "cのa"]


def test_rule_counts_match_equal_texts_once(spark):
    docs = spark.createDataFrame([(1, "第一条と第二条"), (2, "第一条と第二条"), (3, "第3条及び第4条"), (4, None), (5, "")], "doc_id long, text string")
    found = sp.rule_counts(docs)
    plain = sp.extract(docs).groupBy("rule").agg(F.min_by("type", "seq").alias("type"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate", plan.index("MapInArrow")) > 0


def test_many_names_take_one_pass_over_the_texts(spark):
    names = spark.createDataFrame([(n,) for n in ("税法", "地方税法", "乙税法", "税", "法地", "民法", "長い長い名前の法")], "name string")
    docs = spark.createDataFrame([(1, "特例地方税法と税法"), (2, None), (3, ""), (4, "民法地方税法"), (5, "長い長い名前の法、長い名前の法"), (6, "税法税")], "doc_id long, text string")
    few, many = find_names(docs, names), find_names(docs, names, names_a_shard=1)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect())) and few.count() > 6
    assert many._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_versions_are_compared_in_one_exchange(spark):
    from lexloom.operators.rulesets import compare_versions, rule_table

    docs = spark.createDataFrame([(1, "民法第1条と第2条")], "doc_id long, text string")
    found = compare_versions(docs, rule_table(spark), "statute", "baseline")
    assert sorted((r["start"], r["status"]) for r in found.collect()) == [(0, "both"), (6, "both")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange") == 1 and "Join" not in plan


def test_mentions_are_dealt_by_document_once_and_without_contexts(spark, monkeypatch):
    """One exchange by document serves all steps of the detector, of few names or many, and no context goes through it."""
    docs = spark.createDataFrame(
        [(1, "旧" + "長" * 40 + "民法第1条及び第2条、税法第3条を見る。同法第四条", None, None, "5", 1), (2, "特例地方税法第7条、第8条、次条", 3, "試験法", "5", 1), (3, "旧民法第1条、第2条", None, None, None, None), (4, None, None, None, None, None)],
        "doc_id int, text string, law_id long, law_name string, article string, paragraph int",
    )
    names = spark.createDataFrame([("民法", 1), ("税法", 2), ("地方税法", 3)], "name string, law_id long")
    few = sp.detect(docs, names)
    places = getattr(sp, "name_places", find_names)
    monkeypatch.setattr(sp, places.__name__, lambda *a, **how: places(*a, **how | {"names_a_shard": 1}))
    many = sp.detect(docs, names)
    got = sorted(map(tuple, few.select("doc_id", "start", "text", "target_law_id", "target_article").collect()))
    assert got == sorted(map(tuple, many.select("doc_id", "start", "text", "target_law_id", "target_article").collect()))
    assert [(i, text) for i, _, text, *_ in got] == [(1, "民法第1条"), (1, "第2条"), (1, "税法第3条"), (1, "同法第四条"), (2, "地方税法第7条"), (2, "第8条"), (2, "次条")]
    for found in (few, many):
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert plan.count("hashpartitioning(doc_id") == 1
