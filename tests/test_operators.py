import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import japanese as jp
from lexloom.operators import conflicts, evaluation, graph, spans, tables
from lexloom.operators.dictionary import build, resolve_names, within_bounds


def values(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def kanji(n):
    """Numerals by plain division, to hold the column function against."""
    if n == 0:
        return "〇"
    out = ""
    if n >= 10000:
        out, n = kanji(n // 10000) + "万", n % 10000
    for unit, v in (("千", 1000), ("百", 100), ("十", 10)):
        d, n = divmod(n, v)
        out += "" if d == 0 else unit if d == 1 else "〇一二三四五六七八九"[d] + unit
    return out + ("〇一二三四五六七八九"[n] if n else "")


def test_numerals_round_trip(spark):
    numbers = [*range(0, 400), *random.Random(1).sample(range(400, 9_999_999), 300)]
    df = spark.createDataFrame([(n, kanji(n)) for n in numbers], "n long, k string")
    bad = df.where((jp.kanji_to_int("k") != F.col("n")) | (jp.int_to_kanji("n") != F.col("k")) | jp.kanji_to_int("k").isNull())
    assert bad.count() == 0
    odd = spark.createDataFrame([("",), (None,), ("abc",), ("一a",)], "k string")
    assert odd.where(jp.kanji_to_int("k").isNotNull()).count() == 0


@pytest.mark.parametrize(
    ("text", "numeric", "display", "value"),
    [("第90条", "90", "第90条", 90), ("90", "90", "第90条", 90), ("90条", "90", "第90条", 90), ("", "", "", 0), ("第九十条", "90", "第90条", 90), ("第一条", "1", "第1条", 1), (None, "", "", 0), ("無効", "", "無効", 0), ("第三条の二", "3", "第3条", 3)],
)
def test_article_number(spark, text, numeric, display, value):
    got = spark.createDataFrame([(text,)], "t string").select(jp.article_number("t").alias("a")).first()["a"]
    assert (got["numeric"], got["display"], got["value"]) == (numeric, display, value)


def test_article_range_and_mentions(spark):
    df = spark.createDataFrame([("1", "3"), ("", "3"), ("5", "2")], "a string, b string")
    assert [r[0] for r in df.select(jp.article_range("a", "b")).collect()] == [["1", "2", "3"], [], []]
    text = spark.createDataFrame([("第5条と第3条と第5条",)], "t string")
    assert text.select(jp.article_mentions("t")).first()[0] == ["5", "3"]


def test_positions(spark):
    df = spark.createDataFrame([("ab\ncd\nef", 4)], "t string, p int")
    assert tuple(df.select(jp.line_of("t", "p"), jp.column_of("t", "p"), jp.context_around("t", F.lit(3), F.lit(5), 2)).first()) == (2, 1, "b\ncd\ne")


def brute_maximal(rows):
    """Keep spans that no other span holds; of equal ones the first."""
    out = []
    for s in rows:
        if not any(o[0] == s[0] and o is not s and o[1] <= s[1] and o[2] >= s[2] and ((o[1], o[2]) != (s[1], s[2]) or o[3] < s[3]) for o in rows):
            out.append(s)
    return sorted(out)


def test_containment_maximal(spark):
    rng = random.Random(3)
    rows = [(d, a := rng.randrange(30), a + rng.randrange(1, 12), i) for d in range(30) for i in range(rng.randrange(1, 12))]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, seq int")
    assert values(conflicts.containment_maximal(df), "doc_id", "start", "end", "seq") == brute_maximal(rows)


def test_greedy_longest(spark):
    rows = [(1, 0, 5, 0, "abcde"), (1, 3, 10, 1, "defghij"), (1, 20, 22, 2, "xy"), (1, 30, 32, 3, "xy")]
    df = spark.createDataFrame(rows, "doc_id int, start int, end int, seq int, text string")
    assert values(conflicts.greedy_longest(df), "start") == [rows[1], rows[2]]


def test_detect(spark):
    docs = spark.createDataFrame(
        [(1, "会社法第九十条の規定による。", "X", "試験法", "5", 2), (2, "前条に定める。同条第4項", "X", "試験法", "5", 2), (3, "民法第3条を引き、同法第五条も引く。", "X", "試験法", "5", 2), (4, "第5条を削除し", "X", "試験法", "5", 2), (5, None, None, None, None, None), (6, "", "X", None, None, None)],
        "doc_id int, text string, law_id string, law_name string, article string, paragraph int",
    )
    names = spark.createDataFrame([("民法", "129AC0000000089"), ("会社法", "417AC0000000086")], "name string, law_id string")
    got = {(r["doc_id"], r["text"], r["target_law_id"], r["target_article"]) for r in spans.detect(docs, names).collect()}
    assert (1, "会社法第九十条", "417AC0000000086", "第九十条") in got
    assert (2, "前条", "X", "4") in got
    assert (3, "同法第五条", "129AC0000000089", "第五条") in got
    assert not [g for g in got if g[0] in (4, 5, 6)]
    assert [r for r in spans.detect(docs.where("doc_id = 4"), names, filter_negative=False).collect()]


def test_every_rule_fires(spark):
    """One text for each kind of rule, with the span that must come out of extraction."""
    cases = {
        "article_and": ("第1条及び第2条", {"第1条", "第2条"}), "range_kanji": ("第一条から第三条まで", {"第一条から第三条まで"}), "range_paragraph": ("第1条第2項から第4項まで", {"第1条第2項から第4項まで"}),
        "chapter": ("第3章第2節", {"第3章第2節"}), "mutatis": ("第5条の規定は、甲について準用", {"第5条の規定は、甲について準用"}), "replace_terms": ("第5条中「甲」とあるのは「乙」と読み替え", {"第5条中「甲」とあるのは「乙」と読み替え"}),
        "two_laws": ("民法第1条及び商法第2条", {"民法第1条", "商法第2条"}), "one_law_articles": ("民法第1条及び第2条", {"民法第1条", "第2条"}), "hierarchy": ("第一編第二章", {"第一編第二章"}), "relative_twice": ("前々条", {"前々条"}),
        "iroha_range": ("第1条第2号イからハまで", {"第1条第2号イからハまで"}), "supplementary_range": ("附則第1条から第3条まで", {"附則第1条から第3条まで"}), "supplementary": ("附則第1条第2項", {"附則第1条第2項"}),
        "items": ("第一号及び第二号", {"第一号", "第二号"}), "branch": ("第3条の二", {"第3条の二"}), "conditional": ("の場合には、第3条の規定", {"の場合には、第3条の規定"}), "exclusion": ("第3条（第2項を除く。）", {"第3条（第2項を除く。）"}),
        "item_range": ("第3条第1号から第4号まで", {"第3条第1号から第4号まで"}), "appendix": ("別表第二", {"別表第二"}), "the_said": ("当該事業者", {"当該事業者"}), "mutatis_included": ("第3条（第4条において準用する場合を含む。）", {"第3条", "第4条において準用"}),
        "regulation": ("総務省令第三号", {"総務省令第三号"}), "article_or": ("第1条又は第2条", {"第1条", "第2条"}), "alternative": ("第1条第2項又は第3条", {"第1条第2項", "第3条"}), "same_article_paragraph": ("同条第2項", {"同条第2項"}),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "doc_id string, text string")
    got = spans.extract(docs).where("doc_id = rule").groupBy("doc_id").agg(F.collect_set("text").alias("t")).collect()
    assert {r["doc_id"]: set(r["t"]) for r in got} == {k: s for k, (_, s) in cases.items()}


def test_offsets_are_code_points(spark):
    docs = spark.createDataFrame([(1, "😀第12条")], "doc_id int, text string")
    r = spans.extract(docs).where("rule = 'article'").first()
    assert (r["start"], r["end"], r["text"]) == (1, 5, "第12条")


def test_definitions(spark):
    docs = spark.createDataFrame([(1, "個人情報（以下「情報」という。）と個票（以下「情報」という。）")], "doc_id int, text string")
    assert [(r["term"], r["stands_for"]) for r in spans.definitions(docs).collect()] == [("情報", "個人情報")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "T", 0.9) for a, b in pairs], "src long, dst long, rel_type string, confidence double")


def test_paths_use_no_edge_twice(spark):
    pairs = [(1, 2), (2, 1), (2, 3), (3, 1), (1, 1)]
    found = graph.paths(edges_of(spark, pairs), spark.createDataFrame([(1,)], "node long"), 4)

    def walk(node, used):
        for e in pairs:
            if e[0] == node and e not in used:
                yield e[1], len(used) + 1
                if len(used) < 3:
                    yield from walk(e[1], [*used, e])

    assert values(found.select("node", "length"), "node", "length") == sorted(walk(1, []))


def test_impact_levels_first_visit(spark):
    e = spark.createDataFrame([(2, 1, "APPLIES", 0.9), (3, 1, "X", 0.8), (4, 2, "X", 1.0), (4, 3, "X", 0.9), (1, 4, "X", 0.9), (5, 1, "X", 0.1)], "src long, dst long, rel_type string, confidence double")
    got = {r["node"]: (r["depth"], r["confidence"], r["path"]) for r in graph.impact_by_levels(e, spark.createDataFrame([(1,)], "node long")).collect()}
    assert got == {2: (1, 0.9, [1, 2]), 3: (1, 0.8, [1, 3]), 4: (2, 0.9, [1, 2, 4]), 1: (3, 0.729, [1, 2, 4, 1])}


def test_graph_against_sets(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(90)}
    e = edges_of(spark, pairs)
    plain = {p for p in pairs if p[0] != p[1]}
    assert values(graph.mutual_pairs(e), "a", "b") == sorted((a, b) for a, b in plain if a < b and (b, a) in plain)
    assert values(graph.triangles(e), "a", "b", "c") == sorted((a, b, c) for a, b in plain for x, c in plain if x == b and (c, a) in plain and a < b and a < c)
    parent = {n: n for p in pairs for n in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    assert dict(values(graph.connected(e), "node")) == {n: top(n) for n in parent}


def test_tables(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "k int, v string")
    assert values(tables.insert_if_absent(t, new, ["k"]), "k") == [(1, "a"), (2, "b"), (3, "y")]
    assert values(tables.upsert(t, new, ["k"]), "k") == [(1, "a"), (2, "x"), (3, "y")]
    assert values(tables.replace_part(t, new, "k"), "k", "v") == [(1, "a"), (2, "x"), (3, "y"), (3, "z")]
    assert values(tables.last_wins(new, "k", "v"), "k") == [(2, "x"), (3, "z")]


def test_write_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_parts(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), path, "k")
    tables.write_parts(spark.createDataFrame([(2, "c")], "k int, v string"), path, "k")
    assert values(spark.read.parquet(path).select("k", "v"), "k") == [(1, "a"), (2, "c")]


def test_evaluation(spark):
    found = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "doc_id int, text string")
    wanted = spark.createDataFrame([(1, "a"), (2, "c")], "doc_id int, text string")
    r = evaluation.scores(evaluation.text_overlap(found, wanted)).first()
    assert (r["matched"], r["missed"], r["extra"], round(r["precision"], 3), r["recall"]) == (1, 1, 1, 0.333, 0.5)


def test_dictionary(spark):
    laws = spark.createDataFrame([("A", "労働に関する法律", None, 1), ("B", "労働に関する法律", None, 2), ("C", "民法", "明治二十九年法律第八十九号", 3)], "law_id string, title string, law_number string, position int")
    made = build(laws)
    got = dict(values(resolve_names(spark.createDataFrame([("労働に関する法律",), ("労働法",), ("明治二十九年法律第八十九号",), ("平成17年法律第86号",), ("無",)], "name string"), made).select("name", "law_id"), "name"))
    assert got == {"労働に関する法律": "B", "労働法": "A", "明治二十九年法律第八十九号": "C", "平成17年法律第86号": "417AC0000000086", "無": None}
    refs = spark.createDataFrame([("A", 5), ("A", 50), ("Z", 999), ("Z", 1001)], "law_id string, article int")
    bounds = spark.createDataFrame([("A", 10)], "law_id string, last_article int")
    assert values(within_bounds(refs, bounds), "law_id", "article") == [("A", 5), ("Z", 999)]
