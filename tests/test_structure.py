"""Enclosing units and priorities against plain re-tellings."""

import random

from pyspark.sql import functions as F

from lexloom.operators import conflicts as cf
from lexloom.operators.structure import enclosing, headings

TEXT = "第一編　総則\n第1章　通則\n第1節　甲\n第1条　前条に従う。\n２　前項に従う。\n第2章　乙\n第二条の二　前条\n第1節　丙\n　第3条\n1 前項\n前条第4条を見る\n"


def test_headings_begin_lines_only(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (4, "見よ第1章")], "doc_id long, text string")
    got = [(r.level, r.label) for r in headings(docs).orderBy("start").collect()]
    assert got == [
        ("part", "第一編"), ("chapter", "第1章"), ("section", "第1節"), ("article", "第1条"), ("paragraph", "２"), ("chapter", "第2章"), ("article", "第二条の二"), ("section", "第1節"), ("article", "第3条"), ("paragraph", "1"),
    ]


def test_an_outer_heading_closes_inner_units(spark):
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")
    places = [(1, TEXT.index(x), i) for i, x in enumerate(("前条に", "前項に", "前条\n", "前条第4条"))]
    spans = spark.createDataFrame([*places, (2, 3, 9)], "doc_id long, start int, n int")
    got = {r.n: (r.part, r.chapter, r.section, r.article, r.paragraph) for r in enclosing(spans, headings(docs)).collect()}
    assert got == {
        0: ("第一編", "第1章", "第1節", "第1条", None),
        1: ("第一編", "第1章", "第1節", "第1条", "２"),
        2: ("第一編", "第2章", None, "第二条の二", None),
        3: ("第一編", "第2章", "第1節", "第3条", "1"),
        9: (None,) * 5,
    }


def test_priorities_equal_a_comparison_of_all_pairs(spark):
    r = random.Random(6)
    rows = []
    for doc in range(40):
        for seq in range(r.randrange(1, 14)):
            start = r.randrange(12)
            rows.append((doc, seq, start, start + r.randrange(1, 8), r.randrange(8), r.choice(("internal", "range")), r.choice("xy"), r.random() < 0.2))
    spans = spark.createDataFrame(rows, "doc_id int, seq int, start int, end int, priority int, type string, target string, is_range_member boolean")
    kept = [a for a in rows if a[7] or a[5] != "internal" or a[4] > 5 or not any(b[0] == a[0] and b[2] <= a[2] and b[3] >= a[3] and b[4] > a[4] for b in rows)]
    best = {}
    for a in kept:
        k = (a[0], a[2], a[3], a[6])
        best[k] = min(best.get(k, a), a, key=lambda x: (-x[4], x[1]))
    assert {tuple(x) for x in cf.by_priority(spans).collect()} == set(best.values())


def test_greedy_spans_equal_a_plain_fold(spark):
    r = random.Random(7)
    rows = [(doc, seq, s := r.randrange(15), s + r.randrange(1, 9), r.choice("abcde")) for doc in range(60) for seq in range(r.randrange(1, 10))]
    want = set()
    for doc in range(60):
        kept = []
        for a in (x for x in rows if x[0] == doc):
            at = next((i for i, k in enumerate(kept) if a[2] < k[3] and k[2] < a[3]), None)
            if at is None:
                kept.append(a)
            elif a[3] - a[2] > kept[at][3] - kept[at][2]:
                kept[at] = a
        seen = set()
        for k in kept:
            if k[4] not in seen:
                seen.add(k[4])
                want.add((doc, k[2], k[3], k[4]))
    spans = spark.createDataFrame(rows, "doc_id int, seq int, start int, end int, text string")
    got = cf.greedy_longest(spans).select("doc_id", "start", "end", "text")
    assert {tuple(x) for x in got.collect()} == want and F
