"""Quality of detected spans against expected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def text_overlap(detected: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """By key: matched, missed and extra distinct texts, and the row counts on either side."""
    side = lambda df, n: df.groupBy(key, "text").agg(F.count("*").alias(n))
    both = side(detected, "d").join(side(expected, "e"), [key, "text"], "full_outer")
    hit = F.col("d").isNotNull() & F.col("e").isNotNull()
    return both.groupBy(key).agg(
        F.count_if(hit).alias("matched"), F.count_if(F.col("d").isNull()).alias("missed"), F.count_if(F.col("e").isNull()).alias("extra"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("detected_rows"), F.coalesce(F.sum("e"), F.lit(0)).alias("expected_rows"),
    )


def scores(overlap: DataFrame, by_rows: bool = True) -> DataFrame:
    """One row: precision, recall and F1, over row counts, or over distinct texts as matched / (matched + extra or missed)."""
    t = overlap.agg(*[F.sum(c).alias(c) for c in ("matched", "missed", "extra", "detected_rows", "expected_rows")])
    p = ratio(F.col("matched"), F.col("detected_rows") if by_rows else F.col("matched") + F.col("extra"))
    r = ratio(F.col("matched"), F.col("expected_rows") if by_rows else F.col("matched") + F.col("missed"))
    out = t.withColumns({"precision": p, "recall": r})
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6), "f1": F.round(f1(p, r), 6)})


def count_ratio(found: Column, wanted: Column) -> tuple[Column, Column]:
    """min / found and min / wanted: a ratio of counts, which says nothing about which ones match."""
    least = F.least(found, wanted)
    return ratio(least, found), ratio(least, wanted)


def mapping_accuracy(resolved: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * resolved / total).otherwise(F.lit(100.0))


def case_scores(detected: DataFrame, expected: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, precision, recall, f1, passed) of each case, over its distinct texts; a case passes if nothing is missed or extra."""
    o = text_overlap(detected, expected, key)
    p, r = ratio(F.col("matched"), F.col("matched") + F.col("extra")), ratio(F.col("matched"), F.col("matched") + F.col("missed"))
    return o.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1(p, r), 6).alias("f1"), ((p == 1) & (r == 1)).alias("passed"))
