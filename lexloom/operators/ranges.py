"""Article numbers with branches as an order, and the members of ranges among the articles that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.japanese import _once, half_width_digits, kanji_to_int

_DIGITS = "[0-9一二三四五六七八九十百千]+"


def article_rank(number: str | Column) -> Column:
    """array<int> of an article number and its branches: 第3条の2, 3の2 and 第三条の二 are [3, 2]; null for anything else.

    Arrays compare element by element, a shorter one before its own branches, which is the order of articles in a statute.
    """
    plain = F.regexp_replace(half_width_digits(number), "[第条]", "")
    value = lambda p: F.coalesce(p.try_cast("int"), kanji_to_int(p).cast("int"))
    good = half_width_digits(number).rlike(f"^第?{_DIGITS}条?(?:の{_DIGITS})*$")
    return F.when(good, _once(plain, lambda p: F.transform(F.split(p, "の"), value)))


def range_members(ranges: DataFrame, articles: DataFrame, on: str = "version_id", bin_size: int = 16) -> DataFrame:
    """``ranges`` with a row for each article of the same ``on`` from ``first`` to ``last``, as ``member``; others have none.

    ``ranges``: on, first, last (article numbers in any form); ``articles``: on, article_number. Both are binned by the whole number,
    ``bin_size`` numbers a bin, so that the join is an equi-join on version and bin, and the comparison of ranks runs within a
    bin. A range is sent to as many bins as it spans. Ends that are no numbers, or in the wrong order, give no rows.
    """
    bins = lambda rank: (rank[0] / bin_size).cast("int")
    r = ranges.withColumns({"_a": article_rank("first"), "_b": article_rank("last")}).where(F.col("_a") <= F.col("_b"))
    r = r.withColumn("_bin", F.explode(F.sequence(bins(F.col("_a")), bins(F.col("_b")))))
    a = articles.select(on, F.col("article_number").alias("member"), article_rank("article_number").alias("_rank")).where("_rank is not null").withColumn("_bin", bins(F.col("_rank")))
    found = r.join(a, [on, "_bin"]).where((F.col("_a") <= F.col("_rank")) & (F.col("_rank") <= F.col("_b")))
    return found.drop("_a", "_b", "_rank", "_bin")
