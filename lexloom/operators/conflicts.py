"""Strategies for settling spans that overlap or repeat. Spans have a document key, start, end (exclusive) and seq."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containment_maximal(spans: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """Spans that lie in no other span of their key; of equal spans the one of least seq. One sort by document, no self-join."""
    w = Window.partitionBy(key).orderBy("start", F.desc("end"), "seq").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_reach", F.max("end").over(w)).where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")


def first_by(spans: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``: first mention per text, per position and law, and the like."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return spans.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def strongest_by(spans: DataFrame, keys: list[str], value: str = "confidence") -> DataFrame:
    """The row of greatest value of each key, ties by seq; aggregates map-side, so hot keys don't matter."""
    cols = [c for c in spans.columns if c not in keys]
    best = F.max_by(F.struct(*cols), F.struct(F.col(value), -F.col("seq"))).alias("_row")
    return spans.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in cols]).select(*spans.columns)


def by_priority(spans: DataFrame, key: str = "doc_id", weak: int = 5) -> DataFrame:
    """Internal spans of priority 0 to ``weak`` go if a span of higher priority covers them; then one per (start, end, target).

    Columns: priority (a whole number), type, target, is_range_member besides the span's. Range members always stay. One sort
    by document: what precedes a span by (start, longest, highest priority) covers it if it reaches the span's end, so a
    running maximum of the end for each weak priority, over spans of higher priority, tells all.
    """
    before = Window.partitionBy(key).orderBy("start", F.desc("end"), F.desc("priority"), "seq").rowsBetween(Window.unboundedPreceding, -1)
    reach = {f"_reach{p}": F.max(F.when(F.col("priority") > p, F.col("end"))).over(before) for p in range(weak + 1)}
    own = F.lit(None).cast(spans.schema["end"].dataType)
    for p in range(weak + 1):
        own = F.when(F.col("priority") == p, F.col(f"_reach{p}")).otherwise(own)
    covered = (F.col("type") == "internal") & (F.col("priority") <= weak) & ~F.col("is_range_member") & F.coalesce(own >= F.col("end"), F.lit(False))
    kept = spans.withColumns(reach).where(~covered).select(*spans.columns)
    return first_by(kept, [key, "start", "end", "target"], [F.desc("priority"), "seq"])


def greedy_longest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans are taken in seq order; one that overlaps a kept span replaces the first such if longer, else goes; texts once.

    The outcome depends on order, so each document's spans are folded in an array, in the JVM; documents without spans
    give no rows.
    """
    rest = [c for c in spans.columns if c not in (key, "seq")]
    every = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", *rest))).alias("rows"))
    overlap = "(r.start < k.`end` and k.start < r.`end`)"
    at = f"array_position(transform(kept, k -> {overlap}), true)"
    longer = "r.`end` - r.start > k.`end` - k.start"
    fold = f"aggregate(rows, slice(rows, 1, 0), (kept, r) -> case when {at} = 0 then concat(kept, array(r)) else transform(kept, (k, i) -> case when i + 1 = {at} and {longer} then r else k end) end)"
    kept = every.select(key, F.expr(fold).alias("kept"))
    # an element whose text stands earlier goes; the list of texts is made once for each document
    texts = kept.select(key, "kept", F.transform("kept", lambda k: k["text"]).alias("texts"))
    once = texts.select(key, F.expr("filter(kept, (k, i) -> array_position(texts, k.text) = i + 1)").alias("kept"))
    return once.select(key, F.inline("kept")).select(*spans.columns)


def adjusted_confidence(spans: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Confidence times 0.95 in sentences with ただし, times 0.9 with 準用."""
    proviso = F.when(F.col(sentence).contains("ただし"), 0.95).otherwise(1.0)
    mutatis = F.when(F.col(sentence).contains("準用"), 0.9).otherwise(1.0)
    return spans.withColumn("confidence", F.col("confidence") * proviso * mutatis)
