"""Segments of a text with links for its references, and spans of known abbreviations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.operators.conflicts import containment_maximal
from lexloom.operators.spans import Rule, extract


def segments(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, segments): the text in order as structs (text, is_link), spans that overlap an earlier one left out.

    A fold over each document's sorted spans; documents without spans are one segment, null texts give none.
    """
    sorted_spans = spans.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
    kind = "struct<at:int,out:array<struct<text:string,is_link:boolean>>>"
    text = F.col("text")
    piece = lambda a, b, link: F.struct(F.substring(text, a + 1, b - a).alias("text"), F.lit(link).alias("is_link"))

    def step(acc, s):
        more = F.concat(acc["out"], F.when(s["start"] > acc["at"], F.array(piece(acc["at"], s["start"], False))).otherwise(F.array().cast("array<struct<text:string,is_link:boolean>>")), F.array(piece(s["start"], s["end"], True)))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), more.alias("out")).cast(kind))

    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def done(acc):
        rest = F.length(text) - acc["at"]
        return F.when(rest > 0, F.concat(acc["out"], F.array(piece(acc["at"], F.length(text), False)))).otherwise(acc["out"])

    joined = docs.where("text is not null").select(key, "text").join(sorted_spans, key, "left")
    return joined.select(key, F.aggregate(F.coalesce("_s", F.array().cast("array<struct<start:int,end:int>>")), start, step, done).alias("segments"))


def expand_abbreviations(docs: DataFrame, names: list[tuple[str, str]], key: str = "doc_id") -> DataFrame:
    """(key, start, end, text, full): mentions of abbreviations, the longest at a place. ``names``: a bounded word list."""
    longest = sorted(names, key=lambda n: -len(n[0]))
    rule = Rule("abbreviation", "|".join(re.escape(a) for a, _ in longest), (("{0}", "", "abbreviation", 0.9, 0),))
    full = F.create_map(*[F.lit(x) for pair in longest for x in pair])
    return containment_maximal(extract(docs.select(key, "text"), (rule,)), key).select(key, "start", "end", "text", full[F.col("text")].alias("full"))
