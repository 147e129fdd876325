"""The units that enclose a place in a text, by the headings before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.spans import Rule, extract

#: Units of a statute from the outermost to the innermost.
LEVELS = ("part", "chapter", "section", "subsection", "division", "article", "paragraph")
_NUMBER = "[0-9０-９一二三四五六七八九十百千]+"
#: How each unit's heading begins a line.
HEADINGS = tuple(
    Rule(level, f"(?m)^[\\s　]*({form})", (("{1}", "{1}", "heading", 1.0, 1),))
    for level, form in zip(LEVELS, (*(f"第{_NUMBER}{unit}(?:の{_NUMBER})*" for unit in "編章節款目条"), "[0-9０-９]+(?=[\\s　])"))
)


def headings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, level, label, start) of every heading that begins a line."""
    found = extract(docs.select(key, text), HEADINGS, text)
    return found.select(key, F.col("rule").alias("level"), F.col("text").alias("label"), "start")


def enclosing(spans: DataFrame, marks: DataFrame, key: str = "doc_id", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """``spans`` with a column for each level: the label of the unit that holds the span, null where none does.

    A heading opens its unit and closes all inner ones, so a chapter's last section doesn't reach into the next chapter. Spans
    and headings of a document are united and sorted by place once; each level is the last heading before the span, if
    it stands behind the last heading of every outer level. A heading at the very start of a span counts.
    """
    columns = [F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in spans.columns if c not in (key, "start")]
    united = spans.withColumns({"_level": F.lit(None).cast("string"), "_label": F.lit(None).cast("string"), "_is": F.lit(1)}).unionByName(
        marks.select(key, "start", *columns, F.col("level").alias("_level"), F.col("label").alias("_label"), F.lit(0).alias("_is"))
    )
    w = Window.partitionBy(key).orderBy("start", "_is").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {f"_{x}": F.last(F.when(F.col("_level") == x, F.struct("start", "_label")), ignorenulls=True).over(w) for x in levels}
    placed = united.withColumns(last).where("_is = 1")

    def open_at(i: int) -> Column:
        mine, held = F.col(f"_{levels[i]}"), F.lit(True)
        for outer in levels[:i]:
            held = held & (F.col(f"_{outer}").isNull() | (F.col(f"_{outer}.start") < mine["start"]))
        return F.when(held, mine["_label"])

    return placed.select(*spans.columns, *[open_at(i).alias(x) for i, x in enumerate(levels)])
