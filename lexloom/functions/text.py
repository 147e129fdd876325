"""Escapes for texts that go into HTML or into a pattern."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters and what stands for them in HTML, the ampersand first.
HTML = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_escaped(text: str | Column) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), HTML, F.col(text) if isinstance(text, str) else text)


def pattern_escaped(text: str | Column) -> Column:
    """The text with a backslash before every character that means something in a regular expression."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"([.*+?^${}()|\[\]\\])", r"\\$1")
