"""Column functions for Japanese numerals, article numbers, law numbers and text positions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DIGITS = "〇一二三四五六七八九"
UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
FULL_WIDTH = "０１２３４５６７８９"
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018}
ERA_CODES = {"明治": "1", "大正": "2", "昭和": "3", "平成": "4", "令和": "5"}
KANJI = "〇零一二三四五六七八九十百千万"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it is used: the variable of a one-element transform."""
    return F.transform(F.array(value), use)[0]


def kanji_to_int(text: str | Column) -> Column:
    """Value of a kanji numeral by a fold over its characters; null if null, empty, or any other character is in it.

    A unit without a digit before it counts once (十 is 10); 万 multiplies all before it.
    """
    t = F.translate(_c(text), "零", "〇")
    digit = lambda ch: F.instr(F.lit(DIGITS), ch) - 1
    unit = lambda ch: F.coalesce(*[F.when(ch == u, F.lit(v)) for u, v in UNITS.items()])
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("digit"))

    def step(acc: Column, ch: Column) -> Column:
        u = unit(ch)
        some = F.greatest(acc["digit"], F.lit(1).cast("long"))
        whole = F.greatest(acc["part"] + acc["digit"], F.lit(1).cast("long"))
        return F.struct(
            F.when(u == 10000, acc["total"] + whole * 10000).otherwise(acc["total"]).cast("long").alias("total"),
            F.when(u == 10000, F.lit(0)).when(u.isNotNull(), acc["part"] + some * u).otherwise(acc["part"]).cast("long").alias("part"),
            F.when(u.isNotNull(), F.lit(0)).otherwise(acc["digit"] * 10 + digit(ch)).cast("long").alias("digit"),
        )

    value = F.aggregate(F.filter(F.split(t, ""), lambda ch: ch != ""), start, step, lambda a: a["total"] + a["part"] + a["digit"])
    return F.when(t.rlike(f"^[{KANJI}]+$"), value)


def int_to_kanji(n: str | Column) -> Column:
    """Kanji numeral of 1..99999999; 〇 for 0; null outside."""
    n = _c(n).cast("long")

    def below(m: Column) -> Column:
        parts = []
        for u, v in (("千", 1000), ("百", 100), ("十", 10)):
            d = F.floor(m / v) % 10
            parts.append(F.when(d == 0, "").when(d == 1, u).otherwise(F.concat(F.substring(F.lit(DIGITS), d.cast("int") + 1, F.lit(1)), F.lit(u))))
        last = m % 10
        parts.append(F.when(last == 0, "").otherwise(F.substring(F.lit(DIGITS), last.cast("int") + 1, F.lit(1))))
        return F.concat(*parts)

    high, low = F.floor(n / 10000), n % 10000
    return F.when(n == 0, "〇").when((n > 0) & (n < 100000000), F.concat(F.when(high == 0, "").when(high == 1, "一万").otherwise(F.concat(below(high), F.lit("万"))), below(low)))


def half_width_digits(text: str | Column) -> Column:
    return F.translate(_c(text), FULL_WIDTH, "0123456789")


def leading_kanji_value(text: Column) -> Column:
    """The first numeral of a text, in kanji or ASCII digits, as a number."""
    ascii_run = F.regexp_extract(text, r"([0-9]+)", 1)
    kanji_run = F.regexp_extract(text, f"([{KANJI}]+)", 1)
    first_ascii, first_kanji = F.regexp_instr(text, F.lit("[0-9]")), F.regexp_instr(text, F.lit(f"[{KANJI}]"))
    use_kanji = (first_kanji > 0) & ((first_ascii == 0) | (first_kanji < first_ascii))
    return F.when(use_kanji, kanji_to_int(kanji_run)).when(first_ascii > 0, ascii_run.cast("long"))


def article_number(text: str | Column) -> Column:
    """Struct numeric, display, original, value of an article number in any form; branches (の二) are left out.

    The number after 第 and before 条 counts first, else the first number in the text; none gives '' and 0. Null as empty.
    """

    def parts(t: Column, value: Column) -> Column:
        return F.struct(
            F.coalesce(value.cast("string"), F.lit("")).alias("numeric"),
            F.when(value.isNotNull(), F.concat(F.lit("第"), value.cast("string"), F.lit("条"))).otherwise(t).alias("display"),
            t.alias("original"),
            F.coalesce(value, F.lit(0)).cast("long").alias("value"),
        )

    def numbered(t: Column) -> Column:
        inner = F.regexp_extract(t, f"第([0-9{KANJI}]+)条", 1)
        return _once(leading_kanji_value(F.when(inner != "", inner).otherwise(t)), lambda value: parts(t, value))

    return _once(F.coalesce(_c(text), F.lit("")), numbered)


def article_range(start: str | Column, end: str | Column) -> Column:
    """Inclusive list of article numbers as strings; empty unless both ends are valid and in order."""
    a, b = article_number(start)["value"], article_number(end)["value"]
    ok = (a > 0) & (b > 0) & (a <= b)
    return F.when(ok, F.transform(F.sequence(F.when(ok, a).otherwise(F.lit(1)), F.when(ok, b).otherwise(F.lit(1))), lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))


def article_mentions(text: str | Column) -> Column:
    """Distinct arabic article numbers in a text, in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit("第([0-9]+)条"), 1))


def era_year(era: str | Column, year: str | Column) -> Column:
    e = _c(era)
    return F.coalesce(*[F.when(e == name, _c(year) + base) for name, base in ERAS.items()])


def law_number_to_id(text: str | Column) -> Column:
    """Law id of a law number such as 明治二十九年法律第八十九号: era digit, two-digit year, type code, ten-digit number."""
    t = _c(text)
    pattern = f"(明治|大正|昭和|平成|令和)(元|[0-9{KANJI}]+)年(法律|政令|勅令)第([0-9{KANJI}]+)号"
    era, kind = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 3)
    year_text = F.regexp_extract(t, pattern, 2)
    year = F.when(year_text == "元", F.lit(1)).otherwise(leading_kanji_value(year_text))
    number = leading_kanji_value(F.regexp_extract(t, pattern, 4))
    code = F.coalesce(*[F.when(era == name, F.lit(c)) for name, c in ERA_CODES.items()])
    letters = F.when(kind == "法律", "AC").when(kind == "政令", "CO").when(kind == "勅令", "IO")
    return F.concat(code, F.lpad(year.cast("string"), 2, "0"), letters, F.lpad(number.cast("string"), 10, "0"))


def law_id_parts(law_id: str | Column) -> Column:
    """Struct era_year, type_code, number of a well-formed law id; null otherwise."""
    t = _c(law_id)
    ok = t.rlike("^[0-9]{3}[A-Z]{2}[0-9]{10}$")
    return F.when(ok, F.struct(F.substring(t, 1, 3).alias("era_year"), F.substring(t, 4, 2).alias("type_code"), F.substring(t, 6, 10).alias("number")))


def law_type_of(law_id: str | Column) -> Column:
    t = _c(law_id)
    return F.when(t.contains("AC"), "法律").when(t.contains("CO"), "政令").when(t.contains("M"), "省令").when(t.contains("IO"), "勅令").otherwise("その他")


def short_title(title: str | Column) -> Column:
    """A title's usual short form by its ending."""
    t = F.regexp_replace(_c(title), "に関する法律$", "法")
    return F.regexp_replace(F.regexp_replace(t, "の一部を改正する法律$", "改正法"), "等に関する法律$", "等法")


def title_key(title: str | Column) -> Column:
    """Title for comparing: no blanks, ASCII brackets, 付則."""
    t = F.regexp_replace(_c(title), r"[\s　]+", "")
    return F.regexp_replace(F.regexp_replace(t, "（(.+)）", "($1)"), "附則", "付則")


#: Endings of long titles and what short forms put in their place.
TITLE_RULES = (
    ("(.+)に関する法律$", "$1法"), ("(.+)のための法律$", "$1法"), ("(.+)に関する特別措置法$", "$1特措法"), ("(.+)の特例に関する法律$", "$1特例法"),
    ("(.+)等に関する法律$", "$1等法"), ("(.+?)及び.+に関する法律$", "$1法"), ("(.+?)並びに.+に関する法律$", "$1法"),
)


def title_abbreviations(title: str | Column) -> Column:
    """Distinct shorter forms of a title by the ending rules, in rule order."""
    t = _c(title)
    forms = [F.when(t.rlike(p), F.regexp_replace(t, p, r)) for p, r in TITLE_RULES]
    return F.array_distinct(F.filter(F.array(*forms), lambda f: f.isNotNull() & (F.length(f) < F.length(t))))


def item_order(item: str | Column) -> Column:
    """Sort key of an item number in kanji; の-branches count hundredths; 999 for what is no numeral up to fifty."""
    t = _c(item)
    main, sub = F.regexp_extract(t, "^(.+)の(.+)$", 1), F.regexp_extract(t, "^(.+)の(.+)$", 2)
    known = lambda x: F.coalesce(F.when(kanji_to_int(x).between(1, 50), kanji_to_int(x)), F.lit(999)).cast("double")
    return F.when(main != "", known(main) + known(sub) * 0.01).otherwise(known(t))


def article_order(number: str | Column) -> list[Column]:
    """Sort columns: arabic numbers by value, then kanji by value, then other text."""
    t = _c(number)
    arabic = F.regexp_extract(t, r"^\s*([0-9]+)", 1)
    key = F.when(arabic != "", arabic.cast("double")).otherwise(item_order(t))
    return [key, t]


def context_around(text: str | Column, start: str | Column, end: str | Column, reach: int) -> Column:
    """The text from ``reach`` characters before start to ``reach`` after end (0-based, end exclusive)."""
    low = F.greatest(_c(start) - reach, F.lit(0))
    return F.substring(_c(text), low + 1, _c(end) + reach - low)


def line_of(text: str | Column, start: str | Column) -> Column:
    before = F.substring(_c(text), F.lit(1), _c(start))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: str | Column, start: str | Column) -> Column:
    """0-based column within the line."""
    before = F.substring(_c(text), F.lit(1), _c(start))
    return F.length(F.substring_index(before, "\n", -1))


def sentences(text: str | Column) -> Column:
    """Sentences by 。, which each keeps; blank ones dropped."""
    return F.transform(F.filter(F.split(_c(text), "。"), lambda s: F.trim(s) != ""), lambda s: F.concat(F.trim(s), F.lit("。")))


def cache_key(text: str | Column, context: str | Column) -> Column:
    """Trimmed lower-case text and context; hashed when longer than a hundred characters."""
    key = F.concat_ws(":", F.lower(F.trim(_c(text))), _c(context))
    return F.when(F.length(key) > 100, F.sha2(key, 256)).otherwise(key)


def confidence_band(confidence: str | Column) -> Column:
    c = _c(confidence)
    return F.when(c >= 0.9, "high").when(c >= 0.7, "medium").when(c.isNotNull(), "low")


def japanese_date(day: str | Column) -> Column:
    d = _c(day)
    return F.concat(F.year(d), F.lit("年"), F.month(d), F.lit("月"), F.dayofmonth(d), F.lit("日"))


def link_target(law_id: str | Column, article: str | Column, current_law: str | Column) -> Column:
    """Anchor within the current law, else the other law's address with the article as its anchor."""
    anchor = F.when(_c(article).isNotNull(), F.concat(F.lit("#article-"), _c(article))).otherwise("")
    return F.when(_c(law_id).isNull() | (_c(law_id) == _c(current_law)), F.when(anchor != "", anchor)).otherwise(F.concat(F.lit("/laws/"), _c(law_id), anchor))
