"""Resolution of relative references (previous article, next paragraph, same item) as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.japanese import article_number

#: The numerals the resolver knows, up to twenty-five; others count as one.
NUMERALS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十", "二十一", "二十二", "二十三", "二十四", "二十五")
_RESULT = "struct<article_number:string,paragraph_number:bigint,item_number:string,confidence:double,method:string>"


def numeral(text: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(NUMERALS, 1) for x in (k, i)]), text), F.lit(1))


def resolve(text: str | Column, article: str | Column, paragraph: str | Column, item: str | Column) -> Column:
    """Struct article_number, paragraph_number, item_number, confidence, method; null where nothing can be resolved.

    ``article`` is an article number as text, ``paragraph`` a number (null counts as 1), ``item`` a number as text or null.
    """
    text, item = (F.col(x) if isinstance(x, str) else x for x in (text, item))
    art = (F.col(article) if isinstance(article, str) else article).cast("long")
    given = (F.col(paragraph) if isinstance(paragraph, str) else paragraph).cast("long")
    para, now = F.coalesce(given, F.lit(1).cast("long")), article_number(item)["value"]
    k = lambda p: numeral(F.regexp_extract(text, p, 1)).cast("long")
    n, none = "([一二三四五六七八九十]+)", F.lit(None)

    def out(a, p, i, confidence, method="exact"):
        return F.struct(a.cast("string").alias("article_number"), p.cast("bigint").alias("paragraph_number"), i.cast("string").alias("item_number"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")).cast(_RESULT)

    has_item, empty = item.isNotNull() & (item != ""), F.lit(None).cast(_RESULT)
    rules = [
        ((text == "前条") & (art <= 1), out(art, none, none, 0.3, "fallback")),
        (text == "前条", out(art - 1, none, none, 0.95)),
        (text == "次条", out(art + 1, none, none, 0.95)),
        (text.rlike(f"^前{n}条$"), out(F.greatest(F.lit(1), art - k(f"^前{n}条$")), none, none, 0.9)),
        (text.rlike(f"^次{n}条$"), out(art + k(f"^次{n}条$"), none, none, 0.9)),
        ((text == "前項") & (para <= 1), out(art, F.lit(1), none, 0.4, "fallback")),
        (text == "前項", out(art, para - 1, none, 0.95)),
        (text == "次項", out(art, para + 1, none, 0.95)),
        (text.rlike(f"^前{n}項$"), out(art, F.greatest(F.lit(1), para - k(f"^前{n}項$")), none, 0.9)),
        (text.rlike(f"^次{n}項$"), out(art, para + k(f"^次{n}項$"), none, 0.9)),
        (text == "前各項", out(art, para - 1, none, 0.85, "inferred")),
        ((text == "前号") & has_item & (now <= 1), out(art, given, now, 0.3, "fallback")),
        ((text == "前号") & has_item, out(art, given, now - 1, 0.95)),
        ((text == "次号") & has_item, out(art, given, now + 1, 0.95)),
        ((text == "前各号") & has_item, out(art, given, now, 0.85, "inferred")),
        (text.rlike(f"^前条第{n}項$") & (art <= 1), empty),
        (text.rlike(f"^前条第{n}項$"), out(art - 1, k(f"^前条第{n}項$"), none, 0.9)),
        (text.rlike(f"^次条第{n}項$"), out(art + 1, k(f"^次条第{n}項$"), none, 0.9)),
        (text.rlike(f"^前項第{n}号$") & (para <= 1), empty),
        (text.rlike(f"^前項第{n}号$"), out(art, para - 1, k(f"^前項第{n}号$"), 0.9)),
        (text.isin("同条", "本条"), out(art, none, none, 0.95)),
        (text.isin("同項", "本項"), out(art, para, none, 0.95)),
        (text == "各項", out(art, none, none, 0.85, "inferred")),
        (text == "各号", out(art, given, none, 0.85, "inferred")),
    ]
    first, rest = rules[0], rules[1:]
    return reduce(lambda acc, r: acc.when(*r), rest, F.when(*first)).otherwise(empty)


def resolve_in_turn(rows: DataFrame, key: str = "doc_id", least: float = 0.7) -> DataFrame:
    """Resolve each key's references in position order, the context moving on with every result above ``least``.

    Input columns: the key, position, text, article, paragraph (where the key's text starts). The fold runs in the JVM
    over the key's sorted references; a null text or article resolves to null and leaves the context.
    """
    state = "struct<article:string,paragraph:bigint,out:array<struct<position:bigint,text:string,article_number:string,paragraph_number:bigint,confidence:double>>>"
    grouped = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("position").cast("bigint").alias("position"), "text"))).alias("refs"), F.min("article").alias("article"), F.min("paragraph").cast("bigint").alias("paragraph"))
    start = F.struct(F.col("article").cast("string"), F.col("paragraph"), F.array().alias("out")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        got = resolve(x["text"], acc["article"], acc["paragraph"], F.lit(None).cast("string"))
        sure = F.coalesce(got["confidence"] > least, F.lit(False))
        item = F.struct(x["position"].alias("position"), x["text"].alias("text"), got["article_number"].alias("article_number"), got["paragraph_number"].alias("paragraph_number"), got["confidence"].alias("confidence"))
        return F.struct(
            F.when(sure, got["article_number"]).otherwise(acc["article"]).alias("article"),
            F.when(sure & got["paragraph_number"].isNotNull(), got["paragraph_number"]).otherwise(acc["paragraph"]).alias("paragraph"),
            F.concat(acc["out"], F.array(item)).alias("out"),
        ).cast(state)

    return grouped.select(key, F.explode(F.aggregate("refs", start, step, lambda a: a["out"])).alias("r")).select(key, "r.*")
