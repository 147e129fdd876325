"""Statute XML, law lists and run files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.functions.japanese import era_year, kanji_to_int

_TEXT = "string"
#: What is read of a statute's XML; a Sentence is text or an element with attributes.
_SENTENCES = "struct<Sentence:array<string>>"
_SUB2 = f"array<struct<_Num:string,Subitem2Title:string,Subitem2Sentence:{_SENTENCES}>>"
_SUB1 = f"array<struct<_Num:string,Subitem1Title:string,Subitem1Sentence:{_SENTENCES},Subitem2:{_SUB2}>>"
_ITEMS = f"array<struct<_Num:string,ItemTitle:string,ItemSentence:{_SENTENCES},Subitem1:{_SUB1}>>"
_PARAGRAPHS = f"array<struct<_Num:string,ParagraphNum:string,ParagraphSentence:{_SENTENCES},Item:{_ITEMS}>>"
_ARTICLES = f"array<struct<_Num:string,_Delete:string,ArticleTitle:string,ArticleCaption:string,Paragraph:{_PARAGRAPHS}>>"
_SECTIONS = f"array<struct<_Num:string,SectionTitle:string,Article:{_ARTICLES}>>"
_CHAPTERS = f"array<struct<_Num:string,ChapterTitle:string,Section:{_SECTIONS},Article:{_ARTICLES}>>"
_PARTS = f"array<struct<_Num:string,PartTitle:string,Chapter:{_CHAPTERS},Article:{_ARTICLES}>>"
_MAIN = f"struct<Part:{_PARTS},Chapter:{_CHAPTERS},Section:{_SECTIONS},Article:{_ARTICLES},Paragraph:{_PARAGRAPHS}>"
_HEAD = "_Era string, _Year string, _Num string, _LawType string, _PromulgateMonth string, _PromulgateDay string, LawNum string"
#: What a law's head takes, without its provisions.
HEAD_SCHEMA = f"{_HEAD}, LawBody struct<LawTitle:string,EnactStatement:array<string>>"
LAW_SCHEMA = (
    f"{_HEAD}, LawBody struct<LawTitle:string,EnactStatement:array<string>,MainProvision:{_MAIN},SupplProvision:array<struct<Article:{_ARTICLES},Paragraph:{_PARAGRAPHS}>>>"
)


def read_laws(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Law element of the XML files, with ``law_id`` from the file's name."""
    raw = spark.read.format("xml").option("rowTag", "Law").schema(LAW_SCHEMA).load(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.xml)?$", 1)
    return raw.withColumn("law_id", F.url_decode(name))


def law_page(spark: SparkSession, path: str, offset: int = 0, limit: int = 1000) -> DataFrame:
    """A page of a directory of laws in id order (a paging feature)."""
    return law_heads(read_laws(spark, path)).orderBy("law_id").offset(offset).limit(limit)


def law_heads(laws: DataFrame) -> DataFrame:
    """Id, title, number, type and promulgation date; the era's year becomes the Gregorian one."""
    era = F.coalesce(*[F.when(F.col("_Era") == k, F.lit(v)) for k, v in (("Meiji", "明治"), ("Taisho", "大正"), ("Showa", "昭和"), ("Heisei", "平成"), ("Reiwa", "令和"))])
    year = era_year(era, F.col("_Year").cast("int"))
    kind = F.coalesce("_LawType", F.lit("Act"))
    day = F.try_to_timestamp(F.concat_ws("-", year, F.coalesce("_PromulgateMonth", F.lit("1")), F.coalesce("_PromulgateDay", F.lit("1"))), F.lit("y-M-d")).cast("date")
    return laws.select("law_id", F.coalesce("LawBody.LawTitle", F.lit("不明な法令")).alias("title"), F.col("LawNum").alias("law_number"), kind.alias("law_type"), day.alias("promulgated"), F.col("LawBody.EnactStatement").alias("enact_statements"))


def _joined(sentences: Column, between: str = "\n") -> Column:
    return F.array_join(F.transform(sentences, lambda s: F.trim(s)), between)


def articles(laws: DataFrame) -> DataFrame:
    """One row for each article of the main and supplementary provisions, with its place in the hierarchy.

    An article directly under a chapter has no section, and so on; ``sort_order`` is its place in the law.
    """
    none = F.lit(None).cast("string")
    placed = f"array<struct<part:string,chapter:string,section:string,a:{_ARTICLES[6:-1]}>>"
    listed = lambda arrays: F.coalesce(arrays, F.array().cast(placed))

    def level(holder: Column, part: Column = none, chapter: Column = none, section: Column = none) -> Column:
        return listed(F.transform(holder["Article"], lambda a: F.struct(part.alias("part"), chapter.alias("chapter"), section.alias("section"), a.alias("a"))))

    def below(holder: Column, name: str, held) -> Column:
        return listed(F.flatten(F.transform(holder[name], held)))

    def sections(holder: Column, part: Column, chapter: Column) -> Column:
        return below(holder, "Section", lambda x: level(x, part, chapter, x["SectionTitle"]))

    def chapters(holder: Column, part: Column) -> Column:
        return below(holder, "Chapter", lambda c: F.concat(level(c, part, c["ChapterTitle"]), sections(c, part, c["ChapterTitle"])))

    # all levels are one array, so that a law is parsed and gone through once and needs no sort
    m, s = F.col("LawBody.MainProvision"), F.col("LawBody.SupplProvision")
    parts = below(m, "Part", lambda p: F.concat(level(p, p["PartTitle"]), chapters(p, p["PartTitle"])))
    supplements = listed(F.flatten(F.transform(s, lambda x: level(x, F.lit("附則")))))
    found = laws.select("law_id", F.posexplode(F.concat(level(m), parts, chapters(m, none), supplements)).alias("pos", "x"))
    found = found.select("law_id", (F.col("pos") + 1).alias("sort_order"), "x.*")
    text = F.array_join(F.flatten(F.transform(F.coalesce("a.Paragraph", F.array().cast(_PARAGRAPHS)), lambda p: F.coalesce(p["ParagraphSentence"]["Sentence"], F.array().cast("array<string>")))), "\n")
    deleted = (F.coalesce(F.col("a._Delete"), F.lit("")) == "true") | text.contains("削除")
    return found.select("law_id", F.col("a._Num").alias("article_number"), F.col("a.ArticleTitle").alias("article_title"), F.col("a.ArticleCaption").alias("caption"), "part", "chapter", "section", text.alias("content"), deleted.alias("is_deleted"), F.col("a.Paragraph").alias("paragraphs"), "sort_order")


def _value(e: ElementTree.Element | None) -> str | None:
    """An element's text as ``from_xml`` gives it for a string field: trimmed, markup within it as it stands."""
    if e is None:
        return None
    found = e.text or ""
    return (found if not len(e) else found + "".join(ElementTree.tostring(c, "unicode") for c in e)).strip()


def _last(e: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    """The child of a name; of several the last, as ``from_xml`` has it."""
    found = e.findall(name) if e is not None else ()
    return found[-1] if found else None


def _fields(e: ElementTree.Element, kind: T.DataType) -> object:
    """An element as a value of the schema's type: attributes begin with _, arrays hold all children of the name."""
    if not isinstance(kind, T.StructType):
        return _value(e)
    out = {}
    for f in kind.fields:
        if f.name[0] == "_":
            out[f.name] = e.get(f.name[1:])
        elif isinstance(f.dataType, T.ArrayType):
            out[f.name] = [_fields(c, f.dataType.elementType) for c in e.iterfind(f.name)] or None
        elif (c := _last(e, f.name)) is not None:
            out[f.name] = _fields(c, f.dataType)
    return out


def _placed(law: ElementTree.Element) -> Iterator[tuple]:
    """(part, chapter, section, article) in the order of ``articles``."""
    body = _last(law, "LawBody")
    main = _last(body, "MainProvision")
    title = lambda e, name: _value(_last(e, name))

    def chapters(holder, part):
        for c in holder.iterfind("Chapter"):
            chapter = title(c, "ChapterTitle")
            yield from ((part, chapter, None, a) for a in c.iterfind("Article"))
            for x in c.iterfind("Section"):
                yield from ((part, chapter, title(x, "SectionTitle"), a) for a in x.iterfind("Article"))

    if main is not None:
        yield from ((None, None, None, a) for a in main.iterfind("Article"))
        for p in main.iterfind("Part"):
            part = title(p, "PartTitle")
            yield from ((part, None, None, a) for a in p.iterfind("Article"))
            yield from chapters(p, part)
        yield from chapters(main, None)
    for s in body.iterfind("SupplProvision") if body is not None else ():
        yield from (("附則", None, None, a) for a in s.iterfind("Article"))


def articles_of(xml: DataFrame, column: str = "xml", paragraphs: bool = True) -> DataFrame:
    """``articles(parse_laws(xml))``, read by a parser in C, in a tenth of the time of ``from_xml``.

    Without ``paragraphs`` that column is left out. Texts that are no XML have no articles, as there.
    """
    inner = T._parse_datatype_string(_PARAGRAPHS).elementType
    kind = xml.schema["law_id"].dataType.simpleString()
    schema = f"`law_id` {kind}, article_number string, article_title string, caption string, part string, chapter string, section string, content string, is_deleted boolean, sort_order int"
    fields = T._parse_datatype_string(schema + (f", paragraphs {_PARAGRAPHS}" if paragraphs else ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(fields)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(column).to_pylist()):
                try:
                    law = ElementTree.fromstring(t) if t else None
                except ElementTree.ParseError:
                    law = None
                for n, (part, chapter, section, a) in enumerate(_placed(law) if law is not None else (), 1):
                    content = "\n".join(_value(s) for p in a.iterfind("Paragraph") if (held := _last(p, "ParagraphSentence")) is not None for s in held.iterfind("Sentence"))
                    row = (a.get("Num"), _value(_last(a, "ArticleTitle")), _value(_last(a, "ArticleCaption")), part, chapter, section, content, a.get("Delete") == "true" or "削除" in content, n)
                    rows.append((*row, [_fields(p, inner) for p in a.iterfind("Paragraph")] or None) if paragraphs else row)
                    at.append(i)
            kept = batch.column("law_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *[pa.array([r[j] for r in rows], f.type) for j, f in enumerate(list(kinds)[1:])]], schema=kinds)

    return xml.select("law_id", column).mapInArrow(run, fields)


def paragraphs(arts: DataFrame) -> DataFrame:
    """Paragraphs with their sentences joined by line; one without text and items is left out."""
    rows = arts.select("law_id", "article_number", "sort_order", F.posexplode("paragraphs").alias("_n", "p"))
    content = F.coalesce(_joined(F.col("p.ParagraphSentence.Sentence")), F.lit(""))
    return rows.select("law_id", "article_number", "sort_order", (F.col("_n") + 1).alias("paragraph_number"), content.alias("content"), F.col("p.Item").alias("items")).where("content != '' or size(items) > 0")


def items(paras: DataFrame) -> DataFrame:
    """Items, sub-items and sub-sub-items: one row each, with its level and the titles above it."""
    base = ["law_id", "article_number", "paragraph_number"]
    listed = lambda c: F.coalesce(c, F.array().cast("array<struct<level:int,titles:array<string>,content:string>>"))

    def row(level: int, titles: list[Column], sentences: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), F.array(*titles).alias("titles"), F.coalesce(_joined(sentences["Sentence"]), F.lit("")).alias("content"))

    def sub(i: Column, s: Column) -> Column:
        titles = [i["ItemTitle"], s["Subitem1Title"]]
        return F.concat(F.array(row(2, titles, s["Subitem1Sentence"])), listed(F.transform(s["Subitem2"], lambda x: row(3, [*titles, x["Subitem2Title"]], x["Subitem2Sentence"]))))

    # the levels of an item are one array, so that the paragraphs are gone through once
    i = F.col("i")
    levels = F.concat(F.array(row(1, [i["ItemTitle"]], i["ItemSentence"])), listed(F.flatten(F.transform(i["Subitem1"], lambda s: sub(i, s)))))
    return paras.select(*base, F.explode("items").alias("i")).select(*base, F.inline(levels))


def _tagged_texts(text: str, tags: tuple[str, ...]) -> list[tuple[str, str]]:
    """(tag, text) of the text nodes right below the tags, in one pass; child tags and comments part nodes, as in ``xpath``.

    CDATA and the text beside it are one node (``xpath`` keeps only the first piece of such a node).
    """
    above, held, out = [""], [], []
    parser = expat.ParserCreate()

    def end_node(*_: object) -> None:
        if held:
            if above[-1] in tags:
                out.append((above[-1], "".join(held)))
            held.clear()

    def start(name: str, _: dict) -> None:
        end_node()
        above.append(name)

    def end(_: str) -> None:
        end_node()
        above.pop()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, held.append
    parser.CommentHandler = parser.ProcessingInstructionHandler = end_node
    parser.Parse(text, True)
    return out


def embedded_references(xml: DataFrame, column: str = "xml") -> DataFrame:
    """(law_id, tag, text) of reference tags at any depth of an XML text column."""
    tags = ("LawRef", "ArticleRef", "ParagraphRef", "ItemRef", "ReferenceToLaw", "ReferenceToArticle", "Ref")
    kind = xml.schema["law_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(column).to_pylist()):
                found = _tagged_texts(t, tags) if t else []
                rows += found
                at += [i] * len(found)
            kept = batch.column("law_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *[pa.array([r[j] for r in rows], pa.string()) for j in range(2)]], names=["law_id", "tag", "text"])

    return xml.select("law_id", column).mapInArrow(run, f"law_id {kind}, tag string, text string")


def stripped(xml: str | Column) -> Column:
    """Text without tags: each becomes a blank, blanks are joined."""
    c = F.col(xml) if isinstance(xml, str) else xml
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"[\s　]+", " "))


#: Places of the law list's columns, by position.
LIST_COLUMNS = {"law_type": 0, "law_number": 1, "title": 2, "reading": 3, "old_title": 4, "promulgated": 5, "enforced": 9, "law_id": 11, "url": 12}


def law_list(spark: SparkSession, path: str) -> DataFrame:
    """The law list CSV by position; rows without id or title are left out. Quoted fields may hold commas."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(14)])
    raw = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"', multiLine=True, enforceSchema=True)
    return raw.select(*[F.col(f"c{i}").alias(n) for n, i in LIST_COLUMNS.items()]).where("coalesce(law_id, '') != '' and coalesce(title, '') != ''")


def page_of_files(spark: SparkSession, folder: str, offset: int = 0, limit: int = 1000) -> DataFrame:
    """(path, xml, has_more, next_offset): a page of a folder's files in the order of their paths, each file's text in a row.

    Files are listed by Spark's own reader, which opens none of them, so any store that it reaches will do; only the page's
    files, at most ``limit``, are read. An offset beyond the last file gives no rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    page = [r.path for r in listed.orderBy("path").offset(offset).limit(limit + 1).collect()]
    more = len(page) > limit
    if not page:
        return spark.createDataFrame([], "path string, xml string, has_more boolean, next_offset int")
    read = spark.read.option("wholetext", True).text(page[:limit]).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))
    return read.select("path", "xml", F.lit(more).alias("has_more"), F.lit(offset + limit if more else None).cast("int").alias("next_offset"))


#: Header names of a law list's id and title, and those used in their place.
NAMED_COLUMNS = {"law_id": ("法令ID", "law_id"), "title": ("法令名", "law_title")}


def law_list_named(spark: SparkSession, path: str) -> DataFrame:
    """(law_id, title, short) of a law list with a header; an empty field falls back to the other name's column.

    ``short`` is the title without bracketed parts, null where it has none. Rows without id or title are left out.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    first = lambda names: F.coalesce(*[F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    rows = raw.select(*[first(names).alias(c) for c, names in NAMED_COLUMNS.items()]).where("law_id is not null and title is not null")
    short = F.trim(F.regexp_replace("title", "（.+）", ""))
    return rows.withColumn("short", F.when(short != F.col("title"), short))


def latest_file(files: DataFrame, law_id: str = "law_id", name: str = "name") -> DataFrame:
    """The greatest file name of each law: its newest version."""
    return files.groupBy(law_id).agg(F.max(name).alias(name))


def batch_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Result files of numbered batches, with the batch's number."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"batch_(\d+)", 1).cast("int"))


def fetch_since(*_: object) -> DataFrame:
    raise NotImplementedError("the XML source has no incremental fetch")


def item_value(title: str) -> Column:
    return kanji_to_int(title)


def parse_laws(df: DataFrame, column: str = "xml", schema: str = LAW_SCHEMA) -> DataFrame:
    """Rows as ``read_laws`` gives them from an XML text column and ``law_id``; ``HEAD_SCHEMA`` is enough for ``law_heads``."""
    return df.select("law_id", F.from_xml(column, schema).alias("x")).select("x.*", "law_id")


def hybrid_source(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with what the edge table knows of them: mentions made and received."""
    made = edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("made"))
    received = edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("received"))
    return rows.join(made, "node_id", "left").join(received, "node_id", "left").fillna(0, ["made", "received"])
