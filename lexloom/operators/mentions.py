"""Mentions that one fixed pattern can't find: names of a dictionary, terms a document defines, lists of any length."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexloom.operators.conflicts import containment_maximal

_NUMBER = "(?:[0-9]+|[一二三四五六七八九十百千]+)"
#: A member of a list: a law, article, paragraph and item, of which the first ones may be left out.
UNIT = re.compile(
    f"(?:(?P<law>(?:(?!第{_NUMBER}[条項号])[^、。\\s（）「」『』]){{0,150}}法(?:律)?))?第(?P<article>{_NUMBER})条(?P<branch>(?:の{_NUMBER})*)(?:第(?P<paragraph>{_NUMBER})項)?(?:第(?P<item>{_NUMBER})号)?"
    f"|第(?P<paragraph2>{_NUMBER})項(?:第(?P<item2>{_NUMBER})号)?|第(?P<item3>{_NUMBER})号",
    re.A,
)
#: What stands between two members, and the words of a range.
BETWEEN, FROM, TO = re.compile("、?(?:及び|並びに|又は|若しくは)|、"), "から", "まで"
MEMBER = "list int, member int, members int, start int, end int, text string, law_name string, law_end int, own_law boolean, article string, own_article boolean, paragraph int, item int, to_article string, to_paragraph int, to_item int, context string"


def find_names(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", names_a_shard: int = 100_000) -> DataFrame:
    """(key, start, end, name): the occurrences of dictionary names that lie within no longer one's.

    ``dictionary``: name. Up to ``names_a_shard`` names are a broadcast from which tasks build one automaton. Of more names, tasks
    only know the different shapes (first and last character, length); what has the shape of a name is joined with the
    names, so that a text is passed over once however many there are. Offsets are code points, end exclusive. Null texts
    have none; rows that share a key must share the text.
    """
    names = dictionary.select("name").where("name != ''").distinct()
    found, exact = name_places(docs, names, key, text, names_a_shard)
    if exact:
        return found
    # what has the shape of a name may be none, so names are told apart before longer ones swallow shorter ones
    return containment_maximal(found.join(names, "name").select(key, "start", "end", "name").withColumn("seq", F.lit(0)), key).drop("seq")


def name_places(docs: DataFrame, names: DataFrame, key: str, text: str = "text", names_a_shard: int = 100_000) -> tuple[DataFrame, bool]:
    """(key, start, end, name) by one pass over the texts, and whether these are the names of ``find_names``.

    Otherwise they are all that has the shape of a name: what is no name is still among them, and what lies within a longer
    name. ``names``: the different names.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()
    few = names.count() <= names_a_shard
    if few:
        held = spark.sparkContext.broadcast([r.name for r in names.toLocalIterator()])
    else:
        shapes: dict[str, dict[int, set[str]]] = {}
        for r in names.select(F.substring("name", 1, 1).alias("first"), F.substring("name", -1, 1).alias("last"), F.length("name").alias("n")).distinct().toLocalIterator():
            shapes.setdefault(r["last"], {}).setdefault(r["n"], set()).add(r["first"])
        held = spark.sparkContext.broadcast(shapes)

    def by_automaton() -> Callable[[str], Iterator[tuple[int, int, str]]]:
        import ahocorasick

        trie = ahocorasick.Automaton()
        for name in held.value:
            trie.add_word(name, name)
        trie.make_automaton()

        def found(t: str) -> Iterator[tuple[int, int, str]]:
            reach = -1
            for start, end, name in sorted(((end + 1 - len(name), end + 1, name) for end, name in trie.iter(t)), key=lambda s: (s[0], -s[1])) if held.value else ():
                if end > reach:
                    yield start, end, name
                    reach = end

        return found

    def by_shape() -> Callable[[str], Iterator[tuple[int, int, str]]]:
        shapes = held.value

        def found(t: str) -> Iterator[tuple[int, int, str]]:
            for end, c in enumerate(t, 1):
                for n, firsts in shapes.get(c, {}).items():
                    if n <= end and t[end - n] in firsts:
                        yield end - n, end, t[end - n : end]

        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = by_automaton() if few else by_shape()
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                found = list(find(t)) if t else []
                rows += found
                at += [i] * len(found)
            kept = batch.column(key).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *[pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int32(), pa.int32(), pa.string()))]], names=[key, "start", "end", "name"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, start int, end int, name string"), few


def defined_term_citations(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text", reach: int | None = None) -> DataFrame:
    """(key, start, end, text, term, stands_for, article, context): articles cited by a term that the text's own scope defines.

    ``terms``: key, term, stands_for, one row a term (see ``spans.definitions``); ``key`` is the scope, one document or a law of
    many rows. From each article number the text is read backwards: the longest term that ends there is cited. Rows of a
    scope come together with its terms by a join, so a scope's terms must fit a task, its texts need not.
    """
    held = terms.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "stands_for"))).alias("terms"))
    kind = docs.schema[key].dataType.simpleString()
    article = re.compile("第[0-9]+条", re.A)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, (t, pairs) in enumerate(zip(batch.column(text).to_pylist(), batch.column("terms").to_pylist())):
                known = dict(pairs)
                lengths = sorted({len(k) for k in known}, reverse=True)
                for m in article.finditer(t or ""):
                    term = next((t[m.start() - n : m.start()] for n in lengths if n <= m.start() and t[m.start() - n : m.start()] in known), None)
                    if term:
                        rows.append((m.start() - len(term), m.end(), term + m[0], term, known[term], m[0], _around(t, m.start() - len(term), m.end(), reach)))
                        at.append(i)
            kept = batch.column(key).take(pa.array(at, pa.int64()))
            kinds = (pa.int32(), pa.int32(), *[pa.string()] * 5)
            yield pa.RecordBatch.from_arrays([kept, *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]], names=[key, "start", "end", "text", "term", "stands_for", "article", "context"])

    return docs.select(key, text).join(held, key).mapInArrow(run, f"`{key}` {kind}, start int, end int, text string, term string, stands_for string, article string, context string")


def value_of(numeral: str | None) -> int | None:
    """An ASCII or kanji number below ten thousand as an int."""
    if not numeral:
        return None
    if numeral.isdigit() and numeral.isascii():
        return int(numeral)
    total, digit = 0, 0
    for c in numeral:
        if c in "十百千":
            total, digit = total + (digit or 1) * 10 ** ("十百千".index(c) + 1), 0
        else:
            digit = "一二三四五六七八九".index(c) + 1
    return total + digit


def _around(text: str, start: int, end: int, reach: int | None) -> str | None:
    return None if reach is None else text[max(0, start - reach) : end + reach]


def _levels(m: re.Match) -> tuple[str | None, int | None, int | None]:
    """(article with its branches, paragraph, item) of a unit."""
    branch = "".join(f"の{value_of(b)}" for b in m["branch"].split("の")[1:]) if m["branch"] else ""
    return f"{value_of(m['article'])}{branch}" if m["article"] else None, value_of(m["paragraph"] or m["paragraph2"]), value_of(m["item"] or m["item2"] or m["item3"])


def lists_in(text: str) -> Iterator[list[tuple]]:
    """Lists of two members or more, read by a small automaton: member, then a word between members or none, which ends the list.

    A member takes the law, article and paragraph it doesn't name from the member before it. A member may be a range.
    """
    at = 0
    while m := UNIT.search(text, at):
        out, law, law_end, article, paragraph = [], None, None, None, None
        while m:
            own_law, (a, p, i) = bool(m["law"]), _levels(m)
            if own_law:
                law, law_end = m["law"], m.end("law")
            own_article = a is not None
            article = a or article
            paragraph = p if own_article or p is not None else paragraph
            end, to = m.end(), (None, None, None)
            other = UNIT.match(text, end + len(FROM)) if text.startswith(FROM, end) else None
            if other and not other["law"] and text.startswith(TO, other.end()):
                to, end = _levels(other), other.end() + len(TO)
            out.append((m.start(), end, text[m.start() : end], law, law_end, own_law, article, own_article, paragraph, i, *to))
            article, paragraph = to[0] or article, (to[1] if to[0] or to[1] is not None else paragraph)
            at = end
            gap = BETWEEN.match(text, end)
            m = UNIT.match(text, gap.end()) if gap else None
        if len(out) > 1:
            yield out


def enumerations(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each member of each list of citations: key, ``list``, ``member`` (from 1), ``members``, place, and what is cited.

    ``law_name`` is the text before the list's or member's first article up to 法, which may begin with other words (its end
    is ``law_end``); law, article and paragraph are inherited along the list (``own_law``, ``own_article`` tell whether the member
    names them). ``to_...`` is the end of a range, ``context`` the text ``reach`` characters around the member. Null and empty texts have no lists; of other columns those of ``keep`` are carried.
    """
    carried = [key, *keep]
    fields = T._parse_datatype_string(", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried] + [MEMBER]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(fields)
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(text).to_pylist()):
                for n, members in enumerate(lists_in(t or ""), 1):
                    rows += [(n, j, len(members), *m, _around(t, *m[:2], reach)) for j, m in enumerate(members, 1)]
                    at += [i] * len(members)
            take = pa.array(at, pa.int64())
            kept = [batch.column(c).take(take) for c in carried]
            yield pa.RecordBatch.from_arrays([*kept, *[pa.array([r[j] for r in rows], f.type) for j, f in enumerate(list(schema)[len(kept) :])]], schema=schema)

    return docs.select(*carried, text).mapInArrow(run, fields)
