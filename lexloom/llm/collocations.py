"""Collocations: phrases by contiguous pattern growth, one task a prefix, and their cohesion per language.

1. Words are counted by language; words that hold a large share of all occurrences are the heavy prefixes.
2. Every occurrence of a word points to the words to its right in its piece, which is all that growth can reach. Pointers are
   gathered per prefix and slice of texts (equal ones counted) and dealt to tasks by prefix. A heavy prefix is dealt in parts,
   by a hash of what the pointers show, so that no task gets a hot word whole.
3. A task grows each prefix to the right, depth first: the pointers are projected on each next word, and a phrase that occurs
   often enough is emitted and grown again. Parts of a heavy prefix emit partial counts, which are added up.
4. Phrases are cut in two in every place, joined with the counts of both sides, scored, freed of those that a longer
   phrase explains, and ranked by language.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch

#: Texts are handled in slices of about so many bytes, and tasks of the growth are made for about so many pointers.
SLICE, POINTERS = 8_000_000, 4_000_000
#: A-Z to a-z, separators of pieces to line feeds, tabs to blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c for c in range(256))


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece of a text; null has none."""
    return [w for p in (text or "").encode().translate(_TABLE).split(b"\n") if (w := p.split())]


def by_slice(batches: Iterator[pa.RecordBatch], most: int = SLICE) -> Iterator[dict[str, list[list[bytes]]]]:
    """The pieces of each language, for consecutive texts of about ``most`` bytes."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pc.binary_length(batch.column("text")).fill_null(0), np.int64))
        cuts = np.flatnonzero(np.diff(sizes // most)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            part, out = batch.slice(lo, hi - lo), defaultdict(list)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                out[lang].extend(pieces(text))
            yield out


def rows_by_lang(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words; equal words of a slice are counted before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_slice(batches):
            for lang, cut in part.items():
                seen = Counter(chain.from_iterable(cut))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    return rows_by_lang(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def projected(cut: list[list[bytes]], most_words: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """(word, fields) of the pieces' words: what stands to the right of a word's occurrences, sorted and counted.

    Words are numbered within the slice, so that windows of ``most_words`` words are sorted as numbers.
    """
    flat = list(chain.from_iterable(cut))
    words = list(set(flat))
    number = {w: i for i, w in enumerate(words, 1)}
    codes = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # words from here to the piece's end
    columns = [np.where(left > k, np.roll(codes, -k), 0) for k in range(most_words)]
    base = len(words) + 1
    if base**most_words < 1 << 62:
        # a window as one number
        packed = columns[0]
        for c in columns[1:]:
            packed = packed * base + c
        packed, n = np.unique(packed, return_counts=True)
        rows = np.stack([packed // base ** (most_words - 1 - k) % base for k in range(most_words)], axis=1)
    else:
        rows, n = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    counts, which = np.unique(n, return_inverse=True)
    shown = [b" ", *[w + b" " for w in words], *[b"%d " % n for n in counts.tolist()]]
    fields = np.concatenate([rows[:, 1:], (which + len(words) + 1)[:, None]], axis=1).ravel()
    fields = list(map(shown.__getitem__, fields.tolist()))
    starts = np.flatnonzero(np.diff(rows[:, 0], prepend=0))
    ends = np.append(starts, len(rows))[1:]
    for word, a, b in zip((rows[starts, 0] - 1).tolist(), (starts * most_words).tolist(), (ends * most_words).tolist()):
        yield words[word], fields[a:b]


def pointers(docs: DataFrame, heavy, most_words: int) -> DataFrame:
    """(prefix, part, right): for each word of a slice, what stands to the right of its occurrences.

    ``prefix``: language and word, a line feed between them; ``part``: -1, or the part of a heavy prefix that the row belongs to.
    ``right``: for each different right side ``most_words`` - 1 words (empty ones behind the end of a piece) and how often it comes,
    with a blank behind each field. ``heavy``: broadcast of (lang, word) to a number of parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts_of = heavy.value
        for part in by_slice(batches):
            out = []
            for lang, cut in part.items():
                before = lang.encode() + b"\n"
                for word, fields in projected(cut, most_words):
                    n_parts = parts_of.get((lang, word), 1)
                    prefix = before + word
                    if n_parts == 1:
                        out.append((prefix, -1, b"".join(fields)))
                        continue
                    dealt = defaultdict(list)
                    for i in range(0, len(fields), most_words):
                        line = b"".join(fields[i : i + most_words - 1])
                        dealt[zlib.crc32(line) % n_parts].append(line + fields[i + most_words - 1])
                    out += [(prefix, p, b"".join(lines)) for p, lines in dealt.items()]
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["prefix", "part", "right"])

    return rows_by_lang(docs).mapInArrow(run, "prefix binary, part int, right binary")


def grow(phrase: bytes, columns: list[list[bytes]], counts: list[int], least: int, partial: bool) -> Iterator[tuple[bytes, int]]:
    """(phrase, count) for every extension to the right that comes ``least`` times or more, depth first.

    ``columns``: the words to the right of the occurrences, by distance; ``counts``: how often each row stands. ``partial``: the
    occurrences are a part of all, in which only phrases of full depth are whole; shorter ones come out with any count,
    to be added up.
    """
    words, rest = columns[0], columns[1:]
    total = Counter(words)
    if sum(counts) > len(counts):
        for word, n in zip(words, counts):
            if n > 1:
                total[word] += n - 1
    del total[b""]
    keep = 1 if partial and rest else least
    frequent = {w: [] for w, n in total.items() if n >= keep}
    if rest and frequent:
        for i, word in enumerate(words):
            if word in frequent:
                frequent[word].append(i)
    for word, at in frequent.items():
        longer = phrase + b" " + word
        yield longer, total[word]
        # a part in which a phrase is rare holds no longer one that is whole and frequent
        if rest and (total[word] >= least or len(rest) > 1):
            yield from grow(longer, [[c[i] for i in at] for c in rest], [counts[i] for i in at], least, partial)


def grown(dealt: DataFrame, least: int, most_words: int) -> DataFrame:
    """(lang, phrase, n) of every prefix's phrases; ``dealt`` holds each (prefix, part) in consecutive rows of a partition."""

    def emit(key: tuple, fields: list[bytes]) -> Iterator[tuple]:
        counts = [small.get(n) or int(n) for n in fields[most_words - 1 :: most_words]]
        if key[1] >= 0 or sum(counts) >= least:
            lang, _, word = key[0].rpartition(b"\n")
            for phrase, n in grow(word, [fields[k::most_words] for k in range(most_words - 1)], counts, least, key[1] >= 0):
                yield lang, phrase, n

    small = {b"%d" % n: n for n in range(1, 1000)}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [()] * 3
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.binary()).cast(pa.string()) for c in cols[:2]], pa.array(cols[2], pa.int64())], names=["lang", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fields, out = None, [], []
        for batch in batches:
            for prefix, part, right in zip(*(c.to_pylist() for c in batch.columns)):
                if (prefix, part) != key:
                    if key:
                        out.extend(emit(key, fields))
                    key, fields = (prefix, part), []
                fields.extend(right.split(b" "))
                fields.pop()  # what stands behind the last blank
                if len(out) >= 50_000:
                    yield batch_of(out)
                    out = []
        if key:
            out.extend(emit(key, fields))
        yield batch_of(out)

    return dealt.select("prefix", "part", "right").mapInArrow(run, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = 10, most_words: int = 3, pointers_a_task: int = POINTERS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, a) of all phrases of 1 to ``most_words`` words that come ``least`` times, and (lang, n) of all words."""
    spark = docs.sparkSession
    words = scratch.write(word_counts(docs), "collocation-words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // pointers_a_task))
    # at most 4 heavy words for each task: a heavy one has over a quarter of a task's share
    unit = total / (4 * tasks)
    heavy = {(r.lang, r.word.encode()): int(r.n / unit) + 1 for r in words.where(F.col("n") > unit).collect()} if total else {}
    shared = spark.sparkContext.broadcast(heavy)
    dealt = pointers(docs, shared, most_words).repartition(tasks, "prefix", "part").sortWithinPartitions("prefix", "part")
    longer = grown(dealt, least, most_words).groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    single = words.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("a"))
    every = scratch.write(longer.unionByName(single).withColumn("words", F.split("phrase", " ")), "collocation-phrases")
    return every, totals


def collocations(docs: DataFrame, least: int = 10, most_words: int = 3, top: int = 2000, explained: int = 50, pointers_a_task: int = POINTERS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``most_words`` words by cohesion.

    Words are runs without blanks and tabs of pieces between ``.,;:!?`` and line ends, A-Z in lower case; null texts have none,
    a null lang is ``und``. ``a``: occurrences of the phrase, overlaps included; ``l`` and ``r``: of the two sides of its weakest
    cut; ``n``: of all words; ``score``: 1000000 * a * a / (l * r), rounded down. Phrases within a longer one that comes
    ``explained`` per cent as often or more are left out. Repeated rows count as often as they stand, null and repeated
    ids make no difference, other columns aren't read; an empty table gives no rows. Scores are exact while a million
    times a squared has at most 38 digits (a under 10**15); beyond that the query fails. The result reads tables in the
    shared folder.
    """
    scratch, keep = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    every, totals = frequent_phrases(docs, scratch, least, most_words, pointers_a_task)
    phrases = every.where(F.size("words") > 1)
    cut = phrases.select("lang", "phrase", "a", F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice("words", 1, k), " ").alias("left"), F.array_join(F.slice("words", k + 1, F.size("words") - k), " ").alias("right")))).alias("c"))
    cut = cut.select("lang", "phrase", "a", "c.k", "c.left", "c.right")
    side = lambda phrase, n: every.select("lang", F.col("phrase").alias(phrase), F.col("a").alias(n))
    both = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    # decimals of scale 0: products of 7 + 15 + 15 digits stay whole, and a count of more is an error
    score = "cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"
    weakest = both.withColumn("score", F.expr(score)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    # what lies within a longer phrase: its runs of two words or more
    runs = F.expr("flatten(transform(sequence(2, size(words) - 1), k -> transform(sequence(1, size(words) - k + 1), i -> array_join(slice(words, i, k), ' '))))")
    within = phrases.where(F.size("words") > 2).select("lang", F.explode(runs).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = weakest.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < explained * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("w.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    result = ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "w.l", "w.r", "n", F.col("w.score").cast("long").alias("score"))
    result = keep.write(result, "collocations")
    scratch.drop()
    return result
