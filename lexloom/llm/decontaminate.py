"""Benchmark decontamination: a generalised suffix automaton of the test items, run over every document's words.

A window is ``width`` consecutive words of an item; an item of fewer words is one window. While document words stream
through the automaton, the current state tells the longest run of words, ending here, that stands in some item.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import map_batches

#: In UTF-8 a word is a run of digits, ASCII letters (lower-cased) and all bytes from 0x80; the rest become blanks.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


@dataclass
class Automaton:
    """Suffix automaton over word ids; ``reports[s]``: at state s, (least length, window length, items) of windows that end there."""

    width: int
    vocabulary: dict[bytes, int]
    next: list[dict[int, int]]
    link: list[int]
    length: list[int]
    reports: dict[int, list[tuple[int, tuple[str, ...]]]]
    pairs: np.ndarray
    least: int

    @staticmethod
    def build(items: list[tuple[str, list[bytes]]], width: int) -> Automaton:
        vocabulary: dict[bytes, int] = {}
        nxt, link, length = [{}], [-1], [0]

        def extend(last: int, c: int) -> int:
            if c in nxt[last]:  # another item has been here
                q = nxt[last][c]
                return q if length[q] == length[last] + 1 else clone(last, c, q)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            cur, p = len(nxt) - 1, last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[cur] = q if length[q] == length[p] + 1 else clone(p, c, q)
            return cur

        def clone(p: int, c: int, q: int) -> int:
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            new = len(nxt) - 1
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = new
                p = link[p]
            link[q] = new
            return new

        coded = [(item, [vocabulary.setdefault(w, len(vocabulary)) for w in words]) for item, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = extend(last, c)
        # the state that holds each window, once no state is split any more
        holders: dict[int, dict[int, set[str]]] = {}
        pairs, least = set(), width
        for item, ids in coded:
            k = min(width, len(ids))
            least = min(least, k)
            pairs.update(zip(ids, ids[1:]))
            state = 0
            for i, c in enumerate(ids):
                state = nxt[state][c]
                if i + 1 >= k:
                    at = state
                    while length[link[at]] >= k:
                        at = link[at]
                    holders.setdefault(at, {}).setdefault(k, set()).add(item)
        # a document that reaches a state has also read the shorter strings up its suffix links
        reports: dict[int, list] = {}
        for s in sorted(range(1, len(nxt)), key=length.__getitem__):
            own = [(k, tuple(sorted(items))) for k, items in holders.get(s, {}).items()]
            if got := [*own, *reports.get(link[s], [])]:
                reports[s] = got
        size = len(vocabulary)
        return Automaton(width, vocabulary, nxt, link, length, reports, np.array(sorted(a * size + b for a, b in pairs), np.int64), least)

    def scan(self, ids: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items with windows that occur; ``ids`` is -1 for words no item has."""
        hit, found, n = np.zeros(len(ids), bool), set(), len(ids)
        if n < self.least:
            return hit, found
        # only words that could stand in a window are streamed: any window lies within a run of pairs that items have
        if self.least > 1:
            code = ids[:-1].astype(np.int64) * len(self.vocabulary) + ids[1:]
            code[(ids[:-1] < 0) | (ids[1:] < 0)] = -1
            place = np.searchsorted(self.pairs, code)
            ok = (place < len(self.pairs)) & (self.pairs[np.minimum(place, len(self.pairs) - 1)] == code) if len(self.pairs) else np.zeros(n - 1, bool)
            extra = 1
        else:
            ok, extra = ids >= 0, 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if b - a + extra >= self.least:
                self._stream(ids, a, b + extra, hit, found)
        return hit, found

    def _stream(self, ids, a: int, b: int, hit, found: set[str]) -> None:
        nxt, link, length, reports = self.next, self.link, self.length, self.reports
        state = run = 0
        for i, c in enumerate(ids[a:b].tolist(), a):
            while state and c not in nxt[state]:
                state = link[state]
                run = length[state]
            if c in nxt[state]:
                state, run = nxt[state][c], run + 1
            for k, items in reports.get(state, ()):
                if run >= k:
                    hit[i - k + 1 : i + 1] = True
                    found.update(items)


def benchmark_shards(benchmark: DataFrame, width: int, shard_words: int) -> list[Automaton]:
    """Automata over the items, each of at most ``shard_words`` words (or one item), so that what is broadcast is bounded.

    Items are read in blocks by id hash; only one block's texts are on the driver at a time.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (4 * shard_words)))
    out = []
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        coded = [(r["item_id"], words_of(r["text"])) for r in rows]
        if any(w for _, w in coded):
            out.append(Automaton.build(coded, width))
    return out


def _scanner(automata: list[Automaton]):
    def scan(text: str | None) -> tuple[int, np.ndarray, set[str]]:
        words = words_of(text)
        n, hit, found = len(words), np.zeros(len(words), bool), set()
        for a in automata:
            h, f = a.scan(np.fromiter(map(a.vocabulary.get, words, repeat(-1)), np.int32, n))
            if f:
                hit |= h
                found |= f
        return n, hit, found

    return scan


def benchmark_overlap(docs: DataFrame, benchmark: DataFrame, width: int = 10, shard_words: int = 2_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every row of ``docs``.

    Null and empty texts have no words. Items without an id or without words have no window; items that repeat count once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_shards(benchmark, width, shard_words))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        scan = _scanner(shared.value)

        def one(text):
            n, hit, found = scan(text)
            h = int(hit.sum())
            return n, h, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), h > 0

        def apply(cols):
            rows = zip(*map(one, cols["text"].to_pylist()))
            return {"doc_id": cols["doc_id"]} | {n: list(v) for n, v in zip(("n_words", "n_hit", "n_items", "items_sha256", "contaminated"), rows)}

        return apply

    return map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean", make)


def remove_overlap(docs: DataFrame, benchmark: DataFrame, width: int = 10, most_covered: float = 0.5, shard_words: int = 2_000_000) -> DataFrame:
    """``docs`` without the spans that lie in benchmark windows; documents covered beyond ``most_covered`` go whole.

    A span runs from the first to the last of adjoining hit words and is replaced by a blank; ``n_chars``, where it is a
    column, is set anew. Null and empty texts pass as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(benchmark_shards(benchmark, width, shard_words))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        scan = _scanner(shared.value)

        def one(text):
            """The text that stays, or False."""
            if not text:
                return text
            n, hit, found = scan(text)
            if not found:
                return text
            if hit.sum() > most_covered * n:
                return False
            places, out, last = [m.span() for m in WORD.finditer(text)], [], 0
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
            for a, b in zip(edge[::2], edge[1::2]):
                out += [text[last : places[a][0]], " "]
                last = places[b - 1][1]
            return "".join([*out, text[last:]])

        def apply(cols):
            import pyarrow as pa

            texts = list(map(one, cols["text"].to_pylist()))
            stay = pa.array([t is not False for t in texts], pa.bool_())
            got = {n: c.filter(stay) for n, c in cols.items()}
            got["text"] = [t for t in texts if t is not False]
            return got

        return apply

    out = map_batches(docs, schema, make)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
