"""Language identification by cross-parsing: a text is cut into the longest pieces that stand in a language's sample.

For every language a suffix automaton of labelled text is built. Parsing a text against it counts phrases; the language
that needs the fewest per character wins. Texts are parsed in blocks of ``BLOCK`` characters, many side by side, so that
one step moves all of them by one character; a phrase ends at a block's end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import crc_bucket, map_batches

BLOCK = 256
BLANK = 0  # the symbol of all that is no letter


def automaton(codes: np.ndarray, symbols: int) -> np.ndarray:
    """Transition table [state, symbol] of the suffix automaton of ``codes``; 0 is the root and also "no transition"."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        cur, p = len(nxt) - 1, last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                twin = len(nxt) - 1
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    table = np.zeros((len(nxt), symbols), np.int32)
    for s, moves in enumerate(nxt):
        for c, to in moves.items():
            table[s, c] = to
    return table


@dataclass
class Languages:
    names: list[str]
    symbols: dict[str, int]
    tables: list[np.ndarray]

    @property
    def size(self) -> int:
        return len(self.symbols) + 2  # blank, the known letters, any other letter

    def lookup(self) -> np.ndarray:
        """Symbol of each code point: 0 blank, 255 undecided."""
        table = np.full(0x110000, 255, np.uint8)
        for c, s in self.symbols.items():
            table[ord(c)] = s
        table[:128][[not chr(i).isalpha() for i in range(128)]] = BLANK
        return table


def coded(text: str, table: np.ndarray, other: int) -> np.ndarray:
    """Symbols of the lower-cased text, runs of non-letters as one blank; all blank if it has no letter."""
    low = text.lower()
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    got = table[points]
    for i in np.flatnonzero(got == 255).tolist():
        got[i] = other if low[i].isalpha() else BLANK
    blank = got == BLANK
    return got[~(blank & np.concatenate(([True], blank[:-1])))] if len(got) else got


def phrases(blocks: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Phrases of each row of ``blocks`` [row, position]; rows are sorted by falling length."""
    flat, width = table.ravel(), table.shape[1]
    state, count = np.zeros(len(blocks), np.int32), np.zeros(len(blocks), np.int64)
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(blocks.shape[1]), "right")
    for i in range(blocks.shape[1]):
        n = live[i]
        if not n:
            break
        c = blocks[:n, i].astype(np.int32)
        to = flat[state[:n] * width + c]
        broken = to == 0
        count[:n] += broken
        state[:n] = np.where(broken, flat[c], to)
    return count + (lengths > 0)


def rate(texts: list[str | None], langs: Languages, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases per character [text, language], and which texts have a letter."""
    codes = [coded(t, table, langs.size - 1) if t else np.zeros(0, np.uint8) for t in texts]
    has = np.array([bool((c != BLANK).any()) for c in codes])
    sizes = np.array([len(c) for c in codes])
    counts = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(codes)), counts)
    lengths = np.minimum(BLOCK, np.repeat(sizes, counts) - BLOCK * (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)))
    blocks = np.zeros((len(owner), BLOCK), np.uint8)
    blocks[np.arange(BLOCK)[None, :] < lengths[:, None]] = np.concatenate([*codes, np.zeros(0, np.uint8)])
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(codes), len(langs.names)))
    for k, t in enumerate(langs.tables):
        got = np.zeros(len(owner), np.int64)
        got[order] = phrases(blocks[order], lengths[order], t)
        out[:, k] = np.bincount(owner, got, len(codes)) / np.maximum(sizes, 1)
    return out, has


def learn(docs: DataFrame, docs_per_language: int = 200, chars_per_doc: int = 400, chars_per_language: int = 16_000, most_languages: int = 250) -> Languages:
    """Automata from a bounded sample of labelled documents outside the held-out fold.

    About ``docs_per_language`` documents of each language are drawn by id hash; of each, ``chars_per_doc`` characters
    count, up to ``chars_per_language`` in all, so a table has at most twice that many states.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket("doc_id", 3) != 1)).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Languages([], {}, [])
    limit = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, 1.5 * docs_per_language / n) * 1_000_003) + 1)])
    drawn = known.where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1_000_003)) < limit[F.col("lang")])
    rows = drawn.select("lang", F.xxhash64(F.lit(8), "doc_id", "text").alias("h"), F.substring("text", 1, chars_per_doc).alias("text")).limit(3 * docs_per_language * len(sizes)).collect()
    samples: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        if len(samples.setdefault(r["lang"], "")) < chars_per_language:
            samples[r["lang"]] += r["text"] + "\n"
    letters: dict[str, int] = {}
    for c in sorted({c for s in samples.values() for c in s.lower() if c.isalpha()}, key=lambda c: (-sum(s.lower().count(c) for s in samples.values()), c))[:200]:
        letters[c] = len(letters) + 1
    langs = Languages(sorted(samples), letters, [])
    table = langs.lookup()
    langs.tables = [automaton(coded(samples[n], table, langs.size - 1)[:chars_per_language], langs.size) for n in langs.names]
    return langs


def identify(docs: DataFrame, sharpness: float = 60.0, **how) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``.

    ``und`` with score 0 if the text is null, empty or without a letter, or if no language could be learned. The score
    is the winner's share when phrases per character are turned into weights exp(-sharpness * rate). Ties go to the name
    that sorts first. Nothing but the text is looked at in predicting.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **how))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        langs = shared.value
        table = langs.lookup()

        def apply(cols):
            texts = cols["text"].to_pylist()
            pred, score = [], []
            # a few hundred texts at a time: the blocks of long ones would else fill the memory
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and (upto == at or chars + len(texts[upto] or "") < 2_000_000):
                    chars += len(texts[upto] or "")
                    upto += 1
                rates, has = rate(texts[at:upto], langs, table) if langs.names else (np.zeros((upto - at, 1)), np.zeros(upto - at, bool))
                best = rates.argmin(axis=1)
                share = 1 / np.exp(-sharpness * (rates - rates.min(axis=1, keepdims=True))).sum(axis=1)
                pred += [langs.names[b] if h else "und" for b, h in zip(best, has)]
                score += np.where(has, share, 0.0).tolist()
                at = upto
            return {"doc_id": cols["doc_id"], "lang_pred": pred, "score": score}

        return apply

    found = map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, lang_pred string, score double", make)
    return found.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
