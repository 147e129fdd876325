"""Byte-level BPE in two tiers: whole pre-tokens by a minimal perfect hash, all others by merging linked bytes off a heap.

The vocabulary is a public rank file, read by the driver (a few MB at most) and broadcast as arrays; nothing is trained.
Texts are cut into pre-tokens by a pattern; each different pre-token of a slice of rows is looked up once. The hash names one
slot for any string, and the token in that slot is compared in full, so that a miss is certain. What is missed is encoded as
linked bytes: the pair of least rank, leftmost of equals, is merged until no pair has a rank.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the public rank file lies; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed pattern by which the vocabulary splits text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows are handled in slices of about so many characters, and a task remembers so many pre-tokens; neither changes a result.
SLICE, REMEMBERED = 1_000_000, 250_000
_U = np.uint64


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank; ranks must count from 0 without gaps, and every byte must be a token."""
    found = {int(r): base64.b64decode(t) for t, r in map(bytes.split, filter(None, Path(path).read_bytes().splitlines()))}
    tokens = [found[r] for r in range(len(found))]
    if len(set(tokens)) != len(tokens) or not {bytes([b]) for b in range(256)} <= set(tokens):
        raise ValueError(f"{path} is not a byte-level vocabulary")
    return tokens


def _mixed(h: np.ndarray, pilot: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h ^ (np.asarray(pilot, np.int64).astype(_U) * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)
        return x ^ (x >> _U(29))


class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys, n slots, one pilot number for each bucket of about four keys.

    The largest buckets are placed first, each with the first pilot that sends its keys to free slots; buckets of one key
    take a slot that is left, named by a negative pilot. ``slots`` gives each key's own slot, and some slot for any other string.
    """

    def __init__(self, keys: list[bytes]) -> None:
        self.size, self.buckets = len(keys), max(1, len(keys) // 4)
        h = self.hashed(keys)
        if len(np.unique(h)) != self.size:
            raise ValueError("two tokens share a 64-bit hash")
        order = np.argsort(bucket := h % _U(self.buckets), kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if self.size else []
        self.pilots, free, self.place = np.zeros(self.buckets, np.int64), np.ones(self.size, bool), np.zeros(self.size, np.int64)
        for group in sorted(groups, key=len, reverse=True):
            if len(group) == 1:
                break
            start = 0
            while True:
                tried = (_mixed(h[group][None, :], np.arange(start, start + 64)[:, None]) % _U(self.size)).astype(np.int64)
                alone = np.sort(tried, axis=1)
                fits = np.flatnonzero(free[tried].all(axis=1) & (np.diff(alone, axis=1) > 0).all(axis=1))
                if len(fits):
                    break
                start += 64
            self.pilots[bucket[group[0]]] = start + fits[0]
            self.place[group] = tried[fits[0]]
            free[tried[fits[0]]] = False
        single = np.array([g[0] for g in groups if len(g) == 1], np.int64)
        left = np.flatnonzero(free)
        self.pilots[bucket[single].astype(np.int64)] = -left - 1
        self.place[single] = left

    @staticmethod
    def hashed(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), _U, len(keys))

    def slots(self, keys: list[bytes]) -> np.ndarray:
        h = self.hashed(keys)
        pilot = self.pilots[(h % _U(self.buckets)).astype(np.int64)]
        return np.where(pilot < 0, -pilot - 1, (_mixed(h, pilot) % _U(self.size)).astype(np.int64))


class Vocabulary:
    """What a task needs to encode and decode: tokens by rank, the perfect hash with the rank of each slot, ranks by token."""

    def __init__(self, tokens: list[bytes], hash_: PerfectHash) -> None:
        self.tokens, self.hash = tokens, hash_
        self.rank_at = np.zeros(len(tokens), np.int64)
        self.rank_at[hash_.place] = np.arange(len(tokens))
        self.ranks = {t: r for r, t in enumerate(tokens)}
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def merged(self, piece: bytes) -> list[int]:
        """Tokens of a pre-token: bytes linked to their neighbours, and a heap of rank and place packed into one number."""
        n, rank = len(piece), self.ranks.get
        after, before = [*range(1, n + 1), n], list(range(-1, n))
        now, heap = [-1] * (n + 1), []
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                now[i] = r << 32 | i
                heap.append(now[i])
        heapify(heap)
        while heap:
            least = heappop(heap)
            i = least & 0xFFFFFFFF
            if now[i] != least:
                continue  # the pair that begins here has changed since
            gone = after[i]
            end = after[i] = after[gone]
            before[end], now[gone], now[i] = i, -1, -1
            if end < n and (r := rank(piece[i : after[end]])) is not None:
                now[i] = r << 32 | i
                heappush(heap, now[i])
            if (p := before[i]) >= 0:
                now[p] = -1
                if (r := rank(piece[p:end])) is not None:
                    now[p] = r << 32 | p
                    heappush(heap, now[p])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def pieces(self, pieces: list[str]) -> Iterator[tuple[int, ...]]:
        """Tokens of each of the pre-tokens: the hash first, merging for what it misses."""
        raw = [p.encode() for p in pieces]
        for piece, r in zip(raw, self.rank_at[self.hash.slots(raw)].tolist()):
            yield (r,) if self.tokens[r] == piece else tuple(self.merged(piece))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of consecutive runs of ids; an id the vocabulary doesn't have is an error."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.tokens):
            raise ValueError("an id lies outside the vocabulary")
        n = self.lengths[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = self.blob[np.arange(ends[-1]) + np.repeat(self.starts[ids] - ends[:-1], n)]
        cuts = ends[np.concatenate([[0], np.cumsum(counts)])]
        return [out[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


class Encoder:
    """Splits texts and remembers what it has encoded, from one task of a worker to the next."""

    def __init__(self, vocabulary: Vocabulary, pattern: str) -> None:
        self.vocabulary, self.split, self.known = vocabulary, regex.compile(pattern).findall, {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, how many each text has) of texts; null counts as empty."""
        cut = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({p for c in cut for p in c}.difference(self.known))
        self.known.update(zip(new, self.vocabulary.pieces(new)))
        found = [list(chain.from_iterable(map(self.known.__getitem__, c))) for c in cut]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts


_workers: dict[tuple, Encoder] = {}


def worker_encoder(tokens: list[bytes], hash_: PerfectHash, pattern: str) -> Encoder:
    """The encoder of this worker process for a vocabulary and pattern."""
    key = (pattern, len(tokens), xxhash.xxh3_128_digest(b" ".join(tokens)))
    if key not in _workers:
        _workers.clear()
        _workers[key] = Encoder(Vocabulary(tokens, hash_), pattern)
    return _workers[key]


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[list[str | None]]:
    """An Arrow column as lists of consecutive texts, each of about ``most`` bytes; a longer text stands alone."""
    sizes = np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), np.int64))
    cuts = np.flatnonzero(np.diff(sizes // most)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(texts)]):
        if b > a:
            yield texts.slice(a, b - a).to_pylist()


def shared_vocabulary(spark: SparkSession, path: str):
    """The vocabulary of a rank file, its perfect hash built here, as a broadcast of at most a few MB."""
    tokens = read_ranks(path)
    return spark.sparkContext.broadcast((tokens, PerfectHash(tokens)))


def encoder(shared, pattern: str = PATTERN):
    """A column function: text to array<int> of token ids, without special tokens (their strings are ordinary text).

    Null and empty texts have no tokens. ``shared``: of ``shared_vocabulary``.
    """

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = worker_encoder(*shared.value, pattern)
        for texts in batches:
            parts = [one(part) for part in slices(texts)]
            ends = np.cumsum(np.concatenate([[0], *[n for _, n in parts]]))
            ids = np.concatenate([np.zeros(0, np.int32), *[i for i, _ in parts]])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))

    return encode


def decoder(shared):
    """A column function: array<int> of token ids to the bytes they stand for, as binary; null gives null.

    A null id, or one that the vocabulary doesn't have, is an error.
    """

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = Vocabulary(*shared.value)
        for lists in batches:
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("an id is null")
            out, at, ids = [], 0, np.asarray(flat, np.int64)
            for part in np.array_split(np.arange(len(lists)), max(1, len(ids) // SLICE)):
                n = counts[part]
                out += v.decode(ids[at : at + n.sum()], n)
                at += n.sum()
            yield pa.array(out, pa.binary(), mask=np.asarray(lists.is_null()))

    return decode


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, ``ids`` (array<int>) and ``decoded`` (binary, from the ids alone) of every row of ``docs``.

    Rows come out one for one: null ids stay, repeated rows repeat, null and empty texts have no ids and decode to nothing.
    Other columns of ``docs`` are not carried, so their names can't clash. A text's length is bounded by what a task can
    hold. ``vocabulary``: path of a rank file on the driver.
    """
    shared = shared_vocabulary(docs.sparkSession, vocabulary)
    ids = docs.select("doc_id", encoder(shared, pattern)("text").alias("ids"))
    return ids.select("doc_id", "ids", decoder(shared)("ids").alias("decoded"))


def token_digests(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids in decimal and of the decoded bytes."""
    joined: Column = F.array_join(F.col("ids").cast("array<string>"), " ")
    return tokenised(docs, vocabulary, pattern).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
