"""N-gram Jaccard join with an R-tree over count vectors.

Every document is the set of its distinct word shingles. Shingles are hashed into groups, and a document's counts by
group are a point; two sets share at most the sum of the points' coordinate minima. Steps, each a Spark job:

1. Each set gets a fingerprint (equal sets are one node) and keys by pigeonhole: two sets that link differ in at most
   d shingles, so of more than d blocks of the hash range some hold the same shingles in both. For lower thresholds,
   where such blocks are too small, larger ones are used, so many that a link is missed once in 1e9 times.
2. Nodes that share a key belong to one bundle (connected components). Links never leave a bundle.
3. In a bundle, an R-tree over the points yields the pairs whose bound allows a link; pairs not yet connected are verified
   on the sets. A bundle too large for a task is dealt to tasks as pairs of chunks, so that no pair is left out.
4. Verified links give the components.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch, components, join_small, map_batches, written

GROUPS = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (public constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.cumprod(factors, dtype=np.uint64)
    return _powers[0], _powers[1]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``width`` make one shingle, none make none."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(LOWER), np.uint8) if text else np.zeros(0, np.uint8)
    inside = np.concatenate(([False], ~_WHITE[raw], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)))
        word = mix((total[end] - total[start]) * down[start])
        n = len(word)
        k = min(width, n)
        whole = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            whole = mix(whole * _U(_BASE) + word[i : n - k + 1 + i])
    return np.unique(whole)


class Bands:
    """Size bands for a threshold ``num/den`` such that sets that link are in the same band or in adjoining ones.

    For level k (bands k and k+1), ``differ[k]`` is the most shingles by which two linked sets can differ.
    """

    def __init__(self, num: int, den: int, most: int = 1 << 40) -> None:
        self.num, self.den, self.low = num, den, [1]
        while self.low[-1] <= most:
            self.low.append(max(self.low[-1] + 1, self.low[-1] * den // num + 1))
        self.low_array = np.array(self.low)
        top = [x - 1 for x in self.low[1:]]
        # |A|+|B|-2i <= (|A|+|B|)(1-t)/(1+t)
        self.differ = [(a + b) * (den - num) // (den + num) for a, b in pairwise(top)]
        # for lower thresholds the pigeonhole's blocks hold too few shingles to tell sets apart: see random_keys
        self.trials = 0
        if 36 * (den + num) < 600 * (den - num):
            if 2 * num <= den:
                raise ValueError("the threshold must be over one half")
            untouched = 0.85 * np.exp(-8 * (den - num) / (den + num) * (1 + den / num))
            self.trials = int(np.ceil(21 / -np.log1p(-untouched)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low_array, n, "right")) - 1


def block_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set: hashes of what its blocks hold. Sets that link share a key (see also ``random_keys``).

    Blocks are those of the set's own level and the one below, more of them than linked sets can differ in. A level has
    spare blocks beyond the pigeonhole's, so that keys of blocks with fewer than three shingles, which many unrelated sets
    share, are only needed for sets that have more such blocks than there are spare ones.
    """
    if bands.trials:
        return random_keys(s, bands)
    out, band = [], bands.of(len(s))
    with np.errstate(over="ignore"):
        hashed = mix(s ^ _U(0xD1B54A32D192ED03))
    for level in (band, band - 1):
        d = bands.differ[level] if level >= 0 else 0
        if d == 0:  # only equal sets link: they are one node already
            continue
        spare = 1 + d // 8
        blocks = d + 1 + spare
        place = (((s & _U(0xFFFFFFFF)) * _U(blocks)) >> _U(32)).astype(np.int64)
        key, count = _held(place, hashed, blocks, level)
        out.append(key[count >= 3] if (count < 3).sum() <= spare else key)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def random_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys by several independent divisions into blocks of four to eight shingles, for thresholds under about 0.88.

    Levels are powers of two. At the threshold a block is untouched by the difference of two linked sets, and holds
    enough, with a probability that ``Bands`` works out; there are so many blocks that a link is missed with a probability
    under 1e-9 (and sooner falls to a collision of 64-bit hashes in a large corpus). Blocks of fewer than three shingles,
    in tiny sets of none, give no key.
    """
    n, out = len(s), []
    if not n:
        return np.zeros(0, np.uint64)
    own = n.bit_length() - 1
    for level in (own, own - 1):
        if level < 0 or (level < own and n * bands.num >= (1 << own) * bands.den):
            continue
        blocks = max(2, (1 << level) // 4)
        rounds = -(-bands.trials // blocks)
        with np.errstate(over="ignore"):
            seeds = mix(np.arange(1, rounds + 1, dtype=np.uint64) * _U(_BASE))
            hashed = mix(s[None, :] ^ seeds[:, None])
            place = (((hashed & _U(0xFFFFFFFF)) * _U(blocks)) >> _U(32)).astype(np.int64) + np.arange(rounds)[:, None] * blocks
        key, count = _held(place.ravel(), hashed.ravel(), blocks * rounds, level)
        out.append(key[count >= (3 if level >= 3 else 1)])
    return np.concatenate(out)


def _held(place: np.ndarray, hashed: np.ndarray, blocks: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Key and number of shingles of each block."""
    order = np.argsort(place, kind="stable")
    count = np.bincount(place, minlength=blocks)
    first = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashed[order], dtype=np.uint64)))
        held = total[first + count] - total[first]
        return mix(held * _U(_BASE) + _U(level << 32) + np.arange(blocks, dtype=np.uint64)), count


def fingerprint(s: np.ndarray) -> int | None:
    """64 bits that stand for the set; None for the empty set."""
    if not len(s):
        return None
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ _U(0xA0761D6478BD642F)).sum(dtype=np.uint64) + _U(len(s))]))[:1].view(np.int64)[0])


def counts(s: np.ndarray) -> np.ndarray:
    """The point: how many shingles fall into each group."""
    return np.bincount((s >> _U(58)).astype(np.int64), minlength=GROUPS).astype(np.int32)


class RTree:
    """Packed R-tree: points sorted by their widest coordinates in turn, leaves of ``leaf`` points, a box for each node."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 24) -> None:
        self.order = np.concatenate([*self._pack(points, np.arange(len(points)), leaf), np.zeros(0, np.int64)]).astype(np.int64)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.starts = list(range(0, len(points), leaf))
        self.boxes = np.maximum.reduceat(self.points, self.starts) if self.starts else points[:0]
        self.least = np.minimum.reduceat(self.sizes, self.starts) if self.starts else sizes[:0]
        self.leaf = leaf

    def _pack(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
        if len(rows) <= leaf:
            return [rows]
        spread = np.ptp(points[rows], axis=0)
        rows = rows[np.argsort(points[rows, spread.argmax()], kind="stable")]
        half = -(-len(rows) // leaf) // 2 * leaf
        return [*self._pack(points, rows[:half], leaf), *self._pack(points, rows[half:], leaf)]

    def candidates(self, other: RTree | None, num: int, den: int):
        """Arrays (a, b, bound) of input rows whose summed coordinate minima allow Jaccard >= num/den.

        Node against node first, on the boxes' upper corners and least sizes; then point against point.
        """
        same, other = other is None, other or self
        for i, a in enumerate(self.starts):
            # overlap / (sizes - overlap) >= num/den  <=>  (num+den) overlap >= num * sizes
            upper = np.minimum(self.boxes[i], other.boxes).sum(axis=1)
            ok = (num + den) * upper >= num * (self.least[i] + other.least)
            if same:
                ok[:i] = False
            p, ps = self.points[a : a + self.leaf], self.sizes[a : a + self.leaf]
            for j in np.flatnonzero(ok):
                b = other.starts[j]
                q, qs = other.points[b : b + self.leaf], other.sizes[b : b + self.leaf]
                bound = np.minimum(p[:, None, :], q[None, :, :]).sum(axis=2)
                fit = (num + den) * bound >= num * (ps[:, None] + qs[None, :])
                if same and i == j:
                    fit = np.triu(fit, 1)
                x, y = np.nonzero(fit)
                if len(x):
                    yield self.order[a + x], other.order[b + y], bound[x, y] / (ps[x] + qs[y])


def links_in(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Verified links between rows, enough to connect all that links connect; ``side`` 0 and 1: only pairs across."""
    points, sizes = np.array([counts(s) for s in sets]).reshape(-1, GROUPS), np.array([len(s) for s in sets])
    if (side == side[0]).all():
        found = RTree(points, sizes).candidates(None, num, den)
        at = (np.arange(len(sets)),) * 2
    else:
        at = (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        found = RTree(points[at[0]], sizes[at[0]]).candidates(RTree(points[at[1]], sizes[at[1]]), num, den)
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    for a, b, bound in found:
        nearest = np.argsort(-bound, kind="stable")
        for i, j in zip(at[0][a[nearest]].tolist(), at[1][b[nearest]].tolist()):
            x, y = top(i), top(j)
            if x != y:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * shared >= num * (len(sets[i]) + len(sets[j]) - shared):
                    root[x] = y
                    out.append((i, j))
    return out


def key_stars(docs: DataFrame, width: int, bands: Bands, buckets: int, flush_keys: int = 2_000_000) -> DataFrame:
    """(a, b): each node that shares a key, with the least node that has the key; enough to connect all that share keys.

    Keys travel as packed arrays by bucket. Each task first joins what shares a key within itself and sends a key once,
    so that a key which very many documents have costs an entry for each task. Of keys and nodes 48 bits travel: should
    two agree by chance, more is taken together than has to be, and nothing is lost.
    """

    def packed(batches):
        import pyarrow as pa

        schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("stars", pa.binary())])
        keys, nodes, held = [], [], 0

        def flush():
            k = np.concatenate([*keys, np.zeros(0, np.uint64)]) >> _U(16) << _U(16)
            f = np.repeat(np.array([n for n, _ in nodes], np.int64) & SHORT, [c for _, c in nodes])
            k, f, stars = combine(k, f)
            place = ((k >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
            cut_at = np.searchsorted(place, np.arange(buckets + 1))
            some = np.flatnonzero(cut_at[1:] > cut_at[:-1]).tolist()
            rows = [(i, pack(k[cut_at[i] : cut_at[i + 1]] >> _U(16)), pack(f[cut_at[i] : cut_at[i + 1]].view(np.uint64))) for i in some]
            if rows:
                # the task's own stars go along, spread over the buckets
                shares = np.array_split(stars, len(rows))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([x.tobytes() for x in shares], pa.binary())], schema=schema)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text, width)
                if len(s) and len(got := block_keys(s, bands)):
                    keys.append(got)
                    nodes.append((fingerprint(s), len(got)))
                    held += len(got)
                if held >= flush_keys:
                    yield from flush()
                    keys, nodes, held = [], [], 0
        yield from flush()

    def met(table):
        import pyarrow as pa

        k = np.concatenate([unpack(b) for b in table.column("keys").to_pylist()])
        f = np.concatenate([unpack(b) for b in table.column("nodes").to_pylist()]).view(np.int64)
        own = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("stars").to_pylist()]).reshape(-1, 2)
        stars = np.unique(np.concatenate((own, combine(k, f)[2])), axis=0)
        return pa.table({"a": stars[:, 0], "b": stars[:, 1]})

    blobs = docs.select("text").mapInArrow(packed, "bucket int, keys binary, nodes binary, stars binary")
    return blobs.groupBy("bucket").applyInArrow(met, "a long, b long").distinct()


SHORT = (1 << 48) - 1


def pack(x: np.ndarray) -> bytes:
    """The low 48 bits of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


def combine(k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, sorted, with its least node; and the stars [node, least node] of the others."""
    order = np.lexsort((f, k))
    k, f = k[order], f[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))[: len(k)]
    low = f[new][np.cumsum(new) - 1] if len(k) else f
    other = f != low
    return k[new], f[new], np.unique(np.stack((f[other], low[other]), axis=1), axis=0)


def ngram_join(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, **how) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``; sets link when Jaccard >= ``num/den``.

    Null and empty texts have the empty set, link with nothing, and are their own component. Rows with equal sets are in
    one component. Repeated rows come out repeated. A null id is in its group, but is never the smallest id unless alone.
    """
    return joined(docs, width, num, den, **how).select("doc_id", "n_shingles", "component_id")


def joined(docs: DataFrame, width: int, num: int, den: int, chunk_rows: int = 1500, chunk_shingles: int = 1_000_000, bucket_chars: int = 8_000_000) -> DataFrame:
    """The rows of ``ngram_join`` with ``text_hash``, and ``component``, which tells components of equal ids apart.

    ``chunk_rows`` and ``chunk_shingles``: what a task holds of a bundle at a time; more is dealt as pairs of chunks.
    ``bucket_chars``: text for each bucket of keys, so that a bucket fits a task.
    """
    kind, bands = docs.schema["doc_id"].dataType.simpleString(), Bands(num, den)

    def measured():
        def apply(cols):
            sets = [shingles(t, width) for t in cols["text"].to_pylist()]
            return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "fp": [fingerprint(s) for s in sets], "n_shingles": [len(s) for s in sets]}

        return apply

    def stored():
        def apply(cols):
            sets = [shingles(t, width) for t in cols["text"].to_pylist()]
            return {"fp": [fingerprint(s) for s in sets], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]}

        return apply

    scratch = Scratch(docs.sparkSession)
    nodes = scratch.write(map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), f"doc_id {kind}, text_hash long, fp long, n_shingles long", measured), "join-nodes")
    chars = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    stars = key_stars(docs, width, bands, max(16, -(-6 * chars // bucket_chars)))
    bundles = components(stars, scratch=scratch).withColumnRenamed("node", "short").withColumnRenamed("component", "bundle")
    short = F.col("fp").bitwiseAND(F.lit(SHORT)).alias("short")

    # one document of each node in a bundle gives its set
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias("row_name")
    members = join_small(nodes.where("fp is not null").select("doc_id", "fp", short), bundles.select("short"), ["short"], "left_semi", 500_000)
    givers = scratch.write(members.groupBy("fp").agg(F.min("doc_id").alias("doc_id")).select(name("doc_id")).distinct(), "join-givers")
    texts = join_small(docs.select(name("doc_id"), "text"), givers, ["row_name"], "left_semi", 500_000)
    sets = map_batches(texts.select("text"), "fp long, n long, shingles binary", stored).where("fp is not null").withColumn("short", short)
    sets = scratch.write(sets.join(bundles, "short").drop("short").dropDuplicates(["fp"]), "join-sets")

    weight = sets.groupBy("bundle").agg(F.count("*").alias("rows"), F.sum("n").alias("total"))
    parts = weight.where("rows > 1").select("bundle", F.greatest(F.ceil(F.col("rows") / chunk_rows), F.ceil(F.col("total") / chunk_shingles)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = sets.join(parts, "bundle").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("bundle", F.least("part", "other").alias("c1"), F.greatest("part", "other").alias("c2"), (F.col("part") > F.col("other")).cast("int").alias("side"), "fp", "shingles")

    def linked(group: pd.DataFrame) -> pd.DataFrame:
        own = [np.frombuffer(b, np.uint64) for b in group["shingles"]]
        side = group["side"].to_numpy() if group["c1"].iloc[0] != group["c2"].iloc[0] else np.zeros(len(group), int)
        fp = group["fp"].to_numpy()
        pairs = links_in(own, side, num, den) if len(own) > 1 else []
        return pd.DataFrame({"a": [fp[i] for i, _ in pairs], "b": [fp[j] for _, j in pairs]}, dtype="int64")

    links = dealt.groupBy("bundle", "c1", "c2").applyInPandas(linked, "a long, b long")
    groups = components(links, scratch=scratch)
    classes = nodes.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"))
    members = classes.join(groups.select(F.col("node").alias("fp"), "component"), "fp")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked_only = members.join(smallest, "component").select("fp", "component_id", "component")
    every = classes.join(linked_only, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), F.coalesce("component", "fp").alias("component"))
    own = F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    result = written(nodes.join(every, "fp", "left").select("doc_id", "text_hash", "n_shingles", own, "component"), "join-result")
    scratch.drop()
    return result


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, **how) -> DataFrame:
    """The first row of each component of ``docs``, all columns as they are.

    The first is the row of the least id (a null id is the last of all); of rows that share it, a hash of the text decides,
    and of rows of equal id and text one stays. Empty and null texts have no links: all rows with them stay.
    """
    found = joined(docs, width, num, den, **how).where("component is not null")
    rows = found.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    place = lambda: F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = rows.groupBy("component").agg(F.min(place()).alias("first"))
    scratch = Scratch(docs.sparkSession)
    rated = scratch.write(rows.join(first, "component").select(F.col("doc_id").alias("keep_id"), F.col("text_hash").alias("keep_hash"), "n", (place() == F.col("first")).alias("stays")), "join-rated")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("keep_row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    same = F.col("row_id").eqNullSafe(F.col("keep_id")) & (F.col("row_hash") == F.col("keep_hash"))
    out = whole.join(rated.where("not stays"), same, "left_anti")
    repeated = rated.where("stays and n > 1")
    if not repeated.isEmpty():
        order = Window.partitionBy("row_id", "row_hash").orderBy(F.lit(1))
        one = out.join(repeated, same, "left_semi").withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
        out = out.join(repeated, same, "left_anti").unionByName(one)
    return out.select(*[F.col(f"keep_row.`{c}`").alias(c) for c in docs.columns])
