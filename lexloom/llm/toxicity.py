"""Toxicity: non-negative positive-unlabelled learning of a numpy classifier over hashed words.

Confirmed toxic documents are the positives, other text is unlabelled; the risk estimator corrects for the class prior
and keeps the negative part from falling below zero.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import crc_bucket, join_small, map_batches

BITS = 20
#: Marks stripped from words' ends (fixed values).
MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\"


#: Lengths of the word beginnings that count as features beside whole words.
STEMS = (4, 5, 7)


def word_ids(text: str | None) -> np.ndarray:
    """Distinct hashed words and word beginnings, lower-cased and stripped of marks; hashed alike on every machine."""
    if not text:
        return np.zeros(0, np.int32)
    words = {w.strip(MARKS) for w in set(text.lower().split())}
    words.discard("")
    found = {f"{w[:k]}-" for k in STEMS for w in words if len(w) > k} | words
    return np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) >> (32 - BITS) for w in found), np.int32, len(found)))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[ids].sum(), -30, 30))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 400, rate: float = 0.05, penalty: float = 3e-3, least_docs: int = 6) -> Model:
    """Logistic non-negative PU learning by full-batch Adam; words seen in fewer than ``least_docs`` positives stay at 0.

    ``penalty`` is on the sum of absolute weights (proximal steps), so that only words which tell keep a weight.
    """
    weights = np.zeros(1 << BITS)
    if not positive or not unlabelled:
        return Model(weights, float(np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))))
    seen = np.bincount(np.concatenate(positive), minlength=1 << BITS)
    common = np.bincount(np.concatenate(unlabelled), minlength=1 << BITS)
    # words that are no likelier in a positive than in any text can't be told apart under the prior
    keep = np.flatnonzero((seen >= least_docs) & (seen / len(positive) > 2 * common / len(unlabelled)))
    place = np.full(1 << BITS, -1, np.int32)
    place[keep] = np.arange(len(keep), dtype=np.int32)

    def sparse(docs):
        got = place[np.concatenate(docs)]
        return got[got >= 0], np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])[got >= 0]

    pi, pd = sparse(positive)
    ui, ud = sparse(unlabelled)
    w, b = np.zeros(len(keep)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    soft = lambda z: np.logaddexp(0, z)
    for t in range(1, rounds + 1):
        zp = b + np.bincount(pd, w[pi], len(positive))
        zu = b + np.bincount(ud, w[ui], len(unlabelled))
        negative = soft(zu).mean() - prior * soft(zp).mean()
        gp = -prior * sig(-zp) / len(positive)
        if negative >= 0:
            gu = sig(zu) / len(unlabelled)
            gp = gp - prior * sig(zp) / len(positive)
        else:  # step back along the negative part only
            gu = -sig(zu) / len(unlabelled)
            gp = prior * sig(zp) / len(positive)
        g = np.bincount(pi, gp[pd], len(keep)) + np.bincount(ui, gu[ud], len(keep))
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        scale = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        step = scale / (np.sqrt(v) + 1e-8)
        w = w - step * m
        w = np.sign(w) * np.maximum(np.abs(w) - np.minimum(step, 100.0) * penalty * prior, 0)
        b -= scale * mb / (np.sqrt(vb) + 1e-8)
    weights[keep] = w
    return Model(weights, b)


def _sampled(df: DataFrame, most: int, seed: int) -> list[np.ndarray]:
    """Word ids of about ``most`` rows at most, drawn evenly by id hash: counted first, so the draw is known to be bounded."""
    n = df.count()
    rate = min(1.0, most / max(n, 1))
    drawn = df.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_003)) < int(rate * 1_000_003) + 1)

    def make():
        return lambda cols: {"ids": [word_ids(t).tobytes() for t in cols["text"].to_pylist()], "doc_id": cols["doc_id"]}

    found = map_batches(drawn.select("doc_id", "text"), f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids binary", make).limit(2 * most).toArrow()
    ids = found.column("ids").to_pylist()
    return [np.frombuffer(ids[i], np.int32) for i in sorted(range(len(ids)), key=list(zip(map(str, found.column("doc_id").to_pylist()), ids)).__getitem__)]


def train(docs: DataFrame, labels: DataFrame, most_positive: int = 3000, most_unlabelled: int = 9000) -> Model:
    """Fit on documents outside the held-out fold (crc32 of the id modulo 5 is 0), at most so many of each kind.

    The class prior is the share of toxic rows among all labelled rows outside that fold.
    """
    known = labels.where(crc_bucket("doc_id", 5) != 0).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("p")).first()
    prior = min(max((share["p"] or 0) / max(share["n"], 1), 1e-3), 0.5)
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (crc_bucket("doc_id", 5) != 0)).select("doc_id", "text")
    toxic = join_small(texts, known.where("toxic = 1").select("doc_id"), ["doc_id"], "left_semi", 500_000)
    return fit(_sampled(toxic, most_positive, 1), _sampled(texts, most_unlabelled, 2), prior)


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null and empty texts get the score of a text without telling words. Where no labels can be learned from, every text
    gets the class prior. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        model = shared.value
        return lambda cols: {"doc_id": cols["doc_id"], "score": [model.score(word_ids(t)) for t in cols["text"].to_pylist()]}

    scored = map_batches(docs.select("doc_id", "text"), f"doc_id {kind}, score double", make)
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5, **how) -> DataFrame:
    """The rows of ``docs`` whose score is below ``limit``, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, **how))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def make():
        import pyarrow as pa

        model = shared.value

        def apply(cols):
            stay = pa.array([model.score(word_ids(t)) < limit for t in cols["text"].to_pylist()], pa.bool_())
            return {n: c.filter(stay) for n, c in cols.items()}

        return apply

    return map_batches(docs, schema, make)
