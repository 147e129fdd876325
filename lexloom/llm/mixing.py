"""Mixing sources to target weights by Poisson replication.

A document of source s is wanted ``weight(s) * total / rows(s)`` times on average. A hash of its id and the seed gives a
uniform number, whose Poisson inverse is the number of copies; the copies are then put in one global hash order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import free_name, join_small, map_batches

#: Copies of a row are exploded in blocks of so many.
BLOCK = 10_000


def uniform(seed: int, *parts: str | Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5: the same on every machine, and in other SQL engines."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: float) -> tuple[int, list[float]]:
    """k0 and P(X <= k) for k = k0, k0 + 1, ... up to twelve deviations beyond the mean; P(X < k0) is 0 to a double.

    Rates up to 500 start from k0 = 0. Above, exp(-rate) would vanish: the first term comes from logarithms, and the sum
    of all is set to 1, which takes out their rounding.
    """
    least = 0 if rate <= 500 else math.floor(rate - 12 * math.sqrt(rate) - 30)
    p = math.exp(least * math.log(rate) - rate - math.lgamma(least + 1)) if least else math.exp(-rate)
    cdf = [p]
    for k in range(least + 1, math.ceil(rate + 12 * math.sqrt(rate) + 30) + 1):
        p = p * rate / k
        cdf.append(cdf[-1] + p)
    return least, [c / cdf[-1] for c in cdf] if least else cdf


def _cumulative():
    def apply(cols):
        found = [cumulative(r) for r in cols["rate"].to_pylist()]
        return {"mix_source": cols["mix_source"], "rate": cols["rate"], "cdf_from": [f[0] for f in found], "cdf": [f[1] for f in found]}

    return apply


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """(source, rate, cdf_from, cdf) by source. ``weights`` default to equal ones; sources that it doesn't name get none.

    ``total``: rows wanted in all, by default as many as there are. A null source is a source of its own, named "null"
    in ``weights``. Any rate will do: ``cdf`` holds some 24 roots of the rate, from ``cdf_from`` copies on.
    """
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("null")).alias("mix_source")).agg(F.count("*").alias("rows"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(str(k), float(v)) for k, v in weights.items()], "mix_source string, weight double")
        weighed = sizes.join(F.broadcast(given), "mix_source", "left").fillna(0.0, ["weight"])
    sums = weighed.agg(F.sum("weight").alias("w"), F.sum("rows").alias("n")).first()
    if not sums["n"] or not sums["w"]:
        return weighed.select("mix_source", F.lit(0.0).alias("rate"), F.lit(0).alias("cdf_from"), F.array(F.lit(1.0)).alias("cdf"))
    wanted = float(total if total is not None else sums["n"])
    rated = weighed.select("mix_source", (F.col("weight") / F.lit(float(sums["w"])) * F.lit(wanted) / F.col("rows")).alias("rate"))
    return map_batches(rated, "mix_source string, rate double, cdf_from int, cdf array<double>", _cumulative)


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 17) -> DataFrame:
    """``docs`` replicated and in global shuffled order, with ``copy_no`` (from 1) and ``shuffle_key`` (the order).

    Copies are counted from the id alone, so rows that repeat an id are replicated alike, and null ids share one number.
    Texts, null or empty, play no part. An empty table gives an empty table. Where ``docs`` has a column of a new name
    already, it stays and the new column's name gets an underscore behind it.
    """
    found = rates(docs, weights, total)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row")
    keyed = docs.select(whole, F.col("doc_id").alias("mix_id"), F.coalesce(F.col("source").cast("string"), F.lit("null")).alias("mix_source"))
    # sources are few; should they be many, the join is shuffled and its skew split by adaptive execution
    joined = join_small(keyed, found, ["mix_source"])
    u = uniform(seed, "mix_id")
    copies = F.col("cdf_from") + F.size(F.filter("cdf", lambda c: c <= u))
    # in two steps, so that no array grows with the number of copies
    block = F.explode(F.sequence(F.lit(1), F.col("mix_copies"), F.lit(BLOCK))).alias("mix_block")
    blocks = joined.withColumn("mix_copies", copies).where("mix_copies > 0").select("mix_row", "mix_id", "mix_copies", block)
    many = blocks.select("mix_row", "mix_id", F.explode(F.sequence(F.col("mix_block"), F.least(F.col("mix_copies"), F.col("mix_block") + (BLOCK - 1)))).alias("mix_copy"))
    many = many.withColumn("mix_key", uniform(seed + 1, "mix_id", "mix_copy"))
    # the key is uniform, so equal ranges of it are equal shares of the rows: no sampling run has to find their bounds
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = many.repartitionById(parts, F.least(F.floor(F.col("mix_key") * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions("mix_key", "mix_id", "mix_copy")
    cols = [F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns]
    return ordered.select(*cols, F.col("mix_copy").alias(free_name("copy_no", docs)), F.col("mix_key").alias(free_name("shuffle_key", docs)))
