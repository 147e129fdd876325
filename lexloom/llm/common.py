"""What several operators of this package share: Arrow row mapping, materialised tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]]) -> DataFrame:
    """Apply a function of column lists to every Arrow batch; ``make`` runs once per task and returns that function.

    The function gets the input columns as Python lists (or arrays, where it asks for them) and returns the columns of ``schema``.
    """
    fields = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, apply = to_arrow_schema(fields), None
        for batch in batches:
            if batch.num_rows:
                apply = apply or make()
                got = apply({n: c for n, c in zip(batch.schema.names, batch.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) if not isinstance(got[f.name], pa.Array) else got[f.name].cast(f.type) for f in out], schema=out)

    return df.mapInArrow(run, fields)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a temporary folder of its own; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (there := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = there.get()
    if not found and spark.sparkContext.master.startswith("local["):
        found = tempfile.mkdtemp(prefix="checkpoints-")
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: lineage ends in the shared folder, and Spark removes the files with the frame."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for frames that are read several times and column-wise."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables in the shared folder that an operator needs for a while; ``drop`` removes them once its result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        # the files of the shuffles behind a table go when it is written, not when the driver happens to collect its garbage
        before = self.spark.conf.get(SHUFFLES_GO)
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_counted(self, df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
        """The table, and aggregates of its rows that are taken while it is written."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        return self.write(df.observe(seen, *[c.alias(n) for n, c in counts.items()]), name), seen.get

    def drop(self) -> None:
        """Delete the tables."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            there = jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)
        self.paths = []


def join_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", limit: int = 10_000) -> DataFrame:
    """Join a table that is expected to be small: broadcast if its rows, counted here, are at most ``limit``, else shuffled."""
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return big.join(small, keys, how)


def crc_bucket(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids hash as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def free_name(name: str, docs: DataFrame) -> str:
    """``name``, with underscores behind it if ``docs`` has a column of that name (names differ by more than case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(links: DataFrame, src: str = "a", dst: str = "b", max_rounds: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """Connected components of undirected links: (node, component), component being the least node reachable.

    Alternates large-star and small-star steps (each two aggregations on the node) until the edges stay the same; the
    number of rounds grows with the logarithm of the longest path, and each is one job. Only nodes with links are
    returned. Null ends are dropped, self-links and repeats make no difference. Raises if ``max_rounds`` don't suffice.
    The result reads a table of ``scratch`` (or else one that stays in the shared folder).
    """
    own, keep = Scratch(links.sparkSession), scratch or Scratch(links.sparkSession)
    mark = {"n": F.count("*"), "x": F.bit_xor(F.xxhash64("u", "v"))}
    ok = F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    edges, last = own.write_counted(links.where(ok).select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).distinct(), "edges", **mark)
    for _ in range(max_rounds if last["n"] else 0):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges, now = own.write_counted(small, "edges", **mark)
        if now == last:
            break
        last = now
    else:
        if last["n"]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    result = keep.write(stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    own.drop()
    return result
