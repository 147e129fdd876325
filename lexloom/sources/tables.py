"""The engine's logical tables over the star-schema files: laws, versions, articles, nodes and citation edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edge types by the flag of the row an edge comes from.
EDGE_TYPES = {"A": "APPLIES", "N": "REFERENCES", "R": "REPLACES"}
#: About so many mentions go to one task where edges are made of them.
MENTIONS_A_TASK = 500_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("law_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("law_type"), F.col("c_nationkey").alias("ministry"), F.col("c_acctbal").alias("score"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("version_id"), F.col("o_custkey").alias("law_id"), F.col("o_orderdate").alias("version_date"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("change_type"), F.col("o_totalprice").alias("size"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = read(spark, sf_dir, "lineitem")
    return i.select(F.col("l_orderkey").alias("version_id"), F.col("l_linenumber").alias("article_number"), F.col("l_partkey").alias("node_id"), F.col("l_suppkey").alias("chapter"), F.col("l_quantity").alias("length"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"), F.col("l_shipdate").alias("enforced"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("node_id"), F.col("p_brand").alias("law"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"), F.col("p_size").alias("number"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (src, dst, rel_type): the strongest confidence, the first position, how many mentions.

    The mentions are dealt by ``src`` before they are grouped: hardly any two share a group, so grouping them in the tasks that
    read them would hold a whole file split in memory. The number of tasks follows the rows, so that none grows with the table.
    """
    i = read(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_returnflag", "l_discount", "l_quantity")
    count = read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    tasks = max(i.count() // MENTIONS_A_TASK + 1, spark.sparkContext.defaultParallelism)
    kind = F.create_map(*[F.lit(x) for kv in EDGE_TYPES.items() for x in kv])
    # the one-row count is a scalar, so joining it multiplies nothing
    return (
        i.join(F.broadcast(count))
        .select(F.col("l_partkey").alias("src"), (F.col("l_orderkey") % F.col("n")).alias("dst"), kind[F.col("l_returnflag")].alias("rel_type"), F.round(0.5 + 5 * F.col("l_discount"), 2).alias("c"), "l_quantity")
        .repartition(tasks, "src")
        .groupBy("src", "dst", "rel_type")
        .agg(F.max("c").alias("confidence"), F.min("l_quantity").alias("position"), F.count("*").alias("mentions"))
    )


#: The same tables for the DuckDB side.
SQL = {
    "laws": "SELECT c_custkey AS law_id, c_name AS title, c_mktsegment AS law_type, c_nationkey AS ministry, c_acctbal AS score FROM customer",
    "versions": "SELECT o_orderkey AS version_id, o_custkey AS law_id, o_orderdate AS version_date, o_orderstatus AS status, o_orderpriority AS change_type, o_totalprice AS size FROM orders",
    "articles": "SELECT l_orderkey AS version_id, l_linenumber AS article_number, l_partkey AS node_id, l_suppkey AS chapter, l_quantity AS length, l_returnflag AS flag, l_linestatus AS line_status, l_shipdate AS enforced FROM lineitem",
    "nodes": "SELECT p_partkey AS node_id, p_brand AS law, p_name AS title, p_type AS kind, p_size AS number FROM part",
    "edges": "SELECT l_partkey AS src, l_orderkey % (SELECT count(*) FROM part) AS dst, CASE l_returnflag WHEN 'A' THEN 'APPLIES' WHEN 'N' THEN 'REFERENCES' ELSE 'REPLACES' END AS rel_type, max(round(0.5 + 5 * l_discount, 2)) AS confidence, min(l_quantity) AS position, count(*) AS mentions FROM lineitem GROUP BY ALL",
}


def with_tables(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` with the named tables before it; a query that begins with WITH goes on in the same clause."""
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    body = sql.strip()
    head = "WITH RECURSIVE" if recursive else "WITH"
    return f"{head} {parts}, {body[5:]}" if body.startswith("WITH ") else f"{head} {parts} {body}"
