"""Rule sets as rows of a table, by version, and two versions compared over one corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators.conflicts import containment_maximal
from lexloom.operators.spans import VERSIONS, Rule, extract

RULE = "version string, position int, name string, pattern string, method string, law_group int, emits array<struct<text:string,target:string,type:string,confidence:double,start_group:int>>"


def rule_table(spark: SparkSession) -> DataFrame:
    """The library's rule sets as rows; the same shape may be kept as a table and edited."""
    rows = [(version, i, r.name, r.pattern, r.method, r.law_group, list(r.rows)) for version, rules in VERSIONS.items() for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE)


def rules_of(table: DataFrame, version: str) -> tuple[Rule, ...]:
    """A version's rules in order; a table of rules is small (patterns of a language, not of a corpus)."""
    rows = table.where(F.col("version") == version).orderBy("position").collect()
    if not rows:
        raise ValueError(f"no rules of version {version}")
    return tuple(Rule(r.name, r.pattern, tuple(tuple(e) for e in r.emits), r.method, r.law_group) for r in rows)


def collected(docs: DataFrame, table: DataFrame, version: str) -> DataFrame:
    """The collect pass: every match of a version's rules."""
    return extract(docs, rules_of(table, version)).withColumn("version", F.lit(version))


def settled(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The resolve pass: of a document's matches, those that lie in no other; the earlier rule's of equal ones."""
    return containment_maximal(spans, key)


def compare_versions(docs: DataFrame, table: DataFrame, first: str, second: str, key: str = "doc_id") -> DataFrame:
    """(key, start, end, type, status): spans that both versions settle on, or only the first or second."""
    at = [key, "start", "end", "type"]
    texts = docs.select(key, "text")
    found = collected(texts, table, first).unionByName(collected(texts, table, second)).select(*at, "seq", "version")
    # one exchange, by document, serves the two windows and the comparison
    kept = containment_maximal(found.repartition(F.col(key)), [key, "version"])
    flags = [F.max(F.col("version") == v).alias(flag) for v, flag in ((first, "_a"), (second, "_b"))]
    return kept.groupBy(*at).agg(*flags).select(*at, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first").otherwise("second").alias("status"))
