"""Table maintenance as whole-table DataFrame steps: upsert, insert if absent, replace a part, last write wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def insert_if_absent(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows whose key it doesn't have; of rows that share a key the least counts. Null keys match nothing."""
    fresh = least_by(rows, keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def least_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key: the least by all its other columns, so the choice does not depend on the order of arrival."""
    others = [c for c in rows.columns if c not in keys]
    if not others:
        return rows.distinct()
    return rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in others]).select(*rows.columns)


def upsert(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace target rows of the same key, column by column where not null, and others are added."""
    others = [c for c in target.columns if c not in keys]
    new = least_by(rows, keys).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in others], F.lit(True).alias("_is_new"))
    joined = target.join(new, keys, "full_outer")
    return joined.select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in others]).select(*target.columns)


def replace_part(target: DataFrame, rows: DataFrame, part: str) -> DataFrame:
    """All rows of the parts that ``rows`` has are replaced by them: delete and reload."""
    return target.join(rows.select(part).distinct(), part, "left_anti").select(*target.columns).unionByName(rows.select(*target.columns))


def single_active(versions: DataFrame, active: str, column: str = "version") -> DataFrame:
    return versions.withColumn("is_active", F.coalesce(F.col(column) == active, F.lit(False)))


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of greatest ``order`` for each key, ties by the other columns; aggregates map-side."""
    others = [c for c in rows.columns if c != key]
    first = [order, *[c for c in others if c != order]]
    return rows.groupBy(key).agg(F.max(F.struct(*first)).alias("_r")).select(key, *[F.col("_r")[c].alias(c) for c in others]).select(*rows.columns)


def record_validation(detections: DataFrame, validations: DataFrame, key: str = "id") -> DataFrame:
    """Detections with ``status`` set by the last validation: confirmed, rejected, or as it was."""
    last = last_wins(validations.select(key, "at", "is_correct"), key, "at")
    status = F.when(F.col("is_correct"), "confirmed").when(~F.col("is_correct"), "rejected").otherwise(F.col("status"))
    return detections.join(last, key, "left").withColumn("status", status).select(*detections.columns)


def publishable(detections: DataFrame) -> DataFrame:
    """Rows not validated yet or validated as correct."""
    return detections.where("status is null or status != 'rejected'")


def invalid(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to nodes that don't exist; what a clean-up would remove."""
    return edges.join(nodes.select(F.col("node_id").alias("dst")), "dst", "left_anti").select(*edges.columns)


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """Overwrite only the parts that ``df`` has; others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(part).parquet(path)


def replace_references(target: DataFrame, found: DataFrame, owner: str) -> DataFrame:
    """``target`` without the rows of any owner that ``found`` has, and the different rows of ``found``.

    An owner of which nothing was found keeps its rows: it was not read anew. Null owners keep theirs too.
    """
    kept = target.join(found.select(owner).distinct(), owner, "left_anti").select(*target.columns)
    return kept.unionByName(found.select(*target.columns).distinct())


def flat_references(nested: DataFrame) -> DataFrame:
    """Nested references (source, target, metadata) as flat columns; a field that the structs don't have is null."""
    fields = {
        "source_law": "source.structural.law_id", "source_article": "source.structural.article_number", "start": "source.position.start", "end": "source.position.end", "line": "source.position.line",
        "target_law": "target.structural.law_id", "target_article": "target.structural.article_number", "type": "metadata.type", "confidence": "metadata.confidence", "method": "metadata.method",
    }

    def there(path: str) -> bool:
        kind = nested.schema
        for name in path.split("."):
            if name not in getattr(kind, "names", ()):
                return False
            kind = kind[name].dataType
        return True

    return nested.select(*[(F.col(path) if there(path) else F.lit(None)).alias(name) for name, path in fields.items()])
