"""Law-name dictionaries: titles, abbreviations, law numbers, and lookups by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.japanese import law_number_to_id, title_abbreviations

#: Abbreviations in use, full title and law id.
COMMON = (
    ("憲法", "日本国憲法", "321CONSTITUTION"), ("民法", "民法", "129AC0000000089"), ("商法", "商法", "132AC0000000048"), ("刑法", "刑法", "140AC0000000045"),
    ("会社法", "会社法", "417AC0000000086"), ("民訴法", "民事訴訟法", "408AC0000000109"), ("刑訴法", "刑事訴訟法", "323AC0000000131"), ("労基法", "労働基準法", "322AC0000000049"),
)


def build(laws: DataFrame) -> DataFrame:
    """(name, law_id, source) from laws (law_id, title, law_number, position): the last title wins, the first abbreviation."""
    titles = laws.groupBy(F.col("title").alias("name")).agg(F.max_by("law_id", "position").alias("law_id")).withColumn("source", F.lit("title"))
    short = laws.select("law_id", "position", F.posexplode(title_abbreviations("title")).alias("n", "name"))
    short = short.groupBy("name").agg(F.min_by("law_id", F.struct("position", "n")).alias("law_id")).withColumn("source", F.lit("abbreviation"))
    numbers = laws.where("law_number is not null").groupBy(F.col("law_number").alias("name")).agg(F.max_by("law_id", "position").alias("law_id")).withColumn("source", F.lit("number"))
    return titles.unionByName(short).unionByName(numbers)


def resolve_names(mentions: DataFrame, dictionary: DataFrame, name: str = "name") -> DataFrame:
    """``mentions`` with law_id by title, then abbreviation, then law number, then the id that the law number spells."""
    by = lambda s: dictionary.where(F.col("source") == s).select(F.col("name").alias(name), F.col("law_id").alias(f"_{s}"))
    out = mentions
    for s in ("title", "abbreviation", "number"):
        out = out.join(by(s), name, "left")
    return out.withColumn("law_id", F.coalesce("_title", "_abbreviation", "_number", law_number_to_id(name))).drop("_title", "_abbreviation", "_number")


def statistics(dictionary: DataFrame) -> DataFrame:
    return dictionary.groupBy("source").agg(F.count("*").alias("names"), F.countDistinct("law_id").alias("laws"))


def within_bounds(refs: DataFrame, bounds: DataFrame, most: int = 1000) -> DataFrame:
    """References whose article lies within its law's last article, or ``most`` where that is not known."""
    return refs.join(bounds.select("law_id", "last_article"), "law_id", "left").where(F.col("article").between(1, F.coalesce("last_article", F.lit(most)))).drop("last_article")


def latest_version(versions: DataFrame, law: str = "law_id") -> DataFrame:
    w = Window.partitionBy(law).orderBy(F.desc("version_date"), F.desc("version_id"))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
