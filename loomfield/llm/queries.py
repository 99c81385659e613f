"""Queries p6 to p8 and the SQL that states what SQL can state of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, work_table
from . import leakage, packing, reading_level


def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def p6_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p6_packing(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the containers, as counts: documents in them, and what breaks a rule (none may)."""
    p = p6_packing(spark, d)
    p = work_table(p, "packed")
    docs = table(spark, d, "documents")
    per = p.groupBy("container").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("items"), F.count_distinct("place").alias("places"), F.max("place").alias("last"))
    whole = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max("piece").alias("last"))
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    parts = [
        one("documents", whole), one("over_capacity", per.where(F.col("tokens") > packing.CAPACITY)), one("places_not_distinct_and_dense", per.where("items != places or last != items - 1")),
        one("documents_missing", docs.join(p, "doc_id", "left_anti")), one("cut_without_need", whole.where(F.col("pieces") != F.greatest(F.ceil(F.col("tokens") / packing.CAPACITY), F.lit(1)))), one("pieces_missing", whole.where("last != pieces - 1")),
        one("half_empty_pairs", per.where(F.col("tokens") * 2 <= packing.CAPACITY).agg((F.count(F.lit(1)) > 1).alias("bad")).where("bad")),
    ]
    return reduce(DataFrame.unionByName, parts)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_per_item(spark: SparkSession, d: str) -> DataFrame:
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))


def p7_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """Of the pairs found those whose document holds the item's text to the letter; the SQL looks for such pairs by itself."""
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", F.col("text").alias("item"))
    return p7_found(spark, d).join(docs, "doc_id").join(items, "item_id").where(F.contains("text", "item") & (F.size(F.split(F.trim("item"), r"\s+")) >= 12)).select("doc_id", "item_id")


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).groupBy("lang", "level").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"), F.avg("score").alias("mean_score"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the levels, as counts of what breaks a rule: one row a document, a level on the scale, enough words, and no document that is short as a whole."""
    got = work_table(_levels(spark, d), "levels")
    docs = table(spark, d, "documents").select("doc_id", F.size(F.split(F.trim("text"), r"\s+")).alias("pieces"))
    one = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
    parts = [
        one("repeated_documents", got.groupBy("doc_id").count().where("count > 1")), one("off_the_scale", got.where("level not between 1 and 4 or level is null")), one("too_few_words", got.where("n_words < 100")),
        one("short_texts", got.join(docs, "doc_id").where("pieces < 20")), one("unknown_documents", got.join(docs, "doc_id", "left_anti")),
    ]
    return reduce(DataFrame.unionByName, parts)


QUERIES = {f.__name__: f for f in (p6_packing, p6_summary, p6_invariants, p7_found, p7_per_item, p7_verbatim, p8_found, p8_profile, p8_invariants)}


def _none(*rules: str) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS rule, 0::BIGINT AS n" for r in rules)


ORACLE: dict[str, str] = {
    "p6_invariants": "SELECT 'documents' AS rule, count(DISTINCT doc_id) AS n FROM documents UNION ALL " + _none("over_capacity", "places_not_distinct_and_dense", "documents_missing", "cut_without_need", "pieces_missing", "half_empty_pairs"),
    "p7_verbatim": "SELECT d.doc_id, i.item_id FROM documents d JOIN eval_items i ON contains(d.text, i.text) WHERE len(regexp_split_to_array(trim(i.text), '\\s+')) >= 12",
    "p8_invariants": _none("repeated_documents", "off_the_scale", "too_few_words", "short_texts", "unknown_documents"),
}
