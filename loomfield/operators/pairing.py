"""Pairing converted tables with export files by name."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_stem(text: str) -> str:
    return text.lower().replace("_", "")


def plain_export(text: str) -> str:
    return text.lower().replace("-", "").replace("_", "").replace(" ", "")


def best_export(stem: str, exports: list[Path]) -> Path | None:
    """The export whose plain name contains, or lies in, the table's; the longest overlap wins, then the first."""
    a = plain_stem(stem)
    scored = [(min(len(a), len(b)), -i) for i, p in enumerate(exports) if (b := plain_export(p.stem)) in a or a in b]
    best = max(scored, default=(0, 0))
    return exports[-best[1]] if best[0] > 0 else None


def _parts_of(c: Column) -> Column:
    """All distinct substrings of a name; of a name of n letters at most n (n + 1) / 2."""
    n = F.char_length(c)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(c, i, k)))
    return F.array_distinct(F.flatten(cut))


def pair_names(stems: DataFrame, stem: str, exports: DataFrame, export: str) -> DataFrame:
    """(stem, export, score) for each stem with a match, over tables of names.

    One name lies in another if it equals one of the other's substrings, so
    both directions are joins on equality and no pair of unlike names is
    formed. Null names and names without letters match nothing.
    """
    a = stems.select(F.col(stem).alias("stem")).distinct().withColumn("a", F.replace(F.lower("stem"), F.lit("_"), F.lit(""))).where("a != ''")
    b = exports.select(F.col(export).alias("export")).distinct().withColumn("b", F.translate(F.lower("export"), "-_ ", "")).where("b != ''")
    export_in_stem = a.select("stem", "a", F.explode(_parts_of(F.col("a"))).alias("b")).join(b, "b")
    stem_in_export = b.select("export", "b", F.explode(_parts_of(F.col("b"))).alias("a")).join(a, "a")
    both = export_in_stem.select("stem", "export", F.char_length("b").alias("score")).unionByName(stem_in_export.select("stem", "export", F.char_length("a").alias("score")))
    best = both.groupBy("stem").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("export").alias("e"))).alias("best"))
    return best.select("stem", F.col("best.e").alias("export"), (-F.col("best.s")).cast("long").alias("score"))
