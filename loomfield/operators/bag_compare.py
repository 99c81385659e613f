"""Multiset comparison of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STRIP_SPACE

# White space beyond ASCII that stripping removes as well.
UNICODE_SPACE = STRIP_SPACE + "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def stripped_texts(df: DataFrame) -> DataFrame:
    """Every column as stripped text, named by position; null becomes 'None', as no table of texts holds nulls."""
    cells: list[Column] = [F.btrim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None")), F.lit(UNICODE_SPACE)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    return df.select(*cells)


def bag_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both with their counts n_a, n_b; columns pair by position.

    One shuffle: both sides are counted on the map side and together.
    """
    names = a.columns
    if len(names) != len(b.columns):
        raise ValueError("tables of different width have no common rows")
    one, nil = F.lit(1).cast("long"), F.lit(0).cast("long")
    left = a.select("*", one.alias("_a"), nil.alias("_b"))
    right = b.toDF(*names).select("*", nil.alias("_a"), one.alias("_b"))
    return left.unionByName(right).groupBy(*names).agg(F.sum("_a").alias("n_a"), F.sum("_b").alias("n_b"))


def bag_difference(a: DataFrame, b: DataFrame) -> int:
    """Rows of a, with multiplicity, beyond those of b."""
    d = bag_counts(a, b).agg(F.sum(F.greatest(F.col("n_a") - F.col("n_b"), F.lit(0)))).first()[0]
    return d or 0


def bag_equal(a: DataFrame, b: DataFrame) -> bool:
    return len(a.columns) == len(b.columns) and bag_counts(a, b).where("n_a != n_b").isEmpty()
