"""Self-checks of a table against its codebook, in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.codebook import Block

COLUMN_TOLERANCE = 3
FEW_ROWS = 10


def column_facts(df: DataFrame) -> tuple[int, dict[str, tuple[int, bool]]]:
    """(rows, column -> (cells that are not missing, all cells alike)) from one pass.

    '' and null are missing. Lowest equal to highest tells a constant column
    without counting distinct values.
    """
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(df.columns):
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        aggs += [F.count(F.nullif(v, F.lit(""))).alias(f"k{i}"), (F.coalesce(F.min(v) == F.max(v), F.lit(True))).alias(f"s{i}")]
    r = df.agg(*aggs).first()
    return r["n"], {c: (r[f"k{i}"], r[f"s{i}"]) for i, c in enumerate(df.columns)}


def check_block(df: DataFrame, block: Block, name: str) -> dict:
    """The checks of a block: row count, column count within three, empty columns, constant columns, names.

    Empty and constant columns are told but do not fail the block.
    """
    rows, facts = column_facts(df)
    wanted = [v.name for v in block.variables]
    empty = [c for c, (k, _) in facts.items() if k == 0]
    alike = [c for c, (_, s) in facts.items() if s] if rows > FEW_ROWS else []
    row_ok = rows == block.nrecs
    col_ok = abs(len(df.columns) - len(wanted)) <= COLUMN_TOLERANCE
    name_ok = df.columns == wanted[: len(df.columns)]
    return {
        "block_name": name,
        "passed": row_ok and col_ok and name_ok,
        "checks": [
            {"check": "row_count", "expected": block.nrecs, "actual": rows, "passed": row_ok},
            {"check": "column_count", "expected": len(wanted), "actual": len(df.columns), "passed": col_ok},
            {"check": "no_all_null_columns", "all_null_columns": empty, "passed": not empty},
            {"check": "column_variance", "identical_columns": alike, "note": "for information: a column may rightly hold one value"},
            {"check": "column_names_match_ddi", "passed": name_ok},
        ],
    }


def missing_profile(df: DataFrame) -> DataFrame:
    """Per column (column_name, filled, constant) as rows, from the same single aggregate."""
    n = F.count(F.lit(1)).alias("n")
    cells = []
    for c in df.columns:
        v = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        cells.append(F.struct(F.lit(c).alias("column_name"), F.count(F.nullif(v, F.lit(""))).alias("filled"), F.coalesce(F.min(v) == F.max(v), F.lit(True)).alias("alike")))
    one = df.agg(n, F.array(*cells).alias("cells"))
    return one.select("n", F.inline("cells")).select("column_name", "filled", (F.col("alike") & (F.col("n") > FEW_ROWS)).alias("constant"))
