"""Reading exports: headerless tab-separated text, every cell a string."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """Columns c0.. of an export; blank lines are no rows, rows of empty cells are.

    The width is the first row's; missing cells at the end are ''. A cell in
    double quotes is unquoted. Lines are split in the JVM, file by file in
    parallel, so a cell can't hold a line end.
    """
    lines = spark.read.text(path).where("value != ''")
    head = lines.first()
    if head is None:
        return spark.createDataFrame([], "c0 string")
    width = head[0].count("\t") + 1
    cells = F.split("value", "\t", -1)
    out = lines.select(cells.alias("cells"))
    cols = []
    for i in range(width):
        c = F.coalesce(F.get(F.col("cells"), F.lit(i)), F.lit(""))
        inner = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        cols.append(F.when(c.rlike('^".*"$') & (F.length(c) > 1), inner).otherwise(c).alias(f"c{i}"))
    return out.select(*cols)
