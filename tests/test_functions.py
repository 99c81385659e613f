import os
import random

import pytest
from loomfield.functions import names
from loomfield.functions.text import micros, trimmed, words_of
from loomfield.session import local_path, pick, release_work_tables, shared_dir, work_table, work_tables_released
from loomfield.sources.container import double_text
from pyspark.sql import functions as F


def test_texts_of_doubles_agree_with_the_decoder(spark):
    r = random.Random(0)
    xs = [0.0, -0.0, 1.0, -1e-9, 0.1 + 0.2, 2.0**60, 1.0000015, 1 / 3, -2.5] + [r.uniform(-1e9, 1e9) for _ in range(500)] + [r.randrange(10**6) / 128 for _ in range(500)] + [r.uniform(-1, 1) * 10.0 ** r.randrange(8, 38) for _ in range(2000)] + [2.0**53 - 0.5, 9e9 + 1 / 3, 2.0**62, 2.0**63, -(2.0**64) - 2.0**13, 123456789012.9999999] + [round(r.uniform(0, 1e5), 2) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [(r["x"], r["t"]) for r in df.select("x", names.double_text(F.col("x")).alias("t")).collect()] == [(x, double_text(x, 0)) for x in xs]
    assert [(r["x"], r["t"]) for r in df.select("x", names.double_text(F.col("x"), 9).alias("t")).collect()] == [(x, double_text(x, 9)) for x in xs]
    odd = spark.createDataFrame([(None,), (float("nan"),), (1.7976931348623157e308,), (float("inf"),), (1e300,), (1e10 + 0.5,), (float("-inf"),)], "x double")
    assert [r[0] for r in odd.select(names.double_text(F.col("x"))).collect()] == ["", "", "", "", None, "10000000000.5", None]


def test_cells_words_and_times(spark):
    df = spark.createDataFrame([("\t a b\n", "One_Word - ÉTÉ:", "2020-01-01 00:00:01.000002"), (None, None, None), ("", " .", None)], "a string, b string, c string")
    got = df.select(trimmed(F.col("a")), words_of(F.col("b")), micros(F.col("c").cast("timestamp_ntz"))).collect()
    assert [tuple(r) for r in got] == [("a b", "one word été", 1577836801000002), (None, "", None), ("", "", None)]


def test_padding_and_quotes(spark):
    df = spark.createDataFrame([("ab",), ('x"y',), ("a\tb",), ("",)], "a string")
    assert [r[0] for r in df.select(names.padded(F.col("a"), 3)).collect()] == ["ab ", 'x"y', "a\tb", "   "]
    assert [r[0] for r in df.select(names.quoted(F.col("a"), "\t")).collect()] == ["ab", '"x""y"', '"a\tb"', ""]


def test_work_tables_and_picking(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A int, b int")
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        assert [tuple(r) for r in pick(df, "A", "b").collect()] == [(2, 3)]
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")
    assert shared_dir(spark).startswith("file:///")
    t = work_table(spark.range(5), "t")
    assert t.count() == 5 and "Range" not in t._jdf.queryExecution().optimizedPlan().toString()
    with work_tables_released(spark):
        inner = work_table(spark.range(3), "inner")
        assert inner.count() == 3
    assert t.count() == 5 and not os.path.exists(local_path(os.path.dirname(inner.inputFiles()[0])))
    assert release_work_tables(spark) >= 1


def test_only_local_paths_are_opened_by_hand():
    assert [local_path(p) for p in ("/a/b c", "file:///a/b", "file:/a/b", "file:///a%20b")] == ["/a/b c", "/a/b", "/a/b", "/a b"]
    for p in ("hdfs://h/a", "s3a://b/a", "file://host/a"):
        with pytest.raises(ValueError):
            local_path(p)
