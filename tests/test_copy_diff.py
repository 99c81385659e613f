import random

import pytest
from loomfield.functions.text import canonical_decimal
from loomfield.operators.copy_diff import CopySpec, depth_bits, diff_copies, digest_stages, range_report
from pyspark.sql import functions as F

SCHEMA = "k string, q string, x string, y string"
SPEC = CopySpec(("k", "q"), ("x", "y"), frozenset({"x"}))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_each_kind(spark):
    a = spark.createDataFrame([(" a ", "1", "07", "u"), ("b", "1", "1.50", None), ("c", "1", "5", "z"), ("c", "1", "5", "z"), ("d", "1", "1e1", "z")], SCHEMA)
    b = spark.createDataFrame([("a", "1\t", "7.", " u"), ("b", "1", "1.5", " \n"), ("c", "1", "6", "Z"), ("e", "2", "", ""), ("d", "1", "10", "z")], SCHEMA)
    assert rows(diff_copies(a, b, SPEC, ("left", "right"))) == [("c", "1", "value", "x"), ("c", "1", "value", "y"), ("d", "1", "value", "x"), ("e", "2", "only_right", "")]


def test_empty_null_and_clashing(spark):
    none = spark.createDataFrame([], SCHEMA)
    a = spark.createDataFrame([(None, None, None, None, 1, "no"), ("k", "", "3", "v" * 100_000, 2, "no")], SCHEMA + ", _leaf int, K string")
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        assert rows(diff_copies(none, none, SPEC)) == []
        assert rows(diff_copies(a, none, SPEC)) == [("", "", "only_a", ""), ("k", "", "only_a", "")]
        assert rows(diff_copies(none, a, SPEC)) == [("", "", "only_b", ""), ("k", "", "only_b", "")]
        assert rows(diff_copies(a, a, SPEC)) == []
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")


def test_several_versions_of_a_key(spark):
    a = spark.createDataFrame([("a", "1", "1", "u"), ("a", "1", "2", "u")], SCHEMA)
    b = spark.createDataFrame([("a", "1", "2", "u"), ("a", "1", "1", "u"), ("a", "1", "1", "u")], SCHEMA)
    c = spark.createDataFrame([("a", "1", "2", "u")], SCHEMA)
    assert rows(diff_copies(a, b, SPEC)) == []
    assert rows(diff_copies(a, c, SPEC)) == [("a", "1", "value", "x")]


@pytest.mark.parametrize("seed", range(3))
def test_random_against_brute_force(spark, seed):
    r = random.Random(seed)
    a = {(f"k{i}", str(r.randrange(3))): (str(r.randrange(9)), r.choice("uvw")) for i in range(600)}
    b = {k: v for k, v in a.items() if r.random() > 0.03}
    for k in list(b):
        if r.random() < 0.03:
            b[k] = (str(r.randrange(9)), r.choice("uvw"))
    for i in range(15):
        b[(f"n{i}", "1")] = ("1", "u")
    want = [(*k, "only_a", "") for k in a if k not in b] + [(*k, "only_b", "") for k in b if k not in a]
    want += [(*k, "value", f) for k in a if k in b for f, x, y in zip("xy", a[k], b[k]) if x != y]
    frame = lambda m: spark.createDataFrame([(*k, *v) for k, v in m.items()] * 2, SCHEMA)
    assert rows(diff_copies(frame(a), frame(b), SPEC)) == sorted(want)


def test_repeats_that_differ_are_no_difference(spark):
    """Rows repeated twice on one side: their exclusive-or vanishes, their sums do not; repeats alone are no difference."""
    one, two = ("a", "1", "1", "u"), ("b", "1", "1", "u")
    frame = lambda *r: spark.createDataFrame(list(r), SCHEMA)
    assert rows(diff_copies(frame(one, one), frame(two, two), SPEC)) == [("a", "1", "only_a", ""), ("b", "1", "only_b", "")]
    assert rows(diff_copies(frame(one, one, two), frame(one, two, two, two), SPEC)) == []


def test_only_differing_leaves_are_compared(spark):
    a = spark.range(4000).select(F.col("id").cast("string").alias("k"), F.lit("1").alias("q"), F.lit("1").alias("x"), F.lit("y").alias("y"))
    b = a.withColumn("y", F.when(F.col("k") == "77", "other").otherwise(F.col("y")))
    _, _, stages = digest_stages(a, b, SPEC)
    assert stages[-1].differing.count() == 1
    report = {r["level"]: (r["ranges"], r["differing"]) for r in range_report(a, b, SPEC).collect()}
    assert report[0] == (1, 1) and all(d == 1 for _, d in report.values())
    big = CopySpec(SPEC.keys, SPEC.fields, SPEC.numeric, leaf_rows=1, max_bits=20)
    _, _, stages = digest_stages(a.unionByName(a.withColumn("k", F.concat("k", F.lit("b")))), b.unionByName(a.withColumn("k", F.concat("k", F.lit("b")))), big)
    assert [s.bits for s in stages] == [12, 13] and [s.differing.count() for s in stages] == [1, 1] and stages[1].level.count() <= 2
    assert {r["level"]: r["differing"] for r in range_report(a, b, big).collect()} == dict.fromkeys(range(4), 1)
    assert rows(diff_copies(a, b, big)) == [("77", "1", "value", "y")]
    assert depth_bits(0, SPEC) == 0 and depth_bits(8, SPEC) == 0 and depth_bits(9, SPEC) == 1


def test_decimal_writings(spark):
    cases = {"007": "7", "7.": "7", "7.0": "7", "+7": "7", "-0.0": "0", ".50": "0.5", "-01.250": "-1.25", "0": "0", "00": "0", "1e3": "1e3", "1 2": "1 2", "": "", ".": ".", "-": "-", "9" * 60 + ".10": "9" * 60 + ".1", "٣": "٣"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", canonical_decimal(F.col("x"))).collect()} == cases
