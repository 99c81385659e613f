import itertools
import random
from datetime import datetime

import pytest
from loomfield.operators.schema_drift import COST, Leaf, best_assignment, edit_distance, edit_script, neighbours_in_order, read_unified, schema_changes, unified_variables, unify_schemas, wider_type
from pyspark.sql import types as T

V = "series_id long, round_no int, delivery_id long, fid string, ddi_pos int, name string, label string, type string, ddi_width int, loaded_at timestamp_ntz"


def brute_distance(old, new):
    """Least cost over all one-to-one pairings of fields that are alike at all; equal places are kept."""
    kept = {(a.parent, a.name) for a in old} & {(b.parent, b.name) for b in new}
    fixed = 0.0
    for a in old:
        for b in new:
            if (a.parent, a.name) == (b.parent, b.name):
                fixed += (a.type != b.type) * COST["type"] + (a.width != b.width) * COST["width"]
    old, new = [a for a in old if (a.parent, a.name) not in kept], [b for b in new if (b.parent, b.name) not in kept]

    def pair(a, b):
        base = COST["renamed"] if a.parent == b.parent and a.words and a.words == b.words else COST["moved"] if a.name == b.name else None
        return None if base is None else base + (a.type != b.type) * COST["type"] + (a.width != b.width) * COST["width"]

    best = float("inf")
    for m in range(min(len(old), len(new)) + 1):
        for xs in itertools.combinations(range(len(old)), m):
            for ys in itertools.permutations(range(len(new)), m):
                costs = [pair(old[i], new[j]) for i, j in zip(xs, ys)]
                if None not in costs:
                    best = min(best, sum(costs) + len(old) + len(new) - 2 * m)
    return fixed + best


@pytest.mark.parametrize("seed", range(150))
def test_distance_is_least(seed):
    """Fields of two files that both versions have, with types and widths that vary: the pairing of least cost."""
    r = random.Random(seed)

    def tree():
        got = {}
        for _ in range(r.randrange(8)):
            leaf = Leaf((r.choice("FG"),), r.choice("abcdefg"), r.choice(["", "w x", "w x", "y"]), r.choice("tu"), r.choice([1, 2, None]), r.randrange(9))
            got.setdefault(leaf.path, leaf)
        for f in "FG":
            got.setdefault((f, "kept"), Leaf((f,), "kept", "", "t", 1))
        return list(got.values())

    old, new = tree(), tree()
    assert edit_distance(old, new) == pytest.approx(brute_distance(old, new))


def test_like_pairs_come_first():
    leaf = lambda n, t, w, pos: Leaf(("F",), n, "words", t, w, pos)
    assert edit_distance([leaf("a", "num", 5, 0), leaf("b", "char", 3, 1)], [leaf("c", "char", 3, 0), leaf("d", "num", 5, 1)]) == 2.0
    many = [leaf(f"o{i}", "num" if i % 3 else "char", i % 7, i) for i in range(300)]
    assert edit_distance(many, [leaf(f"n{i}", x.type, x.width, i) for i, x in enumerate(reversed(many))]) == 300.0


@pytest.mark.parametrize("seed", range(60))
def test_assignment_is_best(seed):
    r = random.Random(seed)
    n, m = r.randrange(1, 6), r.randrange(1, 6)
    saving = [[max(0.0, r.uniform(-2, 5)) for _ in range(m)] for _ in range(n)]
    got = best_assignment(saving)
    best = max(sum(saving[i][j] for i, j in zip(rows, cols)) for k in range(min(n, m) + 1) for rows in itertools.combinations(range(n), k) for cols in itertools.permutations(range(m), k))
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got) and sum(saving[i][j] for i, j in got) == pytest.approx(best)


def test_groups_are_renamed_moved_added_and_removed():
    fields = lambda parent, names, t="n": [Leaf(parent, x, "", t, 1, i) for i, x in enumerate(names)]
    ops = lambda a, b: sorted((e.op, (e.new or e.old).path) for e in edit_script(a, b))
    old = fields((), "k") + fields(("g",), "abcde") + fields(("g", "in"), "xy")
    assert ops(old, fields((), "k") + fields(("h",), "abcde") + fields(("h", "in"), "xy")) == [("renamed", ("h",))]
    assert edit_distance(old, fields((), "k") + fields(("h",), "abcde") + fields(("h", "in"), "xy")) == 1.0
    assert ops(old, fields((), "k") + fields(("h",), "abcd") + fields(("h", "deep"), "xyz", "m")) == sorted([("renamed", ("h",)), ("removed", ("g", "e")), ("renamed", ("h", "deep")), ("added", ("h", "deep", "z")), ("type", ("h", "deep", "x")), ("type", ("h", "deep", "y"))])
    assert ops(old, fields((), "k") + fields(("g",), "abcde") + fields(("other", "in"), "xy")) == sorted([("moved", ("other", "in")), ("added", ("other",))])
    assert ops(fields(("g",), "a"), fields(("h",), "b")) == sorted([("removed", ("g",)), ("removed", ("g", "a")), ("added", ("h",)), ("added", ("h", "b"))])
    # two groups swap their likeness: the assignment finds who is who
    a = fields(("p",), "abc") + fields(("q",), "def")
    assert ops(a, fields(("r",), "def") + fields(("s",), "abc")) == [("renamed", ("r",)), ("renamed", ("s",))]


def test_script_of_a_small_change():
    old = [Leaf(("F1",), "a", "same words", "n", 2, 0), Leaf(("F1",), "b", "", "n", 2, 1), Leaf(("F1",), "c", "x", "n", 2, 2)]
    new = [Leaf(("F1",), "A", "same words", "s", 2, 0), Leaf(("F2",), "c", "x", "n", 3, 0), Leaf(("F1",), "d", "", "n", 1, 1)]
    assert sorted((e.op, (e.new or e.old).name) for e in edit_script(old, new)) == [("added", "F2"), ("added", "d"), ("moved", "c"), ("removed", "b"), ("renamed", "A"), ("type", "A"), ("width", "c")]
    assert sorted(e.op for e in edit_script(old, new, moves=False)) == ["added", "added", "removed", "removed", "renamed", "type"]
    assert edit_script(old, old) == [] and edit_script([], []) == []


def frame(spark, rows):
    t = lambda n: datetime(2020, 1, 1 + n)
    return spark.createDataFrame([(s, r, d, f, p, n, lab, ty, w, t(at)) for s, r, d, f, p, n, lab, ty, w, at in rows], V)


def test_changes(spark):
    rows = [
        (1, 1, 10, "F1", 0, "a", "One  word", "num", 2, 0), (1, 1, 10, "F1", 0, "a", "One  word", "num", 2, 5), (1, 1, 10, "F1", 1, "b", None, None, 3, 0),
        (1, 3, 11, "F1", 0, "draft", "x", "num", 2, 1), (1, 3, 12, "F1", 0, "A", "one_word.", " Numeric", 4, 2), (1, 3, 12, "F1", 1, "b", None, "CHAR", None, 2),
        (1, 4, 13, "F1", 0, "A", "one word", "character", 4, 3), (2, 1, 20, "F1", 0, "z", "", "num", 1, 0), (None, 1, 1, "F1", 0, "q", "", "num", 1, 0), (1, 4, 13, None, 0, "n", "", "num", 1, 3),
    ]
    got = sorted((r["series_id"], r["fid"], r["round_no"], r["change"], r["name"]) for r in schema_changes(frame(spark, rows)).collect())
    assert got == [(1, "", 4, "added", "n"), (1, "F1", 3, "renamed", "A"), (1, "F1", 3, "width", "A"), (1, "F1", 3, "width", "b"), (1, "F1", 4, "removed", "b"), (1, "F1", 4, "type", "A")]
    assert schema_changes(frame(spark, rows[:0])).count() == 0


def test_names_are_followed_over_rounds(spark):
    rows = [(1, r, r, "F1", 0, f"n{r // 2}", "same words", "num" if r < 5 else "char", r, r) for r in range(1, 9)]
    rows += [(1, r, r, "F1", 1, "comes", "", "num", 1, r) for r in (1, 2, 6)] + [(2, 3, 30, "F1", 0, "alone", None, None, None, 1)]
    got = {(r["series_id"], r["round_no"], r["name"]): (r["variable"], r["unified_type"], r["unified_width"]) for r in unified_variables(frame(spark, rows)).collect()}
    assert got == {(1, r, f"n{r // 2}"): ("n4", "character", 8) for r in range(1, 9)} | {(1, r, "comes"): ("comes", "numeric", 1) for r in (1, 2, 6)} | {(2, 3, "alone"): ("alone", "character", None)}
    assert unified_variables(frame(spark, rows[:0])).count() == 0


def test_neighbours_in_order_over_blocks(spark):
    r = random.Random(1)
    rows = [("hot", r.randrange(-300, 300)) for _ in range(200)] + [("b", 5)]
    want = set()
    for k in ("hot", "b"):
        xs = sorted({n for q, n in rows if q == k})
        want |= set(zip([k] * len(xs), xs, [None, *xs], [*xs[1:], None]))
    got = neighbours_in_order(spark.createDataFrame(sorted(set(rows)), "k string, n int"), "k", "n", block=16)
    assert {tuple(x) for x in got.collect()} == want


def test_files_of_drifting_schemas_read_as_one_table(spark, tmp_path):
    f = lambda n, t, label="": T.StructField(n, t, True, {"label": label} if label else {})
    s1 = T.StructType([f("id", T.IntegerType()), f("amt", T.IntegerType(), "Loan amount"), f("gone", T.StringType()), f("g", T.StructType([f("x", T.IntegerType())]))])
    s2 = T.StructType([f("amount", T.LongType(), "loan AMOUNT"), f("id", T.IntegerType()), f("extra", T.DoubleType()), f("h", T.StructType([f("x", T.IntegerType())]))])
    for n, rows, s in (("a", [(1, 5, "g", (7,))], s1), ("b", [(2, 6, "h", (8,))], s1), ("c", [(9, 3, 0.5, (9,))], s2)):
        spark.createDataFrame(rows, s).write.parquet(str(tmp_path / n))
    df, scripts = read_unified(spark, [str(tmp_path / n) for n in "abc"])
    assert [sorted(e.op for e in s) for s in scripts] == [["added", "removed", "renamed", "renamed", "type"]]
    assert dict(df.dtypes) == {"id": "int", "amount": "bigint", "gone": "string", "h_x": "int", "extra": "double"}
    assert sorted(tuple(r) for r in df.select("id", "amount", "gone", "h_x", "extra").collect()) == [(1, 5, "g", 7, None), (2, 6, "h", 8, None), (3, 9, None, 9, 0.5)]


def test_a_field_that_comes_back_is_the_same_field():
    s = lambda *ns: T.StructType([T.StructField(n, T.StringType()) for n in ns])
    target, _ = unify_schemas([s("a", "b"), s("a"), s("a", "b")])
    assert [n for _, _, n in target.fields] == ["a", "b"]
    assert wider_type("int", "bigint") == "bigint" and wider_type("int", "string") == "string" and wider_type("bigint", "float") == "double"


def test_schemas_that_come_back_share_a_scan(spark, tmp_path):
    """Files A, B, A, B: two scans; dots and clashing names in fields stay apart."""
    a, b = "`a.b` int, g struct<b: int>, g_b int", "`a.b` int, g struct<b: int>, g_b int, more string"
    for i, (rows, s) in enumerate([([(1, (2,), 3)], a), ([(4, (5,), 6, "x")], b), ([(7, (8,), 9)], a), ([(10, (11,), 12, "y")], b)]):
        spark.createDataFrame(rows, s).write.parquet(str(tmp_path / str(i)))
    df, scripts = read_unified(spark, [str(tmp_path / str(i)) for i in range(4)])
    assert [[e.op for e in s] for s in scripts] == [["added"], ["removed"], ["added"]]
    assert df.columns == ["a.b", "g_b", "g_b_2", "more"]
    assert sorted(tuple(r) for r in df.collect()) == [(1, 2, 3, None), (4, 5, 6, "x"), (7, 8, 9, None), (10, 11, 12, "y")]
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 2
