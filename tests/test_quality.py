import random

import numpy as np
import pytest
from loomfield.operators.quality_profile import ProfileSpec, bound_issues, bound_profiles, cell_violations, column_profiles, classified, load_issues, load_pairs, load_profiles, screen_auc, value_counts
from loomfield.operators.load_classifier import discrimination
from loomfield.operators.running import running_sums

SPEC = ProfileSpec({"x": (0.0, 1000.0), "w": (None, None)})
S = "rec_no long, load_id string, office string, load_seq int, x string, w string"


def ks(a, b):
    pts = sorted(set(a) | set(b))
    return max(abs(np.mean(np.array(a) <= p) - np.mean(np.array(b) <= p)) for p in pts)


def loads(seed):
    """Loads whose column x shifts, spreads, narrows or stays, with blanks and faults."""
    r = random.Random(seed)
    rows, vals, n = [], {}, 0
    for office in range(6):
        for seq in range(1, 6):
            mid, wide, size = r.choice([300, 300, 360, 500]), r.choice([40, 40, 10, 90]), r.choice([10, 25, 80, 200])
            own = []
            for _ in range(size):
                v = min(1000, max(0, int(r.gauss(mid, wide))))
                cell = r.choices([str(v), f" {v} ", "", None, "1e3", "-1", "2000"], [60, 20, 3, 3, 2, 2, 2])[0]
                if cell and cell.strip() == str(v):
                    own.append(v)
                n += 1
                rows.append((n, f"L{office}-{seq}", f"O{office}", seq, cell, "7" if (office, seq) == (1, 2) else str(r.randrange(50))))
            vals[office, seq] = own
    return rows, vals


@pytest.mark.parametrize("seed", range(2))
def test_shifts_are_all_found(spark, seed):
    rows, vals = loads(seed)
    df = spark.createDataFrame(rows, S)
    issues, _, model = load_issues(classified(df, SPEC), SPEC)
    got = {r["load_id"] for r in issues.where("issue = 'shift' and column_name = 'x'").collect()}
    want = {f"L{o}-{s}" for (o, s), v in vals.items() if (o, s - 1) in vals and len(v) >= 20 and len(vals[o, s - 1]) >= 20 and ks(v, vals[o, s - 1]) > 0.25}
    assert got == want and want
    assert {r["load_id"] for r in issues.where("issue = 'constant'").collect()} <= {"L1-2"}
    for r in model.where("col = 'x'").collect():
        o, s = map(int, r["load"][1:].split("-"))
        gap = ks(vals[o, s], vals[o, s - 1]) if vals[o, s] and vals[o, s - 1] else 0
        assert r["auc_fitted"] >= 0.5 + (gap - 1 / 16) / 2 - 1e-9
    assert 0.5 < screen_auc(SPEC) < 0.6


def test_cells_loads_and_nulls(spark):
    rows = [(i, "A", "o", 1, None if i < 4 else "5", "5") for i in range(24)] + [(30, None, None, None, "x1", "-3"), (31, "A", "o", 1, "1001", "9" * 60)]
    df = spark.createDataFrame(rows, S)
    c = classified(df, SPEC)
    assert sorted(tuple(r) for r in cell_violations(c, SPEC).collect()) == [("x", "pattern", 30), ("x", "range", 31)]
    issues, profiles, _ = load_issues(c, SPEC)
    assert sorted((r[0], r[1], r[2]) for r in issues.collect()) == [("x", "constant", "A"), ("x", "missing", "A")]
    p = {(r["load"], r["col"]): r for r in profiles.collect()}
    assert (p["A", "x"]["rows"], p["A", "x"]["blank"], p["A", "x"]["range"], p["A", "x"]["valid"], p["A", "x"]["distinct"]) == (25, 4, 1, 20, 1)
    empty = classified(df.limit(0), SPEC)
    assert cell_violations(empty, SPEC).count() == 0 and load_issues(empty, SPEC)[0].count() == 0


def test_model_tells_which_column_changed(spark):
    r = random.Random(5)
    rows = [(i, f"L{s}", "o", s, str(r.randrange(100) + 300 * s), str(r.randrange(100))) for s in (1, 2) for i in range(s * 1000, s * 1000 + 400)]
    c = classified(spark.createDataFrame(rows, S), SPEC)
    counts = value_counts(c, SPEC)
    got = {x["col"]: x for x in discrimination(c, counts, load_pairs(load_profiles(counts)), SPEC).collect()}
    assert got["x"]["auc_alone"] > 0.95 and abs(got["w"]["auc_alone"] - 0.5) < 0.1
    assert got["x"]["auc_without"] < 0.6 and got["w"]["auc_without"] > 0.95


def test_bounds(spark):
    df = spark.createDataFrame([(1, 5.0, 4.0, 3), (2, None, 100.0, 2), (3, 1.0, None, 2), (4, 0.0, 99.0, 2), (5, float("nan"), float("nan"), None)], "rec_no long, rng_min double, rng_max double, ddi_width int")
    assert sorted(tuple(r) for r in bound_issues(df).collect()) == [("rng_max", "too_wide", 2), ("rng_min", "inverted", 1)]


def test_profiles_of_bounds(spark):
    nan = float("nan")
    rows = [(1, 0.0, 9.0, 1), (2, 0.0, 10.0, 1), (3, 5.0, 1.0, 2), (4, None, 99.0, 2), (5, None, None, 3), (6, nan, 7.0, None), (7, 3.0, nan, 1), (8, -2.0, 1e9, 3)]
    df = spark.createDataFrame(rows, "rec_no long, rng_min double, rng_max double, ddi_width int")
    got = {r["column_name"]: tuple(r)[1:] for r in bound_profiles(df).collect()}
    assert set(got) == {"rng_min", "rng_max"}
    assert got["rng_min"][:2] == (8, 3) and got["rng_min"][3:] == (0, 4, -2.0, 5.0)
    assert got["rng_max"] == (8, 2, 0, 2, 6, 1.0, 1e9)
    issues = [tuple(r) for r in bound_issues(df).collect()]
    assert got["rng_min"][2] == sum(i == "inverted" for _, i, _ in issues) and got["rng_max"][3] == sum(i == "too_wide" for _, i, _ in issues)
    assert bound_profiles(df.limit(0)).count() == 0


def test_running_sums_over_many_ranges(spark):
    """One group over all ranges, others within one; against sums in a loop."""
    r = random.Random(2)
    rows = sorted({("hot" if r.random() < 0.7 else r.choice("abc"), r.randrange(10_000)) for _ in range(3_000)})
    rows = [(k, v, r.randrange(5)) for k, v in rows]
    got = {(x["k"], x["v"]): (x["cum_n"], x["all_n"]) for x in running_sums(spark.createDataFrame(rows, "k string, v int, n long"), ["k"], "v", ["n"]).collect()}
    total, seen = {}, {}
    for k, _, n in rows:
        total[k] = total.get(k, 0) + n
    for k, v, n in rows:
        seen[k] = seen.get(k, 0) + n
        assert got[k, v] == (seen[k], total[k])
    assert len(got) == len(rows)


def test_many_columns_and_a_change_seen_only_jointly(spark):
    """Thirty columns: the model of all sums up small changes, and ablation names the column that changed most."""
    r = random.Random(9)
    spec = ProfileSpec({f"c{i}": (None, None) for i in range(30)})
    rows = []
    for s in (1, 2):
        for i in range(600):
            rows.append((s * 1000 + i, f"L{s}", "o", s, *[str(int(r.gauss(500 + (s == 2) * (400 if c == 7 else 60 if c % 3 == 0 else 0), 200))) for c in range(30)]))
    df = spark.createDataFrame(rows, "rec_no long, load_id string, office string, load_seq int, " + ", ".join(f"c{i} string" for i in range(30)))
    c = classified(df, spec)
    counts = value_counts(c, spec)
    got = {x["col"]: x for x in discrimination(c, counts, load_pairs(load_profiles(counts)), spec).collect()}
    assert len(got) == 30 and got["c7"]["auc_all"] > 0.88 
    assert min(got.values(), key=lambda x: x["auc_without"])["col"] == "c7" and got["c7"]["auc_all"] - got["c7"]["auc_without"] > 0.1


def test_every_column_is_profiled(spark):
    rows = [("a ", 1, 1.5, None), (None, 1, float("nan"), None), (" ", None, 2.0, None), ("10", 3, None, None), ("-2.50", 3, None, None)]
    df = spark.createDataFrame(rows, "x string, X int, y double, z timestamp_ntz")
    got = {r[0]: tuple(r)[1:] for r in column_profiles(df).collect()}
    assert got == {"x": (5, 2, 3, "-2.50", "a", 5, 1, 1), "X": (5, 1, 2, "1", "3", 1, 4, 0), "y": (5, 3, 2, "1.5", "2", 3, 1, 1), "z": (5, 5, 0, None, None, None, 0, 0)}
    assert column_profiles(df.limit(0)).count() == 0
