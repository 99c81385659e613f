import random
from datetime import datetime, timedelta

import pytest
from loomfield.operators.orphan_refs import References, orphan_references, orphan_report

P = "k string, loaded timestamp_ntz, deleted timestamp_ntz"
R = "rec long, k string, at timestamp_ntz, period string"
T0 = datetime(2020, 1, 1)


def at(n):
    return None if n is None else T0 + timedelta(microseconds=n)


def run(spark, parents, refs, size=250_000):
    p = spark.createDataFrame([(k, at(a), at(b)) for k, a, b in parents], P)
    r = spark.createDataFrame([(i, k, at(t), str(i % 3)) for i, (k, t) in enumerate(refs)], R)
    got = orphan_references(p, "k", "loaded", "deleted", [References("r", r, "k", "at", "rec", "period")], size)
    return sorted((x["rec_no"], x["kind"]) for x in got.collect())


def brute(parents, refs):
    out = []
    for i, (k, t) in enumerate(refs):
        k = (k or "").strip()
        t = float("inf") if t is None else t
        own = [(-1e18 if a is None else a, b) for q, a, b in parents if (q or "").strip() == k]
        if not k or any(a <= t and (b is None or b > t) for a, b in own):
            continue
        out.append((i, "missing" if not own else "late" if all(a > t for a, _ in own) else "deleted"))
    return out


def test_kinds_and_edges(spark):
    parents = [(" a", 10, 20), ("a", 30, None), ("b", 5, 5), (None, 1, None), ("c", None, None)]
    refs = [("a", 9), ("a ", 10), ("a", 19), ("a", 20), ("a", 29), ("a", 30), ("b", 4), ("b", 5), ("x", 1), (None, 1), (" ", 1), ("c", -5), ("a", None), ("b", None)]
    assert run(spark, parents, refs) == brute(parents, refs)


def test_empty(spark):
    assert run(spark, [], [("a", 1)]) == [(0, "missing")]
    assert run(spark, [("a", 1, None)], []) == []
    assert run(spark, [], []) == []


@pytest.mark.parametrize("seed,size", [(0, 250_000), (1, 40), (2, 25), (3, 7)])
def test_random_with_hot_keys_over_many_ranges(spark, seed, size):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < 0.35 else r.choice("abcdefgh") + str(r.randrange(4))
    parents = []
    for _ in range(120):
        a = r.randrange(200)
        parents.append((key(), a, r.choice([None, a + r.randrange(30)])) if r.random() < 0.4 else (key(), a, a + r.randrange(9)))
    refs = [(key(), r.randrange(220)) for _ in range(300)] + [("gone", 5)] * 60
    assert run(spark, parents, refs, size) == brute(parents, refs)


def test_report_and_clashing_columns(spark):
    p = spark.createDataFrame([("a", at(1), None, 5)], P + ", part int")
    r = spark.createDataFrame([(1, "z", at(2), None, "q", 1), (1, "z", at(2), None, "q", 1)], R + ", K string, h long")
    got = orphan_references(p, "k", "loaded", "deleted", [References("r", r, "k", "at", "rec", "period")])
    assert [tuple(x) for x in orphan_report(got).collect()] == [("r", "", "missing", 2)]
