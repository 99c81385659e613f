import random
from collections import Counter

import numpy as np
import pytest
from loomfield.llm.packing import Places, best_fit_steps, pack, pack_sizes, packing_summary
from loomfield.llm.tokens import encoder, default_vocabulary


def brute_best_fit(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(capacity - s)
        else:
            gaps[gaps.index(fit)] -= s
    return len(gaps)


def check(rows, sizes, capacity):
    """Every document whole or cut right, every place distinct, no container over its capacity."""
    inside, places, docs = {}, set(), {}
    for r in rows:
        inside[r["container"]] = inside.get(r["container"], 0) + r["n_tokens"]
        assert (r["container"], r["place"]) not in places
        places.add((r["container"], r["place"]))
        docs.setdefault(r["doc_id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    assert max(inside.values(), default=0) <= capacity
    assert sorted(docs) == sorted(i for i, _ in sizes)
    for i, n in sizes:
        got = sorted(docs[i])
        assert [p for p, _, _ in got] == list(range(max(1, -(-n // capacity))))
        assert [f for _, f, _ in got] == [p * capacity for p, _, _ in got] and sum(k for _, _, k in got) == n
    at = {}
    for c, p in places:
        at.setdefault(c, []).append(p)
    assert all(sorted(v) == list(range(len(v))) for v in at.values())
    return len(inside)


@pytest.mark.parametrize("seed", range(30))
def test_as_tight_as_item_by_item(seed):
    r = random.Random(seed)
    cap = r.choice([10, 64, 100])
    sizes = [r.randint(1, cap) for _ in range(r.randrange(200))]
    counts = Counter(sizes)
    steps, opened = best_fit_steps(counts, cap)
    assert sum(x.n for x in steps) == len(sizes) and opened <= brute_best_fit(sizes, cap)
    places, load, inside = Places(steps, cap), Counter(), Counter()
    for size, n in counts.items():
        container, place = places.of(np.full(n, size), np.arange(n))
        for c, p in zip(container.tolist(), place.tolist()):
            load[c] += size
            inside[c, p] += 1
    assert set(load) == set(range(opened)) and max(load.values(), default=0) <= cap and set(inside.values()) <= {1}
    assert all((c, p - 1) in inside for c, p in inside if p)


@pytest.mark.parametrize("capacity", [2_048, 8_192, 32_768])
def test_steps_grow_with_sizes_and_gaps(capacity):
    """Two million items whose sizes fall off like those of texts: steps do not grow with them."""
    r = np.random.default_rng(1)
    sizes = np.minimum(capacity, np.exp(r.normal(np.log(capacity) - 2.3, 1.2, 200_000)).astype(int) + 1)
    few = {int(s): int(n) for s, n in zip(*np.unique(sizes, return_counts=True))}
    counts = [len(best_fit_steps({s: n * k for s, n in few.items()}, capacity)[0]) for k in (1, 10)]
    assert max(counts) < 8 * capacity and counts[1] < 1.5 * counts[0], counts


@pytest.mark.parametrize("seed", range(2))
def test_pack_sizes(spark, seed):
    r = random.Random(seed)
    sizes = [(i, r.choice([0, 3, 3, 3, r.randrange(60), r.randrange(400)])) for i in range(800)]
    got = pack_sizes(spark.createDataFrame(sizes, "doc_id long, n_tokens long"), 64).collect()
    n = check(got, sizes, 64)
    assert n <= -(-sum(s for _, s in sizes) // 64) + 3


def test_texts(spark):
    texts = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 9000), (5, "x"), (5, "x"), (6, "\t\n ")]
    df = spark.createDataFrame([(i, t, "k") for i, t in texts], "doc_id long, text string, DOC_ID string")
    got = pack(df).collect()
    enc = encoder(default_vocabulary())
    n = {i: len(enc.encode_ordinary(t or "")) for i, t in texts}
    assert len(got) == 6 + -(-n[4] // 2048) and n[4] > 2048
    check([r for r in got if r["doc_id"] != 5], [(i, k) for i, k in n.items() if i != 5], 2048)
    s = packing_summary(pack(df)).first()
    assert s["items"] == len(got) and s["fullest"] <= 2048
    assert pack(df.limit(0)).count() == 0
    only_empty = pack(df.where("doc_id in (2, 3)")).collect()
    assert sorted((r["container"], r["place"]) for r in only_empty) == [(0, 0), (0, 1)]
    with pytest.raises(ValueError):
        best_fit_steps({11: 1}, 10)
