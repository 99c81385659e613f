import random

import numpy as np
import pytest
from loomfield.llm import leakage
from loomfield.llm.leakage import GAP, Query, Rule, build_shard, choose_anchors, items_in_index, leaked_items, passages, positional_index
from loomfield.llm.wikitext import all_segments

D, I = "doc_id long, text string", "item_id long, text string"
VOCAB = [f"w{i}" for i in range(60)]


def found(spark, docs, items, **k):
    return sorted(map(tuple, leaked_items(spark.createDataFrame(docs, D), spark.createDataFrame(items, I), **k).collect()))


def brute(docs, items, rule=Rule()):
    out = set()
    for d, text in docs:
        for i, it in items:
            q = (it or "").split()
            if not q or not text:
                continue
            w = text.split()
            for off in range(-len(q), len(w)):
                same = [0 <= off + j < len(w) and w[off + j] == q[j] for j in range(len(q))]
                run = chain = best_run = best_chain = 0
                before = True
                for m in same:
                    run = run + 1 if m else 0
                    chain = chain + 1 if m else (chain if before else 0)
                    before = m
                    best_run, best_chain = max(best_run, run), max(best_chain, chain)
                if best_run >= rule.run or best_chain >= -(-6 * len(q) // 10):
                    out.add((d, i))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_all_alignments(spark, seed):
    r = random.Random(seed)
    items = [(i, " ".join(r.choice(VOCAB) for _ in range(r.choice([1, 2, 5, 11, 13, 30, 60])))) for i in range(14)]
    docs = []
    for d in range(60):
        words = [r.choice(VOCAB) for _ in range(r.randrange(80))]
        if d % 2:
            q = r.choice(items)[1].split()
            a = r.randrange(len(q))
            part = q[a : a + r.randint(1, len(q))]
            for j in range(r.randrange(3), len(part), r.choice([2, 3, 5, 9, 99])):
                part[j] = "other"
            words[5:5] = part
        docs.append((d, " ".join(words)))
    want = brute(docs, items)
    assert want and found(spark, docs, items) == want
    assert found(spark, docs, items, block=3) == want


def test_disguises(spark):
    item = "The narrow chronicle opens this soft river in its second railway, near another town by the hill in spring."
    w = item.split()
    docs = [
        (1, item.upper()), (2, "x <ref>see p. 5</ref> " + " ".join(w[:6]) + "<ref name='a'>note</ref> " + " ".join(w[6:])), (3, "{{quote|" + item + "|source=me}}"), (4, "<!-- " + item + " -->"),
        (5, " ".join(f"[[{a} (term)|{a}]]" if i % 3 == 0 else f"''{a}''" for i, a in enumerate(w))), (6, "&nbsp;".join(w)), (7, "".join(c + "​" if c in "aeiou" else c for c in item)),
        (8, item.replace("ch", "c­h").replace("o", "о")), (9, "{| class=x\n|-\n| 3 || " + item + "\n|}"), (10, "\n:".join(w)), (11, " ".join(w[:8] + ["{{cite|a b}}"] + w[8:])), (12, item.replace("fi", "ﬁ").replace("e", "é")),
        (20, " ".join(w[:11])), (21, " ".join(w[:6] + ["a", "b"] + w[6:11])), (22, " ".join(reversed(w))), (23, None), (24, ""), (25, "{{" * 500 + "<ref>" * 50 + "[["),
    ]
    assert [d for d, _ in found(spark, docs, [(1, item)])] == list(range(1, 13))


def test_empty_null_equal_and_long(spark):
    text = " ".join(f"v{i}" for i in range(30))
    assert found(spark, [(1, text)], []) == [] and found(spark, [], [(1, text)]) == []
    assert found(spark, [(1, text), (2, "z"), (None, text)], [(1, text), (2, text), (3, None), (4, " ,.")]) == [(1, 1), (1, 2)]
    long = "filler " * 300_000 + text + " filler" * 1000
    assert found(spark, [(7, long), (8, long)], [(1, text)]) == [(7, 1), (8, 1)]
    df = spark.createDataFrame([(1, text, 5)], D + ", TEXT int")
    assert leaked_items(df, spark.createDataFrame([(1, text)], I)).count() == 1


def test_anchors_leave_no_window_free():
    r = random.Random(0)
    for n in range(1, 90):
        words = [f"x{i}" for i in range(n)]
        at, need, hits = choose_anchors(words, {w: r.randrange(100) for w in words}, Rule())
        window = min(12, need, n)
        if window >= 2:
            pairs = {a for a in at if a + 1 in at}
            assert all(any(s <= p and p + 1 < s + window for p in pairs) for s in range(n - window + 1))
        assert hits == (2 if need >= 2 * window and window >= 2 else 1)


def test_segments():
    assert all_segments("a<ref>b c</ref> d {{t|e {{u|f}} g}} [[x|h]]<!-- i -->") == [["a", "d", "h"], ["i"], ["b", "c"], ["u", "f"], ["t", "e", "g"]]


def shard_found(docs, items):
    """Pairs found when all documents stand in one shard, in this order."""
    names, chunks, starts = {}, [], []
    for _, text in docs:
        starts.append(sum(map(len, chunks)))
        chunks += [np.array([names.setdefault(w, len(names)) for w in text.split()], np.int32), np.full(GAP, -1, np.int32)]
    terms, counts, deltas, ids, begins, n = build_shard([d for d, _ in docs], np.concatenate(chunks), np.array(starts), list(names))
    queries = [Query(i, tuple(t.split()), *choose_anchors(t.split(), dict(zip(terms, counts)), Rule())) for i, t in items]
    return sorted(passages(queries, Rule(), terms, np.array(counts), np.frombuffer(deltas, np.int32), np.frombuffer(ids, np.int64), np.frombuffer(begins, np.int32), n))


@pytest.mark.parametrize("lengths", [(12, 12, 12), (12, 11, 12), (12, 12, 30), (40, 12, 12), (3, 12, 13)])
def test_neighbours_on_one_diagonal(lengths):
    item = [f"w{i}" for i in range(76)]
    docs, at = [], 0
    for d, n in enumerate(lengths):
        docs.append((d, " ".join((["x", "y"] if d == 0 else []) + item[at : at + n])))
        at += n + GAP
    items = [(1, " ".join(item)), (2, "w0 w1 w2 w3 w4")]
    want = brute(docs, items)
    assert len(want) > 1 and shard_found(docs, items) == want


def test_long_items_in_blocks(monkeypatch):
    """Items laid over a shard a few places at a time give the same pairs."""
    r = random.Random(8)
    docs = [(d, " ".join(r.choice(VOCAB[:25]) for _ in range(400))) for d in range(6)]
    items = [(i, " ".join(r.choice(VOCAB[:25]) for _ in range(150)) + " " + " ".join(docs[i][1].split()[50:70])) for i in range(4)]
    whole = shard_found(docs, items)
    monkeypatch.setattr(leakage, "SPAN_CELLS", 400)
    assert shard_found(docs, items) == whole == brute(docs, items) and len(whole) >= 4


def test_an_index_serves_several_sets(spark, tmp_path):
    text = " ".join(f"v{i}" for i in range(30))
    positional_index(spark.createDataFrame([(1, text), (2, text + " z")], D), "doc_id", "text").write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for i in (7, 8):
        assert sorted(map(tuple, items_in_index(index, spark.createDataFrame([(i, text)], I)).collect())) == [(1, i), (2, i)]
