"""Evaluation passages inside a corpus, by a distributed positional inverted index.

Stage one reads the corpus once and stores, per shard of documents, the places
of every term. Shards are cut by size along the input's own partitions, so
nothing is shuffled. Stage two takes each stored shard, intersects the lists of
an item's rarest terms, each shifted by the term's place in the item, and looks
closer only where two of them meet.

An item's chosen terms are pairs of neighbouring words such that any window of
twelve words holds a whole pair. A verbatim run of twelve words therefore meets
two of them. Where only single words were exchanged, no two neighbours are both
exchanged, so each pair inside keeps at least one word, and a passage of 24
words holds two pairs. So no passage of either kind is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pick, spread, work_table
from .wikitext import all_segments

#: Places left free between segments, so that no passage runs from one into the next.
GAP = 4
SHARD_TERMS = 1_000_000
#: Words of items laid over a shard at once.
SPAN_CELLS = 2_000_000

_INDEX = "terms array<string>, counts array<int>, deltas binary, docs binary, starts binary, n_places long"
_INDEX_ARROW = pa.schema([
    ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("deltas", pa.binary()),
    ("docs", pa.binary()), ("starts", pa.binary()), ("n_places", pa.int64()),
])


def build_shard(doc_ids: list[int], ids: np.ndarray, starts: np.ndarray, vocabulary: list[str]) -> tuple:
    """One stored shard: per term the places in order, as differences; ids below 0 are free places."""
    at = np.flatnonzero(ids >= 0)
    order = np.argsort(ids[at], kind="stable")
    places = at[order].astype(np.int32)
    counts = np.bincount(ids[at], minlength=len(vocabulary)).astype(np.int32)
    deltas = np.diff(places, prepend=np.int32(0)).astype(np.int32)
    heads = np.concatenate(([0], np.cumsum(counts)[:-1]))
    deltas[heads] = places[heads]
    return vocabulary, counts.tolist(), deltas.tobytes(), np.array(doc_ids, np.int64).tobytes(), starts.astype(np.int32).tobytes(), len(ids)


def positional_index(docs: DataFrame, doc_id: str, text: str, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """The stored index of all words of all texts; one row per shard of about shard_terms words.

    Documents are never split, so a text longer than that makes a longer
    shard. Null texts and rows without id hold no words.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        chunks: list[np.ndarray] = []
        ids: list[int] = []
        starts: list[int] = []
        place = 0
        gap = np.full(GAP, -1, np.int32)

        def flush() -> pa.RecordBatch:
            nonlocal place
            row = build_shard(ids, np.concatenate(chunks), np.array(starts), list(names))
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _INDEX_ARROW)], schema=_INDEX_ARROW)
            names.clear(), chunks.clear(), ids.clear(), starts.clear()
            place = 0
            return out

        for b in batches:
            for d, t in zip(b["d"].to_pylist(), b["t"]):
                segments = all_segments(t.as_py())
                if not segments:
                    continue
                ids.append(d)
                starts.append(place)
                for words in segments:
                    new = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int32, len(words))
                    chunks += [new, gap]
                    place += len(new) + GAP
                if place >= shard_terms:
                    yield flush()
        if ids:
            yield flush()

    docs = pick(docs, doc_id, text)
    slim = docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t")).where("d is not null and t is not null")
    return work_table(spread(slim).mapInArrow(build, _INDEX), "positional-index")


@dataclass(frozen=True)
class Rule:
    """A passage counts with run consecutive words, or share of an item's words in order with single words exchanged."""

    run: int = 12
    share: float = 0.6


@dataclass(frozen=True)
class Query:
    item: int
    words: tuple[str, ...]
    anchors: tuple[int, ...]
    need: int
    hits: int


def choose_anchors(words: list[str], count: dict[str, int], rule: Rule) -> tuple[tuple[int, ...], int, int]:
    """(places in the item, words needed for the share, meetings needed): the cheapest pairs that no passage can miss."""
    n = len(words)
    need = max(1, math.ceil(rule.share * n - 1e-9))
    window = min(rule.run, need, n)
    if window < 2:
        return tuple(range(n)), need, 1
    cost = [count.get(w, 0) for w in words]
    pair = [cost[i] + cost[i + 1] for i in range(n - 1)]
    best: list[tuple[int, int]] = []  # cheapest choice that ends with pair i, and the pair before
    for i, c in enumerate(pair):
        before = [(0, -1)] if i <= window - 2 else []
        before += [(best[j][0], j) for j in range(max(0, i - window + 1), i)]
        total, j = min(before)
        best.append((total + c, j))
    i = min(range(n - window, n - 1), key=lambda k: best[k][0])
    chosen = set()
    while i >= 0:
        chosen |= {i, i + 1}
        i = best[i][1]
    return tuple(sorted(chosen)), need, 2 if need >= 2 * window else 1


def passages(queries: list[Query], rule: Rule, terms: list[str], counts: np.ndarray, deltas: np.ndarray, docs: np.ndarray, starts: np.ndarray, n_places: int) -> set[tuple[int, int]]:
    """(document, item) pairs found in one shard."""
    ends = np.cumsum(counts)
    code = {t: i for i, t in enumerate(terms)}
    post: dict[int, np.ndarray] = {}
    forward = np.full(n_places + 1, -1, np.int32)  # the last place stands for all places outside

    def places(i: int) -> np.ndarray:
        """A term's places; lists are read when first asked for, and then stand in forward too."""
        if i not in post:
            post[i] = np.cumsum(deltas[ends[i] - counts[i] : ends[i]], dtype=np.int32)
            forward[post[i]] = i
        return post[i]

    doc_ends = np.append(starts[1:], n_places)
    out = set()
    for q in queries:
        item = np.array([code.get(w, -2) for w in q.words], np.int32)
        lists = [places(item[a]) - a for a in q.anchors if item[a] >= 0]
        if not lists:
            continue
        at = np.sort(np.concatenate(lists))
        at = at[:-1][at[1:] == at[:-1]] if q.hits == 2 else at
        if not len(at):
            continue
        at = np.unique(at)
        for i in np.unique(item[item >= 0]):  # only items with a place to look at have their common words read
            places(i)
        rows = max(1, SPAN_CELLS // len(item))
        for k in range(0, len(at), rows):
            p = _passages_at(at[k : k + rows], item, q.need, rule.run, forward, n_places)
            d = np.searchsorted(starts, p, side="right") - 1
            d = np.unique(d[(d >= 0) & (p < doc_ends[d])])
            out.update((int(x), q.item) for x in docs[d])
    return out


def _passages_at(at: np.ndarray, item: np.ndarray, need: int, length: int, forward: np.ndarray, n_places: int) -> np.ndarray:
    """Places where a passage begins to count, of the item laid at each of the given places."""
    span = at[:, None] + np.arange(len(item))
    span[(span < 0) | (span >= n_places)] = n_places
    same = forward[span] == item
    keep = same.sum(1) >= min(need, length)
    at, same = at[keep], same[keep]
    run = np.zeros(len(at), int)
    chain = np.zeros(len(at), int)
    before = np.ones(len(at), bool)
    was = np.zeros(len(at), bool)
    hits = []  # the free places end both kinds of passage, so each document on a diagonal has its own
    for i in range(len(item)):
        m = same[:, i]
        run = np.where(m, run + 1, 0)
        chain = np.where(m, chain + 1, np.where(before, chain, 0))
        before = m
        now = (run >= length) | (chain >= need)
        hits.append(at[now & ~was] + i)
        was = now
    return np.concatenate(hits)


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rule: Rule = Rule(), block: int = 5_000) -> DataFrame:
    """Rows (doc_id, item_id), one for each document that holds a passage of an item.

    Case, punctuation, spacing, markup and the encoding of characters play no
    part. Items are a query set: they go through the stored index in blocks of
    fixed size, each small enough to send along with the tasks. Items without
    words match nothing; equal items are each reported; empty tables give no
    rows. Notes, templates and comments are searched too.
    """
    return items_in_index(positional_index(docs, doc_id, text), items, item_id, item_text, rule, block)


def items_in_index(index: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "text", rule: Rule = Rule(), block: int = 5_000) -> DataFrame:
    """As leaked_items, from an index made before; stored as a table, it serves any number of item sets."""
    items = pick(items, item_id, item_text)
    spark = index.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").orderBy("i").toLocalIterator()
    result = None
    done = False
    while not done:
        batch: list[tuple[int, list[str]]] = []
        for r in rows:
            words = [w for s in all_segments(r["t"]) for w in s]
            if words:
                batch.append((r["i"], words))
            if len(batch) == block:
                break
        else:
            done = True
        if batch:
            found = _probe_block(index, batch, rule)
            result = found if result is None else result.unionByName(found)
    return result.distinct() if result is not None else spark.createDataFrame([], "doc_id long, item_id long")


def _probe_block(index: DataFrame, batch: list[tuple[int, list[str]]], rule: Rule) -> DataFrame:
    spark = index.sparkSession
    vocabulary = sorted({w for _, words in batch for w in words})  # of one block of items
    known = spark.createDataFrame([(w,) for w in vocabulary], "term string")
    stats = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("z")).select(F.col("z.terms").alias("term"), F.col("z.counts").alias("n"))
    count = {r["term"]: r["n"] for r in stats.join(known, "term").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    queries = [Query(i, tuple(w), *choose_anchors(w, count, rule)) for i, w in batch]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                get = lambda c: b[c][r]  # noqa: B023, E731
                found = passages(
                    queries, rule, get("terms").as_py(), get("counts").values.to_numpy(), np.frombuffer(get("deltas").as_py(), np.int32),
                    np.frombuffer(get("docs").as_py(), np.int64), np.frombuffer(get("starts").as_py(), np.int32), get("n_places").as_py(),
                )
                if found:
                    d, i = zip(*sorted(found))
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], names=["doc_id", "item_id"])

    return index.mapInArrow(probe, "doc_id long, item_id long")
