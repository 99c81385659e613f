"""Telling languages apart by their frequent words, learned from the corpus's own unreliable labels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pick, spread
from .wikitext import prose_sentences

OTHER = "other"
# Codes that name no language.
NO_LANGUAGE = ("und", "mul", "zxx", "mis")


@dataclass(frozen=True)
class LanguageSpec:
    """Bounds of the fit: documents read per label, the least of them a language needs, its words, and what tells noun capitals."""

    documents: int = 400
    least: int = 10
    words: int = 150
    share: float = 0.05  # of a language's documents that a frequent word is in
    known: float = 0.1  # of a text's words that a known language knows
    capitals: float = 0.25  # of words inside sentences, from which a capital marks any noun


@dataclass(frozen=True)
class Languages:
    """names, the last being 'other'; per frequent word its log chance in each of them but the last; places of those that capital nouns."""

    names: tuple[str, ...] = (OTHER,)
    words: dict[str, np.ndarray] = field(default_factory=dict)
    nouns: frozenset[int] = frozenset()
    known: float = 0.1

    def of(self, lows: Counter) -> int:
        """The place of the language of a text's words that begin without a capital."""
        hits = [w for w in lows if w in self.words]
        if not hits or sum(lows[w] for w in hits) < self.known * sum(lows.values()):
            return len(self.names) - 1
        return int(np.argmax(sum(self.words[w] for w in hits)))


def primary_tag(c: Column) -> Column:
    """The language of a label such as 'EN', 'en-x' or 'en_GB'; '' for none."""
    tag = F.lower(F.regexp_extract(F.coalesce(c.cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[^A-Za-z]|$)", 1))
    return F.when(tag.isin(*NO_LANGUAGE), "").otherwise(tag)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per label: documents (''), words and capitals inside sentences (' w', ' c'), and documents each word is in."""
    counts: dict[str, Counter] = {}
    for b in batches:
        for tag, text in zip(b["tag"].to_pylist(), b["t"]):
            sentences = prose_sentences(text.as_py())
            if not sentences:
                continue
            c = counts.setdefault(tag, Counter())
            c[""] += 1
            inside = [w for s in sentences for w in s[1:] if w[0].isalpha()]
            c[" w"] += len(inside)
            c[" c"] += sum(w[0].isupper() for w in inside)
            c.update({w for s in sentences for w in s if w[0].isalpha() and not w[0].isupper()})
    rows = [(t, w, n) for t, c in counts.items() for w, n in c.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], names=["tag", "word", "n"])


def learn_languages(docs: DataFrame, doc_id: str, text: str, lang: str, spec: LanguageSpec = LanguageSpec()) -> Languages:
    """The languages that enough documents are labelled with, and the words that tell them.

    Labels may err as long as most do not. The fit reads about spec.documents
    texts of each label, chosen by the hash of their id; it is a bounded sample,
    and every document is then told by all its words. Without labels there is
    one language, 'other'.
    """
    docs = pick(docs, doc_id, text, lang)
    tagged = docs.select(docs[doc_id].cast("long").alias("d"), primary_tag(docs[lang]).alias("tag"), docs[text].alias("t")).where("tag != '' and t is not null and d is not null")
    sizes = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= spec.least).collect()  # codes of two or three letters
    if not sizes:
        return Languages(known=spec.known)
    place = F.xxhash64("d").cast("double") / float(1 << 64) + 0.5
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["tag"], min(1.0, spec.documents / r["n"]))])
    sample = tagged.where(place < F.try_element_at(share, F.col("tag"))).select("tag", "t")
    counts = spread(sample).mapInArrow(_word_counts, "tag string, word string, n long").groupBy("tag", "word").agg(F.sum("n").alias("n"))
    whole = counts.where("word = ''").select("tag", F.col("n").alias("docs")).where(F.col("docs") >= spec.least)
    often = counts.join(whole, "tag").where((F.col("n") >= spec.share * F.col("docs")) | F.col("word").isin("", " w", " c"))
    got: dict[str, Counter] = {}
    for r in often.select("tag", "word", "n").collect():  # a bounded sample's frequent words
        got.setdefault(r["tag"], Counter())[r["word"]] = r["n"]
    names = sorted(got)
    if not names:
        return Languages(known=spec.known)
    frequent = {w for c in got.values() for w, _ in sorted(((w, n) for w, n in c.items() if w.strip()), key=lambda x: (-x[1], x[0]))[: spec.words]}
    chance = {w: np.log([(got[t][w] + 0.5) / (got[t][""] + 1) for t in names]) for w in frequent}
    nouns = frozenset(i for i, t in enumerate(names) if got[t][" c"] > spec.capitals * max(1, got[t][" w"]))
    return Languages((*names, OTHER), chance, nouns, spec.known)
