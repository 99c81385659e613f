"""Reading level of running prose, by a Rasch-style model of word difficulty.

Every word of a document is a trial. Names and first words, told by their capital,
are none, but in a language that capitals all nouns a capital tells nothing and
every word counts. Languages and their capitals are learned from the corpus
(languages). Items are the words themselves and, per
language, "longer than m letters". The chance that a trial meets an item goes up
or down with the document's latent level theta: log-odds (or log rate) kappa +
beta * theta, so an item's difficulty is -kappa / beta. Length items carry the
levels of words that were never seen in a labelled document.

Estimation alternates. With item parameters fixed, each document gets the
posterior of its level on a grid; with posteriors fixed, each item gets its
parameters from sums over all documents. Raters' labels tie the scale: they enter
the posterior of labelled documents with an error rate per rater, estimated in
the same rounds. Documents are read and cut into words once; the rounds run over
stored counts. What tasks send each other is sums per item, keyed by the word or
rater itself, so no two share parameters; these take some thirty bytes a
distinct word, in the driver and in each worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pick, spread, work_table
from .languages import Languages, learn_languages
from .wikitext import prose_sentences

GRID = np.arange(1.0, 4.01, 0.5)
K = len(GRID)
CENTRED = GRID - GRID.mean()
LENGTHS = range(3, 16)
N_LEN = len(LENGTHS)


@dataclass(frozen=True)
class LevelSpec:
    """min_words of prose; rounds of estimation; weights of words against lengths and of unlabelled documents."""

    min_words: int = 100
    rounds: int = 3
    word_weight: float = 0.3
    temper: float = 0.05
    unlabelled: float = 0.2
    rater_error: float = 0.15
    ridge: float = 2.0


@dataclass
class Params:
    """kappa and beta of each of words; error of each rater."""

    words: pa.Array
    kappa: np.ndarray
    beta: np.ndarray
    norm: np.ndarray
    length: np.ndarray
    error: dict[str, float]


# --- counts of a document -----------------------------------------------------------------------


def describe(text: str, min_words: int, languages: Languages) -> tuple | None:
    """(prose words, language, trials, distinct words in one, their bytes, their counts, counts of lengths); None for too little prose."""
    sentences = prose_sentences(text)
    n = sum(map(len, sentences))
    if n < min_words:
        return None
    lows = Counter(w for s in sentences for w in s if w[0].isalpha() and not w[0].isupper())
    lang = languages.of(lows)
    if lang in languages.nouns:
        lows = Counter(w.lower() for s in sentences for w in s if w[0].isalpha())
    longer = np.zeros(N_LEN, np.int64)
    for w, c in lows.items():
        longer[: max(0, len(w) - LENGTHS[0])] += c
    words = [w.encode() for w in lows]
    numbers = lambda v: np.fromiter(v, np.int32, len(words)).tobytes()
    return n, lang, sum(lows.values()), b"".join(words), numbers(map(len, words)), numbers(lows.values()), longer.astype(np.int32).tobytes()


_DOC = "doc_id long, n_words long, lang int, trials int, words binary, sizes binary, counts binary, longer binary"
_DOC_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("lang", pa.int32()), ("trials", pa.int32()),
    ("words", pa.binary()), ("sizes", pa.binary()), ("counts", pa.binary()), ("longer", pa.binary()),
])


def described(docs: DataFrame, doc_id: str, text: str, spec: LevelSpec, languages: Languages) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t in zip(b["d"].to_pylist(), b["t"]):
                if (x := describe(t.as_py(), spec.min_words, languages)) is not None:
                    rows.append((d, *x))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DOC_ARROW)], schema=_DOC_ARROW)

    docs = pick(docs, doc_id, text)
    slim = docs.select(docs[doc_id].cast("long").alias("d"), docs[text].alias("t")).where("d is not null and t is not null")
    return work_table(spread(slim).mapInArrow(run, _DOC), "prose-counts")


# --- the two halves of a round --------------------------------------------------------------------


def _frame(b: pa.RecordBatch) -> tuple:
    """Flat arrays of a batch: document of each word, its place among the batch's words, count, counts of lengths, language, trials; those words."""
    sizes = [np.frombuffer(x, np.int32) for x in b["sizes"].to_pylist()]
    per_doc = np.fromiter(map(len, sizes), np.int64, len(sizes))
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(sizes), dtype=np.int64)])
    flat = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(b"".join(b["words"].to_pylist()))).dictionary_encode()
    counts = np.concatenate([np.frombuffer(x, np.int32) for x in b["counts"].to_pylist()]).astype(float)
    longer = np.stack([np.frombuffer(x, np.int32) for x in b["longer"].to_pylist()]).astype(float)
    return np.repeat(np.arange(len(sizes)), per_doc), flat.indices.to_numpy(), counts, longer, b["lang"].to_numpy(), b["trials"].to_numpy().astype(float), flat.dictionary


def text_loglik(p: Params, frame: tuple, spec: LevelSpec) -> np.ndarray:
    """Log-likelihood of each document's trials at each level of the grid."""
    d, i, c, longer, lang, trials, own = frame
    n = len(trials)
    at = pc.fill_null(pc.index_in(own, value_set=p.words), -1).to_numpy(zero_copy_only=False)[i]
    use = at >= 0
    d, i, c = d[use], at[use], c[use]
    a, b = np.bincount(d, c * p.kappa[i], n), np.bincount(d, c * p.beta[i], n)
    total = np.bincount(d, c, n)
    words = a[:, None] + b[:, None] * CENTRED - total[:, None] * p.norm
    odds = p.length[lang]  # documents, lengths, levels
    lengths = np.einsum("dm,dmk->dk", longer, odds) - trials[:, None] * np.logaddexp(0, odds).sum(1)
    return spec.temper * (lengths + spec.word_weight * words)


def _normal(ll: np.ndarray) -> np.ndarray:
    p = np.exp(ll - ll.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def label_loglik(labels: list, error: dict[str, float], usual: float) -> np.ndarray:
    """Of the labels (rater, level, times) of each document; a rater errs to near levels more than to far ones, usual is the error of one not yet known."""
    out = np.zeros((len(labels), K))
    for d, row in enumerate(labels):
        for x in row or ():
            e, far = error.get(x["rater"], usual), np.abs(GRID - x["level"])
            p = np.where(far < 0.26, 1 - e, np.where(far < 0.6, (1 - e) / 2, e / 2 * np.exp(1 - far)))
            out[d] += x["times"] * np.log(p)
    return out


_SUMS = ", ".join(["kind string", "item string", *[f"m{k} double" for k in range(K)]])


def _sums(params: Params | None, error: dict[str, float], weight: float, spec: LevelSpec, labelled: bool, n_langs: int):
    """Per batch: posterior-weighted counts of every item at every level; of raters their errors and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            frame = _frame(b)
            d, i, c, longer, lang, trials, own = frame
            ll = text_loglik(params, frame, spec) if params is not None else np.zeros((len(trials), K))
            if labelled:
                labels = b["labels"].to_pylist()
                ll = ll + label_loglik(labels, error, spec.rater_error)
            post = _normal(ll) * weight
            words = np.stack([np.bincount(i, c * post[d, k], len(own)) for k in range(K)], 1)
            fixed = np.zeros((n_langs * (N_LEN + 1), K))  # lengths per language, then trials per language
            for g in np.unique(lang):
                of = lang == g
                fixed[g * N_LEN : (g + 1) * N_LEN] = longer[of].T @ post[of]
                fixed[n_langs * N_LEN + g] = trials[of] @ post[of]
            raters: dict[str, np.ndarray] = {}
            if labelled:
                for row, p in zip(labels, post):
                    for x in row or ():
                        r = raters.setdefault(x["rater"], np.zeros(K))
                        r[0] += x["times"] * (p @ np.minimum(np.abs(GRID - x["level"]), 1.0)) / weight
                        r[1] += x["times"]
            m = np.concatenate([words, fixed, *[r[None] for r in raters.values()]])
            kind = ["word"] * len(own) + ["fixed"] * len(fixed) + ["rater"] * len(raters)
            item = pa.array(own.to_pylist() + [str(k) for k in range(len(fixed))] + list(raters), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.string()), item, *[pa.array(m[:, k]) for k in range(K)]], names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


def fit_rates(m: np.ndarray, exposure: np.ndarray, ridge: float, steps: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Log rate kappa + beta * level of each item, all items at once, by Newton steps."""
    kappa = np.log((m.sum(1) + 0.01) / exposure.sum())
    beta = np.zeros(len(m))
    for _ in range(steps):
        rate = exposure * np.exp(np.clip(kappa[:, None] + beta[:, None] * CENTRED, -30, 5))
        r0 = (m - rate).sum(1) - 0.02 * (kappa - np.log(1e-4))
        r1 = ((m - rate) * CENTRED).sum(1) - ridge * beta
        a, b, c = rate.sum(1) + 0.02, (rate * CENTRED).sum(1), (rate * CENTRED**2).sum(1) + ridge
        det = a * c - b * b
        kappa = kappa + np.clip((c * r0 - b * r1) / det, -2, 2)
        beta = beta + np.clip((a * r1 - b * r0) / det, -1, 1)
    return kappa, beta


def fit_odds(m: np.ndarray, trials: np.ndarray, steps: int = 30) -> np.ndarray:
    """Log-odds of each length item at each level: a logistic line in the level."""
    k0 = np.log((m.sum(1) + 1) / (np.maximum(trials.sum(1) - m.sum(1), 0) + 1))
    b0 = np.zeros(len(m))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(k0[:, None] + b0[:, None] * CENTRED, -30, 30)))
        r, w = m - trials * p, trials * p * (1 - p)
        g0, g1 = r.sum(1) - 0.01 * k0, (r * CENTRED).sum(1) - 0.1 * b0
        a, b, c = w.sum(1) + 0.01, (w * CENTRED).sum(1), (w * CENTRED**2).sum(1) + 0.1
        det = a * c - b * b
        k0 = k0 + np.clip((c * g0 - b * g1) / det, -1, 1)
        b0 = b0 + np.clip((a * g1 - b * g0) / det, -1, 1)
    return k0[:, None] + b0[:, None] * CENTRED


def _estimate(sums: DataFrame, spec: LevelSpec, n_langs: int) -> Params:
    """Item parameters from the sums, fitted in the cluster; a row for each distinct word and rater reaches the driver."""
    cols = [f"m{k}" for k in range(K)]
    total = work_table(sums.groupBy("kind", "item").agg(*[F.sum(c).alias(c) for c in cols]), "item-sums")
    fixed = np.zeros((n_langs * (N_LEN + 1), K))
    for r in total.where("kind = 'fixed'").collect():
        fixed[int(r["item"])] = [r[c] for c in cols]
    trials = fixed[n_langs * N_LEN :]
    exposure = trials.sum(0) + 1e-9

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                m = np.stack([b[c].to_numpy() for c in cols], 1)
                kappa, beta = fit_rates(m, exposure, spec.ridge)
                yield pa.RecordBatch.from_arrays([b["item"], pa.array(kappa), pa.array(beta)], names=["item", "kappa", "beta"])

    words = total.where("kind = 'word' and " + " + ".join(cols) + " > 0").select("item", *cols).mapInArrow(fit, "item string, kappa double, beta double").toArrow()
    kappa, beta = words["kappa"].to_numpy(), words["beta"].to_numpy()
    norm = np.log(np.exp(kappa[:, None] + beta[:, None] * CENTRED).sum(0)) if len(kappa) else np.zeros(K)
    length = fit_odds(fixed[: n_langs * N_LEN], np.repeat(trials, N_LEN, 0)).reshape(n_langs, N_LEN, K)
    raters = total.where("kind = 'rater'").select("item", F.col("m0").alias("off"), F.col("m1").alias("n")).collect()
    error = {r["item"]: float(np.clip((r["off"] + 10 * spec.rater_error) / (r["n"] + 10), 0.02, 0.6)) for r in raters}
    p = Params(words["item"].cast(pa.large_string()).combine_chunks(), kappa, beta, norm, length, error)
    return p


# --- the operator ---------------------------------------------------------------------------------


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rater: str = "rater", level: str = "level", lang: str | None = "lang", spec: LevelSpec = LevelSpec()) -> DataFrame:
    """Rows (doc_id, level, score, n_words, lang) of every document with enough running prose.

    level is the nearest whole level to the latent score, in the scale of the
    labels. Labels without document, level or within no document with prose are
    left out; any number of labels per document counts, repeated ones too.
    lang names a column of unreliable language labels; without it, all texts
    share their length items.
    Without any usable label there is no scale and level and score are null.
    """
    spark = docs.sparkSession
    languages = learn_languages(docs, doc_id, text, lang) if lang is not None and lang in docs.columns else Languages()
    n_langs = len(languages.names)
    counts = described(docs, doc_id, text, spec, languages)
    labels = pick(labels, doc_id, rater, level)
    marks = labels.select(
        labels[doc_id].cast("long").alias("doc_id"), F.coalesce(labels[rater].cast("string"), F.lit("")).alias("rater"), labels[level].cast("int").alias("level")
    ).where("doc_id is not null and level between 1 and 4")
    marks = marks.groupBy("doc_id", "rater", "level").agg(F.count(F.lit(1)).cast("int").alias("times"))
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("rater", "level", "times")).alias("labels"))
    known = work_table(counts.join(marks, "doc_id"), "labelled-counts")
    langs = F.array(*[F.lit(x) for x in languages.names])
    lang = F.element_at(langs, F.col("lang") + 1).alias("lang")
    if known.isEmpty():
        return counts.select("doc_id", F.lit(None).cast("long").alias("level"), F.lit(None).cast("double").alias("score"), "n_words", lang)
    params = _estimate(known.mapInArrow(_sums(None, {}, 1.0, spec, True, n_langs), _SUMS), spec, n_langs)
    for _ in range(spec.rounds - 1):
        held = spark.sparkContext.broadcast(params)  # grows with the distinct words, not with the texts

        def part(labelled: bool, weight: float, held=held):
            return lambda it: _sums(held.value, held.value.error, weight, spec, labelled, n_langs)(it)

        sums = known.mapInArrow(part(True, 1.0), _SUMS).unionByName(counts.mapInArrow(part(False, spec.unlabelled), _SUMS))
        params = _estimate(sums, spec, n_langs)
    held = spark.sparkContext.broadcast(params)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                theta = _normal(text_loglik(held.value, _frame(b), spec)) @ GRID
                whole = np.clip(np.floor(theta + 0.5), 1, 4).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(whole), pa.array(theta), b["n_words"], b["lang"]], names=["doc_id", "level", "score", "n_words", "lang"])

    return counts.mapInArrow(score, "doc_id long, level long, score double, n_words long, lang int").withColumn("lang", lang)
