"""Classifier two-sample test between each load and the one before it.

Values fall into bins at both loads' sixteenths; blank and faulty cells have bins
of their own. Rows are halved, and everything that is judged on one half was
fitted on the other. Halves are halved again where a model is fitted on top of
others, so that it sees them at work on rows they were not fitted on.

* A column alone: the log-odds of its bins, from counts.
* All columns: a logistic regression on the columns' log-odds, one weight a
  column. Its Newton steps are sums over rows, made in the cluster: each task
  adds up what its rows say of each pair of loads, and what moves is one
  gradient and one curvature per task and pair.
* Ablation: the same model with a column's part left out of the score.

Work and memory grow with the columns, not with the joint bins: nothing holds
the rows of a pair together. Curves are summed over steps of the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import work_table
from .quality_profile import QUANTILES, ProfileSpec, quarter_of
from .running import running_sums

BLANK, FAULTY = -1, -2
#: Added to each bin's counts, so that a bin unseen in one load has finite odds.
SMOOTH = 0.5
STEPS = 2
RIDGE = 0.05
#: Scores are summed in steps of 1 / FINE up to +-FAR.
FINE, FAR = 20, 10


def bin_edges(counts: DataFrame) -> DataFrame:
    """Per load and column the values at each sixteenth of the cumulative share: (load, col, edges)."""
    valid = counts.where("kind = 'valid' and load is not null").groupBy("load", "col", "v").agg(F.sum("n").alias("n"))
    cum = running_sums(valid, ["load", "col"], "v", ["n"])
    step = lambda c: F.floor(c * QUANTILES / F.col("all_n"))
    return cum.where(step(F.col("cum_n")) > step(F.col("cum_n") - F.col("n"))).groupBy("load", "col").agg(F.collect_set("v").alias("edges"))


def _sides(pairs: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """(at, pair, y, edges): each pair once for either load, with both loads' edges per column in the spec's order."""
    none = F.array().cast("array<double>")
    wide = edges.groupBy("load").agg(F.map_from_entries(F.collect_list(F.struct("col", "edges"))).alias("e"))
    both = pairs.join(wide, "load", "left").join(wide.select(F.col("load").alias("prev"), F.col("e").alias("p")), "prev", "left")
    of = lambda m, c: F.coalesce(F.try_element_at(m, F.lit(c)), none)
    both = both.select("load", "prev", F.array(*[F.array_union(of(F.col("e"), c), of(F.col("p"), c)) for c in columns]).alias("edges"))
    side = lambda at, y: both.select(F.col(at).alias("at"), F.col("load").alias("pair"), F.lit(y).alias("y"), "edges")
    return side("load", 1).unionByName(side("prev", 0))


def _bin(kind: Column, v: Column, edges: Column) -> Column:
    below = F.size(F.filter(edges, lambda e: e < v))
    return F.when(kind == "valid", below).when(kind == "blank", BLANK).otherwise(FAULTY)


def pair_cells(rows: DataFrame, sides: DataFrame, spec: ProfileSpec) -> DataFrame:
    """(pair, quarter, b, n1, n0): rows of both loads per quarter and bins of all columns. At most as many as rows."""
    k = len(spec.columns)
    slim = rows.where("load is not null").select(F.col("load").alias("at"), quarter_of("rec").alias("quarter"), *[c for i in range(k) for c in (f"k{i}", f"v{i}")])
    bins = F.array(*[_bin(F.col(f"k{i}"), F.col(f"v{i}"), F.element_at("edges", i + 1)) for i in range(k)])
    return slim.join(sides, "at").groupBy("pair", "quarter", bins.alias("b")).agg(F.count_if(F.col("y") == 1).alias("n1"), F.count_if(F.col("y") == 0).alias("n0"))


def _curve(p: np.ndarray, q: np.ndarray, score: np.ndarray) -> tuple[float, float]:
    """(area under the curve, compared pairs) of counts with a score; equal scores count half."""
    weight = float(p.sum()) * float(q.sum())
    if not weight:
        return 0.5, 0.0
    _, inv = np.unique(score, return_inverse=True)
    p, q = np.bincount(inv, p), np.bincount(inv, q)
    return float((p * (np.cumsum(q) - q / 2)).sum()) / weight, weight


def _log_odds(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each bin, and the same drawn towards 0 by as much as they may owe to chance.

    What the log-odds vary beyond the counts' own variance is held against that
    variance. With many columns that say nothing the sum of their chances would
    drown the rest.
    """
    share = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * len(c)))
    w, noise = share(p) - share(q), 1 / (p + SMOOTH) + 1 / (q + SMOOTH)
    true = max(1e-6, float(((p + q) * (w**2 - noise)).sum() / max((p + q).sum(), 1)))
    return w, w * true / (true + noise)


_FITS = ("h0", "h1", "f0", "f1", "f2", "f3")
_HALVES = {"h0": [0, 1], "h1": [2, 3]}
_PARTS = {**_HALVES, "f0": [0], "f1": [1], "f2": [2], "f3": [3]}
_MODEL = "pair string, columns array<struct<gap:double,valid1:long,valid0:long,bins:array<int>,odds:array<array<double>>,auc_alone:double,auc_fitted:double>>, all1 array<long>, all0 array<long>"
_MODEL_ARROW = pa.schema([
    ("pair", pa.string()), ("columns", pa.list_(pa.struct([("gap", pa.float64()), ("valid1", pa.int64()), ("valid0", pa.int64()), ("bins", pa.list_(pa.int32())), ("odds", pa.list_(pa.list_(pa.float64()))), ("auc_alone", pa.float64()), ("auc_fitted", pa.float64())]))),
    ("all1", pa.list_(pa.int64())), ("all0", pa.list_(pa.int64())),
])


def _one_column(at: np.ndarray, p: np.ndarray, q: np.ndarray) -> dict:
    """Bins of one column with counts of both loads by quarter: per bin the log-odds of all fits, and the curves over valid values."""
    odds = {n: _log_odds(p[:, x].sum(1), q[:, x].sum(1)) for n, x in _PARTS.items()}
    ok = at >= 0
    judged = [_curve(p[ok][:, _HALVES[own]].sum(1), q[ok][:, _HALVES[own]].sum(1), odds[other][0][ok]) for own, other in (("h0", "h1"), ("h1", "h0"))]
    weight = sum(w for _, w in judged)
    whole_p, whole_q = p[ok].sum(1), q[ok].sum(1)
    fitted = _curve(whole_p, whole_q, whole_p / np.maximum(whole_p + whole_q, 1))[0]
    p_at, q_at, n1, n0 = np.cumsum(whole_p), np.cumsum(whole_q), whole_p.sum(), whole_q.sum()
    gap = float((np.abs(p_at * n0 - q_at * n1) / (n1 * n0)).max()) if n1 and n0 else 0.0
    return {"gap": gap, "valid1": int(n1), "valid0": int(n0), "bins": at.tolist(), "odds": np.stack([odds[n][1] for n in _FITS], 1).tolist(), "auc_alone": sum(a * w for a, w in judged) / weight if weight else 0.5, "auc_fitted": fitted}


def _column_models(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for pair, bins in zip(b["pair"].to_pylist(), b["bins"].to_pylist()):
                bins.sort(key=lambda x: (x["i"], x["bin"]))
                i, at = (np.array([x[c] for x in bins]) for c in ("i", "bin"))
                p, q = (np.array([x[c] for x in bins], float) for c in ("p", "q"))
                cols = [_one_column(at[i == c], p[i == c], q[i == c]) for c in range(k)]
                first = i == 0  # every row is in some bin of each column
                rows.append((pair, cols, [int(p[first][:, x].sum()) for x in _HALVES.values()], [int(q[first][:, x].sum()) for x in _HALVES.values()]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _MODEL_ARROW)], schema=_MODEL_ARROW)

    return run


def column_models(cells: DataFrame, k: int) -> DataFrame:
    """Per pair the models of its columns, each alone: bins, their log-odds fitted on halves and quarters, curves; and rows of both loads' halves.

    What meets in a row are a pair's bins, a few dozen a column at most.
    """
    long = cells.select("pair", "quarter", "n1", "n0", F.posexplode("b").alias("i", "bin"))
    of = lambda c: F.array(*[F.sum(F.when(F.col("quarter") == q, F.col(c)).otherwise(0)) for q in range(4)])
    bins = long.groupBy("pair", "i", "bin").agg(of("n1").alias("p"), of("n0").alias("q"))
    return bins.groupBy("pair").agg(F.collect_list(F.struct("i", "bin", "p", "q")).alias("bins")).mapInArrow(_column_models(k), _MODEL)


def _features(cells: DataFrame, models: DataFrame, k: int) -> DataFrame:
    """(pair, fold, n1, n0, own, other) of cells: log-odds fitted on the other quarter of the cell's half, and on the other half."""
    tables = models.select("pair", F.transform("columns", lambda c: F.map_from_arrays(c["bins"], c["odds"])).alias("m"))
    got = cells.join(tables, "pair").withColumn("e", F.array(*[F.element_at(F.element_at("m", i + 1), F.element_at("b", i + 1)) for i in range(k)]))
    of = lambda fit: F.transform("e", lambda x: x[_FITS.index(fit)])
    q = F.col("quarter")
    own = F.when(q == 0, of("f1")).when(q == 1, of("f0")).when(q == 2, of("f3")).otherwise(of("f2"))
    return got.select("pair", F.floor(q / 2).cast("int").alias("fold"), "n1", "n0", own.alias("own"), F.when(q < 2, of("h1")).otherwise(of("h0")).alias("other"))


def _runs(b: pa.RecordBatch) -> tuple[np.ndarray, list, np.ndarray]:
    """(order that brings rows of one pair and half together, their (pair, fold), where each run begins)."""
    pair, fold = b["pair"].dictionary_encode(), b["fold"].to_numpy()
    key = pair.indices.to_numpy().astype(np.int64) * 2 + fold
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else np.zeros(0, int)
    names = pair.dictionary.to_pylist()
    return order, [(names[key[order[s]] >> 1], int(key[order[s]] & 1)) for s in starts], starts


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _gradients(k: int):
    """Per batch, pair and half: what its rows add to the gradient and the curvature of the likelihood; both loads weigh the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order, names, starts = _runs(b)
            x = np.c_[np.ones(b.num_rows), _matrix(b["own"], k)][order]
            beta = _matrix(b["beta"], k + 1)[order]
            get = lambda c: b[c].to_numpy().astype(float)[order]  # noqa: B023, E731
            half = (get("all1") + get("all0")) / 2
            pos, neg = get("n1") * half / np.maximum(get("all1"), 1), get("n0") * half / np.maximum(get("all0"), 1)
            p = 1 / (1 + np.exp(-np.clip((x * beta).sum(1), -30, 30)))
            g = x * (pos - (pos + neg) * p)[:, None]
            h = (x[:, :, None] * x[:, None, :] * ((pos + neg) * p * (1 - p))[:, None, None]).reshape(len(x), -1)
            sums = np.add.reduceat(np.c_[g, h], starts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in names], pa.string()), pa.array([f for _, f in names], pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["pair", "fold", "s"])

    return run


def _newton(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for beta, s in zip(b["beta"].to_pylist(), b["s"].to_pylist()):
                beta = np.array(beta)
                g, h = np.array(s[: k + 1]), np.array(s[k + 1 :]).reshape(k + 1, k + 1)
                step = np.linalg.solve(h + RIDGE * np.eye(k + 1), g - RIDGE * (beta - np.r_[0.0, np.ones(k)]))
                out.append(beta + np.clip(step, -2, 2))
            yield pa.RecordBatch.from_arrays([b["pair"], b["fold"], b["all1"], b["all0"], pa.array(out, pa.list_(pa.float64()))], names=["pair", "fold", "all1", "all0", "beta"])

    return run


def _scores(k: int):
    """Per batch, pair and half: counts of both loads at each step of the score, of the whole model (0) and without column i (i)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            order, names, starts = _runs(b)
            part = _matrix(b["beta"], k + 1)[:, 1:] * _matrix(b["other"], k)
            z = part.sum(1)[:, None] - np.c_[np.zeros(b.num_rows), part]
            z = np.rint(np.clip(z, -FAR, FAR) * FINE).astype(np.int64)[order]
            n1, n0 = (b[c].to_numpy()[order] for c in ("n1", "n0"))
            run_of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(order)]))
            cols: list[list] = [[] for _ in range(6)]
            for m in range(k + 1):
                at, inv = np.unique(run_of * (4 * FAR * FINE) + z[:, m] + 2 * FAR * FINE, return_inverse=True)
                where = [names[r] for r in at // (4 * FAR * FINE)]
                for c, v in zip(cols, ([n for n, _ in where], [f for _, f in where], [m] * len(at), (at % (4 * FAR * FINE) - 2 * FAR * FINE).tolist(), np.bincount(inv, n1).astype(np.int64).tolist(), np.bincount(inv, n0).astype(np.int64).tolist())):
                    c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["pair", "fold", "m", "z", "n1", "n0"])

    return run


def _model_curves(k: int):
    """Of each pair the cross-fitted curve of the whole model (first) and without each column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for steps in b["steps"].to_pylist():
                fold, m, z, n1, n0 = (np.array([x[c] for x in steps]) for c in ("fold", "m", "z", "n1", "n0"))
                figures = []
                for i in range(k + 1):
                    judged = [_curve(n1[at], n0[at], z[at]) for at in ((m == i) & (fold == f) for f in (0, 1))]
                    weight = sum(w for _, w in judged)
                    figures.append(sum(a * w for a, w in judged) / weight if weight else 0.5)
                out.append(figures)
            yield pa.RecordBatch.from_arrays([b["pair"], pa.array(out, pa.list_(pa.float64()))], names=["pair", "auc"])

    return run


def discrimination(rows: DataFrame, counts: DataFrame, pairs: DataFrame, spec: ProfileSpec) -> DataFrame:
    """(load, prev, col, auc_all, auc_without, auc_alone, auc_fitted, edge_gap, valid1, valid0) of each pair of loads and column.

    auc_all, auc_without and auc_alone are cross-fitted: the model of all
    columns, the same without the column, and the column's own, the last over
    valid values. auc_fitted is the own model's on the values it was fitted to.
    At some edge of the bins the gap between the loads' cumulative shares is
    within a sixteenth of its maximum, which bounds auc_fitted from below. edge_gap is the largest at the edges,
    exact as the bins' counts are; valid1 and valid0 count valid values.
    """
    k = len(spec.columns)
    sides = work_table(_sides(pairs, bin_edges(counts), spec.columns), "pair-edges")
    joint = work_table(pair_cells(rows, sides, spec), "pair-bins")
    models = work_table(column_models(joint, k), "column-models")
    cells = work_table(_features(joint, models, k).sortWithinPartitions("pair"), "pair-cells")
    start = F.array(F.lit(0.0), *[F.lit(1.0)] * k).alias("beta")
    half = lambda f: F.struct(F.lit(f).alias("fold"), F.get("all1", F.lit(f)).alias("all1"), F.get("all0", F.lit(f)).alias("all0"))
    weights = models.select("pair", F.inline(F.array(half(0), half(1)))).select("*", start)
    shape = "pair string, fold int, all1 long, all0 long, beta array<double>"
    for _ in range(STEPS):
        parts = cells.join(weights, ["pair", "fold"]).select("pair", "fold", "n1", "n0", "own", "all1", "all0", "beta").mapInArrow(_gradients(k), "pair string, fold int, s array<double>")
        sums = parts.select("pair", "fold", F.posexplode("s").alias("at", "x")).groupBy("pair", "fold", "at").agg(F.sum("x").alias("x"))
        sums = sums.groupBy("pair", "fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("s"))
        weights = work_table(weights.join(sums, ["pair", "fold"]).select("pair", "fold", "all1", "all0", "beta", "s").mapInArrow(_newton(k), shape), "pair-weights")
    other = weights.select("pair", (1 - F.col("fold")).alias("fold"), "beta")
    steps = cells.join(other, ["pair", "fold"]).select("pair", "fold", "n1", "n0", "other", "beta").mapInArrow(_scores(k), "pair string, fold int, m int, z int, n1 long, n0 long")
    steps = steps.groupBy("pair", "fold", "m", "z").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    curves = steps.groupBy("pair").agg(F.collect_list(F.struct("fold", "m", "z", "n1", "n0")).alias("steps")).mapInArrow(_model_curves(k), "pair string, auc array<double>")
    at = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i")
    got = models.select("pair", "columns").join(curves, "pair", "left").select("pair", "columns", "auc", at)
    alone = lambda c: F.get("columns", F.col("i"))[c].alias(c)
    got = got.select(F.col("pair").alias("load"), F.get(F.array(*[F.lit(c) for c in spec.columns]), F.col("i")).alias("col"), F.get("auc", F.lit(0)).alias("auc_all"), F.get("auc", F.col("i") + 1).alias("auc_without"), alone("auc_alone"), alone("auc_fitted"), alone("gap"), alone("valid1"), alone("valid0"))
    half_if_none = lambda c: F.coalesce(c, F.lit(0.5)).alias(c)
    return pairs.join(got, "load").select("load", "prev", "col", *map(half_if_none, ("auc_all", "auc_without", "auc_alone", "auc_fitted")), F.col("gap").alias("edge_gap"), "valid1", "valid0")
