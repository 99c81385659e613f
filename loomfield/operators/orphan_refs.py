"""References to records that do not exist, by range-partitioned sorted arrays.

Parents and references are placed in one order (key place, time) and cut into
ranges of even size, so a key that holds a third of all rows is spread over many
ranges. Within a range the parents become sorted arrays, the references of the
range are looked up in one vectorised binary search. A range can't see parents
of its first and last key that lie in other ranges; references that depend on
them leave with what is known, and are settled against one summary row per
range edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell, micros
from ..session import parts_for, pick, work_table

FOREVER = (1 << 63) - 1
BEGINNING = -(1 << 63)
ROWS_PER_RANGE = 250_000

_OUT = "role tinyint, part int, src int, rec long, period string, k string, t long, prior boolean, has boolean, n long, d long"


@dataclass(frozen=True)
class References:
    """A table that names keys of another; period groups the report."""

    name: str
    df: DataFrame
    key: str
    time: str
    rec: str
    period: str | None = None


def _events(parents: DataFrame, key: str, loaded: str, deleted: str, refs: list[References]) -> DataFrame:
    k = cell(parents[key].cast("string"))
    out = parents.select(
        k.alias("k"),
        F.coalesce(micros(parents[loaded]), F.lit(BEGINNING)).alias("t"),
        F.coalesce(micros(parents[deleted]), F.lit(FOREVER)).alias("d"),
    )
    out = out.groupBy("k", "t").agg(F.max("d").alias("d")).select(
        "k", "t", F.lit(0).cast("tinyint").alias("kind"), "d", F.lit(0).alias("src"), F.lit(0).cast("long").alias("rec"), F.lit(None).cast("string").alias("period")
    )
    for i, r in enumerate(refs):
        period = r.df[r.period].cast("string") if r.period else F.lit(None).cast("string")
        out = out.unionByName(
            r.df.select(
                cell(r.df[r.key].cast("string")).alias("k"),
                F.coalesce(micros(r.df[r.time]), F.lit(FOREVER - 1)).alias("t"),
                F.lit(1).cast("tinyint").alias("kind"),
                F.lit(None).cast("long").alias("d"),
                F.lit(i).alias("src"),
                r.df[r.rec].cast("long").alias("rec"),
                period.alias("period"),
            )
        )
    return out.where(F.col("k") != "").withColumn("h", F.xxhash64("k"))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range: sorted parent arrays, one binary search for all its references."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    tab = pa.Table.from_batches(got)
    del got
    part = tab["part"][0].as_py()
    key = tab["k"].combine_chunks().dictionary_encode()
    code = key.indices.to_numpy(zero_copy_only=False)
    kind, t = tab["kind"].to_numpy(), tab["t"].to_numpy()
    group = np.concatenate(([0], np.cumsum(code[1:] != code[:-1])))  # rows come sorted by key
    last = group[-1]
    is_parent = kind == 0
    pg, pt = group[is_parent], t[is_parent]
    pd_ = tab["d"].combine_chunks().filter(pa.array(is_parent)).to_numpy(zero_copy_only=False).astype(np.int64)
    until = pd.Series(pd_).groupby(pg).cummax().to_numpy() if len(pg) else pd_
    times = np.unique(pt)
    width = len(times) + 1
    place = pg * width + np.searchsorted(times, pt, side="right")  # sorted: parents by key, then time
    rows = np.flatnonzero(~is_parent)
    rg, rt = group[rows], t[rows]
    at = np.searchsorted(place, rg * width + np.searchsorted(times, rt, side="right"), side="right") - 1
    if len(pg):
        prior = (at >= 0) & (pg[np.maximum(at, 0)] == rg)
        in_force = prior & (until[np.maximum(at, 0)] > rt)
    else:
        prior = in_force = np.zeros(len(rows), bool)
    has = np.isin(rg, np.unique(pg))
    edge = (rg == 0) | (rg == last)
    miss = ~in_force
    out = rows[miss]
    n = len(out)
    if n:
        take = pa.array(out)
        role = np.where(edge[miss], 1, 0).astype(np.int8)
        yield pa.RecordBatch.from_arrays(
            [pa.array(role), pa.array(np.full(n, part, np.int32)), tab["src"].combine_chunks().take(take), tab["rec"].combine_chunks().take(take), tab["period"].combine_chunks().take(take),
             tab["k"].combine_chunks().take(take), pa.array(rt[miss]), pa.array(prior[miss]), pa.array(has[miss]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())],
            names=[c.split()[0] for c in _OUT.split(", ")],
        )
    edges = [0] if last == 0 else [0, int(last)]
    firsts = np.searchsorted(group, edges)
    m = len(edges)
    counts = [int((pg == g).sum()) for g in edges]
    most = [int(pd_[pg == g].max()) if c else None for g, c in zip(edges, counts)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(m, 2, np.int8)), pa.array(np.full(m, part, np.int32)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()),
         tab["k"].combine_chunks().take(pa.array(firsts)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.bool_()), pa.array(counts, pa.int64()), pa.array(most, pa.int64())],
        names=[c.split()[0] for c in _OUT.split(", ")],
    )


def orphan_references(parents: DataFrame, key: str, loaded: str, deleted: str, refs: list[References], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows (table_name, rec_no, period, kind) for references with no parent in force at their time.

    A parent row is in force from its load time up to, not including, its
    deletion. kind: missing (no row of that key at all), late (all its rows
    were loaded later), deleted (otherwise). Keys compare trimmed; blank keys
    refer to nothing and give no row. A parent without load time counts as
    loaded from the beginning, a reference without time is judged after all
    loads. Repeated parent rows count once; repeated references each give
    their row. Empty parents make every reference missing.
    """
    parents = pick(parents, key, loaded, deleted)
    refs = [replace(r, df=pick(r.df, r.key, r.time, r.rec, *([r.period] if r.period else []))) for r in refs]
    ev = _events(parents, key, loaded, deleted, refs)
    spark = parents.sparkSession
    rows = parents.count() + sum(r.df.count() for r in refs)
    ranges = parts_for(spark, rows, rows_per_range)
    order = ["h", "k", "t", "kind", "salt"]
    laid = ev.withColumn("salt", F.xxhash64("rec", "src")).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    laid = laid.withColumn("part", F.spark_partition_id()).drop("h", "salt")
    probed = work_table(laid.mapInArrow(_probe, _OUT), "probed-ranges")
    final = probed.where("role = 0").select("src", "rec", "period", F.when(~F.col("has"), "missing").when(~F.col("prior"), "late").otherwise("deleted").alias("kind"))
    by_key = Window.partitionBy("k")
    before = by_key.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = probed.where("role = 2").select(
        "part", "k", F.max("d").over(before).alias("d0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.sum("n").over(by_key).alias("n1")
    )
    open_ = probed.where("role = 1").select("part", "k", "src", "rec", "period", "t", "prior").join(edges, ["part", "k"])
    settled = open_.where(~(F.coalesce(F.col("d0") > F.col("t"), F.lit(False)))).select(
        "src", "rec", "period", F.when(F.col("n1") == 0, "missing").when(~F.col("prior") & (F.col("n0") == 0), "late").otherwise("deleted").alias("kind")
    )
    names = F.array(*[F.lit(r.name) for r in refs])
    return final.unionByName(settled).select(F.element_at(names, F.col("src") + 1).alias("table_name"), F.col("rec").alias("rec_no"), "period", "kind")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per table, period and kind."""
    return orphans.groupBy("table_name", F.coalesce(F.col("period"), F.lit("")).alias("period"), "kind").agg(F.count(F.lit(1)).alias("orphans"))
