"""Column profiles of loads, their violations, and changes of distribution between loads.

Exact base aggregates come from one pass that counts each (load, column, cell
class, number). Changes between a load and its forerunner come from a classifier
two-sample test (load_classifier). Columns by which the loads can be told apart
go to an exact comparison of cumulative shares.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import double_text
from ..functions.text import cell
from ..session import pick, work_table
from .running import running_sums


#: Bins hold at most this part of either load's valid values, but for values that many rows share.
QUANTILES = 16


@dataclass(frozen=True)
class ProfileSpec:
    """Columns with (lowest, highest) bounds, and the load's columns."""

    bounds: dict[str, tuple[float | None, float | None]]
    load: str = "load_id"
    owner: str = "office"
    seq: str = "load_seq"
    rec: str = "rec_no"
    min_valid: int = 20
    missing_share: float = 0.15
    shift_gap: float = 0.25
    tell_apart: float = 0.6  # a column by which a model tells loads apart this well on rows it was not fitted on is looked at
    ablated: float = 0.02  # so is one whose loss costs the model of all columns this much

    @property
    def columns(self) -> list[str]:
        return list(self.bounds)


def codebook_bounds(vars_: DataFrame, block: str, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    """Bounds of the named columns from the codebook; a handful of rows, one per column."""
    rows = vars_.where((F.col("block_name") == block) & F.col("name").isin(columns)).groupBy("name").agg(F.max("rng_min").alias("lo"), F.max("rng_max").alias("hi")).collect()
    got = {r["name"]: (r["lo"], r["hi"]) for r in rows}
    return {c: got.get(c, (None, None)) for c in columns}


def classified(df: DataFrame, spec: ProfileSpec) -> DataFrame:
    """Per row and column the cell's class (blank, pattern, range, valid) and its number."""
    df = pick(df, spec.load, spec.owner, spec.seq, spec.rec, *spec.columns)
    out = df.select(F.col(spec.load).cast("string").alias("load"), F.col(spec.owner).cast("string").alias("owner"), F.col(spec.seq).cast("long").alias("seq"), F.col(spec.rec).cast("long").alias("rec"), *[cell(F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(spec.columns)])
    # in steps, so that each pattern is tried once a cell
    whole = {f"n{i}": F.when(F.col(f"c{i}").rlike("^-?[0-9]+$"), F.col(f"c{i}").try_cast("double")) for i in range(len(spec.columns))}
    out = out.withColumns(whole)
    kinds, values = {}, {}
    for i, (lo, hi) in enumerate(spec.bounds.values()):
        num, outside = F.col(f"n{i}"), F.lit(False)
        if lo is not None:
            outside = outside | (num < lo)
        if hi is not None:
            outside = outside | (num > hi)
        kinds[f"k{i}"] = F.when(F.col(f"c{i}") == "", "blank").when(num.isNull(), "pattern").when(outside, "range").otherwise("valid")
        values[f"v{i}"] = F.when(F.col(f"k{i}") == "valid", num)
    keep = [f"{x}{i}" for i in range(len(spec.columns)) for x in "kv"]
    return out.withColumns(kinds).withColumns(values).select("load", "owner", "seq", "rec", *keep)


def _long(rows: DataFrame, spec: ProfileSpec, *keep: str) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("col"), F.col(f"k{i}").alias("kind"), F.col(f"v{i}").alias("v")) for i, c in enumerate(spec.columns)]
    return rows.select(*keep, F.inline(F.array(*cells)))


def cell_violations(rows: DataFrame, spec: ProfileSpec) -> DataFrame:
    """Rows (column_name, issue, rec_no) for cells that break the pattern or the bounds."""
    return _long(rows, spec, "rec").where("kind in ('pattern', 'range')").select(F.col("col").alias("column_name"), F.col("kind").alias("issue"), F.col("rec").alias("rec_no"))


def quarter_of(rec: str) -> Column:
    """The quarter of the rows, 0 to 3, to which a record belongs; 0 and 1 make the first half."""
    return F.pmod(F.xxhash64(rec), F.lit(4)).cast("int")


def value_counts(rows: DataFrame, spec: ProfileSpec) -> DataFrame:
    """Counts per (load, owner, seq, col, kind, v); combined on the map side, so a hot load is small when it moves."""
    return _long(rows, spec, "load", "owner", "seq").groupBy("load", "owner", "seq", "col", "kind", "v").agg(F.count(F.lit(1)).alias("n"))


def load_pairs(profiles: DataFrame) -> DataFrame:
    """(load, prev) of each load and its owner's load before it."""
    loads = profiles.where("load is not null").select("load", "owner", "seq").distinct()
    before = loads.select(F.col("load").alias("prev"), "owner", (F.col("seq") + 1).alias("seq"))
    return loads.join(before, ["owner", "seq"]).select("load", "prev")


def load_profiles(counts: DataFrame) -> DataFrame:
    """Per load and column: rows, blank, pattern, range, valid, distinct, lowest, highest."""
    n_if = lambda k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k)
    return counts.groupBy("load", "owner", "seq", "col").agg(
        F.sum("n").alias("rows"), *[n_if(k) for k in ("blank", "pattern", "range", "valid")],
        F.count("v").alias("distinct"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
    )


def largest_gaps(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Exact largest gap between the cumulative shares of each (load, prev, col): (…, n1, n0, cross), the gap being cross / (n1 * n0).

    Running sums go over ranges of values, so no task holds a hot load's values.
    """
    valid = counts.where("kind = 'valid'").groupBy("load", "col", "v").agg(F.sum("n").alias("n"))
    cur = pairs.join(valid, ["load", "col"]).select("load", "prev", "col", "v", F.col("n").alias("n1"), F.lit(0).cast("long").alias("n0"))
    old = pairs.join(valid.withColumnRenamed("load", "prev"), ["prev", "col"]).select("load", "prev", "col", "v", F.lit(0).cast("long").alias("n1"), F.col("n").alias("n0"))
    per = cur.unionByName(old).groupBy("load", "prev", "col", "v").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    cum = running_sums(per, ["load", "prev", "col"], "v", ["n1", "n0"])
    gap = F.abs(F.col("cum_n1").cast("decimal(19,0)") * F.col("all_n0") - F.col("cum_n0").cast("decimal(19,0)") * F.col("all_n1"))
    return cum.groupBy("load", "prev", "col").agg(F.max("all_n1").alias("n1"), F.max("all_n0").alias("n0"), F.max(gap).alias("cross"))


def screen_auc(spec: ProfileSpec) -> float:
    """The fitted AUC that a gap over the limit can't fall below.

    The fitted one-column model orders the bins by their odds, so its curve is
    concave, and it passes a point with a gap of at least shift_gap less the
    share of a bin; so the area is at least a half plus half of that.
    """
    return 0.5 + (spec.shift_gap - 1 / QUANTILES) / 2 - 1e-9


def load_issues(rows: DataFrame, spec: ProfileSpec) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(issues, profiles, model): load issues (column_name, issue, load_id), the profile and the model's figures.

    missing: blank share over the limit; constant: at least min_valid valid
    values, all the same; shift: the classifier tells the load from the one
    before by that column (cross-fitted, by ablation, or fitted), and the exact
    gap is over the limit, at an edge of the bins or between two. The first two may miss a shift between loads of few
    rows, the last can't (screen_auc). Rows without a load take no part here;
    empty tables give no rows.
    """
    from .load_classifier import discrimination

    counts = work_table(value_counts(rows, spec), "value-counts")
    profiles = work_table(load_profiles(counts), "load-profiles")
    pairs = load_pairs(profiles)
    model = work_table(discrimination(rows, counts, pairs, spec), "discrimination")
    held = profiles.where("load is not null")
    miss = held.where(F.col("blank") / F.col("rows") > spec.missing_share).select(F.col("col").alias("column_name"), F.lit("missing").alias("issue"), F.col("load").alias("load_id"))
    const = held.where((F.col("valid") >= spec.min_valid) & (F.col("distinct") == 1)).select(F.col("col").alias("column_name"), F.lit("constant").alias("issue"), F.col("load").alias("load_id"))
    ablated = F.col("auc_all") - F.col("auc_without") >= spec.ablated
    told = (F.col("auc_alone") >= spec.tell_apart) | ablated | (F.col("auc_fitted") >= screen_auc(spec))
    enough = (F.col("valid1") >= spec.min_valid) & (F.col("valid0") >= spec.min_valid)
    suspects = model.where(told & enough)
    # between two edges the gap is within a bin's share of that at the edges, so few pairs are still open
    open_ = suspects.where((F.col("edge_gap") <= spec.shift_gap) & (F.col("edge_gap") + 1 / QUANTILES > spec.shift_gap)).select("load", "prev", "col")
    over = F.col("cross").cast("double") / (F.col("n1").cast("double") * F.col("n0")) > spec.shift_gap
    shifted = suspects.where(F.col("edge_gap") > spec.shift_gap).select("load", "col").unionByName(largest_gaps(counts, open_).where(over).select("load", "col"))
    shift = shifted.select(F.col("col").alias("column_name"), F.lit("shift").alias("issue"), F.col("load").alias("load_id")).distinct()
    return miss.unionByName(const).unionByName(shift), profiles, model


def bound_issues(vars_: DataFrame) -> DataFrame:
    """Rows (column_name, issue, rec_no) of a catalogue's impossible bounds; null or NaN bounds break nothing."""
    vars_ = pick(vars_, "rng_min", "rng_max", "ddi_width", "rec_no")
    lo, hi = F.col("rng_min"), F.col("rng_max")
    inverted = vars_.where((lo > hi) & ~F.isnan(lo)).select(F.lit("rng_min").alias("column_name"), F.lit("inverted").alias("issue"), F.col("rec_no"))
    wide = vars_.where((hi >= F.pow(F.lit(10.0), F.col("ddi_width"))) & ~F.isnan(hi)).select(F.lit("rng_max").alias("column_name"), F.lit("too_wide").alias("issue"), F.col("rec_no"))
    return inverted.unionByName(wide)


def bound_profiles(vars_: DataFrame) -> DataFrame:
    """Per bound of a catalogue: rows, missing (null or NaN), inverted, too_wide, distinct, lowest, highest."""
    vars_ = pick(vars_, "rng_min", "rng_max", "ddi_width")
    lo, hi = F.nanvl("rng_min", F.lit(None)), F.nanvl("rng_max", F.lit(None))
    n_if = lambda c: F.when(c, 1).otherwise(0)
    cells = F.array(
        F.struct(F.lit("rng_min").alias("column_name"), lo.alias("v"), n_if(lo > F.col("rng_max")).alias("inverted"), F.lit(0).alias("too_wide")),
        F.struct(F.lit("rng_max").alias("column_name"), hi.alias("v"), F.lit(0).alias("inverted"), n_if(hi >= F.pow(F.lit(10.0), F.col("ddi_width"))).alias("too_wide")),
    )
    counts = vars_.select(F.inline(cells)).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("inverted").alias("inverted"), F.sum("too_wide").alias("too_wide"))
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.sum("inverted").alias("inverted"), F.sum("too_wide").alias("too_wide"),
        F.count("v").alias("distinct"), F.min("v").alias("lowest"), F.max("v").alias("highest"),
    )


def _as_text(name: str, kind: str) -> Column:
    c = F.col(f"`{name}`")
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(""))
    return double_text(c.cast("double")) if kind in ("double", "float") else cell(c.cast("string"))


def column_profiles(df: DataFrame) -> DataFrame:
    """Of every column: (column_name, n_rows, missing, n_distinct, lowest, highest, longest, whole_numbers, other_numbers).

    Values are trimmed texts; null, blank and NaN are missing. lowest and
    highest go by letters, longest is in letters. Two steps: equal values of a
    column are counted, on the map side first, so that repeated values are
    small when they move; then each column is summed up. An empty table gives
    no rows. Columns are told apart by place, so their names may clash.
    """
    names, kinds = df.columns, [t for _, t in df.dtypes]
    plain = df.toDF(*[f"c{i}" for i in range(len(names))])
    cells = F.array(*[F.struct(F.lit(i).alias("i"), _as_text(f"c{i}", t).alias("v")) for i, t in enumerate(kinds)])
    counts = plain.select(F.inline(cells)).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    v, n = F.nullif(F.col("v"), F.lit("")), F.col("n")
    of = lambda cond: F.sum(F.when(cond, n).otherwise(0))
    per = counts.groupBy("i").agg(
        F.sum("n").alias("n_rows"), of(F.col("v") == "").alias("missing"), F.count(v).alias("n_distinct"), F.min(v).alias("lowest"), F.max(v).alias("highest"),
        F.max(F.char_length(v)).cast("long").alias("longest"), of(v.rlike("^-?[0-9]+$")).alias("whole_numbers"), of(v.rlike(r"^-?[0-9]+\.[0-9]+$")).alias("other_numbers"),
    )
    return per.select(F.get(F.array(*[F.lit(x) for x in names]), F.col("i")).alias("column_name"), "n_rows", "missing", "n_distinct", "lowest", "highest", "longest", "whole_numbers", "other_numbers")
