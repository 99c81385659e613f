"""Differences between two copies of a dataset, by hierarchical range checksums.

Every key has a place in the 64-bit space of its hash; a range is a prefix of
that place, so ranges are even whatever the keys look like. Each row is reduced
to hashes once. Each side's hashes are then reduced to a few thousand ranges,
which costs a row per range and task to move, however large the copies are.
Ranges that differ are parted again, by a stage that reads only the hashes in
them, and so on down to leaves of a few rows. Fields are compared for the rows
of differing leaves only.

A checksum is the count, an exclusive-or and sums of 64-bit hashes over the rows
of a range, so order is no matter. Ranges alike as multisets are alike as sets;
where only repeats differ, the leaf is looked at and found alike.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import canonical_decimal, cell
from ..session import pick, work_table

FAN_BITS = 4
#: Bits by which a stage parts ranges.
STAGE_BITS = 12
_PARTS = ("n", "x", "s0", "s1", "s2")


@dataclass(frozen=True)
class CopySpec:
    """Key and compared columns; numeric ones compare as numbers."""

    keys: tuple[str, ...]
    fields: tuple[str, ...]
    numeric: frozenset[str] = frozenset()
    leaf_rows: int = 8
    max_bits: int = 36


def _keyed(df: DataFrame, spec: CopySpec, bits: int) -> DataFrame:
    """Normal keys _k0.., raw fields _f0.. and the leaf _leaf; other columns are gone, so no name can clash."""
    keys = [cell(df[k].cast("string")).alias(f"_k{i}") for i, k in enumerate(spec.keys)]
    out = df.select(*keys, *[df[f].cast("string").alias(f"_f{i}") for i, f in enumerate(spec.fields)])
    place = F.xxhash64(*[out[f"_k{i}"] for i in range(len(spec.keys))])
    leaf = F.lit(0).cast("long") if bits == 0 else F.shiftrightunsigned(place, 64 - bits)
    return out.withColumn("_leaf", leaf)


def _normal(keyed: DataFrame, spec: CopySpec) -> DataFrame:
    """The fields in one writing."""
    one = lambda i, f: canonical_decimal(cell(F.col(f"_f{i}"))) if f in spec.numeric else cell(F.col(f"_f{i}"))
    return keyed.withColumns({f"_f{i}": one(i, f) for i, f in enumerate(spec.fields)})


def _hashes(rows: DataFrame, name: str) -> DataFrame:
    """(_leaf, _x, _y) of each row, stored: what all checksums are made of."""
    cols = [c for c in rows.columns if c != "_leaf"]
    return work_table(rows.select("_leaf", F.xxhash64(*cols).alias("_x"), F.xxhash64(F.lit("second"), *reversed(cols)).alias("_y")), name)


def range_digests(rows: DataFrame, side: str, shift: int = 0) -> DataFrame:
    """One checksum per range of one copy: (_leaf, n_, x_, s0_ to s2_); ranges are shift bits coarser than leaves.

    Sums take 21 bits of a hash each, so they hold for 10^12 rows of a range.
    All is added up on the map side first.
    """
    slim = rows.withColumn("_leaf", F.shiftrightunsigned("_leaf", shift))
    part = lambda i: F.sum(F.shiftrightunsigned("_y", 21 * i).bitwiseAND(F.lit((1 << 21) - 1)))
    return slim.groupBy("_leaf").agg(F.count(F.lit(1)).alias(f"n_{side}"), F.bit_xor("_x").alias(f"x_{side}"), *[part(i).alias(f"s{i}_{side}") for i in range(3)])


def _both(a: DataFrame, b: DataFrame, shift: int, name: str) -> DataFrame:
    return work_table(range_digests(a, "a", shift).join(range_digests(b, "b", shift), "_leaf", "full_outer").na.fill(0), name)


def _fold(level: DataFrame) -> DataFrame:
    """The level above: sixteen ranges become one."""
    aggs = [(F.bit_xor if p == "x" else F.sum)(f"{p}_{s}").alias(f"{p}_{s}") for s in ("a", "b") for p in _PARTS]
    return level.groupBy(F.shiftrightunsigned("_leaf", FAN_BITS).alias("_leaf")).agg(*aggs)


def _differs() -> Column:
    out = F.lit(False)
    for p in _PARTS:
        out = out | (F.col(f"{p}_a") != F.col(f"{p}_b"))
    return out


def depth_bits(rows: int, spec: CopySpec) -> int:
    """Bits of the finest range: at most leaf_rows rows in a leaf on average."""
    return min(spec.max_bits, math.ceil(math.log2(max(1, rows / spec.leaf_rows))))


@dataclass(frozen=True)
class Stage:
    """Checksums of ranges of some bits, of those ranges only whose coarser range differs in the stage before."""

    bits: int
    level: DataFrame
    differing: DataFrame


def digest_stages(a: DataFrame, b: DataFrame, spec: CopySpec) -> tuple[DataFrame, DataFrame, list[Stage]]:
    """Keyed rows of both copies, and the stages from coarse ranges to leaves; the last stage's differing ranges are the differing leaves.

    Each stage parts a differing range in up to 4,096 and reads only the
    hashes of rows in differing ranges. Copies alike end after the first.
    """
    a, b = pick(a, *spec.keys, *spec.fields), pick(b, *spec.keys, *spec.fields)
    bits = depth_bits(max(a.count(), b.count()), spec)
    na, nb = _keyed(a, spec, bits), _keyed(b, spec, bits)
    ha, hb = _hashes(_normal(na, spec), "row-hashes"), _hashes(_normal(nb, spec), "row-hashes")
    out: list[Stage] = []
    for at in [*range(STAGE_BITS, bits, STAGE_BITS), bits]:
        inside = lambda h: h
        if out:
            known, shift = out[-1].differing.withColumnRenamed("_leaf", "_top"), bits - out[-1].bits
            inside = lambda h: h.withColumn("_top", F.shiftrightunsigned("_leaf", shift)).join(known, "_top", "left_semi").drop("_top")  # noqa: B023, E731
        level = _both(inside(ha), inside(hb), bits - at, "digests")
        out.append(Stage(at, level, work_table(level.where(_differs()).select("_leaf"), "differing")))
    return na, nb, out


def diff_copies(a: DataFrame, b: DataFrame, spec: CopySpec, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Rows (keys…, diff, field): one per key on one side only, one per differing field.

    diff is only_<name> with field '' or 'value' with the field's name. Null,
    empty and white space are one value, in keys too. Where a key has several
    distinct rows on a side, a field differs if its set of values differs.
    Empty copies give only_ rows for all of the other; columns beyond the
    spec are not looked at. Output keys are trimmed strings.
    """
    na, nb, stages = digest_stages(a, b, spec)
    leaves = stages[-1].differing
    keys = [f"_k{i}" for i in range(len(spec.keys))]
    rows = na.withColumn("_s", F.lit(1)).unionByName(nb.withColumn("_s", F.lit(2))).join(leaves, "_leaf", "left_semi")
    rows = _normal(rows, spec)  # of the differing leaves only
    cells = [F.struct(F.lit(-1).alias("f"), F.lit("").alias("v"))]
    cells += [F.struct(F.lit(i).alias("f"), F.col(f"_f{i}").alias("v")) for i in range(len(spec.fields))]
    values = rows.select(*keys, "_s", F.inline(F.array(*cells))).groupBy(*keys, "f", "v").agg(F.bit_or("_s").alias("_s"))
    per_key = values.groupBy(*keys).agg(
        F.max(F.when(F.col("f") < 0, F.col("_s"))).alias("_s"),
        F.sort_array(F.collect_set(F.when((F.col("f") >= 0) & (F.col("_s") != 3), F.col("f")))).alias("_fs"),
    )
    field_names = F.array(*[F.lit(f) for f in spec.fields])
    fields = F.when(F.col("_s") == 3, F.transform("_fs", lambda i: F.element_at(field_names, i + 1))).otherwise(F.array(F.lit("")))
    diff = F.when(F.col("_s") == 1, F.lit(f"only_{names[0]}")).when(F.col("_s") == 2, F.lit(f"only_{names[1]}")).otherwise(F.lit("value"))
    return per_key.select(*[F.col(k).alias(n) for k, n in zip(keys, spec.keys)], diff.alias("diff"), F.explode(fields).alias("field"))


def range_report(a: DataFrame, b: DataFrame, spec: CopySpec) -> DataFrame:
    """Per level of the tree, sixteen ranges to one above: ranges looked at, and ranges that differ (level 0 is the root)."""
    _, _, stages = digest_stages(a, b, spec)
    levels: list[DataFrame] = []
    above = 0
    for s in stages:
        own = [s.level]
        for _ in range(math.ceil((s.bits - above) / FAN_BITS) - (1 if above else 0)):
            own.append(_fold(own[-1]))
        levels += reversed(own)
        above = s.bits
    out = None
    for depth, level in enumerate(levels):
        one = level.select(F.lit(depth).cast("long").alias("level"), F.when(_differs(), 1).otherwise(0).alias("d"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("ranges"), F.sum("d").alias("differing"))
