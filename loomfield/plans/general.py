"""Queries p1 to p5 and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import cell
from ..operators import codebook_tables, copy_diff, nested_records, orphan_refs, quality_profile, schema_drift
from ..session import once, scratch, table, work_table

RECORDS = "block_10_household_loan_records"
EXPORT = "block_10_household_loan_export"
PERSONS = "block_41_persons_demogrphic_weelyactivity_records"
HOUSEHOLDS = "block_1_3_household_records"
LOAN_BLOCK = "Block-10-Household-Loan-records"
LOAN_FIELDS = ("B10_q2", "B10_q3", "B10_q4", "B10_q5", "B10_q6", "Wgt1_strm")


def _loan_spec(spark: SparkSession, d: str) -> copy_diff.CopySpec:
    book = table(spark, d, "codebook_vars").where((F.col("block_name") == LOAN_BLOCK) & (F.col("type") == "numeric"))
    numeric = frozenset(r["name"] for r in book.select("name").collect())  # one codebook's variables
    return copy_diff.CopySpec(("Hhold_key", "B10_q1"), LOAN_FIELDS, numeric & frozenset(LOAN_FIELDS))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return copy_diff.diff_copies(table(spark, d, RECORDS), table(spark, d, EXPORT), _loan_spec(spark, d), ("records", "export"))


def p1_per_field(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("diff", "field").agg(F.count(F.lit(1)).alias("loans"))


def p1_ranges(spark: SparkSession, d: str) -> DataFrame:
    return copy_diff.range_report(table(spark, d, RECORDS), table(spark, d, EXPORT), _loan_spec(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return codebook_tables.codebook_links(table(spark, d, "ddi_codebooks"))


def p2_variables(spark: SparkSession, d: str) -> DataFrame:
    t = codebook_tables.codebook_tables(table(spark, d, "ddi_codebooks"))["variables"]
    return t.select(F.col("doc").alias("codebook_id"), "var_id", "name", "label", F.size("file_ids").cast("long").alias("n_files"))


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    t = codebook_tables.codebook_tables(table(spark, d, "ddi_codebooks"))["files"]
    return t.select(F.col("doc").alias("codebook_id"), "file_id", "cases")


def p2_categories(spark: SparkSession, d: str) -> DataFrame:
    t = codebook_tables.codebook_tables(table(spark, d, "ddi_codebooks"))["categories"]
    return t.select(F.col("doc").alias("codebook_id"), "var_id", F.col("value").alias("category"))


def p2_refused(spark: SparkSession, d: str) -> DataFrame:
    """Codebooks that p2_found leaves out, although well-formed, as their entities grow beyond the parser's limit."""
    return nested_records.refused_texts(table(spark, d, "ddi_codebooks"), "codebook_id", "ddi_xml").select(F.col("doc").alias("codebook_id"))


def _profile_spec(spark: SparkSession, d: str) -> quality_profile.ProfileSpec:
    return quality_profile.ProfileSpec(quality_profile.codebook_bounds(table(spark, d, "codebook_vars"), LOAN_BLOCK, ["B10_q3", "Wgt1_strm"]))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    spec = _profile_spec(spark, d)
    rows = work_table(quality_profile.classified(table(spark, d, RECORDS), spec), "classified")
    issues, _, _ = quality_profile.load_issues(rows, spec)
    shape = lambda df, name, load, rec: df.select(F.lit(name).alias("table_name"), "column_name", "issue", load.alias("load_id"), rec.cast("long").alias("rec_no"))
    return (
        shape(quality_profile.cell_violations(rows, spec), RECORDS, F.lit(""), F.col("rec_no"))
        .unionByName(shape(issues, RECORDS, F.col("load_id"), F.lit(0)))
        .unionByName(shape(quality_profile.bound_issues(table(spark, d, "ddi_variables")), "ddi_variables", F.lit(""), F.col("rec_no")))
    )


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    spec = _profile_spec(spark, d)
    counts = quality_profile.value_counts(quality_profile.classified(table(spark, d, RECORDS), spec), spec)
    p = quality_profile.load_profiles(counts)
    return p.select(F.col("load").alias("load_id"), F.col("col").alias("column_name"), F.col("rows").alias("n_rows"), "blank", F.col("pattern").alias("bad_pattern"), F.col("range").alias("out_of_range"), "valid", F.col("distinct").alias("n_distinct"), "lowest", "highest")


_PROFILED = {
    RECORDS: ["rec_no", "Hhold_key", *[f"B10_q{i}" for i in range(1, 7)], "Wgt1_strm", "sub_round", "office", "load_id", "load_seq", "loaded_at"],
    EXPORT: ["line_no", "Hhold_key", *[f"B10_q{i}" for i in range(1, 7)], "Wgt1_strm"],
    HOUSEHOLDS: ["rec_no", "Hhold_key", "State_cd", "B1_q4", "B1_q7", "B1_q9", "B1_q12", "Wgt1_strm", "sub_round", "loaded_at", "deleted_at"],
    PERSONS: ["rec_no", "Hhold_key", *[f"B41_q{i}" for i in range(1, 10)], "Wgt1_strm", "sub_round", "loaded_at"],
    "ddi_variables": ["rec_no", "delivery_id", "series_id", "round_no", "fid", "ddi_pos", "name", "label", "type", "ddi_width", "dcml", "rng_min", "rng_max", "loaded_at"],
}


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """Every column of the survey tables and of the delivered variables."""
    out = None
    for t in _PROFILED:
        one = quality_profile.column_profiles(table(spark, d, t)).select(F.lit(t).alias("table_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    p = quality_profile.bound_profiles(table(spark, d, "ddi_variables"))
    return p.select("column_name", F.col("rows").alias("n_rows"), "missing", "inverted", "too_wide", F.col("distinct").alias("n_distinct"), "lowest", "highest")


def p3_shifts(spark: SparkSession, d: str) -> DataFrame:
    """The model's figures for each load against its forerunner; no SQL states them."""
    spec = _profile_spec(spark, d)
    rows = work_table(quality_profile.classified(table(spark, d, RECORDS), spec), "classified")
    return quality_profile.load_issues(rows, spec)[2].select(F.col("load").alias("load_id"), F.col("prev").alias("prev_load_id"), F.col("col").alias("column_name"), "auc_all", "auc_without", "auc_alone", "auc_fitted")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    refs = [orphan_refs.References(n, table(spark, d, n), "Hhold_key", "loaded_at", "rec_no", "sub_round") for n in (PERSONS, RECORDS)]
    return orphan_refs.orphan_references(table(spark, d, HOUSEHOLDS), "Hhold_key", "loaded_at", "deleted_at", refs)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("table_name", "rec_no", "kind")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_refs.orphan_report(_orphans(spark, d)).withColumnRenamed("period", "sub_round")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, d, "ddi_variables")).select("series_id", "fid", "round_no", "change", "name")


def p5_per_change(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("change").agg(F.count(F.lit(1)).alias("cases"), F.count_distinct("series_id").alias("series"))


def p5_table(spark: SparkSession, d: str) -> DataFrame:
    t = schema_drift.unified_variables(table(spark, d, "ddi_variables"))
    return t.select("series_id", "fid", "round_no", "name", "variable", "type", "width", "unified_type", "unified_width")


def _drifting_files(spark: SparkSession, d: str) -> list[str]:
    """The loan records as four deliveries of a quarter each: as they are; with columns renamed, typed and added; with columns in groups; and one more as the first."""

    def make():
        df = table(spark, d, RECORDS)
        said = lambda c, name, label: c.alias(name, metadata={"label": label})
        part = lambda i: df.where(F.pmod("rec_no", F.lit(4)) == i)
        c, text = F.col, cell(F.col("B10_q3"))
        amount = F.when(text.rlike("^-?[0-9]{1,18}$"), text.cast("bigint"))
        first = [c("rec_no"), said(c("Hhold_key"), "Hhold_key", "Household key"), said(c("B10_q3"), "B10_q3", "Amount outstanding"), c("sub_round"), c("office"), c("load_seq")]
        second = [c("rec_no"), said(c("Hhold_key"), "household", "household KEY"), said(amount, "amount", "amount, outstanding"), c("sub_round"), c("load_seq").cast("bigint").alias("load_seq"), c("loaded_at")]
        third = [c("rec_no"), F.struct(said(c("Hhold_key"), "household", "Household key"), c("sub_round")).alias("who"), F.struct(said(amount, "amount", "Amount outstanding"), c("B10_q5").alias("months")).alias("loan"), c("load_seq").cast("bigint").alias("load_seq")]
        fourth = [c("rec_no"), F.struct(said(c("Hhold_key"), "household", "Household key"), c("sub_round")).alias("asked"), F.struct(said(amount, "amount", "Amount outstanding"), c("B10_q5").alias("months")).alias("loan"), c("load_seq").cast("bigint").alias("load_seq"), c("office")]
        base, out = scratch(spark, "drifting"), []
        for i, cols in enumerate((first, second, third, fourth)):
            out.append(f"{base}/{i}.parquet")
            part(i).select(*cols).write.parquet(out[-1])
        return out

    return once(spark, (d, "drifting"), make)


def p5_unified_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of four schemas read as one table by the projections that their edit scripts compile to."""
    return schema_drift.read_unified(spark, _drifting_files(spark, d))[0]


def p5_file_changes(spark: SparkSession, d: str) -> DataFrame:
    """The edit scripts between those files."""
    scripts = schema_drift.read_unified(spark, _drifting_files(spark, d))[1]
    at = lambda x: ".".join(x.path) if x else None
    rows = [(i, e.op, at(e.old), at(e.new)) for i, s in enumerate(scripts, 1) for e in s]
    return spark.createDataFrame(rows, "version int, change string, old_path string, new_path string")


QUERIES = {f.__name__: f for f in (p1_found, p1_per_field, p1_ranges, p2_found, p2_files, p2_variables, p2_categories, p2_refused, p3_found, p3_profile, p3_columns, p3_bounds, p3_shifts, p4_found, p4_report, p5_found, p5_per_change, p5_table, p5_unified_files, p5_file_changes)}

# --- SQL ------------------------------------------------------------------------------------------

_SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def _cell(c: str) -> str:
    return f"coalesce(trim({c}, {_SPACE}), '')"


def _number(c: str) -> str:
    """One writing for each number; the cells of these tables fit a decimal."""
    ok = rf"regexp_full_match({c}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)')"
    return f"CASE WHEN {ok} THEN CAST(TRY_CAST({c} AS DECIMAL(38,10)) AS VARCHAR) ELSE {c} END"


def _loans_sql(t: str) -> str:
    fields = ", ".join(f"{_cell(f) if f in ('B10_q2', 'B10_q4') else _number(_cell(f))} AS {f}" for f in LOAN_FIELDS)
    return f"SELECT DISTINCT {_cell('Hhold_key')} AS k, {_cell('B10_q1')} AS q, {fields} FROM {t}"


_P1 = f"""
WITH a AS ({_loans_sql(RECORDS)}), b AS ({_loans_sql(EXPORT)}),
j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(a.q, b.q) AS q, a.k IS NULL AS no_a, b.k IS NULL AS no_b,
      {', '.join(f'a.{f} <> b.{f} AS d_{f}' for f in LOAN_FIELDS)}
      FROM a FULL OUTER JOIN b ON a.k = b.k AND a.q = b.q)
SELECT k AS "Hhold_key", q AS "B10_q1", 'only_records' AS diff, '' AS field FROM j WHERE no_b
UNION ALL SELECT k, q, 'only_export', '' FROM j WHERE no_a
""" + "".join(f"UNION ALL SELECT k, q, 'value', '{f}' FROM j WHERE d_{f}\n" for f in LOAN_FIELDS)

_CLASSED = " UNION ALL ".join(
    f"""SELECT rec_no, load_id, office, load_seq, '{c}' AS col, CASE WHEN v = '' THEN 'blank' WHEN NOT regexp_full_match(v, '-?[0-9]+') THEN 'pattern'
        WHEN CAST(v AS DOUBLE) < b.rng_min OR CAST(v AS DOUBLE) > b.rng_max THEN 'range' ELSE 'valid' END AS kind,
        CASE WHEN regexp_full_match(v, '-?[0-9]+') AND NOT (CAST(v AS DOUBLE) < b.rng_min OR CAST(v AS DOUBLE) > b.rng_max) THEN CAST(v AS DOUBLE) END AS num
        FROM (SELECT *, {_cell(c)} AS v FROM {RECORDS}) r, (SELECT rng_min, rng_max FROM codebook_vars WHERE block_name = '{LOAN_BLOCK}' AND name = '{c}') b"""
    for c in ("B10_q3", "Wgt1_strm")
)
_PROFILE = """p AS (SELECT load_id, office, load_seq, col, count(*) AS n_rows, count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'pattern') AS bad_pattern,
  count(*) FILTER (kind = 'range') AS out_of_range, count(*) FILTER (kind = 'valid') AS valid, count(DISTINCT num) AS n_distinct, min(num) AS lowest, max(num) AS highest FROM c GROUP BY ALL)"""
_P3 = f"""
WITH c AS ({_CLASSED}), {_PROFILE},
pairs AS (SELECT x.load_id, x.col, y.load_id AS prev, x.valid AS n1, y.valid AS n0 FROM p x JOIN p y ON x.office = y.office AND x.col = y.col AND y.load_seq = x.load_seq - 1 WHERE x.valid >= 20 AND y.valid >= 20),
pts AS (SELECT pairs.load_id, pairs.col, n1, n0, c.num, count(*) FILTER (c.load_id = pairs.load_id) AS m1, count(*) FILTER (c.load_id = prev) AS m0
  FROM pairs JOIN c ON c.col = pairs.col AND c.load_id IN (pairs.load_id, prev) AND c.kind = 'valid' GROUP BY ALL),
cum AS (SELECT load_id, col, abs(sum(m1) OVER w / n1 - sum(m0) OVER w / n0) AS gap FROM pts WINDOW w AS (PARTITION BY load_id, col ORDER BY num))
SELECT '{RECORDS}' AS table_name, col AS column_name, kind AS issue, '' AS load_id, rec_no FROM c WHERE kind IN ('pattern', 'range')
UNION ALL SELECT '{RECORDS}', col, 'missing', load_id, 0 FROM p WHERE blank / n_rows > 0.15
UNION ALL SELECT '{RECORDS}', col, 'constant', load_id, 0 FROM p WHERE valid >= 20 AND n_distinct = 1
UNION ALL SELECT '{RECORDS}', col, 'shift', load_id, 0 FROM cum GROUP BY load_id, col HAVING max(gap) > 0.25
UNION ALL SELECT 'ddi_variables', 'rng_min', 'inverted', '', rec_no FROM ddi_variables WHERE rng_min > rng_max
UNION ALL SELECT 'ddi_variables', 'rng_max', 'too_wide', '', rec_no FROM ddi_variables WHERE rng_max >= pow(10, ddi_width)
"""


def _orphan_sql(t: str) -> str:
    return f"""SELECT '{t}' AS table_name, r.rec_no, r.sub_round,
  CASE WHEN h.k IS NULL THEN 'missing' WHEN h.first > r.loaded_at THEN 'late' ELSE 'deleted' END AS kind
FROM (SELECT *, {_cell('Hhold_key')} AS k FROM {t}) r LEFT JOIN (SELECT k, min(loaded_at) AS first FROM hh GROUP BY k) h ON h.k = r.k
WHERE r.k <> '' AND NOT EXISTS (SELECT 1 FROM hh WHERE hh.k = r.k AND hh.loaded_at <= r.loaded_at AND (hh.deleted_at IS NULL OR hh.deleted_at > r.loaded_at))"""


_ORPHANS = f"""WITH hh AS (SELECT {_cell('Hhold_key')} AS k, loaded_at, deleted_at FROM {HOUSEHOLDS}),
o AS ({_orphan_sql(PERSONS)} UNION ALL {_orphan_sql(RECORDS)})"""

# Of a file and round at most one field gone and one new bear the same words in these tables, so renamed pairs are a plain join here.
_P5 = """
WITH v AS (SELECT DISTINCT series_id, round_no, delivery_id, fid, name, ddi_width AS w, ddi_pos AS pos,
    trim(regexp_replace(lower(coalesce(label, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS words,
    CASE WHEN lower(trim(type)) IN ('num', 'numeric') THEN 'numeric' WHEN type IS NULL OR lower(trim(type)) IN ('char', 'character', '') THEN 'character' ELSE lower(trim(type)) END AS ty FROM ddi_variables),
d AS (SELECT series_id, round_no, delivery_id, max(loaded_at) AS seen FROM ddi_variables GROUP BY ALL),
c AS (SELECT series_id, round_no, arg_max(delivery_id, row(seen, delivery_id)) AS delivery_id FROM d GROUP BY ALL),
r AS (SELECT *, lag(round_no) OVER (PARTITION BY series_id ORDER BY round_no) AS prev FROM c),
t AS (SELECT v.* FROM v JOIN c USING (series_id, round_no, delivery_id)),
old AS (SELECT r.series_id, r.round_no, t.fid, t.name, t.w, t.words, t.ty, t.pos FROM r JOIN t ON t.series_id = r.series_id AND t.round_no = r.prev),
new AS (SELECT r.series_id, r.round_no, t.fid, t.name, t.w, t.words, t.ty, t.pos FROM r JOIN t ON t.series_id = r.series_id AND t.round_no = r.round_no WHERE r.prev IS NOT NULL),
gone AS (SELECT * FROM old ANTI JOIN new USING (series_id, round_no, fid, name)),
come AS (SELECT * FROM new ANTI JOIN old USING (series_id, round_no, fid, name)),
ren AS (SELECT g.series_id, g.round_no, g.fid, g.name AS was, n.name, g.ty AS t0, n.ty AS t1, g.w AS w0, n.w AS w1 FROM gone g JOIN come n ON g.series_id = n.series_id AND g.round_no = n.round_no AND g.fid = n.fid AND g.words = n.words WHERE g.words <> ''),
same AS (SELECT o.series_id, o.round_no, o.fid, o.name AS was, n.name, o.ty AS t0, n.ty AS t1, o.w AS w0, n.w AS w1 FROM old o JOIN new n USING (series_id, round_no, fid, name)),
both_ AS (SELECT * FROM ren UNION ALL SELECT * FROM same),
ch AS (SELECT series_id, fid, round_no, 'renamed' AS change, name FROM ren
UNION ALL SELECT series_id, fid, round_no, 'type', name FROM both_ WHERE t0 <> t1
UNION ALL SELECT series_id, fid, round_no, 'width', name FROM both_ WHERE w0 IS DISTINCT FROM w1
UNION ALL SELECT g.series_id, g.fid, g.round_no, 'removed', g.name FROM gone g ANTI JOIN (SELECT series_id, round_no, fid, was AS name FROM ren) USING (series_id, round_no, fid, name)
UNION ALL SELECT n.series_id, n.fid, n.round_no, 'added', n.name FROM come n ANTI JOIN ren USING (series_id, round_no, fid, name))
"""

def _column_sql(t: str, c: str) -> str:
    if c.endswith("_at"):
        v = f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S.%f'), '')"
    elif c.startswith("rng_"):
        v = f"CASE WHEN {c} IS NULL OR isnan({c}) THEN '' WHEN {c} = trunc({c}) THEN CAST(CAST({c} AS HUGEINT) AS VARCHAR) ELSE regexp_replace(rtrim(printf('%.6f', {c}), '0'), '\\.$', '') END"
    else:
        v = _cell(f"CAST({c} AS VARCHAR)")
    whole, part = "regexp_full_match(v, '-?[0-9]+')", "regexp_full_match(v, '-?[0-9]+\\.[0-9]+')"
    return f"""SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER (v = '') AS missing, count(DISTINCT nullif(v, '')) AS n_distinct, min(nullif(v, '')) AS lowest, max(nullif(v, '')) AS highest,
      max(length(nullif(v, ''))) AS longest, count(*) FILTER ({whole}) AS whole_numbers, count(*) FILTER ({part}) AS other_numbers FROM (SELECT {v} AS v FROM {t})"""


ORACLE = {
    "p1_found": _P1,
    "p1_per_field": f"SELECT diff, field, count(*) AS loans FROM ({_P1}) GROUP BY ALL",
    "p3_found": _P3,
    "p3_profile": f"WITH c AS ({_CLASSED}), {_PROFILE} SELECT load_id, col AS column_name, n_rows, blank, bad_pattern, out_of_range, valid, n_distinct, lowest, highest FROM p",
    "p3_columns": " UNION ALL ".join(_column_sql(t, c) for t, cs in _PROFILED.items() for c in cs),
    "p3_bounds": """WITH b AS (SELECT 'rng_min' AS column_name, CASE WHEN NOT isnan(rng_min) THEN rng_min END AS v, rng_min > rng_max AND NOT isnan(rng_min) AS inv, false AS wide FROM ddi_variables
UNION ALL SELECT 'rng_max', CASE WHEN NOT isnan(rng_max) THEN rng_max END, false, rng_max >= pow(10, ddi_width) AND NOT isnan(rng_max) FROM ddi_variables)
SELECT column_name, count(*) AS n_rows, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (inv) AS inverted, count(*) FILTER (wide) AS too_wide,
  count(DISTINCT v) AS n_distinct, min(v) AS lowest, max(v) AS highest FROM b GROUP BY column_name""",
    "p4_found": f"{_ORPHANS} SELECT table_name, rec_no, kind FROM o",
    "p4_report": f"{_ORPHANS} SELECT table_name, coalesce(sub_round, '') AS sub_round, kind, count(*) AS orphans FROM o GROUP BY ALL",
    "p5_found": f"{_P5} SELECT * FROM ch",
    "p5_table": f"""{_P5.replace('WITH v AS', 'WITH RECURSIVE v AS', 1)},
ln AS (SELECT r.series_id, t.fid, r.prev AS round_no, coalesce(n.was, t.name) AS name, r.round_no AS to_round, t.name AS to_name
  FROM r JOIN t ON t.series_id = r.series_id AND t.round_no = r.round_no LEFT JOIN ren n ON n.series_id = t.series_id AND n.fid = t.fid AND n.round_no = t.round_no AND n.name = t.name WHERE r.prev IS NOT NULL),
nodes AS (SELECT series_id, fid, round_no, name, any_value(ty) AS type, any_value(w) AS width FROM t GROUP BY ALL),
chain AS (SELECT series_id, fid, round_no, name, name AS variable FROM nodes ANTI JOIN (SELECT ln.series_id, ln.fid, ln.round_no, ln.name FROM ln JOIN nodes m ON m.series_id = ln.series_id AND m.fid = ln.fid AND m.round_no = ln.to_round AND m.name = ln.to_name) USING (series_id, fid, round_no, name)
  UNION ALL SELECT ln.series_id, ln.fid, ln.round_no, ln.name, chain.variable FROM chain JOIN ln ON ln.series_id = chain.series_id AND ln.fid = chain.fid AND ln.to_round = chain.round_no AND ln.to_name = chain.name JOIN nodes m ON m.series_id = ln.series_id AND m.fid = ln.fid AND m.round_no = ln.round_no AND m.name = ln.name)
SELECT c.*, n.type, n.width, CASE WHEN bool_and(n.type = 'numeric') OVER w THEN 'numeric' ELSE 'character' END AS unified_type, max(n.width) OVER w AS unified_width
FROM chain c JOIN nodes n USING (series_id, fid, round_no, name) WINDOW w AS (PARTITION BY c.series_id, c.fid, c.variable)""",
    "p5_unified_files": f"""SELECT rec_no, "Hhold_key" AS asked_household, CASE WHEN rec_no % 4 = 0 THEN B10_q3 ELSE CAST(TRY_CAST(CASE WHEN regexp_full_match({_cell('B10_q3')}, '-?[0-9]{{1,18}}') THEN {_cell('B10_q3')} END AS BIGINT) AS VARCHAR) END AS loan_amount, sub_round AS asked_sub_round,
      CASE WHEN rec_no % 4 IN (0, 3) THEN office END AS office, CAST(load_seq AS BIGINT) AS load_seq, CASE WHEN rec_no % 4 = 1 THEN loaded_at END AS loaded_at, CASE WHEN rec_no % 4 IN (2, 3) THEN B10_q5 END AS loan_months FROM {RECORDS}""",
    "p5_file_changes": """SELECT * FROM (VALUES (1, 'renamed', 'Hhold_key', 'household'), (1, 'renamed', 'B10_q3', 'amount'), (1, 'type', 'B10_q3', 'amount'), (1, 'type', 'load_seq', 'load_seq'), (1, 'removed', 'office', NULL), (1, 'added', NULL, 'loaded_at'),
      (2, 'added', NULL, 'who'), (2, 'added', NULL, 'loan'), (2, 'moved', 'household', 'who.household'), (2, 'moved', 'sub_round', 'who.sub_round'), (2, 'moved', 'amount', 'loan.amount'), (2, 'added', NULL, 'loan.months'), (2, 'removed', 'loaded_at', NULL),
      (3, 'renamed', 'who', 'asked'), (3, 'added', NULL, 'office')) t(version, change, old_path, new_path)""",
    "p5_per_change": f"{_P5} SELECT change, count(*) AS cases, count(DISTINCT series_id) AS series FROM ch GROUP BY change",
}
