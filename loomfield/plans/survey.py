"""Queries over containers, names, texts, checks and comparisons, with the SQL of their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import cell
from ..operators import bag_compare, pairing, table_checks
from ..session import file_url, local_path, once, scratch, table
from ..sources import sinks
from ..sources.codebook import Variable, codebook_frames, read_codebook
from ..sources.container import block_layout, read_block
from ..sources.encode import write_container
from .general import EXPORT, HOUSEHOLDS, LOAN_FIELDS, PERSONS, RECORDS, _cell

# --- containers: write a table as one, read it back ---------------------------------------------------


def _prepared(df: DataFrame) -> DataFrame:
    """Timestamps as text, the only types a container knows being text and numbers."""
    cols = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if t.startswith("timestamp") else F.col(c) for c, t in df.dtypes]
    return df.select(*cols)


_ORDER = {"nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"]}


def _written(spark: SparkSession, d: str, name: str) -> tuple[str, str, str]:
    return once(spark, (d, "written", name), lambda: write_container(_prepared(table(spark, d, name)), _ORDER[name], name))


def _roundtrip(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        path, book, fid = _written(spark, d, name)
        return read_block(spark, path, fid, book)

    query.__name__ = f"roundtrip_{name}"
    return query


def roundtrip_loans(spark: SparkSession, d: str) -> DataFrame:
    """A dirty table of texts: nulls, blanks and padded cells all come back stripped."""
    path, book, fid = write_container(_prepared(table(spark, d, RECORDS)), ["rec_no"], "Block-10")
    return read_block(spark, path, fid, book)


def typed_lineitem(spark: SparkSession, d: str) -> DataFrame:
    path, book, fid = _written(spark, d, "lineitem")
    return read_block(spark, path, fid, book, typed=True)


def pruned_lineitem(spark: SparkSession, d: str) -> DataFrame:
    """Three of eleven columns are read from the file; the rest is never touched."""
    path, book, fid = _written(spark, d, "lineitem")
    df = read_block(spark, path, fid, book, columns=["l_returnflag", "l_linestatus", "l_quantity"], typed=True)
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("n"))


def record_order(spark: SparkSession, d: str) -> DataFrame:
    """The record number the source gives: row i of the file is record i."""
    path, book, fid = _written(spark, d, "orders")
    return read_block(spark, path, fid, book, columns=["o_orderkey"], with_rec=True).select(F.col("_rec").alias("rec"), "o_orderkey")


def codebook_scan(spark: SparkSession, d: str) -> DataFrame:
    """Variables as the codebook of a written table states them."""
    _, book, _ = _written(spark, d, "lineitem")
    _, variables = codebook_frames(spark, read_codebook(book))
    return variables.select("ddi_pos", "name", "type", "ddi_width", "rng_min", "rng_max")


def layout_scan(spark: SparkSession, d: str) -> DataFrame:
    """Slots of a written table located, matched and laid out: storage, bytes, and place of each column."""
    path, book, fid = _written(spark, d, "lineitem")
    rows = [(c.name, c.slot.encoding, c.width, c.offset) for c in block_layout(path, book, fid).columns]
    return spark.createDataFrame(rows, "name string, encoding string, width int, col_offset long")


# --- texts --------------------------------------------------------------------------------------------------


def double_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", names.double_text(F.col("l_extendedprice")).alias("price"), names.double_text(F.col("l_discount")).alias("discount"))


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", names.safe_name_col(F.col("page_title")).alias("safe"))


def stata_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", names.stata_name_col(F.col("page_title")).alias("stata"), F.left(F.col("page_title"), F.lit(80)).alias("label"))


_CUSTOMER_WIDTHS = {"c_custkey": 10, "c_name": 20, "c_nationkey": 13, "c_acctbal": 9, "c_mktsegment": 14}


def fwf_lines(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer")
    df = df.select(*[names.double_text(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])
    return sinks.fixed_lines(df, _CUSTOMER_WIDTHS)


def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.separated_lines(_prepared(table(spark, d, "documents")), ",")


def tsv_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.separated_lines(table(spark, d, EXPORT), "\t")


def jsonl_lines(spark: SparkSession, d: str) -> DataFrame:
    return sinks.json_lines(_prepared(table(spark, d, RECORDS)))


# --- checks and comparisons -----------------------------------------------------------------------------------


def missing_columns(spark: SparkSession, d: str) -> DataFrame:
    return table_checks.missing_profile(table(spark, d, PERSONS))


def row_column_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for n in (HOUSEHOLDS, PERSONS, RECORDS, EXPORT):
        df = table(spark, d, n)
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"))
        out = one if out is None else out.unionByName(one)
    return out


def _bags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cols = ["Hhold_key", "B10_q1", *LOAN_FIELDS]
    strip = lambda df: df.select(*[cell(F.col(c)).alias(c) for c in cols])
    return strip(table(spark, d, RECORDS)), strip(table(spark, d, EXPORT))


def bag_diff(spark: SparkSession, d: str) -> DataFrame:
    """Distinct rows whose multiplicity differs, with both counts."""
    return bag_compare.bag_counts(*_bags(spark, d)).where("n_a != n_b")


def bag_except(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the records beyond those of the export, with multiplicity."""
    a, b = _bags(spark, d)
    return a.exceptAll(b)


def bag_equal(spark: SparkSession, d: str) -> DataFrame:
    a, b = _bags(spark, d)
    counts = bag_compare.bag_counts(a, b)
    extra = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    return counts.agg(extra("n_a", "n_b").alias("only_records"), extra("n_b", "n_a").alias("only_export")).withColumn("equal", F.expr("only_records = 0 and only_export = 0"))


def pair_exports(spark: SparkSession, d: str) -> DataFrame:
    """Table stems with the export whose name overlaps most; brands stand for names, of which some begin others."""
    p = table(spark, d, "part").select("p_brand").distinct()
    stems = p.select(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("stem"))
    exports = p.select(F.concat(F.replace(F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("Brand"), F.lit("BRAND")), F.lit(" ")).alias("export"))
    return pairing.pair_names(stems, "stem", exports, "export")



def fwf_file(spark: SparkSession, d: str) -> DataFrame:
    """The fixed-width sink as a file, read back as lines with the header first."""
    folder = local_path(scratch(spark, "fwf"))
    df = table(spark, d, "supplier").select("s_suppkey", "s_name")
    got = sinks.write_table(df, folder, "supplier", ["fwf"], [(Variable("s_suppkey", ddi_width=6), "offset"), (Variable("s_name", ddi_width=25), "char")], single=True)
    return spark.read.text(file_url(got["fwf"]["path"]))


_ROUNDTRIPS = [_roundtrip(n) for n in ("nation", "customer", "supplier", "part", "orders", "lineitem")]
QUERIES = {
    f.__name__: f
    for f in (
        *_ROUNDTRIPS, roundtrip_loans, typed_lineitem, pruned_lineitem, record_order, codebook_scan, layout_scan,
        double_text, safe_names, stata_names, fwf_lines, csv_lines, tsv_lines, jsonl_lines,
        missing_columns, row_column_counts, bag_diff, bag_except, bag_equal, pair_exports, fwf_file,
    )
}

# --- SQL ----------------------------------------------------------------------------------------------------------


def _dbl(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '' WHEN {c} = trunc({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE regexp_replace(rtrim(printf('%.6f', {c}), '0'), '\\.$', '') END"


def _int(c: str) -> str:
    return f"coalesce(CAST({c} AS VARCHAR), '')"


_COLS = {
    "nation": {"n_nationkey": _int, "n_name": _cell, "n_regionkey": _int},
    "customer": {"c_custkey": _int, "c_name": _cell, "c_nationkey": _int, "c_acctbal": _dbl, "c_mktsegment": _cell},
    "supplier": {"s_suppkey": _int, "s_name": _cell, "s_nationkey": _int, "s_acctbal": _dbl},
    "part": {"p_partkey": _int, "p_name": _cell, "p_brand": _cell, "p_type": _cell, "p_size": _int, "p_retailprice": _dbl},
    "orders": {"o_orderkey": _int, "o_custkey": _int, "o_orderstatus": _cell, "o_totalprice": _dbl, "o_orderdate": None, "o_orderpriority": _cell},
    "lineitem": {"l_orderkey": _int, "l_partkey": _int, "l_suppkey": _int, "l_linenumber": _int, "l_quantity": _dbl, "l_extendedprice": _dbl, "l_discount": _dbl, "l_tax": _dbl, "l_returnflag": _cell, "l_linestatus": _cell, "l_shipdate": None},
}


def _time(c: str) -> str:
    return f"coalesce(strftime({c}, '%Y-%m-%d %H:%M:%S'), '')"


def _roundtrip_sql(t: str) -> str:
    return "SELECT " + ", ".join(f"{(f or _time)(c)} AS {c}" for c, f in _COLS[t].items()) + f" FROM {t}"


def _csv(c: str, sep: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '[{sep}\"\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


def _lines(cols: list[str], sep: str, t: str) -> str:
    glue = "," if sep == "," else "chr(9)"
    body = (f" || {repr(sep) if sep == ',' else glue} || ").join("(" + _csv(_time(c) if c.endswith(("_ts", "_at")) else f"coalesce(CAST({c} AS VARCHAR), '')", "," if sep == "," else "\\t") + ")" for c in cols)
    return f"SELECT {body} AS value FROM {t}"


_STRIPPED = ", ".join(f"{_cell(c)} AS {c}" for c in ("Hhold_key", "B10_q1", *LOAN_FIELDS))
_NAMES = ", ".join(("Hhold_key", "B10_q1", *LOAN_FIELDS))
_COUNTS = f"SELECT {_NAMES}, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM (SELECT {_STRIPPED}, 1 AS a, 0 AS b FROM {RECORDS} UNION ALL SELECT {_STRIPPED}, 0, 1 FROM {EXPORT}) GROUP BY ALL"
_PERSON_COLS = ["rec_no", "Hhold_key", *[f"B41_q{i}" for i in range(1, 10)], "Wgt1_strm", "sub_round", "loaded_at"]
_RECORD_COLS = {c: _cell for c in ("Hhold_key", "B10_q1", *LOAN_FIELDS, "sub_round", "office", "load_id")} | {"load_seq": _int, "loaded_at": _time}
_RECORD_ORDER = ["rec_no", "Hhold_key", *[f"B10_q{i}" for i in range(1, 7)], "Wgt1_strm", "sub_round", "office", "load_id", "load_seq", "loaded_at"]

def _fact(i: int, c: str, kind) -> str:
    if kind is _int:
        return f"SELECT {i} AS ddi_pos, '{c}' AS name, 'numeric' AS type, 'offset' AS encoding, CAST(length(CAST(max({c}) AS VARCHAR)) AS INTEGER) AS ddi_width, CAST(min({c}) AS DOUBLE) AS rng_min, CAST(max({c}) AS DOUBLE) AS rng_max, count(*) AS n FROM lineitem"
    if kind is _dbl:
        return f"SELECT {i}, '{c}', 'numeric', 'double', 12, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), count(*) FROM lineitem"
    return f"SELECT {i}, '{c}', 'character', 'char', CAST(max(length({(kind or _time)(c)})) AS INTEGER), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), count(*) FROM lineitem"


#: What the written codebook must state of lineitem; its ranges fill no whole number of bytes.
_FACTS = " UNION ALL ".join(_fact(i, c, kind) for i, (c, kind) in enumerate(_COLS["lineitem"].items()))

ORACLE = {f"roundtrip_{t}": _roundtrip_sql(t) for t in _COLS} | {
    "roundtrip_loans": f"SELECT CAST(rec_no AS VARCHAR) AS rec_no, {', '.join(f'{f(c)} AS {c}' for c, f in _RECORD_COLS.items())} FROM {RECORDS}",
    "typed_lineitem": f"SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, {_time('l_shipdate')} AS l_shipdate FROM lineitem",
    "pruned_lineitem": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem GROUP BY ALL",
    "record_order": "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS rec, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders",
    "codebook_scan": f"SELECT ddi_pos, name, type, ddi_width, rng_min, rng_max FROM ({_FACTS})",
    "layout_scan": f"""SELECT name, encoding, width, CAST(coalesce(sum(width * n) OVER (ORDER BY ddi_pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS col_offset
      FROM (SELECT name, ddi_pos, n, encoding, CAST(CASE encoding WHEN 'char' THEN ddi_width WHEN 'double' THEN 8 ELSE greatest(1, ceil(length(bin(CAST(rng_max - rng_min AS BIGINT))) / 8.0)) END AS INTEGER) AS width FROM ({_FACTS}))""",
    "double_text": f"SELECT l_orderkey, l_linenumber, {_dbl('l_extendedprice')} AS price, {_dbl('l_discount')} AS discount FROM lineitem",
    "safe_names": "SELECT doc_id, lower(trim(regexp_replace(page_title, '[^a-zA-Z0-9]+', '_', 'g'), '_')) AS safe FROM documents",
    "stata_names": "SELECT doc_id, left(regexp_replace(page_title, '[^a-zA-Z0-9_]', '_', 'g'), 32) AS stata, left(page_title, 80) AS label FROM documents",

    "fwf_lines": "SELECT rtrim(" + " || ".join(f"(v{i} || repeat(' ', greatest(0, {w} - length(v{i}))))" for i, w in enumerate(_CUSTOMER_WIDTHS.values())) + ") AS value FROM (SELECT " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '') AS v{i}" for i, c in enumerate(_CUSTOMER_WIDTHS)).replace("coalesce(CAST(c_acctbal AS VARCHAR), '')", _dbl("c_acctbal")) + " FROM customer)",
    "csv_lines": _lines(["doc_id", "page_id", "page_title", "parent_doc_id", "rev_ts", "fetched_at", "editor", "edit_note", "lang", "source", "text", "n_chars"], ",", "documents"),
    "tsv_lines": _lines(["line_no", "Hhold_key", "B10_q1", *LOAN_FIELDS], "\t", EXPORT),
    "jsonl_lines": "SELECT CAST(to_json(struct_pack(" + ", ".join(f"{c} := {_time(c) if c == 'loaded_at' else _int(c)}" for c in _RECORD_ORDER) + f")) AS VARCHAR) AS value FROM {RECORDS}",
    "missing_columns": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(nullif(CAST({c} AS VARCHAR), '')) AS filled, count(*) > 10 AND count(DISTINCT coalesce(CAST({c} AS VARCHAR), '')) <= 1 AS \"constant\" FROM {PERSONS}" for c in _PERSON_COLS),
    "row_column_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, (SELECT count(*) FROM {t}) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns" for t in (HOUSEHOLDS, PERSONS, RECORDS, EXPORT)),
    "bag_diff": f"SELECT * FROM ({_COUNTS}) WHERE n_a <> n_b",
    "bag_except": f"SELECT {_STRIPPED} FROM {RECORDS} EXCEPT ALL SELECT {_STRIPPED} FROM {EXPORT}",
    "bag_equal": f"SELECT CAST(sum(greatest(n_a - n_b, 0)) AS BIGINT) AS only_records, CAST(sum(greatest(n_b - n_a, 0)) AS BIGINT) AS only_export, sum(abs(n_a - n_b)) = 0 AS equal FROM ({_COUNTS})",
    "pair_exports": """WITH p AS (SELECT DISTINCT p_brand FROM part), s AS (SELECT replace(lower(p_brand), '#', '_') AS stem FROM p), e AS (SELECT replace(replace(p_brand, '#', '-'), 'Brand', 'BRAND') || ' ' AS export FROM p),
      j AS (SELECT stem, export, replace(lower(stem), '_', '') AS a, replace(replace(replace(lower(export), '-', ''), '_', ''), ' ', '') AS b FROM s, e),
      k AS (SELECT stem, export, least(length(a), length(b)) AS score, row_number() OVER (PARTITION BY stem ORDER BY least(length(a), length(b)) DESC, export) AS rn FROM j WHERE contains(a, b) OR contains(b, a))
      SELECT stem, export, score FROM k WHERE rn = 1 AND score > 0""",

    "fwf_file": "SELECT rtrim(rpad('s_suppkey', 11, ' ') || 's_name') AS value UNION ALL SELECT rtrim(CAST(s_suppkey AS VARCHAR) || repeat(' ', greatest(0, 11 - length(CAST(s_suppkey AS VARCHAR)))) || s_name) FROM supplier",
}
