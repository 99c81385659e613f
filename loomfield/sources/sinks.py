"""Writing a table of texts in eight formats, as folders of parts or as one file each.

Text formats are built as whole lines inside the JVM and written in parallel;
in a folder each part bears the header. On request the parts are strung
together in order as one file, by copying streams. Workbooks and Stata files
are always single; tasks write their rows as pieces, and the driver holds none
of them.
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import accumulate
from operator import xor
from pathlib import Path
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import padded, quoted, stata_name
from ..session import file_url, local_path, ship_package
from .codebook import Variable

# Names of the formats and suffixes of their files.
SUFFIXES = {"parquet": ".parquet", "csv": ".csv", "tsv": ".tsv", "excel": ".xlsx", "stata": ".dta", "json": ".json", "jsonl": ".jsonl", "fwf": ".txt"}
_ABOUT = {
    "parquet": "typed columns for engines that read in parallel", "csv": "text cut by commas", "tsv": "text cut by tabs", "excel": "a workbook: the rows, and what the codebook says of the columns",
    "stata": "all columns as strings with their labels", "json": "an array of objects (in folders: an object a line)", "jsonl": "an object a line", "fwf": "columns padded to the widths of the codebook",
}
FORMATS = {name: (suffix, _ABOUT[name]) for name, suffix in SUFFIXES.items()}
SHEET_ROWS = 1_048_576
HEAD_ROWS = 2
SHEET_ROOM = SHEET_ROWS - HEAD_ROWS
#: How hard sheets are packed: a third of the usual level's time for a quarter more bytes.
PACKING = 1
#: The most rows and the longest text of fixed room that Stata's format takes; longer texts stand in its part for strLs.
STATA_ROWS, STATA_TEXT = 2**31 - 1, 2045
FWF_DEFAULT = 12
LABEL_CHARS = 80


def _c(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def separated_lines(df: DataFrame, sep: str) -> DataFrame:
    """One line per row: cells quoted where they need it."""
    alone = len(df.columns) == 1
    return df.select(F.concat_ws(sep, *[quoted(_c(c), sep, alone) for c in df.columns]).alias("value"))


def separated_header(columns: list[str], sep: str) -> str:
    hard = lambda c: any(x in c for x in (sep, '"', "\n", "\r"))
    return sep.join('"' + c.replace('"', '""') + '"' if hard(c) else c for c in columns)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row, every value a string."""
    return df.select(F.to_json(F.struct(*[_c(c).alias(c) for c in df.columns])).alias("value"))


def fixed_widths(columns: list[str], variables: dict[str, Variable]) -> dict[str, int]:
    """Room of each column: its width or name and a blank, and one more."""
    return {c: max(variables[c].ddi_width, len(c) + 1) + 1 if c in variables else FWF_DEFAULT for c in columns}


def fixed_lines(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One line per row of cells padded to their width, never cut, without blanks at the end."""
    from ..operators.bag_compare import UNICODE_SPACE

    return df.select(F.rtrim(F.concat(*[padded(_c(c), widths[c]) for c in df.columns]), F.lit(UNICODE_SPACE)).alias("value"))


def _string_together(parts: Path, target: str, head: bytes = b"", tail: bytes = b"", between: bytes = b"") -> None:
    with open(target, "wb") as out:
        out.write(head)
        first = True
        for p in sorted(parts.glob("part-*")):
            if p.stat().st_size == 0:
                continue
            if between:
                for line in open(p, "rb"):
                    out.write((b"" if first else between) + line.rstrip(b"\n"))
                    first = False
            else:
                with open(p, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
        out.write(tail)


def _headed(lines: DataFrame, head: str) -> DataFrame:
    """Each partition's first line with the header before it."""
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    return lines.select(F.when(first, F.concat(F.lit(head + "\n"), F.col("value"))).otherwise(F.col("value")).alias("value"))


def _write_lines(lines: DataFrame, target: str, single: bool, head: str | None, array: bool = False) -> None:
    if not single:
        (lines if head is None else _headed(lines, head)).write.mode("overwrite").text(file_url(target))
        return
    tmp = Path(f"{target}.{uuid.uuid4().hex}.parts")
    try:
        lines.write.text(file_url(tmp))
        if array:
            _string_together(tmp, target, b"[\n  ", b"\n]", b",\n  ")
        else:
            _string_together(tmp, target, (head + "\n").encode() if head is not None else b"")
    finally:
        shutil.rmtree(tmp, ignore_errors=True)


def _write_parquet(df: DataFrame, target: str, single: bool) -> None:
    if not single:
        df.write.mode("overwrite").parquet(file_url(target))
        return
    tmp = Path(f"{target}.{uuid.uuid4().hex}.parts")
    try:
        df.coalesce(1).write.option("compression", "snappy").parquet(file_url(tmp))
        os.replace(next(tmp.glob("part-*.parquet")), target)
    finally:
        shutil.rmtree(tmp, ignore_errors=True)


# --- workbooks and Stata files -------------------------------------------------------------------------


@contextmanager
def _held(df: DataFrame) -> Iterator[DataFrame]:
    """df with rows that keep their partitions from one pass to the next: stored, if it isn't yet."""
    if df.storageLevel.useDisk or df.storageLevel.useMemory:
        yield df
        return
    df = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield df
    finally:
        df.unpersist()


def _starts(df: DataFrame, most: list[Column]) -> tuple[dict[int, int], int, list]:
    """(partition -> number of its first row from 0, rows, highest of each of most); one row per partition is collected."""
    rows = sorted(map(tuple, df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)), *most).collect()), key=lambda r: r[0])
    ends = list(accumulate((r[1] for r in rows), initial=0))
    return {r[0]: a for r, a in zip(rows, ends)}, ends[-1], [max((r[i] for r in rows if r[i] is not None), default=None) for i in range(2, len(most) + 2)]


def _sheet_ref(i: int) -> str:
    ref = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        ref = chr(65 + r) + ref
    return ref


def _sheet_row(r: int, cells: Iterable) -> str:
    out = []
    for i, v in enumerate(cells):
        if v is None or v == "":
            continue
        if isinstance(v, str):
            text = escape("".join(ch for ch in v if ch >= " " or ch in "\t\n\r"))
            out.append(f'<c r="{_sheet_ref(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>')
        else:
            out.append(f'<c r="{_sheet_ref(i)}{r}"><v>{v}</v></c>')
    return f'<row r="{r}">{"".join(out)}</row>'


def sheet_rows(df: DataFrame, number: Column) -> DataFrame:
    """(sheet, xml): each row as a data sheet has it; number counts rows from 0 over all sheets. Numbers stay numbers, the rest is text."""
    at = df.select((number / SHEET_ROOM).cast("int").alias("_sheet"), (number % SHEET_ROOM + HEAD_ROWS + 1).cast("string").alias("_r"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(df.columns)])
    lost = "".join(chr(x) for x in range(32) if chr(x) not in "\t\n\r")
    cells = []
    for i, f in enumerate(df.schema.fields):
        text = F.col(f"_{i}").cast("string")
        if isinstance(f.dataType, T.NumericType):
            cell = F.concat(F.lit(f'<c r="{_sheet_ref(i)}'), "_r", F.lit('"><v>'), text, F.lit("</v></c>"))
        else:
            plain = F.translate(text, lost, "")
            for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
                plain = F.replace(plain, F.lit(sign), F.lit(name))
            cell = F.concat(F.lit(f'<c r="{_sheet_ref(i)}'), "_r", F.lit('" t="inlineStr"><is><t xml:space="preserve">'), plain, F.lit("</t></is></c>"))
        cells.append(F.when(text != "", cell).otherwise(""))
    return at.select(F.col("_sheet").alias("sheet"), F.concat(F.lit('<row r="'), "_r", F.lit('">'), *cells, F.lit("</row>")).alias("xml"))


class _Piece:
    """A stretch of a sheet, packed so that pieces written one behind the other are one deflated text."""

    def __init__(self, path: str):
        self.path, self.file, self.pack = path, open(f"{path}.{uuid.uuid4().hex}", "wb"), zlib.compressobj(PACKING, wbits=-zlib.MAX_WBITS)
        self.size = self.packed = self.crc = 0

    def write(self, text) -> None:
        self.size, self.crc = self.size + len(text), zlib.crc32(text, self.crc)
        self.packed += self.file.write(self.pack.compress(text))

    def close(self, last: bool = False) -> tuple[str, int, int, int]:
        self.packed += self.file.write(self.pack.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH))
        self.file.close()
        os.replace(self.file.name, self.path)  # a repeated task writes the same piece again
        return self.path, self.size, self.packed, self.crc


def _joined_crc(a: int, b: int, n: int) -> int:
    """The CRC of two texts in a row from their own; n bytes has the second."""
    times = lambda m, x: reduce(xor, (m[i] for i in range(32) if x >> i & 1), 0)
    step = [zlib.crc32(b"\0", 1 << i) ^ zlib.crc32(b"\0") for i in range(32)]  # what zero bytes behind it make of each bit: 1, 2, 4, ... bytes
    while n:
        if n & 1:
            a = times(step, a)
        step, n = [times(step, c) for c in step], n >> 1
    return a ^ b


def _add_packed(z: zipfile.ZipFile, name: str, pieces: list[tuple[str, int, int, int]]) -> None:
    """Pieces as one member; they are copied as they are."""
    info = zipfile.ZipInfo(name)
    info.compress_type = zipfile.ZIP_DEFLATED
    for _, size, packed, crc in pieces:
        info.CRC = _joined_crc(info.CRC if info.file_size else 0, crc, size)
        info.file_size, info.compress_size = info.file_size + size, info.compress_size + packed
    z.fp.seek(z.start_dir)
    info.header_offset = z.fp.tell()
    z.fp.write(info.FileHeader(zip64=True))
    for path, *_ in pieces:
        with open(path, "rb") as f:
            shutil.copyfileobj(f, z.fp, 1 << 20)
    z.start_dir = z.fp.tell()
    z.filelist.append(info)
    z.NameToInfo[name] = info


def _book(sheets: int) -> dict[str, str]:
    """The parts of a workbook beside its sheets: rows in sheets 1, 3, 4, ..., variables in sheet 2."""
    named = [("Data" if i == 0 else f"Data {i + 1}", n) for i, n in enumerate(data_sheets(sheets))] + [("Variables", 2)]
    head, kind = '<?xml version="1.0" encoding="UTF-8"?>', "application/vnd.openxmlformats-officedocument.spreadsheetml"
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{kind}.worksheet+xml"/>' for _, n in named) + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="{doc}"><sheets>' + "".join(f'<sheet name="{name}" sheetId="{n}" r:id="rId{n}"/>' for name, n in named) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{n}" Type="{doc}/worksheet" Target="worksheets/sheet{n}.xml"/>' for _, n in named) + "</Relationships>",
    }


def data_sheets(sheets: int) -> list[int]:
    """Numbers of the files that hold the rows' sheets."""
    return [1, *range(3, sheets + 2)]


_SHEET = '<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
VARIABLE_SHEET = ("Variable", "Label", "Type", "Width", "Decimals", "Encoding", "Min", "Max")


def write_excel(df: DataFrame, target: str, variables: list[tuple[Variable, str]]) -> None:
    """Sheet Data (labels, names, rows) and sheet Variables; what one sheet can't hold goes on in Data 2, Data 3 and so on.

    Tasks write and pack the rows of their partitions as pieces, which are copied into the workbook.
    """
    labels = {v.name: v.label for v, _ in variables if v.label}
    tmp = Path(f"{target}.{uuid.uuid4().hex}.parts")
    ship_package(df.sparkSession)
    with _held(df) as held:
        starts, n, _ = _starts(held, [])
        first = F.element_at(F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts, default=0) + 1)]), F.spark_partition_id() + 1)
        rows = sheet_rows(held, first + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, pieces, lines = TaskContext.get().partitionId(), {}, 0
            for b in batches:
                sheet, xml = b["sheet"].to_numpy(), b["xml"].cast(pa.string())
                ends = np.frombuffer(xml.buffers()[1], "<i4", len(xml) + 1, xml.offset * 4) if len(xml) else ()
                for s in np.unique(sheet).tolist():
                    lo, hi = np.searchsorted(sheet, [s, s + 1])
                    if s not in pieces:
                        pieces[s] = _Piece(f"{tmp}/{part:08d}-{s:04d}")
                    pieces[s].write(memoryview(xml.buffers()[2])[ends[lo] : ends[hi]])
                lines += len(xml)
            done = [(part, s, *p.close()) for s, p in pieces.items()]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "sheet", "path", "size", "packed", "crc"), x)) | {"n": lines if i == 0 else 0} for i, x in enumerate(done)], pa.schema([("part", pa.int32()), ("sheet", pa.int32()), ("path", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("crc", pa.int64()), ("n", pa.int64())]))

        try:
            tmp.mkdir()
            got = sorted(map(tuple, rows.mapInArrow(encode, "part int, sheet int, path string, size long, packed long, crc long, n long").collect()))  # a row per task and sheet
            if (done := sum(x[-1] for x in got)) != n:
                raise RuntimeError(f"{done} rows written of {n}")
            sheets = max(1, -(-n // SHEET_ROOM))
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in _book(sheets).items():
                    z.writestr(name, text)
                for s, number in enumerate(data_sheets(sheets)):
                    head, tail = _Piece(f"{tmp}/head-{s}"), _Piece(f"{tmp}/tail-{s}")
                    head.write((_SHEET + _sheet_row(1, [labels.get(c, c) for c in df.columns]) + _sheet_row(2, df.columns)).encode())
                    tail.write(b"</sheetData></worksheet>")
                    _add_packed(z, f"xl/worksheets/sheet{number}.xml", [head.close(), *[x[2:6] for x in got if x[1] == s], tail.close(last=True)])
                told = [VARIABLE_SHEET] + [(v.name, v.label, v.type, v.ddi_width, v.dcml, e, v.rng_min, v.rng_max) for v, e in variables]
                z.writestr("xl/worksheets/sheet2.xml", _SHEET + "".join(_sheet_row(r, row) for r, row in enumerate(told, 1)) + "</sheetData></worksheet>")
        finally:
            shutil.rmtree(tmp, ignore_errors=True)


def stata_frame(names: list[str], widths: list[int], labels: dict[str, str]) -> bytes:
    """A Stata file of one row whose texts have these widths: all that surrounds the rows of a larger one."""
    out = io.BytesIO()
    pd.DataFrame([["x" * min(w, STATA_TEXT + 1) for w in widths]], columns=names).to_stata(out, write_index=False, variable_labels=labels, version=117, byteorder="<")
    return out.getvalue()


def stata_rows(batch: pa.RecordBatch, widths: list[int], first: int, longs) -> bytes:
    """Rows as Stata stores them, numbered from first; longer texts go to longs, and the row says which is its."""
    n, cells = batch.num_rows, []
    for i, w in enumerate(widths):
        text = batch.column(i).cast(pa.string())
        if w > STATA_TEXT:
            cell = np.zeros((n, 2), "<u4")
            for r, v in enumerate(text.to_pylist()):
                if v:
                    raw = v.encode("latin-1") + b"\0"
                    cell[r] = i + 1, first + r + 1
                    longs.write(b"GSO" + struct.pack("<IIBI", i + 1, first + r + 1, 130, len(raw)) + raw)
            cells.append(cell.view(np.uint8))
        elif pc.all(pc.string_is_ascii(text)).as_py():
            wide = pc.ascii_rpad(text, w, padding="\0")
            cells.append(np.frombuffer(wide.buffers()[2], np.uint8, n * w, wide.offset * w).reshape(n, w))
        else:
            cells.append(np.array([v.encode("latin-1") for v in text.to_pylist()], f"S{w}").view(np.uint8).reshape(n, w))
    return np.hstack(cells).tobytes()


def write_stata(df: DataFrame, target: str, variables: dict[str, Variable]) -> None:
    """All columns as text, names and labels cut to what the format takes; names that collide when cut are an error.

    Tasks write the rows of their partitions as pieces, which are strung together.
    """
    names = [stata_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("column names collide when cut to 32 characters")
    labels = {stata_name(c): variables[c].label[:LABEL_CHARS] for c in df.columns if c in variables and variables[c].label}
    tmp = Path(f"{target}.{uuid.uuid4().hex}.parts")
    ship_package(df.sparkSession)
    with _held(df) as held:
        texts = held.select(*[F.when(_c(c) == "nan", "").otherwise(_c(c)).alias(s) for c, s in zip(df.columns, names)])
        starts, n, longest = _starts(texts, [F.max(F.char_length(s)) for s in names])
        if n > STATA_ROWS:
            raise ValueError(f"{n} rows are more than the format's {STATA_ROWS}")
        widths = [max(1, w or 0) for w in longest]

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, at = TaskContext.get().partitionId(), 0
            piece = f"{tmp}/{uuid.uuid4().hex}"
            with open(f"{piece}.rows", "wb") as rows, open(f"{piece}.longs", "wb") as longs:
                for b in batches:
                    if b.num_rows:
                        rows.write(stata_rows(b, widths, starts[part] + at, longs))
                        at += b.num_rows
            for kind in ("rows", "longs"):
                os.replace(f"{piece}.{kind}", f"{tmp}/{part:08d}.{kind}")  # a repeated task writes the same piece again
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64())], names=["part", "n"])

        try:
            tmp.mkdir()
            done = sum(r["n"] for r in texts.mapInArrow(encode, "part int, n long").collect())  # one row per task
            if done != n:
                raise RuntimeError(f"{done} rows written of {n}")
            frame = stata_frame(names, widths, labels)
            at = frame.index(b"<map>") + 5
            places = list(struct.unpack_from("<14Q", frame, at))
            head = bytearray(frame[: places[9]])
            struct.pack_into("<I", head, head.index(b"<N>") + 3, n)
            with open(target, "wb") as out:
                out.write(head)
                for i, (tag, kind) in enumerate((("data", "rows"), ("strls", "longs")), 9):
                    places[i] = out.tell()
                    out.write(f"<{tag}>".encode())
                    for p in sorted(tmp.glob(f"*.{kind}")):
                        with open(p, "rb") as f:
                            shutil.copyfileobj(f, out, 1 << 20)
                    out.write(f"</{tag}>".encode())
                moved = out.tell() - places[11]
                out.write(frame[places[11] :])
                out.seek(at)
                out.write(struct.pack("<14Q", *places[:11], *[x + moved for x in places[11:]]))
        finally:
            shutil.rmtree(tmp, ignore_errors=True)


def stata_layout(path: str) -> tuple[list[str], list[int], int, int]:
    """(names, widths, rows, place of the first row) of a file of texts such as write_stata makes."""
    with open(path, "rb") as f:
        head = f.read(1 << 12)
        k, n = (struct.unpack_from(kind, head, head.index(tag) + len(tag))[0] for kind, tag in (("<H", b"<K>"), ("<I", b"<N>")))
        places = struct.unpack_from("<14Q", head, head.index(b"<map>") + 5)
        f.seek(0)
        head = f.read(places[9])
    widths = list(struct.unpack_from(f"<{k}H", head, places[2] + len("<variable_types>")))
    if wrong := [w for w in widths if w > STATA_TEXT]:
        raise ValueError(f"{path}: columns of types {wrong} are no texts of fixed room")
    at = places[3] + len("<varnames>")
    names = [head[at + 33 * i : at + 33 * i + 33].partition(b"\0")[0].decode("latin-1") for i in range(k)]
    return names, widths, n, places[9] + len("<data>")


def write_table(df: DataFrame, folder: str, name: str, formats: list[str], variables: list[tuple[Variable, str]] = (), single: bool = False) -> dict:
    """format -> {path, size_mb} or {path, error}; one format's failure leaves the others alone.

    df must give its rows in the order wanted. Parallel formats are folders of
    parts whose names sort in that order; with single, each is one file.
    """
    by_name = {v.name: v for v, _ in variables}
    out = {}
    os.makedirs(local_path(folder), exist_ok=True)
    for fmt in formats:
        target = os.path.join(local_path(folder), name + FORMATS[fmt][0])
        try:
            if fmt == "parquet":
                _write_parquet(df, target, single)
            elif fmt in ("csv", "tsv"):
                sep = "," if fmt == "csv" else "\t"
                _write_lines(separated_lines(df, sep), target, single, separated_header(df.columns, sep))
            elif fmt == "json":
                _write_lines(json_lines(df), target, single, None, array=single)
            elif fmt == "jsonl":
                _write_lines(json_lines(df), target, single, None)
            elif fmt == "fwf":
                w = fixed_widths(df.columns, by_name)
                _write_lines(fixed_lines(df, w), target, single, "".join(c.ljust(w[c]) for c in df.columns).rstrip())
            elif fmt == "excel":
                write_excel(df, target, list(variables))
            elif fmt == "stata":
                write_stata(df, target, by_name)
            size = os.path.getsize(target) if os.path.isfile(target) else sum(p.stat().st_size for p in Path(target).rglob("*") if p.is_file())
            out[fmt] = {"path": target, "size_mb": round(size / 2**20, 2)}
        except Exception as e:
            out[fmt] = {"path": target, "error": str(e)}
    return out
