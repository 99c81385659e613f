"""Writing containers: for tests and for round trips of whole tables.

Rows are laid out in a given order and cut into ranges; each task encodes its
range column by column into piece files in a shared folder. Since the file is
column-major, it is then the pieces strung together: a stream of file copies that
holds no data in memory.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import quoteattr

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import local_path, scratch
from .codebook import Block, Variable
from .layout import CHAR_FLAG, CHAR_FLAG_AT, CHAR_WIDTH_AT, DOUBLE_FLAG, DOUBLE_FLAG_AT, MARK, NAME_AT, NAME_BYTES, SLOT_BYTES, binary_width


@dataclass(frozen=True)
class Spec:
    """How a column is stored: its variable, encoding, width of text, and place among the data."""

    var: Variable
    encoding: str
    char_width: int = 0
    var_num: int = 1
    raw: bool = False  # text beyond ASCII is stored as its UTF-8 bytes, not as question marks

    @property
    def width(self) -> int:
        return binary_width(self.var, self.encoding, self.char_width)


def slot_bytes(spec: Spec) -> bytes:
    b = bytearray(SLOT_BYTES)
    struct.pack_into("<I", b, 0, spec.var_num)
    if spec.encoding == "char":
        b[CHAR_FLAG_AT], b[CHAR_WIDTH_AT] = CHAR_FLAG, spec.char_width
    elif spec.encoding == "double":
        b[DOUBLE_FLAG_AT] = DOUBLE_FLAG
    name = spec.var.name.encode("utf-16-le")[:NAME_BYTES]
    b[NAME_AT : NAME_AT + len(name)] = name
    return bytes(b)


def _encode_texts(text: pa.Array, spec: Spec) -> bytes:
    w = spec.width
    text = pc.fill_null(text.cast(pa.string()), "")
    if not pc.all(pc.string_is_ascii(text)).as_py():
        how = ("utf-8", "strict") if spec.raw else ("ascii", "replace")
        return b"".join(v.encode(*how)[:w].ljust(w) for v in text.to_pylist())
    text = pc.ascii_rpad(pc.utf8_slice_codeunits(text, 0, w), w)
    return text.buffers()[2][text.offset * w : (text.offset + len(text)) * w].to_pybytes() if w and len(text) else b""


def encode_values(values: list | pa.Array, spec: Spec) -> bytes:
    """Values of one column; None means missing."""
    w = spec.width
    if spec.encoding == "char":
        return _encode_texts(values if isinstance(values, pa.Array) else pa.array(values, pa.string()), spec)
    if spec.encoding == "double":
        return np.array([np.nan if v is None else v for v in values] if isinstance(values, list) else values.cast(pa.float64()).to_numpy(zero_copy_only=False), "<f8").tobytes()
    low = int(spec.var.rng_min or 0)
    if w > 7 or abs(low) >= 1 << 62:
        values = values if isinstance(values, list) else values.to_pylist()
        return b"".join(b"\xff" * w if v is None else (int(v) - low).to_bytes(w, "little") for v in values)
    values = pa.array(values, pa.int64()) if isinstance(values, list) else values.cast(pa.int64())
    above = pc.fill_null(values, low).to_numpy() - low
    if len(above) and (above.min() < 0 or above.max() >= 1 << 8 * w):
        raise OverflowError(f"{spec.var.name}: values beyond {w} bytes above {low}")
    cells = np.ascontiguousarray(above, "<i8").view(np.uint8).reshape(-1, 8)[:, :w].copy()
    cells[values.is_null().to_numpy(zero_copy_only=False)] = 255
    return cells.tobytes()


def codebook_xml(blocks: list[Block]) -> str:
    out = ["<codeBook>"]
    for b in blocks:
        out.append(f"<fileDscr ID={quoteattr(b.fid)} URI={quoteattr('x?Name=' + b.name)}><fileTxt><dimensns><caseQnty>{b.nrecs}</caseQnty></dimensns></fileTxt></fileDscr>")
    out.append("<dataDscr>")
    for b in blocks:
        for v in b.variables:
            rng = "" if v.rng_min is None and v.rng_max is None else "<valrng><range" + "".join(f' {k}="{x!r}"' for k, x in (("min", v.rng_min), ("max", v.rng_max)) if x is not None) + "/></valrng>"
            label = f"<labl>{v.label.replace('&', '&amp;').replace('<', '&lt;')}</labl>" if v.label else ""
            out.append(f'<var name={quoteattr(v.name)} files={quoteattr(b.fid)}><location width="{v.ddi_width}"/>{label}{rng}<varFormat type={quoteattr(v.type)} dcml="{v.dcml}"/></var>')
    return "\n".join(out + ["</dataDscr></codeBook>"])


def encode_container(blocks: list[tuple[Block, list[Spec], list[list]]]) -> bytes:
    """A container of small blocks (block, specs in slot order, columns of values)."""
    out = [MARK]
    for _, specs, columns in blocks:
        by_num = sorted(zip(specs, columns), key=lambda x: x[0].var_num)
        out += [encode_values(c, s) for s, c in by_num] + [slot_bytes(s) for s in specs]
    return b"".join(out)


def specs_for(df: DataFrame) -> list[Spec]:
    """Storage that fits the table: text by its longest value, whole numbers by their range, doubles as such; one aggregate."""
    aggs = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            aggs.append(F.struct(F.lit(None).cast("double"), F.max(F.octet_length(c)).cast("double")))
        elif isinstance(f.dataType, T.IntegralType):
            aggs.append(F.struct(F.min(c).cast("double"), F.max(c).cast("double")))
        else:
            aggs.append(F.struct(F.lit(None).cast("double"), F.lit(None).cast("double")))
    got = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    out = []
    for i, f in enumerate(df.schema.fields):
        low, high = got[i]
        num = len(df.columns) - i  # data order differs from slot order, as it may
        if isinstance(f.dataType, T.StringType):
            w = max(1, int(high or 1))
            if w > 255:
                raise ValueError(f"{f.name}: text of {w} bytes is too wide for a container")
            out.append(Spec(Variable(f.name, f.name, "character", w), "char", w, num))
        elif isinstance(f.dataType, T.IntegralType):
            low, high = low or 0.0, high or 0.0
            if int(high) - int(low) + 1 == 1 << 8 * max(1, (max(1, int(high) - int(low)).bit_length() + 7) // 8):
                high += 1.0  # else the highest value would read as missing
            out.append(Spec(Variable(f.name, f.name, "numeric", len(str(int(high))), 0, low, high), "offset", 0, num))
        else:
            out.append(Spec(Variable(f.name, f.name, "numeric", 12, 6), "double", 0, num))
    return out


def write_container(df: DataFrame, order: list[str], name: str = "Block-1", folder: str | None = None) -> tuple[str, str, str]:
    """Write a table as a container of one block in the given order; returns (container, codebook, fid)."""
    path, book, blocks = write_blocks([Table(df, tuple(order), "F1", name)], folder)
    return path, book, blocks[0].fid


@dataclass(frozen=True)
class Table:
    """A table to be stored as a block, in the order of some of its columns; specs are found from the table unless given."""

    df: DataFrame
    order: tuple[str, ...]
    fid: str
    name: str
    specs: tuple[Spec, ...] | None = None


def _pieces(table: Table, specs: list[Spec], target: str) -> list[tuple[int, int]]:
    """Encode ranges of rows column by column into files of target; (range, rows) in order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, tmp = None, 0, uuid.uuid4().hex
        files = []
        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part = b["_part"][0].as_py()
                files = [open(f"{target}/{part:08d}-{i:04d}.{tmp}", "wb") for i in range(len(specs))]
            for i, s in enumerate(specs):
                files[i].write(encode_values(b[s.var.name], s))
            n += b.num_rows
        for i, f in enumerate(files):
            f.close()
            os.replace(f.name, f"{target}/{part:08d}-{i:04d}")  # a repeated task writes the same piece again
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64())], names=["part", "n"])

    laid = table.df.repartitionByRange(*table.order).sortWithinPartitions(*table.order).withColumn("_part", F.spark_partition_id())
    return sorted((r["part"], r["n"]) for r in laid.mapInArrow(encode, "part int, n long").collect())  # one row per task


def write_blocks(tables: list[Table], folder: str | None = None) -> tuple[str, str, list[Block]]:
    """Write tables as the blocks of one container; returns (container, codebook, blocks).

    The folder must be a file system that all executors see.
    """
    spark = tables[0].df.sparkSession
    folder = Path(local_path(folder or scratch(spark, "containers")))
    folder.mkdir(parents=True, exist_ok=True)
    path, blocks = folder / "data.bin", []
    with open(path, "wb") as out:
        out.write(MARK)
        for t in tables:
            specs = list(t.specs) if t.specs is not None else specs_for(t.df)
            pieces = folder / f"pieces-{t.fid}"
            pieces.mkdir()
            parts = _pieces(t, specs, str(pieces))
            for _, i in sorted((s.var_num, i) for i, s in enumerate(specs)):
                for part, _ in parts:
                    with open(pieces / f"{part:08d}-{i:04d}", "rb") as f:
                        shutil.copyfileobj(f, out, 1 << 20)
            for s in specs:
                out.write(slot_bytes(s))
            shutil.rmtree(pieces)
            blocks.append(Block(t.fid, t.name, sum(n for _, n in parts), [s.var for s in specs]))
    book = folder / "ddi.xml"
    book.write_text(codebook_xml(blocks), encoding="utf-8")
    return str(path), str(book), blocks
