"""Spark batch source for containers: row-range partitions, pruned columns, Arrow batches.

    spark.dataSource.register(ContainerSource)
    spark.read.format("survey_container").option("codebook", xml).option("block", "F2").load(path)

Every value has a fixed width, so rows a..b of a column are one contiguous
slice: partitions read just their slices and nothing is shuffled. Spark does not
prune the columns of Python sources, so read_block passes the wanted schema.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import STRIP_SPACE
from ..session import local_path
from .codebook import Block, find_codebook, read_codebook
from .layout import MARK, BlockLayout, Column, LayoutError, locate_blocks, plan_block

#: The largest double, and the share of it from which a value means "missing".
MISSING_FROM = 1.7976931348623157e308 * 0.99
BATCH_ROWS = 65_536
PART_BYTES = 64 << 20
REC = "_rec"


# --- decoding -------------------------------------------------------------------------------------


def decode_char(raw: bytes, width: int, n: int) -> pa.Array:
    """Fixed-width ASCII: NUL is a space, each other byte beyond ASCII one replacement sign, ends stripped."""
    if width == 0:
        return pa.array([""] * n, pa.string())
    raw = raw.replace(b"\0", b" ")
    if raw.isascii():
        ends = np.arange(n + 1, dtype=np.int32) * width
        text = pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])
        return pc.utf8_trim(text, characters=STRIP_SPACE)
    text = raw.decode("ascii", "replace")
    return pa.array([text[i : i + width].strip() for i in range(0, n * width, width)], pa.string())


def decode_offset(raw: bytes, width: int, n: int, lowest: int) -> tuple[list | np.ndarray, np.ndarray]:
    """(values, missing) of little-endian unsigned numbers above lowest; all bits set means missing."""
    cells = np.frombuffer(raw, np.uint8, n * width).reshape(n, width)
    missing = (cells == 255).all(1)
    if width <= 7 and abs(lowest) < 1 << 62:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = cells
        return wide.view("<i8").ravel() + lowest, missing
    return [int.from_bytes(raw[i : i + width], "little") + lowest for i in range(0, n * width, width)], missing


def double_text(x: float, dcml: int) -> str:
    """A finite double: whole numbers exactly, others with max(dcml, 6) decimals less trailing zeros."""
    if x == int(x):
        return str(int(x))
    return f"{x:.{max(dcml, 6)}f}".rstrip("0").rstrip(".")


def decode_double(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, missing); minus infinity is an error of the block."""
    x = np.frombuffer(raw, "<f8", n)
    missing = np.isnan(x) | (x >= MISSING_FROM)
    if np.isneginf(x).any():
        raise OverflowError("minus infinity has no decimal text")
    return x, missing


def _texts(values, missing: np.ndarray) -> pa.Array:
    text = pa.array(values).cast(pa.string()) if isinstance(values, np.ndarray) else pa.array([str(v) for v in values], pa.string())
    return pc.if_else(pa.array(missing), "", text)


def _double_texts(x: np.ndarray, missing: np.ndarray, dcml: int) -> pa.Array:
    """The texts of double_text for a whole column: each distinct number is written once."""
    x = np.where(missing, 0.0, x)
    values, place = np.unique(x, return_inverse=True)
    whole = (values == np.trunc(values)) & (np.abs(values) < 2.0**53)
    out = np.empty(len(values), object)
    out[whole] = values[whole].astype(np.int64).astype(str)
    part = ~whole & (values != np.trunc(values))
    if part.any():
        fixed = pa.array(np.char.mod(f"%.{max(dcml, 6)}f", values[part]))
        out[part] = pc.utf8_rtrim(pc.utf8_rtrim(fixed, characters="0"), characters=".").to_numpy(zero_copy_only=False)
    for i in np.flatnonzero(~whole & ~part):
        out[i] = double_text(float(values[i]), dcml)
    texts = pa.array(out, pa.string()).take(pa.array(place.ravel()))
    return pc.if_else(pa.array(missing), "", texts)


def column_array(raw: bytes, col: Column, n: int, typed: bool = False) -> pa.Array:
    """n values of a column, as text with '' for missing, or typed with null for missing."""
    if len(raw) < col.width * n:
        raise LayoutError(f"{col.name}: {len(raw)} bytes of {col.width * n}")
    kind = col.slot.encoding
    if kind == "char":
        text = decode_char(raw, col.width, n)
        return pc.if_else(pc.equal(text, ""), None, text) if typed else text
    if kind == "offset":
        values, missing = decode_offset(raw, col.width, n, int(col.var.rng_min or 0))
        if not typed:
            return _texts(values, missing)
        if isinstance(values, np.ndarray):
            return pa.array(values, pa.int64(), mask=missing)
        return pa.array([None if m else v for v, m in zip(values, missing)], pa.decimal128(38, 0))
    x, missing = decode_double(raw, n)
    if typed:
        return pa.array(x, pa.float64(), mask=missing)
    return _double_texts(x, missing, col.var.dcml)


# --- planning -------------------------------------------------------------------------------------


def open_checked(path: str) -> mmap.mmap:
    """The mapped file; empty files and files without the mark are errors."""
    if os.path.getsize(path) == 0:
        raise LayoutError(f"{path} is empty")
    with open(path, "rb") as f:
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    if data[: len(MARK)] != MARK:
        raise LayoutError(f"{path} does not begin with {MARK.decode()}")
    return data


@lru_cache(maxsize=16)
def _locations(path: str, codebook: str, stamp: tuple) -> tuple[list[Block], dict[str, int]]:
    blocks = read_codebook(codebook)
    with open_checked(path) as data:
        return blocks, locate_blocks(data, blocks)


def container_plan(path: str, codebook: str) -> tuple[list[Block], dict[str, int]]:
    """Blocks of the codebook and the places of those found; kept by path, time and size."""
    s, c = os.stat(path), os.stat(codebook)
    return _locations(path, codebook, (s.st_mtime_ns, s.st_size, c.st_mtime_ns, c.st_size))


def block_layout(path: str, codebook: str, block: str) -> BlockLayout:
    """The layout of one block, given by fid or name."""
    blocks, found = container_plan(path, codebook)
    chosen = next((b for b in blocks if b.fid == block), None) or next((b for b in blocks if b.name == block), None)
    if chosen is None:
        raise LayoutError(f"the codebook has no block {block}")
    if chosen.fid not in found:
        raise LayoutError(f"block {chosen.fid} was not found in the container")
    with open_checked(path) as data:
        return plan_block(data, chosen, found[chosen.fid], frozenset(p for f, p in found.items() if f != chosen.fid))


def _spark_type(col: Column, typed: bool) -> T.DataType:
    if not typed or col.slot.encoding == "char":
        return T.StringType()
    if col.slot.encoding == "double":
        return T.DoubleType()
    return T.LongType() if col.width <= 7 else T.DecimalType(38, 0)


def block_schema(layout: BlockLayout, typed: bool = False, with_rec: bool = False) -> T.StructType:
    fields = [T.StructField(c.name, _spark_type(c, typed), True, {"label": c.var.label, "type": c.var.type}) for c in layout.columns]
    return T.StructType(([T.StructField(REC, T.LongType())] if with_rec else []) + fields)


# --- the source -----------------------------------------------------------------------------------


@dataclass
class RowRange(InputPartition):
    first: int
    end: int

    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class ContainerReader(DataSourceReader):
    def __init__(self, path: str, layout: BlockLayout, schema: T.StructType, typed: bool, rows: int):
        self.path, self.layout, self.schema, self.typed, self.rows = path, layout, schema, typed, rows

    def partitions(self) -> list[RowRange]:
        n = self.layout.block.nrecs
        return [RowRange(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [RowRange(0, 0)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        by_name = {c.name: c for c in self.layout.columns}
        n = self.layout.block.nrecs
        with open(self.path, "rb") as f:
            for a in range(partition.first, partition.end, BATCH_ROWS):
                b = min(partition.end, a + BATCH_ROWS)
                arrays = []
                for name in self.schema.names:
                    if name == REC and name not in by_name:
                        arrays.append(pa.array(np.arange(a, b, dtype=np.int64)))
                        continue
                    col = by_name[name]
                    assert b <= n
                    f.seek(self.layout.data_start + col.offset + a * col.width)
                    arrays.append(column_array(f.read((b - a) * col.width), col, b - a, self.typed))
                yield pa.RecordBatch.from_arrays(arrays, names=self.schema.names)


class ContainerSource(DataSource):
    """Options: codebook (else the ddi.xml beside), block (fid or name), typed, withRec, rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "survey_container"

    def _layout(self) -> tuple[str, BlockLayout]:
        path = local_path(self.options["path"])
        book = self.options.get("codebook") or find_codebook(path)
        return path, block_layout(path, local_path(book), self.options["block"])

    def _flag(self, name: str) -> bool:
        return str(self.options.get(name, "false")).lower() == "true"

    def schema(self) -> T.StructType:
        return block_schema(self._layout()[1], self._flag("typed"), self._flag("withRec"))

    def reader(self, schema: T.StructType) -> ContainerReader:
        path, layout = self._layout()
        rows = int(self.options.get("rowsPerPartition", 0)) or max(1, min(PART_BYTES // max(1, layout.record_bytes), -(-layout.block.nrecs // 8) or 1))
        return ContainerReader(path, layout, schema, self._flag("typed"), max(rows, 10_000) if "rowsPerPartition" not in self.options else rows)


def read_block(spark: SparkSession, path: str, block: str, codebook: str | None = None, columns: list[str] | None = None, typed: bool = False, with_rec: bool = False, rows_per_partition: int | None = None) -> DataFrame:
    """A block as a DataFrame; only the named columns are read from the file."""
    path = local_path(path)
    codebook = local_path(codebook) if codebook else find_codebook(path)
    full = block_schema(block_layout(path, codebook, block), typed, with_rec)
    if columns is not None:
        full = T.StructType([full[c] for c in ([REC] if with_rec else []) + columns])
    spark.dataSource.register(ContainerSource)
    r = spark.read.format("survey_container").schema(full).option("codebook", codebook).option("block", block)
    r = r.option("typed", str(typed).lower()).option("withRec", str(with_rec).lower())
    if rows_per_partition:
        r = r.option("rowsPerPartition", rows_per_partition)
    return r.load(path)
