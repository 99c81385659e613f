"""Where a container keeps each block: slots, widths, offsets. Pure functions on bytes.

A container starts with a mark. A block's data lie column by column directly
before its slots; a slot describes one column.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

from .codebook import Block, Variable

# Fixed values of the format.
MARK = b"NESSTART"
SLOT_BYTES = 160
CHAR_FLAG_AT, CHAR_FLAG = 4, 1
DOUBLE_FLAG_AT, DOUBLE_FLAG = 5, 10
CHAR_WIDTH_AT = 14
NAME_AT, NAME_BYTES = 63, 80
LARGEST_VAR_NUM = 50_000


class LayoutError(ValueError):
    """The container does not fit its codebook."""


@dataclass(frozen=True)
class Slot:
    var_num: int
    encoding: str
    char_width: int
    name: str
    index: int


@dataclass(frozen=True)
class Column:
    """A codebook variable joined with its slot; offset counts bytes from the block's first."""

    var: Variable
    slot: Slot
    width: int
    offset: int = 0

    @property
    def name(self) -> str:
        return self.slot.name


@dataclass(frozen=True)
class BlockLayout:
    """columns stand in output order; data_start is a place in the file."""

    block: Block
    columns: tuple[Column, ...]
    data_start: int

    @property
    def record_bytes(self) -> int:
        return sum(c.width for c in self.columns)


def _name(data, at: int) -> str | None:
    try:
        return bytes(data[at + NAME_AT : at + NAME_AT + NAME_BYTES]).decode("utf-16-le").partition("\0")[0]
    except UnicodeDecodeError:
        return None


def akin(a: str, b: str) -> bool:
    """Equal, or one begins with the other."""
    return a.startswith(b) or b.startswith(a)


def read_slots(data, start: int, n: int) -> list[Slot]:
    out = []
    for i in range(n):
        at = start + i * SLOT_BYTES
        if at + SLOT_BYTES > len(data):
            raise LayoutError(f"slot {i} at {at} is cut off")
        num = struct.unpack_from("<I", data, at)[0]
        encoding = "char" if data[at + CHAR_FLAG_AT] == CHAR_FLAG else "double" if data[at + DOUBLE_FLAG_AT] == DOUBLE_FLAG else "offset"
        name = _name(data, at)
        out.append(Slot(num, encoding, data[at + CHAR_WIDTH_AT] if encoding == "char" else 0, f"var_{num}" if name is None else name, i))
    return out


def _valid_number(data, at: int) -> bool:
    return 1 <= struct.unpack_from("<I", data, at)[0] <= LARGEST_VAR_NUM


def count_slots(data, start: int, limit: int) -> int:
    """Length of the run of valid slots from start, at most limit."""
    n = 0
    while n < limit:
        at = start + n * SLOT_BYTES
        if at + SLOT_BYTES > len(data) or not _valid_number(data, at) or not (_name(data, at) or "").strip():
            break
        n += 1
    return n


def _starts(data, block: Block, alone: dict) -> Iterator[int]:
    """Places where the block's slots may begin, by the names that tell most first."""
    names = [v.name for v in block.variables]
    keys = [(n, i) for i, n in enumerate(names) if n in alone] + [(names[0], 0)]
    if len(names) > 1:
        keys.append((names[-1], len(names) - 1))
    for name, i in keys:
        needle = name.encode("utf-16-le")
        at = data.find(needle) if needle else -1
        while at >= 0:
            start = at - NAME_AT - i * SLOT_BYTES
            if start >= 0:
                yield start
            at = data.find(needle, at + 1)


def _accepts(data, start: int, block: Block) -> bool:
    n = len(block.variables)
    if start + SLOT_BYTES > len(data) or not _valid_number(data, start):
        return False
    first, last = block.variables[0].name, block.variables[-1].name
    head = _name(data, start)
    if head is None or not akin(head, first):
        return False
    run = count_slots(data, start, n + 4)
    ends = []
    if run >= n:
        ends.append(n)
    if 0 < run and abs(run - n) <= 3:
        ends.append(run)
    tails = [_name(data, start + (e - 1) * SLOT_BYTES) for e in ends]
    return run == n or any(t is not None and akin(t, last) for t in tails)


def single_owners(blocks: list[Block]) -> dict[str, tuple[str, int]]:
    """name -> (fid, place among its variables) of the names that just one variable of the codebook bears."""
    owners = Counter(v.name for b in blocks for v in b.variables)
    return {v.name: (b.fid, i) for b in blocks for i, v in enumerate(b.variables) if owners[v.name] == 1}


def locate_blocks(data, blocks: list[Block]) -> dict[str, int]:
    """fid -> place of the first slot, for each block that can be found."""
    alone = single_owners(blocks)
    found: dict[str, int] = {}
    taken: set[tuple[int, int]] = set()
    for block in sorted(blocks, key=lambda b: b.fid_num):
        n = len(block.variables)
        for start in _starts(data, block, alone) if n else ():
            if (start, n) not in taken and _accepts(data, start, block):
                found[block.fid] = start
                taken.add((start, n))
                break
    return found


def binary_width(var: Variable, encoding: str, char_width: int) -> int:
    """Bytes of one value."""
    if encoding == "char":
        return char_width
    if encoding == "double":
        return 8
    if var.rng_min is not None and var.rng_max is not None:
        span = max(1, int(var.rng_max) - int(var.rng_min))
    else:
        span = 10**var.ddi_width - 1
    return max(1, (span.bit_length() + 7) // 8)


def match_slots(variables: list[Variable], slots: list[Slot]) -> list[Column]:
    """Variables joined with slots, in slot order.

    Equal counts pair by position. With up to five apart, each variable takes
    the slot of its name, else the first free slot whose name is akin; a
    variable without slot is dropped, a slot without variable is an error,
    since its width is unknown.
    """
    if len(variables) == len(slots):
        pairs = list(zip(variables, slots))
    elif abs(len(variables) - len(slots)) <= 5:
        free = {s.name: s for s in slots}
        pairs = []
        for v in variables:
            name = v.name if v.name in free else next((n for n in free if akin(v.name, n)), None)
            if name is not None:
                pairs.append((v, free.pop(name)))
        if not pairs:
            raise LayoutError(f"none of {len(variables)} variables is among {len(slots)} slots")
        if free:
            raise LayoutError(f"slots without variable: {', '.join(free)}")
    else:
        raise LayoutError(f"{len(variables)} variables but {len(slots)} slots")
    names = Counter(s.name for _, s in pairs)
    if twice := [n for n, k in names.items() if k > 1]:
        raise LayoutError(f"columns of one name: {', '.join(twice)}")
    return sorted((Column(v, s, binary_width(v, s.encoding, s.char_width)) for v, s in pairs), key=lambda c: c.slot.index)


def repaired_widths(columns: list[Column], nrecs: int, room: int) -> list[Column]:
    """Widths that fit the room before the slots: the widest whole numbers lose a byte each, where their range allows."""
    cols = list(columns)
    wide = [i for i, c in enumerate(cols) if c.slot.encoding == "offset" and c.width > 1]
    total = sum(c.width for c in cols)
    for i in sorted(wide, key=lambda i: (-cols[i].width, cols[i].slot.var_num)):
        if total * nrecs <= room:
            break
        c = cols[i]
        v = c.var
        if v.rng_min is not None and v.rng_max is not None and int(v.rng_max) - int(v.rng_min) >= 1 << 8 * (c.width - 1):
            continue
        cols[i] = replace(c, width=c.width - 1)
        total -= 1
    if total * nrecs > room:
        raise LayoutError(f"{total} bytes a record for {nrecs} records do not fit the {room} bytes before the slots")
    return cols


def further_slots(data, start: int, limit: int, others: frozenset[int] = frozenset()) -> int:
    """Slots from start, where a codebook says there should be none, at most limit.

    Behind a block's slots lie other bytes, so more is asked of these than of
    slots that are expected: a printable name with nothing behind it in its
    field, and no place where another block is known to begin.
    """
    n = 0
    while n < limit:
        at = start + n * SLOT_BYTES
        if at in others or at + SLOT_BYTES > len(data) or not _valid_number(data, at):
            break
        name = _name(data, at) or ""
        behind = bytes(data[at + NAME_AT + len(name.encode("utf-16-le")) : at + NAME_AT + NAME_BYTES])
        if not name.strip() or not name.isprintable() or any(behind):
            break
        n += 1
    return n


def plan_block(data, block: Block, start: int, others: frozenset[int] = frozenset()) -> BlockLayout:
    """The layout of a located block: matched columns, widths, and offsets in the order of var_num.

    others are the places of other blocks' slots. Slots beyond the codebook's
    variables take part in the matching, where a slot without variable is an
    error: reading on without its width would shift every value.
    """
    n = len(block.variables)
    run = count_slots(data, start, n)
    if run == n:
        run += further_slots(data, start + n * SLOT_BYTES, 6, others)
    cols = match_slots(block.variables, read_slots(data, start, run))
    cols = repaired_widths(cols, block.nrecs, start - len(MARK))
    at, placed = 0, {}
    for c in sorted(cols, key=lambda c: c.slot.var_num):
        placed[c.slot.index] = at
        at += c.width * block.nrecs
    return BlockLayout(block, tuple(replace(c, offset=placed[c.slot.index]) for c in cols), start - at)
