import math
import struct

import numpy as np
import pyarrow as pa
import pytest
from loomfield.sources import container as C
from loomfield.sources.codebook import Block, Variable, parse_codebook
from loomfield.sources.encode import Spec, codebook_xml, encode_container, encode_values, slot_bytes
from loomfield.sources.layout import MARK, Column, LayoutError, Slot, akin, binary_width, count_slots, locate_blocks, match_slots, plan_block, read_slots, repaired_widths

DBL_MAX = 1.7976931348623157e308


def texts(raw, enc, width, n, low=0.0, dcml=0):
    col = Column(Variable("v", rng_min=low, dcml=dcml), Slot(1, enc, width, "v", 0), width)
    return C.column_array(raw, col, n).to_pylist()


@pytest.mark.parametrize(
    "raw,width,n,want",
    [
        (b"Hello\0\0World\0\0", 7, 2, ["Hello", "World"]), (b"AB   CD   ", 5, 2, ["AB", "CD"]), (bytes(10), 5, 2, ["", ""]), (b"a\0b", 3, 1, ["a b"]),
        (b"\xe9x\x1c", 3, 1, ["�x"]), (b"\x1c\t\x0bz\x1f", 5, 1, ["z"]), (b"", 3, 0, []), (b"", 0, 2, ["", ""]),
    ],
)
def test_char(raw, width, n, want):
    assert texts(raw, "char", width, n) == want


@pytest.mark.parametrize(
    "raw,width,low,want",
    [
        (b"\x05\x00\x0a\x00", 2, 100, ["105", "110"]), (b"\x03\x07", 1, 0, ["3", "7"]), (b"\xff" * 4, 2, 0, ["", ""]), (b"\x00\x09\x62\xff", 1, 1, ["1", "10", "99", ""]),
        (b"\xe8\x03", 2, 0, ["1000"]), (b"\x01" + bytes(9), 10, 0, ["1"]), (bytes(9) + b"\x80", 10, 0, [str(128 << 72)]), (b"\xff" * 7 + b"\x7f", 8, 0, [str((1 << 63) - 1)]), (b"\x05", 1, -9.7, ["-4"]),
    ],
)
def test_offset(raw, width, low, want):
    assert texts(raw, "offset", width, len(want), low) == want


def test_double():
    xs = [42.0, 3.14, 100.0, DBL_MAX, math.nan, math.inf, -0.0, -1e-9, 2.0**60, 1e300, 0.1 + 0.2, 123456789012.125, 1.0000015]
    want = ["42", "3.14", "100", "", "", "", "0", "-0", str(2**60), str(int(1e300)), "0.3", "123456789012.125", "1.000001"]
    assert texts(np.array(xs, "<f8").tobytes(), "double", 8, len(xs)) == want
    assert texts(np.array([1 / 3], "<f8").tobytes(), "double", 8, 1, dcml=9) == ["0.333333333"]
    with pytest.raises(OverflowError):
        texts(np.array([-math.inf], "<f8").tobytes(), "double", 8, 1)
    with pytest.raises(LayoutError):
        texts(b"123", "double", 8, 1)


@pytest.mark.parametrize("enc,lo,hi,width,cw,want", [("char", None, None, 11, 11, 11), ("double", 0, 400000, 6, 0, 8), ("offset", 0, 255, 3, 0, 1), ("offset", 0, 400000, 6, 0, 3), ("offset", None, None, 2, 0, 1), ("offset", 0, 1, 1, 0, 1), ("offset", 5, 5, 1, 0, 1), ("offset", 9, 1, 1, 0, 1), ("offset", 3, None, 4, 0, 2), ("offset", None, None, 20, 0, 9)])
def test_width(enc, lo, hi, width, cw, want):
    assert binary_width(Variable("v", ddi_width=width, rng_min=lo, rng_max=hi), enc, cw) == want


def small():
    a = [Spec(Variable("Key", "Key & <b>", "character", 3), "char", 3, 7), Spec(Variable("Amt", "", "numeric", 4, 0, 10.0, 900.0), "offset", 0, 2), Spec(Variable("Wgt", "w", "numeric", 5, 2), "double", 0, 5)]
    b = [Spec(Variable("Key", "", "character", 2), "char", 2, 1), Spec(Variable("Other", "", "numeric", 2), "offset", 0, 2)]
    ba = Block("F2", "Block-A", 3, [s.var for s in a])
    bb = Block("F10", "Block-B", 2, [s.var for s in b])
    data = encode_container([(ba, a, [["abc", None, "z"], [10, 900, None], [1.5, None, -2.0]]), (bb, b, [["q", "r"], [3, 98]])])
    return data, [bb, ba], codebook_xml([bb, ba])


def test_locate_plan_and_read(spark, tmp_path):
    data, blocks, xml = small()
    assert [(b.fid, b.name, b.nrecs, b.variables) for b in parse_codebook(xml)] == [(b.fid, b.name, b.nrecs, b.variables) for b in blocks]
    found = locate_blocks(data, blocks)
    assert set(found) == {"F2", "F10"}
    lay = plan_block(data, blocks[1], found["F2"])
    assert [c.name for c in lay.columns] == ["Key", "Amt", "Wgt"] and [c.offset for c in lay.columns] == [6 + 24, 0, 6] and lay.data_start == 8
    path, book = tmp_path / "x.bin", tmp_path / "DDI.xml"
    path.write_bytes(data), book.write_text(xml)
    rows = lambda **k: [tuple(r) for r in C.read_block(spark, str(path), **k).collect()]
    assert rows(block="F2") == [("abc", "10", "1.5"), ("", "900", ""), ("z", "", "-2")]
    assert rows(block="Block-B") == [("q", "3"), ("r", "98")]
    assert rows(block="F2", columns=["Wgt", "Key"], with_rec=True, rows_per_partition=2) == [(0, "1.5", "abc"), (1, "", ""), (2, "-2", "z")]
    assert rows(block="F2", typed=True) == [("abc", 10, 1.5), (None, 900, None), ("z", None, -2.0)]
    df = C.read_block(spark, str(path), "F2")
    assert df.schema["Key"].metadata["label"] == "Key & <b>"
    with pytest.raises(LayoutError):
        C.read_block(spark, str(path), "F77")


def test_files_that_are_no_containers(tmp_path):
    (tmp_path / "e").write_bytes(b"")
    (tmp_path / "m").write_bytes(b"NOTRIGHT" * 9)
    for n in "em":
        with pytest.raises(LayoutError):
            C.open_checked(str(tmp_path / n))


def test_slots():
    spec = Spec(Variable("Näme"), "char", 9, 300)
    raw = MARK + slot_bytes(spec) + slot_bytes(Spec(Variable("b"), "offset", 0, 4)) + slot_bytes(Spec(Variable(" "), "offset", 0, 5))
    assert read_slots(raw, 8, 2) == [Slot(300, "char", 9, "Näme", 0), Slot(4, "offset", 0, "b", 1)]
    assert count_slots(raw, 8, 50) == 2 and count_slots(raw, len(raw) - 5, 50) == 0
    with pytest.raises(LayoutError):
        read_slots(raw, 8, 4)
    bad = bytearray(slot_bytes(spec))
    bad[63:65] = b"\x00\xd8"
    assert read_slots(bytes(bad), 0, 1)[0].name == "var_300"


def test_matching():
    slot = lambda *ns: [Slot(i + 1, "offset", 0, n, i) for i, n in enumerate(ns)]
    var = lambda *ns: [Variable(n, ddi_width=1) for n in ns]
    names = lambda cols: [(c.var.name, c.name) for c in cols]
    assert names(match_slots(var("a", "b"), slot("x", "y"))) == [("a", "x"), ("b", "y")]
    assert names(match_slots(var("ab", "q", "c"), slot("c", "a"))) == [("c", "c"), ("ab", "a")]
    for vs, ss in ((var("a", "b"), slot("x")), (var(*"abcdefg"), slot("a")), (var("a", "zz", "y"), slot("a", "q")), (var("a", "b"), slot("x", "x"))):
        with pytest.raises(LayoutError):
            match_slots(vs, ss)
    assert akin("ab", "abc") and akin("abc", "ab") and not akin("ab", "b")


def test_width_repair():
    col = lambda n, w, hi: Column(Variable(n, ddi_width=1, rng_min=0.0 if hi else None, rng_max=hi), Slot(ord(n), "offset", 0, n, ord(n)), w)
    cols = [col("a", 3, 60_000.0), col("b", 2, 300.0), col("c", 2, None)]
    assert [c.width for c in repaired_widths(cols, 10, 70)] == [3, 2, 2]
    assert [c.width for c in repaired_widths(cols, 10, 60)] == [2, 2, 2]
    assert [c.width for c in repaired_widths(cols, 10, 50)] == [2, 2, 1]
    with pytest.raises(LayoutError):
        repaired_widths(cols, 10, 49)


def test_wide_block_and_shared_names():
    n = 260
    specs = [Spec(Variable(f"V{i}", ddi_width=1), "offset", 0, i + 1) for i in range(n)]
    b1, b2 = Block("F1", "one", 1, [s.var for s in specs]), Block("F2", "two", 2, [s.var for s in specs])
    data = encode_container([(b1, specs, [[i % 9] for i in range(n)]), (b2, specs, [[1, 2]] * n)])
    found = locate_blocks(data, [b1, b2])
    assert set(found) == {"F1", "F2"} and found["F1"] < found["F2"]
    assert plan_block(data, b2, found["F2"]).data_start == found["F1"] + 160 * n


def test_codebook_details():
    xml = """<c:codeBook xmlns:c="u"><c:fileDscr ID="F1_2" URI="a?Name=b?Name=c d"><c:x><c:dimensns><c:caseQnty> 7 </c:caseQnty></c:dimensns></c:x></c:fileDscr><c:fileDscr/>
    <c:var name="n" files="F1_2 F9"><c:location width="3"/><c:labl> lab </c:labl><c:invalrng><c:range min="1_000" max="?"/></c:invalrng><c:valrng><c:range min="2" max="3"/></c:valrng></c:var></c:codeBook>"""
    b, other = parse_codebook(xml)
    assert (b.fid, b.fid_num, b.name, b.nrecs) == ("F1_2", 12, "c d", 7) and (other.fid, other.fid_num, other.nrecs) == ("", 0, 0)
    assert b.variables == [Variable("n", "lab", "character", 3, 0, 1000.0, None)]
    for bad in ("<a>", '<!DOCTYPE a [<!ENTITY x "y">]><a/>', "<a><fileDscr><dimensns><caseQnty>x</caseQnty></dimensns></fileDscr></a>"):
        with pytest.raises(Exception):
            parse_codebook(bad)


def test_no_records(spark, tmp_path):
    specs = [Spec(Variable("a", ddi_width=3), "double"), Spec(Variable("b", ddi_width=3), "char", 3, 2)]
    b = Block("F1", "none", 0, [s.var for s in specs])
    (tmp_path / "x").write_bytes(encode_container([(b, specs, [[], []])]))
    (tmp_path / "ddi.xml").write_text(codebook_xml([b]))
    df = C.read_block(spark, str(tmp_path / "x"), "F1")
    assert df.columns == ["a", "b"] and df.count() == 0


def test_encoder_and_struct_agree():
    assert encode_values([1.5], Spec(Variable("x"), "double")) == struct.pack("<d", 1.5)
    assert isinstance(C.decode_char(b"ab", 1, 2), pa.Array)


def test_slots_behind_the_codebooks_are_an_error(spark, tmp_path):
    """A slot more than variables would shift every value; data that follows a block's slots is no slot."""
    specs = [Spec(Variable(n, "", "character", 2), "char", 2, i + 1) for i, n in enumerate(("aa", "bb", "cc"))]
    rows = [["a1", "a2"], ["b1", "b2"], ["c1", "c2"]]
    block = Block("F1", "b", 2, [s.var for s in specs])
    path, book = tmp_path / "x.bin", tmp_path / "ddi.xml"
    path.write_bytes(encode_container([(block, specs, rows)]))
    book.write_text(codebook_xml([Block("F1", "b", 2, block.variables[:2])]))
    with pytest.raises(LayoutError, match="cc"):
        C.read_block(spark, str(path), "F1")
    # numbers behind the slots that read as valid slot numbers, and a second block without records
    numbers = [Spec(Variable("n", ddi_width=9), "offset", 0, 1), Spec(Variable("m", ddi_width=9), "offset", 0, 2)]
    second, third = Block("F2", "n", 300, [s.var for s in numbers]), Block("F3", "z", 0, [Variable("zz", ddi_width=1)])
    data = encode_container([(block, specs, rows), (second, numbers, [[0x0041] * 300, [0x0042] * 300]), (third, [Spec(third.variables[0], "offset")], [[]])])
    path.write_bytes(data), book.write_text(codebook_xml([block, second, third]))
    assert [tuple(r) for r in C.read_block(spark, str(path), "F1").collect()] == [("a1", "b1", "c1"), ("a2", "b2", "c2")]
    assert C.read_block(spark, str(path), "F2").distinct().collect() == [("65", "66")]
    assert C.read_block(spark, str(path), "F3").count() == 0


def test_values_and_arrays_encode_alike():
    text = Spec(Variable("t"), "char", 3)
    assert encode_values(pa.array(["ab", None, "abcd"]), text) == encode_values(["ab", None, "abcd"], text) == b"ab    abc"
    assert encode_values(["é"], text) == b"?  " and encode_values(["é"], Spec(Variable("t"), "char", 3, raw=True)) == b"\xc3\xa9 "
    n = Spec(Variable("n", rng_min=-5.0, rng_max=400.0), "offset")
    assert encode_values(pa.array([-5, None, 400]), n) == encode_values([-5, None, 400], n) == b"\0\0\xff\xff\x95\x01"
    with pytest.raises(OverflowError):
        encode_values([-6], n)
