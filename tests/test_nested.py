import random
import xml.etree.ElementTree as ET
from collections import Counter

import pyarrow.parquet as pq
from loomfield.operators.codebook_tables import codebook_links
from loomfield.operators.nested_records import label_nodes, nearest_above, refused_texts, walk_xml
from loomfield.plans.general import QUERIES


def brute(doc, xml):
    try:
        root = ET.fromstring(xml)
    except (ET.ParseError, TypeError):
        return set()
    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: (e.text or "").strip()
    files = {}
    for e in root.iter():
        if local(e) == "fileDscr":
            files[e.get("ID", "").strip()] = [text(x) for x in e.iter() if local(x) == "caseQnty" and text(x)]
    out = {(doc, "file", "", f) for f in files} | {(doc, "cases", f, c[0]) for f, c in files.items() if c}
    for v in root.iter():
        if local(v) == "var":
            known = [f for f in v.get("files", "").split() if f in files]
            out |= {(doc, "var", f, v.get("ID", "").strip()) for f in known}
            if known:
                out |= {(doc, "cat", v.get("ID", "").strip(), text(c)) for c in v.iter() if local(c) == "catValu"}
    return out


def test_against_tree_search(spark, tiny):
    rows = pq.read_table(f"{tiny}/ddi_codebooks.parquet").to_pylist()
    want = set().union(*(brute(r["codebook_id"], r["ddi_xml"]) for r in rows))
    got = [tuple(r) for r in codebook_links(spark.read.parquet(f"{tiny}/ddi_codebooks.parquet")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_odd_documents(spark):
    xs = [
        (1, "<a><fileDscr ID='F1'><dimensns><caseQnty> 5 </caseQnty></dimensns></fileDscr><fileDscr ID='F1'/><var ID='V' files='F1 F1 F9'><catgry><catValu> 1<!-- x --> </catValu></catgry></var></a>"),
        (2, "<a><![CDATA[<fileDscr ID='F1'/>]]><!-- <fileDscr ID='F2'/> --></a>"),
        (3, "<a><fileDscr ID='F1'></a>"),
        (4, None),
        (5, ""),
        (6, "<!DOCTYPE a [<!ENTITY x 'y'>]><a><fileDscr ID='F1'><caseQnty>&x;</caseQnty></fileDscr></a>"),
        (7, "<p:a xmlns:p='u'><p:fileDscr ID='F1'/><p:var files='F1' ID='V'/></p:a>"),
        (7, "<p:a xmlns:p='u'><p:fileDscr ID='F1'/><p:var files='F1' ID='V'/></p:a>"),
        (None, "<a><fileDscr ID='F1'/></a>"),
        (8, "<a>" + "<b>" * 3000 + "<fileDscr ID='F1'/>" + "</b>" * 3000 + "</a>"),
    ]
    df = spark.createDataFrame([(*x, "c") for x in xs], "codebook_id long, ddi_xml string, DOC string")
    got = sorted(tuple(r) for r in codebook_links(df).collect())
    assert got == [(1, "cat", "V", "1"), (1, "file", "", "F1"), (1, "var", "F1", "V"), (6, "cases", "F1", "y"), (6, "file", "", "F1"), (7, "file", "", "F1"), (7, "var", "F1", "V"), (8, "file", "", "F1")]
    assert codebook_links(df.limit(0)).count() == 0


def test_labels_mean_containment(spark):
    xml = "<a><b><c/><d><c/></d></b><b/><c/></a>"
    nodes = walk_xml(xml)
    assert len(nodes) == 7 and sorted(n[0] for n in nodes) == sorted(n[1] for n in nodes) == list(range(7))
    df = label_nodes(spark.createDataFrame([(1, xml)], "i long, x string"), "i", "x", above=["b", "d"])
    got = {r["pre"]: (r["up"].get("b"), r["up"].get("d")) for r in df.where("tag = 'c'").collect()}
    assert got == {2: (1, None), 4: (1, 3), 6: (None, None)}
    back = {r["pre"]: r["post"] for r in df.collect()}
    assert all((back[p] > back[q]) == (q in (2, 3, 4)) for p, q in ((1, 2), (1, 3), (1, 4), (1, 6)))


def test_refused_texts_are_listed(spark, tmp_path):
    bomb = "<!DOCTYPE a [<!ENTITY e0 'xxxxxxxxxx'>" + "".join(f"<!ENTITY e{i} '{f'&e{i - 1};' * 10}'>" for i in range(1, 10)) + "]>"
    xs = [
        (1, "<a><fileDscr ID='F1'/></a>"),
        (2, "<!DOCTYPE a [<!ENTITY x 'y'>]><a><fileDscr ID='F1'>&x;</fileDscr></a>"),
        (2, "<!DOCTYPE a [<!ENTITY x 'y'>]><a/>"),
        (3, "<!DOCTYPE a [<!ENTITY x 'y'>]><a><fileDscr ID='F1'></a>"),
        (4, "<!DOCTYPE a [<!ELEMENT a ANY>]><a/>"),
        (5, "<a><![CDATA[<!ENTITY x 'y'>]]></a>"),
        (6, bomb + "<a>&e9;</a>"),
        (7, bomb + "<a k='&e9;'/>"),
        (8, None),
        (None, bomb + "<a/>"),
    ]
    df = spark.createDataFrame(xs, "codebook_id long, ddi_xml string")
    assert sorted(r["doc"] for r in refused_texts(df, "codebook_id", "ddi_xml").collect()) == [6, 7]
    assert {r["codebook_id"] for r in codebook_links(df).collect()} == {1, 2}
    df.write.parquet(f"{tmp_path}/ddi_codebooks.parquet")
    assert sorted(r["codebook_id"] for r in QUERIES["p2_refused"](spark, str(tmp_path)).collect()) == [6, 7]


def test_tags_that_nest_in_themselves():
    """The nearest container of each tag against tree search, on random trees of few tags."""
    assert nearest_above(walk_xml("<r><sec n='1'><sec n='2'/><p/></sec></r>"), frozenset(["sec"]))[3] == {"sec": 1}
    r = random.Random(3)

    def grow(parent, depth):
        for _ in range(r.randrange(4) if depth < 6 else 0):
            grow(ET.SubElement(parent, r.choice("abc")), depth + 1)

    for _ in range(200):
        root = ET.Element("a")
        grow(root, 0)
        up = {c: p for p in root.iter() for c in p}
        order = {e: i for i, e in enumerate(root.iter())}
        want = []
        for e in root.iter():
            found, at = {}, up.get(e)
            while at is not None:
                found.setdefault(at.tag, order[at])
                at = up.get(at)
            want.append({t: i for t, i in found.items() if t in "ab"})
        assert nearest_above(walk_xml(ET.tostring(root, encoding="unicode")), frozenset("ab")) == want


def test_tables_against_another_reader(spark, tiny):
    """Files, variables and categories as another parser's tree gives them."""
    local = lambda e: e.tag.rpartition("}")[2]
    text = lambda e: (e.text or "").strip()
    files, variables, categories = set(), Counter(), Counter()
    for r in pq.read_table(f"{tiny}/ddi_codebooks.parquet").to_pylist():
        try:
            root = ET.fromstring(r["ddi_xml"])
        except (ET.ParseError, TypeError):
            continue
        last = {}
        for e in root.iter():
            if local(e) == "fileDscr":
                last[e.get("ID", "").strip()] = next((text(x) for x in e.iter() if local(x) == "caseQnty" and text(x)), "")
            if local(e) == "var":
                in_cat = {x for c in e.iter() if local(c) == "catgry" for x in c.iter()}
                label = next((text(x) for x in e.iter() if local(x) == "labl" and x not in in_cat), "")
                variables[(r["codebook_id"], e.get("ID", "").strip(), e.get("name", "").strip(), label, len(set(e.get("files", "").split())))] += 1
                categories.update((r["codebook_id"], e.get("ID", "").strip(), text(c)) for c in e.iter() if local(c) == "catValu")
        files |= {(r["codebook_id"], f, n) for f, n in last.items()}
    get = lambda q: Counter(tuple(x) for x in QUERIES[q](spark, tiny).collect())
    assert get("p2_files") == Counter(files) and get("p2_variables") == variables and get("p2_categories") == categories and categories
