"""Raw codebooks as related tables of files, variables and categories."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CELL_SPACE
from ..session import work_table
from .nested_records import map_documents, nearest_above

TAGS = ["fileDscr", "caseQnty", "var", "catgry", "catValu", "labl"]
_ABOVE = frozenset(("fileDscr", "var", "catgry"))
#: White space in an attribute that holds a list.
_LIST_SPACE = re.compile(r"[ \t\n\r]+")
_ROW = "kind string, pre int, id string, name string, value string, refs array<string>, known array<string>"
_COLUMNS = [("kind", pa.string()), ("pre", pa.int32()), ("id", pa.string()), ("name", pa.string()), ("value", pa.string()), ("refs", pa.list_(pa.string())), ("known", pa.list_(pa.string()))]


def _cell(text: str | None) -> str:
    return (text or "").strip(CELL_SPACE)


def codebook_rows(nodes: list[tuple]) -> Iterable[tuple]:
    """Files, variables and categories of one document, each a row (kind, pre, id, name, value, refs, known).

    A file's value is its case count, a variable's its label and a category's
    its value; a category's id is its variable's. refs are the files a
    variable names, known those of them that the document defines.
    """
    ups = nearest_above(nodes, _ABOVE)
    files: dict[str, int] = {}
    cases: dict[int, str] = {}
    labels: dict[int, str] = {}
    for i, ((_, _, _, tag, attrs, text), up) in enumerate(zip(nodes, ups)):
        if tag == "fileDscr":
            files[_cell(dict(attrs).get("ID"))] = i  # of one ID the last
        elif tag == "caseQnty" and "fileDscr" in up and (n := _cell(text)):
            cases.setdefault(up["fileDscr"], n)
        elif tag == "labl" and "var" in up and "catgry" not in up:
            labels.setdefault(up["var"], _cell(text))
    for fid, i in files.items():
        yield "file", nodes[i][0], fid, None, cases.get(i, ""), None, None
    known: dict[int, tuple[str, list[str]]] = {}
    for i, (pre, _, _, tag, attrs, text) in enumerate(nodes):
        if tag == "var":
            named = dict(attrs)
            refs = [f for f in dict.fromkeys(_LIST_SPACE.split(_cell(named.get("files")))) if f]
            known[i] = (_cell(named.get("ID")), [f for f in refs if f in files])
            yield "var", pre, known[i][0], _cell(named.get("name")), labels.get(i, ""), refs, known[i][1]
        elif tag == "catValu" and "var" in ups[i]:
            var_id, tied = known[ups[i]["var"]]
            yield "cat", pre, var_id, None, _cell(text), None, tied


def _rows(books: DataFrame, doc: str, xml: str) -> DataFrame:
    return map_documents(books, doc, xml, TAGS, codebook_rows, _COLUMNS, _ROW)


def codebook_tables(books: DataFrame, doc: str = "codebook_id", xml: str = "ddi_xml") -> dict[str, DataFrame]:
    """Flat tables files, variables and categories of every well-formed codebook.

    files: (doc, file_id, pre, cases); of definitions sharing an ID the last
    counts, cases is '' where it gives none. variables: (doc, var_id, pre,
    name, label, file_ids). categories: (doc, var_id, pre, value). Links to
    parents are interval containment; a caseQnty outside a fileDscr or a
    catValu outside a var belongs to nothing and is left out. Missing
    IDs are ''. Equal texts of one id count once.
    """
    rows = work_table(_rows(books, doc, xml), "codebook-rows")
    of = lambda kind, *cols: rows.where(F.col("kind") == kind).select("doc", "txt", "pre", *cols).distinct()
    return {
        "files": of("file", F.col("id").alias("file_id"), F.col("value").alias("cases")),
        "variables": of("var", F.col("id").alias("var_id"), "name", F.col("value").alias("label"), F.col("refs").alias("file_ids")),
        "categories": of("cat", F.col("id").alias("var_id"), "value"),
    }


def codebook_links(books: DataFrame, doc: str = "codebook_id", xml: str = "ddi_xml") -> DataFrame:
    """One row (codebook_id, level, parent_key, child_key) per file, case count, variable in a file, and category."""
    link = lambda level, parent, child: F.struct(F.lit(level).alias("level"), parent.alias("parent_key"), child.alias("child_key"))
    own, value, no = F.col("id"), F.col("value"), F.lit("")
    file = F.when(value == "", F.array(link("file", no, own))).otherwise(F.array(link("file", no, own), link("cases", own, value)))
    var = F.transform("known", lambda f: link("var", f, own))
    cat = F.when(F.size("known") > 0, F.array(link("cat", own, value)))
    links = F.when(F.col("kind") == "file", file).when(F.col("kind") == "var", var).otherwise(cat)
    return _rows(books, doc, xml).select(F.col("doc").alias("codebook_id"), F.inline(links)).distinct()
