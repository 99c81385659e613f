"""Deeply nested records as flat tables, linked by interval labels.

A depth-first walk gives each node a pre-order and a post-order number. Node a
lies above node b exactly when pre(a) < pre(b) and post(a) > post(b), so links
between any two levels come from the labels alone, whatever lies between them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import pick, spread

_NODES = "pre int, post int, depth int, tag string, attrs map<string,string>, value string, up map<string,int>"
_COLUMNS = [
    ("pre", pa.int32()), ("post", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())), ("value", pa.string()), ("up", pa.map_(pa.string(), pa.int32())),
]
_BATCH = 50_000


class _Walk:
    """Depth-first walk of one XML text; keeps nodes of the wanted tags, numbers all."""

    def __init__(self, keep: frozenset[str] | None):
        self.keep = keep
        self.nodes: list[tuple] = []
        self.open: list[list] = []
        self.pre = self.post = 0

    def start(self, name: str, attrs: dict) -> None:
        if self.open:
            self.open[-1][4] = True  # own text is what comes before the first child
        self.open.append([self.pre, name.rpartition(" ")[2], attrs, [], False])
        self.pre += 1

    def text(self, data: str) -> None:
        node = self.open[-1]
        if not node[4]:
            node[3].append(data)

    def end(self, _: str) -> None:
        pre, tag, attrs, text, _seen = self.open.pop()
        if self.keep is None or tag in self.keep:
            named = {k.rpartition(" ")[2]: v for k, v in attrs.items()}
            self.nodes.append((pre, self.post, len(self.open), tag, list(named.items()), "".join(text)))
        self.post += 1


def read_xml(text: str, keep: frozenset[str] | None = None) -> tuple[list[tuple] | None, bool]:
    """((pre, post, depth, tag, attributes, own text) of each kept node in order of pre, None if not well-formed; whether a limit was met).

    Names lose their namespace. Entities that a document declares are put in,
    up to the parser's own limit: none before eight million characters, beyond
    them a hundred times the document's size. A document past it gives None.
    Nothing outside the document is ever read.
    """
    w = _Walk(keep)
    p = expat.ParserCreate("utf-8", namespace_separator=" ")
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = w.start, w.end, w.text
    try:
        p.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError as e:
        return None, e.code == expat.errors.codes[expat.errors.XML_ERROR_AMPLIFICATION_LIMIT_BREACH]
    w.nodes.sort()
    return w.nodes, False


def walk_xml(text: str, keep: frozenset[str] | None = None) -> list[tuple] | None:
    return read_xml(text, keep)[0]


def _texts(df: DataFrame, doc: str, xml: str) -> DataFrame:
    """(doc, txt, xml): the texts with an id; txt tells texts of one id apart."""
    df = pick(df, doc, xml)
    out = df.select(df[doc].cast("long").alias("doc"), F.xxhash64(df[xml]).alias("txt"), df[xml].alias("xml"))
    return out.where("doc is not null and xml is not null")


def refused_texts(df: DataFrame, doc: str, xml: str) -> DataFrame:
    """(doc) once for each id with a text whose entities grow beyond the parser's limit; only these well-formed texts give no nodes."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [d for d, text in zip(b["doc"].to_pylist(), b["xml"]) if read_xml(text.as_py(), frozenset())[1]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["doc"])

    return spread(_texts(df, doc, xml).where(F.contains("xml", F.lit("<!ENTITY")))).mapInArrow(look, "doc long").distinct()


def nearest_above(nodes: list[tuple], above: frozenset[str]) -> list[dict[str, int]]:
    """For each node, in order of pre: tag -> place in nodes of the nearest node of that tag that contains it.

    Going by pre, a node can only lie in nodes opened before it, and it lies
    in those whose post is larger. Per tag the nodes still open form a stack;
    what is left of it after the closed ones are dropped ends with the nearest,
    also where a tag nests in itself. Each node is put on and taken off once.
    """
    stacks: dict[str, list[tuple[int, int]]] = {t: [] for t in above}
    out = []
    for i, (_, post, _, tag, _, _) in enumerate(nodes):
        up = {}
        for t, s in stacks.items():
            while s and s[-1][0] < post:
                s.pop()
            if s:
                up[t] = s[-1][1]
        out.append(up)
        if tag in stacks:
            stacks[tag].append((post, i))
    return out


def map_documents(df: DataFrame, doc: str, xml: str, keep: list[str] | None, rows_of: Callable[[list[tuple]], Iterable[tuple]], columns: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """Rows (doc, txt, columns…) that rows_of makes of the labelled nodes of each well-formed text.

    All nodes of a document are in the task that walked it, so links between
    them need no shuffle. Null, empty and damaged texts give no rows, a null id
    gives none either.
    """
    wanted = frozenset(keep) if keep is not None else None
    schema = pa.schema([("doc", pa.int64()), ("txt", pa.int64()), *columns])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for doc_id, h, text in zip(b["doc"].to_pylist(), b["txt"].to_pylist(), b["xml"]):
                for row in rows_of(walk_xml(text.as_py(), wanted) or []):
                    rows.append((doc_id, h, *row))
                    if len(rows) >= _BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    return spread(_texts(df, doc, xml)).mapInArrow(run, "doc long, txt long, " + ddl)


def label_nodes(df: DataFrame, doc: str, xml: str, keep: list[str] | None = None, above: list[str] = ()) -> DataFrame:
    """The node table (doc, txt, pre, post, depth, tag, attrs, value, up) of every well-formed XML text.

    up gives, for each tag in above, the pre of the nearest node of that tag
    that contains the node; a tag is absent where none does. keep limits the
    table to some tags, which must hold those in above; numbering covers all
    nodes. A text repeated in a row gives its nodes again.
    """
    tags = frozenset(above)

    def rows_of(nodes: list[tuple]) -> Iterable[tuple]:
        for n, up in zip(nodes, nearest_above(nodes, tags)):
            yield (*n, [(t, nodes[i][0]) for t, i in up.items()])

    return map_documents(df, doc, xml, keep, rows_of, _COLUMNS, _NODES)
