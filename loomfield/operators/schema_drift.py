"""Schemas that drift: tree edit scripts between versions, compiled into projections.

A schema is a tree: groups (files, structs) above fields. A script makes the new
tree of the old one by adding, removing, renaming and moving nodes and by
changing types and widths, each at a cost. Sibling order is no edit. Nodes of
equal name under parents that stand for each other are the same node.

1. Groups. A top-down mapping of the trees (children are matched only where
   their parents are) of least cost is found from the leaves up: for each pair
   of groups that may stand for each other the least cost of making one of the
   other, for the groups below them by an assignment. A group renamed must keep
   a node. Groups left over that bear one name under different parents are moved,
   the largest saving first.
2. Fields. Given the groups, all fields left over are paired at once, by a flow
   of least cost: fields of one parent whose label words agree may be renamed,
   fields of equal name elsewhere moved, and a pair that also changes type or
   width costs more. Paths lead through nodes for equal type, equal width, both
   and neither, so the network grows with the fields and not with their pairs.

The pairing of fields is exact for the groups found, the mapping of groups is
exact among top-down mappings without moves.
"""

from __future__ import annotations

import json
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import words_of
from ..session import file_url, pick, work_table

#: Costs of the edit operations. Removing and adding cost more than renaming, so fields that may be renamed are.
COST = {"added": 1.0, "removed": 1.0, "renamed": 1.0, "moved": 1.5, "type": 0.25, "width": 0.25}
ROUND_BLOCK = 64
GROUP = "group"

Path = tuple[str, ...]


@dataclass(frozen=True)
class Leaf:
    """A field: its parent's path, name, label words ('' if none), type and width. As a node of a script also a group."""

    parent: Path
    name: str
    words: str = ""
    type: str = ""
    width: int | None = None
    pos: int = 0

    @property
    def path(self) -> Path:
        return (*self.parent, self.name)


@dataclass(frozen=True)
class Edit:
    op: str
    old: Leaf | None
    new: Leaf | None

    @property
    def cost(self) -> float:
        return COST[self.op]


@dataclass(frozen=True)
class Match:
    """Pairs (same, renamed or moved; old; new) of fields and of groups, and what is left on both sides."""

    fields: list[tuple[str, Leaf, Leaf]]
    gone: list[Leaf]
    come: list[Leaf]
    groups: list[tuple[str, Path, Path]]
    gone_groups: list[Path]
    come_groups: list[Path]


def _changed(a: Leaf, b: Leaf) -> float:
    return (a.type != b.type) * COST["type"] + (a.width != b.width) * COST["width"]


def best_assignment(saving: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of the greatest total saving; pairs that save nothing are left out. Shortest augmenting paths."""
    n = max(len(saving), len(saving[0]) if saving else 0)
    if not n:
        return []
    cost = [[-saving[i][j] if i < len(saving) and j < len(saving[0]) else 0.0 for j in range(n)] for i in range(n)]
    u, v, row_of = [0.0] * (n + 1), [0.0] * (n + 1), [n] * (n + 1)  # column n stands for the row being placed
    for i in range(n):
        row_of[n], at = i, n
        least, via, seen = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while row_of[at] != n or at == n:
            seen[at], r = True, row_of[at]
            step, to = float("inf"), -1
            for j in range(n):
                if not seen[j]:
                    if (c := cost[r][j] - u[r] - v[j]) < least[j]:
                        least[j], via[j] = c, at
                    if least[j] < step:
                        step, to = least[j], j
            for j in range(n + 1):
                if seen[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                elif j < n:
                    least[j] -= step
            at = to
        while at != n:
            row_of[at], at = row_of[via[at]], via[at]
    return sorted((row_of[j], j) for j in range(n) if row_of[j] < len(saving) and j < len(saving[0]) and saving[row_of[j]][j] > 0)


def pair_fields(gone: list[tuple[Leaf, Path | None]], come: list[Leaf], moves: bool) -> list[tuple[str, Leaf, Leaf]]:
    """The cheapest pairing of fields left over, as (renamed or moved, old, new).

    gone holds each old field with the path that stands for its parent in the
    new tree. Fields meet in classes, of one parent and words to be renamed, of
    one name to be moved. Classes that share no field are solved apart.
    """
    classes: dict[tuple, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
    for side, fields in enumerate(([(x, p) for x, p in gone], [(x, x.parent) for x in come])):
        for i, (x, parent) in enumerate(fields):
            if x.words and parent is not None:
                classes["renamed", parent, x.words][side].append(i)
            if moves:
                classes["moved", x.name][side].append(i)
    classes = {k: v for k, v in classes.items() if v[0] and v[1]}
    of_node: dict[tuple[int, int], list[tuple]] = defaultdict(list)
    for k, sides in classes.items():
        for side, members in enumerate(sides):
            for i in members:
                of_node[side, i].append(k)
    out, done = [], set()
    for k in classes:
        if k in done:
            continue
        todo, part = [k], []
        done.add(k)
        while todo:
            part.append(c := todo.pop())
            for side in (0, 1):
                for i in classes[c][side]:
                    for other in of_node[side, i]:
                        if other not in done:
                            done.add(other)
                            todo.append(other)
        if len(part) == 1 and len(classes[k][0]) == len(classes[k][1]) == 1:
            out.append((k[0], gone[classes[k][0][0]][0], come[classes[k][1][0]]))
        else:
            out += _flow([(c, *classes[c]) for c in part], [x for x, _ in gone], come)
    return out


def _flow(classes: list[tuple], gone: list[Leaf], come: list[Leaf]) -> list[tuple[str, Leaf, Leaf]]:
    """Pairs of least cost through the classes, by successive cheapest paths; a pair must not cost more than a removal and an addition."""
    ends: list[int] = []  # edges in pairs: 2e forward, 2e + 1 back
    cost: list[float] = []
    room: list[int] = []
    out_of: dict[object, list[int]] = defaultdict(list)
    nodes: list[object] = []
    number: dict[object, int] = {}

    def node(x: object) -> int:
        if x not in number:
            number[x] = len(nodes)
            nodes.append(x)
        return number[x]

    def edge(a: object, b: object, c: float, cap: int) -> None:
        for x, y, w, r in ((a, b, c, cap), (b, a, -c, 0)):
            out_of[node(x)].append(len(ends))
            ends.append(node(y))
            cost.append(w)
            room.append(r)

    t, w = COST["type"], COST["width"]
    source, sink = node("source"), node("sink")
    for i in sorted({i for _, g, _ in classes for i in g}):
        edge("source", ("gone", i), 0.0, 1)
    for j in sorted({j for _, _, c in classes for j in c}):
        edge(("come", j), "sink", 0.0, 1)
    for k, g, c in classes:
        likes = lambda x: (((k, "both", x.type, x.width), 0.0), ((k, "type", x.type), w), ((k, "width", x.width), t), ((k, "any"), t + w))  # noqa: B023, E731
        there = {n for j in c for n, _ in likes(come[j])}
        for i in g:
            for n, more in likes(gone[i]):
                if n in there:
                    edge(("gone", i), n, COST[k[0]] + more, 1)
        for j in c:
            for n, _ in likes(come[j]):
                edge(n, ("come", j), 0.0, 1)
    while True:
        dist, via = {source: 0.0}, {}
        queue, queued = deque([source]), {source}
        while queue:
            x = queue.popleft()
            queued.discard(x)
            for e in out_of[x]:
                y = ends[e]
                if room[e] and dist[x] + cost[e] < dist.get(y, float("inf")):
                    dist[y], via[y] = dist[x] + cost[e], e
                    if y not in queued:
                        queued.add(y)
                        queue.append(y)
        if dist.get(sink, float("inf")) > COST["added"] + COST["removed"]:
            break
        x = sink
        while x != source:
            e = via[x]
            room[e] -= 1
            room[e ^ 1] += 1
            x = ends[e ^ 1]
    # what flows in and out of each class node is paired in order of position
    into: dict[int, list[int]] = defaultdict(list)
    outof: dict[int, list[int]] = defaultdict(list)
    for x, es in out_of.items():
        for e in es:
            if e % 2 == 0 and room[e ^ 1]:
                a, b = nodes[x], nodes[ends[e]]
                if a[0] == "gone":
                    into[ends[e]].append(a[1])
                elif b[0] == "come":
                    outof[x].append(b[1])
    return [(nodes[n][0][0], gone[i], come[j]) for n, g in into.items() for i, j in zip(sorted(g), sorted(outof[n]))]


def _first_of_each(leaves: list[Leaf]) -> dict[Path, Leaf]:
    out: dict[Path, Leaf] = {}
    for leaf in sorted(leaves, key=lambda x: (x.pos, x.name)):
        out.setdefault(leaf.path, leaf)
    return out


def _inner(leaves: dict[Path, Leaf]) -> dict[Path, tuple[list[Leaf], list[Path]]]:
    """path of each group -> its fields and the groups directly in it."""
    out: dict[Path, tuple[list[Leaf], list[Path]]] = {(): ([], [])}
    for leaf in leaves.values():
        for n in range(1, len(leaf.parent) + 1):
            p = leaf.parent[:n]
            if p not in out:
                out[p] = ([], [])
                out[p[:-1]][1].append(p)
        out[leaf.parent][0].append(leaf)
    return out


def _map_groups(old: dict, new: dict, moves: bool) -> dict[Path, tuple[str, Path]]:
    """old group -> (same, renamed or moved; new group)."""
    if not moves:
        return {p: ("same", p) for p in old if p in new}

    @lru_cache(maxsize=None)
    def size(tree: int, p: Path) -> int:
        fields, groups = (old, new)[tree][p]
        return 1 + len(fields) + sum(size(tree, g) for g in groups)

    @lru_cache(maxsize=None)
    def inside(g: Path, h: Path) -> tuple[float, int, tuple]:
        """(cost of making h of g, nodes kept, pairs of groups below)."""
        (fa, ga), (fb, gb) = old[g], new[h]
        by_name = {x.name: x for x in fb}
        same = [(x, by_name[x.name]) for x in fa if x.name in by_name]
        kept = {x.name for x, _ in same}
        gone, come = [(x, h) for x in fa if x.name not in kept], [x for x in fb if x.name not in kept]
        pairs = pair_fields(gone, come, False)
        cost = sum(_changed(a, b) for a, b in same) + sum(COST[op] + _changed(a, b) for op, a, b in pairs)
        cost += (len(gone) - len(pairs)) * COST["removed"] + (len(come) - len(pairs)) * COST["added"]
        n, below = len(same) + len(pairs), []
        names = {q[-1]: q for q in gb}
        for p in ga:
            if p[-1] in names:
                c, k, _ = inside(p, names[p[-1]])
                cost, n = cost + c, n + 1 + k
                below.append(("same", p, names[p[-1]]))
        taken = {x for _, p, q in below for x in ((0, p), (1, q))}
        rest_a, rest_b = [p for p in ga if (0, p) not in taken], [q for q in gb if (1, q) not in taken]
        cost += sum(size(0, p) * COST["removed"] for p in rest_a) + sum(size(1, q) * COST["added"] for q in rest_b)
        saving = [[_saving(p, q, "renamed") for q in rest_b] for p in rest_a]
        for i, j in best_assignment(saving):
            cost, n = cost - saving[i][j], n + 1 + inside(rest_a[i], rest_b[j])[1]
            below.append(("renamed", rest_a[i], rest_b[j]))
        return cost, n, tuple(below)

    def _saving(p: Path, q: Path, op: str) -> float:
        cost, kept, _ = inside(p, q)
        return max(0.0, size(0, p) * COST["removed"] + size(1, q) * COST["added"] - COST[op] - cost) if kept else 0.0

    out: dict[Path, tuple[str, Path]] = {}
    used: set[Path] = set()

    def settle(op: str, p: Path, q: Path) -> None:
        if p not in out and q not in used:
            out[p] = (op, q)
            used.add(q)
            for pair in inside(p, q)[2]:
                settle(*pair)

    settle("same", (), ())
    while True:
        names = defaultdict(list)
        for q in new:
            if q not in used:
                names[q[-1]].append(q)
        best = max(((_saving(p, q, "moved"), p, q) for p in old if p not in out for q in names[p[-1]]), default=(0.0, (), ()))
        if best[0] <= 0:
            return out
        settle("moved", *best[1:])


def match_trees(old: list[Leaf], new: list[Leaf], moves: bool = True) -> Match:
    """Which node of the new tree each of the old tree becomes. Fields repeated in a parent count once (the first by position)."""
    a, b = _first_of_each(old), _first_of_each(new)
    ta, tb = _inner(a), _inner(b)
    groups = _map_groups(ta, tb, moves)
    pairs, gone, left = [], [], dict(b)
    for x in a.values():
        parent = groups.get(x.parent, (None, None))[1]
        twin = None if parent is None else left.pop((*parent, x.name), None)
        if twin is not None:
            pairs.append(("same", x, twin))
        else:
            gone.append((x, parent))
    found = pair_fields(gone, list(left.values()), moves)
    lost, won = {x.path for _, x, _ in found}, {y.path for _, _, y in found}
    taken = {q for _, q in groups.values()}
    return Match(
        pairs + found, [x for x, _ in gone if x.path not in lost], [y for y in left.values() if y.path not in won],
        [(op, p, q) for p, (op, q) in groups.items() if p], [p for p in ta if p not in groups], [q for q in tb if q not in taken],
    )


def edit_script(old: list[Leaf], new: list[Leaf], moves: bool = True) -> list[Edit]:
    """The script that makes the new tree of the old one, at the least cost in the sense stated above.

    renamed pairs fields of one parent whose label words agree, or groups that
    keep a node; moved pairs nodes of equal name under different parents; each
    pair of fields may also bring type and width edits. Without moves nothing
    leaves its parent, and groups are only places: none is renamed, added or
    removed itself.
    """
    m = match_trees(old, new, moves)
    out = []
    for op, a, b in m.fields:
        if op != "same":
            out.append(Edit(op, a, b))
        if a.type != b.type:
            out.append(Edit("type", a, b))
        if a.width != b.width:
            out.append(Edit("width", a, b))
    if moves:
        node = lambda p: Leaf(p[:-1], p[-1], type=GROUP)
        out += [Edit(op, node(p), node(q)) for op, p, q in m.groups if op != "same"]
        out += [Edit("removed", node(p), None) for p in m.gone_groups] + [Edit("added", None, node(q)) for q in m.come_groups]
    return out + [Edit("removed", a, None) for a in m.gone] + [Edit("added", None, b) for b in m.come]


def edit_distance(old: list[Leaf], new: list[Leaf], moves: bool = True) -> float:
    return sum(e.cost for e in edit_script(old, new, moves))


# --- versions of a catalogue, as rows ---------------------------------------------------------


def field_type(c: Column) -> Column:
    """numeric or character, whatever the spelling; null means character."""
    t = F.lower(F.btrim(F.coalesce(c, F.lit("character")), F.lit(" \t\n\r")))
    return F.when(t == "num", "numeric").when(t.isin("char", ""), "character").otherwise(t)


def neighbours_in_order(df: DataFrame, key: str, order: str, *extra: str, block: int = ROUND_BLOCK) -> DataFrame:
    """df, whose (key, order) are distinct, with prev and next, the orders of that key before and behind (null at the ends).

    Done in two levels: within blocks of the order, then between the blocks'
    ends, so no task sees more than a block of a hot key or its block ends.
    """
    slim = df.select(key, order, *extra).withColumn("_b", F.floor(F.col(order) / block))
    by = Window.partitionBy(key, "_b").orderBy(order)
    inside = slim.withColumn("prev", F.lag(order).over(by)).withColumn("next", F.lead(order).over(by))
    ends = slim.groupBy(key, "_b").agg(F.min(order).alias("_low"), F.max(order).alias("_top"))
    far = Window.partitionBy(key).orderBy("_b")
    ends = ends.select(key, "_b", F.lag("_top").over(far).alias("_up"), F.lead("_low").over(far).alias("_down"))
    return inside.join(ends, [key, "_b"]).select(key, order, *extra, F.coalesce("prev", "_up").alias("prev"), F.coalesce("next", "_down").alias("next"))


_CATALOGUE = ("series_id", "round_no", "delivery_id", "fid", "ddi_pos", "name", "label", "type", "ddi_width", "loaded_at")


def latest_versions(variables: DataFrame) -> DataFrame:
    """One row (series_id, round_no, delivery_id) per round: the delivery loaded last, then the larger id."""
    per = variables.groupBy("series_id", "round_no", "delivery_id").agg(F.max("loaded_at").alias("at"))
    return per.groupBy("series_id", "round_no").agg(F.max(F.struct("at", "delivery_id"))["delivery_id"].alias("delivery_id"))


def _delivered(variables: DataFrame) -> DataFrame:
    """Fields of the rounds' deliveries that count: (series_id, round_no, prev, next, fid, name, f), repeated rows still repeated."""
    v = pick(variables, *_CATALOGUE).where("series_id is not null and round_no is not null and name is not null")
    rounds = neighbours_in_order(latest_versions(v), "series_id", "round_no", "delivery_id")
    field = F.struct(F.coalesce("ddi_pos", F.lit(0)).alias("pos"), F.col("label").alias("label"), field_type(F.col("type")).alias("type"), F.col("ddi_width").alias("width"))
    slim = v.select("series_id", "round_no", "delivery_id", F.coalesce("fid", F.lit("")).alias("fid"), "name", field.alias("f"))
    return slim.join(rounds, ["series_id", "round_no", "delivery_id"]).drop("delivery_id")


_EDITS = "series_id long, fid string, round_no int, change string, name string, old_name string, old_fid string"


def _scripts(moves: bool):
    names = [c.split()[0] for c in _EDITS.split(", ")]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()))))
    leaf = lambda x, f: Leaf((x["fid"],), x["name"], f["words"], f["type"], f["width"], f["pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for series, rnd, fields in zip(*(b[c].to_pylist() for c in ("series_id", "round_no", "fields"))):
                old = [leaf(x, x["old"]) for x in fields if x["old"] is not None]
                new = [leaf(x, x["new"]) for x in fields if x["new"] is not None]
                for e in edit_script(old, new, moves):
                    at, was = e.new or e.old, e.old or e.new
                    for c, x in zip(cols, (series, at.parent[-1] if at.parent else "", rnd, e.op, at.name, was.name, was.parent[-1] if was.parent else "")):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def schema_changes(variables: DataFrame, moves: bool = False) -> DataFrame:
    """Edits (series_id, fid, round_no, change, name, old_name, old_fid) of each round against the one delivered before.

    A tree is one delivered codebook: files above fields. Each field stands
    beside its namesake of the round before, and those that are alike, which no
    script would touch, leave before the scripts are sought. Rows without
    series, round or name are no fields. Repeated rows count once; a first
    round has no edits; an empty catalogue gives none.
    """
    none = F.lit(None).cast("struct<pos:int,label:string,type:string,width:int>")
    as_new = F.struct(F.when(F.col("prev").isNotNull(), F.col("round_no")).alias("at"), F.col("f").alias("new"), none.alias("old"))
    both = F.array(as_new, F.struct(F.col("next").alias("at"), none.alias("new"), F.col("f").alias("old")))
    rows = _delivered(variables).select("series_id", "fid", "name", F.inline(F.filter(both, lambda x: x["at"].isNotNull())))
    fields = rows.groupBy("series_id", "at", "fid", "name").agg(F.min("new").alias("new"), F.min("old").alias("old"))
    alike = F.coalesce((F.col("new.type") == F.col("old.type")) & F.col("new.width").eqNullSafe(F.col("old.width")), F.lit(False))
    worded = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.pos").alias("pos"), words_of(F.col(f"{c}.label")).alias("words"), F.col(f"{c}.type").alias("type"), F.col(f"{c}.width").alias("width"))).alias(c)
    changed = fields.where(~alike).select("series_id", "at", "fid", "name", worded("new"), worded("old"))
    trees = changed.groupBy("series_id", F.col("at").alias("round_no")).agg(F.sort_array(F.collect_list(F.struct("fid", "name", "new", "old"))).alias("fields"))
    return trees.mapInArrow(_scripts(moves), _EDITS)


def unified_variables(variables: DataFrame) -> DataFrame:
    """One consistent table over all rounds: (series_id, fid, round_no, name, variable, type, width, unified_type, unified_width).

    Each delivered field follows its edit scripts to the last name it bears:
    variable. A field that vanishes and comes back under that name is the same
    variable. unified_type is numeric only if it always is, unified_width the
    largest. Names are followed by doubling, so a chain over n rounds takes
    log n joins, none of which gathers a series in one task.
    """
    key = ["series_id", "fid", "round_no", "name"]
    fields = work_table(_delivered(variables).groupBy(*key).agg(F.min("f").alias("f"), F.max("prev").alias("prev")), "fields")
    renamed = schema_changes(variables).where("change = 'renamed'").select("series_id", "fid", "round_no", "name", "old_name")
    now = fields.select(*key, "prev").where("prev is not null").join(renamed, key, "left")
    was = now.select("series_id", "fid", F.col("prev").alias("round_no"), F.coalesce("old_name", "name").alias("name"), F.col("round_no").alias("to_round"), F.col("name").alias("to_name"))
    step = work_table(fields.select(*key).join(was, key, "left").select(*key, F.coalesce("to_round", "round_no").alias("to_round"), F.coalesce("to_name", "name").alias("to_name")), "steps")
    while True:
        onward = step.select("series_id", "fid", F.col("round_no").alias("to_round"), F.col("name").alias("to_name"), F.col("to_round").alias("far_round"), F.col("to_name").alias("far_name"))
        far = work_table(step.join(onward, ["series_id", "fid", "to_round", "to_name"]), "steps")
        moved = far.where("far_round != to_round").limit(1).count()
        step = far.select(*key, F.col("far_round").alias("to_round"), F.col("far_name").alias("to_name"))
        if not moved:
            break
    out = fields.join(step, key).select(*key, F.col("to_name").alias("variable"), F.col("f.type").alias("type"), F.col("f.width").alias("width"))
    numeric = F.min((F.col("type") == "numeric").cast("int")) == 1
    whole = out.groupBy("series_id", "fid", "variable").agg(F.when(numeric, "numeric").otherwise("character").alias("unified_type"), F.max("width").alias("unified_width"))
    return out.join(whole, ["series_id", "fid", "variable"])


# --- files with differing schemas ---------------------------------------------------------------


def _leaves_of(schema: T.StructType, parent: Path = ()) -> list[Leaf]:
    out = []
    for i, f in enumerate(schema.fields):
        if isinstance(f.dataType, T.StructType) and f.dataType.fields:
            out += _leaves_of(f.dataType, (*parent, f.name))
        else:
            words = " ".join("".join(ch if ch.isalnum() else " " for ch in (f.metadata or {}).get("label", "").lower()).split())
            out.append(Leaf(parent, f.name, words, f.dataType.simpleString(), None, i))
    return out


_WIDER = ["boolean", "tinyint", "smallint", "int", "bigint", "float", "double"]


def wider_type(a: str, b: str) -> str:
    """The narrowest type that holds both; text if nothing else does."""
    if a == b:
        return a
    if a in _WIDER[1:] and b in _WIDER[1:]:
        w = max(a, b, key=_WIDER.index)
        return "double" if w == "float" and "bigint" in (a, b) or w == "float" and "int" in (a, b) else w
    if {a, b} == {"date", "timestamp"}:
        return "timestamp"
    return "string"


@dataclass(frozen=True)
class UnifiedSchema:
    """Target fields (path in the latest version that has them, type, column name) and, per version, the source path of each target."""

    fields: list[tuple[Path, str, str]]
    sources: list[dict[Path, Path]]


def _column_names(paths: list[Path]) -> list[str]:
    """Paths joined by underscores; where two come out alike, even but for case, the later ones get a number."""
    out, seen = [], set()
    for p in paths:
        base = name = "_".join(p)
        n = 1
        while name.lower() in seen:
            n += 1
            name = f"{base}_{n}"
        seen.add(name.lower())
        out.append(name)
    return out


def unify_schemas(versions: list[T.StructType], moves: bool = True) -> tuple[UnifiedSchema, list[list[Edit]]]:
    """Chain the edit scripts of consecutive versions into one target schema and per-version source paths."""
    trees = [_leaves_of(v) for v in versions]
    ids: list[dict[Path, int]] = [{x.path: i for i, x in enumerate(trees[0])}] if trees else []
    names, types = ([x.path for x in trees[0]], [x.type for x in trees[0]]) if trees else ([], [])
    scripts = []
    for old, new in zip(trees, trees[1:]):
        scripts.append(edit_script(old, new, moves))
        came = {b.path: a.path for _, a, b in match_trees(old, new, moves).fields}
        now = {b: ids[-1][a] for b, a in came.items()}
        taken = set(now.values())
        for leaf in new:
            i = now.get(leaf.path)
            if i is None:  # a field that comes back under its old path is the same field
                i = next((k for k in reversed(range(len(names))) if names[k] == leaf.path and k not in taken), None)
            if i is None:
                names.append(leaf.path)
                types.append(leaf.type)
                i = len(names) - 1
            taken.add(i)
            names[i], types[i] = leaf.path, wider_type(types[i], leaf.type)
            now[leaf.path] = i
        ids.append(now)
    columns = _column_names(names)
    return UnifiedSchema(list(zip(names, types, columns)), [{i: p for p, i in m.items()} for m in ids]), scripts


def compile_projection(target: UnifiedSchema, version: int) -> list[Column]:
    """The projection that brings a file of that version to the target; absent fields are null.

    Target columns are flat; a nested field's path is joined by underscores.
    """
    src = target.sources[version]
    quote = lambda p: ".".join("`" + s.replace("`", "``") + "`" for s in p)
    return [(F.col(quote(src[i])) if i in src else F.lit(None)).cast(kind).alias(name) for i, (_, kind, name) in enumerate(target.fields)]


def _footers(spark: SparkSession, files: list[str]) -> list[str]:
    """A text that tells each file's schema, read from the files' ends in the cluster."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        for b in batches:
            texts = []
            for f in b["file"].to_pylist():
                where, path = fs.FileSystem.from_uri(f)
                if where.get_file_info(path).type == fs.FileType.Directory:
                    inside = sorted(x.path for x in where.get_file_info(fs.FileSelector(path, recursive=True)) if x.is_file and not x.base_name.startswith(("_", ".")))
                    path = inside[0]
                schema = pq.read_schema(where.open_input_file(path))
                meta = schema.metadata or {}
                texts.append(json.dumps([schema.remove_metadata().to_string(), meta.get(b"org.apache.spark.sql.parquet.row.metadata", b"").decode()]))
            yield pa.RecordBatch.from_arrays([b["at"], pa.array(texts, pa.string())], names=["at", "text"])

    urls = [f if "://" in f else file_url(f) for f in files]
    rows = spark.createDataFrame(list(enumerate(urls)), "at long, file string")
    parts = max(1, min(len(files), spark.sparkContext.defaultParallelism))
    return [r["text"] for r in rows.repartition(parts).mapInArrow(look, "at long, text string").orderBy("at").collect()]  # one row per file given


def read_unified(spark: SparkSession, files: list[str], moves: bool = True) -> tuple[DataFrame, list[list[Edit]]]:
    """All Parquet files, given in order of time, as one table, with the script between each two versions.

    Schemas are told apart by the files' ends, read in the cluster; only one
    file of each is opened here. Files that get the same projection are read in
    one scan, whatever lies between them in time; every scan selects just the
    target's fields, so pruning and pushdown reach the files.
    """
    texts = _footers(spark, files)
    known: dict[str, T.StructType] = {}
    for t, f in zip(texts, files):
        if t not in known:
            known[t] = spark.read.parquet(f).schema
    runs: list[tuple[T.StructType, list[str]]] = []
    for t, f in zip(texts, files):
        if runs and runs[-1][0] == known[t]:
            runs[-1][1].append(f)
        else:
            runs.append((known[t], [f]))
    target, scripts = unify_schemas([s for s, _ in runs], moves)
    scans: dict[tuple, tuple[int, list[str]]] = {}
    for i, (s, fs) in enumerate(runs):
        scans.setdefault((s.json(), tuple(sorted(target.sources[i].items()))), (i, []))[1].extend(fs)
    out = None
    for i, fs in scans.values():
        one = spark.read.schema(runs[i][0]).parquet(*fs).select(*compile_projection(target, i))
        out = one if out is None else out.unionByName(one)
    return out, scripts
