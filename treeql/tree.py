"""Trees: the `nodes` schema and its in-process form.

A document's tree is a set of rows in preorder. `last_desc` makes "below" an interval test, `named_index` and `child_index` give positions among siblings.
"""

from __future__ import annotations

import gc
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("node_id", T.IntegerType()), T.StructField("parent_id", T.IntegerType()),
        T.StructField("child_index", T.IntegerType()), T.StructField("named_index", T.IntegerType()), T.StructField("depth", T.IntegerType()),
        T.StructField("last_desc", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("is_named", T.BooleanType()),
        T.StructField("is_extra", T.BooleanType()), T.StructField("is_missing", T.BooleanType()), T.StructField("is_error", T.BooleanType()),
        T.StructField("has_error", T.BooleanType()), T.StructField("field", T.StringType()), T.StructField("start_byte", T.IntegerType()),
        T.StructField("end_byte", T.IntegerType()), T.StructField("start_row", T.IntegerType()), T.StructField("start_col", T.IntegerType()),
        T.StructField("end_row", T.IntegerType()), T.StructField("end_col", T.IntegerType()), T.StructField("child_count", T.IntegerType()),
        T.StructField("named_child_count", T.IntegerType()), T.StructField("text", T.StringType()),
    ]
)
ARROW = pa.schema([(f.name, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.simpleString()]) for f in NODES.fields])
DDL = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODES.fields)


@contextmanager
def uncollected():
    """Without the cyclic collector, which would visit all nodes of a growing tree again and again; what is dropped meanwhile waits for its next run."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@contextmanager
def collected_by_hand():
    """Yields a function to tell how many nodes were made and dropped: the cyclic collector, which trees need as parents and children hold each other, runs after so many of them only,
    and not whenever rows that wait for output have grown."""
    made = 0

    def tell(n: int) -> None:
        nonlocal made
        made += n
        if made >= 100_000:
            made = 0
            gc.collect()

    with uncollected():
        yield tell


class Node:
    """A node under construction or in use; `parent` and `index` are set by `Tree`. What most nodes have alike stands in the class."""

    extra = missing = error = False
    field: str | None = None
    text_: str | None = None
    parent: "Node | None" = None
    index = named_index = id = -1

    def __init__(self, type_: str, named: bool = True, start: int = 0, end: int = 0, children: Iterable["Node"] = (), field: str | None = None, *, extra=False, missing=False, error=False, text: str | None = None):
        self.type, self.named, self.start, self.end = type_, named, start, end
        self.children = children if type(children) is list else list(children)
        if field is not None:
            self.field = field
        if extra:
            self.extra = True
        if missing:
            self.missing = True
        if error:
            self.error = True
        if text is not None:
            self.text_ = text

    def child_by_field(self, name: str) -> "Node | None":
        return next((c for c in self.children if c.field == name), None)

    def named_children(self) -> list["Node"]:
        return [c for c in self.children if c.named]

    def walk(self) -> Iterator["Node"]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def ancestors(self) -> Iterator["Node"]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    @property
    def has_error(self) -> bool:
        return any(n.error or n.missing for n in self.walk())

    def sexpr(self) -> str:
        """Named nodes only; what stands below an anonymous node goes with it."""
        out, stack = [], [(self, False)]
        while stack:
            node, closing = stack.pop()
            if closing:
                out.append(")")
            elif node.named:
                out.append((" (" if out else "(") + ("MISSING " if node.missing else "") + node.type)
                stack.append((node, True))
                stack.extend((c, False) for c in reversed(node.children))
        return "".join(out)


class Tree:
    """A tree over its text. Numbers, parents and indexes of nodes are set when `root` or `nodes` is first asked for; `rows` does without."""

    def __init__(self, root: Node, source: bytes = b""):
        self._root, self.source, self.stop_reason = root, source, "accepted"
        self._nodes: list[Node] | None = None

    @property
    def root(self) -> Node:
        if self._nodes is None:
            self._number()
        return self._root

    @property
    def top(self) -> Node:
        """The root as it is, numbered or not."""
        return self._root

    @property
    def nodes(self) -> list[Node]:
        if self._nodes is None:
            self._number()
        return self._nodes

    @property
    def has_error(self) -> bool:
        return self._root.has_error

    def _number(self) -> None:
        self._nodes = found = []
        self._root.parent = None
        for node in self._root.walk():
            node.id = len(found)
            found.append(node)
            named = 0
            for i, c in enumerate(node.children):
                c.parent, c.index = node, i
                c.named_index = named if c.named else -1
                named += c.named

    def text(self, node: Node) -> str:
        if node.text_ is not None:
            return node.text_
        if node.end > len(self.source) or node.start > node.end:
            return ""
        return self.source[node.start : node.end].decode("utf-8", "replace")

    def line_starts(self) -> list[int]:
        out, at = [0], self.source.find(b"\n")
        while at >= 0:
            out.append(at + 1)
            at = self.source.find(b"\n", at + 1)
        return out

    def rows(self, doc_id: int) -> list[tuple]:
        """Rows of `NODES`."""
        with uncollected():
            return self._rows(doc_id)

    def _rows(self, doc_id: int) -> list[tuple]:
        lines, source = self.line_starts(), self.source
        one_line, size = len(lines) == 1, len(self.source)
        # the nodes in preorder, each with its parent's number, its places among all and among named siblings, and its depth
        order, stack = [], [(self._root, None, 0, None, 0)]
        counts = []
        while stack:
            at = stack.pop()
            node, depth, number = at[0], at[4] + 1, len(order)
            order.append(at)
            named = 0
            if node.children:
                below = []
                for i, c in enumerate(node.children):
                    if c.named:
                        below.append((c, number, i, named, depth))
                        named += 1
                    else:
                        below.append((c, number, i, None, depth))
                below.reverse()
                stack += below
            counts.append(named)
        last, errors = list(range(len(order))), [n[0].error or n[0].missing for n in order]
        for k in range(len(order) - 1, 0, -1):
            up = order[k][1]
            if last[k] > last[up]:
                last[up] = last[k]
            if errors[k]:
                errors[up] = True
        out = []
        for k, (n, up, index, named_index, depth) in enumerate(order):
            start, end = n.start, n.end
            if one_line:
                r0 = r1 = c0 = c1 = 0
            else:
                r0, r1 = bisect_right(lines, start) - 1, bisect_right(lines, end) - 1
                c0, c1 = lines[r0], lines[r1]
            if n.children:
                text = None
            elif n.text_ is not None:
                text = n.text_
            else:
                text = source[start:end].decode("utf-8", "replace") if start <= end <= size else ""
            out.append((doc_id, k, up, index, named_index, depth, last[k], n.type, n.named, n.extra, n.missing, n.error, errors[k], n.field, start, end, r0, start - c0, r1, end - c1, len(n.children), counts[k], text))
        return out


def from_rows(rows: Iterable[dict]) -> Tree:
    """The tree of one document from rows of `NODES` (or a subset of its columns) in any order."""
    rows = sorted(rows, key=lambda r: r["node_id"])
    made: dict[int, Node] = {}
    root = None
    for r in rows:
        node = Node(r["type"], r.get("is_named", True), r.get("start_byte") or 0, r.get("end_byte") or 0, field=r.get("field"), extra=bool(r.get("is_extra")), missing=bool(r.get("is_missing")), error=bool(r.get("is_error")), text=r.get("text"))
        made[r["node_id"]] = node
        if r["parent_id"] is None:
            root = node
        else:
            made[r["parent_id"]].children.append(node)
    return Tree(root)


def from_columns(node_id, parent_id, type_, is_named, is_error, is_missing, field, start_byte, end_byte, text) -> Tree:
    """The tree of one document from columns of `NODES`, in the order of node_id; numbered at once where that is the preorder."""
    made: dict[int, Node] = {}
    found: list[Node] = []
    root, new, kept = None, Node.__new__, True
    path: list[Node] = []  # from the root to the node before
    for number, up, kind, named, error, missing, name, start, end, own in zip(node_id, parent_id, type_, is_named, is_error, is_missing, field, start_byte, end_byte, text):
        made[number] = node = new(Node)
        node.type, node.named, node.start, node.end, node.children = kind, named, start or 0, end or 0, []
        if name is not None:
            node.field = name
        if error:
            node.error = True
        if missing:
            node.missing = True
        if own is not None:
            node.text_ = own
        if up is None:
            kept, root = kept and root is None and not found, node
        else:
            above = made[up]
            siblings = above.children
            if kept:
                while path and path[-1] is not above:
                    path.pop()
                kept = bool(path)
                node.parent, node.index = above, len(siblings)
                if named:
                    node.named_index = seen = above.__dict__.get("_seen", 0)
                    above._seen = seen + 1
            siblings.append(node)
        node.id = len(found)
        found.append(node)
        path.append(node)
    tree = Tree(root)
    if kept:
        tree._nodes = found
    return tree


def record_batch(rows: list[tuple], schema: pa.Schema = ARROW) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, schema.types)], schema=schema)
