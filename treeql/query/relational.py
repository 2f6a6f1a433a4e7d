"""Definite patterns as DataFrame plans: joins on (document, parent) with Column predicates, which Catalyst can push down, prune and reorder.

A pattern is definite if no step repeats, its alternations are of plain steps, and its predicates look at single captures. Its matches are then the rows of
a join, one for each combination of children, and their order is that of the columns in `order`. Other patterns need the matcher.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.navigation import below
from .compiler import Child, Pattern, Predicate, Query, Step

_PREDICATES = {"eq", "not-eq", "any-eq", "any-not-eq", "match", "not-match", "any-match", "any-not-match", "any-of", "not-any-of", "is-exported", "has-parent", "not-has-parent", "set", "offset", "strip", "is", "is-not", "count", "has-ancestor", "not-has-ancestor"}


def definite(pattern: Pattern) -> bool:
    def plain(step: Step) -> bool:
        if step.kind == "alt":
            return not step.children and all(not b.nested and not b.field and not b.predicates and not b.step.captures for b in step.branches)
        return all(not c.quantifier and plain(c.step) for c in step.children)

    return not pattern.quantifier and plain(pattern.root) and all(p.name in _PREDICATES for p in pattern.predicates)


def _names(step: Step, out: list[str]) -> list[str]:
    out.extend(step.captures)
    for c in step.children:
        _names(c.step, out)
    return out


class _Plan:
    def __init__(self, nodes: DataFrame):
        self.nodes, self.count, self.captures, self.order = nodes, 0, [], []

    def side(self) -> tuple[DataFrame, str]:
        p = f"n{self.count}_"
        self.count += 1
        keep = ["doc_id", "node_id", "parent_id", "child_index", "named_index", "depth", "last_desc", "type", "is_named", "is_error", "field", "start_byte", "end_byte", "named_child_count", "text"]
        return self.nodes.select(*[F.col(c).alias(p + c) for c in keep]), p

    def test(self, step: Step, p: str) -> Column:
        kind, named = F.col(p + "type"), F.col(p + "is_named")
        if step.kind == "any":
            return F.lit(True)
        if step.kind == "named":
            return named
        if step.kind == "text":
            return ~named & (kind == step.name)
        if step.kind == "alt":
            return reduce(Column.__or__, [self.test(b.step, p) for b in step.branches])
        hit = (kind == step.name) | F.col(p + "is_error") if step.name == "ERROR" else kind == step.name
        return hit & (named == F.lit(step.named))

    def absent(self, df: DataFrame, step: Step, p: str) -> DataFrame:
        for f in step.absent if step.kind == "type" else []:
            with_field = self.nodes.where(F.col("field") == f).select(F.col("doc_id").alias("d_"), F.col("parent_id").alias("p_"))
            df = df.join(with_field, (F.col(p + "doc_id") == F.col("d_")) & (F.col(p + "node_id") == F.col("p_")), "left_anti")
        return df

    def build(self, step: Step) -> DataFrame:
        df, p = self.side()
        df = self.absent(df.where(self.test(step, p)), step, p)
        self.take(step, p)
        self.root = p
        return self.below(df, step, p)

    def take(self, step: Step, p: str) -> None:
        self.captures.extend((name, p) for name in step.captures)

    def below(self, df: DataFrame, step: Step, up: str) -> DataFrame:
        before: list[str] = []
        for i, child in enumerate(step.children):
            side, p = self.side()
            side = self.absent(side.where(self.test(child.step, p)), child.step, p)
            on = (F.col(p + "doc_id") == F.col(up + "doc_id")) & (F.col(p + "parent_id") == F.col(up + "node_id"))
            if child.field:
                side = side.where(F.col(p + "field") == child.field)
            if before:
                on &= F.col(p + "child_index") > F.col(before[-1] + "child_index")
            on &= self.anchored(child, i, p, up, before)
            df = df.join(side, on)
            self.order.append(p + "child_index")
            self.take(child.step, p)
            df = self.below(df, child.step, p)
            before.append(p)
        return df

    @staticmethod
    def anchored(child: Child, i: int, p: str, up: str, before: list[str]) -> Column:
        ok = F.lit(True)
        if child.anchor_before:
            # the place behind the last named sibling that the steps before took
            last = F.coalesce(*[F.col(b + "named_index") for b in reversed(before)], F.lit(-1)) if before else F.lit(-1)
            ok &= F.col(p + "named_index") == last + 1
        if child.anchor_after:
            ok &= F.col(p + "named_index") == F.col(up + "named_child_count") - 1
        return ok

    def held(self, df: DataFrame, q: Predicate) -> DataFrame:
        at = [p for name, p in self.captures if name == q.capture]
        if q.directive:
            return df
        if q.name in ("is", "is-not"):
            names = [n for n, _ in self.captures if not q.capture or n == q.capture]
            found = any(n == q.values[0] or n.endswith("." + q.values[0]) for n in names)
            return df if found == (q.name == "is") else df.limit(0)
        if q.name == "count":
            n, limit = len(at), int(q.values[1])
            ok = {">": n > limit, "<": n < limit, ">=": n >= limit, "<=": n <= limit, "==": n == limit, "!=": n != limit}[q.values[0]]
            return df if ok else df.limit(0)
        if "has-" in q.name:
            if not at:
                return df.limit(0)
            anti = "left_anti" if q.name.startswith("not-") else "left_semi"
            if "ancestor" in q.name and len(at) == 1:
                under = self.nodes.withColumn("u_", below(F.col("type").isin(*q.values))).where("u_").select(F.col("doc_id").alias("d_"), F.col("node_id").alias("a_"))
                return df.join(under, (F.col(at[0] + "doc_id") == F.col("d_")) & (F.col(at[0] + "node_id") == F.col("a_")), anti)
            above = self.nodes.where(F.col("type").isin(*q.values)).select(F.col("doc_id").alias("d_"), F.col("node_id").alias("a_"), F.col("last_desc").alias("l_"))
            hit = F.lit(False)
            for p in at:
                inside = (F.col("a_") == F.col(p + "parent_id")) if "parent" in q.name else (F.col(p + "node_id") > F.col("a_")) & (F.col(p + "node_id") <= F.col("l_"))
                hit |= inside
            return df.join(above, (F.col(at[0] + "doc_id") == F.col("d_")) & hit, anti)
        if not at:
            return df if q.optional else df.limit(0)
        texts = [F.coalesce(F.col(p + "text"), F.lit("")) for p in (at if q.name.startswith("any-") and q.name != "any-of" else at[:1])]
        if q.name == "is-exported":
            return df.where(texts[0].rlike(r"^\p{Lu}"))
        if q.name in ("any-of", "not-any-of"):
            hit = texts[0].isin(*q.values)
            return df.where(hit if q.name == "any-of" else ~hit)
        wanted = not ("not" in q.name)
        if q.name.endswith("eq"):
            other = [p for name, p in self.captures if name == q.other]
            if q.other and not other:
                return df.limit(0)
            right = F.coalesce(F.col(other[0] + "text"), F.lit("")) if q.other else F.lit(q.values[0])
            tests = [(t == right) == F.lit(wanted) for t in texts]
        else:
            tests = [t.rlike(q.regex) == F.lit(wanted) for t in texts]
        return df.where(reduce(Column.__or__, tests))


def pattern_matches(nodes: DataFrame, pattern: Pattern, index: int = 0, disabled: frozenset = frozenset()) -> DataFrame:
    """Rows (doc_id, pattern_index, root_id, order, captures) of a definite pattern.

    captures: array of (name, node_id, start_byte, end_byte, text) in the order of the steps.
    """
    plan = _Plan(nodes)
    df = plan.build(pattern.root)
    for q in pattern.predicates:
        df = plan.held(df, q)
    strips = {q.capture: q for q in pattern.predicates if q.name == "strip"}

    def one(name: str, p: str) -> Column:
        text = F.coalesce(F.col(p + "text"), F.lit(""))
        if name in strips:
            stripped = F.regexp_replace(text, strips[name].regex, "")
            text = F.when(stripped != "", stripped).otherwise(text)  # an empty override stands for the node's own text
        return F.struct(F.lit(name).alias("name"), F.col(p + "node_id").alias("node_id"), F.col(p + "start_byte").alias("start_byte"), F.col(p + "end_byte").alias("end_byte"), text.alias("text"))

    captured = [one(n, p) for n, p in plan.captures if n not in disabled]
    empty = F.expr("cast(array() as array<struct<name:string,node_id:int,start_byte:int,end_byte:int,text:string>>)")
    return df.select(
        F.col(plan.root + "doc_id").alias("doc_id"), F.lit(index).alias("pattern_index"), F.col(plan.root + "node_id").alias("root_id"),
        (F.array(*plan.order) if plan.order else F.expr("cast(array() as array<int>)")).alias("order"), (F.array(*captured) if captured else empty).alias("captures"),
    )


def query_matches(nodes: DataFrame, query: Query) -> DataFrame:
    """All matches of a query of definite patterns."""
    parts = [pattern_matches(nodes, p, i, query.disabled_captures) for i, p in enumerate(query.patterns) if i not in query.disabled_patterns]
    return reduce(DataFrame.unionByName, parts)
