"""Grammar rules."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Rule:
    kind: str  # str pat sym blank seq choice repeat repeat1 token imm field prec alias
    items: tuple = ()
    value: Any = None
    extra: Any = None


def rule(x) -> Rule:
    return literal(x) if isinstance(x, str) else x


def literal(s: str) -> Rule:
    return Rule("str", value=s)


def pat(regex: str) -> Rule:
    return Rule("pat", value=regex)


def sym(name: str) -> Rule:
    return Rule("sym", value=name)


def blank() -> Rule:
    return Rule("blank")


def seq(*xs) -> Rule:
    return Rule("seq", tuple(map(rule, xs)))


def choice(*xs) -> Rule:
    return Rule("choice", tuple(map(rule, xs)))


def optional(x) -> Rule:
    return choice(x, blank())


def repeat(x) -> Rule:
    return Rule("repeat", (rule(x),))


def repeat1(x) -> Rule:
    return Rule("repeat1", (rule(x),))


def token(x) -> Rule:
    return Rule("token", (rule(x),))


def immediate(x) -> Rule:
    return Rule("imm", (rule(x),))


def named(name: str, x) -> Rule:
    """Give the nodes of `x` the field `name` in their parent."""
    return Rule("field", (rule(x),), name)


def prec(level: int, x, side: str = "") -> Rule:
    return Rule("prec", (rule(x),), level, side)


def left(level: int, x) -> Rule:
    return prec(level, x, "left")


def right(level: int, x) -> Rule:
    return prec(level, x, "right")


def dynamic(level: int, x) -> Rule:
    return prec(level, x, "dynamic")


def alias(x, name: str, is_named: bool = True) -> Rule:
    return Rule("alias", (rule(x),), name, is_named)


def sep1(x, by) -> Rule:
    return seq(x, repeat(seq(by, x)))


def sep(x, by) -> Rule:
    return optional(sep1(x, by))


def comma_sep1(x) -> Rule:
    return sep1(x, ",")


def comma_sep(x) -> Rule:
    return sep(x, ",")


def parens(x) -> Rule:
    return seq("(", x, ")")


def brackets(x) -> Rule:
    return seq("[", x, "]")


def braces(x) -> Rule:
    return seq("{", x, "}")


@dataclass
class Grammar:
    """Rules by name, the first is the start. Names with a leading underscore make no nodes."""

    name: str
    rules: dict[str, Rule] = field(default_factory=dict)
    extras: list[Rule] = field(default_factory=lambda: [pat(r"\s")])
    conflicts: list[tuple[str, ...]] = field(default_factory=list)
    inline: list[str] = field(default_factory=list)
    word: str = ""
    supertypes: list[str] = field(default_factory=list)
    externals: list[str] = field(default_factory=list)  # tokens that only the scanner finds
    scanner: Any = None  # scan(source, at, names that may come, state) -> (name, end, new state) or None; states are bytes
    tests: list[tuple[str, str, str | None]] = field(default_factory=list)  # name, input, expected S-expression or None for an error

    def define(self, name: str, x) -> "Grammar":
        self.rules[name] = rule(x)
        return self

    def append_choice(self, name: str, *xs) -> "Grammar":
        old = self.rules[name]
        items = old.items if old.kind == "choice" else (old,)
        self.rules[name] = Rule("choice", (*items, *map(rule, xs)))
        return self

    def extended(self, name: str) -> "Grammar":
        out = copy.deepcopy(self)
        out.name, out.tests = name, []
        return out

    def supertype_members(self) -> dict[str, set[str]]:
        def names(r: Rule) -> set[str]:
            if r.kind == "sym":
                return {r.value}
            return set().union(*(names(x) for x in r.items)) if r.items else set()

        return {s: names(self.rules[s]) for s in self.supertypes}


def validate(g: Grammar) -> list[str]:
    """Problems of a grammar: names without rule, rules that nothing reaches, symbols that can't end."""
    out = []

    def used(r: Rule) -> set[str]:
        return ({r.value} if r.kind == "sym" else set()).union(*(used(x) for x in r.items)) if r.items or r.kind == "sym" else set()

    uses = {k: used(r) for k, r in g.rules.items()}
    for k, names in uses.items():
        out += [f"{k}: no rule {n}" for n in sorted(names) if n not in g.rules and n not in g.externals]
    for n in [*g.inline, *g.supertypes, *([g.word] if g.word else []), *(x for c in g.conflicts for x in c)]:
        if n not in g.rules:
            out.append(f"no rule {n}")
    if not g.rules:
        return [*out, "no rules"]
    seen, todo = set(), [next(iter(g.rules)), *([g.word] if g.word else []), *(n for x in g.extras for n in used(x))]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.add(n)
            todo.extend(uses.get(n, ()))
    out += [f"{k}: not reached from the start" for k in g.rules if k not in seen]
    ends: set[str] = set()

    def can(r: Rule) -> bool:
        if r.kind in ("str", "pat", "blank", "repeat"):
            return True
        if r.kind == "sym":
            return r.value in ends or r.value not in g.rules or r.value in g.externals
        return (any if r.kind == "choice" else all)(can(x) for x in r.items)

    while True:
        more = {k for k, r in g.rules.items() if k not in ends and can(r)}
        if not more:
            break
        ends |= more
    return out + [f"{k}: never ends" for k in g.rules if k not in ends]


def diff(old: Grammar, new: Grammar) -> dict[str, list[str]]:
    """Added, removed and modified rules, and changed settings."""
    settings = ("extras", "conflicts", "inline", "word", "supertypes")
    return {
        "added": [k for k in new.rules if k not in old.rules], "removed": [k for k in old.rules if k not in new.rules],
        "modified": [k for k in new.rules if k in old.rules and new.rules[k] != old.rules[k]], "settings": [s for s in settings if getattr(old, s) != getattr(new, s)],
    }


_TO_JSON = {"str": "STRING", "pat": "PATTERN", "sym": "SYMBOL", "blank": "BLANK", "seq": "SEQ", "choice": "CHOICE", "repeat": "REPEAT", "repeat1": "REPEAT1", "token": "TOKEN", "imm": "IMMEDIATE_TOKEN", "field": "FIELD", "alias": "ALIAS"}


def to_json(g: Grammar) -> dict:
    """The grammar in the public grammar.json form."""

    def one(r: Rule) -> dict:
        if r.kind == "prec":
            kind = {"": "PREC", "left": "PREC_LEFT", "right": "PREC_RIGHT", "dynamic": "PREC_DYNAMIC"}[r.extra]
            return {"type": kind, "value": r.value, "content": one(r.items[0])}
        out: dict[str, Any] = {"type": _TO_JSON[r.kind]}
        if r.kind in ("str", "pat"):
            return out | {"value": r.value}
        if r.kind == "sym":
            return out | {"name": r.value}
        if r.kind in ("seq", "choice"):
            return out | {"members": [one(x) for x in r.items]}
        if r.kind == "field":
            return out | {"name": r.value, "content": one(r.items[0])}
        if r.kind == "alias":
            return out | {"content": one(r.items[0]), "named": r.extra, "value": r.value}
        return out | ({"content": one(r.items[0])} if r.items else {})

    return {
        "name": g.name, "word": g.word or None, "rules": {k: one(r) for k, r in g.rules.items()}, "extras": [one(x) for x in g.extras],
        "conflicts": [list(c) for c in g.conflicts], "externals": [{"type": "SYMBOL", "name": x} for x in g.externals], "inline": g.inline, "supertypes": g.supertypes,
    }


def from_json(data: dict) -> Grammar:
    back = {v: k for k, v in _TO_JSON.items()}

    def one(x: dict) -> Rule:
        t = x["type"]
        if t.startswith("PREC"):
            return prec(x["value"], one(x["content"]), {"PREC": "", "PREC_LEFT": "left", "PREC_RIGHT": "right", "PREC_DYNAMIC": "dynamic"}[t])
        if t in ("STRING", "PATTERN"):
            return Rule(back[t], value=x["value"])
        if t == "SYMBOL":
            return sym(x["name"])
        if t in ("SEQ", "CHOICE"):
            return Rule(back[t], tuple(map(one, x["members"])))
        if t == "FIELD":
            return named(x["name"], one(x["content"]))
        if t == "ALIAS":
            return alias(one(x["content"]), x["value"], x["named"])
        return Rule(back[t], (one(x["content"]),) if "content" in x else ())

    return Grammar(
        data["name"], {k: one(v) for k, v in data["rules"].items()}, [one(x) for x in data.get("extras", [])], [tuple(c) for c in data.get("conflicts", [])],
        list(data.get("inline", [])), data.get("word") or "", list(data.get("supertypes", [])), [x["name"] for x in data.get("externals", []) if x.get("type") == "SYMBOL"],
    )
