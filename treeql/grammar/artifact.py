"""Compiled languages as bytes, so that executors load tables instead of compiling a grammar. Gzipped JSON: loading runs no code."""

from __future__ import annotations

import gzip
import json
import re

from .compiler import Language, Part, Production, Terminal

FORMAT = 1


def dump_language(x: Language) -> bytes:
    """A language's tables; its scanner is code and doesn't go with them."""
    data = {
        "format": FORMAT, "name": x.name, "start": x.start, "extras": x.extras, "externals": x.externals, "conflicts": x.conflicts, "nonterminals": sorted(x.nonterminals),
        "supertypes": {k: sorted(v) for k, v in x.supertypes.items()}, "actions": x.actions, "gotos": x.gotos,
        "productions": [[p.left, [[y.name, y.field, y.alias, y.alias_named] for y in p.right], p.level, p.side, p.dynamic] for p in x.productions],
        "terminals": [[t.name, t.regex.pattern.decode() if t.regex else None, t.named, t.is_string, t.immediate, t.level, t.order] for t in x.terminals.values()],
    }
    return gzip.compress(json.dumps(data, ensure_ascii=False).encode(), mtime=0)


def load_language(data: bytes, scanner=None) -> Language:
    """The language of `dump_language`'s bytes; `scanner` if it has external tokens."""
    x = json.loads(gzip.decompress(data))
    if x.get("format") != FORMAT:
        raise ValueError(f"format {x.get('format')} of a language, {FORMAT} is known")
    if x["externals"] and scanner is None:
        raise ValueError(f"{x['name']} needs a scanner for {', '.join(x['externals'])}")
    terminals = {t[0]: Terminal(t[0], re.compile(t[1].encode()) if t[1] is not None else None, *t[2:]) for t in x["terminals"]}
    productions = [Production(left, tuple(Part(*y) for y in right), *rest) for left, right, *rest in x["productions"]]
    return Language(
        x["name"], productions, terminals, set(x["nonterminals"]), x["extras"], [{k: [tuple(a) for a in v] for k, v in s.items()} for s in x["actions"]], x["gotos"],
        x["conflicts"], {k: set(v) for k, v in x["supertypes"].items()}, x["start"], x["externals"], scanner,
    )
