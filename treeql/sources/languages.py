"""Language registry and detection, as joins with small dimension tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..grammar.samples import GRAMMARS


@dataclass(frozen=True)
class Entry:
    name: str
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    interpreters: tuple[str, ...] = ()
    aliases: tuple[str, ...] = ()
    display: str = ""


# Public names, file endings and interpreters of common languages.
REGISTRY: dict[str, Entry] = {
    e.name: e
    for e in [
        Entry("json", (".json", ".geojson", ".webmanifest"), (".prettierrc",), (), ("geojson",), "JSON"), Entry("ini", (".ini", ".cfg"), (".editorconfig", ".gitconfig"), (), ("dosini",), "INI"),
        Entry("lox", (".lox",)), Entry("calc", (".calc",)), Entry("go", (".go",), (), (), ("golang",), "Go"), Entry("java", (".java",), (), ("jshell",), (), "Java"),
        Entry("python", (".py", ".pyi", ".pyw"), ("SConstruct",), ("python", "python2", "python3"), ("py",), "Python"), Entry("starlark", (".bzl", ".star"), ("BUILD", "BUILD.bazel", "WORKSPACE"), (), ("bazel",), "Starlark"),
        Entry("javascript", (".js", ".mjs", ".cjs", ".jsx"), (), ("node", "deno"), ("js",), "JavaScript"), Entry("typescript", (".ts", ".mts"), (), ("ts-node",), ("ts",), "TypeScript"), Entry("html", (".html", ".htm", ".xhtml"), (), (), ("xhtml",), "HTML"),
        Entry("css", (".css",), (), (), (), "CSS"), Entry("bash", (".sh", ".bash"), (".bashrc", ".profile"), ("bash", "sh", "zsh"), ("shell",), "Shell"), Entry("ruby", (".rb",), ("Rakefile", "Gemfile"), ("ruby",), ("rb",), "Ruby"),
        Entry("rust", (".rs",), (), (), ("rs",), "Rust"), Entry("c", (".c", ".h"), (), (), (), "C"), Entry("cpp", (".cc", ".cpp", ".hpp"), (), (), ("c++",), "C++"), Entry("markdown", (".md", ".markdown"), (), (), ("md",), "Markdown"),
        Entry("yaml", (".yaml", ".yml"), (), (), ("yml",), "YAML"), Entry("toml", (".toml",), ("Pipfile",), (), (), "TOML"), Entry("make", (".mk",), ("Makefile", "GNUmakefile"), ("make",), ("makefile",), "Makefile"), Entry("perl", (".pl", ".pm"), (), ("perl",), (), "Perl"),
    ]
}


def register(entry: Entry) -> None:
    REGISTRY[entry.name] = entry


def languages(spark: SparkSession) -> DataFrame:
    """(name, display, extensions, has_grammar) of all languages."""
    rows = [(e.name, display_name(e.name), list(e.extensions), e.name in GRAMMARS) for e in sorted(REGISTRY.values(), key=lambda e: e.name)]
    return spark.createDataFrame(rows, "name string, display string, extensions array<string>, has_grammar boolean")


def display_name(name: str) -> str:
    e = REGISTRY.get(name)
    return e.display if e and e.display else name.replace("_", " ").title()


def _lookup(table: dict[str, str], key: Column) -> Column:
    """A small dictionary as a map literal: no join at all."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def detect_language(path: Column) -> Column:
    """By exact file name, else by the longest of up to four dotted endings, else by the lower-case ending."""
    base = F.element_at(F.split(path, "/"), -1)
    names = {f: e.name for e in REGISTRY.values() for f in e.filenames}
    endings = {x: e.name for e in REGISTRY.values() for x in e.extensions}
    parts = F.split(base, r"\.")
    tries = []
    for k in (4, 3, 2, 1):
        tail = F.concat(F.lit("."), F.array_join(F.slice(parts, -k, k), "."))
        tries.append(F.when(F.size(parts) > k, _lookup(endings, tail)))
    last = F.when(F.size(parts) > 1, _lookup(endings, F.lower(F.concat(F.lit("."), F.element_at(parts, -1)))))
    return F.coalesce(_lookup(names, base), *tries, last)


def interpreter(line: Column) -> Column:
    """The interpreter that a `#!` line names, past `env`, its flags and variable settings."""
    words = F.split(F.trim(F.regexp_replace(line, r"^#!\s*", "")), r"\s+")
    base = lambda w: F.lower(F.element_at(F.split(w, "/"), -1))
    rest = F.filter(F.slice(words, 2, F.size(words)), lambda w: ~w.startswith("-") & ~w.contains("="))
    found = F.when(base(words[0]) == "env", base(F.try_element_at(rest, F.lit(1)))).otherwise(base(words[0]))
    return F.when(line.startswith("#!"), found)


def detect_by_shebang(line: Column) -> Column:
    table = {i: e.name for e in REGISTRY.values() for i in e.interpreters}
    name = interpreter(line)
    return F.coalesce(_lookup(table, name), _lookup(table, F.regexp_replace(name, r"[0-9.]+$", "")))


def detect_by_name(name: Column) -> Column:
    """By a language's own name, else by an alias."""
    table = {a: e.name for e in REGISTRY.values() for a in e.aliases} | {n: n for n in REGISTRY}
    return _lookup(table, F.lower(F.trim(name)))


def support(spark: SparkSession) -> DataFrame:
    """(name, backend, n_states, n_conflicts): how each language is parsed."""
    from ..grammar.samples import language

    rows = []
    for name in sorted(set(REGISTRY) | set(GRAMMARS)):
        if name in GRAMMARS:
            lang = language(name)
            rows.append((name, "lr" if not lang.conflicts else "glr", len(lang.actions), len(lang.conflicts)))
        else:
            rows.append((name, "imports" if name in ("go", "java", "python", "starlark") else "unsupported", 0, 0))
    return spark.createDataFrame(rows, "name string, backend string, n_states int, n_conflicts int")


def conflicts(spark: SparkSession, name: str) -> DataFrame:
    """(language, place): where a grammar leaves more than one action, to be forked at parse time."""
    from ..grammar.samples import language

    return spark.createDataFrame([(name, x) for x in language(name).conflicts], "language string, place string")


def next_symbols(spark: SparkSession, name: str) -> DataFrame:
    """(state, symbol): the terminals that each state of a language's parser can take, as for completion."""
    from ..grammar.samples import language

    lang = language(name)
    return spark.createDataFrame([(k, s) for k in range(len(lang.actions)) for s in lang.next_symbols(k)], "state int, symbol string")
