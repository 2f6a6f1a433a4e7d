"""Import extraction from sources of Go, Java, Python and Starlark."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

IMPORTS = "doc_id bigint, seq int, lang string, kind string, path string, from string, name string, alias string, is_static boolean, wildcard boolean, relative int, start_byte int, end_byte int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("seq", pa.int32()), *[(n, pa.string()) for n in ("lang", "kind", "path", "from", "name", "alias")], ("is_static", pa.bool_()), ("wildcard", pa.bool_()), ("relative", pa.int32()), ("start_byte", pa.int32()), ("end_byte", pa.int32())])


def blanked(source: bytes, marks: str) -> bytes:
    """Comments as blanks of the same length; strings stay. `marks`: `c` for // and /* */, `#` for hash comments."""
    parts = [rb'"""(?:.|\n)*?"""', rb"'''(?:.|\n)*?'''"] if marks == "#" else [rb"`[^`]*`"]
    parts += [rb'"(?:\\.|[^"\\\n])*"', rb"'(?:\\.|[^'\\\n])*'"]
    comment = rb"#[^\n]*" if marks == "#" else rb"//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)"
    return re.sub(b"|".join([*parts, b"(?P<c>" + comment + b")"]), lambda m: re.sub(rb"[^\n]", b" ", m[0]) if m["c"] else m[0], source)


def _row(kind, path, from_="", name="", alias="", static=False, wildcard=False, relative=0, start=0, end=0):
    return kind, path, from_, name, alias, static, wildcard, relative, start, end


def go_imports(source: bytes) -> Iterator[tuple]:
    text = blanked(source, "c")
    m = re.search(rb"(?m)^\s*package\s+(\w+)", text)
    if m:
        yield _row("package", m[1].decode(), name=m[1].decode(), start=m.start(1), end=m.end(1))
    spec = re.compile(rb'(?:([\w.]+)[ \t]+)?("(?:[^"\\]|\\.)*"|`[^`]*`)')
    for m in re.finditer(rb'(?m)^[ \t]*import\s*(?:\(([^)]*)\)|((?:[\w.]+[ \t]+)?(?:"[^"\n]*"|`[^`]*`)))', text):
        group = 1 if m[1] is not None else 2
        for s in spec.finditer(m[group]):
            path, alias = s[2][1:-1].decode("utf-8", "replace"), (s[1] or b"").decode()
            yield _row("import", path, name=path.rsplit("/", 1)[-1], alias=alias, wildcard=alias == ".", start=m.start(group) + s.start(), end=m.start(group) + s.end())


def java_imports(source: bytes) -> Iterator[tuple]:
    text = blanked(source, "c")
    for m in re.finditer(rb"\b(package|import)\s+(static\s+)?([\w.\s]+?)(\s*\.\s*\*)?\s*;", text):
        path = re.sub(rb"\s+", b"", m[3]).decode()
        if m[1] == b"package":
            yield _row("package", path, name=path, start=m.start(), end=m.end())
            continue
        head, _, name = path.rpartition(".")
        wild = m[4] is not None
        yield _row("import", path, path if wild else head, "*" if wild else name, "", m[2] is not None, wild, start=m.start(), end=m.end())


def _logical_lines(source: bytes) -> Iterator[tuple[int, int, str]]:
    """Statements of an indented language, with strings and comments blanked, continued lines and brackets joined."""
    quoted = rb'[rRbBuUfF]{0,2}(?:"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')|#[^\n]*'
    text = re.sub(quoted, lambda m: re.sub(rb"[^\n]", b" ", m[0]) if m[0].startswith(b"#") else b"\x01" * len(m[0]), source)
    start = depth = at = 0
    while at <= len(text):
        c = text[at : at + 1]
        if c in (b"(", b"[", b"{"):
            depth += 1
        elif c in (b")", b"]", b"}"):
            depth = max(0, depth - 1)
        elif c == b"\\" and text[at + 1 : at + 2] == b"\n":
            at += 1
        elif (c in (b"\n", b";") and depth == 0) or c == b"":
            piece = text[start:at]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip():
                yield start + lead, start + len(piece.rstrip()), re.sub(r"\\\n|\s+", " ", piece.decode("utf-8", "replace")).strip()
            start = at + 1
        at += 1


def _listed(text: str) -> Iterator[tuple[str, str]]:
    for item in text.strip().strip("()").split(","):
        if item.strip():
            name, _, alias = item.strip().partition(" as ")
            yield name.strip(), alias.strip()


def python_imports(source: bytes) -> Iterator[tuple]:
    for start, end, line in _logical_lines(source):
        if m := re.fullmatch(r"import (.+)", line):
            for name, alias in _listed(m[1]):
                yield _row("import", name, name=name.rsplit(".", 1)[-1], alias=alias, start=start, end=end)
        elif m := re.fullmatch(r"from\s*(\.*)\s*([\w.]*)\s+import\s*(.+)", line):
            base, dots = m[2], len(m[1])
            for name, alias in _listed(m[3]):
                wild = name == "*"
                path = base if wild else f"{base}.{name}" if base else name
                yield _row("from", path, base, name, alias, False, wild, dots, start, end)


def starlark_imports(source: bytes) -> Iterator[tuple]:
    text = blanked(source, "#")
    for m in re.finditer(rb"(?m)^[ \t]*load\s*\(([^)]*)\)", text):
        args = re.findall(rb'(?:(\w+)\s*=\s*)?("(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[^,\s]+)', m[1])
        values = [(a.decode(), v.decode("utf-8", "replace")) for a, v in args]
        if not values or values[0][1][:1] not in "\"'":
            continue
        path = values[0][1][1:-1]
        for alias, v in values[1:]:
            if v[:1] in "\"'":
                yield _row("load", path, path, v[1:-1], alias, start=m.start(), end=m.end())


EXTRACTORS = {"go": go_imports, "java": java_imports, "python": python_imports, "starlark": starlark_imports}


def status(lang: str, source: bytes) -> tuple[str, str]:
    """(status, reason): whether the source alone says what it imports."""
    if lang not in EXTRACTORS:
        return "unsupported", "language"
    if lang == "starlark" and any(a.strip()[:1] not in (b'"', b"'") for a in re.findall(rb"(?m)^[ \t]*load\s*\(([^,)]*)", blanked(source, "#"))):
        return "fallback", "load of something other than a literal"
    return "ok", ""


def extract_imports(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each import of each source, in order; sources of other languages give none."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, lang, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if text and lang in EXTRACTORS:
                    rows.extend((doc, i, lang, *r) for i, r in enumerate(EXTRACTORS[lang](text.encode())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)

    return docs.where(F.col(lang_col).isin(*EXTRACTORS)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, IMPORTS)
