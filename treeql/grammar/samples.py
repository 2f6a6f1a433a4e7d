"""Grammars that come with the engine."""

from __future__ import annotations

from functools import cache

from .compiler import Language, compile_grammar
from .dsl import Grammar, alias, braces, brackets, choice, comma_sep, immediate, left, literal, named, optional, parens, pat, prec, repeat, repeat1, right, seq, sym, token
from .parser import Parser


def json_grammar() -> Grammar:
    g = Grammar("json")
    g.define("document", repeat(sym("_value")))
    g.define("_value", choice(*map(sym, ("object", "array", "number", "string", "true", "false", "null"))))
    g.define("object", braces(comma_sep(sym("pair"))))
    g.define("pair", seq(named("key", sym("string")), ":", named("value", sym("_value"))))
    g.define("array", brackets(comma_sep(sym("_value"))))
    g.define("string", seq('"', repeat(choice(sym("string_content"), sym("escape_sequence"))), immediate(literal('"'))))
    g.define("string_content", immediate(prec(1, pat(r'[^\\"\n]+'))))
    g.define("escape_sequence", immediate(seq("\\", choice(pat(r'["\\/bfnrt]'), pat(r"u[0-9a-fA-F]{4}")))))
    g.define("number", token(pat(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")))
    for word in ("true", "false", "null"):
        g.define(word, literal(word))
    g.supertypes = ["_value"]
    g.tests = [("pair", '{"a": [1, true]}', "(document (object (pair (string (string_content)) (array (number) (true)))))"), ("open", '{"a": ', None)]
    return g


def calc_grammar() -> Grammar:
    g = Grammar("calc")
    side = lambda op, level: left(level, seq(named("left", sym("expression")), named("operator", op), named("right", sym("expression"))))
    g.define("program", sym("expression"))
    g.define("expression", choice(side("+", 1), side("-", 1), side("*", 2), side("/", 2), right(3, seq(named("operator", "-"), named("operand", sym("expression")))), parens(sym("expression")), sym("number")))
    g.define("number", token(pat(r"[0-9]+(?:\.[0-9]+)?")))
    g.tests = [("levels", "1+2*3", "(program (expression (expression (number)) (expression (expression (number)) (expression (number)))))"), ("open", "1+", None)]
    return g


def ini_grammar() -> Grammar:
    g = Grammar("ini")
    g.extras = [pat(r"[ \t]")]
    g.define("document", seq(repeat(choice(sym("_blank"), sym("comment"), sym("setting"))), repeat(sym("section"))))
    g.define("section", seq(sym("section_name"), repeat(choice(sym("_blank"), sym("comment"), sym("setting")))))
    g.define("section_name", seq("[", sym("text"), "]", sym("_blank")))
    g.define("setting", seq(named("name", sym("setting_name")), "=", optional(named("value", sym("setting_value"))), sym("_blank")))
    g.define("setting_name", pat(r"[^\[\]=;#\s][^=\n]*?(?=[ \t]*=)"))
    g.define("setting_value", pat(r"[^\s][^\n]*"))
    g.define("text", pat(r"[^\[\]\n]+"))
    g.define("comment", seq(pat(r"[;#][^\n]*"), sym("_blank")))
    g.define("_blank", pat(r"\r?\n"))
    g.tests = [("section", "[a]\nk = v\n", "(document (section (section_name (text)) (setting (setting_name) (setting_value))))")]
    return g


def lox_grammar() -> Grammar:
    """A small language with functions, classes and imports, enough for tags, highlights and code patterns."""
    g = Grammar("lox")
    g.extras = [pat(r"\s"), sym("comment")]
    g.define("program", repeat(sym("_declaration")))
    g.define("_declaration", choice(sym("import_declaration"), sym("class_declaration"), sym("function_declaration"), sym("variable_declaration"), sym("_statement")))
    g.define("import_declaration", seq("import", named("path", sym("string")), optional(seq("as", named("alias", sym("identifier")))), ";"))
    g.define("class_declaration", seq("class", named("name", sym("identifier")), optional(seq("<", named("superclass", sym("identifier")))), named("body", sym("class_body"))))
    g.define("class_body", braces(repeat(alias(sym("_method"), "method_declaration"))))
    g.define("_method", seq(named("name", sym("identifier")), named("parameters", sym("parameters")), named("body", sym("block"))))
    g.define("function_declaration", seq("fun", named("name", sym("identifier")), named("parameters", sym("parameters")), named("body", sym("block"))))
    g.define("parameters", parens(comma_sep(sym("identifier"))))
    g.define("variable_declaration", seq("var", named("name", sym("identifier")), optional(seq("=", named("value", sym("_expression")))), ";"))
    g.define("_statement", choice(sym("expression_statement"), sym("print_statement"), sym("return_statement"), sym("if_statement"), sym("while_statement"), sym("block")))
    g.define("expression_statement", seq(sym("_expression"), ";"))
    g.define("print_statement", seq("print", sym("_expression"), ";"))
    g.define("return_statement", seq("return", optional(sym("_expression")), ";"))
    g.define("if_statement", right(0, seq("if", parens(named("condition", sym("_expression"))), named("consequence", sym("_statement")), optional(seq("else", named("alternative", sym("_statement")))))))
    g.define("while_statement", seq("while", parens(named("condition", sym("_expression"))), named("body", sym("_statement"))))
    g.define("block", braces(repeat(sym("_declaration"))))
    binary = lambda level, *ops: [left(level, seq(named("left", sym("_expression")), named("operator", op), named("right", sym("_expression")))) for op in ops]
    g.define("_expression", choice(sym("assignment"), sym("binary_expression"), sym("unary_expression"), sym("call_expression"), sym("member_expression"), parens(sym("_expression")), *map(sym, ("identifier", "number", "string", "true", "false", "nil"))))
    g.define("assignment", right(1, seq(named("left", choice(sym("identifier"), sym("member_expression"))), "=", named("right", sym("_expression")))))
    g.define("binary_expression", choice(*binary(2, "or"), *binary(3, "and"), *binary(4, "==", "!="), *binary(5, "<", "<=", ">", ">="), *binary(6, "+", "-"), *binary(7, "*", "/")))
    g.define("unary_expression", right(8, seq(named("operator", choice("!", "-")), named("operand", sym("_expression")))))
    g.define("call_expression", left(9, seq(named("function", sym("_expression")), named("arguments", sym("arguments")))))
    g.define("arguments", parens(comma_sep(sym("_expression"))))
    g.define("member_expression", left(9, seq(named("object", sym("_expression")), ".", named("property", sym("identifier")))))
    g.define("identifier", pat(r"[A-Za-z_][A-Za-z_0-9]*"))
    g.define("number", pat(r"[0-9]+(?:\.[0-9]+)?"))
    g.define("string", pat(r'"[^"\n]*"'))
    for word in ("true", "false", "nil"):
        g.define(word, literal(word))
    g.define("comment", pat(r"//[^\n]*"))
    g.word, g.supertypes = "identifier", ["_expression", "_statement", "_declaration"]
    g.tests = [("call", "f(1);", "(program (expression_statement (call_expression (identifier) (arguments (number)))))")]
    return g


class Indentation:
    """A scanner of `_newline`, `_indent` and `_dedent`; its state is the open levels, one byte each."""

    def scan(self, source: bytes, at: int, names: list[str], state: bytes):
        end = at
        while end < len(source) and source[end] in b" \t\r":
            end += 1
        if "_newline" in names and end < len(source) and source[end] == 10:
            return "_newline", end + 1, state
        if "_newline" in names and end == len(source) and "_dedent" not in names:
            return "_newline", end, state
        # the level of the next line with anything in it
        line, level = at, 0
        while line < len(source):
            stop = source.find(b"\n", line)
            stop = len(source) if stop < 0 else stop
            body = source[line:stop]
            if body.strip():
                level = min(len(body) - len(body.lstrip()), 255)
                break
            line = stop + 1
        if at and source[at - 1] != 10 and at < len(source):
            return None
        now = state[-1] if state else 0
        if "_indent" in names and level > now and line < len(source):
            return "_indent", line, state + bytes([level])
        if "_dedent" in names and state and (level < now or line >= len(source)):
            return "_dedent", at, state[:-1]
        return None


def outline_grammar() -> Grammar:
    """Lines, with indented lines below them: a grammar with a scanner."""
    g = Grammar("outline")
    g.extras = [pat(r"[ \t\r]")]
    g.externals, g.scanner = ["_newline", "_indent", "_dedent"], Indentation()
    g.define("document", repeat(choice(sym("item"), sym("_newline"))))
    g.define("item", right(0, seq(named("head", sym("text")), sym("_newline"), optional(seq(sym("_indent"), repeat1(choice(sym("item"), sym("_newline"))), sym("_dedent"))))))
    g.define("text", pat(r"[^\s][^\n]*"))
    g.tests = [("nested", "a\n  b\n    c\n  d\ne\n", "(document (item (text) (item (text) (item (text))) (item (text))) (item (text)))")]
    return g


GRAMMARS = {"outline": outline_grammar, "json": json_grammar, "calc": calc_grammar, "ini": ini_grammar, "lox": lox_grammar}


def register_grammar(name: str, grammar) -> None:
    """Add a grammar (a function that makes it) under a name."""
    GRAMMARS[name] = grammar
    language.cache_clear()
    parser.cache_clear()


@cache
def language(name: str) -> Language:
    return compile_grammar(GRAMMARS[name]())


@cache
def parser(name: str) -> Parser:
    """One parser for each language in each process."""
    return Parser(language(name))


def run_tests(g: Grammar) -> list[str]:
    """Failures of a grammar's own tests."""
    p, out = Parser(compile_grammar(g)), []
    for name, source, want in g.tests:
        tree = p.parse(source.encode())
        if want is None:
            if not tree.root.has_error:
                out.append(f"{name}: no error")
        elif tree.root.sexpr() != want:
            out.append(f"{name}: {tree.root.sexpr()}")
    return out

