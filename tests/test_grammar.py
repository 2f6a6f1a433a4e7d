import json
import random

import pytest

from treeql.grammar import dsl
from treeql.grammar.compiler import GrammarError, compile_grammar
from treeql.grammar.html import parse_html
from treeql.grammar.parser import Parser
from treeql.grammar.samples import GRAMMARS, calc_grammar, json_grammar, language, lox_grammar, parser, run_tests


@pytest.mark.parametrize("name", GRAMMARS)
def test_own_tests(name):
    assert run_tests(GRAMMARS[name]()) == []
    assert dsl.validate(GRAMMARS[name]()) == []


def value(tree, node):
    if node.type in ("document", "pair"):
        return value(tree, node.named_children()[0])
    if node.type == "object":
        return {value(tree, p.child_by_field("key")): value(tree, p.child_by_field("value")) for p in node.named_children()}
    if node.type == "array":
        return [value(tree, c) for c in node.named_children()]
    return json.loads(tree.text(node))


def test_json_equals_the_json_module():
    rng = random.Random(3)

    def make(depth):
        k = rng.randrange(7 if depth else 5)
        if k == 5:
            return [make(depth - 1) for _ in range(rng.randrange(4))]
        if k == 6:
            return {f"k{i} é": make(depth - 1) for i in range(rng.randrange(4))}
        return [rng.randrange(-99, 99), 1.5e10, "a\"b\\n é", True, None][k]

    for _ in range(100):
        v = make(4)
        tree = parser("json").parse(json.dumps(v, ensure_ascii=rng.random() < 0.5).encode())
        assert not tree.root.has_error and value(tree, tree.root) == v


def test_calc_equals_eval():
    rng = random.Random(4)

    def run(tree, n):
        kids = n.named_children()
        if n.type == "number":
            return float(tree.text(n))
        if n.child_by_field("left"):
            a, b = run(tree, n.child_by_field("left")), run(tree, n.child_by_field("right"))
            return {"+": a + b, "-": a - b, "*": a * b, "/": a / b if b else 0}[n.child_by_field("operator").type]
        return -run(tree, n.child_by_field("operand")) if n.child_by_field("operand") else run(tree, kids[0])

    def make(d):
        return str(rng.randrange(1, 9)) if d == 0 or rng.random() < 0.2 else rng.choice([f"({make(d - 1)})", f"{make(d - 1)} {rng.choice('+-*')} {make(d - 1)}", f"-{make(d - 1)}"])

    for _ in range(100):
        s = make(4)
        tree = parser("calc").parse(s.encode())
        assert run(tree, tree.root) == eval(s)


@pytest.mark.parametrize(("lang", "source"), [("json", '{"a": [1, 2'), ("json", '{"a" 1} ] x'), ("calc", "1 + * 2"), ("lox", "fun f( { return; } }"), ("json", "\x00\xff"), ("lox", "var = ;;")])
def test_errors_are_in_the_tree(lang, source):
    tree = parser(lang).parse(source.encode())
    assert tree.root.has_error
    for n in tree.nodes:
        assert 0 <= n.start <= n.end <= len(source.encode())
        assert all(c.start >= n.start and c.end <= n.end for c in n.children)


def test_any_bytes_give_a_tree():
    rng = random.Random(5)
    for lang in GRAMMARS:
        for _ in range(40):
            source = "".join(rng.choice('{}[]",:0a \n=+-()é;') for _ in range(rng.randrange(40)))
            assert parser(lang).parse(source.encode()).root is not None


def test_ambiguity_forks():
    g = dsl.Grammar("ab")
    g.define("s", dsl.choice(dsl.sym("x"), dsl.sym("y")))
    g.define("x", dsl.dynamic(1, dsl.seq(dsl.repeat1("a"), "b"))).define("y", dsl.dynamic(2, dsl.seq(dsl.repeat1("a"), "b")))
    tree = Parser(compile_grammar(g)).parse(b"a a b")
    assert tree.root.sexpr() == "(s (y))" and not tree.root.has_error


def test_round_trip_and_diff():
    for make in (json_grammar, calc_grammar, lox_grammar):
        g = make()
        back = dsl.from_json(dsl.to_json(g))
        assert back.rules == g.rules and back.supertypes == g.supertypes
        assert dsl.diff(g, back)["modified"] == []
    new = calc_grammar().extended("more").append_choice("expression", dsl.sym("name")).define("name", dsl.pat("[a-z]+"))
    assert dsl.diff(calc_grammar(), new) == {"added": ["name"], "removed": [], "modified": ["expression"], "settings": []}
    assert Parser(compile_grammar(new)).parse(b"a+1").root.sexpr() == "(program (expression (expression (name)) (expression (number))))"


def test_bad_grammar():
    with pytest.raises(GrammarError):
        compile_grammar(dsl.Grammar("bad").define("s", dsl.sym("nowhere")))
    assert "number" in language("calc").next_symbols(0)


def test_html():
    source = b'<p class="x">a<br>b<p>c</b><script>if (a < b) "</p>"</script><!-- n --></div>'
    tree = parse_html(source)
    kinds = [n.type for n in tree.nodes]
    assert kinds.count("element") == 3 and "script_element" in kinds and "comment" in kinds and kinds.count("ERROR") == 2
    assert [tree.text(n) for n in tree.nodes if n.type == "raw_text"] == ['if (a < b) "</p>"']


def test_vm_scanner():
    from treeql.grammar.vm import VmError, VmScanner

    # a name: letters, after them any number of word characters
    program = [("require_valid", "name", 7), ("if_class", "letter", 7), ("advance",), ("mark",), ("if_class", "word", 6), ("jump", 2), ("emit", "name"), ("fail",)]
    scanner = VmScanner(program)
    assert scanner.scan("été_1 x".encode(), 0, ["name"], b"") == ("name", 7, b"")
    assert scanner.scan(b"1x", 0, ["name"], b"") is None and scanner.scan(b"x", 0, ["other"], b"") is None
    assert VmScanner([("jump", 0)]).scan(b"", 0, [], b"") is None
    assert VmScanner([("require_state", 0, 3), ("set_state", 5), ("emit", "t"), ("fail",)]).scan(b"", 0, ["t"], b"")[2] == (5).to_bytes(8, "big")
    for bad in ([("nope",)], [("jump", 7)]):
        with pytest.raises(VmError):
            VmScanner(bad)
    g = dsl.Grammar("vm", externals=["name"], scanner=scanner)
    g.define("s", dsl.repeat(dsl.sym("name")))
    assert Parser(compile_grammar(g)).parse(b"ab c1").root.sexpr() == "(s (name) (name))"


def test_token_sources():
    from treeql.grammar.sources import Renamed, by_order, listed_tokens, pattern_tokens

    calc = Parser(language("calc"))
    words = pattern_tokens({"number": "[0-9]+", "+": "plus", "*": "times"})
    assert calc.parse(b"1 plus 2 times 3", tokens=words).root.sexpr() == calc.parse(b"1 + 2 * 3").root.sexpr()
    assert calc.parse(b"1 plus ? 2", tokens=words).has_error and not calc.parse(b"1+2").has_error
    listed = listed_tokens([("number", 0, 1), ("+", 1, 2), ("number", 2, 3)])
    assert calc.parse(b"1p2", tokens=listed).root.sexpr() == calc.parse(b"1+2").root.sexpr()
    with pytest.raises(ValueError):
        listed_tokens([("number", 0, 2), ("+", 1, 2)])
    with pytest.raises(ValueError):
        calc.parse(b"1", tokens=lambda text: lambda at: ("number", 0, 9))
    outline = language("outline")
    other = by_order(outline, ["nl", "in", "out"])
    assert other.scan(b"\nx", 0, ["nl"], b"") == ("nl", 1, b"") and isinstance(other, Renamed)
    with pytest.raises(ValueError):
        by_order(outline, ["nl"])


def test_limits_cancellation_and_log():
    p = Parser(language("json"))
    deep = b"[" * 50 + b"]" * 50
    assert p.parse(deep, max_depth=20).stop_reason == "stack_depth_limit" and p.parse(deep, max_depth=60).stop_reason == "accepted"
    assert p.parse(b"[" + b"1," * 500 + b"1]", max_nodes=100).stop_reason == "node_limit"
    assert p.parse(deep, cancelled=lambda: True).stop_reason == "cancelled"
    said = []
    p.parse(b"[1", log=lambda kind, text: said.append((kind, text)))
    assert ("lex", "number 1 2") in said and any(k == "parse" for k, _ in said)


def test_second_parse_with_more_room():
    # which of the names is meant shows only at the end: with one stack the parse may follow the wrong one
    g = dsl.Grammar("late")
    g.define("s", dsl.choice(*[dsl.seq(dsl.sym(f"n{k}"), dsl.repeat("x"), end) for k, end in enumerate("abcdef")]))
    for k in range(6):
        g.define(f"n{k}", dsl.seq("n", "m"))
    g.conflicts = [tuple(f"n{k}" for k in range(6))]
    wide, narrow = Parser(compile_grammar(g), max_stacks=64), Parser(compile_grammar(g), max_stacks=1)
    for end in b"abcdef":
        source = b"n m x x " + bytes([end])
        assert not wide.parse(source).has_error
        assert narrow.parse(source).root.sexpr() == wide.parse(source).root.sexpr()


def test_saved_languages():
    from treeql.grammar.artifact import dump_language, load_language
    from treeql.grammar.samples import Indentation

    for name, source in (("json", b'{"a": [1, tru, "\\u00e9"]}'), ("lox", b"class A < B { f(x) { return x.y(1) } }"), ("calc", b"1 + * 2")):
        loaded = load_language(dump_language(language(name)))
        assert Parser(loaded).parse(source).rows(1) == Parser(language(name)).parse(source).rows(1)
        assert dump_language(loaded) == dump_language(language(name))
    with pytest.raises(ValueError):
        load_language(dump_language(language("outline")))
    outline = load_language(dump_language(language("outline")), Indentation())
    assert Parser(outline).parse(b"a\n  b\n").root.sexpr() == Parser(language("outline")).parse(b"a\n  b\n").root.sexpr()


def test_nested_regions():
    from treeql.operators.embedded import detect, regions
    from treeql.query.compiler import compile_query

    inside = {"json": compile_query("((pair key: (string (string_content) @injection.language) value: (string (string_content) @injection.content)))")}
    source = b'{"calc": "1+2", "none": "x", "json": "[7]"}'
    found = regions(source, "json", inside)
    assert [(r.language, source[r.start : r.end], r.level, r.tree is not None) for r in found[1:]] == [("calc", b"1+2", 1, True), ("none", b"x", 1, False), ("json", b"[7]", 1, True)]
    assert len(regions(source, "json", inside, max_depth=0)) == 1 and list(detect(found[3].tree, inside["json"])) == []
    # a language that holds itself ends at the greatest depth
    whole = {"json": compile_query('((document) @injection.content (#set! injection.language "json"))')}
    assert [r.level for r in regions(b"1", "json", whole)] == list(range(11))


def test_utf16_query_range():
    from treeql.query.execute import in_utf16_range

    source = "é😀x".encode()
    assert in_utf16_range(source, 1, 3) == (2, 6) and in_utf16_range(source, 3, 4) == (6, 7) and in_utf16_range(source, 0, 0) == (0, 0)
    assert in_utf16_range(source, 2, 3) is None and in_utf16_range(source, 0, 9) is None


def test_grammar_js():
    from treeql.grammar.javascript import from_javascript

    g = from_javascript(r"""
    // a small language
    const PREC = { add: 1, mul: 2, call: 9 };
    const digits = /[0-9]+/;
    const commaSep1 = (rule, by = ',') => seq(rule, repeat(seq(by, rule)));
    function commaSep(rule) { return optional(commaSep1(rule)); }
    module.exports = grammar({
      name: 'tiny',
      extras: $ => [/\s/, $.comment],
      word: $ => $.identifier,
      supertypes: ($) => [$._expression],
      rules: {
        program: $ => repeat(seq(field('value', $._expression), ';')),
        _expression: $ => choice($.binary, $.call, $.number, $.identifier, alias($.quoted, $.string)),
        binary: $ => choice(...[['+', PREC.add], ["*", PREC.mul]].map(x => prec.left(x[1], seq(field('left', $._expression), x[0], field('right', $._expression))))),
        call($) { return prec(PREC.call, seq(field('function', $.identifier), '(', commaSep($._expression), ')')); },
        number: _ => token(seq(optional('-'), digits)),
        identifier: $ => /[a-z_]\w*/i,
        quoted: $ => seq('"', token.immediate(/[^"\u000a]*/), '"'),
        comment: $ => token(seq('//', /[^\n]*/)),
      },
    });
    """)
    p = Parser(compile_grammar(g))
    tree = p.parse(b'f(1, -2 * x + 3); // c\n"q";')
    assert tree.root.sexpr() == "(program (call (identifier) (number) (binary (binary (number) (identifier)) (number))) (comment) (string))"
    assert tree.root.children[0].field == "value" and g.word == "identifier" and g.supertypes == ["_expression"]
    again = dsl.from_json(dsl.to_json(g))
    assert again.rules == g.rules
    for bad in ("module.exports = grammar(base, {});", "for (;;) {}", "const x = 1;", "module.exports = grammar({name: 'x', rules: {a: $ => prec('up', 'b')}});", "module.exports = grammar({name: 'x', rules: {a: $ => @}});"):
        with pytest.raises(GrammarError):
            from_javascript(bad)
