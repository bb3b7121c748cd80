"""Rules, directives, configuration, fixing, reports and the document stream."""

import pytest

from sylva.operators.rules import RULES
from sylva.plans.infer import as_toml, infer_block_spacing
from sylva.plans.lint import edits_of, exit_code, fix, lint
from sylva.plans.report import config_schema, dump_tree, explain, problems_fixed, report, rule_table, rules_markdown, totals
from sylva.sources.config import parse_config, select_rules
from sylva.sources.files import files_from, ignored, load_files, scripts_of
from sylva.streaming.documents import actions, compact, current, publish

#: rule, options, number of findings, source
SNIPPETS = [
    ("constructor-super", {}, 1, "class A extends B { constructor() {} }"),
    ("constructor-super", {}, 1, "class A { constructor() { super(); } }"),
    ("constructor-super", {}, 0, "class A extends B { constructor() { super(); } }"),
    ("for-direction", {}, 1, "for (let i = 0; i < 9; i -= 1) {}"),
    ("for-direction", {}, 0, "for (let i = 0; i < 9; i -= -1) {}"),
    ("for-direction", {}, 0, "for (let i = 0; i < 9; i += n) {}"),
    ("getter-return", {}, 1, "let a = { get b() { if (c) { return 1; } } }"),
    ("getter-return", {}, 0, "let a = { get b() { if (c) { return 1; } else { return 2; } } }"),
    ("getter-return", {}, 1, "Object.defineProperty(a, 'b', { get: function () {} })"),
    ("getter-return", {"allowImplicit": True}, 0, "let a = { get b() { return; } }"),
    ("no-setter-return", {}, 1, "class A { set b(c) { return c; } }"),
    ("no-setter-return", {}, 1, "Object.create(a, { b: { set(c) { return c; } } })"),
    ("no-async-promise-executor", {}, 1, "new Promise(async (a) => {})"),
    ("no-async-promise-executor", {}, 0, "new Promise((a) => {}, async () => {})"),
    ("no-await-in-loop", {}, 1, "async () => { while (a) { await b; } }"),
    ("no-await-in-loop", {}, 0, "async () => { for (const a of await b) { c(async () => { await d; }); } }"),
    ("no-compare-neg-zero", {}, 2, "-0 > a; b === -0"),
    ("no-cond-assign", {}, 1, "while (a = b) {}"),
    ("no-cond-assign", {}, 0, "while ((a = b)) {}"),
    ("no-cond-assign", {"allow_parens": False}, 1, "while ((a = b)) {}"),
    ("no-confusing-arrow", {}, 1, "a => b ? c : d"),
    ("no-confusing-arrow", {}, 0, "a => (b ? c : d)"),
    ("no-constant-condition", {}, 2, "if (true) {} else if (a && false) {}"),
    ("no-constant-condition", {}, 0, "if (a || b) {}"),
    ("no-debugger", {}, 1, "debugger"),
    ("no-dupe-keys", {}, 2, "x = { a: 1, 'b': 2, a: 3, 'b': 4, c: { a: 1 } }"),
    ("no-duplicate-cases", {}, 1, "switch (a) { case b.c: case d: case b . c: }"),
    ("no-duplicate-imports", {}, 1, "import a from 'x'; import b from 'x'; import c from 'y';"),
    ("no-duplicate-imports", {"include_exports": True}, 1, "import a from 'x'; export * from 'x';"),
    ("no-empty", {}, 2, "if (a) {} switch (b) {}"),
    ("no-empty", {}, 0, "if (a) { /* b */ } function c() {}"),
    ("no-extra-boolean-cast", {}, 3, "if (!!a) {} Boolean(!!b); !Boolean(c)"),
    ("no-extra-boolean-cast", {"enforce_for_logical_operands": True}, 1, "if (!!a || b) {}"),
    ("no-extra-semi", {}, 2, ";class A { ; } for (;;);"),
    ("no-inner-declarations", {}, 1, "if (a) { function b() {} }"),
    ("no-inner-declarations", {"disallowed": ["variables"]}, 1, "if (a) { var b; let c; } for (var d of e) {}"),
    ("no-irregular-whitespace", {}, 2, "a = 1; // 　\n' '"),
    ("no-new-symbol", {}, 1, "new Symbol()"),
    ("no-prototype-builtins", {}, 1, "a.b.hasOwnProperty('c')"),
    ("no-sparse-arrays", {}, 1, "[,1]; [1,]"),
    ("no-this-before-super", {}, 1, "class A extends B { constructor() { this.a; super(); } }"),
    ("no-this-before-super", {}, 0, "class A extends B { constructor() { super(); this.a; } }"),
    ("no-unexpected-multiline", {}, 3, "a\n(b); c\n[d]; e\n`f`"),
    ("no-unexpected-multiline", {}, 0, "a(\nb); c?.\n(d)"),
    ("no-unsafe-finally", {}, 1, "function f() { try { a() } finally { return 1 } }"),
    ("no-unsafe-negation", {}, 2, "!a in b; !c instanceof d; !(e in f)"),
    ("require-yield", {}, 1, "function* a() { b(); }"),
    ("use-isnan", {}, 3, "a == NaN; switch (NaN) { case NaN: }"),
    ("use-isnan", {"enforce_for_index_of": True}, 1, "a.indexOf(NaN)"),
    ("valid-typeof", {}, 1, "typeof a === 'strin'; typeof b == 'string'"),
    ("valid-typeof", {"require_string_literals": True}, 1, "typeof a === b"),
    ("block-spacing", {}, 2, "if (a) {b()}"),
    ("block-spacing", {"style": "never"}, 1, "if (a) { b()}"),
    ("no-invalid-regexp", {}, 2, "new RegExp('['); RegExp('a', 'z'); /a/g"),
    ("simplify-regex", {}, 1, "/[0-9]{1,}/; /a/"),
]


def test_rules(spark):
    by_options: dict = {}
    for i, (rule, options, _, source) in enumerate(SNIPPETS):
        by_options.setdefault(repr(options), (options, {}))[1][f"{i}.mjs"] = (rule, source)
    wrong = []
    for options, sources in by_options.values():
        files = files_from(spark.createDataFrame([(p, s) for p, (_, s) in sources.items()], "path string, source string"))
        run = lint(files, rules={r: options for r, _ in sources.values()})
        counts = {(r.path, r.rule): r["count"] for r in run.diagnostics.where("phase = 'rule'").groupBy("path", "rule").count().collect()}
        for p, (rule, source) in sources.items():
            want = SNIPPETS[int(p[:-4])][2]
            if counts.get((p, rule), 0) != want:
                wrong.append((rule, options, source, want, counts.get((p, rule), 0)))
    assert wrong == []
    assert {s[0] for s in SNIPPETS} == set(RULES)


def sources(spark, **texts):
    return files_from(spark.createDataFrame([(p.replace("_", "."), s) for p, s in texts.items()], "path string, source string"))


def test_directives(spark):
    files = sources(
        spark,
        a_js="// sylva-ignore\n\ndebugger; if (a) {}",
        b_js="// sylva-ignore no-debugger\n\ndebugger; if (a) {}",
        c_js="f();\n// sylva-ignore no-debugger\ndebugger;\ndebugger;",
        d_js="f();\n/* sylva-ignore */\nif (a) { debugger; }\ndebugger;",
        e_js="// sylva-nothing\n// sylva-ignore no-such-rule\nf();",
    )
    run = lint(files)
    got = sorted((r.path, r.phase, r.rule or "", r.line) for r in run.diagnostics.collect())
    assert got == [("b.js", "rule", "no-empty", 2), ("c.js", "rule", "no-debugger", 3), ("d.js", "rule", "no-debugger", 3), ("e.js", "directive", "", 0), ("e.js", "directive", "", 1)]


def test_comments_of_other_tools_mean_nothing(spark):
    files = sources(spark, a_js="// eslint-disable-next-line no-console\nf();", b_js="/* jslint-ignore */ f();", c_js="// sylva-ignore no-debuger\n// sylva-ignoer no-empty\nf();", d_js="// sylva-ignore no-empty\n\n// sylva-ignore no-empty\nif (a) {}")
    got = sorted((r.path, r.severity, r.title) for r in lint(files).diagnostics.collect())
    assert got == [
        ("c.js", "error", "there is no active rule no-debuger, did you mean no-debugger?"),
        ("c.js", "error", "there is no directive ignoer, did you mean ignore?"),
        ("d.js", "warning", "this is redundant: the file already ignores no-empty"),
    ]


def test_long_texts_have_findings_like_short_ones(spark):
    a, many = "a" * 10_000, ", ".join(f"b{i}" for i in range(3000))
    snippets = {
        "no-compare-neg-zero": f"{a} == -0;", "no-invalid-regexp": f"/{a}(/; new RegExp('{a}['); RegExp('\\u005b\\n');", "use-isnan": f"x.indexOf(NaN, {many}); {a} == NaN;",
        "no-debugger": "if (a) {" * 3000 + "debugger;" + "}" * 3000, "no-await-in-loop": "async () => { while (a) { " + "if (b) {" * 300 + f"x = await c + {' + '.join(['d'] * 2000)};" + "}" * 300 + " } }",
        "simplify-regex": f"/{a}[0-9]/",
    }
    files = files_from(spark.createDataFrame([(f"{n}.mjs", s) for n, s in snippets.items()], "path string, source string"))
    run = lint(files, rules={n: {"enforce_for_index_of": True} if n == "use-isnan" else {} for n in snippets})
    counts: dict = {}
    for r in run.diagnostics.collect():
        counts[r.path[:-4], r.rule] = counts.get((r.path[:-4], r.rule), 0) + 1
    assert counts == {(n, n): {"no-invalid-regexp": 3, "use-isnan": 2}.get(n, 1) for n in snippets}


def test_many_lines_and_edits(spark):
    source = "debugger;\n" * 60_000 + "new Symbol();\n" * 2000
    run = lint(sources(spark, a_mjs=source), rules={"no-new-symbol": {}})
    rows = run.diagnostics.orderBy("start").collect()
    assert [(r.line, r.col) for r in rows] == [(60_000 + i, 0) for i in range(2000)]
    assert fix(run).first().source == source.replace("new ", "")


def test_configuration_precedence():
    text = '[rules]\ngroups = ["style"]\nallowed = ["no-empty"]\n[rules.errors]\nno-empty = {}\nnoDebugger = {}\n[rules.warnings]\nno-debugger = {}\nnoCondAssign = { allowParens = false }\nno-debuger = {}\n'
    selected, said = select_rules(parse_config(text))
    assert {n: level for n, (level, _) in selected.items()} == {"no-debugger": "warning", "no-cond-assign": "warning", "block-spacing": "error"}
    assert any("did you mean no-debugger" in s for s in said)
    assert any("no-empty is allowed" in s for s in said)
    assert set(select_rules(None)[0]) == {n for n, r in RULES.items() if r.recommended}
    assert parse_config("not [ toml").problems


def test_levels_outcomes_and_exit_code(spark):
    files = sources(spark, a_js="debugger;", b_js="if (a) {}", c_js="f();", d_js="var = 1;")
    run = lint(files, parse_config('[rules.errors]\nno-debugger = {}\n[rules.warnings]\nno-empty = {}\n'))
    assert {r.path: r.outcome for r in run.outcomes.collect()} == {"a.js": "failure", "b.js": "warning", "c.js": "success", "d.js": "failure"}
    assert totals(run.outcomes).first().text == "Outcome: 2 fail, 1 warn, 1 success"
    assert exit_code(run) == 1
    assert exit_code(lint(files.where("path = 'c.js'"))) == 0
    assert exit_code(lint(files.where("false"))) == 2


def test_fixing_reaches_a_fixpoint(spark):
    rules = {n: {} for n in ("no-extra-semi", "no-new-symbol", "no-compare-neg-zero", "no-unsafe-negation", "block-spacing", "simplify-regex")}
    files = sources(spark, a_js="if (é) {f()};;", b_js="new Symbol(); x === -0; !a in b; /[0-9]{1,}aa/;", c_js="f();;\nvar = 1;", d_js="f();")
    run = lint(files, rules=rules)
    fixed = fix(run)
    assert {r.path: r.source for r in fixed.collect()} == {"a.js": "if (é) { f() }", "b.js": "Symbol(); Object.is(x, -0); !(a in b); /\\d+a{2}/;"}
    again = lint(fixed.drop("passes"), rules=rules)
    assert edits_of(again.diagnostics).count() == 0
    assert "c.js" in {r.path for r in fix(run, dirty=True).collect()}
    assert problems_fixed(run.diagnostics, again.diagnostics).first().fixed >= 6


def test_reports(spark):
    run = lint(sources(spark, a_js="f();\n  debugger;\nif (a) {}"))
    short = [r.text for r in report(run.diagnostics, run.files, "short").orderBy("path", "line_no").collect()]
    assert short == ["2:3  error  a debugger statement  no-debugger", "3:8  error  an empty block        no-empty"]
    long_ = report(run.diagnostics, run.files).orderBy("start").first().text
    assert long_ == "error[no-debugger]: a debugger statement\n  --> a.js:2:3\n2 |   debugger;\n  |   ^^^^^^^^^"
    with pytest.raises(ValueError, match="did you mean short"):
        report(run.diagnostics, run.files, "shrt")
    assert dump_tree(run.nodes).orderBy("pre").first().text == "SCRIPT@0..26"
    assert rule_table(spark).count() == len(RULES) == 32
    assert "no-empty" in explain("no-empty") and "block-spacing" in rules_markdown()
    assert "no-debugger" in config_schema()["properties"]["rules"]["properties"]["errors"]["properties"]


def test_inference(spark):
    run = lint(sources(spark, a_js="if (a) { b() }", b_js="if (a) {b()}", c_js="for (;;) { c() }"))
    assert as_toml(infer_block_spacing(run.nodes)) == '[rules.errors]\nblock-spacing = { style = "always" }\n'


def test_sources(spark, tmp_path):
    for name, text in {"a.js": "a", "b.mjs": "b", "sub/c.ts": "c", "sub/d.txt": "d", "lib/e.js": "e", ".hidden/f.js": "f", "lib/keep.js": "k"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = load_files(spark, str(tmp_path), ignore=["lib/*", "!lib/keep.js", "# no"], root=str(tmp_path))
    assert {(r.name, r.kind) for r in files.collect()} == {("a.js", "script"), ("b.mjs", "module"), ("c.ts", "typescript"), ("keep.js", "script")}
    assert {r.kind for r in load_files(spark, str(tmp_path), override="module").collect()} == {"module"}
    paths = spark.createDataFrame([("a/build/x.js",), ("build.js",), ("a/b.test.js",)], "p string")
    assert [r.x for r in paths.select(ignored(paths["p"], ["build/", "*.test.js"]).alias("x")).collect()] == [True, False, True]
    pages = spark.createDataFrame([(1, '<script>a("</p>")</script><SCRIPT type=x>b</SCRIPT >'), (2, None)], "page_id long, html string")
    assert {(r.path, r.source) for r in scripts_of(pages).collect()} == {("page/1/0.js", 'a("</p>")'), ("page/1/1.js", "b")}


def test_document_stream(spark, tmp_path):
    source, folder = tmp_path / "events", str(tmp_path / "findings")

    def send(_, *rows):
        spark.createDataFrame(rows, "uri string, seq bigint, event string, text string").coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("uri string, seq bigint, event string, text string").parquet(str(source))
        publish(stream, folder, rules={"no-debugger": {}}).awaitTermination()
        return {(r.uri, r.seq, r.rule) for r in current(spark, folder).collect()}

    send(1, ("a.js", 1, "open", "debugger;"), ("b.js", 1, "open", "f();"))
    assert run() == {("a.js", 1, "no-debugger"), ("b.js", 1, None)}
    assert [r.rule for r in actions(current(spark, folder).where("uri = 'a.js'"), 3).collect()] == ["no-debugger"]
    send(2, ("a.js", 2, "change", "f();"), ("b.js", 3, "change", "debugger;"), ("b.js", 2, "change", "f();"))
    assert run() == {("a.js", 2, None), ("b.js", 3, "no-debugger")}
    send(3, ("b.js", 4, "close", None), ("a.js", 1, "change", "debugger;"))
    assert run() == {("a.js", 2, None), ("b.js", 4, None)}
    assert spark.read.parquet(f"{folder}/batch-{2:09d}").select("uri").distinct().count() == 1  # only what a batch touches is written
    compact(spark, folder)
    assert run() == {("a.js", 2, None), ("b.js", 4, None)}
    send(4, ("a.js", 3, "change", "debugger;"))
    assert run() == {("a.js", 3, "no-debugger"), ("b.js", 4, None)}


def test_long_texts(spark):
    long = "a + " * 100 + "b"
    texts = {
        "a.js": "x = /" + "a" * 200 + "(/;", "b.js": "new RegExp('" + "a" * 20_000 + "[');", "c.js": "x = /" + "(" * 400 + "[0-9]" + ")" * 400 + "/;",
        "d.js": f"x = (({long}) === -0);", "e.js": f"x = (-0 < f({long}));",
    }
    files = files_from(spark.createDataFrame(list(texts.items()), "path string, source string"))
    run = lint(files, rules={"no-invalid-regexp": {}, "simplify-regex": {}, "no-compare-neg-zero": {}})
    got = sorted((r.path, r.rule) for r in run.diagnostics.collect())
    assert got == [("a.js", "no-invalid-regexp"), ("b.js", "no-invalid-regexp"), ("c.js", "simplify-regex"), ("d.js", "no-compare-neg-zero"), ("e.js", "no-compare-neg-zero")]
    fixed = {r.path: r.source for r in fix(run).collect()}
    assert fixed["d.js"] == f"x = (Object.is(({long}), -0));" and fixed["c.js"] == "x = /" + "(" * 400 + "\\d" + ")" * 400 + "/;"


def test_a_source_of_any_length_is_parsed(spark):
    source = "/*" + "x" * (4 << 20) + "*/\n" + "f();\n" * 3000 + "debugger;\n"
    run = lint(files_from(spark.createDataFrame([("a.js", source)], "path string, source string")), rules={"no-debugger": {}})
    assert [(r.phase, r.rule, r.line) for r in run.diagnostics.collect()] == [("rule", "no-debugger", 3001)]


def test_an_await_far_down_a_chain_is_in_its_loop(spark):
    chain = " + a" * 700
    texts = {"a.mjs": f"for (;;) {{ x = await f(){chain}; }}", "b.mjs": f"for (;;) {{ g(async () => await f(){chain}); }}", "c.mjs": f"x = await f(){chain};"}
    run = lint(files_from(spark.createDataFrame(list(texts.items()), "path string, source string")), rules={"no-await-in-loop": {}})
    assert [(r.path, r.rule) for r in run.diagnostics.collect()] == [("a.mjs", "no-await-in-loop")]


def test_command_line(spark, tmp_path, capsys):
    import io

    from sylva.__main__ import main
    from sylva.sources.files import ignore_rules

    for name, text in {"a.js": "debugger;;\n", "sub/b.mjs": "if (a) { f(); }\n", "dist/c.js": "debugger;", "sub/keep.js": "debugger;", "sub/drop.js": "debugger;", ".gitignore": "dist/\n*drop.js\n", "sub/.sylvaignore": "/keep.js\n", "sylva.toml": "[rules]\ngroups = ['errors']\n[errors]\nformatter = 'short'\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    assert [n for _, n in ignore_rules(tmp_path)] == [False] * 3
    out = io.StringIO()
    assert main(["lint", str(tmp_path)], spark, out) == 1
    text = out.getvalue()
    assert "a debugger statement" in text and "dist" not in text and "keep" not in text and "drop" not in text and "Outcome: 1 fail, 0 warn, 1 success" in text
    out = io.StringIO()
    assert main(["fix", "--formatter", "long", str(tmp_path)], spark, out) == 1
    assert (tmp_path / "a.js").read_text() == "debugger;\n" and "fixed 1 problems" in out.getvalue()
    out = io.StringIO()
    assert main(["infer", str(tmp_path)], spark, out) == 0 and 'style = "always"' in out.getvalue()
    assert main(["explain", "no-debugger"], spark, out) == 0 and "Recommended: yes" in out.getvalue()
    assert main(["explain", "no-debuger"], spark, out) == 2 and "did you mean no-debugger" in capsys.readouterr().err
    assert main(["rules"], spark, out) == 0 and "valid-typeof" in out.getvalue()
    (tmp_path / "none").mkdir()
    assert main(["lint", "--no-config", str(tmp_path / "none")], spark, out) == 2
    (tmp_path / "more").write_text("a.js\n!keep.js\n")
    out = io.StringIO()
    assert main(["lint", "--ignore-file", str(tmp_path / "more"), "--no-use-gitignore", "--verbose", "--max-threads", "2", str(tmp_path)], spark, out) == 1
    text = out.getvalue()
    assert "a.js" not in text and all(f"{n}.js" in text for n in ("c", "keep", "drop")) and "4 files, " in capsys.readouterr().err
    assert main(["lint", "--ignore-file", str(tmp_path / "missing"), str(tmp_path)], spark, out) == 2
