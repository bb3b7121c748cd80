"""Navigation, coverage, editor lookups, edits and numbers."""

import pytest

from sylva.functions.numbers import parse_number
from sylva.functions.positions import byte_offset, utf16_column
from sylva.operators import navigation as N
from sylva.operators.edits import apply_edits, map_offsets, overlapping, without_conflicts
from sylva.operators.syntax import lexed
from sylva.plans.coverage import coverage, run
from sylva.plans.coverage import test_files as suite_files
from sylva.plans.lint import lint
from sylva.plans.queries import ORACLES, QUERIES
from sylva.sources.files import files_from
from sylva.streaming.editor import completions, hover, quick_fixes


@pytest.fixture(scope="module")
def tree(spark):
    return lint(files_from(spark.createDataFrame([("a.js", "#!/x\nif (é) { f(1, 2) } // c\nf(1, 2);\n")], "path string, source string")))


def test_navigation(spark, tree):
    nodes, tokens = tree.nodes.persist(), tree.tokens.persist()
    by = {r.pre: r for r in nodes.collect()}
    assert {(r.pre, r.p_kind) for r in N.parents(nodes).collect()} == {(p, by[r.parent].kind) for p, r in by.items() if r.parent >= 0}
    assert {(r.pre, r.ancestor) for r in N.ancestors(nodes).collect()} == {(p, a) for p in by for a in by if a < p <= by[a].post}
    assert sum(len(r.children) for r in N.children(nodes).collect()) == len(by) - 1
    assert all((r.prev_pre is None) == (r.ord == 0) for r in N.siblings(nodes).where("parent >= 0").collect())
    block = nodes.where("kind = 'BLOCK_STMT'")
    assert {r.kind for r in N.descendants(nodes, block).collect()} == {"EXPR_STMT", "CALL_EXPR", "NAME_REF", "ARG_LIST", "LITERAL"}
    assert N.pruned(nodes, block).count() == nodes.count() - N.descendants(nodes, block).count()
    walk = [(r.event, r.pre) for r in N.preorder(nodes).orderBy("step").collect()]
    assert len(walk) == 2 * len(by) and [p for e, p in walk if e == "enter"] == sorted(by)
    stack = []
    for event, pre in walk:
        if event == "enter":
            stack.append(pre)
        else:
            assert stack.pop() == pre
    file_id = next(iter(by.values())).file_id
    ranges = spark.createDataFrame([(file_id, 1, 15, 16), (file_id, 2, 0, 50)], "file_id long, range_id int, lo int, hi int")
    assert {(r.range_id, r.kind) for r in N.covering(nodes, ranges.where("range_id = 1")).collect()} == {(1, "NAME_REF")}
    calls = nodes.where("kind = 'CALL_EXPR'")
    assert N.lexically_equal(calls.where("lexh is not null"), calls).count() == 2
    assert N.tokens_equal(calls, "f ( 1 , 2 )").count() == 2
    assert N.lossy(tokens).count() < tokens.count() == N.neighbours(tokens).count()
    assert [(r.kind, r.content) for r in N.comments(tokens).collect()] == [("line", " c")]
    assert {r.kind for r in N.tokens_at(tokens, ranges.selectExpr("file_id", "lo as offset").where("offset = 15")).collect()} >= {"IDENT"}
    assert N.tokens_in(tokens, block, trivia=False).count() == 8
    assert nodes.where(N.nearest(("IF_STMT",)).isNotNull()).count() == by[1].post - 1
    assert nodes.where(N.child_with_kind("ARG_LIST").isNotNull()).count() == 2


def test_neighbours_and_trivia(spark, tree):
    nodes, tokens = tree.nodes, tree.tokens
    root = nodes.where("depth = 1").orderBy("ord").collect()
    first = nodes.where(f"pre = {root[0].pre}")
    assert [(r.distance, r.sibling) for r in N.siblings_towards(nodes, first).orderBy("distance").collect()] == [(i, r.pre) for i, r in enumerate(root) if i]
    assert N.siblings_towards(nodes, first, forward=False).count() == 0
    assert {r.name for r in nodes.where("kind in ('IF_STMT', 'CALL_EXPR')").select(N.readable_name(nodes["kind"]).alias("name")).collect()} == {"if statement", "call expression"}
    assert nodes.where(N.is_loop(nodes["kind"])).count() == 0
    rows = N.with_trivia(tokens).collect()
    assert [t.text for r in rows if r.text == "}" for t in r.trailing] == [" ", "// c", "\n"]
    held = N.with_trivia(tokens).where("text = '}'").select(N.until_comment("trailing", False).alias("near"), N.until_comment("leading", True).alias("before")).first()
    assert [t.text for t in held.near] == [" "] and [t.text for t in held.before] == [" "]


def test_assigned_values_and_children(spark):
    from sylva.operators.edits import disjoint, eating_whitespace
    from sylva.plans.report import files_with_findings, with_children

    run_ = lint(files_from(spark.createDataFrame([("a.js", "x += f(1);  y = 2;"), ("b.js", "if (a = b) { debugger; ; }")], "path string, source string")), rules={"no-cond-assign": {}, "no-debugger": {}, "no-extra-semi": {}})
    assert {r.value for r in N.assigned_values(run_.nodes.where("kind = 'ASSIGN_EXPR'")).collect()} >= {"x + f(1)", "2"}
    assert [r.path for r in files_with_findings(run_.diagnostics).collect()] == ["b.js"]
    d = spark.createDataFrame([(1, "rule", "a", 0, 9, "t"), (1, "rule", "b", 2, 3, "u"), (1, "rule", "c", 2, 8, "v"), (2, "rule", "d", 2, 3, "w")], "file_id long, phase string, rule string, start int, end int, title string")
    assert {r.rule: [c.rule for c in r.children] for r in with_children(d).collect()} == {"a": ["c", "b"], "b": [], "c": ["b"], "d": []}
    e = spark.createDataFrame([(1, "r", 0, 2, ""), (1, "r", 1, 3, ""), (2, "r", 10, 11, "")], "file_id long, rule string, start int, end int, insert string")
    assert {r.file_id: r.disjoint for r in disjoint(e).collect()} == {1: False, 2: True}
    source = run_.files.where("path = 'a.js'").first()
    cut = spark.createDataFrame([(source.file_id, "r", 9, 10, "")], "file_id long, rule string, start int, end int, insert string")
    assert [(r.start, r.end) for r in eating_whitespace(cut, run_.tokens).collect()] == [(9, 12)]


def test_running_positions(spark):
    rows = N.running_positions(lexed(spark.createDataFrame([(1, "é = 'x'")], "file_id long, source string"))).orderBy("tok").collect()
    assert [(r.start, r.end) for r in rows] == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 8)]


def test_lexed_lengths(spark):
    rows = lexed(spark.createDataFrame([(1, "é = 'x'"), (2, None)], "file_id long, source string")).orderBy("tok").collect()
    assert [(r.kind, r.len) for r in rows] == [("IDENT", 2), ("WHITESPACE", 1), ("EQ", 1), ("WHITESPACE", 1), ("STRING", 3)]


def test_edits(spark):
    edits = [(1, "a", 0, 2, "x"), (1, "b", 1, 3, "y"), (1, "c", 4, 4, "é"), (2, "w", 0, 9, ""), (2, "v", 1, 2, "z"), (2, "u", 5, 6, "z"), (3, "q", 1, 3, "")]
    e = spark.createDataFrame(edits, "file_id long, rule string, start int, end int, insert string")
    assert {(r.file_id, r.rule) for r in without_conflicts(e).collect()} == {(1, "a"), (1, "c"), (2, "w"), (3, "q")}
    assert {r.rule for r in overlapping(e, neighbours_only=True).where("clash").collect()} == {"b", "v"}
    files = spark.createDataFrame([(1, "abcdef"), (2, "abcdefghi"), (3, "aébc"), (4, "x")], "file_id long, source string")
    assert {r.file_id: r.source for r in apply_edits(files, without_conflicts(e)).collect()} == {1: "xcdéef", 2: "", 3: "abc"}
    at = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (1, 6), (4, 5)], "file_id long, offset int")
    assert {(r.file_id, r.offset): r.mapped for r in map_offsets(at, without_conflicts(e)).collect()} == {(1, 0): 0, (1, 1): None, (1, 2): 1, (1, 6): 7, (4, 5): 5}


def test_coverage(spark):
    head = "/*---\ndescription: x\n{}---*/\n"
    tests = [("a.js", head.format("") + "f();"), ("b.js", head.format("negative:\n  phase: parse\n") + "var = 1"), ("c.js", head.format("flags: [module]\n") + "import a from 'b'"), ("d.js", head.format("features: [x]\n") + "("), ("e.js", head.format("flags: [onlyStrict]\n") + "("), ("f.js", "no front matter")]
    files = suite_files(files_from(spark.createDataFrame(tests, "path string, source string")))
    got = {(r.path, r["mode"]): r.outcome for r in run(files).collect()}
    assert got == {("a.js", "strict"): "passed", ("a.js", "sloppy"): "passed", ("b.js", "strict"): "passed", ("b.js", "sloppy"): "passed", ("c.js", "module"): "passed", ("e.js", "strict"): "failed"}
    row = coverage(run(files)).first()
    assert (row.passed, row.failed, row.percentage) == (5, 1, 83.33)


def test_editor_lookups(spark):
    run_ = lint(files_from(spark.createDataFrame([("a.js", "#!/x\nf();\n// sylva-ignore no-empty\nif (a) {}\nf();;")], "path string, source string")))
    assert hover(run_.directives, run_.files, "a.js", 15).first().rules == ["no-empty"]
    assert hover(run_.directives, run_.files, "a.js", 0).count() == 0
    assert completions(spark, "no-deb").first().label == "no-debugger"
    d = run_.diagnostics.where("rule = 'no-extra-semi'").first()
    fixes = {(r.start, r.insert) for r in quick_fixes(run_.diagnostics, run_.files, "a.js", d.start, d.end).collect()}
    assert fixes == {(d.start, ""), (5, "// sylva-ignore no-extra-semi\n\n")}


def test_positions(spark):
    line = spark.createDataFrame([("aé𝄞b",)], "s string")
    assert [line.select(utf16_column(line["s"], line["s"].isNull().cast("int"), line["s"].isNotNull().cast("int") * n).alias("x")).first().x for n in (0, 1, 3, 7, 8)] == [0, 1, 2, 4, 5]
    assert [byte_offset("aé𝄞b", n) for n in (0, 1, 2, 4, 5, 99)] == [0, 1, 3, 7, 8, 8]


@pytest.mark.parametrize(("text", "value"), [("0x1F", ("float", 31.0)), ("1_000", ("float", 1000.0)), ("0b11n", ("bigint", 3)), ("017", ("float", 15.0)), ("08", ("float", 8.0)), (".5e1", ("float", 5.0)), ("1__0", None), ("0o8", None), ("05n", None), ("123456789012345678901234567890n", ("bigint", 123456789012345678901234567890))])
def test_numbers(text, value):
    assert parse_number(text) == value


def test_sinks(spark, tree, tmp_path):
    from sylva.plans.sinks import highlighted, write_sources

    write_sources(tree.files, str(tmp_path))
    assert (tmp_path / "a.js").read_text().startswith("#!/x\nif (é)")
    text = highlighted(tree.tokens).first().text
    assert "\x1b[35mif\x1b[0m" in text and "\x1b[90m// c\x1b[0m" in text
    import re

    assert re.sub(r"\x1b\[\d+m", "", text) == tree.files.first().source


def test_fragments():
    from sylva.functions.parser import parse_expression
    from sylva.functions.regex_engine import capture_groups

    root, parser = parse_expression("a + b * c")
    assert (root.kind, root.op, parser.errors) == ("BIN_EXPR", "+", [])
    assert parse_expression("a b")[1].errors and parse_expression("")[1].errors
    assert capture_groups("(a)(?:b)(?<c>d)[(]") == (2, ["c"])


def test_edit_builders(spark):
    from pyspark.sql import functions as F

    from sylva.operators import edits as E

    files = spark.createDataFrame([(1, "abcdef")], "file_id long, source string")
    at = [F.lit(x) for x in range(7)]
    cases = {"aXef": E.replace(at[1], at[4], F.lit("X")), "abXcdef": E.insert(at[2], F.lit("X")), "af": E.delete(at[1], at[5]), "a(bc)def": E.wrap(at[1], at[3]), "cd": E.unwrap(at[0], at[6], at[2], at[4])}
    for want, fixes in cases.items():
        e = files.select("file_id", F.lit("r").alias("rule"), F.explode(fixes).alias("f")).select("file_id", "rule", "f.*")
        assert apply_edits(files, e).first().source == want
    assert files.select(F.size(E.unless_commented(E.delete(at[0], at[1]), F.lit(True))).alias("n")).first().n == 0


def test_reload(spark):
    from sylva.sources.files import reload

    files = files_from(spark.createDataFrame([("a.js", "x"), ("b.js", "y")], "path string, source string"))
    assert {(r.path, r.source, r.n_bytes) for r in reload(files, "a.js", "new").collect()} == {("a.js", "new", 3), ("b.js", "y", 1)}


def test_lines_of_offsets_in_all_documents(spark, tmp_path):
    texts = ["", None, "a\nb", "é\n" * 9, "日本\n語\n\U0001f600", "\n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in QUERIES["offset_to_line"](spark, str(tmp_path)).collect()]
    want = [(i, at, b[:at].count(b"\n")) for i, b in enumerate((t or "").encode() for t in texts) for at in (0, len(b) // 2, len(b))]
    assert sorted(got) == sorted(want)
    duckdb = pytest.importorskip("duckdb")
    documents = duckdb.read_parquet(f"{tmp_path}/documents.parquet/*.parquet")  # noqa: F841
    assert sorted(duckdb.sql(ORACLES["offset_to_line"]).fetchall()) == sorted(want)


def test_scratch_tables_are_removed(spark):
    from pathlib import Path

    from sylva.session import scratch, shared_dir, shared_table

    folder = Path(shared_dir(spark).removeprefix("file://"))
    with scratch(spark):
        assert shared_table(spark.range(3), "scratch-test").count() == 3
        assert list(folder.glob("sylva-scratch-test-*"))
    assert not list(folder.glob("sylva-scratch-test-*"))


def test_union_of_edits_fails_on_overlap(spark):
    from sylva.operators.edits import union_disjoint

    schema = "file_id long, rule string, start int, end int, insert string"
    a = spark.createDataFrame([(1, "a", 0, 9, ""), (2, "a", 0, 4, "")], schema)
    fits = spark.createDataFrame([(1, "b", 9, 12, "x"), (2, "a", 0, 4, ""), (2, "b", 4, 4, "y")], schema)
    assert union_disjoint(a, fits).count() == 4 and union_disjoint(a, fits).schema == a.schema
    for clash in ((1, "b", 8, 9, ""), (1, "b", 3, 4, "")):
        with pytest.raises(Exception, match=rf"file 1: the edit of b at {clash[2]}..{clash[3]} overlaps that of a at 0..9"):
            union_disjoint(a, spark.createDataFrame([clash], schema)).collect()


def test_reach(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate("t.tt..ttt")] + [(2, 0, "t"), (3, 0, None), (3, 1, "t")], "k int, n int, x string")
    got = sorted((r.k, r.n, r.back, r.ahead) for r in N.reach(rows, ["k"], ["n"], rows["x"] == "t").collect())
    text = "t.tt..ttt"
    back = [len(text[:i]) - len(text[:i].rstrip("t")) for i in range(9)]
    ahead = [len(text[i + 1 :]) - len(text[i + 1 :].lstrip("t")) for i in range(9)]
    assert got == [(1, i, back[i], ahead[i]) for i in range(9)] + [(2, 0, 0, 0), (3, 0, 0, 1), (3, 1, 0, 0)]
    tokens = spark.createDataFrame([(1, 0, False), (1, 1, True), (1, 2, True), (1, 3, False)], "file_id long, tok int, is_trivia boolean")
    assert sorted((r.tok, r.back, r.ahead) for r in N.trivia_around(tokens).collect()) == [(0, 0, 2), (1, 0, 1), (2, 1, 0), (3, 2, 0)]


def test_votes_merge(spark):
    from sylva.plans.infer import merged, votes, winners

    rows = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "b", None), ("r", None, 2), ("s", "a", 1), ("s", "b", 3)], "rule string, x string, y int")
    options = {"x": rows["x"], "y": rows["y"]}
    whole = {r.rule: r.options for r in winners(votes(rows, ["rule"], options), ["rule"]).collect()}
    assert whole == {"r": {"x": "b", "y": "2"}, "s": {"x": "b", "y": "3"}}
    parts = [votes(rows.where(f"coalesce(y, 0) % 2 = {k}"), ["rule"], options) for k in (0, 1)]
    assert {r.rule: r.options for r in winners(merged(parts[0].unionByName(parts[1]), ["rule"]), ["rule"]).collect()} == whole


def test_files_that_are_left_out_are_never_opened(spark, tmp_path):
    from sylva.sources.files import load_files

    for n in range(40):
        for folder in ("node_modules/x", "src", ".git"):
            (tmp_path / folder).mkdir(parents=True, exist_ok=True)
            (tmp_path / folder / f"f {n}+%.js").write_text("x" * 100)
    files = load_files(spark, str(tmp_path), ignore=["node_modules/", "f 1*"], root=str(tmp_path))
    assert {r.name for r in files.collect()} == {f"f {n}+%.js" for n in range(40) if not str(n).startswith("1")}
    leaves = files._jdf.queryExecution().executedPlan().collectLeaves()
    files._jdf.queryExecution().executedPlan().executeCollect()
    assert [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())] == [29]


def test_a_failing_task_leaves_every_target_as_it_was(spark, tmp_path):
    from sylva.plans.sinks import write_sources

    (tmp_path / "sub").mkdir()
    for n in range(6):
        (tmp_path / "sub" / f"{n}.js").write_text("old")
    rows = spark.createDataFrame([(f"{tmp_path}/sub/{n}.js", f"new {n}") for n in range(6)], "path string, source string").repartition(6, "path")
    failing = rows.selectExpr("path", "if(path like '%/3.js', cast(raise_error('no') as string), source) as source")
    with pytest.raises(Exception, match="no"):
        write_sources(failing, str(tmp_path), in_place=True)
    assert {p.read_text() for p in (tmp_path / "sub").iterdir()} == {"old"}
    write_sources(rows, str(tmp_path), in_place=True)
    assert {p.name: p.read_text() for p in (tmp_path / "sub").iterdir()} == {f"{n}.js": f"new {n}" for n in range(6)}
    assert len([p for p in tmp_path.iterdir() if p.name != "sub"]) <= 1  # of the failed job at most
    write_sources(spark.createDataFrame([("a/é.js", "ü\n"), ("/b.js", None)], "path string, source string"), f"file://{tmp_path}/out")
    assert (tmp_path / "out/a/é.js").read_text() == "ü\n" and (tmp_path / "out/b.js").read_text() == ""
    write_sources(rows.limit(0), str(tmp_path / "out"))


def test_nearest_of_many_names_is_exact(spark):
    import random

    from sylva.functions.names import levenshtein, nearest_names

    r = random.Random(3)
    names = ["", "a", "ab", "é", "abc"] + ["".join(r.choices("abcé", k=r.randrange(1, 16))) for _ in range(150)]
    said = ["", "b", "ba", "xyz"] + ["".join(r.choices("abcé", k=r.randrange(0, 18))) for _ in range(80)] + names[:20]
    frames = [spark.createDataFrame([(x,) for x in (*values, None)], f"{c} string") for values, c in ((said, "said"), (names, "name"))]
    found = nearest_names(*frames)
    want = {}
    for s in said:
        near = [(d, n) for n in names if (d := levenshtein(s, n)) <= max(len(s), 3) // 3]
        if near:
            want[s] = min(near)
    assert {x.said: (x.distance, x.nearest) for x in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
