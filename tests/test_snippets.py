"""The long report, and findings and offsets moved by edits."""

import random
import time

import pytest

from sylva.operators.edits import map_offsets, moved
from sylva.plans.lint import edits_of, lint
from sylva.plans.snippets import WIDE, long_report
from sylva.sources.files import files_from
from sylva.streaming.editor import after_fix

FOUND = "file_id long, path string, phase string, rule string, severity string, title string, label string, start int, end int, line int, col int, labels array<struct<start:int,end:int,text:string>>, notes array<string>"


NESTED = "one(\n  two(\n    x\n  )\n)\nsix\nseven();"
LONG = "x" * 5000 + " debugger " + "y" * 5000
#: Name: source, spans (start, end, text) of which the first is the diagnostic's own, its label, notes.
CASES = {
    "room": ("abcdefgh ijklmnop qrstuvwxyz", [(0, 3, ""), (9, 12, "two"), (4, 6, "a long text"), (18, 20, "")], "own", []),
    "rails": (NESTED, [(0, 23, ""), (7, 21, "inner"), (16, 17, "x"), (28, 33, "")], "own", ["n", "m"]),
    "bytes": ("é = 'ü'; yy", [(11, 13, ""), (5, 9, "")], "own", []),
    "long": (LONG, [(5001, 5009, "")], "own", []),
    "empty": ("", [(0, 0, "")], "own", []),
    "last": ("a\n", [(2, 2, "")], None, []),
    "newline": ("a\nb", [(0, 2, "")], "own", []),
    "nulls": (None, [(0, 0, "")], "", None),
}


@pytest.fixture(scope="module")
def shown(spark):
    """The lines below the head of the reports of all cases."""
    files = files_from(spark.createDataFrame([(k, s) for k, (s, *_) in CASES.items()], "path string, source string"))
    ids = {r.path: r.file_id for r in files.collect()}
    rows = []
    for name, (source, spans, label, notes) in CASES.items():
        start, end, _ = spans[0]
        before = (source or "").encode()[:start].decode()
        rows.append((ids[name], name, "rule", "r", "error", "t", label, start, end, before.count("\n"), len(before.rpartition("\n")[2]), None if notes is None else spans[1:], notes))
    return {r.path: r.text.split("\n")[2:] for r in long_report(spark.createDataFrame(rows, FOUND), files).collect()}


def test_labels_share_rows_where_there_is_room(shown):
    assert shown["room"] == ["1 | abcdefgh ijklmnop qrstuvwxyz", "  | ^^^ own  --- two  --", "  |     -- a long text"]


def test_spans_over_lines_run_down_rails(shown):
    assert shown["rails"] == [
        "1 | /  one(", "2 | |/   two(", "3 | ||     x", "  | ||     - x", "4 | ||   )", "  | |\\___- inner", "5 | |  )", "  | \\__^ own", "...", "7 |    seven();", "  |    -----", "  = note: n", "  = note: m",
    ]


def test_bytes_and_characters(shown):
    assert shown["bytes"] == ["1 | é = 'ü'; yy", "  |     ---  ^^ own"]


def test_long_lines_are_cut_around_their_first_mark(shown):
    source, marks = shown["long"]
    assert len(source) == WIDE + 4 and marks == "  | " + " " * 40 + "^" * 8 + " own" and source[44:52] == "debugger"


def test_odd_places(shown):
    assert shown["empty"] == ["1 |", "  | ^ own"]
    assert shown["last"] == ["2 |", "  | ^"]
    assert shown["newline"] == ["1 | a", "  | ^ own"]  # the end of a line has no mark of its own
    assert shown["nulls"] == ["1 |", "  | ^"]


def test_rules_say_where_else_to_look(spark):
    sources = {
        "no-dupe-keys": "x = { a: 1, a: 2 };", "no-await-in-loop": "for (const a of b) { await a; }", "no-unsafe-negation": "!a in b;", "constructor-super": "class A extends B { constructor() { f(); } }",
        "no-this-before-super": "class A extends B { constructor() { this.a = 1; super(); } }", "no-unsafe-finally": "try { a(); } finally { throw b; }", "no-extra-boolean-cast": "if (!!a) { f(); }",
    }
    run = lint(files_from(spark.createDataFrame([(f"{k}.mjs", v) for k, v in sources.items()], "path string, source string")), rules={k: {} for k in sources})
    got = {r.rule: [sources[r.rule][x.start : x.end] for x in r.labels] for r in run.diagnostics.collect()}
    assert got == {
        "no-dupe-keys": ["a"], "no-await-in-loop": ["for (const a of b) { await a; }"], "no-unsafe-negation": ["b"], "constructor-super": ["B"],
        "no-this-before-super": ["super()"], "no-unsafe-finally": ["finally { throw b; }"], "no-extra-boolean-cast": ["(!!a)"],
    }
    said = lint(files_from(spark.createDataFrame([("a.js", "typeof a === 'objekt'; typeof a === 'somethingelse'")], "path string, source string"))).diagnostics.orderBy("start").collect()
    assert [r.notes for r in said] == [["did you mean object?"], []]


def random_edits(r, n, wide):
    edits, at = [], 0
    while len(edits) < n:
        at += r.randrange(0, wide)
        end = at + r.randrange(0, 4)
        edits.append((1, at, end, "x" * r.randrange(4)))
        at = end + r.randrange(0, 2)
    return edits


def test_offsets_after_edits_are_those_of_the_new_text(spark):
    r = random.Random(6)
    for width in (None, 7):
        edits = random_edits(r, 60, 6)
        offsets = [(1, x, x) for x in range(0, 320)] + [(2, 5, 5), (1, 3, 999), (1, 3, 999)]
        e = spark.createDataFrame(edits, "file_id long, start int, end int, insert string")
        got = map_offsets(spark.createDataFrame(offsets, "file_id long, offset int, n int"), e, width).collect()

        def brute(at):
            inside = any(s < at < e for _, s, e, _ in edits)
            return None if inside else at + sum(len(i) - (e - s) for _, s, e, i in edits if e <= at)

        assert sorted((x.file_id, x.offset, x.n, x.mapped) for x in got if x.mapped is not None) == sorted((f, o, n, o if f == 2 else brute(o)) for f, o, n in offsets if f == 2 or brute(o) is not None)
        assert len(got) == len(offsets)


def test_offsets_after_many_edits_are_linear(spark):
    """10,000 edits by 10,000 offsets of one file: the join of both would have a hundred million rows."""
    edits = spark.range(10_000).selectExpr("1L as file_id", "cast(id * 10 as int) as start", "cast(id * 10 + 3 as int) as end", "repeat('x', cast(id % 7 as int)) as insert")
    offsets = spark.range(10_000).selectExpr("1L as file_id", "cast(id * 10 + 5 as int) as offset")
    plan = map_offsets(offsets, edits)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    began = time.time()
    got = map_offsets(offsets, edits).orderBy("offset").collect()
    moved_by = 0
    for i, row in enumerate(got):
        moved_by += i % 7 - 3
        assert row.mapped == i * 10 + 5 + moved_by
    assert time.time() - began < 30


def test_findings_move_with_edits(spark):
    spans = spark.createDataFrame([(1, "a", 0, 2), (1, "b", 4, 6), (1, "c", 10, 12), (1, "c", 10, 12), (2, "d", 3, 4)], "file_id long, rule string, start int, end int")
    edits = spark.createDataFrame([(1, 2, 3, "xyz"), (1, 5, 5, "!"), (1, 8, 9, "")], "file_id long, start int, end int, insert string")
    assert {tuple(x) for x in moved(spans, edits).collect()} == {(1, "a", 0, 2), (1, "c", 12, 14), (2, "d", 3, 4)}
    run = lint(files_from(spark.createDataFrame([("a.js", "f();;\ndebugger;")], "path string, source string")))
    left = after_fix(run.diagnostics, edits_of(run.diagnostics)).collect()
    assert [(x.rule, x.start, x.end) for x in left if x.rule == "no-debugger"] == [("no-debugger", 5, 14)]
