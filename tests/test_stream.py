"""Streams of document events, of the configuration and of settings."""

import shutil

from sylva.streaming.documents import EVENTS, SETTINGS, compact, current, documents, publish


class Editor:
    """Sends events and runs the stream over what has come, anew each time, as after a restart."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.events, self.settings, self.folder, self.options = spark, tmp_path / "events", tmp_path / "settings", str(tmp_path / "findings"), options
        for where, schema in ((self.events, EVENTS), (self.settings, SETTINGS)):
            spark.createDataFrame([], schema).coalesce(1).write.parquet(str(where))

    def send(self, *rows):
        self.spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(str(self.events))
        return self

    def say(self, name, seq, text):
        self.spark.createDataFrame([(name, seq, text)], SETTINGS).coalesce(1).write.mode("append").parquet(str(self.settings))
        return self

    def run(self):
        """What was published, batch by batch."""
        out = []
        read = lambda where, schema: self.spark.readStream.schema(schema).parquet(str(where))
        keep = lambda rows, n: out.append(sorted((r.uri, r.seq, r.rule or "") for r in rows.collect()))
        query = publish(read(self.events, EVENTS), self.folder, keep, settings=read(self.settings, SETTINGS), **self.options)
        query.awaitTermination()
        return [x for x in out if x]

    def now(self):
        return {(r.uri, r.seq, r.rule) for r in current(self.spark, self.folder).collect()}


def test_a_batch_reads_no_earlier_version(spark, tmp_path):
    editor = Editor(spark, tmp_path, rules={"no-debugger": {}}, forget="1ms")
    editor.send(("a.js", 5, "open", "debugger;"), ("b.js", 1, "open", "f();"), ("e.js", 8, "open", "f();"), ("e.js", 9, "close", None)).run()
    for old in [p for p in (tmp_path / "findings").iterdir() if p.name.startswith(("batch-", "docs-"))]:
        shutil.move(str(old), str(tmp_path / f"away-{old.name}"))
    # what is not newer is known from the state, though no version is left to tell
    odd = [(None, 9, "open", "debugger;"), ("c.js", None, "open", "debugger;"), ("d.js", 1, "odd", "debugger;")]
    got = editor.send(("a.js", 5, "change", ""), ("a.js", 2, "close", None), ("b.js", 2, "change", "debugger; debugger;"), ("b.js", 2, "change", ""), *odd).run()
    assert got == [[("b.js", 2, "no-debugger"), ("b.js", 2, "no-debugger")]]
    # the closed document is forgotten by now, the open one isn't
    assert editor.send(("e.js", 1, "open", "debugger;"), ("a.js", 1, "change", "")).run() == [[("e.js", 1, "no-debugger")]]


def test_a_change_of_configuration_lints_open_documents_only(spark, tmp_path):
    editor = Editor(spark, tmp_path, rules={"no-debugger": {}})
    both = "debugger; if (a) {}"
    editor.send(("a.js", 1, "open", both), ("b.js", 1, "open", both), ("c.js", 1, "open", "f();")).run()
    assert editor.send(("b.js", 2, "close", None)).run() == [[("b.js", 2, "")]]
    # interleaved with events: a new document and a change are linted by the new configuration, and so is what is open
    editor.say("config", 1, "[rules.errors]\nno-empty = {}\n").send(("d.js", 1, "open", "// sylva-ignore no-empty\n\nif (a) {}"), ("c.js", 2, "change", both))
    assert [x for rows in editor.run() for x in rows] == [("a.js", 1, "no-empty"), ("c.js", 2, "no-empty"), ("d.js", 1, "")]
    assert editor.now() == {("a.js", 1, "no-empty"), ("b.js", 2, None), ("c.js", 2, "no-empty"), ("d.js", 1, None)}
    compact(spark, editor.folder)
    # older, unreadable or unknown settings change nothing, and nothing is linted again
    assert editor.say("config", 0, "[rules.errors]\nno-debugger = {}\n").say("config", 2, "[[[").say("settings", 1, "no").say("other", 9, "{}").send(("a.js", 2, "change", "if (a) {} // x")).run() == [[("a.js", 2, "no-empty")]]
    assert editor.say("settings", 3, '{"lint": false}').run() == [[("a.js", 2, ""), ("c.js", 2, ""), ("d.js", 1, "")]]
    assert editor.say("settings", 4, '{"directives": false}').run() == [[("a.js", 2, "no-empty"), ("c.js", 2, "no-empty"), ("d.js", 1, "no-empty")]]
    assert {(r.uri, r.seq, r.event) for r in documents(spark, editor.folder).collect()} == {("a.js", 2, "change"), ("b.js", 2, "close"), ("c.js", 2, "change"), ("d.js", 1, "open")}
