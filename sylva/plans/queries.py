"""Driver queries: the relational building blocks over the generated tables, each with its SQL, and the parsing queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.functions.names import name_distance, nearest_names
from sylva.functions.regex_engine import check_patterns
from sylva.operators.directives import apply_ignores
from sylva.operators.edits import map_offsets, overlapping, union_disjoint, without_conflicts
from sylva.operators.navigation import covering, reach, siblings
from sylva.operators.rules import RULES, options_of, repeated
from sylva.operators.spans import inside, tracks
from sylva.operators.syntax import lexed, nodes_of, parsed
from sylva.plans.coverage import coverage
from sylva.plans.infer import infer_block_spacing, merged, mode_largest, votes, winners
from sylva.plans.lint import fix, lint, outcomes_of
from sylva.plans.report import padded, short_report, totals
from sylva.plans.snippets import long_report
from sylva.sources.config import merged_levels, parse_config, with_levels
from sylva.sources.files import files_from, line_starts, located, scripts_of
from sylva.streaming.documents import latest

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query(r"SELECT page_id, i AS n, s AS source, strlen(s)::BIGINT AS n_bytes FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>', 1)) AS s, unnest(range(len(regexp_extract_all(html, '(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>', 1)))) AS i FROM pages)")
def scan_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline scripts of pages as files."""
    files = scripts_of(table(spark, sf_dir, "pages"))
    part = F.split("path", "/")
    return files.select(F.get(part, 1).cast("long").alias("page_id"), F.regexp_extract("path", r"/(\d+)\.js$", 1).cast("long").alias("n"), "source", F.col("n_bytes").cast("long").alias("n_bytes"))


@query("SELECT doc_id, i - 1 AS line, (sum(strlen(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(p) - 1)::BIGINT AS start FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def line_starts_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte offset of every line of every document."""
    return line_starts(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.col("file_id").alias("doc_id"), F.col("line").cast("long").alias("line"), "start")


@query("WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, sum(strlen(p) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(p) - 1 AS start FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS p, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d)), q AS (SELECT doc_id, unnest([0, 1, 2]) AS k, unnest([0, strlen(t) // 2, strlen(t)])::BIGINT AS o FROM d) SELECT q.doc_id, o AS byte_offset, count(*) - 1 AS line FROM q JOIN p ON p.doc_id = q.doc_id AND p.start <= o GROUP BY q.doc_id, k, o")
def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the first, middle and last byte of every document, whatever its characters; null as empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    n = F.octet_length("t").cast("long")
    at = docs.select(F.col("doc_id").alias("file_id"), F.explode(F.array(F.lit(0).cast("long"), F.floor(n / 2), n)).alias("byte_offset"))
    lines = line_starts(docs, "doc_id", "t").select("file_id", "line", F.array("start").alias("starts"), F.lit("").alias("path"))
    return located(at, lines, "byte_offset").select(F.col("file_id").alias("doc_id"), "byte_offset", F.col("line").cast("long").alias("line"))


@query(r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\x{0b}\x{0c}\x{85}\x{a0}\x{1680}\x{180e}\x{feff}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g'))::BIGINT AS n_irregular FROM documents")
def irregular_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule over tokens, with every document as one token: how many findings it has."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = docs.where("text is not null").select(F.col("doc_id").alias("file_id"), F.lit(0).alias("tok"), F.lit("IDENT").alias("kind"), F.lit(0).alias("start"), "text")
    found = RULES["no-irregular-whitespace"].frame(tokens, tokens, options_of(RULES["no-irregular-whitespace"], None)).groupBy("file_id").agg(F.count(F.lit(1)).alias("n_irregular"))
    return docs.join(found, docs["doc_id"] == found["file_id"], "left").select("doc_id", F.coalesce("n_irregular", F.lit(0)).cast("long").alias("n_irregular"))


LEVELS = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error' WHEN 'click' THEN 'warning' ELSE 'note' END"


@query(f"WITH u AS (SELECT user_id, CASE WHEN bool_or(s = 'error') THEN 'failure' WHEN bool_or(s = 'warning') THEN 'warning' ELSE 'success' END AS outcome FROM (SELECT user_id, event_id % 50 AS part, {LEVELS} AS s FROM events) GROUP BY 1, part) SELECT outcome, count(*) AS n FROM u GROUP BY 1")
def outcome_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A3: the worst severity of each of a user's files, and how many files have which outcome."""
    rows = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", F.col("event_id") % 50).alias("path"), F.expr(LEVELS).alias("severity")).withColumn("file_id", F.xxhash64("path"))
    return outcomes_of(rows, rows.select("file_id", "path").distinct()).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH l(event_type, level) AS (VALUES ('purchase', 'warning'), ('click', 'error')) SELECT severity, count(*) AS n FROM (SELECT CASE WHEN s = 'error' THEN coalesce(level, 'error') ELSE s END AS severity FROM (SELECT event_type, {LEVELS} AS s FROM events) LEFT JOIN l USING (event_type)) GROUP BY 1")
def severity_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a type listed as a warning are demoted; nothing is promoted."""
    levels = spark.sql("SELECT * FROM VALUES ('purchase', 'warning'), ('click', 'error') AS l(rule, level)")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), F.expr(LEVELS).alias("severity"))
    return with_levels(rows, levels).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


@query("WITH e AS (SELECT p_partkey AS k, 'error' AS level FROM part WHERE p_size > 25), w AS (SELECT p_partkey AS k, 'warning' AS level FROM part WHERE p_size > 10), u AS (SELECT * FROM e UNION ALL SELECT * FROM w WHERE k NOT IN (SELECT k FROM e)) SELECT level, count(*) AS n, sum(k)::BIGINT AS total FROM u WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = k AND l_quantity >= 50) GROUP BY 1")
def allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists, of which the earlier wins by key, without the keys of a third."""
    part = table(spark, sf_dir, "part")
    first, second = (part.where(f"p_size > {n}").select(F.col("p_partkey").alias("k"), F.lit(level).alias("level")) for n, level in ((25, "error"), (10, "warning")))
    allowed = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("k"))
    return merged_levels([first, second], allowed, "k").groupBy("level").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"))


@query("SELECT o_custkey, o_orderkey, f AS first_orderkey FROM (SELECT *, row_number() OVER w AS n, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)) WHERE n > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later occurrences of a key with the first one."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("pre"), "o_orderpriority", F.col("o_orderkey").alias("start"), F.col("o_orderkey").alias("end"))
    return repeated(rows, ["o_orderpriority"], "'a key that was there before'").select(F.col("file_id").alias("o_custkey"), F.col("pre").alias("o_orderkey"), F.col("first").alias("first_orderkey"))


@query("SELECT l_suppkey, max(s).b AS returnflag FROM (SELECT l_suppkey, {'a': count(*), 'b': l_returnflag} AS s FROM lineitem GROUP BY l_suppkey, l_returnflag) GROUP BY 1")
def mode_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each group, of equally frequent ones the largest."""
    return mode_largest(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_returnflag"), "returnflag")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits derived from line items: an order is a file, a supplier a rule."""
    start = F.col("l_partkey") % 400
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_suppkey") % 7).cast("string").alias("rule"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.repeat(F.lit("x"), F.col("l_linenumber")).alias("insert"))


INTERVALS = "e AS (SELECT DISTINCT l_orderkey AS file_id, (l_suppkey % 7)::VARCHAR AS rule, l_partkey % 400 AS s, l_partkey % 400 + l_quantity::BIGINT AS e, repeat('x', l_linenumber) AS i FROM lineitem)"


@query(f"WITH {INTERVALS}, c AS (SELECT *, coalesce(max(e) OVER (PARTITION BY file_id ORDER BY s, e, rule, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > s, false) AS clash FROM e) SELECT file_id, rule, s AS start, e AS \"end\", i AS \"insert\" FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.clash AND b.file_id = a.file_id AND b.rule = a.rule)")
def overlap_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits without those of rules that clash with an earlier edit of the file."""
    return without_conflicts(intervals(spark, sf_dir))


@query(f"WITH {INTERVALS} SELECT file_id, count(*) FILTER (clash) AS n_clashes FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY file_id ORDER BY s, e, rule, i) > s, false) AS clash FROM e) GROUP BY 1")
def neighbour_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that start before the preceding one ends."""
    return overlapping(intervals(spark, sf_dir).distinct(), neighbours_only=True).groupBy("file_id").agg(F.count_if("clash").alias("n_clashes"))


@query("WITH e AS (SELECT l_orderkey AS file_id, l_linenumber * 100 AS s, l_linenumber * 100 + l_quantity::BIGINT AS e, l_linenumber AS n FROM lineitem), o AS (SELECT o_orderkey AS file_id, unnest([0, 110, 350, 799]) AS byte_offset FROM orders) SELECT o.file_id, byte_offset, CASE WHEN NOT coalesce(bool_or(s < byte_offset AND byte_offset < e), false) THEN byte_offset + coalesce(sum(CASE WHEN e <= byte_offset THEN n - (e - s) ELSE 0 END), 0)::BIGINT END AS mapped FROM o LEFT JOIN e USING (file_id) GROUP BY 1, 2")
def apply_edits_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where bytes are after all edits before them; null inside a deletion."""
    start = (F.col("l_linenumber") * 100).cast("long")
    edits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.repeat(F.lit("x"), F.col("l_linenumber")).alias("insert"))
    offsets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.explode(F.array(*[F.lit(x).cast("long") for x in (0, 110, 350, 799)])).alias("offset"))
    return map_offsets(offsets, edits).withColumnRenamed("offset", "byte_offset")


@query("WITH r AS (SELECT user_id, event_id AS lo, event_id + 2000 AS hi FROM events WHERE event_type = 'error' OR event_id % 97 = 0) SELECT user_id, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.user_id = e.user_id AND e.event_id BETWEEN lo AND hi) GROUP BY 1")
def containment_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that no ignored range of their file holds."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_type").alias("rule"), F.col("event_id").alias("start"), F.col("event_id").alias("end"))
    where = events.where("rule = 'error' or start % 97 = 0").select("file_id", F.lit("ignore").alias("command"), F.lit("node").alias("scope"), F.expr("cast(array() as array<string>)").alias("rules"), F.col("start").alias("node_start"), (F.col("start") + 2000).alias("node_end"))
    return apply_ignores(events, where).groupBy(F.col("file_id").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH m AS (SELECT n_nationkey AS k, substr(n_name, 2) || 'x' AS wrong FROM nation), d AS (SELECT k, wrong, n_name, levenshtein(n_name, wrong) AS dist, greatest(length(wrong), 3) // 3 AS most FROM m, nation) SELECT k, wrong, arg_min(n_name, (dist, n_name)) AS nearest, min(dist)::BIGINT AS distance FROM d WHERE dist <= most GROUP BY 1, 2")
def nearest_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of a bounded list of names to each misspelt one, within a third of its length."""
    nation = table(spark, sf_dir, "nation")
    names = nation.agg(F.collect_set("n_name").alias("names"))  # 25 names: a bounded list
    wrong = nation.select(F.col("n_nationkey").alias("k"), F.concat(F.expr("substring(n_name, 2)"), F.lit("x")).alias("wrong"))
    pairs = wrong.join(F.broadcast(names), F.lit(True)).select("k", "wrong", F.explode("names").alias("name")).withColumn("d", name_distance(F.col("name"), F.col("wrong"))).where("d is not null")
    return pairs.groupBy("k", "wrong").agg(F.min_by("name", F.struct("d", "name")).alias("nearest"), F.min("d").cast("long").alias("distance"))


@query("SELECT r_regionkey, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey AND lower(r_name) = lower(upper(r_name)) GROUP BY 1")
def case_insensitive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F9, first step: names equal but for case."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    named = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.upper("r_name").alias("wrong"), "n_nationkey")
    return named.join(region, F.lower("wrong") == F.lower("r_name")).groupBy("r_regionkey").agg(F.count("n_nationkey").alias("n"))


@query("SELECT event_id, rpad(event_type, max(length(event_type)) OVER (PARTITION BY user_id)::INT, ' ') || '|' AS line FROM events")
def report_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns padded to the widest of their group."""
    rows = padded(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["event_type"], ["user_id"])
    return rows.select("event_id", F.concat("event_type", F.lit("|")).alias("line"))


@query("WITH o AS (SELECT CASE WHEN toxic = 1 THEN 'panicked' WHEN quality = 1 THEN 'passed' ELSE 'failed' END AS o FROM labels) SELECT count(*) FILTER (o = 'passed') AS passed, count(*) FILTER (o = 'failed') AS failed, count(*) FILTER (o = 'panicked') AS panicked, round(100.0 * count(*) FILTER (o = 'passed') / count(*), 2)::DOUBLE AS percentage FROM o")
def coverage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed, failed, panicked and the share that passed."""
    outcome = F.when(F.col("toxic") == 1, "panicked").when(F.col("quality") == 1, "passed").otherwise("failed")
    return coverage(table(spark, sf_dir, "labels").select(outcome.alias("outcome")))


@query("SELECT conv_id, max(turn) AS seq, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def latest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last text of each document."""
    events = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("uri"), F.col("turn").alias("seq"), F.lit("change").alias("event"), "text")
    return latest(events).select(F.col("uri").cast("long").alias("conv_id"), "seq", "text")


@query("SELECT user_id, event_id, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def sibling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next sibling."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.lit(0).alias("parent"), F.col("event_id").alias("ord"), F.col("event_id").alias("pre"), F.col("event_type").alias("kind"))
    return siblings(rows).select(F.col("file_id").alias("user_id"), F.col("pre").alias("event_id"), F.col("prev_kind").alias("before"), F.col("next_kind").alias("after"))


# Every inline script of the pages has one shape, `var t="</p>";track(N);`. One of five lines is added to each, by the page's number,
# so what is found in which page can be written down in SQL.
SCRIPT = r"(SELECT page_id, regexp_extract(html, '(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>', 1) AS s FROM pages WHERE regexp_matches(html, '(?is)<script'))"
ADDED = ("", "\ndebugger;", "\nif (a) {}", "\nx === NaN; y == -0;", "\n// sylva-ignore no-empty\nif (a) {}")


def planted_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = scripts_of(table(spark, sf_dir, "pages"))
    added = F.element_at(F.array(*map(F.lit, ADDED)), (page_of(F.col("path")) % 5 + 1).cast("int"))
    return files_from(files.select("path", F.concat("source", added).alias("source")))


def page_of(path: Column) -> Column:
    return F.get(F.split(path, "/"), 1).cast("long")


@query(f"""WITH k(line, kind, n, extra) AS (VALUES (-1, 'VAR_KW', 1, 3), (-1, 'WHITESPACE', 1, 1), (-1, 'IDENT', 2, 6), (-1, 'EQ', 1, 1), (-1, 'STRING', 1, 6), (-1, 'SEMICOLON', 2, 2), (-1, 'L_PAREN', 1, 1), (-1, 'NUMBER', 1, -20), (-1, 'R_PAREN', 1, 1),
  (1, 'WHITESPACE', 1, 1), (1, 'DEBUGGER_KW', 1, 8), (1, 'SEMICOLON', 1, 1), (2, 'WHITESPACE', 3, 3), (2, 'IF_KW', 1, 2), (2, 'L_PAREN', 1, 1), (2, 'IDENT', 1, 1), (2, 'R_PAREN', 1, 1), (2, 'L_CURLY', 1, 1), (2, 'R_CURLY', 1, 1),
  (3, 'WHITESPACE', 6, 6), (3, 'IDENT', 3, 5), (3, 'EQ3', 1, 3), (3, 'EQ2', 1, 2), (3, 'SEMICOLON', 2, 2), (3, 'MINUS', 1, 1), (3, 'NUMBER', 1, 1), (4, 'WHITESPACE', 4, 4), (4, 'COMMENT', 1, 24), (4, 'IF_KW', 1, 2), (4, 'L_PAREN', 1, 1), (4, 'IDENT', 1, 1), (4, 'R_PAREN', 1, 1), (4, 'L_CURLY', 1, 1), (4, 'R_CURLY', 1, 1))
SELECT kind, sum(n)::BIGINT AS n, sum(CASE WHEN extra < 0 THEN length(s) + extra - 1 ELSE extra END)::BIGINT AS bytes FROM {SCRIPT}, k WHERE line = -1 OR line = page_id % 5 GROUP BY 1""")
def js_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all scripts by kind."""
    toks = lexed(planted_scripts(spark, sf_dir))
    return toks.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("bytes"))


@query(f"""WITH k(line, kind, n) AS (VALUES (-1, 'SCRIPT', 1), (-1, 'VAR_DECL', 1), (-1, 'DECLARATOR', 1), (-1, 'SINGLE_PATTERN', 1), (-1, 'NAME', 1), (-1, 'LITERAL', 2), (-1, 'EXPR_STMT', 1), (-1, 'CALL_EXPR', 1), (-1, 'NAME_REF', 1), (-1, 'ARG_LIST', 1),
  (1, 'DEBUGGER_STMT', 1), (2, 'IF_STMT', 1), (2, 'CONDITION', 1), (2, 'NAME_REF', 1), (2, 'BLOCK_STMT', 1), (3, 'EXPR_STMT', 2), (3, 'BIN_EXPR', 2), (3, 'NAME_REF', 3), (3, 'UNARY_EXPR', 1), (3, 'LITERAL', 1), (4, 'IF_STMT', 1), (4, 'CONDITION', 1), (4, 'NAME_REF', 1), (4, 'BLOCK_STMT', 1))
SELECT kind, sum(n)::BIGINT AS n FROM {SCRIPT}, k WHERE line = -1 OR line = page_id % 5 GROUP BY 1""")
def js_nodes_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P5: nodes of all scripts by kind."""
    return nodes_of(parsed(planted_scripts(spark, sf_dir))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


CONFIG = '[rules]\ngroups = ["errors"]\n[rules.warnings]\nno-empty = {}\n'


@query(f"SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'failure' WHEN 2 THEN 'warning' WHEN 3 THEN 'failure' ELSE 'success' END AS outcome, CASE page_id % 5 WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 0 END::BIGINT AS n_error, CASE page_id % 5 WHEN 2 THEN 1 ELSE 0 END::BIGINT AS n_warning FROM {SCRIPT}")
def lint_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the pages' scripts: outcome per page."""
    run = lint(planted_scripts(spark, sf_dir), parse_config(CONFIG))
    return run.outcomes.select(page_of(F.col("path")).alias("page_id"), "outcome", "n_error", "n_warning")


#: A source, the rule that finds something in it, and what it finds.
SNIPPETS = (
    ("debugger;", "no-debugger", "debugger;"), ("if (a) {}", "no-empty", "{}"), ("foo();;", "no-extra-semi", ";"), ("new Symbol();", "no-new-symbol", "new Symbol()"), ("!a in b;", "no-unsafe-negation", "!a"), ("x == -0;", "no-compare-neg-zero", "x == -0"),
    ("x === NaN;", "use-isnan", "x === NaN"), ("typeof x === 'strnig';", "valid-typeof", "'strnig'"), ("var a = [,1];", "no-sparse-arrays", "[,1]"), ("a = { b: 1, b: 2 };", "no-dupe-keys", "b"), ("switch (a) { case 1: case 1: }", "no-duplicate-cases", "1"),
    ("for (let i = 0; i < 9; i--) { f(i); }", "for-direction", "for (let i = 0; i < 9; i--) { f(i); }"), ("class A extends B { constructor() { this.a = 1; super(); } }", "no-this-before-super", "this"), ("while (true) { f(); }", "no-constant-condition", "true"),
    ("if (!!a) { f(); }", "no-extra-boolean-cast", "!"), ("new RegExp('(');", "no-invalid-regexp", "new RegExp('(')"), ("try { a(); } finally { throw b; }", "no-unsafe-finally", "throw b;"), ("foo.hasOwnProperty('a');", "no-prototype-builtins", "foo.hasOwnProperty('a')"),
    ("if (a = b) { f(); }", "no-cond-assign", "(a = b)"), ("for (const a of b) { await a; }", "no-await-in-loop", "await a"), ("class A extends B { constructor() { f(); } }", "constructor-super", "constructor() { f(); }"), ("a = { get b() { f(); } };", "getter-return", "{ f(); }"),
    ("new Promise(async () => f());", "no-async-promise-executor", "async () => f()"), ("a => b ? c : d;", "no-confusing-arrow", "a => b ? c : d"), ("import a from 'x'; import b from 'x';", "no-duplicate-imports", "import b from 'x';"), ("if (a) { function b() { f(); } }", "no-inner-declarations", "function b() { f(); }"),
    ("a = { set b(c) { return c; } };", "no-setter-return", "{ return c; }"), ("a\n(b);", "no-unexpected-multiline", "a\n(b)"), ("f(1, 2);", "no-irregular-whitespace", " "), ("function* a() { f(); }", "require-yield", "function* a() { f(); }"), ("a = /[0-9]/;", "simplify-regex", "/[0-9]/"), ("if (a) {f(); }", "block-spacing", "{f(); }"),
)


def planted(spark: SparkSession, sf_dir: str, pieces: list[str], suffix: str = "js") -> DataFrame:
    """The pages' scripts, each followed by one of the pieces, by the page's number."""
    files = scripts_of(table(spark, sf_dir, "pages"))
    own = F.element_at(F.array(*map(F.lit, pieces)), (page_of(F.col("path")) % len(pieces) + 1).cast("int"))
    return files_from(files.select(F.regexp_replace("path", "js$", suffix).alias("path"), F.concat("source", F.lit("\n"), own).alias("source")))


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_rows(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else sql_text(x) for x in r) + ")" for r in rows)


@query(f"WITH t(k, rule, found) AS (VALUES {sql_rows((i, r, t) for i, (_, r, t) in enumerate(SNIPPETS))}) SELECT page_id, rule, found FROM {SCRIPT} JOIN t ON page_id % {len(SNIPPETS)} = k")
def rule_hits_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.5: every rule, and what of a page's script it finds."""
    files = planted(spark, sf_dir, [x for x, _, _ in SNIPPETS], "mjs")
    found = lint(files, rules={n: {} for n in RULES}).diagnostics
    text = F.expr("cast(substring(cast(source as binary), start + 1, end - start) as string)")
    return found.join(files.select("file_id", "source"), "file_id").select(page_of(F.col("path")).alias("page_id"), "rule", text.alias("found"))


@query("""SELECT CASE p_partkey % 3 WHEN 0 THEN 'a{' || p_size || ',}' WHEN 1 THEN '[0-9]-' || p_size % 10 ELSE '[a-zA-Z0-9_]-' || p_size % 10 END AS pattern,
CASE p_partkey % 3 WHEN 0 THEN CASE p_size WHEN 0 THEN 'a*' WHEN 1 THEN 'a+' END WHEN 1 THEN '\\d-' || p_size % 10 ELSE '[\\w]-' || p_size % 10 END AS simplified FROM part""")
def simplify_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.15: regular expressions made of parts, written shorter."""
    one = F.expr("case p_partkey % 3 when 0 then concat('a{', p_size, ',}') when 1 then concat('[0-9]-', p_size % 10) else concat('[a-zA-Z0-9_]-', p_size % 10) end")
    return check_patterns(table(spark, sf_dir, "part").select(one.alias("pattern"), F.lit("").alias("flags"))).select("pattern", "simplified")


#: Sources, and what fixing makes of them.
FIXED = (("if (a) {f()};;\n", "if (a) { f() }\n"), ("new Symbol();x == -0;", "Symbol();Object.is(x, -0);"), ("f();", None))


@query(f"SELECT page_id, s || chr(10) || CASE page_id % 3 {' '.join(f'WHEN {k} THEN ' + ' || chr(10) || '.join(map(sql_text, new.split(chr(10)))) for k, (_, new) in enumerate(FIXED) if new)} END AS source FROM {SCRIPT} WHERE page_id % 3 < 2")
def autofix_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.16: pages' scripts after fixing until nothing changes."""
    files = planted(spark, sf_dir, [x for x, _ in FIXED])
    fixed = fix(lint(files, rules={n: {} for n in ("no-extra-semi", "no-new-symbol", "no-compare-neg-zero", "block-spacing")}))
    return fixed.select(page_of(F.col("path")).alias("page_id"), "source")


@query(f"SELECT 'block-spacing' AS rule, CASE WHEN count(*) FILTER (page_id % 3 <> 1) > count(*) FILTER (page_id % 3 = 1) THEN 'always' ELSE 'never' END AS style FROM {SCRIPT}")
def inferred_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options inferred by the votes of all pages' scripts."""
    return infer_block_spacing(nodes_of(parsed(planted(spark, sf_dir, ["if (a) { b() }", "if (a) {b()}", "for (;;) { c() }"]))))


#: Sources, and their lines of the short report.
SHORT = (("debugger;", "2:1  error  a debugger statement  no-debugger"), ("if (a) {}", "2:8  error  an empty block  no-empty"), ("foo();;", "2:7  error  an unneeded semicolon  no-extra-semi"), ("new Symbol();", "2:1  error  Symbol can not be called with new  no-new-symbol"), ("var a = [,1];", "2:9  error  an array literal with holes  no-sparse-arrays"), ("switch (a) { case 1: case 1: }", "2:27  error  the case 1 was there before  no-duplicate-cases"))


@query(f"WITH t(k, text) AS (VALUES {sql_rows((i, t) for i, (_, t) in enumerate(SHORT))}) SELECT page_id, text FROM {SCRIPT} JOIN t ON page_id % {len(SHORT)} = k")
def short_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: the short report of the pages' scripts."""
    return short_report(lint(planted(spark, sf_dir, [x for x, _ in SHORT])).diagnostics).select(page_of(F.col("path")).alias("page_id"), "text")


@query(f"SELECT count(*) FILTER (page_id % 5 IN (1, 3)) AS failed, count(*) FILTER (page_id % 5 = 2) AS warned, count(*) FILTER (page_id % 5 IN (0, 4)) AS succeeded FROM {SCRIPT}")
def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: totals of a run over the pages' scripts."""
    return totals(lint(planted_scripts(spark, sf_dir), parse_config(CONFIG)).outcomes).drop("text")


# Spans of line items: a supplier is a file, an item lies from the day it is shipped to the day it is received.


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = lambda c: F.datediff(F.col(c).cast("date"), F.lit("1990-01-01")).cast("long")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", day("l_shipdate").alias("s"), (day("l_shipdate") + F.col("l_quantity").cast("long")).alias("e"))


SHIPMENTS = "x AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_quantity, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS s, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) + l_quantity::BIGINT AS e FROM lineitem)"


@query(f"""WITH RECURSIVE {SHIPMENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s, e, l_orderkey, l_linenumber) AS n FROM x),
r AS (SELECT l_suppkey, 0::BIGINT AS n, 0::BIGINT AS l_orderkey, 0::BIGINT AS l_linenumber, -1::BIGINT AS track, []::BIGINT[] AS ends FROM (SELECT DISTINCT l_suppkey FROM x)
  UNION ALL SELECT l_suppkey, n, l_orderkey, l_linenumber, t AS track, list_concat(ends[1:t], [e], ends[t + 2:]) AS ends
  FROM (SELECT r.l_suppkey, n.n, n.l_orderkey, n.l_linenumber, n.e, r.ends, coalesce(list_position([z <= n.s FOR z IN r.ends], true) - 1, len(r.ends))::BIGINT AS t FROM r JOIN n ON n.l_suppkey = r.l_suppkey AND n.n = r.n + 1))
SELECT l_orderkey, l_linenumber::INT AS l_linenumber, l_suppkey, track FROM r WHERE n > 0""")
def label_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the rails of the long report: every span of a file on the lowest track that is free."""
    rows = tracks(shipments(spark, sf_dir), ["l_suppkey"], "s", "e", ["l_orderkey", "l_linenumber"])
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", F.col("track").cast("long").alias("track"))


@query(f"WITH {SHIPMENTS}, o AS (SELECT * FROM x WHERE l_quantity >= 45) SELECT o.l_orderkey, o.l_linenumber, count(*) AS n, sum(i.l_quantity)::BIGINT AS quantity FROM o JOIN x i ON i.l_suppkey = o.l_suppkey AND i.s BETWEEN o.s AND o.e AND i.e <= o.e GROUP BY 1, 2")
def spans_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies within each of a file's wide spans."""
    rows = shipments(spark, sf_dir)
    outer = rows.where("l_quantity >= 45").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("s").alias("_lo"), F.col("e").alias("_hi"))
    found = inside(rows.select("l_suppkey", "s", "e", "l_quantity"), outer, ["l_suppkey"], "s").where("e <= _hi")
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


# A tree a region: nations, customers and orders, of which each is as wide as the orders below it.
LEVELS_OF_TREE = ("region", "nation", "customer", "order")


def sales_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"n_regionkey": "file_id", "n_nationkey": "nation", "c_custkey": "customer", "o_orderkey": "order"}
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey")).select(*[F.col(a).alias(b) for a, b in names.items()])
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("file_id").orderBy("nation", "customer", "order")) - 1)
    keys = [["file_id"], ["file_id", "nation"], ["file_id", "nation", "customer"], ["file_id", "nation", "customer", "order"]]
    spans = {f"x{d}": F.struct(F.lit(kind).alias("kind"), F.min("at").over(Window.partitionBy(*k)).alias("start"), (F.max("at").over(Window.partitionBy(*k)) + 1).alias("end")) for d, (kind, k) in enumerate(zip(LEVELS_OF_TREE, keys, strict=True))}
    step = lambda d: F.struct((F.col(f"x{d}.start") * 4 + d).alias("pre"), f"x{d}.kind", f"x{d}.start", f"x{d}.end")
    wide = rows.withColumns(spans)
    levels = [F.struct(step(d).alias("own"), F.lit(d).alias("depth"), F.array(*map(step, range(d))).cast("array<struct<pre:int,kind:string,start:int,end:int>>").alias("path")) for d in range(4)]
    # of each node the row of its first order
    return wide.select("file_id", "at", F.explode(F.array(*levels)).alias("x")).where("x.own.start = at").select("file_id", "x.own.*", "x.depth", "x.path")


@query("""WITH o AS (SELECT n_regionkey AS f, n_nationkey AS n, c_custkey AS c, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey, o_orderkey) - 1 AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
t AS (SELECT f, 'region' AS kind, 0 AS depth, min(p) AS s, max(p) + 1 AS e FROM o GROUP BY f UNION ALL SELECT f, 'nation', 1, min(p), max(p) + 1 FROM o GROUP BY f, n UNION ALL SELECT f, 'customer', 2, min(p), max(p) + 1 FROM o GROUP BY f, n, c UNION ALL SELECT f, 'order', 3, p, p + 1 FROM o),
r AS (SELECT user_id % 5 AS f, event_id, event_id * 37 % 2500 AS lo, event_id * 37 % 2500 + event_id % 97 AS hi FROM events),
j AS (SELECT event_id, r.f, kind, s * 4 + depth AS pre, row_number() OVER (PARTITION BY event_id ORDER BY e - s, depth DESC, s DESC) AS k FROM r JOIN t ON t.f = r.f AND s <= lo AND e >= hi)
SELECT event_id, f::BIGINT AS region, pre::BIGINT AS pre, kind FROM j WHERE k = 1""")
def covering_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest node that covers each of many ranges."""
    at = F.col("event_id") * 37 % 2500
    ranges = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("file_id"), F.col("event_id").alias("range_id"), at.alias("lo"), (at + F.col("event_id") % 97).alias("hi"))
    found = covering(sales_tree(spark, sf_dir).withColumn("file_id", F.col("file_id").cast("long")), ranges.withColumn("file_id", F.col("file_id").cast("long")))
    return found.select(F.col("range_id").alias("event_id"), F.col("file_id").alias("region"), F.col("pre").cast("long").alias("pre"), "kind")


#: Lines added to the scripts of pages, by the page's number, and what the long report says of them after its head.
REPORTED = (
    ("", None, None),
    ("\ndebugger;", "no-debugger]: a debugger statement\n  --> page/{}/0.js:2:1", "2 | debugger;\n  | ^^^^^^^^^"),
    ("\nx = { a: 1, a: 2 };", "no-dupe-keys]: the key a was there before\n  --> page/{}/0.js:2:13", "2 | x = { a: 1, a: 2 };\n  |       - it is here first\n  |             ^"),
    ("\ntry { a(); } finally {\n  throw b;\n}", "no-unsafe-finally]: a throw in a finally block\n  --> page/{}/0.js:3:3", "2 | / try { a(); } finally {\n3 | |   throw b;\n  | |   ^^^^^^^^\n4 | | }\n  | \\_- it leaves this block, and what the try block throws or returns is dropped"),
    ("\nif (typeof a === 'strnig') { a(); }", "valid-typeof]: no type is called so\n  --> page/{}/0.js:2:18", "2 | if (typeof a === 'strnig') { a(); }\n  |                  ^^^^^^^^\n  = note: did you mean string?"),
)


@query(f"""SELECT page_id, CASE page_id % 5 {' '.join(f"WHEN {k} THEN {sql_text('error[' + head.split('{}')[0])} || page_id || {sql_text(head.split('{}')[1] + chr(10) + body)}" for k, (_, head, body) in enumerate(REPORTED) if head)} END AS text FROM {SCRIPT} WHERE page_id % 5 > 0""")
def long_report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: the long report of planted faults: labels on one line, over several lines, and notes."""
    files = scripts_of(table(spark, sf_dir, "pages"))
    added = F.element_at(F.array(*[F.lit(x) for x, _, _ in REPORTED]), (page_of(F.col("path")) % 5 + 1).cast("int"))
    files = files_from(files.select("path", F.concat("source", added).alias("source")))
    return long_report(lint(files).diagnostics, files).select(page_of(F.col("path")).alias("page_id"), "text")


@query("""WITH n AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS total, event_type <> 'error' AS ok FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
f AS (SELECT *, max(CASE WHEN NOT ok THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, min(CASE WHEN NOT ok THEN n END) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM n)
SELECT event_id, (n - 1 - coalesce(b, 0))::BIGINT AS back, (coalesce(a, total + 1) - n - 1)::BIGINT AS ahead FROM f""")
def look_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events without an error lie directly before and after each of a user's."""
    rows = reach(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], F.col("event_type") != "error")
    return rows.select("event_id", F.col("back").cast("long").alias("back"), F.col("ahead").cast("long").alias("ahead"))


@query("""WITH v AS (SELECT l_suppkey, o, v, count(*) AS n FROM (SELECT l_suppkey, 'flag' AS o, l_returnflag AS v FROM lineitem UNION ALL SELECT l_suppkey, 'line', l_linenumber::VARCHAR FROM lineitem UNION ALL SELECT l_suppkey, 'status', l_linestatus FROM lineitem WHERE l_quantity > 25) WHERE v IS NOT NULL GROUP BY 1, 2, 3),
b AS (SELECT l_suppkey, o, max({'n': n, 'v': v}).v AS v FROM v GROUP BY 1, 2)
SELECT l_suppkey, max(CASE WHEN o = 'flag' THEN v END) AS flag, max(CASE WHEN o = 'line' THEN v END) AS line, max(CASE WHEN o = 'status' THEN v END) AS status FROM b GROUP BY 1""")
def several_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several options voted in one pass, of histograms that were made apart and merged."""
    rows = table(spark, sf_dir, "lineitem")
    options = {"flag": F.col("l_returnflag"), "line": F.col("l_linenumber"), "status": F.when(F.col("l_quantity") > 25, F.col("l_linestatus"))}
    parts = [votes(rows.where(f"l_orderkey % 2 = {k}"), ["l_suppkey"], options) for k in (0, 1)]
    found = winners(merged(parts[0].unionByName(parts[1]), ["l_suppkey"]), ["l_suppkey"])
    return found.select("l_suppkey", *[F.col("options")[o].alias(o) for o in options])


UNION = "x AS (SELECT DISTINCT l_orderkey AS file_id, l_linenumber AS k, l_linenumber * 100 AS s, l_linenumber * 100 + l_quantity::BIGINT AS e, l_returnflag AS r FROM lineitem)"


@query(f"WITH {UNION}, a AS (SELECT file_id, min(s) AS s, max(e) AS e FROM x GROUP BY file_id, k) SELECT file_id, count(*) AS n, sum(e - s)::BIGINT AS bytes FROM a GROUP BY 1")
def union_of_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of two rules put together, with overlaps as faults; here those of one place are made one before."""
    start = (F.col("l_linenumber") * 100).cast("long")
    place = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_linenumber", start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"))
    edits = place.groupBy("file_id", "l_linenumber").agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumn("insert", F.lit(""))
    parts = [edits.where(f"l_linenumber % 2 = {k}").withColumn("rule", F.lit(f"r{k}")) for k in (0, 1)]
    return union_disjoint(*parts).groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


@query("""WITH a AS (SELECT DISTINCT p_name || ' ' || p_brand AS name FROM part), s AS (SELECT DISTINCT substr(p_name, 2) || 'x' || substr(p_brand, 3) AS said FROM part),
d AS (SELECT said, name, levenshtein(said, name) AS d FROM s, a WHERE abs(length(said) - length(name)) <= length(said) // 3)
SELECT said, min({'d': d, 'n': name}).n AS nearest, min(d)::BIGINT AS distance FROM d WHERE d <= greatest(length(said), 3) // 3 GROUP BY said""")
def nearest_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of many names to misspelt ones, by segments that are equal."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat("p_name", F.lit(" "), "p_brand").alias("name"))
    said = part.select(F.concat(F.expr("substring(p_name, 2)"), F.lit("x"), F.expr("substring(p_brand, 3)")).alias("said"))
    return nearest_names(said, names).select("said", "nearest", F.col("distance").cast("long").alias("distance"))
