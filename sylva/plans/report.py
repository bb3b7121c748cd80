"""Reports over diagnostics: long and short text, totals, dumps of tokens and trees, the list of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylva.functions.names import best_match
from sylva.operators.rules import RULES
from sylva.operators.spans import inside
from sylva.plans.snippets import long_report

FORMATTERS = ("long", "short")


def padded(rows: DataFrame, columns: list[str], per: list[str]) -> DataFrame:
    """rows with text columns filled up with blanks to the widest of their group."""
    own = Window.partitionBy(*per)
    wide = rows.withColumns({f"_w_{c}": F.max(F.length(c)).over(own) for c in columns})
    return wide.withColumns({c: F.rpad(c, F.col(f"_w_{c}"), " ") for c in columns}).drop(*[f"_w_{c}" for c in columns])


def short_report(diagnostics: DataFrame) -> DataFrame:
    """path, line_no, text: a line a diagnostic, its columns padded to the widest of the file; lines and columns count from 1."""
    order = Window.partitionBy("path").orderBy("start", "end", "_rule", "title")
    rows = diagnostics.withColumns({"_at": F.concat_ws(":", F.col("line") + 1, F.col("col") + 1), "_rule": F.coalesce("rule", "phase")})
    rows = padded(rows.withColumn("line_no", F.row_number().over(order)), ["_at", "severity", "title"], ["path"])
    return rows.select("path", "line_no", F.concat_ws("  ", "_at", "severity", "title", "_rule").alias("text"))


def report(diagnostics: DataFrame, files: DataFrame, formatter: str = "long") -> DataFrame:
    if formatter not in FORMATTERS:
        near = best_match(list(FORMATTERS), formatter)
        raise ValueError(f"there is no formatter {formatter}" + (f", did you mean {near}?" if near else ""))
    return long_report(diagnostics, files) if formatter == "long" else short_report(diagnostics)


def totals(outcomes: DataFrame) -> DataFrame:
    """One row: failed, warned, succeeded, and the line that says so."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    out = outcomes.agg(n("failure").alias("failed"), n("warning").alias("warned"), n("success").alias("succeeded"))
    return out.withColumn("text", F.format_string("Outcome: %d fail, %d warn, %d success", "failed", "warned", "succeeded"))


def problems_fixed(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many diagnostics fixing removed, counted per file and never below 0."""
    a, b = (d.groupBy("file_id").agg(F.count(F.lit(1)).alias(n)) for d, n in ((before, "a"), (after, "b")))
    return a.join(b, "file_id", "left").agg(F.coalesce(F.sum(F.greatest(F.col("a") - F.coalesce("b", F.lit(0)), F.lit(0))), F.lit(0)).alias("fixed"))


def dump_tree(nodes: DataFrame) -> DataFrame:
    """file_id, pre, text: a line a node, indented by depth."""
    return nodes.select("file_id", "pre", F.concat(F.expr("repeat('  ', depth)"), "kind", F.lit("@"), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string")).alias("text"))


def dump_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.select("file_id", "tok", F.concat("kind", F.lit("@"), F.col("start").cast("string"), F.lit(".."), F.col("end").cast("string"), F.lit(" "), "text").alias("text"))


def rule_table(spark) -> DataFrame:
    """name, group, recommended, options, docs of the built-in rules."""
    rows = [(r.name, r.group, r.recommended, {k: str(v) for k, v in r.options.items()}, r.docs) for r in RULES.values()]
    return spark.createDataFrame(rows, "name string, `group` string, recommended boolean, options map<string,string>, docs string").orderBy("name")


def explain(name: str) -> str:
    if name not in RULES:
        near = best_match(list(RULES), name)
        raise ValueError(f"there is no rule {name}" + (f", did you mean {near}?" if near else ""))
    r = RULES[name]
    options = "".join(f"\n- `{k}` ({v!r})" for k, v in r.options.items())
    return f"# {r.name}\n\n{r.docs}\n\nGroup: {r.group}. Recommended: {'yes' if r.recommended else 'no'}.{options and chr(10) + chr(10) + 'Options:' + options}"


def rules_markdown() -> str:
    """The documentation of all rules by group."""
    out = []
    for group in sorted({r.group for r in RULES.values()}):
        out.append(f"# {group}\n")
        out += [f"| {r.name} | {r.docs.split('.')[0]}. |" for r in sorted(RULES.values(), key=lambda r: r.name) if r.group == group]
    return "\n".join(out)


def config_schema() -> dict:
    """A JSON schema of the configuration."""
    kinds = {bool: "boolean", str: "string", tuple: "array"}
    rules = {r.name: {"type": "object", "properties": {k: {"type": kinds[type(v)]} for k, v in r.options.items()}, "description": r.docs} for r in RULES.values()}
    groups = sorted({r.group for r in RULES.values()})
    return {
        "$schema": "http://json-schema.org/draft-07/schema#", "type": "object",
        "properties": {
            "rules": {"type": "object", "properties": {"errors": {"type": "object", "properties": rules}, "warnings": {"type": "object", "properties": rules}, "groups": {"type": "array", "items": {"enum": groups}}, "allowed": {"type": "array", "items": {"enum": sorted(RULES)}}}},
            "errors": {"type": "object", "properties": {"formatter": {"enum": list(FORMATTERS)}}},
            "parser": {"type": "object", "properties": {"source-type": {"enum": ["script", "module", "typescript", "auto"]}}},
        },
    }


def files_with_findings(diagnostics: DataFrame) -> DataFrame:
    """path of every file that a diagnostic points into."""
    return diagnostics.where("start is not null").select("path").distinct()


def with_children(diagnostics: DataFrame) -> DataFrame:
    """diagnostics with ``children``: those of the same file that lie within them, by start, the widest first."""
    key = ["file_id", "phase", "rule", "start", "end", "title"]
    child = F.struct("start", (-F.col("end")).alias("wide"), "end", F.coalesce("rule", "phase").alias("rule"), "title")
    inner = diagnostics.select("file_id", F.col("start").alias("_at"), child.alias("_d"))
    outer = diagnostics.select(*key)
    pairs = inside(inner, outer.withColumns({"_lo": F.col("start"), "_hi": F.col("end")}), ["file_id"], "_at").where("_d.end <= end and (_d.start > start or _d.end < end)")
    rows = outer.withColumn("_d", F.lit(None).cast(pairs.schema["_d"].dataType)).unionByName(pairs.select(*key, "_d"))
    return rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list("_d")), lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end"), d["rule"].alias("rule"), d["title"].alias("title"))).alias("children"))
