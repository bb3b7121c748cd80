"""A lint run: sources to diagnostics, outcomes and fixed sources.

    run = lint(files)                  # files of sylva.sources.files
    run.diagnostics, run.outcomes      # DataFrames
    fixed = fix(run)                   # file_id, path, source, passes

A source is parsed once, in one pass that keeps the nodes which the selected rules look at, and the starts of lines; these rows are
written as a table of the shared folder, and every rule reads only the columns it needs. All tokens and nodes are another pass, made
when they are asked for.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.operators import rules as R
from sylva.operators.directives import apply_ignores, directive_errors, parse_directives, redundant
from sylva.operators.edits import apply_edits, without_conflicts
from sylva.operators.syntax import errors_of, lines_of, nodes_of, parsed, paths_of, tokens_of
from sylva.session import shared_table
from sylva.sources.config import Config, select_rules
from sylva.sources.files import located

NONE = (("file_id", "bigint"), ("rule", "string"), ("pre", "int"), ("start", "int"), ("end", "int"), ("title", "string"), ("label", "string"), ("fixes", R.FIXES), *R.MORE)
PASSES = 11  # how often fixing goes round at most


@dataclass
class LintRun:
    files: DataFrame
    directives: DataFrame
    diagnostics: DataFrame  # file_id, path, phase, rule, severity, title, label, start, end, fixes, labels (start, end, text), notes, line, col
    outcomes: DataFrame  # file_id, path, outcome, n_error, n_warning
    selected: dict[str, tuple[str, dict]] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)

    @cached_property
    def trees(self) -> DataFrame:
        """All rows of the files, parsed anew."""
        return shared_table(parsed(self.files), "trees", partition="what")

    @property
    def tokens(self) -> DataFrame:
        return tokens_of(self.trees)

    @property
    def nodes(self) -> DataFrame:
        return nodes_of(self.trees)


def outcomes_of(diagnostics: DataFrame, files: DataFrame) -> DataFrame:
    """Per file: failure if any diagnostic is an error, else warning if any is one, else success."""
    counts = diagnostics.groupBy("file_id").agg(F.count_if(F.col("severity") == "error").alias("n_error"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
    joined = files.select("file_id", "path").join(counts, "file_id", "left").fillna(0, ["n_error", "n_warning"])
    outcome = F.when(F.col("n_error") > 0, "failure").when(F.col("n_warning") > 0, "warning").otherwise("success")
    return joined.select("file_id", "path", outcome.alias("outcome"), "n_error", "n_warning")


def lint(files: DataFrame, config: Config | None = None, rules: dict[str, dict] | None = None, directives: bool = True) -> LintRun:
    """rules: names to options, instead of a configuration; without either the recommended rules run."""
    selected, said = ({n: ("error", o) for n, o in rules.items()}, []) if rules is not None else select_rules(config)
    if config is not None and config.source_type:
        files = files.withColumn("kind", F.lit(config.source_type))
    rules_ = {n: o for n, (_, o) in selected.items()}
    trees = shared_table(parsed(files, R.needs_of(rules_)), "findings", partition="what")
    nodes, tokens = nodes_of(trees), tokens_of(trees)
    none = [F.expr(f"cast(array() as {t})").alias(c) for c, t in (("fixes", R.FIXES), *R.MORE)]
    about = lambda phase, df, severity="error": df.select("file_id", F.lit(phase).alias("phase"), F.lit(None).cast("string").alias("rule"), F.lit(severity).alias("severity"), "title", F.lit("").alias("label"), "start", "end", *none)
    parts = [about("parse", errors_of(trees))]
    any_tokens = tokens.limit(1).count() > 0  # only files with steering comments or odd characters have tokens here
    steering = parse_directives(tokens, nodes)
    if any_tokens:
        steering = shared_table(steering, "directives")
    if selected:
        # The large expressions of the row rules run by themselves, in a job without a shuffle.
        single = R.row_findings(nodes, rules_)
        several = R.other_findings(nodes, tokens if any_tokens else None, rules_)
        found = reduce(DataFrame.unionByName, [*([] if single is None else [shared_table(single, "hits")]), *several]) if several or single is not None else nodes.limit(0).select(*[F.lit(None).cast(t).alias(c) for c, t in NONE])
        levels = F.create_map(*[F.lit(x) for n, (level, _) in selected.items() for x in (n, level)])
        kept = (apply_ignores(found, steering) if directives and any_tokens else found).dropDuplicates(["file_id", "rule", "start", "end", "title"])
        parts.append(kept.select("file_id", F.lit("rule").alias("phase"), "rule", levels[F.col("rule")].alias("severity"), "title", "label", "start", "end", "fixes", "labels", "notes"))
    if directives and any_tokens:
        parts.append(about("directive", directive_errors(steering, sorted(selected))))
        if selected:
            parts.append(about("directive", redundant(steering, found), "warning"))
    found = reduce(DataFrame.unionByName, parts)
    lines = lines_of(trees)
    diagnostics = shared_table(located(found, lines), "diagnostics")
    return LintRun(files, steering, diagnostics, outcomes_of(diagnostics, paths_of(trees)), selected, said)


def edits_of(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.where("size(fixes) > 0").select("file_id", "rule", F.explode("fixes").alias("f")).select("file_id", "rule", "f.*")


def fix(run: LintRun, dirty: bool = False, passes: int = PASSES) -> DataFrame:
    """file_id, path, kind, source, passes of every file that fixes change: applied, parsed and linted again until nothing is left.

    Files with syntax errors are left alone unless dirty. A pass works only on the files that the one before changed.
    """
    config_rules = {n: o for n, (_, o) in run.selected.items()}
    files, diagnostics = run.files, run.diagnostics
    done: DataFrame | None = None
    current = files
    for n in range(1, passes + 1):
        edits = edits_of(diagnostics)
        if not dirty:
            edits = edits.join(diagnostics.where("phase = 'parse'").select("file_id").distinct(), "file_id", "left_anti")
        edits = without_conflicts(edits)
        changed = shared_table(apply_edits(current, edits).withColumn("passes", F.lit(n)), "fixed")
        if not changed.limit(1).count():
            break
        done = changed if done is None else done.join(changed, "file_id", "left_anti").unionByName(changed)
        current = changed.drop("passes")
        diagnostics = lint(current, rules=config_rules).diagnostics
    if done is None:
        return files.limit(0).withColumn("passes", F.lit(0))
    return done


def exit_code(run: LintRun) -> int:
    """2 without files, 1 with any error, else 0."""
    if not run.files.limit(1).count():
        return 2
    return int(run.diagnostics.where("severity in ('bug', 'error')").limit(1).count() > 0)
