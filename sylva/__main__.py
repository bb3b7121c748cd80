"""The command line: ``python -m sylva lint PATH...``, ``fix``, ``rules``, ``explain RULE...``, ``infer PATH...``.

Exit codes: 0 without errors, 1 with any, 2 if no file is found or a command can't be carried out,
3 after a fault, which is reported with its trace.
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession

from sylva.operators.rules import RULES
from sylva.operators.syntax import nodes_of, parsed
from sylva.plans.infer import as_toml, infer_block_spacing
from sylva.plans.lint import exit_code, fix, lint
from sylva.plans.report import explain, problems_fixed, report, totals
from sylva.plans.sinks import write_sources
from sylva.session import local_session
from sylva.sources.config import Config, find_config, parse_config
from sylva.sources.files import IGNORE_FILES, ignore_rules, load_files


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sylva", description="Finds and fixes problems in JavaScript and TypeScript sources.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("lint", "report problems"), ("fix", "rewrite sources by the fixes of rules, then report what is left"), ("infer", "print the options that sources agree on")):
        c = commands.add_parser(name, help=what)
        c.add_argument("paths", nargs="*", default=["."], help="files, folders or globs")
        c.add_argument("--no-ignore", action="store_true", help="read files that ignore files leave out, too")
        c.add_argument("--ignore-file", action="append", default=[], metavar="FILE", help="a further file of ignore patterns, which counts more than those found (may be given again)")
        c.add_argument("--use-gitignore", action=argparse.BooleanOptionalAction, default=True, help="whether .gitignore files count")
        c.add_argument("--cores", "--max-threads", default="*", help="how many cores a local session takes")
        c.add_argument("--verbose", action="store_true", help="say how many files were read, by which rules, and how long it took")
        if name != "infer":
            c.add_argument("--config", help="a configuration file instead of the nearest one")
            c.add_argument("--no-config", action="store_true", help="the recommended rules, whatever is configured")
            c.add_argument("--formatter", help="long or short; the configured one unless given")
        if name == "fix":
            c.add_argument("--dirty", action="store_true", help="fix files with syntax errors, too")
    commands.add_parser("rules", help="list all rules")
    commands.add_parser("explain", help="describe rules").add_argument("names", nargs="+")
    return top


def _root(given: list[str]) -> Path:
    """The folder that all given paths lie in."""
    root = Path(os.path.commonpath([str(Path(p).absolute()) for p in given]))
    root = root if root.is_dir() else root.parent
    while "*" in str(root):
        root = root.parent
    return root


def _files(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    given, root = args.paths, _root(args.paths)
    names = IGNORE_FILES if args.use_gitignore else tuple(n for n in IGNORE_FILES if n != ".gitignore")
    left_out = ignore_rules(root, args.ignore_file, () if args.no_ignore else names)
    paths = [f"file://{Path(p).absolute()}" for p in given]
    return load_files(spark, paths, ignore=left_out, root=str(root))


def _config(args: argparse.Namespace) -> Config | None:
    if args.no_config:
        return None
    if args.config:
        return parse_config(Path(args.config).read_text(encoding="utf-8"), args.config.endswith(".json"))
    first = Path(args.paths[0])
    return find_config(first if first.is_dir() else first.parent)


def _checked(args: argparse.Namespace, spark: SparkSession, out) -> int:
    began = time.time()
    files = _files(spark, args)
    config = _config(args)
    run = lint(files, config)
    if args.command == "fix":
        before = run.diagnostics
        fixed = fix(run, dirty=args.dirty)
        write_sources(fixed, str(_root(args.paths)), in_place=True)
        run = lint(_files(spark, args), config)
        print(f"fixed {problems_fixed(before, run.diagnostics).first().fixed} problems", file=out)
    for said in run.warnings:
        print(f"warning: {said}", file=sys.stderr)
    shown = report(run.diagnostics, run.files, args.formatter or (config.formatter if config else "long"))
    for row in shown.orderBy("path", "line_no" if "line_no" in shown.columns else "start").toLocalIterator():
        print(f"{row.path}: {row.text}" if "line_no" in shown.columns else row.text, file=out)
    print(totals(run.outcomes).first().text, file=out)
    if args.verbose:
        print(f"{run.files.count()} files, {len(run.selected)} rules, {time.time() - began:.1f} s", file=sys.stderr)
    return exit_code(run)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    """Carries out one command; spark: a session to use instead of a local one of its own."""
    args = arguments().parse_args(argv)
    out = out or sys.stdout
    if args.command == "rules":
        for r in sorted(RULES.values(), key=lambda r: (r.group, r.name)):
            print(f"{r.group:8} {r.name:28} {r.docs}", file=out)
        return 0
    try:
        if args.command == "explain":
            print("\n\n".join(explain(n) for n in args.names), file=out)
            return 0
        spark = spark or local_session(args.cores)
        if args.command == "infer":
            print(as_toml(infer_block_spacing(nodes_of(parsed(_files(spark, args))))), end="", file=out)
            return 0
        return _checked(args, spark, out)
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception:
        print(f"sylva stopped because of a fault of its own.\ncommand: {args.command}\npython: {sys.version.split()[0]}, spark: {pyspark.__version__}\n{traceback.format_exc()}", file=sys.stderr)
        return 3


if __name__ == "__main__":
    sys.exit(main())
