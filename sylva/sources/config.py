"""Configuration: which rules run, with which options and at which level."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylva.functions.names import best_match
from sylva.operators.rules import RULES

#: Names of configuration files, the first found in a folder counts.
FILE_NAMES = ("sylva.json", "sylva.toml")


@dataclass
class Config:
    """rules: errors and warnings (rule to options), groups, allowed; formatter: 'long' or 'short'; source_type: kind of all sources."""

    errors: dict[str, dict] = field(default_factory=dict)
    warnings: dict[str, dict] = field(default_factory=dict)
    groups: list[str] = field(default_factory=list)
    allowed: list[str] = field(default_factory=list)
    formatter: str = "long"
    source_type: str | None = None
    has_rules: bool = False
    problems: list[str] = field(default_factory=list)
    unreadable: bool = False


def _rule_name(name: str) -> str:
    return "".join("-" + c.lower() if c.isupper() else c for c in name).replace("_", "-").lstrip("-").lower()


def _rules(given: dict | list, problems: list[str]) -> dict[str, dict]:
    out = {}
    for name, options in (given.items() if isinstance(given, dict) else ((n, {}) for n in given)):
        rule = _rule_name(name)
        if rule not in RULES:
            near = best_match(list(RULES), rule)
            problems.append(f"there is no rule {name}" + (f", did you mean {near}?" if near else ""))
            continue
        out[rule] = options if isinstance(options, dict) else {}
    return out


def parse_config(text: str, is_json: bool | None = None) -> Config:
    """A configuration from TOML or JSON text; what can't be read is listed under problems, and the default is used for it."""
    out = Config()
    try:
        data = json.loads(text) if (text.lstrip().startswith("{") if is_json is None else is_json) else tomllib.loads(text)
    except ValueError as e:
        out.problems.append(f"the configuration can't be read: {e}")
        out.unreadable = True
        return out
    rules = data.get("rules")
    if rules is not None:
        out.has_rules = True
        out.errors = _rules(rules.get("errors", {}), out.problems)
        out.warnings = _rules(rules.get("warnings", {}), out.problems)
        out.groups = list(rules.get("groups", []))
        out.allowed = list(_rules(rules.get("allowed", []), out.problems))
    out.formatter = data.get("errors", {}).get("formatter", "long")
    kind = data.get("parser", {}).get("source-type", data.get("parser", {}).get("source_type"))
    out.source_type = {"auto": None}.get(kind, kind)
    return out


def find_config(folder: str | Path, config_dir: str | Path | None = None, names: tuple[str, ...] = FILE_NAMES) -> Config | None:
    """The configuration of a folder, of the nearest folder above it, or of a user's configuration folder if one is given. names: of its file."""
    start = Path(folder).resolve()
    places = [start, *start.parents] + ([Path(config_dir)] if config_dir is not None else [])
    for place in places:
        for name in names:
            if (found := place / name).is_file():
                return parse_config(found.read_text(encoding="utf-8"), found.suffix == ".json")
    return None


def select_rules(config: Config | None) -> tuple[dict[str, tuple[str, dict]], list[str]]:
    """(rule to (level, options), warnings): allowed rules never run; errors come before warnings, warnings before groups."""
    if config is None or not config.has_rules:
        return {n: ("error", {}) for n, r in RULES.items() if r.recommended}, list(config.problems) if config else []
    said, out = list(config.problems), {}
    for name, options in config.errors.items():
        out[name] = ("error", options)
    for name, options in config.warnings.items():
        out.setdefault(name, ("warning", options))
    known = {r.group for r in RULES.values()}
    for group in config.groups:
        if group not in known:
            said.append(f"there is no group {group}")
        for name, r in RULES.items():
            if r.group == group:
                out.setdefault(name, ("error", {}))
    for name in config.allowed:
        if name in out:
            said.append(f"the rule {name} is allowed, so it does not run")
            del out[name]
    # A rule in warnings is demoted even where errors list it, too.
    return {n: ("warning" if n in config.warnings else level, o) for n, (level, o) in out.items()}, said


def merged_levels(tables: list[DataFrame], allowed: DataFrame, key: str = "rule") -> DataFrame:
    """Tables of (key, level) as one, in which an earlier table's key wins, without the keys of allowed."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.join(out.select(key), key, "left_anti"))
    return out.join(allowed.select(key), key, "left_anti")


def with_levels(found: DataFrame, levels: DataFrame) -> DataFrame:
    """found (rule, severity, …) with errors of rules that levels (rule, level; a short table) lists at that level; nothing is promoted."""
    joined = found.join(F.broadcast(levels.select("rule", F.col("level").alias("_level"))), "rule", "left")
    return joined.withColumn("severity", F.when(F.col("severity") == "error", F.coalesce("_level", F.lit("error"))).otherwise(F.col("severity"))).drop("_level")
