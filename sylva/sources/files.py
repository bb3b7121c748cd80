"""The files table: file_id, path, name, kind, source, n_bytes."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sylva.operators.spans import as_of

EXTENSIONS = ("js", "mjs", "ts")


def kind_of(path: Column, override: str | None = None) -> Column:
    """script, module or typescript, by extension unless overridden."""
    if override:
        return F.lit(override)
    return F.when(path.rlike(r"\.ts$"), "typescript").when(path.rlike(r"\.mjs$"), "module").otherwise("script")


def files_from(sources: DataFrame, path_col: str = "path", source_col: str = "source", override: str | None = None) -> DataFrame:
    """A table of texts as files: the id is a hash of the path, so it needs no counter; null sources are empty."""
    path, source = F.col(path_col).cast("string"), F.coalesce(F.col(source_col), F.lit(""))
    return sources.select(F.xxhash64(path).alias("file_id"), path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), kind_of(path, override).alias("kind"), source.alias("source"), F.octet_length(source).alias("n_bytes"))


def load_files(spark: SparkSession, paths: str | list[str], ignore: list[str] | list[tuple[str, bool]] | None = None, override: str | None = None, root: str = "", hidden: bool = False) -> DataFrame:
    """js, mjs and ts files below the paths (globs allowed). ignore: patterns as in an ignore file; hidden files are skipped unless asked for.

    Patterns are filters of the listed paths, which Spark applies when it plans the scan: a file that is left out is never opened. What is
    read is dealt out by size.
    """
    glob = "*.{" + ",".join(EXTENSIONS) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(paths)
    # the path of a listed file as a URL; a plus sign in it is one
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*(?=/)", "")
    if root:
        prefix = root.rstrip("/") + "/"
        path = F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)
    if not hidden:
        raw = raw.where(~path.rlike(r"(^|/)\.[^/.]"))
    if ignore:
        raw = raw.where(~ignored(path, ignore))
    named = raw.select(F.regexp_replace("path", "^[a-z]+:/*(?=/)", "").alias("path"), F.col("content").cast("string").alias("source"))
    return files_from(named, override=override)


def pattern_regex(pattern: str) -> tuple[str, bool] | None:
    """One line of an ignore file as (regular expression of relative paths, negated); None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    only_folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            j = line.index("]", i + 1)
            body = line[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body.startswith("!") else body) + "]", j + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if only_folders else "(?:/.*)?$"), negated


#: Names of the files that say what to leave out; later ones count more.
IGNORE_FILES = (".gitignore", ".ignore", ".sylvaignore")


def ignore_rules(root: str | Path, more: list[str] | None = None, names: tuple[str, ...] = IGNORE_FILES) -> list[tuple[str, bool]]:
    """The lines of all ignore files in a folder and those below it, as (regular expression of paths relative to it, negated).

    more: further files of patterns of that folder, which count more than those found. names: which files are looked for.

    A line of a nested folder concerns paths in that folder only, and counts more than those of the folders above. The files are read
    by the driver: there are as many as folders with one.
    """
    root, out = Path(root), []
    found = [(p.parent, p) for n in names for p in root.rglob(n) if p.is_file()]
    found = sorted(found, key=lambda x: (len(x[0].parts), x[0], names.index(x[1].name)))
    for folder, p in [*found, *((root, Path(m)) for m in more or [])]:
        inside = folder.relative_to(root).as_posix()
        prefix = "" if inside == "." else re.escape(inside) + "/"
        for line in p.read_text(encoding="utf-8", errors="replace").splitlines():
            if (made := pattern_regex(line)) is not None:
                out.append(("^" + prefix + made[0][1:], made[1]))
    return out


def ignored(path: Column, patterns: list[str] | list[tuple[str, bool]]) -> Column:
    """Whether the last matching pattern takes a path out; patterns with ! take it back in."""
    out = F.lit(False)
    for p in patterns:
        if (made := pattern_regex(p) if isinstance(p, str) else p) is not None:
            out = F.when(path.rlike(made[0]), F.lit(not made[1])).otherwise(out)
    return out


def scripts_of(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Inline scripts of web pages as files named page/<id>/<n>.js."""
    found = pages.select(F.col(id_col).alias("id"), F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(r"(?is)<script(?:\s[^>]*)?>(.*?)</script\s*>"), F.lit(1))).alias("n", "source"))
    return files_from(found.select(F.concat(F.lit("page/"), F.col("id").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(".js")).alias("path"), "source"))


def line_starts(files: DataFrame, id_col: str = "file_id", source_col: str = "source") -> DataFrame:
    """file_id, line (from 0), start (byte offset): a running sum over the pieces between newlines."""
    pieces = files.select(F.col(id_col).alias("file_id"), F.posexplode(F.split(F.coalesce(F.col(source_col), F.lit("")), "\n", -1)).alias("line", "p"))
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select("file_id", "line", F.octet_length("p").cast("long").alias("n")).select("file_id", "line", F.coalesce(F.sum(F.col("n") + 1).over(before), F.lit(0)).cast("long").alias("start"))


BLOCK = 256  # lines of which the starts go together


def located(found: DataFrame, lines: DataFrame, at: str = "start") -> DataFrame:
    """found (file_id, …) with path, line and col of byte ``at``, counted from 0: the last line that starts at or before it.

    lines: blocks of the starts of lines (file_id, line, starts, path). Findings and blocks are sorted together, so a finding takes along
    its own block and nothing that grows with the file.
    """
    marks = lines.select("file_id", F.get("starts", 0).alias("_at"), F.struct("line", "starts", "path").alias("_mark"))
    held = as_of(found, marks, ["file_id"], at, "_b")
    own = F.expr(f"filter(_b.starts, s -> s <= `{at}`)")
    out = held.withColumns({"path": F.col("_b.path"), "line": F.col("_b.line") + F.size(own) - 1, "col": F.col(at) - F.get(own, F.size(own) - 1)})
    return out.drop("_b")


def reload(files: DataFrame, path: str, source: str) -> DataFrame:
    """files with the text of one path replaced; a path that isn't there changes nothing."""
    new = F.when(F.col("path") == path, F.lit(source)).otherwise(F.col("source"))
    return files.withColumn("source", new).withColumn("n_bytes", F.octet_length("source"))
