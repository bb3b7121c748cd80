"""Where results go: fixed sources, highlighted text."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sylva.session import ship


def _where(place: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    if not urlsplit(place).scheme:
        return fs.LocalFileSystem(), place
    return fs.FileSystem.from_uri(place)


@dataclass
class Staged(WriterCommitMessage):
    manifest: str


class SourceWriter(DataSourceWriter):
    """Tasks write into a staging folder, each attempt into its own; only the commit moves files to their places, each by one rename.

    A manifest an attempt says which file goes where, so what a task reports is one name. Until all tasks are done no target is touched,
    and a failure of any of them leaves the targets as they were; then, and after the commit, the staging folder goes. What a task that is
    just being killed writes meanwhile may stay in that hidden folder, never in a target.
    """

    def __init__(self, folder: str, in_place: bool) -> None:
        self.folder, self.in_place = folder.rstrip("/"), in_place
        self.staging = f"{self.folder}/.sylva-{uuid.uuid4().hex}"
        system, staging = _where(self.staging)
        system.create_dir(staging, recursive=True)

    def _target(self, path: str) -> str:
        return path if self.in_place else f"{_where(self.folder)[1]}/{path.lstrip('/')}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        system, staging = _where(self.staging)
        own = f"{staging}/{context.partitionId()}-{context.taskAttemptId()}"
        system.create_dir(own, recursive=False)  # not where an abort has taken the staging folder away
        with system.open_output_stream(f"{own}/manifest") as manifest:
            for n, row in enumerate(iterator):
                with system.open_output_stream(f"{own}/{n}") as out:
                    out.write((row["source"] or "").encode("utf-8", "surrogatepass"))
                manifest.write(json.dumps([f"{own}/{n}", self._target(row["path"])]).encode() + b"\n")
        return Staged(f"{own}/manifest")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staging = _where(self.staging)
        for message in messages:
            if message is None:
                continue
            with system.open_input_stream(message.manifest) as lines:
                for line in lines.read().splitlines():
                    staged, target = json.loads(line)
                    system.create_dir(target.rpartition("/")[0] or "/", recursive=True)
                    system.move(staged, target)
        system.delete_dir(staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, staging = _where(self.staging)
        if system.get_file_info(staging).type == fs.FileType.Directory:
            system.delete_dir(staging)


class SourceFiles(DataSource):
    """A sink for rows of path and source: ``df.write.format("sylva_sources").option("folder", …)``, with option in_place for paths that are absolute."""

    @classmethod
    def name(cls) -> str:
        return "sylva_sources"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return SourceWriter(self.options["folder"], self.options.get("in_place", "false") == "true")


def write_sources(fixed: DataFrame, folder: str, in_place: bool = False) -> None:
    """Writes path and source of every row below a folder (a path or URL) that all executors share; with in_place, to the paths themselves, which lie in it.

    All or nothing up to the commit: a task that fails leaves every target as it was. Of rows of one path the last to be moved stays.
    """
    spark = fixed.sparkSession
    ship(spark)
    spark.dataSource.register(SourceFiles)
    fixed.select("path", "source").write.format("sylva_sources").mode("append").option("folder", folder).option("in_place", str(in_place).lower()).save()


#: ANSI colours of token classes.
COLOURS = (("(COMMENT|SHEBANG)", 90), ("(STRING|TEMPLATE_CHUNK|BACKTICK)", 32), ("(NUMBER|TRUE_KW|FALSE_KW|NULL_KW)", 33), ("REGEX", 36), (".*_KW", 35))


def highlighted(tokens: DataFrame) -> DataFrame:
    """file_id, text: every source with its tokens in colour."""
    shown = F.col("text")
    for kinds, colour in reversed(COLOURS):
        shown = F.when(F.col("kind").rlike(f"^{kinds}$"), F.concat(F.lit(f"\x1b[{colour}m"), "text", F.lit("\x1b[0m"))).otherwise(shown)
    rows = tokens.select("file_id", F.struct("tok", shown.alias("x")).alias("t"))
    return rows.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["x"]), "").alias("text"))
