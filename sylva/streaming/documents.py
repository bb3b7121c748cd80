"""Editor mode: a stream of document events (uri, seq, event, text) and the current findings of every open document.

``open`` and ``change`` carry the whole text, of which the last by sequence number counts; ``close`` takes the findings back. What a document's
last event was is keyed state of the stream: an event that is not newer is dropped, whichever batch brought the newer one, and a micro-batch
reads nothing that earlier batches wrote. It writes the documents it touches and their findings as its own version: exactly once by
(uri, seq), because a batch that is repeated starts from the same state. The state of a closed document is forgotten after a while.

A second stream may carry the configuration and the settings (name, seq, text), the last of each by sequence number counts. A change is
applied to what the batch touches and to all documents that are open, which are the only ones that are read and linted again.

Of a document the latest version counts; :func:`compact` puts the versions together when a reader has too many of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sylva.plans.lint import lint
from sylva.session import ship
from sylva.sources.config import parse_config
from sylva.sources.files import files_from

EVENTS = "uri string, seq bigint, event string, text string"


def latest(events: DataFrame) -> DataFrame:
    """The last event of each document, by sequence number, then by kind (a close after others), then by text."""
    rank = F.struct("seq", F.col("event") == "close", "text")
    return events.where("uri is not null and seq is not null and event in ('open', 'change', 'close')").groupBy("uri").agg(F.max_by(F.struct("seq", "event", "text"), rank).alias("e")).select("uri", "e.*")


def findings_of(events: DataFrame, rules: dict[str, dict] | None = None, config: str | None = None, directives: bool = True) -> DataFrame:
    """uri, seq, rule, title, start, end, line, col of the open documents among the events' last. config: the text of a configuration, instead of rules."""
    last = latest(events)
    files = files_from(last.where("event <> 'close'"), "uri", "text")
    found = (lint(files, parse_config(config), directives=directives) if config is not None else lint(files, rules=rules, directives=directives)).diagnostics
    return found.join(last.select(F.col("uri").alias("path"), "seq"), "path").select(F.col("path").alias("uri"), "seq", F.coalesce("rule", "phase").alias("rule"), "title", "start", "end", "line", "col")


def newest(events: DataFrame, forget: str = "7 days") -> DataFrame:
    """The stream of each document's last events: of a batch the last by sequence number, if it is newer than all before it.

    State is the last sequence number of a document. After a close it is removed once ``forget`` has passed (in processing time); events that
    come later than that count as those of a new document.
    """
    later = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = state.get[0] if state.exists else None
        best = None
        for part in parts:  # portions of the document's events; the best so far is all that is kept
            for seq, event, text in zip(part["seq"], part["event"], part["text"], strict=True):
                if best is None or (seq, event == "close", text or "") > (best[0], best[1] == "close", best[2] or ""):
                    best = (int(seq), event, text)
        if best is None or known is not None and best[0] <= known:
            return
        state.update((best[0],))
        if best[1] == "close":
            state.setTimeoutDuration(later)
        yield pd.DataFrame({"uri": [key[0]], "seq": [best[0]], "event": [best[1]], "text": [best[2]]})

    valid = events.where("uri is not null and seq is not null and event in ('open', 'change', 'close')").select("uri", "seq", "event", "text")
    return valid.groupBy("uri").applyInPandasWithState(step, EVENTS, "known bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: What the second stream carries: (name, seq, text), where name is one of CONTROLS.
SETTINGS = "name string, seq bigint, text string"
#: config: the text of a configuration; settings: a JSON object, {"lint": false} takes all findings back, {"directives": false} reads no ignore comments.
CONTROLS = ("config", "settings")


def publish(events: DataFrame, folder: str, publish_batch: Callable[[DataFrame, int], None] | None = None, rules: dict[str, dict] | None = None, checkpoint: str | None = None, settings: DataFrame | None = None, forget: str = "7 days") -> StreamingQuery:
    """Runs over a streaming DataFrame of events; ``folder`` holds the documents and the findings of each batch in folders of their own.

    publish_batch gets what changed: the findings of the touched documents and, for closed or clean ones, a row with a null rule.
    settings: a streaming DataFrame (SETTINGS); rules count until it has brought a configuration. A configuration that can't be read
    changes nothing.
    """
    spark = events.sparkSession
    ship(spark)

    def batch(rows: DataFrame, number: int) -> None:
        own = f"{folder}/docs-{number:09d}"
        rows.write.mode("overwrite").parquet(own)  # the state is gone through once
        got = spark.read.schema(EVENTS).parquet(own)
        changed, (config, options) = _controls(spark, folder, got, number)
        last = got.where("uri is not null")
        if changed:  # all open documents, as of the batches up to this one
            last = documents(spark, folder, number).where("event <> 'close'").unionByName(last)
        last = latest(last)
        found = findings_of(last, rules, config, options.get("directives", True))
        if not options.get("lint", True):
            found = found.limit(0)
        touched = last.select("uri", "seq").join(found.drop("seq"), "uri", "left")
        touched.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch-{number:09d}")
        if publish_batch is not None:
            publish_batch(spark.read.parquet(f"{folder}/batch-{number:09d}").drop("batch"), number)

    all_rows = newest(events, forget)
    if settings is not None:
        said = settings.where(F.col("name").isin(*CONTROLS) & F.col("seq").isNotNull())
        all_rows = all_rows.unionByName(said.select(F.lit(None).cast("string").alias("uri"), "seq", F.col("name").alias("event"), "text"))
    writer = all_rows.writeStream.foreachBatch(batch).outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{folder}/checkpoint")
    # timeouts are looked at by batches with data; batches without any, which Spark would make for them, would never end here
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return writer.start()
    finally:
        spark.conf.set(key, before)


def _controls(spark: SparkSession, folder: str, got: DataFrame, number: int) -> tuple[bool, tuple[str | None, dict]]:
    """Whether the batch changes the configuration or the settings, and what they are then. Each version holds both, so one is read."""
    names = [n for n in _versions(spark, folder, number - 1, "control-", None)]
    state = {r.name: (r.seq, r.text) for r in spark.read.schema(SETTINGS).parquet(f"{folder}/{names[-1]}").collect()} if names else {}
    said = got.where("uri is null").groupBy("event").agg(F.max_by(F.struct("seq", "text"), F.struct("seq", "text")).alias("x")).select("event", "x.*").collect()  # a row a name
    new = {r.event: (r.seq, r.text) for r in said if (r.event not in state or r.seq > state[r.event][0]) and _readable(r.event, r.text)}
    if new:
        state = state | new
        spark.createDataFrame([(k, *v) for k, v in state.items()], SETTINGS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/control-{number:09d}")
    return bool(new), (state.get("config", (0, None))[1], json.loads(state.get("settings", (0, "{}"))[1]))


def _readable(name: str, text: str | None) -> bool:
    try:
        return isinstance(json.loads(text), dict) if name == "settings" else not parse_config(text).unreadable
    except (ValueError, TypeError, AttributeError):
        return False


def _versions(spark: SparkSession, folder: str, number: int | None, kind: str, base: str | None) -> list[str]:
    """The newest compacted table up to a batch, and the versions after it, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    listed = [PurePosixPath(s.getPath().toString()).name for s in fs.listStatus(path)]
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    found = [(int(n.rpartition("-")[2]), n) for n in listed if n.startswith(kind) or base and n.startswith(base)]
    found = sorted((k, n) for k, n in found if number is None or k <= number)
    start = max((x for x in found if base and x[1].startswith(base) and whole(x[1])), default=(-1, ""))
    return [n for k, n in found if n == start[1] or n.startswith(kind) and k > start[0]]


def documents(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """The last event (uri, seq, event, text) of every document up to a batch."""
    names = _versions(spark, folder, number, "docs-", "docsbase-")
    return latest(spark.read.schema(EVENTS).parquet(*[f"{folder}/{n}" for n in names]).where("uri is not null"))


def current(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame | None:
    """The findings after a batch (the last one if no number is given); a row with a null rule says that a document has none."""
    if not (names := _versions(spark, folder, number, "batch-", "base-")):
        return None
    rows = spark.read.parquet(*[f"{folder}/{n}" for n in names])
    last = rows.groupBy("uri").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["uri", "batch"]).drop("batch")


def compact(spark: SparkSession, folder: str) -> None:
    """Writes the findings and the documents after the last batch as one table each, from which later readers start; the versions may be removed afterwards."""
    if names := _versions(spark, folder, None, "batch-", "base-"):
        last = int(names[-1].rpartition("-")[2])
        documents(spark, folder, last).write.mode("overwrite").parquet(f"{folder}/docsbase-{last:09d}")
        current(spark, folder, last).withColumn("batch", F.lit(last)).write.mode("overwrite").parquet(f"{folder}/base-{last:09d}")


def actions(findings: DataFrame, offset: int) -> DataFrame:
    """Findings whose span holds an offset: what an editor offers there."""
    return findings.where((F.col("start") <= offset) & (F.col("end") >= offset))
