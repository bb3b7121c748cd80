"""Session defaults, shared tables and package shipping."""

from __future__ import annotations

import atexit
import ctypes
import gc
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_ROOT = Path(__file__).resolve().parent
_own_dir: str | None = None
_shipped: set[str] = set()


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    spark = SparkSession.builder.master(f"local[{cores}]").appName("sylva").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode (tests), where it may be unset, a folder of our own."""
    global _own_dir
    if where := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return where.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sylva-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the shared tables that are made inside, at its end: results have to be written (or collected) before."""
    own: list[str] = []
    _scratch.append(own)
    try:
        yield
    finally:
        _scratch.remove(own)
        for name in own:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shared_table(df: DataFrame, name: str, partition: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sylva-{name}-{uuid.uuid4().hex}"
    for held in _scratch:
        held.append(path)
    (df.write.partitionBy(partition) if partition else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_owner = ""
_states: dict[str, object] = {}


def _release() -> None:
    """Gives freed memory back to the system: workers stay alive between tasks, and idle ones count, too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not every C library has it


def in_worker(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run as an operator's Python task: what another operator has kept in the worker goes first, and freed memory goes at the end."""

    def task(batches: Iterator) -> Iterator:
        enter(owner)
        try:
            yield from run(batches)
        finally:
            _release()

    return task


def enter(owner: str) -> None:
    global _owner
    if owner != _owner:
        _states.clear()
        _owner = owner
        gc.collect()
        _release()


def kept(key: str, make: Callable[[], T]) -> T:
    """What the present operator keeps in this worker between tasks."""
    if key not in _states:
        _states[key] = make()
    return _states[key]


#: Arrow batches of long texts are kept small: a task holds a few of them at a time. Settings of the user's own stay.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", str(4 << 20))}


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, and bounds Arrow batches."""
    sc = spark.sparkContext
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, f"{_ROOT.name}/{p.relative_to(_ROOT)}")
    folder = tempfile.mkdtemp(prefix="sylva-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "sylva_package.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
