"""Session helpers: the one place that knows about scratch space and batch bounds."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Bounds of one Arrow batch handed to Python: rows, and bytes for long texts.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def get_session(app: str = "conceptlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; cluster settings given outside win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(ARROW_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(ARROW_BYTES),
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tuned(spark: SparkSession) -> SparkSession:
    """A session that was made elsewhere, with Arrow batches bounded as in ``get_session`` if theirs are larger.

    For programs (registered queries, pipeline stages) to call on the session they are given; operators don't.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = spark.conf.get(key).lower()
        unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now.rstrip("b")[-1:], 1)
        if not 0 < int(now.rstrip("bkmg")) * unit <= most:
            spark.conf.set(key, str(most))
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors: spark.checkpoint.dir.

    Where it is unset, a folder of this machine's is taken if driver and executors are one process, and refused else:
    on a cluster each executor would write to its own disk.
    """
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.gettempdir()}/conceptlake-{os.getuid()}"
    return where.rstrip("/")


class _Scopes(threading.local):
    """The tables that ``cut`` has written, by scope, the innermost last."""

    def __init__(self) -> None:
        self.open: list[list[str]] = [[]]


_SCOPES = _Scopes()


def _delete(spark: SparkSession, paths: list[str]) -> int:
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def drop_cuts(spark: SparkSession) -> int:
    """Delete the tables that results handed out so far may still be read from; how many there were.

    Call it when those results have been read. At the end of the process it is called for what is left.
    """
    paths, _SCOPES.open[0] = _SCOPES.open[0], []
    return _delete(spark, paths)


@atexit.register
def _leave() -> None:
    context, paths = SparkContext._active_spark_context, _SCOPES.open[0]
    if paths and context is not None and context._jsc is not None:
        drop_cuts(SparkSession.builder.getOrCreate())


def drop(df: DataFrame) -> None:
    """Delete a table of ``cut`` that nothing will be read from again."""
    path = df.__dict__["_cut_path"]
    for paths in _SCOPES.open:
        if path in paths:
            paths.remove(path)
    _delete(df.sparkSession, [path])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A scope for ``cut``: its tables are deleted at the end, but those handed to the function that it gives.

    What is handed out must be such a table itself, not a plan over tables that go.
    """
    mine: list[str] = []
    _SCOPES.open.append(mine)
    kept: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.__dict__["_cut_path"])
        return df

    try:
        yield keep
    finally:
        _SCOPES.open.remove(mine)
        _SCOPES.open[-1] += [p for p in mine if p in kept]
        _delete(spark, [p for p in mine if p not in kept])


def cut(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared scratch folder and read it back.

    This cuts the lineage in a form that survives lost executors; a later stage reads only the columns it needs.
    The table goes with the ``scratch`` scope that it is written in.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/cut-{uuid.uuid4().hex}"
    _SCOPES.open[-1].append(path)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_cut_path"] = path
    return out

