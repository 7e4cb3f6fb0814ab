"""Durable folders, and the package's sources for executors that do not have it installed."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "rows": "spark.sql.execution.arrow.maxRecordsPerBatch",
    "bytes": "spark.sql.execution.arrow.maxBytesPerBatch",
    "spread": "spark.sql.adaptive.coalescePartitions.parallelismFirst",
}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the executors' path, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="nearlight-src-"), "nearlight_main.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``. Where that is unset, one JVM alone gets a private
    folder; a cluster raises, since its executors would not see each other's files."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("nearlight.work.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="nearlight-")
        spark.conf.set("nearlight.work.dir", base)
    return f"{base.rstrip('/')}/nearlight/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system API, whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def settings(spark: SparkSession, **values):
    """Session settings for the queries that run inside, put back at the end."""
    keys = {SETTINGS[k]: str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_scope: ContextVar[list | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables that are cut inside, by this thread, are removed at the end."""
    token = _scope.set([])
    try:
        yield
    finally:
        for path in _scope.get():
            drop_path(spark, path)
        _scope.reset(token)


_kept: list[tuple[SparkSession, str]] = []


@atexit.register
def _sweep() -> None:
    """Results that a query still read from go with the session."""
    for spark, path in _kept:
        if spark.sparkContext._jsc is not None:
            with suppress(Exception):
                drop_path(spark, path)


def kept_dir(spark: SparkSession, name: str) -> str:
    """As :func:`work_dir`, for what is removed with the session."""
    path = work_dir(spark, name)
    _kept.append((spark, path))
    return path


def cut(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and any executor
    can be lost afterwards without recomputing what came before. The table goes with the
    :func:`scratch` around it; with ``keep``, or without one, with the session."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    held = _scope.get()
    if held is None or keep:
        _kept.append((spark, path))
    else:
        held.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
