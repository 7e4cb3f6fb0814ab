"""Shared helpers: durable intermediate tables, text batches, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlight import session
from nearlight.session import cut, drop_path, kept_dir, ship, work_dir  # noqa: F401

NO_KEY = -(1 << 63)  # stands for a null key inside

_held: ContextVar[list] = ContextVar("held")


@contextmanager
def scratch(spark: SparkSession):
    """As :func:`nearlight.session.scratch`; batch sizes set inside are put back at the end, small
    shuffles end in few tasks and files, and what is behind removed tables is let go."""
    token = _held.set([])
    try:
        with session.scratch(spark), session.settings(spark, rows=10_000, bytes=64 << 20, spread="false"):
            yield
    finally:
        for df in _held.get():
            df.unpersist()
        _held.reset(token)
    let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Have the shuffles removed that no table needs any more: Spark does so for what the driver has collected."""
    gc.collect()
    spark._jvm.System.gc()


def hold(df: DataFrame) -> DataFrame:
    """Keep ``df`` on the executors' disks until the end of the :func:`scratch` around. Its lineage
    stays, so what a lost executor held is computed again; unlike :func:`cut` it asks nothing of the
    shared store, which pays off for large tables that a few stages read."""
    out = df.persist(StorageLevel.DISK_ONLY)
    _held.get().append(out)
    return out


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Keep Arrow batches small until the end of the :func:`scratch` around: texts are long, and
    several arrays of 8 bytes a byte follow."""
    ship(spark)
    spark.conf.set(session.SETTINGS["rows"], str(rows))
    spark.conf.set(session.SETTINGS["bytes"], str(8 << 20))


def trim() -> None:
    """Hand memory that is free back to the system, as far as the C library can."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def lean(run: Callable) -> Callable:
    """``run`` over batches, for a task's end in mind: Spark keeps Python workers for later tasks, and the
    heap of one that has freed large arrays stays as large as its largest task made it."""

    def inner(batches):
        yield from run(batches)
        trim()

    return inner


def key_column(key: str):
    """The key as a long that is never null: pandas would turn a column with nulls to doubles, which
    hold no long above 2**53. :func:`null_key` undoes it."""
    return F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NO_KEY))


def null_key(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("k", F.nullif("k", F.lit(NO_KEY))).withColumnRenamed("k", key)


def chunks(texts: list, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about ``limit`` bytes; a longer text stands alone."""
    i = size = 0
    for j, t in enumerate(texts):
        n = len(t)
        if j > i and size + n > limit:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(texts):
        yield i, len(texts)


def _forest(batches):
    """Spanning stars of one partition's edges by union-find, at most one edge for each node."""
    import pandas as pd

    parent: dict = {}

    def find(x):
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for pdf in batches:
        for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist()):
            ra, rb = find(a), find(b)
            parent.setdefault(a, ra)
            parent.setdefault(b, rb)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        if len(parent) > 1_000_000:
            yield pd.DataFrame({"u": list(parent), "v": [find(x) for x in parent]})
            parent.clear()
    if parent:
        yield pd.DataFrame({"u": list(parent), "v": [find(x) for x in parent]})


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of ``edges(u long, v long)`` as ``(node, comp)``, comp the least node.

    Contraction: each round every node adopts its least neighbour (a combinable minimum, so a
    hub does not gather its edges in one task), parents are followed, and edges are rewritten
    to parents until none is left. Nodes without an edge to another node do not appear.
    """
    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u is not null and v is not null")
    e = e.mapInPandas(_forest, "u long, v long").filter("u <> v").distinct()
    total = None
    while True:
        e = cut(e, f"{name}-edges")
        if e.isEmpty():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        par = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p")), f"{name}-parents")
        for _ in range(2):
            up = par.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            par = par.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        par = cut(par, f"{name}-parents")
        up = par.select(F.col("u").alias("x"), F.col("p").alias("y"))
        if total is None:
            total = par.select(F.col("u").alias("node"), F.col("p").alias("comp"))
        else:
            total = total.join(up, F.col("comp") == F.col("x"), "left").select("node", F.coalesce("y", "comp").alias("comp"))
        total = cut(total, f"{name}-labels")
        moved = (
            e.join(up, F.col("u") == F.col("x")).select(F.col("y").alias("u"), "v")
            .join(up, F.col("v") == F.col("x")).select("u", F.col("y").alias("v"))
        )
        chains = par.select("p").distinct().join(up, F.col("p") == F.col("x")).select(F.col("p").alias("u"), F.col("y").alias("v"))
        e = moved.union(chains).filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if total is None:
        return edges.sparkSession.createDataFrame([], "node long, comp long")
    return total


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least index reachable from each of ``n`` nodes, by repeated minima over the edges."""
    lab = np.arange(n)
    if len(i) == 0:
        return lab
    u, v = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(u, kind="stable")
    u, v = u[order], v[order]
    first = np.flatnonzero(np.diff(u, prepend=-1))
    nodes = u[first]
    while True:
        new = lab.copy()
        new[nodes] = np.minimum(lab[nodes], np.minimum.reduceat(lab[v], first))
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new
