"""Named collections of vectors below one folder: created once, written by batch, searched, dropped.

A collection has a dimension and a metric. A batch adds a folder with what it changes: rows that are
newer than what is stored, and a mark where a row left its cluster or was deleted. Nothing is rewritten; a read
takes, of each id, what the last batch says. Rows and marks lie in a folder for each cluster, and a row's
mark lies where the row did, so a read of one cluster is right by its own files alone.

The manifest names the folders that count. It is written last, under the next number, and only if nobody else
has: a batch that broke off or lost that race is never seen and starts again from what is stored by then. A batch
that is in the manifest is not applied again. :meth:`Collections.compact` folds the folders into one."""

from __future__ import annotations

import json
import uuid
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from nearlight.operators import search, store
from nearlight.session import drop_path

METRICS = ("cosine", "euclid", "dot")
COLUMNS = ["id", "vec", "payload", "cluster_id", "ts", "node"]
SCHEMA = "id long, vec array<float>, payload string, ts double, node long, gone boolean, seq int, cluster_id long"
#: Folders after which a batch folds them.
FOLDERS = 64
TRIES = 10


class Collections:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # files

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._path(path)
        return fs.exists(p)

    def _manifest(self, name: str) -> dict:
        """The last manifest: its number, folders by sequence, and batches with the rows they brought."""
        p, fs = self._path(f"{self.base}/{name}/manifest")
        numbers = sorted((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), reverse=True) if fs.exists(p) else []
        for n in numbers:
            stream = fs.open(self._path(f"{self.base}/{name}/manifest/{n}")[0])
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            with suppress(ValueError):  # one that broke off
                return json.loads(text)
        return {"number": 0, "folders": {}, "folded": [], "batches": {}}

    def _commit(self, name: str, manifest: dict) -> bool:
        """False if the number is taken."""
        p, fs = self._path(f"{self.base}/{name}/manifest/{manifest['number']}")
        t, _ = self._path(f"{self.base}/{name}/manifest/.{manifest['number']}-{uuid.uuid4().hex}")
        stream = fs.create(t, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(p):
            fs.delete(t, False)
            return False
        try:
            done = fs.rename(t, p)
        except Py4JJavaError:
            done = False
        if not done:
            fs.delete(t, False)
        return bool(done)

    # collections

    def create(self, name: str, dim: int, metric: str = "cosine") -> bool:
        """True if it is new. An unknown metric is cosine; a collection that is there stays as it is."""
        if self._exists(f"{self.base}/{name}/about/_SUCCESS"):
            return False
        kind = metric.lower() if metric.lower() in METRICS else "cosine"
        self.spark.createDataFrame([(dim, kind)], "dim int, metric string").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/{name}/about")
        return True

    def about(self, name: str) -> tuple[int, str]:
        return tuple(self.spark.read.schema("dim int, metric string").parquet(f"{self.base}/{name}/about").first())

    def drop(self, name: str) -> bool:
        """True, also where there was none."""
        drop_path(self.spark, f"{self.base}/{name}")
        return True

    # reads

    def _stored(self, name: str, manifest: dict, cluster: int | None = None) -> DataFrame:
        """Of each id in each cluster, what the last folder that knows it says."""
        if not manifest["folders"]:
            return self.spark.createDataFrame([], SCHEMA)
        base = f"{self.base}/{name}/rows"
        rows = self.spark.read.schema(SCHEMA).option("basePath", base).parquet(*[f"{base}/{f}" for f in manifest["folders"].values()])
        rows = rows.drop("part")
        rows = rows if cluster is None else rows.filter(F.col("cluster_id") == cluster)
        if len(manifest["folders"]) == 1:
            return rows
        last = rows.groupBy("cluster_id", "id").agg(F.max_by(F.struct("vec", "payload", "ts", "node", "gone", "seq"), "seq").alias("r"))
        return last.select("id", "r.vec", "r.payload", "r.ts", "r.node", "r.gone", "r.seq", "cluster_id")

    def scan(self, name: str, cluster: int | None = None) -> DataFrame:
        """All rows, or those of a cluster; none where the collection has none."""
        rows = self._stored(name, self._manifest(name), cluster).filter("not gone")
        return rows.select("id", "vec", "payload", "ts", "node", "cluster_id")

    def count(self, name: str) -> int:
        return self.scan(name).count()

    def query(self, name: str, queries: DataFrame, k: int) -> DataFrame:
        """Top ``k`` with payload and vector for each of ``queries(qid, qvec)``."""
        rows = self.scan(name)
        return search.with_rows(search.topk(queries, rows, k, self.about(name)[1]), rows)

    def query_by_cluster(self, name: str, queries: DataFrame, k: int) -> DataFrame:
        """As :func:`query` where each of ``queries(qid, qvec, cluster_id)`` asks its own cluster only."""
        asked = queries.select("qid", "qvec", F.col("cluster_id").alias("part"))
        metric = self.about(name)[1]
        rows = self.scan(name)
        own = rows.join(queries.select("cluster_id").distinct(), "cluster_id", "left_semi").withColumn("part", F.col("cluster_id"))
        return search.with_rows(search._ranked(search._answers(asked, own, k, metric), k, metric), rows)

    # writes

    def insert(self, name: str, rows: DataFrame, batch: str, order: str | None = None) -> int:
        """Bring ``rows(id, vec, payload, cluster_id, ts, node)`` as ``batch``; how many were taken. A row must be newer
        than the stored one of its id. With ``order`` rows come one by one and each must also be newer than
        those before it; without, only the newest of each id comes (of equal versions, one chosen by its
        content). A vector of another dimension fails the batch; rows without id are not taken."""
        dim, _ = self.about(name)
        checked = rows.filter("id is not null").withColumn(
            "vec", F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.lit(f"a vector of {name} has {dim} components")))
        )

        def change(stored: DataFrame) -> DataFrame:
            old = stored.filter("not gone").select(F.col("id").alias("_id"), F.col("cluster_id").alias("_cluster"), store.version().alias("_old"))
            both = _offered(checked, order).join(old, F.col("id") == F.col("_id"), "left").filter("_old is null or r.version > _old")
            last = both.groupBy("id").agg(
                F.max_by("r", "r.version").alias("r"), F.count("*").alias("taken"), F.max(F.col("_id").isNotNull()).alias("known"), F.max("_cluster").alias("_cluster")
            )
            moved = F.col("known") & ~F.col("_cluster").eqNullSafe(F.col("r.cluster_id"))
            kept = F.struct("r.vec", "r.payload", "r.ts", "r.node", F.lit(False).alias("gone"), F.col("r.cluster_id").alias("cluster_id"), F.col("taken").alias("n"))
            left = F.struct(*_blank(), F.lit(True).alias("gone"), F.col("_cluster").alias("cluster_id"), F.lit(0).cast("long").alias("n"))
            return last.select("id", F.inline(F.when(moved, F.array(kept, left)).otherwise(F.array(kept))))

        return self._apply(name, batch, change)

    def delete(self, name: str, ids: DataFrame, batch: str) -> int:
        """Delete the rows of ``ids(id)``; how many were there. What comes later is taken whatever its version."""
        gone = ids.select(F.col("id").alias("_id")).distinct()
        return self._apply(name, batch, lambda stored: _marks(stored.filter("not gone").join(gone, F.col("id") == F.col("_id"), "left_semi")))

    def delete_cluster(self, name: str, cluster: int, batch: str) -> int:
        """Delete all rows of a cluster; only its folder is read."""
        return self._apply(name, batch, lambda stored: _marks(stored.filter("not gone")), cluster)

    def _apply(self, name: str, batch: str, change, cluster: int | None = None) -> int:
        for _ in range(TRIES):
            manifest = self._manifest(name)
            if batch in manifest["batches"]:
                return manifest["batches"][batch]
            seq = manifest["number"] + 1
            folder = f"seq={seq}/part={uuid.uuid4().hex}"
            seen = Observation()
            told = change(self._stored(name, manifest, cluster)).observe(seen, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("rows"))
            told.drop("n").write.partitionBy("cluster_id").parquet(f"{self.base}/{name}/rows/{folder}")
            n, any_ = int(seen.get["n"]), seen.get["rows"] > 0
            folders = manifest["folders"] | ({str(seq): folder} if any_ else {})
            if self._commit(name, manifest | {"number": seq, "folders": folders, "batches": manifest["batches"] | {batch: n}}):
                if len(folders) > FOLDERS:
                    self.compact(name)
                return n
            drop_path(self.spark, f"{self.base}/{name}/rows/{folder}")
        raise RuntimeError(f"{name}: other writers were first {TRIES} times")

    def compact(self, name: str) -> bool:
        """Fold all folders into one without marks; folders that no manifest but the last two names are
        removed. False if a writer was first or there is nothing to fold."""
        manifest = self._manifest(name)
        if len(manifest["folders"]) < 2:
            return False
        seq = manifest["number"] + 1
        folder = f"seq={seq}/part={uuid.uuid4().hex}"
        rows = self._stored(name, manifest).filter("not gone").drop("seq")
        rows.repartition("cluster_id", F.xxhash64("id") % 8).write.partitionBy("cluster_id").parquet(f"{self.base}/{name}/rows/{folder}")
        # readers of the manifest before may still read the folders that are folded now
        if not self._commit(name, manifest | {"number": seq, "folders": {str(seq): folder}, "folded": list(manifest["folders"].values())}):
            drop_path(self.spark, f"{self.base}/{name}/rows/{folder}")
            return False
        for f in manifest["folded"]:
            drop_path(self.spark, f"{self.base}/{name}/rows/{f}")
        return True


def _offered(rows: DataFrame, order: str | None) -> DataFrame:
    """``(id, r)``: the versions of each id that a batch offers one after the other, each newer than those before."""
    row = F.struct(store.version().alias("version"), *COLUMNS[1:]).alias("r")
    if order is None:
        return rows.groupBy("id").agg(F.max_by(row, F.struct(store.version(), F.xxhash64("payload", "cluster_id"), F.xxhash64("vec"))).alias("r"))
    before = Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_v", store.version()).withColumn("_top", F.max("_v").over(before)).filter("_top is null or _v > _top").select("id", row)


def _blank() -> list:
    return [F.lit(None).cast(t).alias(c) for c, t in (("vec", "array<float>"), ("payload", "string"), ("ts", "double"), ("node", "long"))]


def _marks(rows: DataFrame) -> DataFrame:
    return rows.select("id", *_blank(), F.lit(True).alias("gone"), "cluster_id", F.lit(1).cast("long").alias("n"))
