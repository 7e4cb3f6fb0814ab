"""Streaming ingest with version-based lateness: state by id, and tables that only changes are added to."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from nearlight.operators import clustering, health, search, store
from nearlight.session import cut, drop_path, kept_dir, ship, work_dir
from nearlight.streaming import keyed


class Snapshots:
    """A table as numbered folders; a batch writes its own number, so that a batch that is sent
    again replaces its own output and reads the snapshot before it."""

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path, schema

    def numbers(self) -> list[int]:
        """Finished batches."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(f.getName()) for f in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")))

    def read(self, number: int | None) -> DataFrame:
        if number is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{number}")

    def before(self, batch: int) -> DataFrame:
        return self.read(max((n for n in self.numbers() if n < batch), default=None))

    def last(self) -> DataFrame:
        return self.read(max(self.numbers(), default=None))

    def write(self, batch: int, rows: DataFrame) -> None:
        """The batch's snapshot; those before the last but one are removed."""
        rows.write.mode("overwrite").parquet(f"{self.path}/{batch}")
        for n in self.numbers()[:-2]:
            drop_path(self.spark, f"{self.path}/{n}")


def _drain(stream: DataFrame, batch, checkpoint: str, mode: str = "append") -> None:
    stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: batch(n, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Changes:
    """A table as changes by batch. Each writes its own folder, so that a batch that is sent again replaces its own
    output; a read takes, of each id, what the last batch says. Every ``FOLD`` batches the changes are
    folded into a base, so a batch costs its own rows, and now and then a share of the table."""

    FOLD = 32

    def __init__(self, spark: SparkSession, path: str, schema, key: str = "id"):
        self.schema, self.key = schema, key
        self.base = Snapshots(spark, f"{path}/base", schema)
        self.changes = Snapshots(spark, f"{path}/changes", schema)

    def read(self, before: int | None = None) -> DataFrame:
        """The table, or as it was before a batch."""
        early = [n for n in self.base.numbers() if before is None or n < before]
        start = max(early, default=-1)
        rows = self.base.read(start if early else None).withColumn("_batch", F.lit(-1).cast("long"))
        for n in self.changes.numbers():
            if n > start and (before is None or n < before):
                rows = rows.unionByName(self.changes.read(n).withColumn("_batch", F.lit(n).cast("long")))
        row = F.struct(*[F.col(f"`{c}`") for c in self.schema.names])
        return rows.groupBy(F.col(self.key).alias("_key")).agg(F.max_by(row, "_batch").alias("r")).select("r.*")

    def write(self, batch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.changes.path}/{batch}")
        start = max(self.base.numbers(), default=-1)
        open_ = [n for n in self.changes.numbers() if n > start]
        if len(open_) >= self.FOLD:
            self.base.write(open_[-1], self.read())  # the base before it stays for those who read it
            for n in self.changes.numbers():
                if n <= start:
                    drop_path(self.base.spark, f"{self.changes.path}/{n}")


def upsert_stream(spark: SparkSession, source: str, schema, path: str, checkpoint: str) -> DataFrame:
    """Drain a Parquet stream into a last-writer-wins table; the table that it leaves, also after a restart without
    new files. The newest row of each id is the stream's state, and a batch adds the ids that it brought, so nothing
    that is stored is read or written again. Equal versions go by ``_batch``, if the rows have it."""
    columns = [c for c in schema.names if c != "_batch"]
    table = Changes(spark, path, StructType([schema[c] for c in columns]))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(source)
    arrival = F.col("_batch").cast("long") if "_batch" in schema.names else F.lit(0).cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    newest = stream.groupBy(F.col("id").alias("_id")).agg(F.max_by(row, F.struct(store.version().alias("v"), (-arrival).alias("a"))).alias("r")).select("r.*")
    _drain(newest, table.write, checkpoint, "update")
    return table.read()


def replay(spark: SparkSession, batches: list[DataFrame]) -> DataFrame:
    """The batches as a stream and the table that they leave."""
    source = kept_dir(spark, "stream-source")
    for i, b in enumerate(batches):
        b.withColumn("_batch", F.lit(i)).write.mode("append").parquet(source)
    schema = StructType([*batches[0].schema.fields, StructField("_batch", IntegerType())])
    return upsert_stream(spark, source, schema, kept_dir(spark, "stream-table"), work_dir(spark, "stream-checkpoint"))


def bootstrap(spark: SparkSession, rows: DataFrame, threshold: int) -> DataFrame:
    """Rows are buffered until ``threshold`` of them have come; then clusters are learned from the
    buffer once, whatever ``cluster_id`` its rows bring. Buffered rows take their K-means cluster,
    later rows the nearest one, and rows without a usable vector -1. Adds ``state`` and ``cluster_id``.
    What was learned lies beside the table by batch, so a restart goes on with it. An id is one row, the last."""
    source, path = kept_dir(spark, "boot-source"), kept_dir(spark, "boot-table")
    rows.repartitionByRange(4, "id").write.parquet(source)
    kept = rows.select("id", "vec", F.col("cluster_id").cast("long").alias("cluster_id"))
    table = Changes(spark, f"{path}/rows", kept.withColumn("state", F.lit("")).schema)
    layouts = Snapshots(spark, f"{path}/clusters", "cluster_id long, centroid array<double>")

    def clustered(found: DataFrame, into: DataFrame) -> DataFrame:
        joined = found.drop("cluster_id").join(into.select("id", "cluster_id"), "id", "left")
        return joined.select("id", "vec", F.coalesce("cluster_id", F.lit(-1)).cast("long").alias("cluster_id"), F.lit("clustered").alias("state"))

    def batch(number: int, new: DataFrame) -> None:
        new = cut(new.select(*kept.columns), "boot-new")
        known = [n for n in layouts.numbers() if n < number]
        if known:
            near = search.nearest_clusters(new, layouts.read(known[-1]), 1)
            return table.write(number, clustered(new, near))
        held = table.read(number).drop("state")
        held = held.join(new.select("id"), "id", "left_anti").unionByName(new)
        learned = clustering.learn(held) if held.count() >= threshold else None
        if not learned:
            return table.write(number, new.withColumn("state", F.lit("bootstrap")))
        layouts.write(number, learned[1])
        table.write(number, clustered(held, learned[0]))  # once, all that waited

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source).select(*kept.columns)
    _drain(stream, batch, work_dir(spark, "boot-checkpoint"))
    return table.read()


def heartbeats(spark: SparkSession, beats: DataFrame) -> DataFrame:
    """``(peer_id, ms, n, mean, var)`` of each peer's last ``SAMPLE`` gaps, kept as state by a stream of ``beats(peer_id,
    ms)``. A peer's first beat activates it, without a gap. Beats of a batch are taken in order."""
    source, table = kept_dir(spark, "beats-source"), kept_dir(spark, "beats-table")
    beats.repartitionByRange(4, "ms").write.parquet(source)
    ship(spark)
    out = "peer_id long, ms double, n long, mean double, var double"

    def step(key, frames, state):
        ms = np.sort(np.concatenate([f["ms"].to_numpy(np.float64) for f in frames]))
        last, gaps = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        all_ = ms if last is None else np.concatenate([[last], ms])
        gaps = (gaps + np.diff(all_).tolist())[-health.SAMPLE :]
        state.update((float(all_[-1]), gaps))
        mean, var = (float(np.mean(gaps)), float(np.var(gaps))) if gaps else (health.FIRST_MEAN, 0.0)
        yield pd.DataFrame({"peer_id": [key[0]], "ms": [float(all_[-1])], "n": [len(gaps)], "mean": [mean], "var": [var]})

    stream = spark.readStream.schema(beats.schema).option("maxFilesPerTrigger", 4).parquet(source)
    kept = stream.groupBy("peer_id").applyInPandasWithState(step, out, "last double, gaps array<double>", "update", GroupStateTimeout.NoTimeout)
    stats = Changes(spark, table, kept.schema, "peer_id")
    _drain(kept, stats.write, work_dir(spark, "beats-checkpoint"), "update")
    return stats.read()


def suspicions(spark: SparkSession, beats: DataFrame, files: int = 4) -> DataFrame:
    """Changes of all peers of ``beats(peer_id, ms, answered)``, as a stream in the order of time reports them."""
    source, path = kept_dir(spark, "contact-source"), kept_dir(spark, "contact-changes")
    _in_order(beats.select("peer_id", F.col("ms").cast("double").alias("ms"), "answered"), "ms", files, source)
    stream = spark.readStream.schema("peer_id long, ms double, answered boolean").option("maxFilesPerTrigger", 1).parquet(source)
    return _appended(spark, keyed.detected(stream), keyed.CHANGES, path)


def divert(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """What comes out of :func:`nearlight.streaming.keyed.diverted` for ``rows(cluster_id, seq, kind, id)`` in the order of ``seq``."""
    source, path = kept_dir(spark, "divert-source"), kept_dir(spark, "divert-rows")
    _in_order(rows.select("cluster_id", "seq", "kind", "id"), "seq", files, source)
    stream = spark.readStream.schema("cluster_id long, seq long, kind string, id long").option("maxFilesPerTrigger", 1).parquet(source)
    return _appended(spark, keyed.diverted(stream), keyed.WAITED, path)


def _in_order(rows: DataFrame, column: str, files: int, path: str) -> None:
    """Ranges of ``column`` one after the other: a stream takes files by their age."""
    dealt = cut(rows.repartitionByRange(files, column).withColumn("_part", F.spark_partition_id()), "in-order")
    for p in range(files):
        dealt.filter(F.col("_part") == p).drop("_part").coalesce(1).write.mode("append").parquet(path)


def _appended(spark: SparkSession, stream: DataFrame, schema: str, path: str) -> DataFrame:
    """All that a stream with keyed state puts out."""
    with keyed.stores(spark):
        _drain(stream, lambda n, rows: rows.write.mode("overwrite").parquet(f"{path}/{n}"), work_dir(spark, "keyed-checkpoint"), "update")
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in Snapshots(spark, path, schema).numbers()])
