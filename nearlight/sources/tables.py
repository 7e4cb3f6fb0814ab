"""Readers, and adapters from the given tables to the vector data model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlight.session import ship

N_NODES, RF = 8, 3
UNREACHABLE = (2, 5)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vectors(spark: SparkSession, sf_dir: str, payload: bool = False) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("cluster_id"),
        (F.col("vec_id") % 7).cast("double").alias("ts"), (F.col("vec_id") % 8).alias("node"),
    )
    if payload:
        d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("payload"))
        e = e.join(d, "id", "left")
    return e


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: every row whose id is divisible by 50."""
    return vectors(spark, sf_dir).filter(F.col("id") % 50 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def nodes(spark: SparkSession) -> DataFrame:
    return spark.range(N_NODES).withColumnRenamed("id", "node_id")


def active(spark: SparkSession) -> DataFrame:
    return nodes(spark).filter(~F.col("node_id").isin(*UNREACHABLE))


def placement(clusters: DataFrame) -> DataFrame:
    c = F.col("cluster_id")
    return clusters.select("cluster_id").distinct().select("cluster_id", F.explode(F.array(c % 8, (c + 1) % 8, (c + 3) % 8)).alias("node_id"))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every vector, diverged: some are missing, some are of an older version."""
    v = vectors(spark, sf_dir)
    r = v.join(placement(v), "cluster_id").filter("id % 5 <> node_id % 5")
    return r.withColumn("ts", F.when((F.col("id") + F.col("node_id")) % 3 == 0, F.col("ts") - 1).otherwise(F.col("ts")))


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update of every vector: newer, equal or older."""
    v = vectors(spark, sf_dir)
    shift = F.when(F.col("id") % 3 == 0, 1.0).when(F.col("id") % 3 == 1, 0.0).otherwise(-1.0)
    return v.withColumn("ts", F.col("ts") + shift).withColumn("cluster_id", F.col("cluster_id") + 100)


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("long").alias("peer_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms"))


def latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    end = F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0
    return e.select("event_type", (F.col("user_id") % 8).cast("long").alias("server"), F.col("value").cast("double").alias("ms"), end.alias("end_ms"))


def peers(spark: SparkSession, path: str, me: int | None = None) -> DataFrame:
    """Peers of a JSON list of ``{id, url, port}``; incomplete entries and ``me`` are left out."""
    p = spark.read.schema("id long, url string, port long").json(path, multiLine=True)
    p = p.filter("url is not null and port is not null").dropDuplicates(["url", "port"])
    return p if me is None else p.filter(F.col("id") != me)


def write_peers(spark: SparkSession, addresses: list[tuple[str, int | str]], path: str) -> int:
    """Write a list that :func:`peers` reads: ``(url, port)`` in the order of their ids, which count from 0; an empty url
    is this machine. A port that is no number is refused."""
    listed = [{"id": i, "url": url.strip() or "127.0.0.1", "port": int(port)} for i, (url, port) in enumerate(addresses)]
    spark.createDataFrame([(json.dumps(listed, indent=4),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return len(listed)
