"""Versioned store: last writer wins as relational algebra over one logical table.

Rows are ``(id, vec, payload, cluster_id, ts, node)``; ``(ts, node)`` is the version, compared
lexicographically, a missing one counting as (0, 0)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearlight.operators.ranking import ranked


def version():
    return F.struct(F.coalesce(F.col("ts"), F.lit(0.0)), F.coalesce(F.col("node"), F.lit(0)))


def _arrival(rows: DataFrame, order: str | None):
    """What decides between equal versions: the earlier row by ``order``, else one by its content."""
    return -F.col(order).cast("long") if order else F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])


def upsert(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """The newest row of each id. An incoming row must be strictly newer than the stored one; of equal
    versions in a batch the first by ``order`` wins (without ``order`` one that its content chooses)."""
    def side(rows: DataFrame, first: int, arrival) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in stored.columns]).alias("r")
        return rows.select(row, F.col("id").alias("_id"), F.struct(version().alias("v"), F.lit(first).alias("s"), arrival.alias("a")).alias("_rank"))

    both = side(stored, 1, F.lit(0).cast("long")).unionByName(side(incoming, 0, _arrival(incoming, order)))
    return both.groupBy("_id").agg(F.max_by("r", "_rank").alias("r")).select("r.*")


def accepted(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Incoming rows that are taken when they come one by one: each newer than the stored row and than
    all rows of its id before it. Without ``order`` the newest of each id comes first, so that it alone is taken."""
    old = stored.select("id", version().alias("_old"))
    rows = incoming.withColumn("_v", version())
    turn = [F.col(order).cast("long")] if order else [F.desc("_v"), _arrival(incoming, None).desc()]
    before = Window.partitionBy("id").orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_top", F.max("_v").over(before)).join(old, "id", "left")
    newer = (F.col("_old").isNull() | (F.col("_v") > F.col("_old"))) & (F.col("_top").isNull() | (F.col("_v") > F.col("_top")))
    return rows.filter(newer).select(*incoming.columns)


def insert_batch(stored: DataFrame, incoming: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The table after the batch, and ``(n)``, how many of its rows were taken."""
    return upsert(stored, incoming, order), accepted(stored, incoming, order).agg(F.count("*").alias("n"))


def contains(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids(id)`` with ``found``."""
    return ids.join(stored.select("id").distinct().withColumn("found", F.lit(True)), "id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def decode(points: DataFrame) -> DataFrame:
    """Stored points ``(id, vec, point)``, ``point`` a JSON text, as rows; a missing version is (0, 0), missing
    destinations are null and a missing cluster is -1."""
    p = F.from_json("point", "string string, cluster_id long, version_ts double, version_node long, destinations array<long>")
    return points.select("id", "vec", p.alias("p")).select(
        "id", "vec", F.col("p.string").alias("payload"), F.coalesce("p.cluster_id", F.lit(-1)).alias("cluster_id"),
        F.coalesce("p.version_ts", F.lit(0.0)).alias("ts"), F.coalesce("p.version_node", F.lit(0)).cast("long").alias("node"), "p.destinations",
    )


def widen(rows: DataFrame, now: float, node: int, destinations: DataFrame | None = None) -> DataFrame:
    """Rows with every column of the model: a missing version is ``(now, node)``, destinations come from
    ``destinations(cluster_id, destinations)`` where the row has none."""
    have = rows.columns
    out = rows
    for c, kind in (("ts", "double"), ("node", "long"), ("cluster_id", "long"), ("destinations", "array<long>")):
        if c not in have:
            out = out.withColumn(c, F.lit(None).cast(kind))
    unset = F.col("ts").isNull()
    out = out.withColumn("node", F.when(unset, F.lit(node)).otherwise(F.col("node"))).withColumn("ts", F.coalesce("ts", F.lit(float(now))))
    out = out.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    if destinations is not None:
        out = out.join(destinations.select("cluster_id", F.col("destinations").alias("_to")), "cluster_id", "left")
        out = out.withColumn("destinations", F.coalesce("destinations", "_to")).drop("_to")
    return out.withColumn("destinations", F.coalesce("destinations", F.array().cast("array<long>")))


def stamp(rows: DataFrame, order: str, node: int, n_peers: int, now: float) -> DataFrame:
    """Client rows as they enter: their id, no cluster yet, version ``(now, node)``."""
    r = assign_ids(rows, order, node, n_peers).withColumnRenamed("new_id", "id")
    return r.withColumn("cluster_id", F.lit(-1).cast("long")).withColumn("ts", F.lit(float(now))).withColumn("node", F.lit(node).cast("long"))


def valid_clusters(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``column`` is a number, as ``cluster_id``, and ``(n)``, how many others were dropped."""
    r = rows.withColumn("cluster_id", F.col(column).try_cast("long"))
    return r.filter("cluster_id is not null"), r.agg(F.count_if(F.col("cluster_id").isNull()).alias("n"))


def unassigned(rows: DataFrame) -> DataFrame:
    """Rows whose cluster is gone wait for a new one."""
    return rows.withColumn("cluster_id", F.lit(-1).cast("long"))


def divert(rows: DataFrame, splitting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to save now, and those whose cluster is in ``splitting(cluster_id)`` and that wait for its end."""
    return rows.join(splitting, "cluster_id", "left_anti"), rows.join(splitting, "cluster_id", "left_semi")


def save(stored: DataFrame, rows: DataFrame, splitting: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The table, the count taken, and the rows that wait."""
    now, wait = divert(rows, splitting)
    return *insert_batch(stored, now, order), wait


def delete_payload(stored: DataFrame, values: DataFrame) -> DataFrame:
    """Rows whose payload is none of ``values(payload)``; a null payload is never one."""
    return stored.join(values, "payload", "left_anti")


def lookup(stored: DataFrame, key: int) -> DataFrame:
    return stored.filter(F.col("id") == key)


def multi_get(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted(ord, id)`` in its order; missing ids are skipped."""
    return wanted.join(stored, "id").orderBy("ord")


def delete_where(stored: DataFrame, condition) -> DataFrame:
    """All rows for which ``condition`` is not true; null is not true."""
    return stored.filter(~F.coalesce(condition, F.lit(False)))


def remove(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids, "id", "left_anti")


def assign_ids(rows: DataFrame, order: str, node: int, n_peers: int, part: str | None = None) -> DataFrame:
    """Ids ``counter * 10**digits + node``, the counter following ``order`` (within ``part``)."""
    r = ranked(rows, [part] if part else [], [order])
    return r.withColumn("new_id", F.col("rank").cast("long") * 10 ** len(str(n_peers)) + node).drop("rank", "total")


def insert_partitioned(rows: DataFrame, path: str) -> None:
    """One folder for each cluster; a read with a cluster filter touches only its folders."""
    rows.write.mode("overwrite").partitionBy("cluster_id").parquet(path)


def prefix(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by id, or all of fewer."""
    return rows.orderBy("id").limit(n)


def batches(rows: DataFrame, order: str, size: int, servers: int = 1) -> DataFrame:
    """Adds ``batch``, ``size`` rows each in ``order``, and the ``server`` whose turn it is."""
    r = ranked(rows, [], [order]).withColumn("batch", F.expr(f"(rank - 1) div {size}")).drop("rank", "total")
    return r.withColumn("server", F.pmod("batch", F.lit(servers)))
