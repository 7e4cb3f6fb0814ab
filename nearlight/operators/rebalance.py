"""From a buffer to a cluster layout, and from an overloaded node to a split: one chain over replicas.

``replicas`` hold ``(id, vec, payload, cluster_id, ts, node, node_id)``, a row for each stored copy. Each
step returns new tables; clusters, placement and copies change together, so that routing never meets
a cluster that is gone. Choices that could be random are the least loaded node, then the least id."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearlight.operators import clustering, replication, search, store
from nearlight.session import cut

log = logging.getLogger(__name__)

PARTS = 3
CHECK_SECONDS = 86_400  # between two looks at the load


@dataclass(frozen=True)
class Topology:
    clusters: DataFrame  # cluster_id, centroid
    placement: DataFrame  # cluster_id, node_id
    version: int = 0

    def with_clusters(self, gone: int | None, clusters: DataFrame, placement: DataFrame) -> Topology:
        """One cluster replaced by others: the next version."""
        old = F.lit(True) if gone is None else F.col("cluster_id") != gone
        return Topology(
            cut(self.clusters.filter(old).unionByName(clusters.select(*self.clusters.columns)), "topology-clusters"),
            cut(self.placement.filter(old).unionByName(placement.select(*self.placement.columns)), "topology-placement"),
            self.version + 1,
        )

    def newer(self, other: Topology) -> Topology:
        return other if other.version > self.version else self


def empty(spark: SparkSession) -> Topology:
    return Topology(spark.createDataFrame([], "cluster_id long, centroid array<double>"), spark.createDataFrame([], "cluster_id long, node_id long"))


def form(buffer: DataFrame, nodes: list[int], rf: int) -> tuple[Topology, DataFrame] | None:
    """Clusters learned from ``buffer`` and placed on ``nodes``, and the buffer's rows with their cluster
    and destinations (-1 and none for rows without a usable vector); None where no row has one."""
    learned = clustering.learn(buffer)
    if learned is None:
        return None
    labels, centroids = learned
    spark = buffer.sparkSession
    sizes = {r["cluster_id"]: r["n"] for r in labels.groupBy("cluster_id").agg(F.count("*").alias("n")).collect()}
    made = clustering.place(sizes, nodes, rf)
    placement = spark.createDataFrame([(c, n) for c, ns in made.items() for n in ns], "cluster_id long, node_id long")
    topology = empty(spark).with_clusters(None, centroids, placement)
    rows = buffer.drop("cluster_id").join(labels, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
    return topology, attached(rows, topology)


def attached(rows: DataFrame, topology: Topology) -> DataFrame:
    """Rows with the ``destinations`` of their cluster, none where it has no nodes."""
    to = topology.placement.groupBy("cluster_id").agg(F.array_sort(F.collect_set("node_id")).alias("destinations"))
    return rows.drop("destinations").join(to, "cluster_id", "left").withColumn("destinations", F.coalesce("destinations", F.array().cast("array<long>")))


def next_ids(topology: Topology) -> int:
    """The first id that no cluster has had."""
    top = topology.clusters.agg(F.max("cluster_id")).first()[0]
    return (-1 if top is None else top) + 1


def newest(replicas: DataFrame, cluster: int) -> DataFrame:
    """Each id of a cluster once, its newest copy."""
    rows = replicas.filter(F.col("cluster_id") == cluster)
    row = F.struct(*[c for c in replicas.columns if c not in ("id", "node_id")])
    return rows.groupBy("id").agg(F.max_by(row, F.struct(store.version(), -F.col("node_id"))).alias("r")).select("id", "r.*")


def plan_split(replicas: DataFrame, topology: Topology, active: DataFrame, me: int, cluster: int, rf: int, parts: int = PARTS, home: bool = True) -> tuple[DataFrame, DataFrame] | None:
    """``(label, new_id, centroid, destinations)`` of the parts, and ``(id, label)``; None for an empty
    cluster. Fewer rows than parts move as one. With ``home`` part 0 stays at ``me``; else none does, but the last, if
    ``me`` would be short of rows without it. The others go to the peers that will have least, each
    once, then to ``me``; copies go to those that will have least of the rest."""
    rows = newest(replicas, cluster)
    n = rows.count()
    if not n:
        return None
    spark = replicas.sparkSession
    if n < parts:
        labels, parts = rows.select("id", F.lit(0).cast("long").alias("label")), 1
    else:
        labels = cut(clustering.split_clusters(rows, parts).select("id", "label"), "split-labels")
    # A row for each node: its load once the cluster's copies have gone, counted up as parts are dealt.
    copies = replicas.filter(F.col("cluster_id") == cluster).groupBy("node_id").agg(F.count("*").alias("c"))
    stored = replication.load(replicas, active, active)
    load = {r["node_id"]: r["projected"] for r in replication.underloaded(stored, copies, -1, 1 << 30).collect()}
    keep = False
    if not home:
        gone = stored.join(copies, "node_id", "left").select("node_id", F.when(F.col("node_id") == me, F.col("n")).otherwise(F.greatest(F.col("n") - F.coalesce("c", F.lit(0)), F.lit(0))).alias("n"))
        keep = replication.keep_when_planned(gone, me, n, parts).first()["keep"]
    first, used, to = next_ids(topology), {me}, []
    least = lambda nodes: sorted(nodes, key=lambda x: (load[x], x))
    for i in range(parts):
        others = least(set(load) - used)
        stays = home and i == 0 or keep and i == parts - 1
        primary = me if stays or not others else others[0]
        used.add(primary)
        nodes = [primary, *least(set(load) - {primary})[: rf - 1]]
        to.append((i, first + i, nodes))
        for x in nodes:
            load[x] = load.get(x, 0) + n // parts
    found = {r["label"] for r in labels.select("label").distinct().collect()}
    plan = spark.createDataFrame([x for x in to if x[0] in found], "label long, new_id long, destinations array<long>")
    centres = clustering.centroids(rows.join(labels, "id").select(F.col("label").alias("cluster_id"), "vec")).withColumnRenamed("cluster_id", "label")
    return cut(plan.join(centres, "label", "left"), "split-plan"), labels


def kept_home(plan: DataFrame, sizes: dict[int, int], replicas: DataFrame, active: DataFrame, cluster: int, me: int) -> DataFrame:
    """The plan, or, if no part of it stays at ``me`` and ``me`` would be short of rows, the plan with the smallest part's
    last destination replaced by ``me`` (a single one stays beside it)."""
    parts = sorted((r["new_id"], r["label"], list(r["destinations"])) for r in plan.select("new_id", "label", "destinations").collect())
    if not sum(sizes.values()) or any(me in to for _, _, to in parts):
        return plan
    rest = replicas.filter(F.coalesce(F.col("cluster_id") != cluster, F.lit(True)) | (F.col("node_id") != me))
    if not replication.keep_when_distributed(replication.load(rest, active, active), me).first()["keep"]:
        return plan
    _, label, to = min(parts, key=lambda p: (sizes.get(p[1], 0), p[0]))
    to = [*(to[:-1] if len(to) > 1 else to), me]
    return plan.withColumn("destinations", F.when(F.col("label") == label, F.array(*[F.lit(x).cast("long") for x in to])).otherwise(F.col("destinations")))


def split(
    replicas: DataFrame, topology: Topology, cluster: int, plan: DataFrame, labels: DataFrame | None = None, me: int | None = None, active: DataFrame | None = None,
) -> tuple[DataFrame, Topology]:
    """Replicas and topology once ``cluster`` has become the plan's. Rows without a label go to label 0; without
    labels at all, to the nearest centroid. Every copy is written anew at its part's destinations; ``me``, if it is
    named with the ``active`` nodes, keeps a part that it must not lose (:func:`kept_home`)."""
    rows = newest(replicas, cluster)
    if labels is None:
        near = search.nearest_by_euclid(rows, plan.select(F.col("label").alias("cluster_id"), "centroid"))
        labels = near.withColumnRenamed("cluster_id", "label")
    if me is not None:
        sizes = replication.labelled(rows, labels).groupBy("label").agg(F.count("*").alias("n")).collect()
        plan = kept_home(plan, {r["label"]: r["n"] for r in sizes}, replicas, active, cluster, me)
    parts = replication.labelled(rows, labels).drop("cluster_id").join(plan.select("label", F.col("new_id").alias("cluster_id"), "destinations"), "label")
    moved = replication.explode_destinations(parts.drop("label")).select(*replicas.columns)
    # Rows without a cluster (null) are not the cluster's.
    out = replicas.filter(F.coalesce(F.col("cluster_id") != cluster, F.lit(True))).unionByName(moved)
    placed = plan.select(F.col("new_id").alias("cluster_id"), F.explode("destinations").alias("node_id"))
    return cut(out, "split-replicas"), topology.with_clusters(cluster, plan.select(F.col("new_id").alias("cluster_id"), "centroid"), placed)


def rebalance(replicas: DataFrame, topology: Topology, active: DataFrame, me: int, rf: int, parts: int = PARTS, tolerance: float = 0.5) -> tuple[DataFrame, Topology, bool]:
    """One look at the load: the first node above it (``me`` before the others) splits its fullest cluster,
    if it is the one that answers for that cluster. The last value says whether anything changed."""
    if active.count() < 2:
        return replicas, topology, False
    over = replication.overloaded(replication.load(replicas, active, active), me, tolerance).first()
    if over is None:
        return replicas, topology, False
    node = over["node_id"]
    full = replication.heaviest_cluster(replicas.filter((F.col("node_id") == node) & (F.col("cluster_id") >= 0))).first()
    if full is None:
        return replicas, topology, False
    answers = replication.responsible(topology.placement.filter(F.col("cluster_id") == full["cluster_id"])).first()
    if answers is None or answers["node_id"] != node:
        return replicas, topology, False
    plan = plan_split(replicas, topology, active, node, full["cluster_id"], rf, parts)
    if plan is None:
        return replicas, topology, False
    return *split(replicas, topology, full["cluster_id"], *plan, node, active), True


def requeue(pending: DataFrame, topology: Topology) -> DataFrame:
    """Rows that waited for a split, routed anew with cluster and destinations."""
    rows = store.unassigned(pending).drop("destinations")
    to = search.destinations(rows, topology.clusters, topology.placement)
    return rows.drop("cluster_id").join(to, "id", "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1))).withColumn("destinations", F.coalesce("destinations", F.array().cast("array<long>")))


def due(seconds: float, status: str) -> bool:
    """Whether the monitor looks at the load."""
    return status == "clustered" and seconds >= CHECK_SECONDS


def monitor(spark: SparkSession, look, status, checkpoint: str, seconds: float = CHECK_SECONDS) -> StreamingQuery:
    """Call ``look()`` every ``seconds`` while ``status()`` is ``clustered``, the first time after one interval, until the
    returned query is stopped. A look that fails is reported as the query's progress goes on."""
    began = time.monotonic()

    def tick(_, number: int) -> None:
        if time.monotonic() - began >= seconds and status() == "clustered":
            try:
                look()
            except Exception:
                log.exception("a look at the load failed")

    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return ticks.writeStream.foreachBatch(tick).trigger(processingTime=f"{max(1, round(seconds * 1000))} milliseconds").option("checkpointLocation", checkpoint).start()


def bumped(topology: Topology, version: int) -> Topology:
    return replace(topology, version=max(topology.version, version))
