"""A whole system of nodes as one object: what a client's insert or query does in each state.

Tables are DataFrames in the shared folder, replaced as a whole by each step. The state machine is
also there as Columns, so that a table of messages tells what becomes of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearlight.operators import rebalance, replication, search, store
from nearlight.session import cut

ROWS = "id long, vec array<double>, payload string, cluster_id long, ts double, node long"


def receive_action(sender: Column, status: Column, coordinates: Column, knows: Column | None = None) -> Column:
    """What becomes of rows by who sends them and the receiver's state; ``knows``: a coordinator is known."""
    knows = F.lit(True) if knows is None else knows
    start, ready = status == "bootstrap", status == "clustered"
    return (
        F.when((sender == "bootstrap") & coordinates & start, "buffer").when((sender == "bootstrap") & coordinates & ready, "route")
        .when(sender.isin("clustered", "handoff"), "save").when(sender == "reconcile", "insert")
        .when((sender == "client") & start, F.when(coordinates, "buffer").when(knows, "forward").otherwise("drop"))
        .when((sender == "client") & ready, "route").otherwise("refuse")
    )


def query_action(sender: Column, status: Column, coordinates: Column, knows: Column | None = None) -> Column:
    """As :func:`receive_action` for queries."""
    knows = F.lit(True) if knows is None else knows
    start, ready = status == "bootstrap", status == "clustered"
    return (
        F.when((sender == "client") & start, F.when(coordinates, "scan buffer").when(knows, "forward").otherwise("nothing"))
        .when((sender == "client") & ready, "search").when((sender == "bootstrap") & coordinates, F.when(start, "scan buffer").otherwise("search"))
        .when(sender == "clustered", "search").otherwise("refuse")
    )


class Engine:
    """``nodes`` with ``rf`` copies of each row; clusters are learned once ``threshold`` rows have come."""

    def __init__(self, spark: SparkSession, nodes: list[int], rf: int, threshold: int):
        self.spark, self.nodes, self.rf, self.threshold = spark, sorted(nodes), rf, threshold
        self.active = spark.createDataFrame([(n,) for n in self.nodes], "node_id long")
        self.status, self.dropped, self.inserted = "bootstrap", 0, 0
        self.topology = rebalance.empty(spark)
        self.buffer = spark.createDataFrame([], ROWS)
        self.replicas = spark.createDataFrame([], f"{ROWS}, node_id long")
        self.hints = spark.createDataFrame([], f"{ROWS}, target_id long, seq long")
        self.pending = spark.createDataFrame([], ROWS)
        self.splitting = spark.createDataFrame([], "cluster_id long")

    @property
    def coordinator(self) -> int | None:
        return self.active.agg(F.max("node_id")).first()[0]

    def insert(self, rows: DataFrame, order: str, now: float) -> None:
        """Client rows ``(vec, payload)`` and ``order``, stamped as they come."""
        base = self.inserted
        new = store.stamp(rows, order, self.coordinator or 0, len(self.nodes), now)
        step = 10 ** len(str(len(self.nodes)))
        new = cut(new.withColumn("id", F.col("id") + base * step).withColumn("vec", F.col("vec").cast("array<double>")).select("id", "vec", "payload", "cluster_id", "ts", "node"), "engine-new")
        self.inserted += new.count()
        self.receive(new, "client")

    def _says(self, action, sender: str, at: int | None) -> str:
        """What a node (the coordinator, if none is named) does with what ``sender`` sends."""
        lead = self.coordinator
        return self.spark.range(1).select(action(F.lit(sender), F.lit(self.status), F.lit(lead is not None and at in (None, lead)), F.lit(lead is not None))).first()[0]

    def receive(self, rows: DataFrame, sender: str, at: int | None = None) -> str:
        """Rows from a client or from a node, at a node; what was done with them."""
        action = self._says(receive_action, sender, at)
        if action == "forward":
            self.receive(rows, sender)
        elif action == "drop":
            self.dropped += rows.count()
        elif action == "buffer":
            self.buffer = cut(store.upsert(self.buffer, rows.select(*self.buffer.columns)), "engine-buffer")
            self._cluster()
        elif action == "route":
            self._route(rows)
        elif action == "save":
            self._save(rows)
        elif action == "insert":
            self.replicas = cut(self._merged(rows), "engine-replicas")
        return action

    def _cluster(self) -> None:
        if self.buffer.count() < self.threshold:
            return
        made = rebalance.form(self.buffer, [r["node_id"] for r in self.active.collect()], self.rf)
        if made is None:
            return
        self.set_clusters(made[0])
        self._send(made[1])
        self.buffer = self.spark.createDataFrame([], ROWS)

    def set_clusters(self, topology: rebalance.Topology) -> None:
        """Adopt a newer layout; from then on rows are routed."""
        self.topology, self.status = self.topology.newer(topology), "clustered"

    def _route(self, rows: DataFrame) -> None:
        self._send(rebalance.requeue(rows, self.topology))

    def _send(self, rows: DataFrame) -> None:
        routed = rows.select("id", "cluster_id", "destinations")
        copies, hints, lost = replication.send(rows.drop("destinations"), routed, self.active)
        self.dropped += lost.first()["dropped"]
        late = hints.withColumn("target_id", F.col("node_id")).withColumn("seq", F.monotonically_increasing_id())
        self.hints = cut(self.hints.unionByName(late.select(*self.hints.columns)), "engine-hints")
        self._save(copies.drop("destinations"))

    def _save(self, copies: DataFrame) -> None:
        now, wait = store.divert(copies, self.splitting)
        self.pending = cut(store.upsert(self.pending, wait.select(*self.pending.columns)), "engine-pending")
        self.replicas = cut(self._merged(now), "engine-replicas")

    def _merged(self, copies: DataFrame) -> DataFrame:
        """Last writer wins for each node's copy."""
        to = copies.select("id", "vec", "payload", "cluster_id", "ts", "node", F.col("node_id").alias("target_id"))
        return replication.replay_hints(self.replicas, to.withColumnRenamed("target_id", "node_id"), self.active).select(*self.replicas.columns)

    def query(self, queries: DataFrame, k: int = 100, look: int = 4, at: int | None = None) -> DataFrame:
        """``(qid, rank, id, score, vec, payload)`` of a client's queries at a node."""
        action = self._says(query_action, "client", at)
        if action == "forward":
            return self.query(queries, k, look)
        if action in ("scan buffer", "nothing"):
            queries = queries if action == "scan buffer" else queries.limit(0)
            return search.with_rows(search.topk(queries, self.buffer, k), self.buffer)
        found = search.search_routed(queries, self.topology.clusters, self.topology.placement, self.active, self.replicas, k, look)
        rows = self.replicas.groupBy("id").agg(F.max_by(F.struct("vec", "payload"), F.struct(store.version(), -F.col("node_id"))).alias("r")).select("id", "r.*")
        return search.with_rows(found, rows)

    def begin_split(self, cluster: int) -> None:
        self.splitting = self.spark.createDataFrame([(cluster,)], "cluster_id long")

    def end_split(self) -> None:
        """Rows that waited are routed anew."""
        self.splitting = self.spark.createDataFrame([], "cluster_id long")
        wait, self.pending = self.pending, self.spark.createDataFrame([], ROWS)
        self._route(wait)

    def rebalance(self, parts: int = rebalance.PARTS, tolerance: float = 0.5) -> bool:
        if self.status != "clustered":
            return False
        me = self.active.agg(F.min("node_id")).first()[0]
        self.replicas, self.topology, moved = rebalance.rebalance(self.replicas, self.topology, self.active, me, self.rf, parts, tolerance)
        return moved

    def set_active(self, nodes: list[int]) -> DataFrame:
        """Reachability changes: who joined or left; on a change hints are delivered and copies compared."""
        after = self.spark.createDataFrame([(n,) for n in sorted(nodes)], "node_id long")
        change = cut(replication.membership_change(self.active, after), "engine-change")
        self.active = after
        if nodes and not change.isEmpty():
            self.heal()
        return change

    def heal(self) -> None:
        to = search.destinations(self.replicas.select("id", "vec").dropDuplicates(["id"]), self.topology.clusters, self.topology.placement)
        held = self.replicas.withColumn("destinations", F.lit(None).cast("array<long>"))
        late = self.hints.withColumn("destinations", F.lit(None).cast("array<long>")).select(*[c for c in held.columns if c != "node_id"], "target_id", "seq")
        # Stored clusters decide where a copy belongs; vectors only where a row has none.
        stored = rebalance.attached(self.replicas.select("id", "cluster_id").dropDuplicates(["id"]), self.topology).select("id", F.col("destinations").alias("own"))
        calc = to.select("id", "destinations").join(stored, "id", "full").select("id", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("destinations")).alias("destinations"))
        out, left = replication.heal(held, late, self.active, cut(calc, "engine-homes"))
        self.replicas = cut(out.drop("destinations"), "engine-replicas")
        self.hints = cut(left.select(*self.hints.columns), "engine-hints")
