"""Replicas, hints, digests, reconciliation and membership as set algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearlight.session import cut


def explode_destinations(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.explode("destinations").alias("node_id"))


def deliver(copies: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Copies for reachable nodes, and hints for the others."""
    return copies.join(active, "node_id", "left_semi"), copies.join(active, "node_id", "left_anti")


def digest(replicas: DataFrame, node: int) -> DataFrame:
    return replicas.filter(F.col("node_id") == node).select("id", "ts", "node")


def digest_diff(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """``(id, what)``: ``missing_there``, ``missing_here``, ``newer_here`` or ``newer_there``."""
    a = mine.select("id", F.struct("ts", "node").alias("va"))
    b = theirs.select("id", F.struct("ts", "node").alias("vb"))
    what = (
        F.when(F.col("vb").isNull(), "missing_there").when(F.col("va").isNull(), "missing_here")
        .when(F.col("va") > F.col("vb"), "newer_here").when(F.col("va") < F.col("vb"), "newer_there")
    )
    return a.join(b, "id", "full").select("id", what.alias("what")).filter("what is not null")


def should_hold(rows: DataFrame, peer: int, calculated: DataFrame, has_clusters: bool = True) -> DataFrame:
    """Rows with ``hold``: stored destinations decide, else the calculated ones."""
    r = rows.join(calculated.select("id", F.col("destinations").alias("calc")), "id", "left")
    hold = (
        F.when(F.size(F.coalesce("destinations", F.array().cast("array<long>"))) > 0, F.array_contains("destinations", F.lit(peer).cast("long")))
        .when(F.lit(not has_clusters), F.lit(True)).otherwise(F.coalesce(F.array_contains("calc", F.lit(peer).cast("long")), F.lit(False)))
    )
    return r.withColumn("hold", hold).drop("calc")


def reconcile(replicas: DataFrame, placement: DataFrame) -> DataFrame:
    """The newest version of every id on each node of its cluster."""
    newest = replicas.groupBy("id").agg(F.max_by(F.struct("cluster_id", "ts", "node"), F.struct("ts", "node")).alias("r"))
    return newest.select("id", "r.*").join(placement, "cluster_id").select("id", "cluster_id", "ts", "node", "node_id")


def elect(members: DataFrame) -> DataFrame:
    """The highest node of each partition coordinates."""
    return members.groupBy("partition").agg(F.max("node_id").alias("coordinator"))


def last_links(events: DataFrame) -> DataFrame:
    """The last operation of each (observer, peer) of ``events(seq, observer, peer, op)``."""
    return events.groupBy("observer", "peer").agg(F.max_by("op", "seq").alias("op"))


def membership_change(before: DataFrame, after: DataFrame) -> DataFrame:
    joined = after.join(before, "node_id", "left_anti").select("node_id", F.lit("joined").alias("change"))
    return joined.unionByName(before.join(after, "node_id", "left_anti").select("node_id", F.lit("left").alias("change")))


def responsible(placement: DataFrame) -> DataFrame:
    """The node that may split a cluster: the least of its replicas."""
    return placement.groupBy("cluster_id").agg(F.min("node_id").alias("node_id"))


def load(replicas: DataFrame, nodes: DataFrame, active: DataFrame) -> DataFrame:
    """``(node_id, n)`` of reachable nodes, those without rows included."""
    counts = replicas.groupBy("node_id").agg(F.count("*").alias("n"))
    return nodes.join(active, "node_id", "left_semi").join(counts, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))


def load_stats(loads: DataFrame) -> DataFrame:
    return loads.agg(F.sum("n").alias("total"), F.avg("n").alias("average"), F.max("n").alias("most"), F.min("n").alias("least"))


def overloaded(loads: DataFrame, me: int, tolerance: float = 0.5) -> DataFrame:
    """The first node over ``average * (1 + tolerance)``, ``me`` before the others."""
    avg = loads.agg(F.avg("n").alias("average"))
    over = loads.join(F.broadcast(avg)).filter(F.col("average") > 0).filter(F.col("n") > F.col("average") * (1 + tolerance))
    return over.orderBy(F.col("node_id") != me, "node_id").limit(1)


def heaviest_cluster(replicas: DataFrame) -> DataFrame:
    """``(node_id, cluster_id, n)``: the fullest cluster of each node, ties to the least id."""
    c = replicas.groupBy("node_id", "cluster_id").agg(F.count("*").alias("n"))
    return c.groupBy("node_id").agg(F.max_by("cluster_id", F.struct("n", -F.col("cluster_id"))).alias("cluster_id"), F.max("n").alias("n"))


def underloaded(loads: DataFrame, copies: DataFrame, me: int, limit: int) -> DataFrame:
    """Other nodes by load once the split cluster's ``copies(node_id, c)`` have gone."""
    p = loads.join(copies, "node_id", "left").withColumn("projected", F.greatest(F.col("n") - F.coalesce("c", F.lit(0)), F.lit(0)))
    return p.filter(F.col("node_id") != me).orderBy("projected", "node_id").limit(limit).select("node_id", "projected")


def distinct_peers(peers: DataFrame) -> DataFrame:
    """One peer for each (ip, port), the least id."""
    return peers.groupBy("ip", "port").agg(F.min("node_id").alias("node_id"))


def replay_hints(replicas: DataFrame, hints: DataFrame, active: DataFrame) -> DataFrame:
    """Replicas once hints for reachable nodes have arrived: the newest version of each copy, the
    stored one of equals. ``hints`` has the columns of ``replicas``."""
    back = hints.join(active, "node_id", "left_semi").select(*replicas.columns)
    both = replicas.withColumn("_stored", F.lit(1)).unionByName(back.withColumn("_stored", F.lit(0)))
    rest = [c for c in replicas.columns if c not in ("id", "node_id")]
    best = both.groupBy("id", "node_id").agg(F.max_by(F.struct(*rest), F.struct("ts", "node", "_stored")).alias("r"))
    return best.select("id", "node_id", "r.*")


def hand_out(labels: DataFrame, plan: DataFrame) -> DataFrame:
    """Copies of split rows ``(id, cluster_id, label)`` for each node of ``plan(cluster_id, label, new_id,
    destinations)``, under the new cluster id."""
    new = labels.join(plan, ["cluster_id", "label"])
    return new.select("id", F.col("new_id").alias("cluster_id"), F.explode("destinations").alias("node_id"))


def allowed(peers: DataFrame, blocked: DataFrame) -> DataFrame:
    """Peers that no simulated partition of ``blocked(node_id)`` cuts off."""
    return peers.join(blocked, "node_id", "left_anti")


def reachable_peer(peers: DataFrame, active: DataFrame, node: int) -> DataFrame:
    """The peer of an id, if it is reachable."""
    return peers.filter(F.col("node_id") == node).join(active, "node_id", "left_semi")


def find_coordinator(peers: DataFrame, active: DataFrame) -> DataFrame:
    """The first reachable peer of ``peers(ord, node_id, claims)`` that claims to coordinate."""
    return peers.join(active, "node_id", "left_semi").filter("claims").orderBy("ord").limit(1)


def first_other(targets: DataFrame, me: int) -> DataFrame:
    """The first of ``targets(ord, node_id)`` that is not ``me``."""
    return targets.filter(F.col("node_id") != me).orderBy("ord").limit(1)


def invert(assignment: DataFrame) -> DataFrame:
    """``(cluster_id, destinations)`` of ``assignment(node_id, clusters)``."""
    each = assignment.select("node_id", F.explode("clusters").alias("cluster_id"))
    return each.groupBy("cluster_id").agg(F.array_sort(F.collect_set("node_id")).alias("destinations"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with their ``label`` of ``labels(id, label)``, 0 where there is none."""
    return rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", F.lit(0)))


def send(rows: DataFrame, routed: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Copies for reachable nodes, hints for the others, and ``(dropped)``, the rows without any
    destination. ``routed(id, cluster_id, destinations)``; a row's cluster is set only if it has none."""
    to = routed.select("id", F.col("cluster_id").alias("_c"), "destinations")
    all_ = rows.drop("destinations").join(to, "id", "left")
    all_ = all_.withColumn("cluster_id", F.when(F.col("cluster_id") == -1, F.coalesce("_c", F.lit(-1))).otherwise(F.col("cluster_id"))).drop("_c")
    dropped = all_.agg(F.count_if(F.coalesce(F.size("destinations"), F.lit(0)) <= 0).alias("dropped"))
    return *deliver(explode_destinations(all_), active), dropped


def replication_check(replicas: DataFrame, rf: int) -> DataFrame:
    """Distinct ids, copies, and whether every id has ``rf`` of them."""
    per = replicas.groupBy("id").agg(F.count("*").alias("c"))
    return per.agg(F.count("*").alias("n_unique"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_total"), F.coalesce(F.sum("c") == F.count("*") * rf, F.lit(True)).alias("complete"))


#: Below this share of the average load a node is short of rows; a part of a split may fall a fifth short of it.
SHORT, SLACK = 0.7, 0.8


def keep_when_planned(loads: DataFrame, me: int, sent: int, parts: int) -> DataFrame:
    """``(projected, average, keep)``: whether ``me`` should keep one of ``parts`` of the ``sent`` rows. The
    average counts ``me`` with what it will have left."""
    left = F.when(F.col("node_id") == me, F.greatest(F.col("n") - sent, F.lit(0))).otherwise(F.col("n"))
    a = loads.select("node_id", left.alias("n")).agg(F.max(F.when(F.col("node_id") == me, F.col("n"))).alias("projected"), F.avg("n").alias("average"))
    keep = (F.col("projected") < SHORT * F.col("average")) & (F.col("projected") + sent / parts >= SLACK * SHORT * F.col("average"))
    return a.withColumn("keep", F.coalesce(keep, F.lit(False)))


def keep_when_distributed(loads: DataFrame, me: int) -> DataFrame:
    """``(projected, average, keep)``: whether ``me``, its rows gone, must keep one. The average is the peers'."""
    a = loads.agg(F.max(F.when(F.col("node_id") == me, F.col("n"))).alias("projected"), F.avg(F.when(F.col("node_id") != me, F.col("n"))).alias("average"))
    return a.withColumn("keep", F.coalesce(F.col("projected") < SHORT * F.col("average"), F.lit(False)))


def by_load(loads: DataFrame, limit: int) -> DataFrame:
    """The least loaded peers; those whose load is not known come last."""
    return loads.orderBy(F.col("n").asc_nulls_last(), "node_id").limit(limit)


def chosen_replicas(forced: DataFrame, loads: DataFrame, rf: int) -> DataFrame:
    """``rf`` nodes: all of ``forced(node_id)``, then the least loaded others."""
    f = forced.select("node_id", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("n"))
    rest = loads.join(forced, "node_id", "left_anti").select("node_id", F.lit(1).alias("turn"), "n")
    return f.unionByName(rest).orderBy("turn", F.col("n").asc_nulls_last(), "node_id").limit(rf).select("node_id")


# Hints: ``(target_id, seq, ...)``, appended and never merged.
def add_hints(hints: DataFrame, target: int, rows: DataFrame) -> DataFrame:
    return hints.unionByName(rows.withColumn("target_id", F.lit(target).cast("long")).select(*hints.columns))


def take_hints(hints: DataFrame, target: int) -> tuple[DataFrame, DataFrame]:
    """A target's hints in order, and the table without them."""
    mine = F.col("target_id") == target
    return hints.filter(mine).orderBy("seq"), hints.filter(~mine)


def hint_counts(hints: DataFrame) -> DataFrame:
    return hints.groupBy("target_id").agg(F.count("*").alias("n"))


def exchange(replicas: DataFrame, a: int, b: int, calculated: DataFrame, topology: DataFrame | None = None) -> DataFrame:
    """Replicas once ``a`` and ``b`` have compared digests: each sends the other what it lacks or has
    older, if the other should hold it (stored ``destinations``, else ``calculated(id, destinations)``, else
    whatever)."""
    pair = replicas.filter(F.col("node_id").isin(a, b))
    row = F.struct(*[c for c in replicas.columns if c not in ("id", "node_id")])
    sides = pair.groupBy("id").agg(*[F.max_by(row, F.when(F.col("node_id") == n, F.struct("ts", "node"))).alias(f"r{n}") for n in (a, b)], *[F.max(F.when(F.col("node_id") == n, F.struct("ts", "node"))).alias(f"v{n}") for n in (a, b)])
    moves = None
    for src, dst in ((a, b), (b, a)):
        news = sides.filter(f"v{src} is not null and (v{dst} is null or v{src} > v{dst})").select("id", f"r{src}.*")
        hold = should_hold(news, dst, calculated, topology is None or not topology.isEmpty()).filter("hold").drop("hold")
        part = hold.withColumn("node_id", F.lit(dst).cast("long")).select(*replicas.columns)
        moves = part if moves is None else moves.unionByName(part)
    old = replicas.join(moves.select("id", "node_id"), ["id", "node_id"], "left_anti")
    return old.unionByName(moves)


def newer_topology(topologies: DataFrame) -> DataFrame:
    """The cluster list of the highest version of ``topologies(node_id, version, ...)``, the least node of equals."""
    rest = [c for c in topologies.columns if c != "node_id"]
    return topologies.agg(F.max_by(F.struct(*rest), F.struct("version", -F.col("node_id"))).alias("r")).select("r.*")


BUCKETS = 4096


def _holders(rows: DataFrame, calculated: DataFrame | None, live: list[int]) -> DataFrame:
    """Adds ``holders``, the reachable nodes that should hold a row: its stored ``destinations``, else those of
    ``calculated(id, destinations)``, which may be none; every node where nothing is calculated."""
    nodes = F.array(*[F.lit(n).cast("long") for n in live]) if live else F.array().cast("array<long>")
    stored = F.col("destinations") if "destinations" in rows.columns else F.lit(None).cast("array<long>")
    rows = rows.withColumn("_stored", stored)
    if calculated is None:
        to = F.when(F.size("_stored") > 0, F.col("_stored")).otherwise(nodes)
    else:
        rows = rows.join(calculated.select(F.col("id").alias("_id"), F.col("destinations").alias("_calc")), F.col("id") == F.col("_id"), "left")
        to = F.when(F.size("_stored") > 0, F.col("_stored")).otherwise(F.coalesce("_calc", F.array().cast("array<long>")))
    return rows.withColumn("holders", F.array_sort(F.array_intersect(to, nodes)))


def open_ranges(keys: DataFrame) -> DataFrame:
    """``(bucket)`` of ``keys(id, node_id, v, holders, bucket)`` in which copies differ.

    A node's digest of a bucket is, for each set of holders, the number of its rows and two exclusive sums of
    their hashes; a bucket is settled if all holders of each set have the same digest and nobody else has any."""
    sums = [F.bit_xor(F.xxhash64(F.lit(seed), "id", "v")) for seed in (1, 2)]
    each = keys.groupBy("bucket", "holders", "node_id").agg(F.count("*").alias("n"), sums[0].alias("h1"), sums[1].alias("h2"))
    d = F.struct("n", "h1", "h2")
    sets = each.groupBy("bucket", "holders").agg(F.array_sort(F.collect_set("node_id")).alias("nodes"), F.min(d).alias("lo"), F.max(d).alias("hi"))
    return sets.filter("nodes <> holders or lo <> hi").select("bucket").distinct()


def missing_copies(replicas: DataFrame, active: DataFrame, calculated: DataFrame | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """What all pairs of reachable nodes would send each other: ``(id, source, node_id)``, a row for each copy that is
    missing or older at a node that should hold the newest, and ``(bucket)``, the ranges of ids in which nodes differ.
    Only the newest version of an id travels, and its destinations decide; a node that it does not name keeps what it has.

    One plan, whatever the number of nodes. Ids, versions and homes are read once to digests; only ranges with
    different digests are compared by id, still without their rows."""
    live = sorted({r["node_id"] for r in active.collect()})
    here = replicas.filter(F.col("node_id").isin(live) & F.col("id").isNotNull())
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")
    version = F.struct(F.coalesce("ts", F.lit(0.0)).alias("ts"), F.coalesce("node", F.lit(0)).cast("long").alias("node"))
    narrow = here.select("id", "node_id", version.alias("v"), *(["destinations"] if "destinations" in replicas.columns else []))
    keys = cut(_holders(narrow, calculated, live).select("id", "node_id", "v", "holders", bucket.alias("bucket")), "digest-keys")
    differ = cut(open_ranges(keys), "digest-ranges")
    left = keys.join(F.broadcast(differ), "bucket", "left_semi")  # at most so many buckets
    newest = left.groupBy("id").agg(F.max_by(F.struct("v", "node_id", "holders"), F.struct("v", (-F.col("node_id")).alias("s"))).alias("o"))
    best = newest.select("id", "o.v", F.col("o.node_id").alias("source"), F.explode("o.holders").alias("node_id"))
    own = left.select(F.col("id").alias("_id"), F.col("node_id").alias("_n"), F.col("v").alias("_v"))
    news = best.join(own, (F.col("id") == F.col("_id")) & (F.col("node_id") == F.col("_n")), "left").filter("_v is null or v > _v")
    return news.select("id", "source", "node_id"), differ


def reconcile_all(replicas: DataFrame, active: DataFrame, calculated: DataFrame | None = None, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """Replicas once all reachable nodes have compared with each other, and ``(node_id, n)``, the copies that each
    received. Rows of settled ranges and of other nodes are passed on as they are, without a shuffle."""
    moves, differ = missing_copies(replicas, active, calculated, buckets)
    moves = cut(moves, "digest-moves")
    bucket = F.coalesce(F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"), F.lit(-1))
    marked = replicas.withColumn("_bucket", bucket)
    same = marked.join(F.broadcast(differ.withColumnRenamed("bucket", "_bucket")), "_bucket", "left_anti").select(*replicas.columns)
    rest = marked.join(F.broadcast(differ.withColumnRenamed("bucket", "_bucket")), "_bucket", "left_semi").select(*replicas.columns)
    sent = rest.join(moves.select("id", F.col("source").alias("node_id"), F.col("node_id").alias("_to")), ["id", "node_id"])
    sent = sent.drop("node_id").withColumnRenamed("_to", "node_id").select(*replicas.columns)
    kept = rest.join(moves.select("id", "node_id"), ["id", "node_id"], "left_anti").select(*replicas.columns)
    return same.unionByName(kept).unionByName(sent), moves.groupBy("node_id").agg(F.count("*").alias("n"))


def heal(replicas: DataFrame, hints: DataFrame, active: DataFrame, calculated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What happens when a partition ends: hints are delivered to reachable targets, then all reachable
    nodes compare. Returns replicas and the hints that are left."""
    out = cut(replay_hints(replicas, hints.drop("seq").withColumnRenamed("target_id", "node_id"), active), "healed-hints")
    left = hints.join(active.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    return reconcile_all(out, active, calculated)[0], left


# How many ids there are, from sketches that are kept and merged instead of the ids.
SKETCH = 14


def id_sketches(rows: DataFrame, *by: str) -> DataFrame:
    """``(by, sketch)``: the ids of each node, batch or whatever ``by`` names, in some 16 kB."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg("id", F.lit(SKETCH)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """``(by, ids)``: how many different ids the sketches of a group hold together, to about one percent."""
    return sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("ids"))
