"""Registered queries over the whole given tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearlight.functions import dot, euclid, norm
from nearlight.operators import ann, clustering, engine, health, rebalance, replication, search, store
from nearlight.session import kept_dir
from nearlight.sources import requests
from nearlight.sources import tables as t
from nearlight.sources.collections import Collections
from nearlight.streaming import ingest

QUERIES: dict = {}
ORACLE: dict = {}

#: Tables of the data model as DuckDB sees them.
BASE = """
with vectors as (
  select vec_id as id, embedding::double[] as vec, label::bigint as cluster_id, (vec_id % 7)::double as ts, vec_id % 8 as node from embeddings
), queries as (select id as qid, vec as qvec from vectors where id % 50 = 0),
nodes as (select unnest(range(8)) as node_id), active as (select node_id from nodes where node_id not in (2, 5)),
placement as (select cluster_id, unnest([cluster_id % 8, (cluster_id + 1) % 8, (cluster_id + 3) % 8]) as node_id from (select distinct cluster_id from vectors)),
replicas as (
  select v.id, v.vec, v.cluster_id, v.ts - case when (v.id + p.node_id) % 3 = 0 then 1 else 0 end as ts, v.node, p.node_id
  from vectors v join placement p using (cluster_id) where v.id % 5 <> p.node_id % 5
), incoming as (
  select id, vec, cluster_id + 100 as cluster_id, ts + case id % 3 when 0 then 1 when 1 then 0 else -1 end as ts, node from vectors
), each as (select cluster_id, generate_subscripts(vec, 1) as pos, unnest(vec) as x from vectors),
clusters as (
  select cluster_id, list(m order by pos) as centroid from (select cluster_id, pos, avg(x) as m from each group by all) group by 1
), near as (
  select v.id, c.cluster_id, list_dot_product(v.vec, c.centroid) / sqrt(list_dot_product(v.vec, v.vec) * list_dot_product(c.centroid, c.centroid)) as score
  from vectors v, clusters c
), nearest as (select *, row_number() over (partition by id order by score desc, cluster_id) as rank from near),
sims as (select id, node_id, max(score) as sim from near join placement using (cluster_id) group by all),
loads as (
  select n.node_id, coalesce(c.n, 0)::bigint as n from active n left join (select node_id, count(*) as n from replicas group by 1) c using (node_id)
), beats as (select user_id::bigint as peer_id, epoch_us(ts::timestamp) / 1000.0 as ms from events),
samples as (select event_type, (user_id % 8)::bigint as server, value::double as ms, epoch_us(ts::timestamp) / 1000.0 as end_ms from events)
"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = BASE + sql
        return f

    return add


def _r(df, *cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else c for c in df.columns])


def _centroids(spark, sf):
    return clustering.centroids(t.vectors(spark, sf))


_TOP = """select qid, id, round(score, 6) as score, rank from (
  select qid, id, {s} as score, row_number() over (partition by qid order by {s} {o}, id) as rank from queries, vectors) where rank <= 10"""
_COS = "list_dot_product(qvec, vec) / sqrt(list_dot_product(qvec, qvec) * list_dot_product(vec, vec))"
_L2 = "list_distance(qvec, vec)"


@query(_TOP.format(s=_COS, o="desc"))
def vec_topk_cosine(spark, sf):
    return _r(search.topk(t.queries(spark, sf), t.vectors(spark, sf), 10), "score")


@query(_TOP.format(s="list_dot_product(qvec, vec)", o="desc"))
def vec_topk_dot(spark, sf):
    return _r(search.topk(t.queries(spark, sf), t.vectors(spark, sf), 10, "dot"), "score")


@query(f"""select qid, id, rank, round(score, 6) as score from (
  select qid, id, {_L2} as score, row_number() over (partition by qid order by round({_L2}, 9), id) as rank from queries, vectors) where rank <= 10""")
def vec_topk_euclid(spark, sf):
    return _r(search.topk(t.queries(spark, sf), t.vectors(spark, sf), 10, "euclid"), "score").select("qid", "id", "rank", "score")


@query(f"select id, round(max({_COS}), 6) as score from queries, vectors where qid <> id group by id order by max({_COS}) desc, id limit 100")
def vec_topk_merged_global(spark, sf):
    got = search.topk(t.queries(spark, sf), t.vectors(spark, sf), 101).filter("qid <> id")
    return _r(search.merged(got.select("qid", "id", "score"), 100), "score")


def _index(spark, sf, metric="cosine"):
    return ann.build(t.vectors(spark, sf), kept_dir(spark, "index"), metric)


@query()
def index_topk(spark, sf):
    """By the lists and codes that the index has measured to be enough; a test holds its recall against brute force."""
    return _r(_index(spark, sf).search(t.queries(spark, sf), 10), "score")


@query(_TOP.format(s=_COS, o="desc"))
def index_topk_all_lists(spark, sf):
    index = _index(spark, sf)
    return _r(index.search(t.queries(spark, sf), 10, probes=len(index.centres), depth=0), "score")


@query("select id, cluster_id, round(score, 6) as score, rank from nearest where rank <= 3")
def index_nearest_cluster_k(spark, sf):
    """Clusters through an index of their own, loaded from its folder."""
    c = _centroids(spark, sf).select(F.col("cluster_id").alias("id"), F.col("centroid").alias("vec"))
    path = kept_dir(spark, "cluster-index")
    ann.build(c, path, n_lists=1)
    return _r(search.nearest_clusters(t.vectors(spark, sf), _centroids(spark, sf), 3, ann.load(spark, path)), "score")


@query("select id, round(sqrt(list_dot_product(vec, vec)), 6) as norm, round(list_dot_product(vec, centroid), 6) as dot, round(list_distance(vec, centroid), 6) as dist from vectors join clusters using (cluster_id)")
def vec_scalar_functions(spark, sf):
    c = t.vectors(spark, sf).join(_centroids(spark, sf), "cluster_id")
    return _r(c.select("id", norm("vec").alias("norm"), dot("vec", "centroid").alias("dot"), euclid("vec", "centroid").alias("dist")), "norm", "dot", "dist")


@query("select id, cluster_id, ts, node from vectors where id = 7")
def vec_point_lookup(spark, sf):
    return store.lookup(t.vectors(spark, sf), 7).select("id", "cluster_id", "ts", "node")


@query("select qid as ord, id, cluster_id from queries join vectors on id = qid + 1")
def vec_multi_get(spark, sf):
    wanted = t.queries(spark, sf).select(F.col("qid").alias("ord"), (F.col("qid") + 1).alias("id"))
    return store.multi_get(t.vectors(spark, sf), wanted).select("ord", "id", "cluster_id")


@query("select id, ts, node from vectors where cluster_id = 3")
def vec_filter_cluster(spark, sf):
    return t.vectors(spark, sf).filter("cluster_id = 3").select("id", "ts", "node")


@query("select id, cluster_id from vectors where cluster_id <> 3 or cluster_id is null")
def vec_delete_by_cluster(spark, sf):
    return store.delete_where(t.vectors(spark, sf), F.col("cluster_id") == 3).select("id", "cluster_id")


@query("select id, arg_max(cluster_id, (ts, node, seq)) as cluster_id, arg_max(ts, (ts, node, seq)) as ts from (select *, 1 as seq from vectors union all select *, 0 from incoming) group by id")
def vec_lww_upsert(spark, sf):
    return store.upsert(t.vectors(spark, sf), t.incoming(spark, sf)).select("id", "cluster_id", "ts")


@query("select count(*) as n from incoming i left join vectors v using (id) where v.id is null or (i.ts, i.node) > (v.ts, v.node)")
def vec_lww_accept_count(spark, sf):
    return store.accepted(t.vectors(spark, sf), t.incoming(spark, sf)).agg(F.count("*").alias("n"))


@query("select id, row_number() over (partition by cluster_id order by id) * 10 + cluster_id as new_id from vectors")
def vec_id_assign(spark, sf):
    return store.assign_ids(t.vectors(spark, sf), "id", 0, 8, "cluster_id").select("id", (F.col("new_id") + F.col("cluster_id")).alias("new_id"))


@query("select id from vectors where id not in (select qid from queries)")
def vec_remove_by_id(spark, sf):
    return store.remove(t.vectors(spark, sf), t.queries(spark, sf).select(F.col("qid").alias("id"))).select("id")


@query("select id, ts, node from replicas where node_id = 1")
def vec_digest(spark, sf):
    return replication.digest(t.replicas(spark, sf), 1)


@query("""select id, case when b.id is null then 'missing_there' when a.id is null then 'missing_here' when (a.ts, a.node) > (b.ts, b.node) then 'newer_here' else 'newer_there' end as what
from (select * from replicas where node_id = 1) a full join (select * from replicas where node_id = 3) b using (id)
where a.id is null or b.id is null or (a.ts, a.node) <> (b.ts, b.node)""")
def digest_difference(spark, sf):
    r = t.replicas(spark, sf)
    return replication.digest_diff(replication.digest(r, 1), replication.digest(r, 3))


@query("""select n.id, n.cluster_id, n.v.ts as ts, n.v.node as node, p.node_id from (select id, any_value(cluster_id) as cluster_id, max({'ts': ts, 'node': node}) as v from replicas group by id) n
join placement p using (cluster_id)""")
def reconcile_all_replicas(spark, sf):
    r = t.replicas(spark, sf)
    return replication.reconcile(r, t.placement(t.vectors(spark, sf)))


@query("select cluster_id, pos, round(avg(x), 6) as m from each group by all")
def centroids_by_label(spark, sf):
    c = _centroids(spark, sf).select("cluster_id", F.posexplode("centroid").alias("pos", "m"))
    return c.select("cluster_id", (F.col("pos") + 1).cast("long").alias("pos"), F.round("m", 6).alias("m"))


@query("select id, cluster_id, round(score, 6) as score from nearest where rank = 1")
def nearest_cluster_1(spark, sf):
    return _r(search.nearest_clusters(t.vectors(spark, sf), _centroids(spark, sf), 1).select("id", "cluster_id", "score"), "score")


@query("select id, cluster_id, round(score, 6) as score, rank from nearest where rank <= 3")
def nearest_cluster_k(spark, sf):
    return _r(search.nearest_clusters(t.vectors(spark, sf), _centroids(spark, sf), 3), "score")


@query("select id, arg_min(c.cluster_id, (list_distance(vec, centroid), c.cluster_id)) as cluster_id from vectors v, clusters c group by id")
def split_relabel_nearest_centroid(spark, sf):
    return search.nearest_by_euclid(t.vectors(spark, sf), _centroids(spark, sf))


@query("select id, node_id, round(sim, 6) as sim from sims")
def node_similarity_max(spark, sf):
    v = t.vectors(spark, sf)
    return _r(search.node_similarity(v, _centroids(spark, sf), t.placement(v)), "sim")


_ROUTED = """, cand as (
  select s.id, s.node_id, s.sim, exists (select 1 from nearest n join placement p using (cluster_id) where n.id = s.id and n.rank <= 3 and p.node_id = s.node_id) as hit
  from sims s where s.node_id in (select node_id from active)
), routed as (
  select id, node_id, sim, row_number() over (partition by id order by sim desc, node_id) as rank
  from (select *, bool_or(hit) over (partition by id) as anyhit from cand) where hit or not anyhit
)
"""


@query(_ROUTED + "select id, node_id, round(sim, 6) as sim, rank from routed where rank <= 3")
def route_vectors_topk(spark, sf):
    v = t.vectors(spark, sf)
    return _r(search.route(v, _centroids(spark, sf), t.placement(v), t.active(spark)), "sim")


@query("select n.id, n.cluster_id, p.node_id from nearest n join placement p using (cluster_id) where rank = 1")
def destinations_explode(spark, sf):
    v = t.vectors(spark, sf)
    return replication.explode_destinations(search.destinations(v, _centroids(spark, sf), t.placement(v))).select("id", "cluster_id", "node_id")


@query("select id, node_id from (select *, row_number() over (partition by id order by sim desc, node_id) as r from sims) where r <= 3")
def destinations_fallback_top_rf(spark, sf):
    v = t.vectors(spark, sf)
    return replication.explode_destinations(search.destinations_without_index(v, _centroids(spark, sf), t.placement(v), 3)).select("id", "node_id")


_SEARCHED = _ROUTED + f""", found as (
  select qid, r.node_id, v.id, {_COS.replace('vec)', 'v.vec)').replace('qv.vec', 'qvec').replace('(vec,', '(v.vec,')} as score
  from queries join routed r on r.id = qid and r.rank = 1 join replicas v on v.node_id = r.node_id
), best as (select *, row_number() over (partition by qid order by score desc, id) as rank from found)
"""


def _routed(spark, sf):
    v = t.vectors(spark, sf)
    return search.search_routed(t.queries(spark, sf), _centroids(spark, sf), t.placement(v), t.active(spark), t.replicas(spark, sf), 10)


@query(_SEARCHED + "select qid, node_id, id, round(score, 6) as score, rank from best where rank <= 10")
def search_routed_best_node(spark, sf):
    return _r(_routed(spark, sf), "score")


@query(_SEARCHED + f""", exact as (
  select * from (select qid, id, row_number() over (partition by qid order by {_COS} desc, id) as rank from queries, vectors) where rank <= 10
) select e.qid, round(count(b.id) / count(*), 6) as recall from exact e left join (select * from best where rank <= 10) b on b.qid = e.qid and b.id = e.id group by e.qid""")
def search_recall_at_10(spark, sf):
    exact = search.topk(t.queries(spark, sf), t.vectors(spark, sf), 10)
    return _r(search.recall(exact, _routed(spark, sf)), "recall")


@query("select cluster_id, count(*) as n from vectors group by 1")
def cluster_sizes(spark, sf):
    return t.vectors(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("select node_id, arg_max(cluster_id, (n, -cluster_id)) as cluster_id, max(n) as n from (select node_id, cluster_id, count(*) as n from replicas group by all) group by node_id")
def heaviest_cluster_per_node(spark, sf):
    return replication.heaviest_cluster(t.replicas(spark, sf))


def _loads(spark, sf):
    return replication.load(t.replicas(spark, sf), t.nodes(spark), t.active(spark))


@query("select sum(n)::bigint as total, round(avg(n), 6) as average, max(n) as most, min(n) as least from loads")
def load_stats(spark, sf):
    return _r(replication.load_stats(_loads(spark, sf)), "average")


@query("select node_id, n from loads where n > 1.1 * (select avg(n) from loads) order by node_id <> 4, node_id limit 1")
def detect_imbalance(spark, sf):
    return replication.overloaded(_loads(spark, sf), 4, 0.1).select("node_id", "n")


@query("select cluster_id, min(node_id) as node_id from placement group by 1")
def rebalance_responsible(spark, sf):
    return replication.responsible(t.placement(t.vectors(spark, sf)))


@query("select node_id, greatest(n - coalesce(c, 0), 0) as projected from loads left join (select node_id, count(*) as c from replicas where cluster_id = 1 group by 1) using (node_id) where node_id <> 1 order by projected, node_id limit 3")
def underloaded_peers(spark, sf):
    copies = t.replicas(spark, sf).filter("cluster_id = 1").groupBy("node_id").agg(F.count("*").alias("c"))
    return replication.underloaded(_loads(spark, sf), copies, 1, 3)


@query("select cluster_id, case when ceil(1.2 * n / 3) * 3 < n then ceil(n / 3) + 1 else ceil(1.2 * n / 3) end::bigint as size_limit from (select cluster_id, count(*) as n from vectors group by 1)")
def split_max_size(spark, sf):
    n = t.vectors(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n"))
    m = F.ceil(1.2 * F.col("n") / 3)
    return n.select("cluster_id", F.when(m * 3 < F.col("n"), F.ceil(F.col("n") / 3) + 1).otherwise(m).cast("long").alias("size_limit"))


def _delivered(spark, sf):
    v = t.vectors(spark, sf)
    copies = replication.explode_destinations(search.destinations(v, _centroids(spark, sf), t.placement(v)))
    return replication.deliver(copies, t.active(spark))


@query("select p.node_id, count(*) as n from nearest n join placement p using (cluster_id) where rank = 1 and p.node_id not in (select node_id from active) group by 1")
def hints_by_target(spark, sf):
    return _delivered(spark, sf)[1].groupBy("node_id").agg(F.count("*").alias("n"))


@query("select n.id, p.node_id from nearest n join placement p using (cluster_id) where rank = 1 and p.node_id = 2")
def hints_deliverable(spark, sf):
    back = spark.createDataFrame([(2,)], "node_id long")
    return replication.deliver(_delivered(spark, sf)[1], back)[0].select("id", "node_id")


#: Every user of the events as a node, and reachable unless its last event is an error.
_USERS = """, users as (select user_id::bigint as node_id, min(event_id) as ord, arg_max(event_type, event_id) <> 'error' as up from events group by 1),
up as (select node_id from users where up)
"""


def _users(spark, sf, rows="true"):
    last = t.read(spark, sf, "events").filter(rows).groupBy(F.col("user_id").cast("long").alias("node_id"))
    return last.agg(F.min("event_id").alias("ord"), (F.max_by("event_type", "event_id") != "error").alias("up"))


def _up(spark, sf, rows="true"):
    return _users(spark, sf, rows).filter("up").select("node_id")


@query(_USERS + "select node_id % 4 as partition, max(node_id) as coordinator from up group by 1")
def elect_coordinator_per_partition(spark, sf):
    return replication.elect(_up(spark, sf).withColumn("partition", F.col("node_id") % 4))


@query(_USERS + """, early as (select user_id::bigint as node_id from events where event_id % 3 = 0 group by 1 having arg_max(event_type, event_id) <> 'error')
select node_id, 'joined' as change from up where node_id not in (select node_id from early) union all select node_id, 'left' from early where node_id not in (select node_id from up)""")
def membership_change(spark, sf):
    return replication.membership_change(_up(spark, sf, "event_id % 3 = 0"), _up(spark, sf))


@query("select peer_id, ms, round(ms - lag(ms) over (partition by peer_id order by ms), 3) as gap from beats")
def heartbeat_intervals(spark, sf):
    g = health.intervals(t.heartbeats(spark, sf))
    return g.select("peer_id", "ms", F.round("gap", 3).alias("gap"))


_BEATS = """, gaps as (select *, ms - lag(ms) over (partition by peer_id order by ms) as gap from beats),
wins as (select *, coalesce(avg(gap) over w, 3000) as mean, coalesce(var_pop(gap) over w, 0) as var from gaps window w as (partition by peer_id order by ms rows between 499 preceding and current row))
"""


@query(_BEATS + "select peer_id, ms, round(mean, 3) as mean, round(sqrt(var), 2) as std from wins")
def heartbeat_window_stats(spark, sf):
    w = health.window_stats(t.heartbeats(spark, sf))
    return w.select("peer_id", "ms", F.round("mean", 3).alias("mean"), F.round(F.sqrt("var"), 2).alias("std"))


NOW = "(select max(ms) from beats)"


def _now(spark, sf):
    return t.heartbeats(spark, sf).agg(F.max("ms")).first()[0]


@query(_BEATS + f"select peer_id, ({NOW} - ms - mean) / greatest(sqrt(var), 100) < 5.612001244174788 as available from wins qualify row_number() over (partition by peer_id order by ms desc) = 1")
def heartbeat_available(spark, sf):
    return health.suspicion(t.heartbeats(spark, sf), _now(spark, sf)).select("peer_id", "available")


_CHANGES = _BEATS + f""", dated as (
  select *, lag(ms + mean + 5.612001244174788 * greatest(sqrt(var), 100)) over w as due, row_number() over w as beat, lead(ms) over w as next,
         ms + mean + 5.612001244174788 * greatest(sqrt(var), 100) as own from wins window w as (partition by peer_id order by ms)
), changes as (
  select peer_id, ms, 'contact' as cause from dated where beat = 1
  union all select peer_id, due, 'silence' from dated where ms >= due
  union all select peer_id, ms, 'return' from dated where ms >= due
  union all select peer_id, own, 'silence' from dated where next is null and {NOW} >= own
)
"""


@query(_CHANGES + "select peer_id, cause, round(ms, -2) as ms, cause <> 'silence' as available from changes")
def heartbeat_changes(spark, sf):
    """Contact, silence and return of every peer, by timers where nothing comes any more."""
    got = ingest.suspicions(spark, t.heartbeats(spark, sf).withColumn("answered", F.lit(True)))
    return got.select("peer_id", "cause", F.round("ms", -2).alias("ms"), "available")


@query(_CHANGES + "select peer_id, arg_max(cause, (ms, cause)) <> 'silence' as available from changes group by 1")
def heartbeat_available_stream(spark, sf):
    got = ingest.suspicions(spark, t.heartbeats(spark, sf).withColumn("answered", F.lit(True)))
    return got.groupBy("peer_id").agg(F.max_by("available", F.struct("ms", "cause")).alias("available"))


@query("""select id, case when b then -1 else cluster_id end as cluster_id, b as released
from (select id, cluster_id, cluster_id in (3, 4) and id > 100 and id < 400 as b from vectors) where not (cluster_id = 4 and id > 100)""")
def split_divert_stream(spark, sf):
    """Clusters 3 and 4 are split from row 100 on; 3 until row 400, 4 without end, so that its rows still wait."""
    v = t.vectors(spark, sf).select("cluster_id", (2 * F.col("id")).alias("seq"), F.lit("row").alias("kind"), "id")
    told = spark.createDataFrame([(3, 201, "begin", None), (4, 201, "begin", None), (3, 799, "end", None)], "cluster_id long, seq long, kind string, id long")
    return ingest.divert(spark, v.unionByName(told)).select("id", "cluster_id", "released")


@query()
def phi_value(spark, sf):
    return health.suspicion_value(t.heartbeats(spark, sf), _now(spark, sf)).select("peer_id", F.round("phi", 6).alias("phi"))



@query("""select event_type, n, round(mean, 6) as mean, round(median, 6) as median, round(std, 6) as std,
round(case when n < 20 then most else v[a] + ((n + 1) * 0.95::double - a) * (v[a + 1] - v[a]) end, 6) as p95,
round(case when n < 100 then most else v[b] + ((n + 1) * 0.99::double - b) * (v[b + 1] - v[b]) end, 6) as p99
from (select *, least(greatest(floor((n + 1) * 0.95::double), 1), n - 1)::bigint as a, least(greatest(floor((n + 1) * 0.99::double), 1), n - 1)::bigint as b from (
select event_type, count(*) as n, avg(ms) as mean, median(ms) as median, stddev_samp(ms) as std, max(ms) as most, list(ms order by ms) as v from samples group by 1))""")
def latency_summary(spark, sf):
    return _r(health.latency(t.latencies(spark, sf), "event_type"), "mean", "median", "std", "p95", "p99")


@query("""select server, n, round(mean, 6) as mean, round(diff, 6) as diff, case when diff <= 10 then 'OK' when diff <= 30 then 'WARN' else 'SLOW' end as status
from (select server, n, mean, (mean - g) / g * 100 as diff from (select server, count(*) as n, avg(ms) as mean from samples group by 1), (select avg(ms) as g from samples))""")
def per_server_report(spark, sf):
    return _r(health.server_report(t.latencies(spark, sf)), "mean", "diff")


@query("select event_type, round(count(*) / ((max(end_ms) - min(end_ms)) / 1000.0), 6) as ops from samples group by 1")
def throughput_by_scenario(spark, sf):
    return _r(health.throughput(t.latencies(spark, sf), "event_type"), "ops")


@query()
def kmeans_select_k(spark, sf):
    out, _ = clustering.choose_k(t.vectors(spark, sf).withColumn("vec", F.col("vec").cast("array<double>")))
    return out


@query("select id, arg_max(cluster_id, (ts, node, seq)) as cluster_id, max(ts) as ts from (select *, 1 as seq from vectors union all select *, 0 from incoming) group by id")
def stream_lww(spark, sf):
    return ingest.replay(spark, [t.vectors(spark, sf), t.incoming(spark, sf)]).select("id", "cluster_id", "ts")


@query("select id, cluster_id from vectors order by id limit 100")
def vec_prefix_scan(spark, sf):
    return store.prefix(t.vectors(spark, sf), 100).select("id", "cluster_id")


@query("select id, cluster_id, case when id % 3 = 0 then 2 in (id % 4, (id + 1) % 4) else exists (select 1 from placement p where p.cluster_id = v.cluster_id and p.node_id = 2) end as hold from vectors v")
def vec_should_hold(spark, sf):
    v = t.vectors(spark, sf)
    stored = F.when(F.col("id") % 3 == 0, F.array(F.col("id") % 4, (F.col("id") + 1) % 4))
    held = t.placement(v).groupBy("cluster_id").agg(F.collect_set("node_id").alias("destinations"))
    calculated = v.select("id", "cluster_id").join(held, "cluster_id", "left")
    return replication.should_hold(v.select("id", "cluster_id", stored.alias("destinations")), 2, calculated).select("id", "cluster_id", "hold")


@query("select observer, peer, arg_max(op, event_id) as op from (select event_id, user_id % 8 as observer, event_id % 7 as peer, case event_id % 3 when 0 then 'block' else 'unblock' end as op from events) group by all")
def partition_link_state(spark, sf):
    e = t.read(spark, sf, "events")
    op = F.when(F.col("event_id") % 3 == 0, "block").otherwise("unblock")
    return replication.last_links(e.select(F.col("event_id").alias("seq"), (F.col("user_id") % 8).alias("observer"), (F.col("event_id") % 7).alias("peer"), op.alias("op")))


@query("select ip, port, min(node_id) as node_id from (select user_id::bigint as node_id, 'host' || user_id % 9 as ip, user_id % 11 as port from events) group by all")
def peers_distinct(spark, sf):
    e = t.read(spark, sf, "events")
    return replication.distinct_peers(e.select(F.col("user_id").cast("long").alias("node_id"), F.concat(F.lit("host"), F.col("user_id") % 9).alias("ip"), (F.col("user_id") % 11).alias("port")))


@query("""select id, node_id, arg_max(cluster_id, (ts, node, stored)) as cluster_id, arg_max(ts, (ts, node, stored)) as ts, arg_max(node, (ts, node, stored)) as node from (
  select id, node_id, cluster_id, ts, node, 1 as stored from replicas
  union all select id, node_id, i.cluster_id + 100, i.ts, i.node, 0 from (select id, cluster_id - 100 as cluster_id, ts, node from incoming) i join placement p using (cluster_id) where p.node_id in (select node_id from active)
) group by all""")
def hints_replay(spark, sf):
    hints = t.incoming(spark, sf).withColumn("home", F.col("cluster_id") - 100).join(t.placement(t.vectors(spark, sf)).withColumnRenamed("cluster_id", "home"), "home")
    stored = t.replicas(spark, sf).select("id", "node_id", "cluster_id", "ts", "node")
    return replication.replay_hints(stored, hints, t.active(spark))


@query("select id, 1000 + cluster_id * 3 + id % 3 as cluster_id, unnest([(cluster_id + id % 3) % 8, (cluster_id + id % 3 + 4) % 8]) as node_id from vectors")
def split_hand_out(spark, sf):
    v = t.vectors(spark, sf)
    c, l = F.col("cluster_id"), F.col("label")
    plan = v.select("cluster_id").distinct().select("cluster_id", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("label"))
    plan = plan.select("cluster_id", "label", (1000 + c * 3 + l).alias("new_id"), F.array((c + l) % 8, (c + l + 4) % 8).alias("destinations"))
    return replication.hand_out(v.select("id", "cluster_id", (F.col("id") % 3).alias("label")), plan)


@query("""select peer_id, ms, epoch, round(case when not reset then ms - prev end, 3) as gap from (
  select *, lag(ms) over w as prev, sum(reset::bigint) over (w rows between unbounded preceding and current row)::bigint as epoch
  from (select user_id::bigint as peer_id, epoch_us(ts::timestamp) / 1000.0 as ms, event_id % 20 = 0 as reset from events) window w as (partition by peer_id order by ms))""")
def heartbeat_after_reset(spark, sf):
    e = t.read(spark, sf, "events")
    beats = e.select(F.col("user_id").cast("long").alias("peer_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0).alias("ms"), (F.col("event_id") % 20 == 0).alias("reset"))
    return health.after_resets(beats).select("peer_id", "ms", "epoch", F.round("gap", 3).alias("gap"))


@query("""select fastest, slowest, round(diff, 6) as diff, case when diff > 50 then 'warning' when diff > 20 then 'notice' else 'balanced' end as level from (
  select arg_min(server, (mean, server)) as fastest, arg_max(server, (mean, -server)) as slowest, (max(mean) - min(mean)) / min(mean) * 100 as diff
  from (select server, avg(ms) as mean from samples group by 1))""")
def server_extremes(spark, sf):
    return _r(health.extremes(t.latencies(spark, sf)), "diff")


@query("select i as cluster_id, coalesce(n, 0)::bigint as n from (select unnest(range(12)) as i) left join (select cluster_id, count(*) as n from vectors group by 1) on cluster_id = i")
def cluster_sizes_with_empty(spark, sf):
    return clustering.sizes_with_empty(t.vectors(spark, sf), 12)


@query(""", d as (select a.id, a.cluster_id as c, b.cluster_id as o, sum(list_distance(a.vec, b.vec)) as s, count(*) as n from vectors a, vectors b group by all),
e as (select id, max(case when c = o then s / greatest(n - 1, 1) end) as a, max(case when c = o then n end) as own, min(case when c <> o then s / n end) as b from d group by id)
select round(avg(case when own > 1 then (b - a) / greatest(a, b) else 0 end), 6) as score, count(*) as n from e""")
def silhouette_by_label(spark, sf):
    return _r(clustering.silhouette_score(t.vectors(spark, sf)), "score")


@query("select count(*) as n, least(count(*), 300) as sampled, true as near from vectors")
def silhouette_estimated(spark, sf):
    """From 300 rows, each against all, and whether the value over all rows lies within the stated bound."""
    v = t.vectors(spark, sf)
    told = clustering.silhouette_estimate(v, 300).join(clustering.silhouette_score(v).select(F.col("score").alias("exact")))
    return told.select("n", "sampled", (F.abs(F.col("score") - F.col("exact")) <= F.col("bound")).alias("near"))


# Store


_TWICE = """, twice as (
  select id, cluster_id, ts, node, 2 * id as ord from incoming union all
  select id, cluster_id + 100, ts + (id % 2) - (id % 3 = 2)::int, node, 2 * id + 1 from incoming
)"""


def _twice(spark, sf):
    """Two updates of every vector in one batch: the second newer, equal or older than the first."""
    i = t.incoming(spark, sf)
    one = i.withColumn("ord", 2 * F.col("id"))
    shift = F.col("id") % 2 - (F.col("id") % 3 == 2).cast("int")
    two = i.withColumn("cluster_id", F.col("cluster_id") + 100).withColumn("ts", F.col("ts") + shift).withColumn("ord", 2 * F.col("id") + 1)
    return one.unionByName(two)


@query(_TWICE + " select id, arg_max(cluster_id, (ts, node, -ord)) as cluster_id, max(ts) as ts from (select id, cluster_id, ts, node, -1 as ord from vectors union all select * from twice) group by id")
def vec_batch_insert(spark, sf):
    return store.insert_batch(t.vectors(spark, sf), _twice(spark, sf), "ord")[0].select("id", "cluster_id", "ts")


@query(_TWICE + """ select count(*) filter (where (ts, node) > before) as n from (
  select id, ts, node, ord, max((ts, node)) over (partition by id order by ord rows between unbounded preceding and 1 preceding) as before
  from (select id, ts, node, -1 as ord from vectors union all select id, ts, node, ord from twice)) where ord >= 0""")
def vec_batch_accept_count(spark, sf):
    return store.insert_batch(t.vectors(spark, sf), _twice(spark, sf), "ord")[1]


@query("select try_cast(payload as bigint) as cluster_id, id from (select id, case when id % 4 = 0 then 'x' else cluster_id::varchar end as payload from vectors) where try_cast(payload as bigint) is not null")
def vec_reject_bad_cluster_ids(spark, sf):
    return store.valid_clusters(_texts(spark, sf), "payload")[0].select("id", "cluster_id")


def _texts(spark, sf):
    return t.vectors(spark, sf).select("id", F.when(F.col("id") % 4 == 0, "x").otherwise(F.col("cluster_id").cast("string")).alias("payload"))


@query("select count(*) as n from vectors where id % 4 = 0")
def vec_rejected_count(spark, sf):
    return store.valid_clusters(_texts(spark, sf), "payload")[1]


@query("select v.id, coalesce(length(d.text), -1)::bigint as n from vectors v left join documents d on d.doc_id = v.id where (d.text = (select text from documents where doc_id = 3)) is not true")
def vec_delete_by_payload(spark, sf):
    gone = t.read(spark, sf, "documents").filter("doc_id = 3").select(F.col("text").alias("payload"))
    return store.delete_payload(t.vectors(spark, sf, payload=True), gone).select("id", F.coalesce(F.length("payload"), F.lit(-1)).cast("long").alias("n"))


@query("select i as id, exists (select 1 from vectors v where v.id = i) as found from (select unnest(range(0, 4000, 7)) as i)")
def vec_exists(spark, sf):
    return store.contains(t.vectors(spark, sf), spark.range(0, 4000, 7))


@query("select id, 'p' || id as payload, case when id % 3 = 0 then -1 else cluster_id end as cluster_id, case when id % 2 = 0 then ts else 0 end as ts, case when id % 2 = 0 then node else 0 end as node, case when id % 5 = 0 then 2 else -1 end::bigint as n_to from vectors")
def vec_decode_points(spark, sf):
    i = F.col("id")
    fields = F.struct(
        F.concat(F.lit("p"), i).alias("string"), F.when(i % 3 != 0, F.col("cluster_id")).alias("cluster_id"), F.when(i % 2 == 0, F.col("ts")).alias("version_ts"),
        F.when(i % 2 == 0, F.col("node")).alias("version_node"), F.when(i % 5 == 0, F.array(i, i + 1)).alias("destinations"),
    )
    points = t.vectors(spark, sf).select("id", "vec", F.to_json(fields).alias("point"))
    return store.decode(points).select("id", "payload", "cluster_id", "ts", "node", F.expr("if(destinations is null, -1, size(destinations))").cast("long").alias("n_to"))


@query("select id, case when id % 2 = 0 then ts else 77 end as ts, case when id % 2 = 0 then node else 4 end as node, len(p.d)::bigint as n_to from vectors left join (select cluster_id, list(node_id) as d from placement group by 1) p using (cluster_id)")
def vec_widen_rows(spark, sf):
    v = t.vectors(spark, sf)
    some = v.withColumn("ts", F.when(F.col("id") % 2 == 0, F.col("ts")))
    to = t.placement(v).groupBy("cluster_id").agg(F.collect_set("node_id").alias("destinations"))
    return store.widen(some, 77.0, 4, to).select("id", "ts", "node", F.size("destinations").cast("long").alias("n_to"))


@query("select id as ord, row_number() over (order by id) * 10 + 3 as id, -1::bigint as cluster_id, 5.0::double as ts, 3::bigint as node from vectors")
def vec_client_stamp(spark, sf):
    rows = t.vectors(spark, sf).select(F.col("id").alias("ord"), "vec")
    return store.stamp(rows, "ord", 3, 8, 5.0).select("ord", "id", "cluster_id", "ts", "node")


@query("select id, case when cluster_id in (1, 3) then -1 else cluster_id end as cluster_id, cluster_id in (1, 3) as pending from vectors")
def pending_rows_requeue(spark, sf):
    now, wait = store.divert(t.vectors(spark, sf), spark.createDataFrame([(1,), (3,)], "cluster_id long"))
    return store.unassigned(wait).select("id", "cluster_id", F.lit(True).alias("pending")).unionByName(now.select("id", "cluster_id", F.lit(False).alias("pending")))


@query("select id, (row_number() over (order by id) - 1) // 512 as batch, (row_number() over (order by id) - 1) // 512 % 4 as server from vectors")
def batches_round_robin(spark, sf):
    return store.batches(t.vectors(spark, sf).select("id"), "id", 512, 4)


# Requests and collections


@query("""select id as request, case when id % 10 = 0 or id % 10 = 1 then 400 else 200 end as status, case when id % 10 > 1 then o else -1 end as ord,
case when id % 10 > 1 then 2 else -1 end::bigint as dim, case when id % 10 > 1 then 'it''s "' || id || '"' end as payload
from vectors, (select unnest(range(2)) as o) where id % 10 > 1 or o = 0""")
def requests_inserted(spark, sf):
    i = F.col("id")
    pair = F.concat(F.lit('[[1.5, '), i, F.lit('], "it\'s \\"'), i, F.lit('\\""]'))
    body = F.when(i % 10 == 0, '{"vectors": []}').when(i % 10 == 1, "no json").otherwise(F.concat(F.lit('{"vectors": ['), pair, F.lit(", "), pair, F.lit("]}")))
    got = requests.inserts(t.vectors(spark, sf).select(i.alias("request"), body.alias("body")))
    return got.select("request", "status", F.coalesce("ord", F.lit(-1)).alias("ord"), F.expr("if(vec is null, -1, size(vec))").cast("long").alias("dim"), "payload")


@query(f"""select qid, rank, id, round(score, 6) as distance, 64::bigint as dim, coalesce(length(d.text), -1)::bigint as n from (
  select qid, id, {_COS} as score, row_number() over (partition by qid order by {_COS} desc, id) as rank from queries, vectors) left join documents d on d.doc_id = id where rank <= 10""")
def vec_answers_json(spark, sf):
    v = t.vectors(spark, sf, payload=True)
    told = requests.answers(search.with_rows(search.topk(t.queries(spark, sf), v, 10), v))
    kind = "results array<struct<vector: array<float>, id: bigint, payload: string, distance: double>>"
    each = told.select("qid", F.posexplode(F.from_json("answer", kind)["results"]).alias("pos", "r"))
    return each.select("qid", (F.col("pos") + 1).cast("long").alias("rank"), "r.id", F.round("r.distance", 6).alias("distance"), F.size("r.vector").cast("long").alias("dim"), F.coalesce(F.length("r.payload"), F.lit(-1)).cast("long").alias("n"))


@query("select node_id, 'h' || node_id as host, case when node_id % 2 = 0 then 7000 + node_id else 6334 end::int as port from (select distinct user_id::bigint as node_id from events)")
def peer_addresses(spark, sf):
    n = F.col("node_id")
    url = F.when(n % 2 == 0, F.concat(F.lit("http://h"), n, F.lit(":"), 7000 + n)).otherwise(F.concat(F.lit("h"), n, F.lit(":x")))
    host, port = requests.server_of(F.col("u"))
    return _users(spark, sf).select("node_id", url.alias("u")).select("node_id", host.alias("host"), port.alias("port"))


def _collection(spark, sf):
    """All vectors in two batches, the first sent twice."""
    c = Collections(spark, kept_dir(spark, "collections"))
    assert c.create("v", 64, "Manhattan") and not c.create("v", 3) and c.about("v") == (64, "cosine")
    v = t.vectors(spark, sf, payload=True)
    c.insert("v", v.filter("id % 2 = 0"), "a")
    c.insert("v", v.filter("id % 2 = 1"), "b")
    c.insert("v", v.filter("id % 2 = 0"), "a")
    return c


@query("select cluster_id, count(*) as n, sum(id)::bigint as ids from vectors group by 1")
def collection_batches(spark, sf):
    return _collection(spark, sf).scan("v").groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("select id, ts, node from vectors where cluster_id = 3")
def collection_scan_cluster(spark, sf):
    return _collection(spark, sf).scan("v", 3).select("id", "ts", "node")


@query(f"""select qid, id, round(score, 6) as score, rank from (
  select qid, id, {_COS} as score, row_number() over (partition by qid order by {_COS} desc, id) as rank
  from (select id as qid, vec as qvec, cluster_id from vectors where id % 50 = 0) q join vectors using (cluster_id)) where rank <= 10""")
def collection_query_by_cluster(spark, sf):
    q = t.vectors(spark, sf).filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "cluster_id")
    return _r(_collection(spark, sf).query_by_cluster("v", q, 10).select("qid", "id", "score", "rank"), "score")


def _versions(spark, sf):
    """All vectors, an update of each, the update again, and a fold of both."""
    c = Collections(spark, kept_dir(spark, "collections"))
    c.create("v", 64)
    none = F.lit(None).cast("string").alias("payload")
    first, update = (r.select("*", none) for r in (t.vectors(spark, sf), t.incoming(spark, sf)))
    taken = [("first", c.insert("v", first, "first")), ("update", c.insert("v", update, "update")), ("again", c.insert("v", update, "again"))]
    return c, taken


@query("""select id, arg_max(cluster_id, (ts, node, seq)) as cluster_id, arg_max(ts, (ts, node, seq)) as ts from (select *, 1 as seq from vectors union all select *, 0 from incoming) group by id""")
def collection_versions(spark, sf):
    return _versions(spark, sf)[0].scan("v").select("id", "cluster_id", "ts")


@query("select id, ts from vectors where cluster_id = 3 and id % 3 <> 0")
def collection_cluster_left(spark, sf):
    """Rows that an update moves to another cluster are gone from theirs, also once folded."""
    c, _ = _versions(spark, sf)
    c.compact("v")
    return c.scan("v", 3).select("id", "ts")


@query("""select 'first' as batch, count(*) as n from vectors union all select 'again', 0
union all select 'update', count(*) from incoming i join vectors v using (id) where (i.ts, i.node) > (v.ts, v.node)""")
def collection_taken(spark, sf):
    return spark.createDataFrame(_versions(spark, sf)[1], "batch string, n long")


# Replication


_LIVE = """, live as (select * from replicas where node_id in (select node_id from {nodes})), newest as (
  select id, any_value(cluster_id) as cluster_id, max({{'ts': ts, 'node': node}}) as v from live group by id
), homes as (select n.id, p.node_id, n.v.ts as ts, n.v.node as node from newest n join placement p using (cluster_id) where p.node_id in (select node_id from {nodes}))
"""


def _reconciled(spark, sf, nodes):
    v, r = t.vectors(spark, sf), t.replicas(spark, sf)
    homes = t.placement(v).groupBy("cluster_id").agg(F.collect_list("node_id").alias("destinations"))
    return replication.reconcile_all(r, nodes, v.select("id", "cluster_id").join(homes, "cluster_id").select("id", "destinations"))


@query(_LIVE.format(nodes="nodes") + "select id, node_id, ts, node from homes")
def reconcile_eight_nodes(spark, sf):
    return _reconciled(spark, sf, t.nodes(spark))[0].select("id", "node_id", "ts", "node")


@query(_LIVE.format(nodes="active") + "select id, node_id, ts, node from homes union all select id, node_id, ts, node from replicas where node_id not in (select node_id from active)")
def reconcile_reachable(spark, sf):
    """Copies of nodes that cannot be reached neither count nor change."""
    return _reconciled(spark, sf, t.active(spark))[0].select("id", "node_id", "ts", "node")


@query(_LIVE.format(nodes="nodes") + """select h.node_id, count(*) as n from homes h left join replicas r on r.id = h.id and r.node_id = h.node_id
where r.id is null or (h.ts, h.node) > (r.ts, r.node) group by 1""")
def reconcile_received(spark, sf):
    return _reconciled(spark, sf, t.nodes(spark))[1]


@query("select count(*) as n_unique, 3 * count(*) as n_total, true as complete from vectors")
def replication_complete(spark, sf):
    """Once all nodes have reconciled, every id has all its copies."""
    return replication.replication_check(_reconciled(spark, sf, t.nodes(spark))[0], 3)


@query("select node_id, true as near from replicas group by 1 union all select -1, true")
def distinct_ids_sketched(spark, sf):
    """Sketches by node and batch, merged by node and over all, against the exact counts: within three percent."""
    r = t.replicas(spark, sf).withColumn("batch", F.col("id") % 7)
    kept = replication.id_sketches(r, "node_id", "batch")
    told = replication.merged_sketches(kept, "node_id").unionByName(replication.merged_sketches(kept.withColumn("node_id", F.lit(-1).cast("long")), "node_id"))
    exact = r.groupBy("node_id").agg(F.countDistinct("id").alias("n")).unionByName(r.agg(F.lit(-1).cast("long").alias("node_id"), F.countDistinct("id").alias("n")))
    return told.join(exact, "node_id").select("node_id", (F.abs(F.col("ids") - F.col("n")) <= 0.03 * F.col("n")).alias("near"))


@query("select count(distinct id) as n_unique, count(*) as n_total, count(*) = 3 * count(distinct id) as complete from replicas")
def unique_vs_total_replicas(spark, sf):
    return replication.replication_check(t.replicas(spark, sf), 3)


@query(_USERS + "select node_id from up")
def peers_allowed(spark, sf):
    users = _users(spark, sf)
    return replication.allowed(users.select("node_id"), users.filter("not up").select("node_id"))


@query(_USERS + """select 'coordinator' as what, arg_min(node_id, ord) as node_id from users where up and node_id % 3 = 1 having count(*) > 0
union all select 'peer', node_id from up where node_id = 4 union all select 'target', arg_min(node_id, ord) from users where node_id <> (select arg_min(node_id, ord) from users)""")
def coordinator_lookup(spark, sf):
    users, up = _users(spark, sf).persist(), _up(spark, sf)
    first = users.orderBy("ord").first()["node_id"]
    found = replication.find_coordinator(users.withColumn("claims", F.col("node_id") % 3 == 1), up).select(F.lit("coordinator").alias("what"), "node_id")
    peer = replication.reachable_peer(users, up, 4).select(F.lit("peer").alias("what"), "node_id")
    return found.unionByName(peer).unionByName(replication.first_other(users, first).select(F.lit("target").alias("what"), "node_id"))


@query("select cluster_id, array_to_string(list_sort(list(node_id)), ',') as destinations from placement group by 1")
def assignment_inversion(spark, sf):
    by_node = t.placement(t.vectors(spark, sf)).groupBy("node_id").agg(F.collect_set("cluster_id").alias("clusters"))
    return replication.invert(by_node).withColumn("destinations", F.array_join(F.col("destinations").cast("array<string>"), ","))


@query("select id, case when id % 4 <> 0 then id % 3 else 0 end as label from vectors")
def labels_with_default(spark, sf):
    v = t.vectors(spark, sf).select("id")
    return replication.labelled(v, v.filter("id % 4 <> 0").select("id", (F.col("id") % 3).alias("label")))


@query("""select what, count(*) as n, sum(id)::bigint as ids, sum(cluster_id)::bigint as clusters from (
  select case when p.node_id in (select node_id from active) then 'copy' else 'hint' end as what, v.id, case when v.id % 2 = 0 then n.cluster_id else v.cluster_id end as cluster_id
  from vectors v join nearest n on n.id = v.id and n.rank = 1 and n.cluster_id <> 4 join placement p on p.cluster_id = n.cluster_id
  union all select 'dropped', 0, 0 from nearest where rank = 1 and cluster_id = 4) group by 1""")
def rows_sent(spark, sf):
    v = t.vectors(spark, sf)
    to = search.destinations(v, _centroids(spark, sf), t.placement(v).filter("cluster_id <> 4"))
    rows = v.withColumn("cluster_id", F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("cluster_id")))
    copies, hints, dropped = replication.send(rows, to, t.active(spark))
    sums = [d.agg(F.count("*").alias("n"), F.sum("id").alias("ids"), F.sum("cluster_id").alias("clusters")).select(F.lit(w).alias("what"), "*") for d, w in ((copies, "copy"), (hints, "hint"))]
    lost = dropped.filter("dropped > 0").select(F.lit("dropped").alias("what"), F.col("dropped").alias("n"), F.lit(0).cast("long").alias("ids"), F.lit(0).cast("long").alias("clusters"))
    return sums[0].unionByName(sums[1]).unionByName(lost)


_KEEP = """select me, round(projected, 6) as projected, round(average, 6) as average, projected < 0.7 * average{more} as keep from (
  select m.node_id as me, {left}::double as projected, {avg} as average from loads m)"""


@query(_KEEP.format(more=" and projected + 30 >= 0.8 * 0.7 * average", left="greatest(m.n - 90, 0)", avg="(select avg(case when l.node_id = m.node_id then greatest(l.n - 90, 0) else l.n end) from loads l)"))
def keep_when_planned(spark, sf):
    return _kept(spark, sf, lambda loads, me: replication.keep_when_planned(loads, me, 90, 3))


@query(_KEEP.format(more="", left="m.n", avg="(select avg(l.n) from loads l where l.node_id <> m.node_id)"))
def keep_when_distributed(spark, sf):
    return _kept(spark, sf, replication.keep_when_distributed)


def _kept(spark, sf, rule):
    loads, out = _loads(spark, sf), None
    for me in (0, 1, 3, 4, 6, 7):
        got = rule(loads, me).select(F.lit(me).cast("long").alias("me"), F.round(F.col("projected").cast("double"), 6).alias("projected"), F.round("average", 6).alias("average"), "keep")
        out = got if out is None else out.unionByName(got)
    return out


@query("select node_id from (select 7 as node_id, 0 as turn, 0 as n union all select node_id, 1, n from loads where node_id <> 7) order by turn, n, node_id limit 3")
def replicas_chosen(spark, sf):
    return replication.chosen_replicas(spark.createDataFrame([(7,)], "node_id long"), _loads(spark, sf), 3)


@query("""select id, node_id, ts, node from replicas where node_id not in (1, 3) union all
select id, p.node_id, max((ts, node))[1] as ts, max((ts, node))[2] as node from (select r.* from replicas r where node_id in (1, 3)) r, (select unnest([1, 3]) as node_id) p
where exists (select 1 from placement q where q.cluster_id = r.cluster_id and q.node_id = p.node_id) or exists (select 1 from replicas o where o.id = r.id and o.node_id = p.node_id)
group by id, p.node_id""")
def pair_exchange(spark, sf):
    r = t.replicas(spark, sf).select("id", "cluster_id", "ts", "node", "node_id").withColumn("destinations", F.lit(None).cast("array<long>"))
    v = t.vectors(spark, sf)
    home = t.placement(v).groupBy("cluster_id").agg(F.collect_set("node_id").alias("destinations"))
    return replication.exchange(r, 1, 3, v.select("id", "cluster_id").join(home, "cluster_id")).select("id", "node_id", "ts", "node")


@query("""select version, clusters from (select user_id as node_id, count(*) filter (event_type = 'purchase') as version, count(*) || ' clusters' as clusters from events group by 1)
order by version desc, node_id limit 1""")
def topology_newest(spark, sf):
    e = t.read(spark, sf, "events").groupBy(F.col("user_id").alias("node_id"))
    return replication.newer_topology(e.agg(F.count_if(F.col("event_type") == "purchase").alias("version"), F.concat(F.count("*"), F.lit(" clusters")).alias("clusters")))


# Search, splits and states


@query(_ROUTED + f""", found as (
  select distinct qid, v.id, {_COS.replace('vec)', 'v.vec)').replace('qv.vec', 'qvec').replace('(vec,', '(v.vec,')} as score, first_value(r.node_id) over (partition by qid, v.id order by r.rank) as node_id
  from queries join routed r on r.id = qid and r.rank <= 3 join replicas v on v.node_id = r.node_id
) select qid, node_id, id, round(score, 6) as score, rank from (select *, row_number() over (partition by qid order by score desc, id) as rank from found) where rank <= 10""")
def search_routed_three_nodes(spark, sf):
    v = t.vectors(spark, sf)
    return _r(search.search_routed(t.queries(spark, sf), _centroids(spark, sf), t.placement(v), t.active(spark), t.replicas(spark, sf), 10, 3), "score")


@query("select cluster_id, len(centroid)::bigint as dim from clusters where cluster_id <> 3 union all select 100 + i, 64 from (select unnest(range(3)) as i)")
def topology_replace_cluster(spark, sf):
    v = t.vectors(spark, sf)
    c = _centroids(spark, sf)
    topology = rebalance.empty(spark).with_clusters(None, c, t.placement(v))
    new = c.filter("cluster_id = 3").select("centroid").join(spark.range(3)).select((F.col("id") + 100).alias("cluster_id"), "centroid")
    topology = topology.with_clusters(3, new, t.placement(new))
    return topology.clusters.select("cluster_id", F.size("centroid").cast("long").alias("dim"))


@query("""select id, node_id, cluster_id from replicas where cluster_id <> 1 union all
select id, unnest([(id % 3) % 8, (id % 3 + 4) % 8]) as node_id, 500 + id % 3 as cluster_id from (select distinct id from replicas where cluster_id = 1)""")
def split_given_labels(spark, sf):
    r = t.replicas(spark, sf).select("id", "vec", "cluster_id", "ts", "node", "node_id")
    labels = t.vectors(spark, sf).filter("id % 3 > 0").select("id", (F.col("id") % 3).alias("label"))  # label 0 is the default
    l = F.col("id")
    plan = spark.range(3).select(l.alias("label"), (500 + l).alias("new_id"), F.array_repeat(F.lit(0.0), 64).alias("centroid"), F.array(l % 8, (l + 4) % 8).alias("destinations"))
    topology = rebalance.empty(spark).with_clusters(None, _centroids(spark, sf), t.placement(t.vectors(spark, sf)))
    return rebalance.split(r, topology, 1, plan, labels)[0].select("id", "node_id", "cluster_id")


#: Every event as a message: who sends it, and the state of the node that it reaches.
_STATES = """from (select event_id, case event_id % 7 when 0 then 'bootstrap' when 1 then 'clustered' when 2 then 'client' when 3 then 'client' when 4 then 'handoff' when 5 then 'reconcile' else 'other' end as sender,
case when user_id % 2 = 0 then 'bootstrap' else 'clustered' end as status, event_type in ('click', 'view') as coordinates, value > 50 as knows from events)"""


def _states(spark, sf):
    e, i = t.read(spark, sf, "events"), F.col("event_id")
    names = F.array(*[F.lit(x) for x in ("bootstrap", "clustered", "client", "client", "handoff", "reconcile", "other")])
    return e.select(
        "event_id", F.get(names, (i % 7).cast("int")).alias("sender"), F.when(F.col("user_id") % 2 == 0, "bootstrap").otherwise("clustered").alias("status"),
        F.col("event_type").isin("click", "view").alias("coordinates"), (F.col("value") > 50).alias("knows"),
    )


@query(f"""select *, case sender when 'clustered' then 'save' when 'handoff' then 'save' when 'reconcile' then 'insert'
  when 'bootstrap' then if(not coordinates, 'refuse', if(status = 'bootstrap', 'buffer', 'route'))
  when 'client' then if(status = 'clustered', 'route', if(coordinates, 'buffer', if(knows, 'forward', 'drop'))) else 'refuse' end as action {_STATES}""")
def receive_actions(spark, sf):
    return _states(spark, sf).withColumn("action", engine.receive_action(F.col("sender"), F.col("status"), F.col("coordinates"), F.col("knows")))


@query(f"""select *, case sender when 'clustered' then 'search' when 'bootstrap' then if(not coordinates, 'refuse', if(status = 'bootstrap', 'scan buffer', 'search'))
  when 'client' then if(status = 'clustered', 'search', if(coordinates, 'scan buffer', if(knows, 'forward', 'nothing'))) else 'refuse' end as action {_STATES}""")
def query_actions(spark, sf):
    return _states(spark, sf).withColumn("action", engine.query_action(F.col("sender"), F.col("status"), F.col("coordinates"), F.col("knows")))


@query()
def constrained_kmeans_split(spark, sf):
    return clustering.split_clusters(t.vectors(spark, sf), 3)


@query()
def beam_placement(spark, sf):
    sizes = {r["cluster_id"]: r["n"] for r in cluster_sizes(spark, sf).collect()}
    made = clustering.place(sizes, list(range(t.N_NODES)), t.RF)
    return spark.createDataFrame([(c, n, sizes[c]) for c, ns in made.items() for n in ns], "cluster_id long, node_id long, n long")


@query()
def stream_bootstrap_cluster(spark, sf):
    return ingest.bootstrap(spark, t.vectors(spark, sf), threshold=400).select("id", "cluster_id", "state")


@query()
def rebalance_overloaded_node(spark, sf):
    v = t.vectors(spark, sf, payload=True)
    topology = rebalance.empty(spark).with_clusters(None, _centroids(spark, sf), t.placement(v))
    copies = v.join(topology.placement, "cluster_id").select("id", "vec", "payload", "cluster_id", "ts", "node", "node_id")
    return rebalance.rebalance(copies, topology, t.nodes(spark), 1, t.RF, tolerance=0.1)[0].select("id", "cluster_id", "node_id")


# Health


@query(_BEATS + "select peer_id, ms, least(count(gap) over (partition by peer_id), 500) as n, round(mean, 3) as mean, round(sqrt(var), 2) as std from wins qualify row_number() over (partition by peer_id order by ms desc) = 1")
def heartbeat_stream(spark, sf):
    got = ingest.heartbeats(spark, t.heartbeats(spark, sf))
    return got.select("peer_id", "ms", "n", F.round("mean", 3).alias("mean"), F.round(F.sqrt("var"), 2).alias("std"))


@query("select event_type, count(*) as n, count(*) filter (where event_id % 10 = 0) as errors, round(100.0 * count(*) filter (where event_id % 10 = 0) / count(*), 6)::double as percent from events group by 1")
def error_share(spark, sf):
    e = t.read(spark, sf, "events").select("event_type", (F.col("event_id") % 10 != 0).alias("ok"))
    return _r(health.error_share(e, "event_type"), "percent")


@query("""select event_type, round((case when n < 100 then most else v[b] + ((n + 1) * 0.99::double - b) * (v[b + 1] - v[b]) end) / median, 6) as tail
from (select *, least(greatest(floor((n + 1) * 0.99::double), 1), n - 1)::bigint as b from (
select event_type, count(*) as n, median(ms) as median, max(ms) as most, list(ms order by ms) as v from samples group by 1))""")
def latency_tail(spark, sf):
    return _r(health.tail_ratio(health.latency(t.latencies(spark, sf), "event_type")), "tail").select("event_type", "tail")
