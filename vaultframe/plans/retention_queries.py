"""Retention, protections, prune previews, mark and sweep, catalog rewrites."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from vaultframe.operators import packs as P
from vaultframe.operators import prune
from vaultframe.operators import retention as R
from vaultframe.plans.proxies import MASTER, SNAPSHOT_NOW
from vaultframe.plans.registry import query
from vaultframe.sources.scratch import written

NOW = "timestamp '2001-08-01'"
POLICY = R.RetentionPolicy(monthly=3, yearly=3)


def _rule(unit: str, n: int) -> str:
    bucket = f"date_trunc('{unit}', started_at)"
    return f"(row_number() over (partition by plan_id, {bucket} order by started_at desc, snapshot_id desc) = 1 and dense_rank() over (partition by plan_id order by {bucket} desc) <= {n})"


LAST3 = "(row_number() over (partition by plan_id order by started_at desc, snapshot_id desc) <= 3)"
KEPT = f"k as (select *, {_rule('month', 3)} as m, {_rule('year', 3)} as y from snapshots), kept as (select snapshot_id from k where m or y), live as (select distinct blob_id from blob_refs where snapshot_id in (select snapshot_id from kept))"
CLASSES = KEPT + ", pk as (select p.pack_id, count(b.blob_id) as total, count(l.blob_id) as live, p.size_bytes from packs p left join blobs b on b.pack_id = p.pack_id left join live l on l.blob_id = b.blob_id group by p.pack_id, p.size_bytes), pc as (select *, case when live = 0 then 'delete' when cast(live as double) / total < cast(0.7 as double) then 'repack' else 'keep' end as action from pk)"


def _kept(v):
    return R.evaluate(v.snapshots, POLICY, SNAPSHOT_NOW, ("plan_id",)).where("keep")


def _packs(v):
    return prune.classify_packs(v.packs, v.blobs, prune.live_blobs(v.blob_refs, _kept(v)))


@query("eng2_prune_preview", "select action, count(*) as packs, cast(sum(total) as bigint) as blobs, cast(sum(live) as bigint) as live_blobs, cast(sum(size_bytes) as bigint) as bytes from pc group by all", CLASSES)
def prune_preview(v):
    return _packs(v).groupBy("action").agg(F.count(F.lit(1)).alias("packs"), F.sum("total").alias("blobs"), F.sum("live").alias("live_blobs"), F.sum("size_bytes").alias("bytes"))


for _name, _unit, _n in (("hourly", "hour", 5), ("daily", "day", 3), ("weekly", "week", 3), ("monthly", "month", 3), ("yearly", "year", 2)):

    @query(f"win1_{_name}", f"select snapshot_id, plan_id from (select *, {_rule(_unit, _n)} as keep from snapshots) where keep")
    def _bucket(v, name=_name, n=_n):
        return R.evaluate(v.snapshots, R.RetentionPolicy(**{name: n}), SNAPSHOT_NOW, ("plan_id",)).where("keep").select("snapshot_id", "plan_id")


@query("win2_keep_last", f"select snapshot_id from (select *, {LAST3} as keep from snapshots) where keep")
def keep_last(v):
    return R.evaluate(v.snapshots, R.RetentionPolicy(last=3), SNAPSHOT_NOW, ("plan_id",)).where("keep").select("snapshot_id")


@query("win3_keep_within", f"select snapshot_id, started_at from snapshots where started_at >= {NOW} - interval 90 day")
def keep_within(v):
    return R.evaluate(v.snapshots, R.RetentionPolicy(within=timedelta(days=90)), SNAPSHOT_NOW, ("plan_id",)).where("keep").select("snapshot_id", "started_at")


@query("flt12_keep_tags", "select snapshot_id from snapshots where list_has_any(tags, ['1-urgent', '2-high'])")
def keep_tags(v):
    return R.evaluate(v.snapshots, R.RetentionPolicy(tags=("1-URGENT", "2-high")), SNAPSHOT_NOW).where("keep").select("snapshot_id")


@query("set2_rule_union", f"select snapshot_id, array_to_string(list_filter([case when l then 'last' end, case when m then 'monthly' end, case when y then 'yearly' end, case when t then 'tags' end], lambda x: x is not null), ',') as reasons from k where l or m or y or t",
       f"k as (select *, {LAST3} as l, {_rule('month', 3)} as m, {_rule('year', 2)} as y, list_has_any(tags, ['1-urgent']) as t from snapshots)")
def rule_union(v):
    policy = R.RetentionPolicy(last=3, monthly=3, yearly=2, tags=("1-urgent",))
    return R.evaluate(v.snapshots, policy, SNAPSHOT_NOW, ("plan_id",)).where("keep").select("snapshot_id", F.array_join("keep_reasons", ",").alias("reasons"))


@query("set2_empty_policy", "select count(*) as kept from snapshots")
def empty_policy(v):
    return R.evaluate(v.snapshots, R.RetentionPolicy(), SNAPSHOT_NOW).where("keep").agg(F.count(F.lit(1)).alias("kept"))


@query("set3_deleted_snapshots", "select snapshot_id from snapshots where snapshot_id not in (select snapshot_id from kept)", KEPT)
def deleted_snapshots(v):
    return v.snapshots.join(_kept(v), "snapshot_id", "left_anti").select("snapshot_id")


@query("set4_scoped_protected", f"select snapshot_id, array_to_string(list_filter([case when plan_id <> 7 then 'other-plan' end, case when plan_id = 7 and l then 'last' end, case when started_at >= {NOW} - interval 30 day then 'immutable' end], lambda x: x is not null), ',') as reasons from k",
       f"k as (select *, {LAST3} as l from snapshots)")
def scoped_protected(v):
    judged = R.scoped(v.snapshots, R.RetentionPolicy(last=3), SNAPSHOT_NOW, 7)
    return R.protect(judged, R.Protection(window=timedelta(days=30)), SNAPSHOT_NOW).select("snapshot_id", F.array_join("keep_reasons", ",").alias("reasons"))


@query("eng4_append_only", "select count(*) as kept, cast(0 as bigint) as others from snapshots")
def append_only(v):
    done = R.protect(R.evaluate(v.snapshots, R.RetentionPolicy(last=0), SNAPSHOT_NOW), R.Protection(append_only=True, window=timedelta(days=30)), SNAPSHOT_NOW)
    return done.agg(F.count_if("keep").alias("kept"), F.count_if(~F.array_contains("keep_reasons", "append-only")).alias("others"))


@query("jn11_manual_delete", f"select r.snapshot_id, case when s.snapshot_id is null or s.started_at >= {NOW} - interval 365 day then 'refused' else 'deleted' end as outcome, case when s.snapshot_id is null then 'not-found' when s.started_at >= {NOW} - interval 365 day then 'immutable' end as reason from r left join snapshots s on s.snapshot_id = r.snapshot_id",
       "r as (select distinct case when o_orderkey % 3 = 0 then -o_orderkey - 1 else o_orderkey end as snapshot_id from orders where o_orderkey % 7 = 0)")
def manual_delete(v):
    k = F.col("o_orderkey")
    asked = v.table("orders").where(k % 7 == 0).select(F.when(k % 3 == 0, -k - 1).otherwise(k).alias("snapshot_id"))
    return R.manual_delete(asked, v.snapshots, R.Protection(window=timedelta(days=365)), SNAPSHOT_NOW)


@query("eng3_manual_prune", "select action, count(*) as packs from pc group by all",
       "kept as (select snapshot_id from snapshots where snapshot_id % 2 = 1), live as (select distinct blob_id from blob_refs where snapshot_id in (select snapshot_id from kept))" + CLASSES[len(KEPT):])
def manual_prune(v):
    asked = v.snapshots.where("snapshot_id % 2 = 0").select("snapshot_id")
    gone = R.manual_delete(asked, v.snapshots, R.Protection(), SNAPSHOT_NOW).where("outcome = 'deleted'")
    live = prune.live_blobs(v.blob_refs, prune.deleted(v.snapshots, gone, "snapshot_id"))
    return prune.classify_packs(v.packs, v.blobs, live).groupBy("action").agg(F.count(F.lit(1)).alias("packs"))


@query("jn6_live_blobs", "select blob_id from live", KEPT)
def live(v):
    return prune.live_blobs(v.blob_refs, _kept(v))


@query("jn7_kept_refs", "select snapshot_id, count(*) as refs from blob_refs where snapshot_id in (select snapshot_id from kept) group by all", KEPT)
def kept_refs(v):
    return v.blob_refs.join(_kept(v), "snapshot_id", "left_semi").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("refs"))


@query("agg5_pack_liveness", "select * from pc", CLASSES)
def pack_liveness(v):
    return _packs(v)


@query("agg14_freed_bytes", "select count(*) filter (where action = 'delete') as packs_deleted, count(*) filter (where action = 'repack') as packs_repacked, count(*) filter (where action = 'keep') as packs_kept, cast(coalesce(sum(size_bytes) filter (where action <> 'keep'), 0) as bigint) as bytes_freed from pc", CLASSES)
def freed(v):
    return prune.freed(_packs(v))


@query("agg14_dry_run", "select count(*) filter (where action = 'delete') as packs_deleted, count(*) filter (where action = 'repack') as packs_repacked, count(*) filter (where action = 'keep') as packs_kept, cast(0 as bigint) as bytes_freed from pc", CLASSES)
def dry_run(v):
    return prune.freed(_packs(v), dry_run=True)


@query("snk5_cascade_delete", "select blob_id, pack_id from blobs where pack_id not in (select pack_id from pc where action = 'delete')", CLASSES)
def cascade(v):
    return prune.swept(v.blobs, _packs(v)).select("blob_id", "pack_id")


@query("snk5_packs_left", "select pack_id, size_bytes from pc where action <> 'delete'", CLASSES)
def packs_left(v):
    return prune.swept(v.packs, _packs(v))


@query("snk5_paths_left", "select l_orderkey as snapshot_id, count(*) as paths from lineitem where l_orderkey in (select snapshot_id from kept) group by all", KEPT)
def paths_left(v):
    snapshot_paths = v.table("lineitem").select(F.col("l_orderkey").alias("snapshot_id"), "l_partkey")
    gone = v.snapshots.join(_kept(v), "snapshot_id", "left_anti")
    return prune.deleted(snapshot_paths, gone, "snapshot_id").groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("paths"))


REPACK = CLASSES + ", rp as (select b.blob_id, b.pack_id, b.len_stored, row_number() over (order by b.pack_id, b.blob_id) as i from blobs b join pc on pc.pack_id = b.pack_id join live l on l.blob_id = b.blob_id where pc.action = 'repack')"


@query("eng5_repack", "select pack_id, count(*) as carried, cast(sum(len_stored) as bigint) as bytes from rp group by all", REPACK)
def repack(v):
    alive = written(prune.live_blobs(v.blob_refs, _kept(v)), "live")  # it marks packs and picks what moves
    moved = prune.carried(v.blobs, prune.classify_packs(v.packs, v.blobs, alive), alive)
    return moved.groupBy("pack_id").agg(F.count(F.lit(1)).alias("carried"), F.sum("len_stored").alias("bytes"))


@query("snk3_upsert", "select blob_id, case when r.blob_id is null then b.pack_id else -b.pack_id - 1 end as pack_id, b.len_stored from blobs b left join rp r using (blob_id)", REPACK)
def upsert(v):
    alive = written(prune.live_blobs(v.blob_refs, _kept(v)), "live")  # it marks packs and picks what moves
    moved = prune.carried(v.blobs, prune.classify_packs(v.packs, v.blobs, alive), alive)
    return prune.upserted(v.blobs, moved.withColumn("pack_id", -F.col("pack_id") - 1), "blob_id")


ROTATE = """recursive_rows as (select c_nationkey as writer, c_custkey as seq, 1000 + c_custkey * 37 % 4000 as size, row_number() over (partition by c_nationkey order by c_custkey) as i from customer),
 f as (select writer, seq, i, cast(0 as bigint) as pack_no, cast(size as bigint) as used from recursive_rows where i = 1
   union all select r.writer, r.seq, r.i, case when f.used >= 20000 then f.pack_no + 1 else f.pack_no end, case when f.used >= 20000 then r.size else f.used + r.size end from f join recursive_rows r on r.writer = f.writer and r.i = f.i + 1)"""


@query("agg9_pack_rotation", "select writer, seq, pack_no from f", ROTATE, recursive=True)
def rotation(v):
    k = F.col("c_custkey")
    rows = v.table("customer").select(F.col("c_nationkey").alias("writer"), k.alias("seq"), (F.lit(1000) + k * 37 % 4000).alias("size"))
    return P.rotation(rows, "writer", "seq", "size", 20000)


@query("snk1_pack_summary", "select writer, pack_no, count(*) as blobs, min(seq) as first_seq, max(seq) as last_seq from f group by all", ROTATE, recursive=True)
def pack_summary(v):
    return rotation(v).groupBy("writer", "pack_no").agg(F.count(F.lit(1)).alias("blobs"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


@query("win6_pack_offsets", "select blob_id, pack_id, row_number() over w - 1 as ordinal, cast(16 + coalesce(sum(len_stored) over (partition by pack_id order by blob_id rows between unbounded preceding and 1 preceding), 0) as bigint) as \"offset\" from blobs window w as (partition by pack_id order by blob_id)")
def pack_offsets(v):
    return P.with_offsets(v.blobs).select("blob_id", "pack_id", F.col("ordinal").cast("bigint").alias("ordinal"), "offset")


@query("jn1_new_blobs", "select blob_id, min(seq) as seq from blob_refs where blob_id not in (select blob_id from blobs where blob_id % 3 <> 0) group by all")
def new_blobs(v):
    return prune.new_blobs(v.blob_refs, v.blobs.where("blob_id % 3 <> 0"))


@query("win8_parent_chain", "select snapshot_id, lag(snapshot_id) over (partition by plan_id order by started_at, snapshot_id) as parent_snapshot_id from snapshots")
def parent_chain(v):
    return R.with_previous(v.snapshots).select("snapshot_id", "parent_snapshot_id")


@query("jn12_plan_latest", "select p.plan_id, p.name, max(s.started_at) as last_run from plans p left join snapshots s using (plan_id) group by all")
def plan_latest(v):
    last = v.snapshots.groupBy("plan_id").agg(F.max("started_at").alias("last_run"))
    return v.plans.select("plan_id", "name").join(last, "plan_id", "left")


@query("set6_mark_dag", "select distinct 'n' || n_nationkey as id from nation where n_regionkey in (0, 2) union select 'r0' union select 'r2' union select 'c' || c_custkey from customer join nation on n_nationkey = c_nationkey where n_regionkey in (0, 2)")
def mark_dag(v):
    edges = v.tree_edges.select("parent", F.col("sub").alias("child"))
    roots = v.spark.range(0, 3, 2).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"))
    return prune.reachable(edges, roots, lambda df: written(df, "mark"))


def _payloads(v):
    t = v.table("part")
    body = F.concat_ws(" ", "p_name", "p_brand", "p_type").cast("binary")
    return t.select((F.col("p_partkey") % 40).cast("string").alias("pack_id"), (F.col("p_partkey") % 2).cast("byte").alias("kind"), F.sha2(F.concat(body, F.col("p_partkey").cast("string").cast("binary")), 256).alias("blob_id"), body.alias("payload"), F.length(body).alias("len_plain"), F.lit(0).cast("byte").alias("codec"))


@query("src7_pack_headers", "select cast(p_partkey % 40 as varchar) as pack_id, sha256(concat_ws(' ', p_name, p_brand, p_type) || p_partkey) as blob_id, cast(p_partkey % 2 as tinyint) as kind, cast(octet_length(encode(concat_ws(' ', p_name, p_brand, p_type))) as int) as len_plain from part")
def pack_headers(v):
    return P.headers(P.encoded(_payloads(v), MASTER), MASTER).where("not damaged").select("pack_id", "blob_id", "kind", "len_plain")


@query("eng8_rebuild_index", "select cast(p_partkey % 40 as varchar) as pack_id, count(*) as blobs, cast(sum(octet_length(encode(concat_ws(' ', p_name, p_brand, p_type)))) as bigint) as plain_bytes from part group by all")
def rebuild(v):
    index, _ = P.rebuilt_index(P.headers(P.encoded(_payloads(v), MASTER), MASTER))
    return index.groupBy("pack_id").agg(F.count(F.lit(1)).alias("blobs"), F.sum("len_plain").cast("bigint").alias("plain_bytes"))


@query("scl4_seal_round_trip", "select cast(p_partkey % 40 as varchar) as pack_id, count(*) as blobs, count(*) as equal from part group by all")
def seal_round_trip(v):
    made = P.encoded(_payloads(v), MASTER)
    got = P.opened(made, P.headers(made, MASTER), MASTER)
    both = got.join(_payloads(v).select("blob_id", F.col("payload").alias("expected")), "blob_id")
    return both.groupBy("pack_id").agg(F.count(F.lit(1)).alias("blobs"), F.count_if(F.col("payload") == F.col("expected")).alias("equal"))


@query("udf4_pack_layout", "select cast(p_partkey % 40 as varchar) as pack_id, count(*) as blobs, cast(16 + sum(octet_length(encode(concat_ws(' ', p_name, p_brand, p_type))) + 16) + 4 + 50 * count(*) + 16 + 4 as bigint) as bytes from part group by all")
def pack_layout(v):
    sizes = P.encoded(_payloads(v), MASTER).select("pack_id", F.length("content").cast("bigint").alias("bytes"))
    n = _payloads(v).groupBy("pack_id").agg(F.count(F.lit(1)).alias("blobs"))
    return n.join(sizes, "pack_id")


@query("snk2_rotated_packs", "select writer, pack_no, count(*) as blobs, cast(max(used) as bigint) as bytes from f group by all", ROTATE, recursive=True)
def rotated(v):
    k = F.col("c_custkey")
    sizes = v.table("customer").select(F.col("c_nationkey").alias("w"), k.alias("s"), (F.lit(1000) + k * 37 % 4000).alias("size"))
    r = rotation(v)
    joined = r.join(sizes, (r["writer"] == sizes["w"]) & (r["seq"] == sizes["s"]))
    return joined.groupBy("writer", "pack_no").agg(F.count(F.lit(1)).alias("blobs"), F.sum("size").alias("bytes"))


@query("agg8_newest_in_buckets", f"select plan_id, count(*) filter (where m) as months, count(*) filter (where y) as years from (select *, {_rule('month', 2)} as m, {_rule('year', 2)} as y from snapshots) group by all")
def newest_in_buckets(v):
    flag = lambda unit: R.newest_per_bucket(F.date_trunc(unit, "started_at"), 2, ("plan_id",))
    marked = v.snapshots.select("plan_id", flag("month").alias("m"), flag("year").alias("y"))
    return marked.groupBy("plan_id").agg(F.count_if("m").alias("months"), F.count_if("y").alias("years"))
