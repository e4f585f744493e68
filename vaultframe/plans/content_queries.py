"""Files: change detection, diff, anomaly, trees, verify, restore, content ids, chunking."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultframe.functions import crypto, paths
from vaultframe.operators import chunking, diff, repository, restore, skips, tree
from vaultframe.operators import packs as P
from vaultframe.plans.proxies import MASTER
from vaultframe.plans.registry import query
from vaultframe.sources import files as sources
from vaultframe.sources.scratch import written

STATUS = "st as (select b.*, case when a.path is null then 'new' when a.size = b.size and a.mtime = b.mtime and a.attributes = b.attributes then 'unchanged' else 'changed' end as status from files_b b left join files_a a using (path))"


@query("jn2_change_detection", "select path, status from st", STATUS)
def changes(v):
    return diff.changes(v.files_b, v.files_a).select("path", "status")


@query("flt9_unchanged", "select path, size from st where status = 'unchanged'", STATUS)
def unchanged(v):
    return diff.changes(v.files_b, v.files_a).where("status = 'unchanged'").select("path", "size")


@query("jn3_deletions", "select path from files_a where path not in (select path from files_b)")
def deletions(v):
    return diff.deletions(v.files_b, v.files_a).select("path")


MARKS = "dm as (select coalesce(a.path, b.path) as path, case when a.path is null then '+' when b.path is null then '-' when a.size <> b.size or a.mtime <> b.mtime then '~' end as mark from files_a a full join files_b b on a.path = b.path)"


@query("jn4_diff", "select path, mark from dm where mark is not null", MARKS)
def full_diff(v):
    return diff.diff(v.files_a, v.files_b)


@query("eng9_diff_sorted", "select path, mark from dm where mark is not null order by path", MARKS)
def sorted_diff(v):
    return diff.diff(v.files_a, v.files_b).orderBy("path")


@query("flt10_differs", "select mark, count(*) as n from dm where mark = '~' group by all", MARKS)
def differs(v):
    return diff.diff(v.files_a, v.files_b).where("mark = '~'").groupBy("mark").agg(F.count(F.lit(1)).alias("n"))


@query("set1_path_union", "select path from files_a union select path from files_b")
def path_union(v):
    return v.files_a.select("path").union(v.files_b.select("path")).distinct()


@query("agg11_counters", "select count(*) filter (where status = 'new') as new_files, count(*) filter (where status = 'changed') as changed_files, count(*) filter (where status = 'unchanged') as unchanged_files, cast(coalesce(sum(size) filter (where status <> 'unchanged'), 0) as bigint) as bytes_to_read from st", STATUS)
def counters(v):
    return diff.counters(diff.changes(v.files_b, v.files_a))


@query("agg12_parent_files", "select count(*) filter (where kind = 'file') as files, count(*) filter (where kind = 'dir') as folders from tree_edges")
def parent_files(v):
    return v.tree_edges.agg(F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "dir").alias("folders"))


ANOMALY = STATUS + """, cn as (select (select count(*) from files_a) as parent_files, (select count(*) from st where status <> 'unchanged') as changed, (select count(*) from files_a where path not in (select path from files_b)) as deleted,
 (select count(*) from st where status <> 'unchanged' and name like '%.locked') as suspicious, (select array_to_string(list_sort(list(name)), ', ') from (select name from st where status <> 'unchanged' and name like '%.locked' order by name limit 5)) as samples),
 ar as (select *, cast(changed + deleted as double) / parent_files as ratio from cn)"""


@query("agg13_anomaly", "select parent_files, changed, deleted, suspicious, (parent_files >= 20 and ratio > 0.2) or suspicious > 0 as detected, array_to_string(list_filter([case when parent_files >= 20 and ratio > 0.2 then 'ratio ' || cast(round(ratio * 100) as int) || '%' end, case when suspicious > 0 then 'suspicious ' || suspicious || ': ' || samples || case when suspicious > 5 then ', ...' else '' end end], lambda x: x is not null), ' | ') as reasons from ar", ANOMALY)
def anomaly(v):
    done = diff.anomaly(diff.changes(v.files_b, v.files_a), diff.deletions(v.files_b, v.files_a), v.files_a, diff.AnomalyPolicy(threshold=0.2))
    return done.withColumn("reasons", F.array_join("reasons", " | "))


@query("scl10_suspicious_endings", "select name from files_a where regexp_matches(lower(name), '\\.(locked|encrypted|crypt|crypted|locky|cerber|zepto|enc|vault|ransom|wcry|wncry|ryk|conti)$')")
def endings(v):
    return v.files_a.where(paths.ends_with_any(F.col("name"), diff.SUSPICIOUS)).select("name")


@query("srt7_samples", "select list_sort(list(name))[1:5][1] as first, len(list_sort(list(name))[1:5]) as n from files_a where name like '%.locked'")
def samples(v):
    return v.files_a.where(F.col("name").endswith(".locked")).orderBy("name").limit(5).agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n"))


@query("flt8_selection_scope", "select path from files_a where path = 'src1/en' or starts_with(path, 'src1/en/') or starts_with('src1/en', path || '/') or path = 'src2' or starts_with(path, 'src2/') or starts_with('src2', path || '/')")
def scope(v):
    return v.files_a.where(paths.in_scope(F.col("path"), ["src1/en", "src2"])).select("path")


ODD = "od as (select doc_id, case doc_id % 6 when 0 then 'Veri/' || doc_id when 1 then '../' || doc_id when 2 then 'C:\\x\\' || doc_id when 3 then 'a/../../' || doc_id when 4 then 'a/./b/../' || doc_id else '/' || doc_id end as path from documents)"


def _odd(v):
    d = F.col("doc_id")
    s = d.cast("string")
    forms = ["Veri/", "../", "C:\\x\\", "a/../../", "a/./b/../", "/"]
    out = F.concat(F.lit(forms[5]), s)
    for i, p in enumerate(forms[:5]):
        out = F.when(d % 6 == i, F.concat(F.lit(p), s)).otherwise(out)
    return v.table("documents").select("doc_id", out.alias("path"))


@query("flt13_containment", "select doc_id, path from od where doc_id % 6 in (0, 4)", ODD)
def containment(v):
    return _odd(v).where(paths.is_contained(F.col("path")))


@query("scl8_root_segment", "select doc_id, coalesce(nullif(regexp_replace(regexp_replace(path, '[\\\\/]+$', ''), '[:\\\\/]', '', 'g'), ''), 'root') as segment from od", ODD)
def segment(v):
    return _odd(v).select("doc_id", paths.root_segment(F.col("path")).alias("segment"))


@query("scl9_pack_path", "select pack_id, 'data/' || substr(cast(pack_id as varchar), 1, 2) || '/' || pack_id || '.pack' as file from packs")
def pack_file(v):
    return v.packs.select("pack_id", paths.pack_path(F.col("pack_id").cast("string")).alias("file"))


@query("src11_ancestors", "select path, split_part(path, '/', 1) || ' > ' || split_part(path, '/', 1) || '/' || split_part(path, '/', 2) || ' > ' || path as crumbs from files_a")
def crumbs(v):
    return v.files_a.select("path", F.array_join(paths.ancestors(F.col("path")), " > ").alias("crumbs"))


@query("srt9_folders", "select distinct source as name from documents order by lower(source)")
def folders(v):
    return v.table("documents").select(F.col("source").alias("name")).distinct().orderBy(F.lower("name"))


@query("flt6_fixed_exclusions", "select name from ex where lower(name) not in ('pagefile.sys', 'hiberfil.sys', 'swapfile.sys', 'system volume information', '$recycle.bin')",
       "ex as (select case doc_id % 5 when 0 then 'PAGEFILE.sys' when 1 then '$Recycle.Bin' else doc_id || '.txt' end as name from documents)")
def exclusions(v):
    d = F.col("doc_id")
    names = v.table("documents").select(F.when(d % 5 == 0, "PAGEFILE.sys").when(d % 5 == 1, "$Recycle.Bin").otherwise(F.concat(d.cast("string"), F.lit(".txt"))).alias("name"))
    return names.where(~paths.excluded(F.col("name"), F.col("name")))


@query("flt7_globs", "select path from files_a where regexp_matches(path, '^src1[^/]*/(en|de)/[^/]*$') and not regexp_matches(path, '^([^/]+/)*[^/]*7$')")
def globs(v):
    return v.files_a.where(~paths.excluded(F.col("path"), F.col("name"), ["src1*/en/*", "SRC1*/de/*"], ["**/*7"])).select("path")


@query("flt11_placeholders", "select path, attr from fa where attr & 4456448 = 0", "fa as (select path, case when mtime % 4 = 0 then 4194304 when mtime % 4 = 1 then 262144 + 32 when mtime % 4 = 2 then 6 else 32 end as attr from files_a)")
def placeholders(v):
    m = F.col("mtime") % 4
    rows = v.files_a.select("path", F.when(m == 0, 4194304).when(m == 1, 262144 + 32).when(m == 2, 6).otherwise(32).alias("attr"))
    return rows.where(~paths.is_placeholder(F.col("attr")))


@query("flt11_skipped", """select (select count(*) from fe where why is null) as entries_read, count(*) as entries_skipped, (select string_agg(sample, ';' order by path) from (select path, path || ' (' || why || ')' as sample from fe where why is not null order by path limit 20)) as samples from fe where why is not null""",
       "fe as (select path, case when mtime % 23 = 0 then 'IOException' when mtime % 17 = 0 then 'UnauthorizedAccessException' when mtime % 19 = 0 then 'IOException' end as why from files_a)")
def skipped(v):
    m = F.col("mtime")
    rows = v.files_a.withColumn("attributes", F.when(m % 23 == 0, 4194304).otherwise(32)).withColumn("error", F.when(m % 17 == 0, "UnauthorizedAccessException").when(m % 19 == 0, "IOException"))
    read, left_out = skips.split(rows)
    one = skips.summary(left_out).select("entries_skipped", F.array_join("samples", ";").alias("samples"), F.lit(None).cast("long").alias("entries_read"))
    both = one.unionByName(read.groupBy().agg(F.count(F.lit(1)).alias("entries_read")), allowMissingColumns=True)
    return both.groupBy().agg(F.max("entries_read").alias("entries_read"), F.max("entries_skipped").alias("entries_skipped"), F.max("samples").alias("samples"))


@query("flt15_browsable", "select path, attr from fa where attr & 6 <> 6", "fa as (select path, case when mtime % 4 = 2 then 6 when mtime % 4 = 3 then 2 else 32 end as attr from files_a)")
def browsable(v):
    m = F.col("mtime") % 4
    rows = v.files_a.select("path", F.when(m == 2, 6).when(m == 3, 2).otherwise(32).alias("attr"))
    return rows.where(paths.is_browsable(F.col("attr")))


DEVICES = {"C:\\": "\\\\?\\GLOBALROOT\\Device\\Shadow1", "D:\\": "\\\\?\\GLOBALROOT\\Device\\Shadow2\\"}


@query("scl7_volume_map", "select path, case when path like 'C:%' then '\\\\?\\GLOBALROOT\\Device\\Shadow1\\' || substr(path, 4) when path like 'd:%' then '\\\\?\\GLOBALROOT\\Device\\Shadow2\\' || substr(path, 4) else path end as device_path, case when path like 'd:%' then 'D' || substr(path, 2) else path end as back from vp",
       "vp as (select case doc_id % 3 when 0 then 'C:\\a\\' || doc_id when 1 then 'd:\\b\\' || doc_id else 'E:\\c\\' || doc_id end as path from documents)")
def volume_map(v):
    d = F.col("doc_id")
    s = d.cast("string")
    rows = v.table("documents").select(F.when(d % 3 == 0, F.concat(F.lit("C:\\a\\"), s)).when(d % 3 == 1, F.concat(F.lit("d:\\b\\"), s)).otherwise(F.concat(F.lit("E:\\c\\"), s)).alias("path"))
    mapped = rows.withColumn("device_path", paths.map_path(F.col("path"), DEVICES))
    return mapped.withColumn("back", paths.unmap_path(F.col("device_path"), DEVICES))


@query("jn17_unmap_prefix", "select count(*) as n, count(*) filter (where path like 'C:%' or path like 'd:%') as mapped from vp", "vp as (select case doc_id % 3 when 0 then 'C:\\a\\' || doc_id when 1 then 'd:\\b\\' || doc_id else 'E:\\c\\' || doc_id end as path from documents)")
def unmap(v):
    return volume_map(v).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("path") != F.col("device_path")).alias("mapped"))


# --- trees

WALK = "wk as (select name as path, name, kind, sub, 1 as depth from tree_edges where parent = 'root' union all select w.path || '/' || e.name, e.name, e.kind, e.sub, w.depth + 1 from wk w join tree_edges e on e.parent = w.sub)"


def _walk(v, **how):
    roots = v.spark.range(1).select(F.lit("root").alias("id"), F.lit("").alias("prefix"))
    return tree.walk(v.tree_edges, roots, lambda df: written(df, "level"), **how)


@query("jn5_tree_walk", "select path, kind, cast(depth as int) as depth from wk", WALK, recursive=True)
def tree_walk(v):
    return _walk(v).select("path", "kind", "depth")


@query("jn5_tree_levels", "select cast(depth as int) as depth, kind, count(*) as n from wk group by all", WALK, recursive=True)
def tree_levels(v):
    return _walk(v).groupBy("depth", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("src4_recursive_scan", "select path, kind from wk where not regexp_matches(path, '^AS')", WALK, recursive=True)
def recursive_scan(v):
    return _walk(v, visit="not (name like 'AS%' and kind = 'dir')").select("path", "kind")


@query("eng10_ls", "select case when kind = 'dir' then 'd' else '-' end as mark, name, path from wk where depth = 2 and starts_with(path, 'ASIA/')", WALK, recursive=True)
def ls(v):
    return tree.listing(_walk(v, descend="depth < 2"), "ASIA")


@query("srt4_ordinal_names", "select name, kind from tree_edges where parent = 'n3' order by name")
def ordinal(v):
    return v.tree_edges.where("parent = 'n3'").select("name", "kind").orderBy("name")


@query("srt5_folders_first", "select name, kind from tree_edges where parent in ('n3', 'c3') order by kind = 'file', lower(name)")
def folders_first(v):
    return v.tree_edges.where("parent in ('n3', 'c3')").select("name", "kind").orderBy(F.col("kind") == "file", F.lower("name"))


@query("prj6_ls_row", "select case when kind = 'dir' then 'd' else '-' end || ' ' || lpad(cast(length(name) as varchar), 12, ' ') || ' ' || name as line from tree_edges where parent = 'n3'")
def ls_row(v):
    return v.tree_edges.where("parent = 'n3'").select(F.concat_ws(" ", F.when(F.col("kind") == "dir", "d").otherwise("-"), F.lpad(F.length("name").cast("string"), 12, " "), "name").alias("line"))


KEY = bytes(range(32, 64))
_inner, _outer = crypto.pads(KEY)


def _hmac(text: str, inner: str = _inner, outer: str = _outer) -> str:
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def _level(table: str, tag: str, column: str, below: str) -> str:
    """Ids of all directories of one level; those without entries are there too."""
    value = "e.name" if below == "" else f"{below}.tree_id"
    joined = f" left join {below} on {below}.id = e.sub" if below else ""
    lines = "coalesce(string_agg(e.name || '|' || e.kind || '|' || " + value + ", chr(10) order by e.name), '')"
    return f"select '{tag}' || {column} as id, {_hmac(lines)} as tree_id from {table} left join tree_edges e on e.parent = '{tag}' || {column}{joined} group by all"


MERKLE = f"""l0 as ({_level("customer", "c", "c_custkey", "")}), l1 as ({_level("nation", "n", "n_nationkey", "l0")}), l2 as ({_level("region", "r", "r_regionkey", "l1")}),
 l3 as ({_level("(select '' as k)", "root", "k", "l2")})"""


def _merkle(v):
    return tree.merkle(v.tree_edges, KEY, F.col("name"), lambda df: written(df, "merkle")).select(F.col("parent").alias("id"), "tree_id")


@query("agg17_merkle", "select * from l0 union all select * from l1 union all select * from l2 union all select * from l3", MERKLE)
def merkle(v):
    return _merkle(v)


@query("eng14_tree_draft", "select id as root, tree_id from l3", MERKLE)
def tree_draft(v):
    return _merkle(v).where("id = 'root'").select(F.col("id").alias("root"), "tree_id")


@query("prj7_tree_nodes", "select parent, count(*) as nodes, min(name) as first, max(name) as last from tree_edges group by all")
def tree_nodes(v):
    nodes = v.tree_edges.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct(F.col("name").alias("n"), F.col("kind").alias("t"), F.lit(0).cast("bigint").alias("sz"), "sub"))).alias("nodes"))
    return nodes.select("parent", F.size("nodes").cast("bigint").alias("nodes"), F.get("nodes", F.lit(0))["n"].alias("first"), F.element_at("nodes", -1)["n"].alias("last"))


@query("scl20_tree_json", "select parent, count(*) as n, count(sub) as subs from tree_edges group by all")
def tree_json(v):
    nodes = F.array_sort(F.collect_list(F.struct(F.col("name").alias("n"), F.col("kind").alias("t"), "sub")))
    text = v.tree_edges.groupBy("parent").agg(F.to_json(F.struct(nodes.alias("nodes")), {"ignoreNullFields": "false"}).alias("json"))
    back = text.select("parent", F.from_json("json", "nodes array<struct<n:string,t:string,sub:string>>")["nodes"].alias("nodes"))
    return back.select("parent", F.size("nodes").cast("bigint").alias("n"), F.size(F.filter("nodes", lambda x: x["sub"].isNotNull())).cast("bigint").alias("subs"))


# --- content

ID = crypto.pads(crypto.sub_key(MASTER, "chunk-id-v1"))


@query("scl1_blob_ids", f"select doc_id, {_hmac('text', *ID)} as blob_id from documents")
def blob_ids(v):
    return v.table("documents").select("doc_id", crypto.blob_id(F.col("text"), MASTER).alias("blob_id"))


@query("scl2_sha256", "select doc_id, sha256(text) as sha256 from documents")
def sha(v):
    return v.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))


@query("scl23_hex_base64", "select doc_id, lower(hex(encode(text))) as hex, base64(encode(text)) as b64 from documents")
def codecs(v):
    raw = F.col("text").cast("binary")
    return v.table("documents").select("doc_id", F.lower(F.hex(raw)).alias("hex"), F.regexp_replace(F.base64(raw), "\\s", "").alias("b64"))


@query("scl5_nonce", "select l_linenumber as n, lower(lpad(hex(l_linenumber), 24, '0')) as nonce from (select distinct l_linenumber from lineitem)")
def nonces(v):
    return v.table("lineitem").select(F.col("l_linenumber").alias("n")).distinct().select("n", F.lower(F.hex(crypto.nonce(F.col("n")))).alias("nonce"))


@query("eng1_dedup_contents", "select count(*) as documents, count(distinct text) as blobs, cast((select sum(octet_length(encode(text))) from (select distinct text from documents)) as bigint) as stored_bytes from documents")
def dedup(v):
    ids = v.table("documents").select(crypto.blob_id(F.col("text"), MASTER).alias("blob_id"), F.octet_length("text").alias("n"))
    per = ids.groupBy("blob_id").agg(F.count(F.lit(1)).alias("copies"), F.max("n").alias("n"))
    return per.agg(F.sum("copies").alias("documents"), F.count(F.lit(1)).alias("blobs"), F.sum("n").alias("stored_bytes"))


SMALL = chunking.Sizes(64, 256, 1024, 10, 6)


@query("udf1_chunks")
def chunks(v):
    return chunking.chunked(v.contents, MASTER, SMALL)


@query("udf1_chunks_whole", "select doc_id as path, octet_length(encode(text)) as bytes, sha256(text) as sha256 from documents where text <> ''")
def chunks_whole(v):
    parts = chunking.chunked(v.contents, MASTER, SMALL, with_content=True)
    put = restore.contents(parts.select(F.col("path").alias("file"), "seq", F.col("chunk_id").alias("blob_id")), parts.select(F.col("chunk_id").alias("blob_id"), F.col("content").alias("payload")).dropDuplicates(["blob_id"]))
    return put.select(F.col("file").alias("path"), F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("udf3_zstd_rule")
def zstd(v):
    done = P.compressed(v.contents, "content")
    return done.groupBy("codec").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("plain"), F.sum(F.length("stored")).alias("stored"))


@query("scl6_keeps_compression", "select l_orderkey, l_linenumber, l_quantity < cast(0.97 as double) * l_extendedprice and l_extendedprice > 0 as keeps from lineitem")
def keeps(v):
    return v.table("lineitem").select("l_orderkey", "l_linenumber", P.keeps_compression(F.col("l_quantity"), F.col("l_extendedprice")).alias("keeps"))


# --- verify and restore

PLACED = "pl as (select blob_id, pack_id, len_stored, row_number() over (partition by pack_id order by blob_id) - 1 as ordinal from blobs), rpn as (select r.snapshot_id, r.seq, r.blob_id, p.pack_id, p.ordinal, p.len_stored, cast(coalesce(sum(p.len_stored) over (partition by r.snapshot_id order by r.seq, r.blob_id rows between unbounded preceding and 1 preceding), 0) as bigint) as file_offset from blob_refs r left join pl p using (blob_id))"


def _plan(v):
    refs = v.blob_refs.select(F.col("snapshot_id").alias("file"), "seq", "blob_id")
    placed = P.with_offsets(v.blobs).select("blob_id", "pack_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("len_stored").alias("len_plain"))
    return restore.plan(refs, placed)


@query("jn8_restore_plan", "select snapshot_id as file, seq, pack_id, ordinal from rpn", PLACED)
def restore_plan(v):
    return _plan(v).select("file", "seq", "pack_id", "ordinal")


@query("win5_file_offsets", "select snapshot_id as file, seq, file_offset from rpn", PLACED)
def file_offsets(v):
    return _plan(v).select("file", "seq", "file_offset")


@query("srt6_pack_order", "select pack_id, ordinal, snapshot_id as file, seq from rpn", PLACED)
def pack_order(v):
    return restore.in_pack_order(_plan(v)).select("pack_id", "ordinal", "file", "seq")


@query("win9_completion", "select snapshot_id as file, count(*) as chunks, cast(sum(len_stored) as bigint) as bytes, max({'p': pack_id, 'o': ordinal}).p as last_pack, max({'p': pack_id, 'o': ordinal}).o as last_ordinal from rpn group by all", PLACED)
def completion(v):
    return restore.completion(_plan(v))


@query("agg10_restore_totals", "select count(distinct snapshot_id) as files, cast(sum(len_stored) as bigint) as bytes from rpn", PLACED)
def totals(v):
    return restore.completion(_plan(v)).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


@query("win7_chunk_ordinals", "select snapshot_id, seq, row_number() over (partition by snapshot_id order by seq) - 1 as ordinal from blob_refs")
def ordinals(v):
    chunks_ = v.blob_refs.groupBy("snapshot_id").agg(F.array_sort(F.collect_list("seq")).alias("c"))
    return chunks_.select("snapshot_id", F.posexplode("c").alias("ordinal", "seq")).select("snapshot_id", "seq", F.col("ordinal").cast("bigint").alias("ordinal"))


@query("src10_blob_lookup", "select blob_id, pack_id, ordinal from pl where blob_id % 97 = 0", PLACED)
def lookup(v):
    wanted = v.blobs.where("blob_id % 97 = 0").select("blob_id")
    return P.with_offsets(v.blobs).join(wanted, "blob_id", "left_semi").select("blob_id", "pack_id", F.col("ordinal").cast("bigint").alias("ordinal"))


ISSUES = "select 'blob-without-pack' as issue, cast(blob_id as varchar) as subject from blobs where pack_id % 37 = 0 union all select 'snapshot-without-root', cast(snapshot_id as varchar) from (select snapshot_id, min(blob_id) as root from blob_refs group by all) where root % 53 = 0 union all select 'pack-missing', cast(pack_id as varchar) from packs where pack_id % 37 <> 0 and pack_id % 41 = 0"


@query("jn9_index_issues", ISSUES)
def index_issues(v):
    known, roots = v.packs.where("pack_id % 37 <> 0"), v.blob_refs.groupBy("snapshot_id").agg(F.min("blob_id").alias("root"))
    blobs_ = v.blobs
    found = restore.index_issues(blobs_, known, roots.limit(0), known.where("pack_id % 41 <> 0"))
    lost = restore.index_issues(blobs_.where("blob_id % 53 <> 0"), v.packs, roots)
    return found.unionByName(lost)


@query("jn10_hash_issues", "select 'hash-differs' as issue, cast(doc_id as varchar) as subject from documents where doc_id % 29 = 0")
def hash_issues(v):
    d = v.table("documents")
    real = d.select("doc_id", F.sha2("text", 256).alias("hash"))
    recorded = d.select("doc_id", F.sha2(F.when(F.col("doc_id") % 29 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return restore.hash_issues(recorded, real, "doc_id", "hash-differs")


@query("eng6_verify_counts", f"select issue, count(*) as n from ({ISSUES}) group by all")
def verify_counts(v):
    return index_issues(v).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))


@query("eng7_restore_actions", "select snapshot_id as file, case when snapshot_id % 5 = 0 then 'skip' else 'write' end as action from snapshots")
def actions(v):
    files = v.snapshots.select(F.col("snapshot_id").alias("file"))
    return restore.apply_policy(files, files.where("file % 5 = 0"), "skip")


@query("snk9_restored_content", "select conv_id as file, octet_length(encode(string_agg(text, '' order by turn, text))) as bytes, sha256(string_agg(text, '' order by turn, text)) as sha256 from conversations group by all")
def restored(v):
    rows = v.table("conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("turn"), "text").withColumn("seq", F.row_number().over(W.partitionBy("file").orderBy("turn", "text"))).withColumn("blob_id", F.concat_ws("-", "file", "seq"))
    put = restore.contents(rows.select("file", "seq", "blob_id"), rows.select("blob_id", F.col("text").cast("binary").alias("payload")))
    return put.select("file", F.length("content").cast("bigint").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("jn15_ambiguous_roots", "select lower(c_mktsegment) as segment, count(distinct c_nationkey) as paths from customer group by all having count(distinct c_nationkey) > 1")
def ambiguous(v):
    return restore.ambiguous_roots(v.table("customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("source_path")))


@query("snk10_write_if_new", "select distinct parent from tree_edges where parent like 'n%' and parent not in (select 'n' || n_nationkey from nation where n_nationkey % 2 = 0)")
def write_if_new(v):
    roots = v.tree_edges.where("parent like 'n%'").select("parent").distinct()
    return roots.join(v.table("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("parent")), "parent", "left_anti")


@query("src2_listing")
def file_listing(v):
    return sources.listing(v.spark, v.sf_dir, "*.parquet").select("name", "size")


@query("src1_file_tree")
def file_tree(v):
    return sources.tree(v.spark, v.sf_dir).select("name", "is_directory", "size")


@query("scl3_sub_keys")
def sub_keys(v):
    rows = [(label, crypto.sub_key(MASTER, label).hex()) for label in crypto.SUB_KEYS]
    return v.spark.createDataFrame(rows, "label string, key string")


@query("udf2_gear_table")
def gear(v):
    rows = [(i, f"{int(x):016x}") for i, x in enumerate(chunking.gear_table(MASTER))]
    return v.spark.createDataFrame(rows, "byte int, value string")


# --- whole runs


def _files(v):
    d = v.table("documents")
    return d.select(F.col("doc_id").cast("string").alias("path"), F.concat("doc_id", F.lit(".txt")).alias("name"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").cast("long").alias("mtime"), F.lit(0).alias("attributes"), F.col("text").cast("binary").alias("content"))


def _backup(v):
    """A first run over the even documents and a second one over all, which reads what is
    new or has another size: every seventh even document had another then."""
    spark, files = v.spark, _files(v)
    none = spark.createDataFrame([], "path string, size long, mtime long, attributes int, seq long, blob_id string")
    old = files.where("mtime % 2 = 0").withColumn("content", F.when(F.col("mtime") % 7 == 0, F.concat(F.lit(b"old "), "content")).otherwise(F.col("content"))).withColumn("size", F.length("content").cast("long"))
    first = repository.backup(old, none, spark.createDataFrame([], "blob_id string"), MASTER, datetime(2024, 1, 1))
    parent = first["chunks"].join(old.select("path", "size", "mtime", "attributes"), "path")
    return first, repository.backup(files, parent, first["blobs"], MASTER, datetime(2024, 1, 2))


RUN = "od as (select case when doc_id % 7 = 0 then 'old ' || text else text end as text from documents where doc_id % 2 = 0)"


@query("eng1_backup_run", """select count(*) filter (where doc_id % 2 = 1) as new_files, count(*) filter (where doc_id % 14 = 0) as changed_files, count(*) filter (where doc_id % 2 = 0 and doc_id % 7 <> 0) as unchanged_files,
  cast(coalesce(sum(octet_length(encode(text))) filter (where doc_id % 2 = 1 or doc_id % 14 = 0), 0) as bigint) as bytes_to_read, (select count(distinct text) from documents where (doc_id % 2 = 1 or doc_id % 14 = 0) and text <> '' and text not in (select text from od)) as new_blobs from documents""", RUN)  # fmt: skip
def backup_run(v):
    return _backup(v)[1]["snapshot"].drop("new_bytes")


@query("eng7_restore_run", "select cast(doc_id as varchar) as file, octet_length(encode(text)) as bytes, sha256(text) as sha256 from documents where text <> ''")
def restore_run(v):
    """Every file of the second run, from the packs of both."""
    first, second = _backup(v)
    blobs, packs = first["blobs"].unionByName(second["blobs"]), first["packs"].unionByName(second["packs"])
    return repository.file_digests(repository.restored(second["chunks"].withColumnRenamed("path", "file"), blobs, packs, MASTER))


SEALED = f"tx as (select text, min(doc_id) as i, {_hmac('text', *ID)} as blob_id from documents where text <> '' group by text)"


@query("eng6_verify_full", """select 'pack-missing' as issue, '5' as subject union all select 'pack-hash-differs', unnest(['3', '7', '9']) union all select 'pack-header-damaged', '7' union all select 'blob-without-pack', blob_id from tx where i % 40 = 11
  union all select 'blob-unreadable', min(blob_id) from tx where i % 40 = 9""", SEALED)  # fmt: skip
def verify_full(v):
    """Forty packs: one is unknown to the index, one lost, one cut, one has a wrong hash on
    record, and one a wrong byte in its first blob."""
    d = v.table("documents").where("text <> ''")
    one = d.groupBy("text").agg(F.min("doc_id").alias("i")).select((F.col("i") % 40).cast("string").alias("pack_id"), F.lit(0).cast("byte").alias("kind"), crypto.blob_id(F.col("text"), MASTER).alias("blob_id"), F.col("text").cast("binary").alias("payload"))
    rows = written(one.withColumn("len_plain", F.length("payload")).withColumn("codec", F.lit(0).cast("byte")), "rows")
    made = written(P.encoded(rows, MASTER), "packs", 1)  # Python gets a pack at a time
    index = made.select("pack_id", F.when(F.col("pack_id") == "3", F.sha2(F.lit("x"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    p = F.col("pack_id")
    cut, flipped = F.expr("substring(content, 1, length(content) - 30)"), F.expr("overlay(content placing unhex(lpad(hex(255 - conv(hex(substring(content, 17, 1)), 16, 10)), 2, '0')) from 17 for 1)")
    stored = made.where("pack_id <> '5'").withColumn("content", F.when(p == "7", cut).when(p == "9", flipped).otherwise(F.col("content")))
    return repository.verify("Full", rows.select("blob_id", "pack_id"), index.where("pack_id <> '11'"), v.spark.createDataFrame([], "snapshot_id string, root string"), stored, MASTER)
