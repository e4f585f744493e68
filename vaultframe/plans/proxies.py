"""Views of the driver's tables as the relations of a backup catalog.

Each is defined twice, as a DataFrame and as a common table expression, so that one SQL
engine can check what the other computes.
"""

from __future__ import annotations

from datetime import datetime
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed clocks: tables end on these days.
SNAPSHOT_NOW, JOB_NOW = datetime(2001, 8, 1), datetime(2024, 1, 31)
ERRORS = ("Access to the path is denied.", "The file is being used by another process.", "Repository is not enabled for unattended access", None)
MASTER = bytes(range(32))

SQL = {
    "snapshots": "select o_orderkey as snapshot_id, o_custkey as plan_id, o_orderdate as started_at, [lower(o_orderpriority)] as tags from orders",
    "blob_refs": "select l_orderkey as snapshot_id, l_partkey * 10000 + l_suppkey as blob_id, l_linenumber as seq from lineitem",
    "blobs": "select l_partkey * 10000 + l_suppkey as blob_id, l_partkey * 10 + l_suppkey % 10 as pack_id, cast(max(l_quantity) as int) as len_stored from lineitem group by all",
    "packs": "select pack_id, cast(40 + sum(len_stored) + 66 * count(*) as bigint) as size_bytes from blobs group by all union all select -s_suppkey, 40 from supplier where s_suppkey % 5 = 0",
    "jobs": """select event_id as job_id, user_id as plan_id, 'repo' || (user_id % 5) as repo, case when event_id % 5 = 0 then 'verify' else 'backup' end as kind,
      case event_type when 'error' then 'Failed' when 'purchase' then 'Succeeded' when 'click' then 'Running' when 'signup' then 'Pending' else 'Cancelled' end as status,
      case when event_type <> 'signup' then ts end as started_at, case when event_type in ('error', 'purchase', 'view') then ts + to_seconds(cast(floor(value) as bigint)) end as finished_at,
      case when event_type = 'error' then case event_id % 4 when 0 then 'Access to the path is denied.' when 1 then 'The file is being used by another process.' when 2 then 'Repository is not enabled for unattended access' end end as error_message from events""",
    "files_a": "select source || '/' || lang || '/' || doc_id as path, cast(doc_id as varchar) || case when doc_id % 50 = 0 then '.locked' else '.txt' end as name, n_chars as size, doc_id as mtime, cast(doc_id % 4 as int) as attributes from documents",
    "files_b": """select path, name, size + case when id % 7 = 0 then 1 else 0 end as size, mtime, attributes from (select *, mtime as id from files_a) where id % 11 <> 0
      union all select regexp_replace(path, '[^/]+$', '') || (mtime + 1000000000), name, size, mtime, attributes from files_a where mtime % 13 = 0""",
    "tree_edges": """select 'root' as parent, r_name as name, 'dir' as kind, 'r' || r_regionkey as sub from region
      union all select 'r' || n_regionkey, n_name, 'dir', 'n' || n_nationkey from nation
      union all select 'n' || c_nationkey, c_name, 'dir', 'c' || c_custkey from customer
      union all select 'c' || o_custkey, 'o' || o_orderkey, 'file', null from orders""",
    "logs": "select conv_id as job_id, turn as logged, role as level, text as message from conversations",
    "plans": """select c_custkey as plan_id, c_name as name, '["C:\\Data\\' || c_mktsegment || '","D:\\Mail"]' as source_paths_json,
      case c_custkey % 5 when 0 then '0 3 * * *' when 1 then '0 8-20/2 * * 1,2,3,4,5' when 2 then '0 22 * * 0,6' when 3 then '30 3 * * *'
        else case c_custkey % 25 when 4 then '0 6 1-7 * 1' when 9 then '15 4 31 * *' when 14 then '0 0 29 2 *' when 19 then '0 0 30 2 *' end end as cron_schedule,
      case c_custkey % 4 when 0 then '{"KeepDaily":7,"KeepWeekly":4,"KeepMonthly":12}' when 1 then '{"KeepLast":10}' when 2 then '{"KeepLast":3,"KeepYearly":2}' end as retention_policy_json,
      case c_custkey % 3 when 0 then 'Index' when 1 then 'Full' else 'odd' end as verify_level from customer""",
}


def sql(select: str, ctes: str = "", recursive: bool = False) -> str:
    """A statement over the views that it, or a view that it needs, names."""
    text, used = f"{ctes} {select}", set()
    import re

    grown = True
    while grown:
        grown = False
        for name, body in SQL.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                text += " " + body
                grown = True
    parts = [f"{n} as ({b})" for n, b in SQL.items() if n in used] + ([ctes] if ctes else [])
    return f"with {'recursive ' if recursive else ''}{', '.join(parts)} {select}" if parts else select


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.table("orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_custkey").alias("plan_id"), F.col("o_orderdate").alias("started_at"), F.array(F.lower("o_orderpriority")).alias("tags"))

    @cached_property
    def blob_refs(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("snapshot_id"), (F.col("l_partkey") * 10000 + F.col("l_suppkey")).alias("blob_id"), F.col("l_linenumber").alias("seq"))

    @cached_property
    def blobs(self) -> DataFrame:
        p, s = F.col("l_partkey"), F.col("l_suppkey")
        return self.table("lineitem").groupBy((p * 10000 + s).alias("blob_id"), (p * 10 + s % 10).alias("pack_id")).agg(F.max("l_quantity").cast("int").alias("len_stored"))

    @cached_property
    def packs(self) -> DataFrame:
        """Files with salt, tags and header; some hold no blob."""
        full = self.blobs.groupBy("pack_id").agg((F.lit(40) + F.sum("len_stored") + 66 * F.count(F.lit(1))).alias("size_bytes"))
        return full.unionByName(self.table("supplier").where("s_suppkey % 5 = 0").select((-F.col("s_suppkey")).alias("pack_id"), F.lit(40).cast("bigint").alias("size_bytes")))

    @cached_property
    def jobs(self) -> DataFrame:
        kinds = {"error": "Failed", "purchase": "Succeeded", "click": "Running", "signup": "Pending"}
        status = F.lit("Cancelled")
        for k, v in kinds.items():
            status = F.when(F.col("event_type") == k, v).otherwise(status)
        e = F.col("event_id") % 4
        message = F.when(F.col("event_type") == "error", F.when(e == 0, ERRORS[0]).when(e == 1, ERRORS[1]).when(e == 2, ERRORS[2]))
        return self.table("events").select(
            F.col("event_id").alias("job_id"), F.col("user_id").alias("plan_id"), F.concat(F.lit("repo"), (F.col("user_id") % 5).cast("string")).alias("repo"), F.when(F.col("event_id") % 5 == 0, "verify").otherwise("backup").alias("kind"),
            status.alias("status"), F.when(F.col("event_type") != "signup", F.col("ts")).alias("started_at"), F.when(F.col("event_type").isin("error", "purchase", "view"), F.timestamp_add("SECOND", F.floor("value"), F.col("ts"))).alias("finished_at"), message.alias("error_message"),
        )

    @cached_property
    def files_a(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(F.concat_ws("/", "source", "lang", d.cast("string")).alias("path"), F.concat(d.cast("string"), F.when(d % 50 == 0, ".locked").otherwise(".txt")).alias("name"), F.col("n_chars").alias("size"), d.alias("mtime"), (d % 4).cast("int").alias("attributes"))

    @cached_property
    def files_b(self) -> DataFrame:
        a, i = self.files_a, F.col("mtime")
        old = a.where(i % 11 != 0).withColumn("size", F.col("size") + F.when(i % 7 == 0, 1).otherwise(0))
        new = a.where(i % 13 == 0).withColumn("path", F.concat(F.regexp_replace("path", "[^/]+$", ""), (i + 1000000000).cast("string")))
        return old.unionByName(new)

    @cached_property
    def tree_edges(self) -> DataFrame:
        def level(table: str, parent, name, kind: str, sub) -> DataFrame:
            return self.table(table).select(parent.alias("parent"), name.alias("name"), F.lit(kind).alias("kind"), sub.cast("string").alias("sub"))

        tag = lambda t, c: F.concat(F.lit(t), F.col(c).cast("string"))
        top = level("region", F.lit("root"), F.col("r_name"), "dir", tag("r", "r_regionkey"))
        top = top.unionByName(level("nation", tag("r", "n_regionkey"), F.col("n_name"), "dir", tag("n", "n_nationkey")))
        top = top.unionByName(level("customer", tag("n", "c_nationkey"), F.col("c_name"), "dir", tag("c", "c_custkey")))
        return top.unionByName(level("orders", tag("c", "o_custkey"), tag("o", "o_orderkey"), "file", F.lit(None)))

    @cached_property
    def logs(self) -> DataFrame:
        return self.table("conversations").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("logged"), F.col("role").alias("level"), F.col("text").alias("message"))

    @cached_property
    def plans(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.table("customer").select(
            c.alias("plan_id"), F.col("c_name").alias("name"), F.concat(F.lit('["C:\\\\Data\\\\'), F.col("c_mktsegment"), F.lit('","D:\\\\Mail"]')).alias("source_paths_json"),
            F.when(c % 5 == 0, "0 3 * * *").when(c % 5 == 1, "0 8-20/2 * * 1,2,3,4,5").when(c % 5 == 2, "0 22 * * 0,6").when(c % 5 == 3, "30 3 * * *")
            .when(c % 25 == 4, "0 6 1-7 * 1").when(c % 25 == 9, "15 4 31 * *").when(c % 25 == 14, "0 0 29 2 *").when(c % 25 == 19, "0 0 30 2 *").alias("cron_schedule"),
            F.when(c % 4 == 0, '{"KeepDaily":7,"KeepWeekly":4,"KeepMonthly":12}').when(c % 4 == 1, '{"KeepLast":10}').when(c % 4 == 2, '{"KeepLast":3,"KeepYearly":2}').alias("retention_policy_json"),
            F.when(c % 3 == 0, "Index").when(c % 3 == 1, "Full").otherwise("odd").alias("verify_level"),
        )

    @cached_property
    def contents(self) -> DataFrame:
        return self.table("documents").select(F.col("doc_id").alias("path"), F.col("text").cast("binary").alias("content"))
