"""Explicit schemas of the catalog's tables, of trees and of the records between operators."""

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "binary": T.BinaryType(), "tinyint": T.ByteType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(), "timestamp_ntz": T.TimestampNTZType(), "array<string>": T.ArrayType(T.StringType()),
}


def _s(columns: str) -> T.StructType:
    """From "name type, ..."; unlike StructType.fromDDL it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split(" ") for c in columns.split(", "))])


PACKS = _s("pack_id string, sha256 binary, size_bytes bigint, created_at timestamp_ntz")
BLOBS = _s("blob_id string, pack_id string, kind tinyint, offset bigint, len_stored int, len_plain int, compression tinyint")
SNAPSHOTS = _s("snapshot_id string, plan_id string, parent_snapshot_id string, started_at timestamp_ntz, finished_at timestamp_ntz, root_tree_blob_id string, tags string")
SNAPSHOT_PATHS = _s("id int, snapshot_id string, source_path string")
PLANS = _s("plan_id string, name string, source_paths_json string, cron_schedule string, retention_policy_json string, verify_cron_schedule string, verify_level string, created_at timestamp_ntz")
JOBS = _s("job_id string, plan_id string, kind string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string")
JOB_LOGS = _s("id int, job_id string, timestamp timestamp_ntz, level string, message string")
AUDIT_LOGS = _s("id int, timestamp timestamp_ntz, actor string, action string, details string")
CATALOG = {"packs": PACKS, "blobs": BLOBS, "snapshots": SNAPSHOTS, "snapshot_paths": SNAPSHOT_PATHS, "plans": PLANS, "jobs": JOBS, "job_logs": JOB_LOGS, "audit_logs": AUDIT_LOGS}

#: One node of a tree blob, with the short names of its JSON.
TREE_NODE = _s("n string, t string, sz bigint, mt bigint, attr int, sddl string, c array<string>, sub string")
TREE = T.StructType([T.StructField("nodes", T.ArrayType(TREE_NODE))])
POLICY = _s("KeepLast int, KeepHourly int, KeepDaily int, KeepWeekly int, KeepMonthly int, KeepYearly int, KeepWithin string, KeepTags array<string>")
SOURCE_ENTRIES = _s("full_path string, name string, is_directory boolean, size bigint, last_write timestamp, attributes int, is_reparse boolean, is_placeholder boolean")
PACK_ENTRIES = _s("pack_id string, kind tinyint, blob_id string, offset bigint, len_stored int, len_plain int, compression tinyint")
CHUNKS = _s("path string, seq int, offset bigint, length int, chunk_id string")
KEYS = {"packs": "pack_id", "blobs": "blob_id", "snapshots": "snapshot_id", "snapshot_paths": "id", "plans": "plan_id", "jobs": "job_id", "job_logs": "id", "audit_logs": "id"}
