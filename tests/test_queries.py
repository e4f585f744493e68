"""Every registered query against its SQL on the smallest tables; sources, sinks, plans."""

import glob
import math
import os

import pytest

import __spark_entry__
from vaultframe.plans import ORACLES, QUERIES
from vaultframe.schemas import CATALOG
from vaultframe.sources import catalog, files

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, (bytes, bytearray)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    if name in ORACLES:
        found = duck.execute(ORACLES[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in found.fetchall())


def same_as_sql(spark, name, folder):
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}/*.parquet'")
    found = c.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want, got = found.fetchall(), [tuple(r) for r in QUERIES[name](spark, str(folder)).select(*names).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    return dict(got) if len(names) == 2 else sorted(got)


def test_byte_sizes_just_below_a_kilobyte(spark, tmp_path):
    keys = [0, 1, 31, 32, 33, 900, 936, 1047, 948, 949, None, *range(10_000, 12_000)]
    keys += [k for k in range(150_000) if 1000 <= k * k % 900_000 < 1024]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    assert same_as_sql(spark, "scl12_byte_sizes", tmp_path)[1009] == "1009 B"


def test_numbers_of_a_billion_and_more(spark, tmp_path):
    keys = [0, 1, 2, 1023, 1024, 1025, 1_023_541, 1_023_542, 9_000_000, 10**12, -1, -5000, None]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = same_as_sql(spark, "scl13_numbers", tmp_path)
    assert got[9_000_000] == "8793.000.000" and got[1023] == "999.471"


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() in (2, 3)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_catalog_versions_cascades_and_audit(spark, tmp_path):
    c = catalog.Catalog(spark, f"file://{tmp_path}/repo")
    assert not c.exists() and c.read("jobs").schema == CATALOG["jobs"]
    c.replace("packs", spark.createDataFrame([("p1", None, 5, None), ("p2", None, 6, None)], CATALOG["packs"]))
    c.replace("blobs", spark.createDataFrame([("b1", "p1", 0, 0, 1, 1, 0), ("b2", "p2", 0, 0, 1, 1, 0)], CATALOG["blobs"]))
    c.upsert("packs", spark.createDataFrame([("p2", None, 60, None), ("p3", None, 7, None)], CATALOG["packs"]))
    assert {r["pack_id"]: r["size_bytes"] for r in c.read("packs").collect()} == {"p1": 5, "p2": 60, "p3": 7}
    c.delete("packs", spark.createDataFrame([("p1",)], "pack_id string"))
    assert [r["blob_id"] for r in c.read("blobs").collect()] == ["b2"] and c.read("packs").count() == 2
    c.audit("prune", "2 packs", "2026-08-06 12:00:00")
    c.audit("restore", None, "2026-08-06 13:00:00")
    assert [(r["id"], r["action"]) for r in c.read("audit_logs").orderBy("id").collect()] == [(1, "prune"), (2, "restore")]
    both = catalog.across(spark, {"one": f"file://{tmp_path}/repo", "none": f"file://{tmp_path}/missing"}, "packs")
    assert {r["repo"] for r in both.collect()} == {"one"} and both.count() == 2


def test_file_sources(spark, tmp_path):
    (tmp_path / "t" / "a" / "b").mkdir(parents=True)
    (tmp_path / "t" / "a" / "b" / "x.txt").write_text("hello")
    (tmp_path / "t" / "y.pack").write_bytes(b"123")
    (tmp_path / "t" / "link").symlink_to(tmp_path / "t" / "a")
    got = {r["name"]: r for r in files.tree(spark, str(tmp_path / "t")).collect()}
    assert set(got) == {"a", "b", "x.txt", "y.pack", "link"}
    assert got["x.txt"]["size"] == 5 and got["a"]["is_directory"] and got["a"]["size"] == 0 and got["link"]["is_reparse"]
    assert [(r["name"], r["size"]) for r in files.listing(spark, f"file://{tmp_path}/t", "*.pack").collect()] == [("y.pack", 3)]
    (tmp_path / "repo" / "data" / "ab").mkdir(parents=True)
    (tmp_path / "repo" / "data" / "ab" / "ab12.pack").write_bytes(b"abc")
    row = files.packs(spark, f"file://{tmp_path}/repo").first()
    assert row["pack_id"] == "ab12" and row["sha256"].startswith("ba7816bf")
    (tmp_path / "c.json").write_text('{"Version": 1, "Name": "x"}')
    (tmp_path / "d.json").write_text("{broken")
    rec = files.json_record(spark, f"file://{tmp_path}/*.json", "Version int, Name string")
    assert {r["Version"] for r in rec.collect()} == {1, None}


def test_plans_push_filters_and_prune_columns(spark):
    plan = QUERIES["flt1_by_key"](spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,7)" in plan
    scan = next(x for x in plan.splitlines() if x.startswith("ReadSchema"))
    assert "props" not in scan and "value" not in scan


def test_throttle_folds_every_stream(spark, tmp_path):
    import datetime

    base, rows = datetime.datetime(2024, 1, 1), []
    for u in (3, 19, 20, 21, 1400):
        rows += [(u * 10 + i, base + datetime.timedelta(seconds=i * (u % 7 + 1) * 1000), u, 30.0 + u % 5) for i in range(6)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    want = {}
    for _, ts, u, n in rows:
        avail, last, waited = want.get(u, (100.0, 0.0, 0.0))
        at = (ts - base).total_seconds()
        avail = min(100.0, avail + max(at - last, 0.0) * 0.001) - n
        want[u] = (avail, max(at, last), waited + max(0.0, -avail / 0.001))
    got = {r["stream"]: (r["requests"], r["available"], r["waited"]) for r in QUERIES["udf5_throttle"](spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    for u, (avail, _, waited) in want.items():
        assert got[u] == pytest.approx((6, avail, waited), abs=1e-3)


def test_scratch_tables_go_with_their_scope_and_application(spark, tmp_path):
    from vaultframe.sources import scratch

    files = lambda df: sorted(x.removeprefix("file://") for x in df.inputFiles())
    kept = scratch.written(spark.range(10).groupBy("id").count(), "kept", 3)
    with scratch.scope(spark):
        inner = scratch.written(kept, "inner")
        assert inner.count() == 10 and all(map(os.path.exists, files(inner)))
        gone = files(inner)
    assert not any(map(os.path.exists, gone)) and kept.count() == 10
    other = tmp_path / "neighbour"
    other.mkdir()
    dropped = files(once := scratch.written(kept, "once"))
    scratch.discard(once)
    assert not any(map(os.path.exists, dropped))
    mine = files(kept)
    assert all(spark.sparkContext.applicationId in f for f in mine)
    scratch.clear(spark)
    assert not any(map(os.path.exists, mine)) and other.exists()
    assert spark.conf.get(scratch.BATCH_ROWS) == "10000"
