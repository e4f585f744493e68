"""Operators on small tables with known answers."""

import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vaultframe.functions import cron, crypto, paths, text
from vaultframe.operators import chunking, diff, prune, report, restore, skips, tree
from vaultframe.operators import packs as P
from vaultframe.operators import retention as R
from vaultframe.schemas import CATALOG
from vaultframe.sources.scratch import written

NOW = datetime(2026, 8, 6, 12)


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


# --- retention

BASE = [(f"s{i}", NOW - timedelta(days=i), []) for i in range(10)]


def at(day, hour=12):
    return datetime.fromisoformat(day).replace(hour=hour)


def keep(spark, rows, **policy):
    df = spark.createDataFrame(rows, "snapshot_id string, started_at timestamp_ntz, tags array<string>")
    return {r["snapshot_id"] for r in R.evaluate(df, R.RetentionPolicy(**policy), NOW).where("keep").collect()}


@pytest.mark.parametrize(("rows", "policy", "kept"), [
    (BASE, {}, {r[0] for r in BASE}),
    (BASE, {"last": 3}, {"s0", "s1", "s2"}),
    (BASE, {"last": 0}, set()),
    ([*BASE, ("s0b", NOW - timedelta(hours=6), [])], {"daily": 3}, {"s0", "s1", "s2"}),
    ([("a", at("2026-08-06"), []), ("b", at("2026-08-04"), []), ("c", at("2026-07-28"), []), ("d", at("2026-07-21"), []), ("e", at("2026-07-14"), [])], {"weekly": 2}, {"a", "c"}),
    ([("a", at("2026-08-06"), []), ("b", at("2026-08-01"), []), ("c", at("2026-07-15"), []), ("d", at("2026-06-15"), [])], {"monthly": 2}, {"a", "c"}),
    ([("a", at("2026-08-06"), []), ("b", at("2026-01-01"), []), ("c", at("2025-06-01"), []), ("d", at("2024-06-01"), [])], {"yearly": 2}, {"a", "c"}),
    ([("a", at("2026-08-06", 9), []), ("b", at("2026-08-06", 8), []), ("c", at("2026-08-01", 8), [])], {"hourly": 2}, {"a", "b"}),
    (BASE, {"within": timedelta(days=3.5)}, {"s0", "s1", "s2", "s3"}),
    (BASE, {"within": timedelta(days=3)}, {"s0", "s1", "s2", "s3"}),
    ([*BASE[:9], ("s9", NOW - timedelta(days=9), ["Monthly-Archive"])], {"tags": ["monthly-archive"]}, {"s9"}),
    (BASE, {"last": 1, "yearly": 1}, {"s0"}),
    ([("n", at("2026-08-06"), None)], {"tags": ["x"]}, set()),
])
def test_retention_rules(spark, rows, policy, kept):
    assert keep(spark, rows, **policy) == kept


def test_generations_keep_the_last_week_and_few_others(spark):
    rows = [(f"d{i}", NOW - timedelta(days=i), []) for i in range(40)]
    kept = keep(spark, rows, daily=7, weekly=4, monthly=2)
    assert {f"d{i}" for i in range(7)} <= kept < {r[0] for r in rows}


def test_buckets_are_the_newest_that_are_not_empty(spark):
    rows = [("a", at("2026-08-06"), []), ("b", at("2026-07-06"), []), ("c", at("2026-03-06"), [])]
    assert keep(spark, rows, daily=3) == {"a", "b", "c"}


def test_protections_and_manual_deletes(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in BASE], "snapshot_id string, started_at timestamp_ntz")
    asked = spark.createDataFrame([("s0",), ("s3",), ("s5",), ("s5",), ("gone",)], "snapshot_id string")
    window = R.Protection(window=timedelta(days=3))
    got = {r["snapshot_id"]: (r["outcome"], r["reason"]) for r in R.manual_delete(asked, df, window, NOW).collect()}
    assert got == {"s0": ("refused", "immutable"), "s3": ("refused", "immutable"), "s5": ("deleted", None), "gone": ("refused", "not-found")}
    both = R.Protection(append_only=True, window=timedelta(days=3))
    assert {r["reason"] for r in R.manual_delete(asked, df, both, NOW).collect()} == {"append-only", "not-found"}
    plans = df.withColumn("plan_id", F.when(F.col("snapshot_id") < "s5", "p")).withColumn("tags", F.array().cast("array<string>"))
    kept = {r["snapshot_id"] for r in R.scoped(plans, R.RetentionPolicy(last=1), NOW, "p").where("keep").collect()}
    assert kept == {"s0", "s5", "s6", "s7", "s8", "s9"}


# --- prune


def test_packs_are_judged_by_their_share_of_live_blobs(spark):
    blobs = spark.createDataFrame([(f"{p}{i}", p, 10) for p, n in (("a", 10), ("b", 10), ("c", 10), ("d", 10)) for i in range(n)], "blob_id string, pack_id string, len_stored int")
    files = spark.createDataFrame([(p, 900 if p in "abcd" else 40) for p in "abcde"], "pack_id string, size_bytes long")
    live = spark.createDataFrame([(f"a{i}",) for i in range(7)] + [(f"b{i}",) for i in range(6)] + [(f"d{i}",) for i in range(10)], "blob_id string")
    packs = prune.classify_packs(files, blobs, live)
    assert {r["pack_id"]: (r["action"], r["total"]) for r in packs.collect()} == {"a": ("keep", 10), "b": ("repack", 10), "c": ("delete", 10), "d": ("keep", 10), "e": ("delete", 0)}
    assert prune.freed(packs).first()["bytes_freed"] == 1840 and prune.freed(packs, True).first()["bytes_freed"] == 0
    assert {r["pack_id"] for r in prune.carried(blobs, packs, live).collect()} == {"b"}
    assert prune.swept(blobs, packs).count() == 30 and {r["pack_id"] for r in prune.swept(files, packs).collect()} == set("abd")
    nothing = prune.classify_packs(files, blobs, live.limit(0))
    assert {r["action"] for r in nothing.collect()} == {"delete"}


def test_mark_walks_shared_subtrees_and_cycles_once(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "s"), ("b", "s"), ("s", "x"), ("x", "s"), ("q", "z"), ("r", None)], "parent string, child string")
    roots = spark.createDataFrame([("r",), ("r",)], "id string")
    assert sorted(r["id"] for r in prune.reachable(edges, roots, lambda df: written(df, "t")).collect()) == ["a", "b", "r", "s", "x"]


def test_upsert_and_new_blobs(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, prune.upserted(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    cand = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "blob_id string, seq int")
    assert [tuple(r) for r in prune.new_blobs(cand, spark.createDataFrame([("y",)], "blob_id string")).collect()] == [("x", 1)]


# --- packs

MASTER = bytes(range(32))


def blobs_of(spark):
    rows = [(f"p{p}", b % 2, f"{p * 16 + b:064x}", f"pack {p} blob {b}".encode()) for p in range(3) for b in range(4)]
    df = spark.createDataFrame([(*r, len(r[3]), 0) for r in rows], "pack_id string, kind byte, blob_id string, payload binary, len_plain int, codec byte")
    return rows, df


def test_packs_round_trip_and_show_damage(spark):
    rows, df = blobs_of(spark)
    made = written(P.encoded(df, MASTER), "packs")
    entries = P.headers(made, MASTER)
    assert entries.where("not damaged").count() == 12
    got = {r["blob_id"]: bytes(r["payload"]) for r in P.opened(made, entries, MASTER).collect()}
    assert got == {r[2]: r[3] for r in rows}
    assert P.headers(made, bytes(32)).where("damaged").count() == 3
    bad = made.withColumn("content", F.when(F.col("pack_id") == "p0", F.expr("substring(content, 1, 40)")).when(F.col("pack_id") == "p1", F.expr("concat(substring(content, 1, length(content) - 10), X'ff', substring(content, length(content) - 8, 9))")).otherwise(F.col("content")))
    assert {r["pack_id"] for r in P.headers(bad, MASTER).where("damaged").collect()} == {"p0", "p1"}
    flipped = made.withColumn("content", F.expr("concat(substring(content, 1, 20), X'00', substring(content, 22, length(content)))"))
    payloads = P.opened(flipped, P.headers(flipped, MASTER), MASTER)
    assert payloads.where("payload is null").count() == 3
    other = P.encoded(df.withColumn("payload", F.concat("payload", F.lit(b"!"))), MASTER)  # the same ids, another key
    salt = lambda packs: {r["pack_id"]: bytes(r["content"][:16]) for r in packs.collect()}
    assert salt(made) == salt(P.encoded(df, MASTER)) and not set(salt(made).values()) & set(salt(other).values())
    index, twice = P.rebuilt_index(entries.unionByName(entries.withColumn("pack_id", F.lit("z"))))
    assert index.count() == 12 and twice.count() == 12 and index.where("pack_id = 'z'").count() == 0


def test_packs_are_opened_as_one_row_each(spark):
    """A pack of many blobs is joined as one row, not once for each of them."""
    rows = [("p", 0, f"{b:064x}", f"blob {b}".encode() * 9) for b in range(700)]
    df = spark.createDataFrame([(*r, len(r[3]), 0) for r in rows], "pack_id string, kind byte, blob_id string, payload binary, len_plain int, codec byte")
    made = written(P.encoded(df, MASTER), "packs")
    opened = P.opened(made, P.headers(made, MASTER), MASTER)
    lines = opened._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda word: [i for i, x in enumerate(lines) if word in x]
    assert len(at("Join ")) == 1 and at("Generate posexplode")[0] < at("Join ")[0]
    got = {r["blob_id"]: bytes(r["payload"]) for r in opened.collect()}
    assert got == {r[2]: r[3] for r in rows}
    short = spark.createDataFrame([("a", bytearray(b"")), ("b", bytearray(19)), ("c", None), ("d", bytearray(b"\xff" * 40)), ("e", bytearray(60))], "pack_id string, content binary")
    assert {r["pack_id"] for r in P.headers(short, MASTER).where("damaged").collect()} == set("abcde")
    salts = [bytes(range(16)), b"\xff" * 16, bytes(16), b"\x80" + bytes(15)]
    keys = spark.createDataFrame([(bytearray(x),) for x in salts], "salt binary").select(crypto.hkdf_by(MASTER, b"pack", F.col("salt"), 16)).collect()
    assert [bytes(r[0]) for r in keys] == [crypto.hkdf(MASTER, b"pack", 32, x) for x in salts]


def test_compression_is_kept_where_it_saves(spark):
    noise = random.Random(1).randbytes(200_000)
    df = spark.createDataFrame([(1, bytearray(200_000)), (2, bytearray(noise)), (3, bytearray(b""))], "id int, content binary")
    got = {r["id"]: r for r in P.compressed(df, "content").collect()}
    assert (got[1]["codec"], got[2]["codec"], got[3]["codec"]) == (P.ZSTD, P.RAW, P.RAW)
    assert P.decompressed(bytes(got[1]["stored"]), P.ZSTD, 200_000) == bytes(200_000)
    with pytest.raises(ValueError):
        P.decompressed(b"x", 7, 1)
    with pytest.raises(ValueError):
        P.decompressed(b"xy", P.RAW, 1)


def test_rotation_takes_the_last_blob_whole(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([60, 60, 10, 100, 99, 1, 5])] + [(2, 0, 500)], "w int, seq int, size int")
    got = {(r["writer"], r["seq"]): r["pack_no"] for r in P.rotation(df, "w", "seq", "size", 100).collect()}
    assert [got[1, i] for i in range(7)] == [0, 0, 1, 1, 2, 2, 3] and got[2, 0] == 0


# --- crypto


def test_published_vectors():
    # RFC 5869, case 1
    okm = crypto.hkdf(bytes([0x0B] * 22), bytes(range(0xF0, 0xFA)), 42, bytes(range(13)))
    assert okm.hex() == "3cb25f25faacd57a90434f64d0362f2a2d2d0a90cf1a5a4c5db02d56ecc4c5bf34007208d5b887185865"


@settings(max_examples=10, deadline=None)
@given(st.binary(max_size=100), st.binary(min_size=1, max_size=100))
def test_hmac_expression_is_hmac(spark, content, key):
    import hashlib
    import hmac

    assert one(spark, crypto.hmac_sha256(F.lit(bytearray(content)), key))[0] == hmac.new(key, content, hashlib.sha256).hexdigest()


def test_sealing(spark):
    key = bytes(range(32))
    df = spark.range(3).select("id", crypto.seal(F.lit("secret").cast("binary"), key, F.col("id")).alias("c"))
    assert [bytes(r[0]) for r in df.select(crypto.unseal(F.col("c"), key, F.col("id"))).collect()] == [b"secret"] * 3
    assert df.where(crypto.unseal(F.col("c"), key, F.col("id") + 1).isNotNull()).count() == 0
    assert df.where(F.length("c") != 6 + P.TAG_BYTES).count() == 0


# --- chunking

SIZES = chunking.Sizes(64, 256, 1024, 10, 6)


def plain_cuts(data, gear, s):
    out, start = [], 0
    while start < len(data):
        d = data[start:]
        n = min(s.most, len(d)) if len(d) > s.least else len(d)
        fp = 0
        for i in range(s.least, n):
            fp = (fp << 1) + int(gear[d[i]])
            if not fp & ((1 << (s.strict_bits if i < min(s.normal, len(d)) else s.loose_bits)) - 1):
                n = i + 1
                break
        start += n
        out.append(start)
    return out


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6000), st.sampled_from([(10, 6), (12, 8), (9, 9), (6, 4)]))
def test_cuts_are_those_of_the_rolling_hash(seed, n, bits):
    sizes, gear = chunking.Sizes(64, 256, 1024, *bits), chunking.gear_table(MASTER)
    data = random.Random(seed).randbytes(n)
    got = chunking.cuts(data, gear, sizes)
    assert got == plain_cuts(data, gear, sizes)
    lengths = [b - a for a, b in zip([0, *got], got, strict=False)]
    assert sum(lengths) == n and all(x <= 1024 for x in lengths) and all(x >= 64 for x in lengths[:-1])


def test_production_cuts_and_resynchronisation():
    gear, r = chunking.gear_table(MASTER), random.Random(4)
    data = r.randbytes(12 << 20)
    one_, two = chunking.cuts(data, gear), chunking.cuts(data[:1_000_000] + r.randbytes(777) + data[1_000_000:], gear)
    shifted = {c + 777 for c in one_}
    assert one_ == chunking.cuts(data, gear) and len(shifted & set(two)) >= len(one_) - 4
    assert chunking.cuts(data, chunking.gear_table(bytes(32))) != one_
    assert chunking.cuts(b"", gear) == [] and chunking.cuts(bytes(1000), gear) == [1000]


def test_chunks_put_together_are_the_content(spark):
    rows = [("a", bytearray(random.Random(1).randbytes(5000))), ("b", bytearray(b"")), ("c", None), ("d", bytearray(b"x"))]
    df = spark.createDataFrame(rows, "path string, content binary")
    parts = chunking.chunked(df, MASTER, SIZES, with_content=True).collect()
    for path, content in rows:
        own = sorted((p for p in parts if p["path"] == path), key=lambda p: p["seq"])
        assert b"".join(bytes(p["content"]) for p in own) == bytes(content or b"")
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]


# --- diff


def test_changes_and_diff(spark):
    schema = "path string, size long, mtime long, attributes int"
    old = spark.createDataFrame([("same", 1, 1, 0), ("size", 1, 1, 0), ("attr", 1, 1, 0), ("gone", 1, 1, 0)], schema)
    new = spark.createDataFrame([("same", 1, 1, 0), ("size", 2, 1, 0), ("attr", 1, 1, 4), ("new", 1, 1, 0)], schema)
    assert {r["path"]: r["status"] for r in diff.changes(new, old).collect()} == {"same": "unchanged", "size": "changed", "attr": "changed", "new": "new"}
    assert [r["path"] for r in diff.deletions(new, old).collect()] == ["gone"]
    assert {r["path"]: r["mark"] for r in diff.diff(old, new).collect()} == {"size": "~", "gone": "-", "new": "+"}


@pytest.mark.parametrize(("parent", "changed", "deleted", "names", "policy", "reasons"), [
    (100, 5, 2, ["report.docx"], diff.AnomalyPolicy(), 0), (100, 40, 20, [], diff.AnomalyPolicy(0.5, 20), 1), (5, 5, 0, [], diff.AnomalyPolicy(0.5, 20), 0),
    (1000, 2, 0, ["invoice.docx.locked", "photo.jpg"], diff.AnomalyPolicy(), 1), (1000, 1, 0, ["a.mysterious"], diff.AnomalyPolicy(endings=(".mysterious",)), 1),
    (1000, 3, 0, ["a.docx", "b.xlsx", "c.pdf"], diff.AnomalyPolicy(), 0), (10, 5, 0, ["a.encrypted"], diff.AnomalyPolicy(0.3, 10), 2), (100, 30, 20, [], diff.AnomalyPolicy(), 0),
])
def test_anomalies(spark, parent, changed, deleted, names, policy, reasons):
    bad = [n for n in names if n.endswith(tuple(policy.endings))]
    column = diff.anomaly_columns(F.lit(parent), F.lit(changed), F.lit(deleted), F.lit(len(bad)), F.array(*[F.lit(n) for n in bad]).cast("array<string>"), policy)
    got = one(spark, column.alias("v"))["v"]
    assert (got["detected"], len(got["reasons"])) == (reasons > 0, reasons)
    if parent == 100 and changed == 40:
        assert "60" in got["reasons"][0]


# --- trees


def test_walk_prunes_and_merkle_ids_follow_content(spark):
    rows = [("root", "a", "dir", "A"), ("root", "e.dat", "file", None), ("A", "b", "dir", "B"), ("B", "ü.xlsx", "file", None), ("A", "skip", "dir", "S"), ("S", "x", "file", None)]
    edges = spark.createDataFrame(rows, "parent string, name string, kind string, sub string")
    roots = spark.createDataFrame([("root", "")], "id string, prefix string")
    walk = lambda **how: tree.walk(edges, roots, lambda df: written(df, "level"), **how)
    assert sorted(r["path"] for r in walk().collect()) == ["a", "a/b", "a/b/ü.xlsx", "a/skip", "a/skip/x", "e.dat"]
    assert sorted(r["path"] for r in walk(visit="name <> 'skip'").collect()) == ["a", "a/b", "a/b/ü.xlsx", "e.dat"]
    assert sorted(r["path"] for r in walk(descend="depth < 2").collect()) == ["a", "a/b", "a/skip", "e.dat"]
    assert [(r["mark"], r["name"]) for r in tree.listing(walk(), "a").collect()] == [("d", "b"), ("d", "skip")]
    merkle = lambda df: {r["parent"]: r["tree_id"] for r in tree.merkle(df, bytes(32), F.col("name"), lambda d: written(d, "merkle")).collect()}
    twin = spark.createDataFrame([(p, n, "file", None) for p in ("P", "Q") for n in ("1", "2")] + [("R", "1", "file", None)], edges.schema)
    ids = merkle(twin)
    assert ids["P"] == ids["Q"] != ids["R"]
    deep = [(f"d{i}", "x", "dir", f"d{i + 1}") for i in range(12)] + [("d12", "f", "file", None), ("d0", "empty", "dir", "E"), ("loop", "x", "dir", "loop")]
    before = merkle(spark.createDataFrame(deep, edges.schema))
    assert set(before) == {f"d{i}" for i in range(13)} | {"E"}  # up to the root, and no further round a loop
    after = merkle(spark.createDataFrame([*deep[:12], ("d12", "g", "file", None), *deep[13:]], edges.schema))
    assert before["E"] == after["E"] and all(before[f"d{i}"] != after[f"d{i}"] for i in range(13))


# --- restore


def test_offsets_of_copies_of_a_blob_follow_their_packs(spark):
    chunks = spark.createDataFrame([("f", 0, "b"), ("f", 1, "c")], "file string, seq int, blob_id string")
    rows = [("b", p, o, n) for p, o, n in ((9, 0, 5), (2, 1, 30), (2, 0, 7), (4, 0, 11))] + [("c", 1, 0, 3)]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        blobs = spark.createDataFrame(order, "blob_id string, pack_id int, ordinal int, len_plain int")
        got = {(r["seq"], r["pack_id"], r["ordinal"]): r["file_offset"] for r in restore.plan(chunks, blobs).collect()}
        assert got == {(0, 2, 0): 0, (0, 2, 1): 7, (0, 4, 0): 37, (0, 9, 0): 48, (1, 1, 0): 53}


def test_restore_plan_and_policies(spark):
    chunks = spark.createDataFrame([("f", 0, "x"), ("f", 1, "y"), ("f", 2, "x"), ("g", 0, "lost")], "file string, seq int, blob_id string")
    blobs = spark.createDataFrame([("x", "p1", 0, 5), ("y", "p1", 1, 7)], "blob_id string, pack_id string, ordinal int, len_plain int")
    plan = restore.plan(chunks, blobs)
    assert [r["file_offset"] for r in plan.where("file = 'f'").orderBy("seq").collect()] == [0, 5, 12]
    assert [tuple(r) for r in restore.missing(plan).collect()] == [("g", 0, "lost")]
    done = {r["file"]: r for r in restore.completion(plan.where("pack_id is not null")).collect()}
    assert (done["f"]["chunks"], done["f"]["bytes"], done["f"]["last_ordinal"]) == (3, 17, 1)
    payloads = spark.createDataFrame([("x", bytearray(b"abcde")), ("y", bytearray(b"1234567"))], "blob_id string, payload binary")
    assert bytes(restore.contents(chunks.where("file = 'f'"), payloads).first()["content"]) == b"abcde1234567abcde"
    files, there = chunks.select("file").distinct(), spark.createDataFrame([("f",)], "file string")
    act = lambda p: {r["file"]: r["action"] for r in restore.apply_policy(files, there, p).collect()}
    assert act("skip") == {"f": "skip", "g": "write"} and act("overwrite") == {"f": "write", "g": "write"}
    with pytest.raises(Exception, match="exists"):
        act("fail")


def test_paths(spark):
    for path, ok in (("Veri/rapor.txt", True), ("C/Kullanicilar/belge.docx", True), ("C:\\Windows\\hosts", False), ("..\\..\\Windows", False), ("../../escaped.txt", False), ("Veri/../../escaped.txt", False), ("/etc", False)):
        assert one(spark, paths.is_contained(F.lit(path)))[0] == ok, path
    for path, name in (("C:\\", "C"), ("C:\\Veri", "Veri"), ("C:\\Veri\\", "Veri"), ("D:\\bir\\iki\\Uc", "Uc")):
        assert one(spark, paths.root_of_source(F.lit(path)))[0] == name
    for path, name in (("D:\\Yedek\\Muhasebe", "Muhasebe"), ("D:\\Yedek\\Muhasebe\\", "Muhasebe"), ("\\\\NAS01\\yedek\\fs01", "fs01"), ("D:\\", "D:")):
        assert one(spark, paths.display_name(F.lit(path)))[0] == name
    scope = lambda p, s: one(spark, paths.in_scope(F.lit(p), s))[0]
    assert scope("a/b", ["a"]) and scope("a", ["a/b"]) and scope("a", ["a"]) and not scope("ab", ["a"]) and scope("x", None) and not scope("x", [])
    out = lambda p, **g: one(spark, paths.excluded(F.lit(p), F.lit(p.split("/")[-1]), **g))[0]
    assert out("a/b.TMP", exclude=["**/*.tmp"]) and not out("a/keep.txt", exclude=["**/*.tmp"]) and out("Pagefile.SYS") and out("a/dir", include=["**/*.txt"])
    devices = {"D:\\": "\\\\?\\Device\\Copy1"}
    there = one(spark, paths.map_path(F.lit("d:\\Data\\f"), devices))[0]
    assert there == "\\\\?\\Device\\Copy1\\Data\\f" and one(spark, paths.unmap_path(F.lit(there), devices))[0] == "D:\\Data\\f"


# --- reports


def test_health_calendar(spark):
    day = datetime(2026, 8, 7)
    run = lambda rows, n: [r["health"] for r in report.day_health(spark.createDataFrame(rows, "started_at timestamp_ntz, status string"), day, n).orderBy("day").collect()]
    assert run([], 3) == ["None"] * 3
    assert run([(day, "Succeeded")], 1) == ["Ok"] and run([(day, "Succeeded"), (day, "Failed")], 1) == ["Err"]
    assert run([(day - timedelta(days=1), "Failed"), (day, "Succeeded"), (None, "Failed")], 2) == ["Err", "Ok"]


def test_latest_rows_put_nulls_last(spark):
    jobs = spark.createDataFrame([("a", 1, None), ("a", 2, NOW), ("b", 3, None), ("c", 4, NOW), ("c", 5, NOW)], "repo string, job_id int, started_at timestamp_ntz")
    assert {r["repo"]: r["job_id"] for r in report.latest(jobs, ("repo",)).collect()} == {"a": 2, "b": 3, "c": 5}


def test_queue_holds_one_job_for_each_plan(spark):
    due = spark.createDataFrame([("p", "backup"), ("q", "backup"), ("p", "verify")], "plan_id string, kind string")
    jobs = spark.createDataFrame([("p", "backup", "Running"), ("q", "backup", "Failed")], "plan_id string, kind string, status string")
    assert sorted(map(tuple, report.not_queued(due, jobs).collect())) == [("p", "verify"), ("q", "backup")]


def test_token_bucket(spark):
    rows = [(1, i, 0.0, 100.0) for i in range(4)] + [(2, 0, 0.0, 50.0), (2, 1, 10.0, 50.0)]
    got = {r["stream"]: r["waited"] for r in report.throttle(spark.createDataFrame(rows, "stream int, seq int, at double, n double"), 100.0, 100.0).collect()}
    assert got == {1: 0.0 + 1.0 + 2.0 + 3.0, 2: 0.0}


def test_formatters(spark):
    f = lambda c: one(spark, c)[0]
    assert [f(text.byte_size(F.lit(n))) for n in (0, 1023, 1024, 5153960, 1280)] == ["0 B", "1.023 B", "1,0 KB", "4,9 MB", "1,3 KB"]
    assert f(text.number(F.lit(3204))) == "3.204"
    assert f(text.duration(F.lit(4320))) == "1 sa 12 dk" and f(text.duration(F.lit(47))) == "47 sn" and f(text.duration(F.lit(0))) == "0 sn"
    assert f(text.truncated_path(F.lit("C:\\Veri\\Şirket\\Arşiv\\2024\\Muhasebe"), 24)) == "C:\\Veri\\…\\Muhasebe"
    assert [f(text.disk_level(F.lit(p))) for p in (84, 85, 94, 95)] == ["ok", "warning", "warning", "danger"]
    now = F.lit("2026-08-06 12:00:00").cast("timestamp_ntz")
    assert f(text.relative(F.lit("2026-08-06 11:48:00").cast("timestamp_ntz"), now)) == "12 dk önce"
    assert f(text.relative(F.lit("2026-08-07 11:48:00").cast("timestamp_ntz"), now)) == "az önce"
    assert f(text.error_title(F.lit("Access IS DENIED"))) == "Bir yol okunamadı" and f(text.error_title(F.lit("?"))) == text.OTHER_TITLE
    assert f(text.file_time(F.lit(116444736000000000))) == datetime(1970, 1, 1)


# --- schedules


def test_cron_text(spark):
    build = lambda days, a, b, i: one(spark, cron.build(F.array(*[F.lit(d) for d in days]), F.lit(a), F.lit(b), F.lit(i)))[0]
    week = [1, 2, 3, 4, 5]
    assert build(week, 8, 20, 2) == "0 8-20/2 * * 1,2,3,4,5" and build(range(7), 3, 3, 1) == "0 3 * * *" and build(week, 22, 22, 4) == "0 22 * * 1,2,3,4,5" and build(week, 9, 17, 1) == "0 9-17 * * 1,2,3,4,5"
    with pytest.raises(Exception, match="out of range"):
        build(week, 9, 8, 1)
    texts = [None, "", "0 3 * *", "30 3 * * *", "0 3 1 * *", "0 3 * 6 *", "0 8-20/2 * * MON-FRI", "0 20-8 * * *", "0 8/2 * * *", "0 8-24 * * *", "0 8-20 * * 7"]
    assert spark.createDataFrame([(t,) for t in texts], "c string").where(cron.parse_simple(F.col("c")).isNotNull()).count() == 0
    p = one(spark, cron.parse_simple(F.lit("0 3 * * *")).alias("p"))["p"]
    assert (p["start_hour"], p["end_hour"], p["interval_hours"], len(p["days"])) == (3, 3, 24, 7)
    words = {"0 3 * * *": "Her gün saat 03:00", "0 8-20/2 * * 1,2,3,4,5": "Hafta içi 08:00–20:00 arası 2 saatte bir", "0 9-17 * * 0,6": "Hafta sonu 09:00–17:00 arası saat başı", "0 4 * * 1,3": "Pzt, Çar saat 04:00", "*/5 * * * *": "*/5 * * * *", None: "—", "": "—"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in words], "c string").select("c", cron.describe(F.col("c"))).collect()}
    assert got == words


def test_next_slots(spark):
    now = datetime(2026, 8, 6, 12)
    want = {
        "30 3 * * *": datetime(2026, 8, 7, 3, 30), "0 2 * * SUN": datetime(2026, 8, 9, 2), "0 * * * *": datetime(2026, 8, 6, 13), "0 0 13 * FRI": datetime(2026, 11, 13), "59 23 31 12 *": datetime(2026, 12, 31, 23, 59),
        "0 0 29 2 *": datetime(2028, 2, 29), "0 0 29 2 1": datetime(2044, 2, 29), "0 0 30 2 *": None, "61 * * * *": None, "0 12 * * *": datetime(2026, 8, 7, 12), None: None,
    }
    rows = spark.createDataFrame([(c, now) for c in want] + [("0 3 * * *", None)], "cron string, at timestamp_ntz")
    got = cron.with_next(rows, "cron", "at").collect()
    assert {r["cron"]: r["next_slot"] for r in got if r["at"]} == want and [r["next_slot"] for r in got if r["at"] is None] == [None]


@settings(max_examples=60, deadline=None)
@given(st.datetimes(datetime(2023, 1, 1), datetime(2025, 1, 1)), st.sampled_from(["*/20 1-3 * * *", "5 4 1,15 * *", "0 0 * 3-5 MON", "7 7 7 * 2", "0 6 1-7 * 1"]))
def test_next_slot_is_the_first_minute_that_fits(after, text_):
    f = cron.fields(text_)
    t = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    while not (t.month in f["month"] and t.day in f["day"] and t.isoweekday() % 7 in f["weekday"]):
        t = (t + timedelta(days=1)).replace(hour=0, minute=0)
    while not (t.minute in f["minute"] and t.hour in f["hour"] and t.month in f["month"] and t.day in f["day"] and t.isoweekday() % 7 in f["weekday"]):
        t += timedelta(minutes=1) if t.day in f["day"] and t.month in f["month"] and t.isoweekday() % 7 in f["weekday"] else timedelta(days=1) - timedelta(hours=t.hour, minutes=t.minute)
    assert cron.next_occurrence(text_, after) == t


def test_overdue_counts_the_last_success_of_all_plans(spark):
    jobs = spark.createDataFrame([("a", "Succeeded", datetime(2026, 8, 5, 4)), ("a", "Failed", datetime(2026, 8, 6, 4)), ("b", "Succeeded", datetime(2026, 8, 6, 4)), ("c", "Failed", NOW), ("d", "Succeeded", NOW)], "repo string, status string, started_at timestamp_ntz")
    crons = spark.createDataFrame([("a", "0 3 * * *"), ("b", "0 3 * * *"), ("b", "0 2 * * SUN"), ("c", "0 2 * * SUN"), ("d", "0 0 30 2 *")], "repo string, cron string")
    assert {r["repo"] for r in report.overdue(jobs, crons, datetime(2026, 8, 6, 12)).collect()} == {"a", "c"}


def test_one_job_of_a_plan_is_let_in_over_many_batches(spark, tmp_path):
    from vaultframe.streaming import jobs as streams

    schema = "plan_id string, kind string, job_id long, event string, at timestamp_ntz"
    events = [("p", "backup", 1, "ask"), ("p", "backup", 2, "ask"), ("p", "verify", 3, "ask"), ("p", "backup", 1, "end"), ("p", "backup", 4, "ask"), ("q", "backup", 5, "end"), ("q", "backup", 6, "ask"), ("p", "backup", 7, "ask"), ("p", "verify", 3, "end"), ("p", "verify", 8, "ask")]
    for i in range(0, len(events), 2):  # days may lie between them
        rows = [(*e, datetime(2026, 1, 1) + timedelta(days=i + k)) for k, e in enumerate(events[i : i + 2])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = streams.feed(spark, str(tmp_path / "in"), schema, "*.parquet", 1)
    got = streams.drained(streams.once_queued(live), "admitted").collect()
    assert sorted(r["job_id"] for r in got) == [1, 3, 4, 6, 8]


def test_schedules_that_are_none(spark):
    for bad in ("not a cron expression", "* * * *", "61 * * * *"):
        with pytest.raises(ValueError):
            cron.fields(bad)


def test_a_stop_cancels_what_is_queued_or_runs(spark):
    at, now = datetime(2026, 1, 1), datetime(2026, 1, 2)
    rows = [(1, 1, "Pending", None, None, None), (2, 1, "Running", at, None, None), (3, 1, "Failed", at, at, "x"), (4, 9, "Pending", None, None, None), (5, None, "Running", at, None, None), (6, 1, None, None, None, None)]
    jobs = spark.createDataFrame(rows, "job_id long, plan_id long, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string")
    plans = spark.createDataFrame([(1,), (1,), (None,), (2,)], "plan_id long")
    got = {r[0]: tuple(r) for r in report.stopped(jobs, plans, now).collect()}
    assert got[1] == (1, 1, "Cancelled", now, now, text.STOPPED) and got[2] == (2, 1, "Cancelled", at, now, text.STOPPED)
    assert [got[i] for i in (3, 4, 5, 6)] == rows[2:] and len(got) == 6


def test_skipped_entries_are_counted_and_sampled(spark):
    rows = [(f"f{i:03d}", 4194304 if i % 4 == 0 else 32, "UnauthorizedAccessException" if i % 4 == 1 else None) for i in range(60)] + [("null", None, None)]
    read, left_out = skips.split(spark.createDataFrame(rows, "path string, attributes int, error string"))
    (one,) = skips.summary(left_out).collect()
    assert read.count() == 31 and one["entries_skipped"] == 30 and len(one["samples"]) == 20
    assert one["samples"][:2] == ["f000 (IOException)", "f001 (UnauthorizedAccessException)"]
    (none,) = skips.summary(left_out.where("false")).collect()
    assert (none["entries_skipped"], none["samples"]) == (0, [])


# --- whole runs


def test_backup_restore_and_verify(spark, tmp_path):
    from vaultframe.operators import repository
    from vaultframe.sources.catalog import Catalog

    r, sizes = random.Random(4), chunking.Sizes(64, 256, 1024, 10, 6)
    schema = "path string, name string, size long, mtime long, attributes int, content binary"
    made = lambda contents, day: spark.createDataFrame([(p, p, len(c), day, 0, bytearray(c)) for p, c in contents.items()], schema)
    contents = {f"f{i}": r.randbytes(6000) for i in range(4)} | {"empty": b"", "twin": b""}
    contents["twin"] = contents["f0"]
    none, unknown = spark.createDataFrame([], "path string, size long, mtime long, attributes int, seq long, blob_id string"), spark.createDataFrame([], "blob_id string")
    run = lambda files, parent, blobs, day, **how: repository.backup(files, parent, blobs, MASTER, datetime(2026, 1, day), sizes=sizes, target=8000, writers=2, **how)
    files = made(contents, 1)
    first = run(files, none, unknown, 1)
    counts = first["snapshot"].first()
    assert counts["new_files"] == 6 and counts["new_blobs"] == first["chunks"].select("blob_id").distinct().count() == first["blobs"].count() > 20
    assert first["packs"].count() > 2 and first["packs"].where("length(content) > 8000 + 1024 + 4000").count() == 0
    parent = written(first["chunks"].join(files.drop("content", "name"), "path"), "parent")
    again = run(files, parent, first["blobs"], 2)["snapshot"].first()
    assert (again["unchanged_files"], again["new_blobs"], again["new_bytes"]) == (5, 0, 0)  # an empty file has no chunk to know it by
    contents["f1"] = contents["f1"][:3000] + b"changed" + contents["f1"][3000:]
    second = run(made(contents, 1), parent, first["blobs"], 3)
    counts = second["snapshot"].first()
    assert counts["changed_files"] == 1 and 0 < counts["new_blobs"] < 12
    blobs, packs = first["blobs"].unionByName(second["blobs"]), written(first["packs"].unionByName(second["packs"]), "all")
    writes = repository.restored(second["chunks"].withColumnRenamed("path", "file"), blobs, packs, MASTER)
    got = {x["file"]: bytearray(x["bytes"]) for x in repository.file_digests(writes).collect()}
    for w in writes.collect():
        got[w["file"]][w["file_offset"] : w["file_offset"] + len(w["payload"])] = w["payload"]
    assert {p: bytes(c) for p, c in got.items()} == {p: c for p, c in contents.items() if c}
    with pytest.raises(Exception, match="can't be read"):
        repository.restored(second["chunks"].withColumnRenamed("path", "file"), blobs, packs.limit(1), MASTER).collect()
    with pytest.raises(repository.AnomalyError):
        run(made({f"g{i}.locked": b"x" for i in range(3)}, 2), parent, first["blobs"], 4, policy=diff.AnomalyPolicy())
    index = packs.select("pack_id", F.sha2("content", 256).alias("sha256"))
    roots = spark.createDataFrame([("s", first["blobs"].first()["blob_id"])], "snapshot_id string, root string")
    assert repository.verify("Full", blobs, index, roots, packs, MASTER).count() == 0
    bad = packs.withColumn("content", F.expr("concat(substring(content, 1, 20), X'00ff', substring(content, 23, length(content)))"))
    issues = lambda level, stored: {x["issue"] for x in repository.verify(level, blobs, index, roots, stored, MASTER).collect()}
    assert issues("Index", bad) == set() and issues("Packs", bad) == {"pack-hash-differs"} and issues("Full", bad) == {"pack-hash-differs", "blob-unreadable"}
    assert issues("Index", bad.limit(0)) == {"pack-missing"}
    catalog = Catalog(spark, str(tmp_path / "repo"))
    snapshot = spark.createDataFrame([("s1", datetime(2026, 1, 1))], "snapshot_id string, started_at timestamp_ntz")
    nulls = lambda df, table: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in CATALOG[table]])
    repository.committed(catalog, first, nulls(snapshot, "snapshots"), spark.createDataFrame([(1, "s1", "C:\\Data")], CATALOG["snapshot_paths"]), datetime(2026, 1, 1))
    assert (catalog.read("blobs").count(), catalog.read("packs").count(), catalog.read("snapshots").count()) == (first["blobs"].count(), first["packs"].count(), 1)
