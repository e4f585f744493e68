"""Links between similar items, and the groups that links form, at any group size.

An item is a distinct shingle set with a bigint id; equal sets are one item before this
begins. Items that share a key form a bucket. No bucket is gathered or paired off. First
a few members lead: all others are held against them, which resolves a group of near
copies however large. In buckets whose members are then still in several components, the
members outside the largest one are held against all others of other components, in blocks
of signatures that give out close pairs only. Every pair that shares a key is so compared,
or connected already.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .shingles import overlap

#: Keys (bigint) and marks (int) of rows of symbols, in order of the keys.
Keys = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
#: As many ids, at 8 bytes each, may be broadcast; above that, a shuffle join is used.
MAX_BROADCAST_IDS = 1_000_000
#: Members of a bucket that are compared with all others: its least and greatest id, and the
#: least by hashes. Buckets of one group share them, so they make few distinct pairs.
LEADERS = 4
#: Sizes of the blocks in which signatures are compared.
LEADERS_A_BLOCK, MEMBERS_A_BLOCK = 256, 4096
#: Rows of an Arrow batch where each holds a document's whole set.
LARGE_ROWS = 500
#: Links that a task joins at a time before labels spread.
LINKS_AT_ONCE = 200_000
#: Pairs that one leader's set serves in one task.
PAIRS_A_SALT = 500
#: Codes of a key: marks are below 2 ** 16, and -1.
MARKS = 1 << 17


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as links of each node to the least that it reaches by LINKS_AT_ONCE of
    them. What the links connect stays connected, over far fewer steps."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    def joined() -> pa.RecordBatch:
        nodes = list(root)
        return pa.RecordBatch.from_arrays([pa.array([find(x) for x in nodes], pa.int64()), pa.array(nodes, pa.int64())], names=["a", "b"])

    n = 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
        n += batch.num_rows
        if n >= LINKS_AT_ONCE:
            yield joined()
            n = 0
            root.clear()
    yield joined()


def components(links: DataFrame) -> DataFrame:
    """``id, label`` for every node of ``links`` (a, b): the least id that it reaches.

    Links are joined within tasks first. Then least labels spread along what is left and
    jump to their label's label until none changes.
    """
    links = links.select("a", "b").repartition("a").mapInArrow(_stars, "a long, b long").where("a <> b")
    edges = written(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("src", "dst"), "edges")
    labels = written(edges.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("label")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now is None or now == total:
            discard(edges)
            return labels
        total = now
        near = edges.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("m"))
        spread = labels.join(near, F.col("id") == F.col("src")).select("id", F.least("label", "m").alias("label"))
        spread = written(spread, "labels")
        far = spread.select(F.col("id").alias("root"), F.col("label").alias("far"))
        jumped = written(spread.join(far, F.col("label") == F.col("root"), "left").select("id", F.coalesce("far", "label").alias("label")), "labels")
        discard(labels)
        discard(spread)
        labels = jumped


def _salted(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) and ``salt``: a leader with many pairs has a salt for each PAIRS_A_SALT.

    Only such leaders are counted out and joined; they are few and counted before they are
    broadcast, so no join deals all pairs of one leader to one task.
    """
    heavy = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRS_A_SALT)
    heavy = bounded(written(heavy, "heavy"))
    return pairs.join(heavy, "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.expr(f"coalesce(n, 0) div {PAIRS_A_SALT} + 1"))).select("a", "b", "salt")


def _streamed(pairs: DataFrame, values: DataFrame, test: Callable[[memoryview, list[memoryview]], np.ndarray]) -> DataFrame:
    """The rows of ``pairs`` (a, b, salt) whose ``values`` (id, value) pass ``test``.

    The value of a leader ``a`` goes once to each of its salts, that of a member ``b`` once
    to each of its pairs; a task streams the members past the leader.
    """
    heads = pairs.select("a", "salt").distinct().join(values, F.col("a") == F.col("id")).select("a", "salt", F.lit(None).cast("long").alias("b"), "value")
    members = pairs.join(values, F.col("b") == F.col("id")).select("a", "salt", "b", "value")
    dealt = heads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = b""
        for batch in batches:
            heads = np.flatnonzero(batch.column(2).is_null().to_numpy(zero_copy_only=False))
            raw, good = [memoryview(x.as_buffer()) for x in batch.column(3)], np.zeros(batch.num_rows, bool)
            edges = [-1, *heads.tolist(), batch.num_rows]
            for at, end in zip(edges, edges[1:], strict=False):
                if at >= 0:
                    own = bytes(raw[at])
                if end - at > 1:
                    good[at + 1 : end] = test(own, raw[at + 1 : end])
            yield batch.select(["a", "b", "salt"]).filter(pa.array(good))

    return dealt.mapInArrow(run, "a long, b long, salt long")


def _close(pairs: DataFrame, signatures: DataFrame, max_errors: int) -> DataFrame:
    """The pairs whose signatures differ in ``max_errors`` symbols or fewer."""
    def test(own: memoryview, others: list[memoryview]) -> np.ndarray:
        x = np.frombuffer(own, np.uint16)
        return (np.frombuffer(b"".join(others), np.uint16).reshape(len(others), -1) != x).sum(1) <= max_errors

    return _streamed(pairs, signatures.select("id", F.col("signature").alias("value")), test)


def _confirmed(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = written(sets_of(ids), "sets", LARGE_ROWS)

    def test(own: memoryview, others: list[memoryview]) -> np.ndarray:
        x = np.frombuffer(own, np.uint64)
        return np.array([alike(x, np.frombuffer(o, np.uint64), percent) for o in others], bool)

    return _streamed(pairs, sets.withColumnRenamed("set", "value"), test).drop("salt")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = overlap(x, y)
    return 100 * common >= percent * (len(x) + len(y) - common)


def bounded(ids: DataFrame) -> DataFrame:
    """``ids`` with a broadcast hint if they are counted to be few enough."""
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def _blocks(rows: DataFrame, signatures: DataFrame, max_errors: int, keys_of: Keys) -> DataFrame:
    """Tiles of close pairs of rows (key, id, label) that share a key and not a label.

    All members of a key but those of its most frequent label lead; at least one of any
    such pair does. Leaders and members are dealt into blocks of bounded size, so a key of
    any size is spread over tasks; a task holds one block of leaders. A pair counts only
    under the first of the keys that it shares, so no pair is looked at twice.

    Gives (key, i, j, member, number, id, label, bits): the leaders of each tile that are
    close to a member, and those members, whose ``bits`` tell to which by their ``number``.
    """
    counts = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("labels"))
    several = counts.where("labels > 1").select("key", F.col("top.label").alias("top"), F.expr(f"cast((n - top.c) div {LEADERS_A_BLOCK} + 1 as int)").alias("leads"), F.expr(f"cast(n div {MEMBERS_A_BLOCK} + 1 as int)").alias("members"))
    places = F.expr("""concat(
        if(label <> top, transform(sequence(0, members - 1), x -> struct(key, cast(pmod(xxhash64(id), leads) as int) as i, x as j, 0Y as member, true as leads)), array()),
        transform(sequence(0, leads - 1), x -> struct(key, x as i, cast(pmod(xxhash64(id), members) as int) as j, 1Y as member, label <> top as leads)))""")
    # a member's places are brought together first, so its signature is joined once
    own = rows.join(several, "key").select("id", "label", places.alias("places")).groupBy("id").agg(F.first("label").alias("label"), F.flatten(F.collect_list("places")).alias("places"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.join(signatures, "id").select("id", "label", "signature", F.inline("places")).select("key", "i", "j", "member", "id", "label", "leads", "signature")
    dealt = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "member", "id")
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["key", "i", "j", "member", "number", "id", "label", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        block, told = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            key, i, j, member, ids, labels = (batch.column(c).to_numpy() for c in range(6))
            leading = batch.column(6).to_numpy(zero_copy_only=False)
            signs = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (member[1:] != member[:-1])) + 1).tolist(), len(key)]
            out: list[tuple] = []
            for lo, hi in zip(edges, edges[1:], strict=False):
                here = (int(key[lo]), int(i[lo]), int(j[lo]))
                if not member[lo]:
                    part = [ids[lo:hi], labels[lo:hi], signs[lo:hi]]
                    held = [np.concatenate([x, y]) for x, y in zip(held, part, strict=True)] if here == block else part
                    block, told = here, set()
                elif here == block:
                    for at in range(lo, hi, 256):
                        end = min(at + 256, hi)
                        errors = np.zeros((len(held[0]), end - at), np.int16)
                        for column in range(signs.shape[1]):
                            errors += held[2][:, column, None] != signs[at:end, column]
                        # of two that both lead, the lesser id leads
                        once = (held[0][:, None] < ids[at:end]) | ~leading[at:end]
                        x, y = np.nonzero((errors <= max_errors) & (held[1][:, None] != labels[at:end]) & once)
                        if not len(x):
                            continue
                        own, other = keys_of(held[2][np.unique(x)])[0], keys_of(signs[at:end][np.unique(y)])[0]
                        same = own[np.searchsorted(np.unique(x), x)] == other[np.searchsorted(np.unique(y), y)]
                        first = own[np.searchsorted(np.unique(x), x), same.argmax(1)] == here[0]
                        x, y = x[first], y[first]
                        fresh = set(x.tolist()) - told
                        told |= fresh
                        out += [(*here, 0, k, int(held[0][k]), int(held[1][k]), b"") for k in sorted(fresh)]
                        for m in np.unique(y).tolist():
                            bits = np.zeros(len(held[0]), np.uint8)
                            bits[x[y == m]] = 1
                            out.append((*here, 1, -1, int(ids[at + m]), int(labels[at + m]), np.packbits(bits).tobytes()))
            cols = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return dealt.mapInArrow(run, "key long, i int, j int, member byte, number int, id long, label long, bits binary")


def _tile_links(tiles: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Links (a, b) among the close pairs of ``tiles``, as many as join what they join.

    Within a tile, pairs that labels or earlier links connect already aren't looked at, so
    a tile gives fewer links than it has rows.
    """
    ids = written(tiles.select("id").distinct(), "ids")
    sets = written(sets_of(ids), "sets", LARGE_ROWS)
    n = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = tiles.groupBy("id").agg(F.first("label").alias("label"), F.collect_list(F.struct("key", "i", "j", "member", "number", "bits")).alias("places"))
    dealt = own.join(sets, "id").select("id", "label", "set", F.inline("places")).select("key", "i", "j", "member", "number", "id", "label", "bits", "set")
    dealt = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "member", "number", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leaders, root = None, [], {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            found: list[tuple[int, int]] = []
            cols = [batch.column(c).to_pylist() for c in range(8)]
            for key, i, j, member, number, id_, label, bits, raw in zip(*cols, batch.column(8), strict=True):
                if (key, i, j) != block:
                    block, leaders, root = (key, i, j), {}, {}
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                if not member:
                    leaders[number] = (id_, label, own.copy())
                    continue
                for k in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8))).tolist():
                    other, other_label, theirs = leaders[k]
                    x, y = find(label), find(other_label)
                    if x == y:
                        continue
                    if alike(theirs, own, percent):
                        root[max(x, y)] = min(x, y)
                        found.append((min(id_, other), max(id_, other)))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in range(2)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def keyed(signatures: DataFrame, keys_of: Keys) -> DataFrame:
    """(key, id, code): a row for each key of each (id, signature). The code is the key's
    place in the row of keys, by MARKS, and its mark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(ids), -1)
            for at in range(0, len(ids), 1024):
                keys, marks = keys_of(raw[at : at + 1024])
                codes = np.arange(keys.shape[1], dtype=np.int32) * MARKS + marks + 1
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids[at : at + 1024], keys.shape[1])), pa.array(codes.ravel())], names=["key", "id", "code"])

    return signatures.mapInArrow(run, "key long, id long, code int")


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key those whose key comes twice or more. Rows at either end of
    the partition may have their like in the next one and stay."""
    tail: pa.RecordBatch | None = None  # the open run while it has one row
    open_key = None  # of the run that the last batch ended in, if it has more
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        if tail is not None:
            batch = pa.concat_batches([tail, batch])
        key = batch.column(0).to_numpy()
        begin = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        lengths = np.diff(np.append(begin, len(key)))
        keep = lengths > 1
        keep[0] |= first or key[0] == open_key
        last_open = not keep[-1]
        tail = batch.slice(int(begin[-1])) if last_open else None
        open_key = None if last_open else int(key[-1])
        first = False
        yield batch.filter(pa.array(np.repeat(keep, lengths)))
    if tail is not None:
        yield tail


def _buckets(signatures: DataFrame, keys_of: Keys) -> DataFrame:
    """(key, id, n, l0, l1, ..): the members of each key that has several, and that could
    bring a new pair, with its leaders. Of keys with the same members, which similar items
    have dozens of, the first by place stands for all: it is the first key that any pair of
    them shares.

    Most keys have one member. Rows are range-partitioned by key and id, so a key that very
    many have spreads over tasks, and single ones go as the sorted rows stream past.
    """
    keys = written(keyed(signatures, keys_of), "keys", codec="lz4_raw")
    rows = written(keys.repartitionByRange("key", "id").sortWithinPartitions("key").mapInArrow(_several, "key long, id long, code int"), "several")
    discard(keys)
    x = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in range(2)]
    leaders = [F.min("id").alias("l0"), F.max("id").alias("l1"), *[F.min_by("id", F.xxhash64("id", F.lit(i))).alias(f"l{i}") for i in range(2, LEADERS)]][:LEADERS]
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("code").alias("c0"), F.max("code").alias("c1"), *x, *leaders).where(f"n > 1 and (c0 % {MARKS} = 0 or c0 <> c1)")
    own = ["n", *[f"l{i}" for i in range(LEADERS)]]  # the same for the same members
    one = sizes.groupBy("x0", "x1", *own).agg(F.min_by("key", "c0").alias("key")).select("key", *own)
    out = written(rows.drop("code").join(written(one, "one"), "key"), "buckets")
    discard(rows)
    return out


def groups(signatures: DataFrame, keys_of: Keys, max_errors: int, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``id, label`` for all items that link to another; label is the least id of the group.

    ``signatures``: (id, signature of 16-bit symbols); ``keys_of`` gives the keys, a row of
    bigints, of each row of symbols, and a mark for each: two items with equal marks under
    one key share an earlier key too, unless the mark is -1. A key whose marks are all equal
    is left out, as it brings no new pair. ``sets_of`` gives (id, set) for a table of ids; a set
    is its sorted 64-bit hashes as bytes. Two items link if they share a key, their
    signatures differ in ``max_errors`` symbols at most, and 100 * intersection >=
    ``percent`` * union.
    """
    buckets = _buckets(signatures, keys_of)
    pairs, leading = None, F.lit(False)
    for i in range(LEADERS):
        own = F.col(f"l{i}")
        led = buckets.where(F.col("id") != own).select(own.alias("a"), F.col("id").alias("b"))
        pairs, leading = led if pairs is None else pairs.union(led), leading | (F.col("id") == own)
    pairs = written(pairs.distinct(), "pairs")
    links = written(_confirmed(written(_close(_salted(pairs), signatures, max_errors), "close"), sets_of, percent), "links", LARGE_ROWS)
    labels = components(links)
    rest = buckets.where(~leading & (F.col("n") > 2)).select("key", "id").join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    tiles = written(_blocks(written(rest, "rest"), signatures, max_errors, keys_of), "tiles")
    if not tiles.limit(1).count():
        return labels
    return components(links.union(written(_tile_links(tiles, sets_of, percent), "links", LARGE_ROWS)))
