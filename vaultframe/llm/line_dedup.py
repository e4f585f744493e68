"""Line deduplication by a range partition with a secondary sort.

Each (document, line key) becomes one row (128-bit key hash, document, line numbers).
Rows are range-partitioned by (hash, document) and sorted by (hash, document descending),
so a run of equal hashes streams past with the document that keeps the line first. The
range bounds are drawn over the pair, so one very common line spreads over many
partitions; a run cut by a partition's edge leaves its rows pending and a one-row summary,
and the summaries, two for each partition at most, settle them. Text never enters this
exchange: what comes back is a compressed keep bitmap for each document that loses lines.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACES, as_bytes, releasing, table, written

LINES = "k1 long, k2 long, doc long, version long, at binary"
FOUND = "kind byte, k1 long, k2 long, doc long, version long, at binary, n_docs long"
DROP, PENDING, SUMMARY = 0, 1, 2
#: Documents without an id count as one document with the smallest id.
NO_ID = -(2**63)


def line_key(line: bytes, least_chars: int) -> bytes | None:
    """The line stripped of SPACES and with A-Z in lower case; None below ``least_chars``."""
    bare = line.strip(SPACES)
    if len(bare) < least_chars or len(bare) < 4 * least_chars and len(bare.decode("utf-8", "replace")) < least_chars:
        return None
    return bare.translate(LOWER)


def version(text: bytes) -> int:
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh3_64_intdigest(text)))[0]


def exploded(docs: DataFrame, least_chars: int) -> DataFrame:
    """A row for each document version and line key, with the line numbers that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, ids, versions, at = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = text or b""
                if len(text) < least_chars:
                    continue
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate(text.split(b"\n")):
                    if (key := line_key(line, least_chars)) is not None:
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append(i)
                v = version(text)
                for h, lines in found.items():
                    a, b = struct.unpack("<qq", h)
                    k1.append(a)
                    k2.append(b)
                    ids.append(NO_ID if doc is None else doc)
                    versions.append(v)
                    at.append(np.array(lines, "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((k1, pa.int64()), (k2, pa.int64()), (ids, pa.int64()), (versions, pa.int64()), (at, pa.binary()))], names=["k1", "k2", "doc", "version", "at"])

    return docs.mapInArrow(releasing(run), LINES)


def _stream(least_docs: int):
    """Reads sorted rows; gives DROP rows for whole runs, PENDING and SUMMARY ones at the edges.

    Only numpy columns of one batch and the rows of one open run below ``least_docs``
    documents are held: once a run is known to be long enough, its rows go straight out.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, part: pa.Table | pa.RecordBatch, n_docs: int = 0) -> pa.RecordBatch:
            n = part.num_rows
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int8)), *[part.column(i).combine_chunks() if isinstance(part.column(i), pa.ChunkedArray) else part.column(i) for i in range(5)], pa.array(np.full(n, n_docs, np.int64))], names=[x.split()[0] for x in FOUND.split(", ")])

        first = True  # the run that may have begun in an earlier partition
        key, docs, top, last, held = None, 0, None, None, []

        def put(part: pa.RecordBatch, doc: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The next rows of the open run."""
            nonlocal docs, top, last, held
            fresh = int((doc[1:] != doc[:-1]).sum()) + (last is None or int(doc[0]) != last)
            top, last, docs = int(doc[0]) if top is None else top, int(doc[-1]), docs + fresh
            if first:
                yield rows(PENDING, part)
                return
            held.append((part, doc))
            if docs >= least_docs:
                for p, d in held:
                    lose = d != top
                    if lose.any():
                        yield rows(DROP, p.filter(pa.array(lose)))
                held = []

        def close(at_edge: bool) -> Iterator[pa.RecordBatch]:
            """Ends the open run. Rows of a run at the end of the partition that was long
            enough are decided already; the others wait for what the next partition has."""
            nonlocal key, docs, top, last, held, first
            if key is not None and (first or at_edge):
                for p, _ in held:
                    yield rows(PENDING, p)
                one = pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((key[0], pa.int64()), (key[1], pa.int64()), (top, pa.int64()), (0, pa.int64()), (b"", pa.binary()))], names=["k1", "k2", "doc", "version", "at"])
                yield rows(SUMMARY, one, docs)
            key, docs, top, last, held = None, 0, None, None, []

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, doc = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            lengths = np.diff(edges)
            whole = np.flatnonzero(lengths >= least_docs)  # runs within the batch that can matter
            firsts = {0, len(lengths) - 1, *whole.tolist()}
            for i in sorted(firsts):
                lo, hi = edges[i], edges[i + 1]
                k = (int(a[lo]), int(b[lo]))
                if k != key:
                    had = key is not None
                    yield from close(False)
                    first = first and not had and i == 0
                    key = k
                yield from put(batch.slice(lo, hi - lo), doc[lo:hi])
        yield from close(True)

    return run


def keep_bitmaps(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``doc, version, n_dropped, drop_bitmap`` for the documents that lose lines.

    ``docs``: columns doc_id and text (others are ignored). A key of at least
    ``least_chars`` code points found in ``least_docs`` documents or more loses all its
    lines but those in the largest doc_id that has it. ``drop_bitmap`` is zlib over a
    little-endian bitmap whose bit i is set if line i goes.

    Rows that share a doc_id are parts of one document: they count once and keep their
    lines together. ``version`` is a hash of the text, so that each row's own lines are
    meant; repeated rows share their bitmap. A null doc_id is below all others. Null or
    empty texts have one empty line, which has no key. An empty table gives no rows.
    """
    rows = exploded(docs.select(F.col("doc_id").cast("long"), as_bytes()), least_chars)
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "k1", "k2", F.col("doc").desc()).sortWithinPartitions("k1", "k2", F.col("doc").desc())
    found = written(dealt.mapInArrow(releasing(_stream(least_docs)), FOUND), "lines")
    settled = found.where(F.col("kind") == SUMMARY).groupBy("k1", "k2").agg(F.sum("n_docs").alias("n"), F.max("doc").alias("top")).where(F.col("n") >= least_docs)
    late = found.where(F.col("kind") == PENDING).join(settled, ["k1", "k2"]).where(F.col("doc") != F.col("top"))
    gone = found.where(F.col("kind") == DROP).select("doc", "version", "at").unionByName(late.select("doc", "version", "at"))
    return _bitmaps(gone)


def _bitmaps(gone: DataFrame) -> DataFrame:
    """One row for each document version: the union of its dropped line numbers."""
    each = gone.groupBy("doc", "version").agg(F.collect_set("at").alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps, counts = [], []
            for parts in batch.column(2).to_pylist():
                lines = np.unique(np.concatenate([np.frombuffer(p, "<u4") for p in parts]))
                bits = np.zeros(int(lines[-1]) + 1, np.uint8)
                bits[lines] = 1
                maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
                counts.append(len(lines))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(maps, pa.binary())], names=["doc", "version", "n_dropped", "drop_bitmap"])

    return each.mapInArrow(releasing(run), "doc long, version long, n_dropped long, drop_bitmap binary")


def kept_lines(text: bytes, drop_bitmap: bytes | None) -> tuple[bytes, int, int]:
    """The text without its dropped lines, the number of lines and of dropped ones."""
    lines = text.split(b"\n")
    if drop_bitmap is None:
        return text, len(lines), 0
    bits = np.unpackbits(np.frombuffer(zlib.decompress(drop_bitmap), np.uint8), bitorder="little")
    gone = set(np.flatnonzero(bits).tolist())
    return b"\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)


def _joined(docs: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """``docs`` with its bitmap; the text hash is taken as the texts pass through Python."""
    from pyspark.sql import types as T

    from .common import with_batches

    hashed = with_batches(docs, "text", lambda texts: [pa.array([version(t or b"") for t in texts], pa.int64())], [T.StructField("_version", T.LongType())])
    gone = keep_bitmaps(docs, least_chars, least_docs).withColumnsRenamed({"doc": "_doc", "version": "_v"})
    on = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("_doc")) & (F.col("_version") == F.col("_v"))
    return hashed.join(gone, on, "left")


def digests(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """For each row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256."""
    joined = _joined(docs.select("doc_id", "text"), least_chars, least_docs).select("doc_id", as_bytes(), "drop_bitmap")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [kept_lines(t or b"", m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([k[1] for k in kept], pa.int64()), pa.array([k[2] for k in kept], pa.int64()), pa.array([hashlib.sha256(k[0]).hexdigest() for k in kept], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(releasing(run), f"doc_id {id_type}, n_lines long, n_dropped long, kept_sha256 string")


def filtered(docs: DataFrame, least_chars: int = 20, least_docs: int = 3) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text`` and ``n_chars``, where it exists, anew.

    No document goes; one that loses every line has an empty text. A null text stays null.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text, doc = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    plain = docs.toDF(*names).withColumnsRenamed({text: "text", doc: "doc_id"})
    own = {text: "text", doc: "doc_id"}
    joined = _joined(plain, least_chars, least_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = batch.column(1).to_pylist()
            texts = [None if t is None else (t if m is None else kept_lines(t, m)[0]).decode("utf-8", "replace") for t, m in zip(batch.column(0).to_pylist(), maps, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*others, text])

    others = [n for n in names if n != text]
    schema = ", ".join(f"`{n}` {plain.schema[own.get(n, n)].dataType.simpleString()}" for n in others) + f", `{text}` string"
    out = joined.select(as_bytes(), "drop_bitmap", *[F.col(own.get(n, n)) for n in others]).mapInArrow(releasing(run), schema).select(*names)
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        out = out.withColumn(n, F.when(F.col(text).isNotNull(), F.char_length(text)).cast(docs.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    return digests(table(spark, sf_dir, "documents"))


ORACLE = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, unnest(range(1, len(lines) + 1)) as i from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
hot as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.line, k.i, hot.top is not null and hot.top <> k.doc_id as gone from k left join hot on k.key = hot.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256
from m group by doc_id
"""
