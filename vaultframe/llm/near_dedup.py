"""MinHash near-duplicates by a multi-index Hamming join.

A signature has 5 * m symbols of 16 bits. Two sets with similarity s differ in each symbol
with probability 1 - s. Symbols are split into m chunks of 5. By the pigeonhole principle,
two signatures that differ in at most 2m - 1 symbols differ in at most one symbol of some
chunk, so a key is made of every chunk with each of its symbols left out in turn, and the
pair shares one: every pair within 2m - 1 errors is a candidate, none is missed. With
m = 14, a pair at similarity 0.8 exceeds 27 of 70 errors with probability 1e-4, and a
pair at 0.85 with less than 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near
from .common import TEXT_ROWS, as_bytes, releasing, slices, table, written
from .shingles import Signer, mixed, set_digest, shingle_set

CHUNKS, CHUNK = 14, 5
MAX_ERRORS = 2 * CHUNKS - 1


def signed(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, signature`` for each row of ``docs`` (doc_id, text)."""
    sign = Signer(CHUNKS * CHUNK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, d1, d2, signatures = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text or b"", width)
                a, b = set_digest(s)
                sizes.append(len(s))
                d1.append(a)
                d2.append(b)
                signatures.append(sign(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "signature"])

    return docs.select(F.col("doc_id").cast("long"), as_bytes()).mapInArrow(releasing(run), "doc_id long, n_shingles long, d1 long, d2 long, signature binary")


def chunk_keys(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CHUNKS * CHUNK keys for each row of symbols: a chunk without one of its symbols.

    The mark is the symbol left out: with equal ones the whole chunk is equal, so the
    chunk's first key is shared too. The first key's mark is -1.
    """
    x = signatures.reshape(len(signatures), CHUNKS, CHUNK).astype(np.uint64)
    out = np.empty((len(x), CHUNKS, CHUNK), np.uint64)
    kind = np.arange(CHUNKS, dtype=np.uint64) * np.uint64(CHUNK)
    for gap in range(CHUNK):
        key = np.zeros((len(x), CHUNKS), np.uint64)
        for j in range(CHUNK):
            if j != gap:
                key = key << np.uint64(16) | x[:, :, j]
        out[:, :, gap] = mixed(key + mixed(kind + np.uint64(gap + 1)))
    marks = x.astype(np.int32)
    marks[:, :, 0] = -1
    return out.reshape(len(x), -1).view(np.int64), marks.reshape(len(x), -1)


def set_table(docs: DataFrame, width: int, ids: DataFrame) -> DataFrame:
    """(id, set) of the documents in ``ids``, from their whole texts again."""
    wanted = docs.select(F.col("doc_id").cast("long").alias("id"), as_bytes().alias("text")).join(near.bounded(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t or b"", width).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    return wanted.mapInArrow(releasing(run), "id long, set binary")


def components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Documents link if 100 * intersection >= percent * union of their distinct shingles of
    ``width`` words. Equal sets are one item, so copies cost nothing beyond the first pass.
    ``component_id`` is the least doc_id reachable; ``kept`` marks it.

    Null or empty texts have no shingles and link with nothing. A row without doc_id links
    with nothing, has no component and is kept. Rows that repeat an id and text share their
    result; rows with one id and several texts are expected not to occur: each text is
    judged, and all are kept or not by the id. An empty table gives an empty table.
    """
    rows = written(signed(docs, width), "signed", TEXT_ROWS)
    items = rows.where("doc_id is not null and n_shingles > 0")
    classes = written(items.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.min("n_shingles").alias("n"), F.first("signature").alias("signature")), "classes")
    # a smaller set differs from any other by more than the threshold
    least = -(-percent // (100 - percent)) if percent < 100 else 2**62
    able = classes.where(F.col("n") >= least).select("id", "signature")
    labels = near.groups(able, chunk_keys, MAX_ERRORS, lambda ids: set_table(docs, width, ids).dropDuplicates(["id"]), percent)
    of = classes.select("d1", "d2", "id").join(labels, "id", "left").select("d1", "d2", F.coalesce("label", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(of, ["d1", "d2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def filtered(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group, with the columns of ``docs``; rows that repeat it go too."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names).withColumn("text", F.col(names[docs.columns.index("text")])).withColumn("doc_id", F.col(names[docs.columns.index("doc_id")]).cast("long"))
    found = components(plain, width, percent)
    gone = found.where(~F.col("kept")).select("doc_id").distinct()
    rest = plain.join(gone, "doc_id", "left_anti")
    again = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    again = written(again, "again")
    if again.limit(1).count():  # repeated rows are rare, so only theirs are brought together
        twice = rest.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        rest = rest.join(again, "doc_id", "left_anti").unionByName(twice)
    return rest.select(*names).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: two-word shingles at 0.8 over all documents."""
    return components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2, percent=80)


ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as sh from w),
e as materialized (select doc_id, len(sh) as n, unnest(sh) as g from s),
c as materialized (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
  group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (min(a.n) + min(b.n) - count(*))),
u as (select x, y from c union select y, x from c),
r as (select doc_id as x, doc_id as y from s union select r.x, u.y from r join u on r.y = u.x)
select s.doc_id, cast(len(s.sh) as bigint) as n_shingles, min(r.y) as component_id, s.doc_id = min(r.y) as kept
from s join r on r.x = s.doc_id group by s.doc_id, len(s.sh)
"""
