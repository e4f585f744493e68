"""Packs: rotation, offsets, the binary layout, compression."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vaultframe.functions.crypto import hkdf, hkdf_by, nonce, sub_key

SALT_BYTES, TARGET_BYTES, TAG_BYTES = 16, 32 * 1024 * 1024, 16
RAW, ZSTD = 0, 1
#: Compression is kept if it saves more than this share.
KEPT_SHARE = 0.97
HEADER_NONCE = "00000000" + "f" * 16
_ENTRY = struct.Struct("<B32sQIIB")


def rotation(rows: DataFrame, writer: str, seq: str, size: str, target: int) -> DataFrame:
    """``writer, seq, pack_no``: packs close once their length reaches ``target``.

    A pack takes its last blob whole, so the bounds are no function of the running sum; each
    writer's ordered sizes are folded in one pass. A writer is one task's output, so its
    blobs are bounded by design; writers run in parallel.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(size).cast("bigint").alias("size"))))
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                no = used = 0
                for x in items:
                    out.append((w, x["seq"], no))
                    used += x["size"]
                    if used >= target:
                        no, used = no + 1, 0
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.int64()))], names=["writer", "seq", "pack_no"])

    kind = rows.schema[writer].dataType.simpleString()
    return rows.groupBy(F.col(writer).alias("writer")).agg(ordered.alias("items")).mapInArrow(run, f"writer {kind}, seq bigint, pack_no bigint")


def with_offsets(blobs: DataFrame, order: str = "blob_id") -> DataFrame:
    """Adds the blob's place in its pack: ``ordinal`` (and nonce) and ``offset``."""
    w = W.partitionBy("pack_id").orderBy(order)
    before = F.sum("len_stored").over(w.rowsBetween(W.unboundedPreceding, -1))
    return blobs.withColumn("ordinal", F.row_number().over(w) - 1).withColumn("offset", F.lit(SALT_BYTES) + F.coalesce(before, F.lit(0)))


def keeps_compression(compressed: Column, plain: Column) -> Column:
    return (plain > 0) & (compressed < KEPT_SHARE * plain)


def compressed(rows: DataFrame, content: str, level: int = 3) -> DataFrame:
    """``rows`` with ``stored`` and ``codec``; zstd where it saves enough, else as it is."""
    names = [*rows.columns, "stored", "codec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            stored, codec = [], []
            for plain in batch.column(names.index(content)).to_pylist():
                small = z.compress(plain) if plain else plain
                good = bool(plain) and len(small) < KEPT_SHARE * len(plain)
                stored.append(small if good else plain)
                codec.append(ZSTD if good else RAW)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stored, pa.binary()), pa.array(codec, pa.int8())], names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{ddl}, stored binary, codec byte")


def decompressed(stored: bytes, codec: int, length: int) -> bytes:
    """ValueError if the codec is unknown or the length isn't the recorded one."""
    import zstandard

    if codec not in (RAW, ZSTD):
        raise ValueError(f"codec {codec}")
    plain = zstandard.ZstdDecompressor().decompress(stored, max_output_size=max(length, 1)) if codec == ZSTD else stored
    if len(plain) != length:
        raise ValueError("length differs")
    return plain


def encode_header(entries: Sequence[tuple[int, bytes, int, int, int, int]]) -> bytes:
    """Kind, id, offset, stored and plain length, codec of each blob, after their number."""
    return struct.pack("<I", len(entries)) + b"".join(_ENTRY.pack(*e) for e in entries)


def decode_header(raw: bytes) -> list[tuple[int, bytes, int, int, int, int]]:
    (n,) = struct.unpack_from("<I", raw)
    if len(raw) != 4 + n * _ENTRY.size:
        raise ValueError("header length differs")
    return [_ENTRY.unpack_from(raw, 4 + i * _ENTRY.size) for i in range(n)]


def pack_key(master: bytes, salt: bytes) -> bytes:
    """Each pack has a key of its own, so a blob's number serves as its nonce."""
    return hkdf(sub_key(master, "pack-key-v1"), b"pack", 32, salt)


def _little_endian(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)]))


def _keyed(rows: DataFrame, master: bytes) -> DataFrame:
    """(pack_id, salt) with the pack's key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([pack_key(master, x) for x in batch.column(1).to_pylist()], pa.binary())], names=["pack_id", "salt", "pack_key"])

    return rows.mapInArrow(run, "pack_id string, salt binary, pack_key binary")


def encoded(blobs: DataFrame, master: bytes) -> DataFrame:
    """``pack_id, content``: a sealed file for each pack of (pack_id, kind, blob_id hex,
    payload, len_plain, codec): salt, sealed blobs, sealed header, header length.

    The salt is a hash of the pack's id and of everything that is sealed in it: the same
    rows give the same file, and other rows another key, so no nonce is used twice with one
    key. Sealing is AES-256-GCM in the JVM; a pack closes near TARGET_BYTES, so one row
    holds it.
    """
    blobs = blobs.withColumn("pack_id", F.col("pack_id").cast("string"))
    entry = F.concat_ws(":", "blob_id", "kind", "len_plain", "codec", F.sha2("payload", 256))
    sealed_text = F.concat_ws("|", "pack_id", F.array_join(F.array_sort(F.collect_list(entry)), "|"))
    salts = blobs.groupBy("pack_id").agg(F.substring(F.unhex(F.sha2(sealed_text, 256)), 1, SALT_BYTES).alias("salt"))
    keys = _keyed(salts, master)
    numbered = blobs.withColumn("ordinal", F.row_number().over(W.partitionBy("pack_id").orderBy("blob_id")) - 1).join(keys, "pack_id")
    sealed = numbered.withColumn("payload", F.substring(F.aes_encrypt("payload", F.col("pack_key"), F.lit("GCM"), F.lit("DEFAULT"), nonce(F.col("ordinal"))), 13, 2**31 - 1))
    items = F.array_sort(F.collect_list(F.struct("ordinal", "blob_id", "kind", "payload", "len_plain", "codec")))
    grouped = sealed.groupBy("pack_id", "salt", "pack_key").agg(items.alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, headers_ = [], []
            for salt, own in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                at, body, entries = len(salt), [salt], []
                for b in own:
                    entries.append((b["kind"], bytes.fromhex(b["blob_id"]), at, len(b["payload"]), b["len_plain"], b["codec"]))
                    body.append(b["payload"])
                    at += len(b["payload"])
                bodies.append(b"".join(body))
                headers_.append(encode_header(entries))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bodies, pa.binary()), pa.array(headers_, pa.binary())], names=["pack_id", "pack_key", "body", "header"])

    made = grouped.mapInArrow(run, "pack_id string, pack_key binary, body binary, header binary")
    header = F.substring(F.aes_encrypt("header", F.col("pack_key"), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.lit(HEADER_NONCE))), 13, 2**31 - 1)
    return made.withColumn("sealed", header).select("pack_id", F.concat("body", "sealed", _little_endian(F.length("sealed"))).alias("content"))


def _salted(content: Column, master: bytes) -> Column:
    """``pack_key`` of a file."""
    return hkdf_by(sub_key(master, "pack-key-v1"), b"pack", F.substring(content, 1, SALT_BYTES), SALT_BYTES)


def headers(packs: DataFrame, master: bytes) -> DataFrame:
    """Header entries of (pack_id, content). A pack that is cut, damaged or sealed with
    another key gives one row with ``damaged`` and nulls. Only headers leave the JVM."""
    content, whole = F.col("content"), F.length("content")
    tail = F.hex(F.substring(content, whole - 3, F.lit(4)))
    size = F.when(whole >= SALT_BYTES + 4, F.conv(F.concat(*[F.substring(tail, i, 2) for i in (7, 5, 3, 1)]), 16, 10).cast("bigint"))
    parts = packs.select(F.col("pack_id").cast("string").alias("pack_id"), _salted(content, master).alias("pack_key"), F.when(size <= whole - 4 - SALT_BYTES, F.substring(content, (whole - 3 - size).cast("int"), size.cast("int"))).alias("sealed"))
    plain = F.try_aes_decrypt(F.concat(F.unhex(F.lit(HEADER_NONCE)), F.col("sealed")), F.col("pack_key"), F.lit("GCM"), F.lit("DEFAULT"))
    names = ["pack_id", "kind", "blob_id", "offset", "len_stored", "len_plain", "compression", "damaged"]
    types = (pa.string(), pa.int8(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int8(), pa.bool_())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for p, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if raw is None:
                        raise ValueError("sealed otherwise")
                    out += [(p, k, b.hex(), off, n, size, codec, False) for k, b, off, n, size, codec in decode_header(raw)]
                except (ValueError, struct.error):
                    out.append((p, None, None, None, None, None, None, True))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    return parts.select("pack_id", plain.alias("header")).mapInArrow(parse, "pack_id string, kind byte, blob_id string, offset bigint, len_stored int, len_plain int, compression byte, damaged boolean")


def opened(packs: DataFrame, entries: DataFrame, master: bytes) -> DataFrame:
    """``pack_id, blob_id, kind, payload`` of every entry; payload is null where it can't be
    opened. Compressed payloads are expanded.

    A pack meets its entries as one row and is cut there: no row has a pack for each blob.
    """
    fields = ["offset", "blob_id", "kind", "len_stored", "len_plain", "compression"]
    own = entries.where("not damaged").groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("own"))
    joined = packs.select(F.col("pack_id").cast("string").alias("pack_id"), "content").join(own, "pack_id")
    cut = lambda c, e: F.struct(e["blob_id"].alias("blob_id"), e["kind"].alias("kind"), e["len_plain"].alias("len_plain"), e["compression"].alias("compression"), F.substring(c, e["offset"].cast("int") + 1, e["len_stored"]).alias("sealed"))
    # a column of a row is copied whole each time it is read, a variable isn't: the file is read once and cut from there
    slices = F.get(F.transform(F.array("content"), lambda c: F.transform("own", lambda e: cut(c, e))), F.lit(0))
    sliced = joined.select("pack_id", _salted(F.col("content"), master).alias("pack_key"), slices.alias("parts"))
    parts = sliced.select("pack_id", "pack_key", F.posexplode("parts").alias("ordinal", "e"))
    payload = F.try_aes_decrypt(F.concat(nonce(F.col("ordinal")), F.col("e.sealed")), F.col("pack_key"), F.lit("GCM"), F.lit("DEFAULT"))
    small = parts.select("pack_id", "e.blob_id", "e.kind", "e.len_plain", "e.compression", payload.alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, codec, raw in zip(*[batch.column(c).to_pylist() for c in (3, 4, 5)], strict=True):
                try:
                    out.append(None if raw is None else decompressed(raw, codec, n))
                except Exception:  # noqa: BLE001  what the codec can't read is reported as a null payload
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["pack_id", "blob_id", "kind", "payload"])

    return small.mapInArrow(run, "pack_id string, blob_id string, kind byte, payload binary")


def rebuilt_index(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blob rows from headers, one for each id (the least pack), and the ids seen twice."""
    good = entries.where("not damaged").drop("damaged")
    first = good.groupBy("blob_id").agg(F.min_by(F.struct(*[c for c in good.columns if c != "blob_id"]), "pack_id").alias("e"), F.count(F.lit(1)).alias("n"))
    return first.select("blob_id", "e.*"), first.where("n > 1").select("blob_id", "n")
