"""Content-defined chunking (FastCDC, normalised) of whole payloads.

The rolling hash keeps only what its mask tests: its low k bits depend on the last k bytes.
So all possible cuts of a payload come from a sum over a sliding window. Its low 8 bits need
8-bit arithmetic and three doubling steps over whole arrays, and rule out 255 of 256
places; the few that are left are summed in full. Chunking then hops from cut to cut. Only
the first bytes after a chunk's least size, where the hash starts anew, go one by one.
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vaultframe.functions.crypto import hkdf, sub_key


@dataclass(frozen=True)
class Sizes:
    """Bounds of chunks, and how many low bits must be zero before and after ``normal``."""

    least: int = 256 * 1024
    normal: int = 1024 * 1024
    most: int = 4 * 1024 * 1024
    strict_bits: int = 22
    loose_bits: int = 18


def gear_table(master: bytes) -> np.ndarray:
    """256 64-bit values derived from the master key."""
    return np.frombuffer(hkdf(master, b"gear-seed-v1", 2048), "<u8")


#: Bytes that are scanned at a time, so that the passes over them stay in cache.
BLOCK = 1 << 18


def _places(data: bytes, gear: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Where the hash of the last bytes passes the strict and the loose mask, ascending."""
    bits, least = max(sizes.strict_bits, sizes.loose_bits), min(sizes.strict_bits, sizes.loose_bits)
    raw, wide, two = np.frombuffer(data, np.uint8), gear.astype(np.uint32), gear.astype(np.uint16)
    low = np.frombuffer(data.translate((gear & np.uint64(255)).astype(np.uint8).tobytes()), np.uint8)
    shifted, found = np.empty(BLOCK + 16, np.uint8), []
    for at in range(0, len(data), BLOCK):
        lo = max(0, at - 15)
        w = low[lo : at + BLOCK].copy()
        for step in (1, 2, 4):  # w[i] covers the 2 * step bytes up to i
            if len(w) > step:
                part = shifted[: len(w) - step]
                np.left_shift(w[:-step], step, out=part)
                w[step:] += part
        hit = np.flatnonzero(w == 0 if least >= 8 else (w & np.uint8((1 << least) - 1)) == 0)
        if least >= 16:  # 16 bits of 16 bytes: those of the last 8, and the 8-bit sum before
            hit = hit[hit >= 15]
            h = w[hit - 8].astype(np.uint16) << np.uint16(8)
            for j in range(8):
                h += two[raw[hit + (lo - j)]] << np.uint16(j)
            hit = hit[h == 0]
        found.append(hit[hit >= at - lo] + lo)
    at = np.concatenate(found)
    at = at[at >= bits - 1]
    h = np.zeros(len(at), np.uint32)
    for j in range(bits):
        h += wide[raw[at - j]] << np.uint32(j)
    return at[h & np.uint32((1 << sizes.strict_bits) - 1) == 0], at[h & np.uint32((1 << sizes.loose_bits) - 1) == 0]


def cuts(data: bytes, gear: np.ndarray, sizes: Sizes = Sizes()) -> list[int]:
    """Ends of the chunks. None of an empty payload."""
    n = len(data)
    if n <= sizes.least:
        return [n] if n else []
    hard, soft = _places(data, gear, sizes)
    table = gear.astype(np.uint32).tolist()
    strict, loose = (1 << sizes.strict_bits) - 1, (1 << sizes.loose_bits) - 1
    warm_up = max(sizes.strict_bits, sizes.loose_bits) - 1
    out, start = [], 0
    while n - start > sizes.least:
        begin, end = start + sizes.least, min(start + sizes.most, n)
        middle = min(start + sizes.normal, end)
        cut, h, warm = 0, 0, min(begin + warm_up, end)
        for i in range(begin, warm):  # the hash holds bytes from begin on only
            h = (h << 1) + table[data[i]]
            if not h & (strict if i < middle else loose):
                cut = i + 1
                break
        if not cut and warm < middle and (k := np.searchsorted(hard, warm)) < len(hard) and hard[k] < middle:
            cut = int(hard[k]) + 1
        if not cut and (k := np.searchsorted(soft, max(warm, middle))) < len(soft) and soft[k] < end:
            cut = int(soft[k]) + 1
        start = cut or end
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunked(contents: DataFrame, master: bytes, sizes: Sizes = Sizes(), with_content: bool = False) -> DataFrame:
    """``path, seq, offset, length, chunk_id`` of (path, content); ids are keyed hashes.

    Null or empty contents have no chunks. Files are cut in parallel; one file is one row.
    """
    gear, key = gear_table(master), sub_key(master, "chunk-id-v1")
    kind = contents.schema["path"].dataType.simpleString()
    names = ["path", "seq", "offset", "length", "chunk_id", *["content"] * with_content]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, rows = [], []
            for r, data in enumerate(batch.column(1).to_pylist()):
                start = 0
                for seq, end in enumerate(cuts(data or b"", gear, sizes)):
                    part = data[start:end]
                    take.append(r)
                    rows.append((seq, start, end - start, hmac.new(key, part, hashlib.sha256).hexdigest(), part))
                    start = end
            types = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.binary())[: 4 + with_content]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int64())), *[pa.array([x[i] for x in rows], t) for i, t in enumerate(types)]], names=names)

    return contents.select("path", contents["content"].cast("binary")).mapInArrow(run, f"path {kind}, seq int, offset bigint, length int, chunk_id string" + ", content binary" * with_content)
