"""Telephony audio columns: G.711 by lookup, IMA ADPCM across blocks, resampled PCM.

Every decoder works on whole numpy arrays: mu-law and A-law are one gather from a table of
256 entries; ADPCM runs its short sequential loop over the samples of a block while each
step handles all blocks at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import as_bytes, table

MU_LAW, A_LAW, IMA_ADPCM, PCM = 7, 6, 0x11, 1
ALIGN = 64


def mu_law_table() -> np.ndarray:
    """G.711 mu-law: complemented code, sign, 3-bit exponent, 4-bit mantissa, bias 33 << 2."""
    code = ~np.arange(256, dtype=np.uint8)
    size = ((code.astype(np.int32) & 15) * 8 + 132 << (code.astype(np.int32) >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """G.711 A-law: code xor 0x55, sign, 3-bit exponent, 4-bit mantissa, half a step added."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, step = code >> 4 & 7, (code & 15) * 16 + 8
    size = np.where(exponent == 0, step, step + 256 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def ima_steps() -> np.ndarray:
    """The 89 step sizes of IMA ADPCM."""
    # Fixed values of the format.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494,
        544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
        12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


MU, A, STEPS = mu_law_table(), a_law_table(), ima_steps()
_JUMP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
#: Difference and next index for each step index and nibble.
_N = np.arange(16)
DIFF = (STEPS[:, None] >> 3) + np.where(_N & 4, STEPS[:, None], 0) + np.where(_N & 2, STEPS[:, None] >> 1, 0) + np.where(_N & 1, STEPS[:, None] >> 2, 0)
DIFF = np.where(_N & 8, -DIFF, DIFF).astype(np.int32)
NEXT = np.clip(np.arange(89)[:, None] + _JUMP[_N & 7], 0, 88).astype(np.int32)


def ima_decode(data: bytes | np.ndarray, block: int = ALIGN) -> np.ndarray:
    """All mono blocks of IMA ADPCM: header (predictor, index, 0), then two samples a byte.

    Index bytes above 88 count as 88. A tail shorter than ``block`` is left out.
    """
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // block
    raw = raw[: n * block].reshape(n, block)
    value = (raw[:, 0].astype(np.int32) | raw[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out = np.empty((2 * (block - 4) + 1, n), np.int16)
    out[0] = value
    codes = np.ascontiguousarray(raw[:, 4:].T)
    for i in range(block - 4):
        for k, nibble in ((1, codes[i] & 15), (2, codes[i] >> 4)):
            at = index * 16 + nibble
            value = np.clip(value + DIFF.ravel()[at], -32768, 32767)
            index = NEXT.ravel()[at]
            out[2 * i + k] = value
    return np.ascontiguousarray(out.T).ravel()


def ima_decode_all(bodies: Sequence[bytes | memoryview], block: int = ALIGN, group: int = 1 << 19) -> list[np.ndarray]:
    """ima_decode of each body, whose lengths are multiples of ``block``. Blocks of about
    ``group`` bytes of bodies go through each step together."""
    out: list[np.ndarray] = []
    held: list[bytes | memoryview] = []
    size, per = 0, 2 * (block - 4) + 1
    for i, body in enumerate(bodies):
        held.append(body)
        size += len(body)
        if size >= group or i + 1 == len(bodies):
            samples = ima_decode(b"".join(held), block)
            ends = np.cumsum([len(b) // block * per for b in held])
            out += np.split(samples, ends[:-1])
            held, size = [], 0
    return out


def ima_encode(pcm: np.ndarray, block: int = ALIGN) -> bytes:
    """Blocks of IMA ADPCM, each begun by a sample as it is; the end is filled with zeros."""
    per = 2 * (block - 4) + 1
    n = -(-len(pcm) // per)
    x = np.zeros(n * per, np.int32)
    x[: len(pcm)] = pcm
    x = x.reshape(n, per)
    out = np.zeros((n, block), np.uint8)
    value = x[:, 0].copy()
    out[:, 0], out[:, 1] = value & 255, value >> 8 & 255
    index = np.zeros(n, np.int32)
    for i in range(1, per):
        step, gap = STEPS[index], x[:, i] - value
        code, rest = np.where(gap < 0, 8, 0), np.abs(gap)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = rest >= part
            code, rest = code | np.where(hit, bit, 0), rest - np.where(hit, part, 0)
        at = index * 16 + code
        value, index = np.clip(value + DIFF.ravel()[at], -32768, 32767), NEXT.ravel()[at]
        out[:, 4 + (i - 1) // 2] |= (code << 4 * ((i - 1) % 2)).astype(np.uint8)
    return out.tobytes()


def wav(payload: bytes, kind: int = MU_LAW, rate: int = 8000, bits: int = 8, block: int = 1) -> bytes:
    """A mono RIFF file; its data chunk is ``payload`` as it is (and a pad byte if odd)."""
    extra = struct.pack("<HH", 2, 2 * (block - 4) + 1) if kind == IMA_ADPCM else b"" if kind == PCM else struct.pack("<H", 0)
    speed = rate * block * 8 // bits if kind != IMA_ADPCM else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block if kind != IMA_ADPCM else speed, block, bits) + extra
    size = 4 + 8 + len(fmt) + 8 + len(payload) + len(payload) % 2
    return b"".join((b"RIFF", struct.pack("<I", size & 0xFFFFFFFF), b"WAVEfmt ", struct.pack("<I", len(fmt)), fmt, b"data", struct.pack("<I", len(payload) & 0xFFFFFFFF), payload, b"\0" * (len(payload) % 2)))


def read_wav(data: bytes) -> tuple[int, int, int, memoryview]:
    """Format, rate, block size and the bytes of the data chunk. ValueError if it isn't WAV."""
    view = memoryview(data)
    if view[:4] != b"RIFF" or view[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, kind, rate, block = 12, None, 0, 1
    while at + 8 <= len(view):
        name, (size,) = bytes(view[at : at + 4]), struct.unpack("<I", view[at + 4 : at + 8])
        if name == b"fmt ":
            kind, _, rate, _, block, _ = struct.unpack("<HHIIHH", view[at + 8 : at + 24])
        elif name == b"data" and kind is not None:
            return kind, rate, block, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pcm(data: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a WAV file in mu-law, A-law, IMA ADPCM or 16-bit PCM."""
    kind, rate, block, body = read_wav(data)
    raw = np.frombuffer(body, np.uint8)
    if kind == MU_LAW:
        return rate, MU[raw]
    if kind == A_LAW:
        return rate, A[raw]
    if kind == IMA_ADPCM:
        return rate, ima_decode(raw, block)
    if kind == PCM:
        return rate, np.frombuffer(body[: len(body) // 2 * 2], "<i2")
    raise ValueError(f"format {kind}")


def double_rate(x: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean of it and the next; the last is repeated."""
    out = np.empty(2 * len(x), np.int16)
    out[::2] = x
    out[1:-1:2] = (x[:-1].astype(np.int32) + x[1:]) >> 1
    out[-1:] = x[-1:]
    return out


def features(x: np.ndarray, adpcm: np.ndarray) -> str:
    """Whole numbers only, so equal on every machine: of the 16 kHz signal its samples, mean
    size, root mean square and zero crossings; of the ADPCM reading its mean size and peak."""
    if not len(x):
        return "n=0"
    wide = x.astype(np.int64)
    energy = int(wide @ wide) // len(x)
    size = np.abs(adpcm.astype(np.int32)) if len(adpcm) else np.zeros(1, np.int32)
    return f"n={len(x)};mean={int(np.abs(wide).sum()) // len(x)};rms={int(energy**0.5)};zc={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};admean={int(size.sum(dtype=np.int64)) // len(size)};adpeak={int(size.max())}"


def encode_text(text: bytes) -> bytes:
    """The text and zeros up to a positive multiple of 64 bytes, as a mu-law WAV file."""
    return wav(text + b"\0" * (-len(text) % ALIGN if text else ALIGN))


def decoded(media: DataFrame, column: str = "media", rate: int = 16000) -> DataFrame:
    """Column ``column`` of telephony WAV files as 16-bit PCM WAV at ``rate`` in ``pcm``.

    ``rate`` is the file's or twice that. A null or a file that can't be read gives null.
    Other columns pass as they are; one named ``pcm`` is replaced.
    """
    from pyspark.sql import types as T

    from .common import with_batches

    def one(data: bytes | None) -> bytes | None:
        if data is None:
            return None
        try:
            own, x = pcm(data)
        except (ValueError, struct.error):
            return None
        if own * 2 == rate:
            x = double_rate(x)
        elif own != rate:
            return None
        return wav(x.astype("<i2").tobytes(), PCM, rate, 16, 2)

    return with_batches(media, column, lambda cells: [pa.array([one(c) for c in cells], pa.binary())], [T.StructField("pcm", T.BinaryType())])


def stored(docs: DataFrame) -> DataFrame:
    """Each text as mu-law samples, read back; one row for each row of ``docs``.

    Null and empty texts give 64 zero bytes. Repeated rows give repeated results.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 500):
                texts = [t or b"" for t in batch.column(1).slice(at, 500).to_pylist()]
                files = [encode_text(t) for t in texts]
                bodies = [read_wav(f)[3] for f in files]
                for text, media, body, adpcm in zip(texts, files, bodies, ima_decode_all(bodies), strict=True):
                    _, x = pcm(media)
                    rows.append((len(text), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), features(double_rate(x), adpcm)))
            cols = list(zip(*rows, strict=True)) or [[]] * 7
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", as_bytes()).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over all documents."""
    return stored(table(spark, sf_dir, "documents"))
