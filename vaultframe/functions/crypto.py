"""Keyed content ids and sealed payloads as JVM expressions; keys are derived on the driver."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of the sub-keys. Fixed values of the format.
SUB_KEYS = ("chunk-id-v1", "pack-key-v1", "gear-seed-v1", "meta-v1")


def hkdf(key: bytes, info: bytes, length: int, salt: bytes = b"") -> bytes:
    """HKDF-SHA256 (RFC 5869)."""
    secret = hmac.new(salt or bytes(32), key, hashlib.sha256).digest()
    out, block = b"", b""
    while len(out) < length:
        block = hmac.new(secret, block + info + bytes([len(out) // 32 + 1]), hashlib.sha256).digest()
        out += block
    return out[:length]


def sub_key(master: bytes, label: str) -> bytes:
    if label not in SUB_KEYS:
        raise ValueError(f"no sub-key {label}")
    return hkdf(master, label.encode(), 32)


def pads(key: bytes) -> tuple[str, str]:
    """Hex of HMAC's inner and outer padded key."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(content: Column, key: bytes) -> Column:
    """Hex HMAC-SHA256 of a binary column, as two nested hashes inside generated code."""
    inner, outer = (F.unhex(F.lit(p)) for p in pads(key))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, content), 256))), 256)


def blob_id(content: Column, master: bytes) -> Column:
    return hmac_sha256(content.cast("binary"), sub_key(master, "chunk-id-v1"))


def _hmac_by(key: Column, size: int, content: Column) -> Column:
    """HMAC-SHA256 by a key column of ``size`` bytes, a multiple of 8 up to 64."""
    words = [F.conv(F.hex(F.substring(key, 8 * i + 1, 8)), 16, -10).cast("bigint") for i in range(size // 8)]

    def padded(byte: int) -> Column:
        mask = F.lit(int.from_bytes(bytes([byte]) * 8, "big"))
        return F.unhex(F.concat(*[F.lpad(F.hex(w.bitwiseXOR(mask)), 16, "0") for w in words], F.lit(f"{byte:02x}" * (64 - size))))

    return F.unhex(F.sha2(F.concat(padded(0x5C), F.unhex(F.sha2(F.concat(padded(0x36), content), 256))), 256))


def hkdf_by(key: bytes, info: bytes, salt: Column, salt_bytes: int) -> Column:
    """32 bytes of ``hkdf`` for a salt column of ``salt_bytes`` bytes."""
    secret = _hmac_by(salt, salt_bytes, F.unhex(F.lit(key.hex())))
    return _hmac_by(secret, 32, F.unhex(F.lit((info + b"\x01").hex())))


def nonce(index: Column) -> Column:
    """12 bytes: four zeros and the index, big-endian."""
    return F.unhex(F.lpad(F.hex(index.cast("bigint")), 24, "0"))


def seal(content: Column, key: bytes, index: Column) -> Column:
    """AES-256-GCM ciphertext and tag; the nonce follows from ``index`` and isn't stored."""
    return F.substring(F.aes_encrypt(content, F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"), nonce(index)), 13, 2**31 - 1)


def unseal(sealed: Column, key: bytes, index: Column) -> Column:
    """The content, or null if the key, the index or a byte is wrong."""
    return F.try_aes_decrypt(F.concat(nonce(index), sealed), F.unhex(F.lit(key.hex())), F.lit("GCM"), F.lit("DEFAULT"))
