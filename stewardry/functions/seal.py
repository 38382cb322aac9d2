"""Sealed values: keyed digests for equality, and encryption under keys of their own, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = "••••••"


def normalised(value: Column, kind: str) -> Column:
    """As values are compared: trimmed; e-mail addresses lower-case; of phone numbers the digits and plus signs."""
    text = F.trim(value.cast("string"))
    if kind == "email":
        return F.lower(text)
    return F.regexp_replace(text, "[^0-9+]", "") if kind == "phone" else text


def _xor_pad(key: bytes, with_byte: int) -> bytes:
    return bytes(b ^ with_byte for b in key.ljust(64, b"\0"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 as hex; message: binary or text."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    inner = F.sha2(F.concat(F.lit(_xor_pad(key, 0x36)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(_xor_pad(key, 0x5C)), F.unhex(inner)), 256)


def blind_index(key: bytes, org: str, field: str, value: Column, kind: str = "text") -> Column:
    """A digest by which equal values of a field and organisation are found; org and field count by 16 bytes of their digests."""
    import hashlib

    head = hashlib.sha256(org.encode()).digest()[:16] + hashlib.sha256(field.encode()).digest()[:16]
    return F.when(value.isNotNull(), hmac_sha256(key, F.concat(F.lit(head), normalised(value, kind).cast("binary"))))


def projection_key(key: bytes | None, digest: Column) -> Column:
    """A key to join on that doesn't show the digest: `pk_` and 40 hex digits; null without a key."""
    if key is None:
        return F.lit(None).cast("string")
    return F.when(digest.isNotNull(), F.concat(F.lit("pk_"), F.substring(hmac_sha256(key, digest), 1, 40)))


def fresh_keys(records: DataFrame, id_col: str, master: bytes, version: int) -> DataFrame:
    """(id, wrapped, version): a random data key for each record, encrypted under the master key of a version.

    Random, so write it once; what is read back is the truth.
    """
    data_key = F.unhex(F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, 32))
    return records.select(F.col(id_col), F.base64(F.aes_encrypt(data_key, F.lit(master), F.lit("GCM"), F.lit("DEFAULT"))).alias("wrapped"), F.lit(version).alias("version"))


def _opened(wrapped: Column, version: Column, masters: dict[int, bytes]) -> Column:
    out = F.lit(None).cast("binary")
    for v, master in masters.items():
        out = F.when(version == v, F.try_aes_decrypt(F.unbase64(wrapped), F.lit(master), F.lit("GCM"), F.lit("DEFAULT"))).otherwise(out)
    return out


def rewrapped(keys: DataFrame, masters: dict[int, bytes], to: int) -> DataFrame:
    """The keys under another version of the master key; sealed values stay as they are. A key that can't be opened stays as it is."""
    opened = _opened(F.col("wrapped"), F.col("version"), masters)
    new = F.base64(F.aes_encrypt(opened, F.lit(masters[to]), F.lit("GCM"), F.lit("DEFAULT")))
    others = [c for c in keys.columns if c not in ("wrapped", "version")]
    moved = opened.isNotNull() & (F.col("version") != to)
    return keys.select(*others, F.when(moved, new).otherwise(F.col("wrapped")).alias("wrapped"), F.when(moved, F.lit(to)).otherwise(F.col("version")).alias("version"))


def sealed(rows: DataFrame, keys: DataFrame, id_col: str, columns: list[str], masters: dict[int, bytes]) -> DataFrame:
    """`rows` with the columns encrypted under each record's own key; null without one."""
    joined = rows.join(keys.select(id_col, "wrapped", "version"), id_col, "left")
    data_key = _opened(F.col("wrapped"), F.col("version"), masters)
    out = {c: F.base64(F.aes_encrypt(F.col(c).cast("string").cast("binary"), data_key, F.lit("GCM"), F.lit("DEFAULT"))) for c in columns}
    return joined.withColumns(out).select(*rows.columns)


def unsealed(rows: DataFrame, keys: DataFrame, id_col: str, columns: list[str], masters: dict[int, bytes]) -> DataFrame:
    """The plain values; null for a record whose key has been shredded, and under a master key that isn't given."""
    joined = rows.join(keys.select(id_col, "wrapped", "version"), id_col, "left")
    data_key = _opened(F.col("wrapped"), F.col("version"), masters)
    out = {c: F.try_aes_decrypt(F.unbase64(F.col(c)), data_key, F.lit("GCM"), F.lit("DEFAULT")).cast("string") for c in columns}
    return joined.withColumns(out).select(*rows.columns)


def shredded(keys: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """The keys without those of `gone`: what they sealed can't be read any more, wherever copies of it lie."""
    return keys.join(gone.select(id_col).distinct(), id_col, "left_anti")
