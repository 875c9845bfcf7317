"""Sealed restoration maps: envelope encryption of map columns with AES-256-GCM in built-in functions.

A data key encrypts the map on executors (aes_encrypt: 12 bytes of nonce, ciphertext, 16 of tag); a provider encrypts
the data key on the driver, once a frame. A sealed blob is base64 of JSON: version, provider, createdAt, encryptedDek,
encryptedMap, metadata.

Keys never stand in a query plan, where explain(), the UI and event logs would show them: they come out of Arrow UDFs
that hold them. A provider that can unwrap keys as a column (``unwrap_column``) opens frames of any number of data keys
on executors; others unwrap on the driver.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import hmac
import json
import os
from datetime import UTC, datetime
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.plans.errors import VAULT_CODES, VaultError

VERSION = 1


class Provider(Protocol):
    """Encrypts data keys; clouds' key services fit in here."""

    name: str

    def wrap(self, spark: SparkSession, key: bytes) -> str: ...

    def unwrap(self, spark: SparkSession, wrapped: str) -> bytes: ...


def hkdf(secret: bytes, salt: bytes, info: bytes = b"", size: int = 32) -> bytes:
    """HKDF with SHA-256 (RFC 5869)."""
    key, out, block = hmac.new(salt, secret, hashlib.sha256).digest(), b"", b""
    for n in range(1, -(-size // 32) + 1):
        block = hmac.new(key, block + info + bytes([n]), hashlib.sha256).digest()
        out += block
    return out[:size]


def _held(value: bytes) -> Column:
    """A constant binary column whose value the plan does not show."""

    @F.arrow_udf("binary")
    def held(rows: pa.Array) -> pa.Array:
        return pa.array([value] * len(rows), pa.binary())

    return held(F.lit(0))


def _aes(spark: SparkSession, data: bytes, key: bytes, mode: str) -> bytes | None:
    done = {"aes_encrypt": F.aes_encrypt, "aes_decrypt": F.try_aes_decrypt}[mode](_held(data), _held(key), F.lit("GCM"))
    got = spark.range(1).select(done.alias("x")).first()["x"]
    return None if got is None else bytes(got)


class LocalProvider:
    """A raw key of 32 bytes, or a passphrase from which each wrap derives a key with its own 16 bytes of salt."""

    name = "local"

    def __init__(self, secret: bytes | str):
        if not secret or (isinstance(secret, bytes) and len(secret) != 32):
            raise VaultError("VAULT_INVALID_KEY")
        self.secret = secret

    def wrap(self, spark: SparkSession, key: bytes) -> str:
        salt = os.urandom(16) if isinstance(self.secret, str) else b""
        own = hkdf(self.secret.encode(), salt) if salt else self.secret
        return base64.b64encode(salt + _aes(spark, key, own, "aes_encrypt")).decode()

    def unwrap(self, spark: SparkSession, wrapped: str) -> bytes:
        raw = base64.b64decode(wrapped)
        salt = raw[:16] if isinstance(self.secret, str) else b""
        own = hkdf(self.secret.encode(), salt) if salt else self.secret
        key = _aes(spark, raw[len(salt) :], own, "aes_decrypt")
        if key is None:
            raise VaultError("VAULT_DEK_DECRYPT_FAILED")
        return key

    def unwrap_column(self, wrapped: Column) -> Column:
        """Data keys of a column of wrapped ones; null where unwrapping fails."""
        secret = self.secret

        @F.arrow_udf("binary")
        def own(raw: pa.Array) -> pa.Array:
            derive = functools.lru_cache(maxsize=1024)(lambda salt: hkdf(secret.encode(), salt))
            return pa.array([secret if isinstance(secret, bytes) else derive(r[:16]) if r is not None else None for r in raw.to_pylist()], pa.binary())

        raw = F.unbase64(wrapped)
        return F.try_aes_decrypt(F.substring(raw, 17 if isinstance(secret, str) else 1, 2**31 - 1), own(raw), F.lit("GCM"))


def seal(df: DataFrame, provider: Provider, column: str = "map", out: str = "sealed", metadata: dict[str, str] | None = None, created: str | None = None) -> DataFrame:
    """df with the map column replaced by sealed blobs."""
    key = os.urandom(32)
    wrapped = provider.wrap(df.sparkSession, key)
    created = created or datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
    encrypted = F.base64(F.aes_encrypt(F.to_json(column).cast("binary"), _held(key), F.lit("GCM")))
    fields = [F.lit(VERSION).alias("version"), F.lit(provider.name).alias("provider"), F.lit(created).alias("createdAt"), F.lit(wrapped).alias("encryptedDek"), encrypted.alias("encryptedMap")]
    if metadata:
        fields.append(F.create_map(*[F.lit(x) for kv in sorted(metadata.items()) for x in kv]).alias("metadata"))
    made = F.base64(F.to_json(F.struct(*fields)).cast("binary"))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.regexp_replace(made, r"[\r\n]", ""))).drop(column)


def blob(c: Column) -> Column:
    return F.from_json(F.unbase64(c).cast("string"), "version int, provider string, createdAt string, encryptedDek string, encryptedMap string, metadata map<string,string>")


def open_sealed(df: DataFrame, provider: Provider, column: str = "sealed", out: str = "map") -> DataFrame:
    """df with sealed blobs opened to maps. Heads and keys are checked in two passes before; a map that does not open fails its query."""
    parsed = df.withColumn("_b", blob(F.col(column)))
    held = F.col(column).isNotNull()
    bad = F.col("_b.version").isNull() | (F.col("_b.version") != VERSION) | F.col("_b.encryptedDek").isNull()
    heads = parsed.agg(F.count_if(held & bad).alias("bad"), F.count_if(held & ~F.col("_b.provider").eqNullSafe(provider.name)).alias("other")).first()
    if heads["bad"]:
        raise VaultError("VAULT_INVALID_SEALED_BLOB")
    if heads["other"]:
        raise VaultError("VAULT_PROVIDER_MISMATCH")
    wrapped = F.col("_b.encryptedDek")
    key = provider.unwrap_column(wrapped) if hasattr(provider, "unwrap_column") else _looked_up(parsed.where(held), provider)(wrapped)
    failed = F.raise_error(F.lit(f"VAULT_DECRYPT_FAILED: {VAULT_CODES['VAULT_DECRYPT_FAILED']}")).cast("string")
    opened = parsed.withColumn("_k", key)
    if opened.where(held & F.col("_k").isNull()).limit(1).count():
        raise VaultError("VAULT_DEK_DECRYPT_FAILED")
    plain = F.try_aes_decrypt(F.unbase64("_b.encryptedMap"), F.col("_k"), F.lit("GCM")).cast("string")
    text = F.when(held, F.coalesce(plain, failed))
    return opened.withColumn(out, F.from_json(text, "map<string,string>")).drop("_b", "_k", column)


def _looked_up(blobs: DataFrame, provider: Provider):
    """Data keys that a provider unwraps on the driver, one call for each seal(); they are few, and stream past one by one."""
    keys = {r[0]: provider.unwrap(blobs.sparkSession, r[0]) for r in blobs.select("_b.encryptedDek").distinct().toLocalIterator()}

    @F.arrow_udf("binary")
    def key(wrapped: pa.Array) -> pa.Array:
        return pa.array([keys.get(w) for w in wrapped.to_pylist()], pa.binary())

    return key


def blob_fields(sealed: str) -> dict:
    return json.loads(base64.b64decode(sealed))
