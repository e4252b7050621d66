"""Encrypted snapshots and key checks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope_key(*parts: Column) -> Column:
    """client:assistant:visitor:session:thread, not escaped."""
    return F.concat_ws(":", *parts)


def cipher_key(version: Column, scope: Column, master: Column) -> Column:
    """32 bytes: SHA-256 of version:scope:master."""
    return F.unhex(F.sha2(F.concat_ws(":", version, scope, master), 256))


def encrypt(plain: Column, key: Column) -> Column:
    """struct<alg, nonce_hex, ciphertext_hex>; AES-GCM with a random 12-byte nonce, the tag at the end."""
    sealed = F.hex(F.aes_encrypt(plain, key, F.lit("GCM")))
    return F.struct(F.lit("AESGCM").alias("alg"), F.lower(F.substring(sealed, 1, 24)).alias("nonce_hex"), F.lower(F.substring(sealed, 25, 2147483647)).alias("ciphertext_hex"))


def decrypt(sealed: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unhex(F.concat(sealed["nonce_hex"], sealed["ciphertext_hex"])), key, F.lit("GCM")).cast("string")


def key_status(given: Column, required: Column, key: Column, key_sha256: Column) -> Column:
    """200, 401 or 503: a request's key against the raw key, else against its SHA-256."""
    unset = (F.coalesce(key, F.lit("")) == "") & (F.coalesce(key_sha256, F.lit("")) == "")
    given = F.coalesce(given, F.lit(""))
    raw = (F.coalesce(key, F.lit("")) != "") & (given == key)
    hashed = (F.coalesce(key_sha256, F.lit("")) != "") & (F.sha2(given, 256) == F.lower(key_sha256))
    good = F.coalesce(raw, F.lit(False)) | F.coalesce(hashed, F.lit(False))
    return F.when(~required, 200).when(unset, 503).when(good, 200).otherwise(401)
