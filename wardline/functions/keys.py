"""Pseudonymous keys."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from wardline.fixed_values import USER_KEY_LENGTH

_BLOCK = 64


def pseudonymize(value: Column, secret: str, prefix: str = "") -> Column:
    """HMAC-SHA256 of the value, first 32 hex characters, from built-in hashing only."""
    key = secret.encode()
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytes(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytes(b ^ 0x5C for b in key))
    message = F.encode(F.concat(F.lit(prefix), value.cast("string")), "UTF-8")
    inner = F.unhex(F.sha2(F.concat(inner_pad, message), 256))
    return F.left(F.sha2(F.concat(outer_pad, inner), 256), F.lit(USER_KEY_LENGTH))


def deletion_audit_key(user_key: Column) -> Column:
    hashed = F.sha2(F.concat(F.lit("deletion-log:"), user_key.cast("string")), 256)
    return F.left(hashed, F.lit(USER_KEY_LENGTH))
