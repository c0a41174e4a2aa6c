"""HMAC-SHA256 from the built-in hash, so signatures are checked in the JVM."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLOCK = 64


def hmac_sha256(body: Column, secret: str) -> Column:
    """Lower-case hex HMAC of the UTF-8 text. The two pads are literals of the plan."""
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(b ^ 0x36 for b in key))
    outer_pad = F.lit(bytearray(b ^ 0x5C for b in key))
    inner = F.sha2(F.concat(inner_pad, F.encode(body, "UTF-8")), 256)
    return F.sha2(F.concat(outer_pad, F.unhex(inner)), 256)


def signature_state(body: Column, signature: Column, secret: str) -> Column:
    """missing, wrong_length, wrong or valid (P1). No body at all is signed as ``{}``."""
    sent = F.coalesce(F.nullif(body, F.lit("")), F.lit("{}"))
    expected = F.concat(F.lit("sha256="), hmac_sha256(sent, secret))
    return (
        F.when(signature.isNull() | (signature == ""), "missing")
        .when(F.length(signature) != 71, "wrong_length")
        .when(signature != expected, "wrong")
        .otherwise("valid")
    )


def verify_signature(body: Column, signature: Column, secret: str) -> Column:
    """True only for a signature of exactly this body."""
    return signature_state(body, signature, secret) == "valid"
