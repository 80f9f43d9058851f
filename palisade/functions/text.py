"""Scalar functions on secrets: masks, kinds, digests, entropy, checksums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# PEM kinds that a mask may show.
PEM_KINDS = ("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK")


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, with underscores before it until no column has it (names are compared without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, from integer counts."""
    n = F.length(text)
    counts = F.transform(F.array_sort(F.array_distinct(F.split(text, ""))), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    total = F.aggregate(F.array_sort(counts), F.lit(0.0), lambda acc, c: acc + F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(0.0))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum of 13 to 19 digits that are not all the same."""
    return F.length(digits).between(13, 19) & (F.length(F.replace(digits, F.substring(digits, 1, 1), F.lit(""))) > 0) & F.call_function("luhn_check", digits)


def sanitized_kind(kind: Column) -> Column:
    """At most 16 of [a-z0-9_]; every other byte is an underscore; empty is ``unknown``."""
    ascii_only = F.regexp_replace(F.decode(kind.cast("binary"), "ISO-8859-1"), "[^a-z0-9]", "_")
    return F.when(F.length(kind) > 0, F.substring(ascii_only, 1, 16)).otherwise(F.lit("unknown"))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex HMAC-SHA256 of a binary column under a key of the session."""
    import hashlib

    block = hashlib.sha256(key).digest() if len(key) > 64 else key
    block = block.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in block)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)


def mask_secret(value: Column, kind: Column) -> Column:
    """What a log may show of a secret."""
    pem = F.coalesce(*[F.when(F.startswith(value, F.lit(f"-----BEGIN {k}-----")), F.lit(k)) for k in PEM_KINDS])
    parts = F.split(value, "@", -1)
    domain = F.when((F.size(parts) == 2) & (F.length(parts[0]) > 0) & F.octet_length(parts[1]).between(1, 64), parts[1])
    masked = (
        F.when(kind.isin("api_key", "high_entropy") & (F.length(value) >= 16), F.concat(F.left(value, F.lit(4)), F.lit("…"), F.right(value, F.lit(2))))
        .when((kind == "private_key") & pem.isNotNull(), pem)
        .when((kind == "email") & domain.isNotNull(), F.concat(F.lit("****@"), domain))
        .otherwise(F.lit("****")))
    return F.when(masked == value, F.lit("[redacted]")).otherwise(masked)


def route(path: Column) -> Column:
    """A request path without query and fragment and without trailing slashes."""
    bare = F.regexp_replace(path, "[?#].*$", "")
    return F.when(F.rtrim(bare, F.lit("/")) == "", F.lit("/")).otherwise(F.rtrim(bare, F.lit("/")))
