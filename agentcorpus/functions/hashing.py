"""Stable hashes as Column expressions.

Everything that orders or buckets rows uses the first 64 bits of a SHA-256 digest.  The 16-character
hex form sorts exactly like the unsigned number, so windows order by the text and never need a
20-digit decimal; the number itself is only formed when a caller asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def as_text(part) -> Column:
    return (part if isinstance(part, Column) else F.lit(str(part))).cast("string")


def digest(*parts, separator: str = SEPARATOR) -> Column:
    """SHA-256 hex of the parts joined with the unit separator."""
    return F.sha2(F.concat_ws(separator, *[as_text(part) for part in parts]), 256)


def stable_key(*parts) -> Column:
    """16 hex characters that sort like ``stable_int`` of the same parts."""
    return F.substring(digest(*parts), 1, 16)


def stable_int(*parts) -> Column:
    return F.conv(stable_key(*parts), 16, 10).cast("decimal(20,0)")


def stable_rank(seed, identifier: Column) -> Column:
    return F.sha2(F.concat(as_text(seed), F.lit(":"), as_text(identifier)), 256)


def hex_mod(hex_text: Column, modulus: int) -> Column:
    """Modulo of a hex number of any length whose width is a multiple of eight digits.

    Folding eight digits at a time keeps every product inside a signed 64-bit integer as long as
    the modulus is below 2**31.
    """
    shift = (1 << 32) % modulus
    chunks = F.transform(
        F.sequence(F.lit(1), F.length(hex_text), F.lit(8)),
        lambda start: F.conv(hex_text.substr(start, F.lit(8)), 16, 10).cast("bigint"),
    )
    return F.aggregate(
        chunks,
        F.lit(0).cast("bigint"),
        lambda acc, chunk: (acc * F.lit(shift) + chunk % F.lit(modulus)) % F.lit(modulus),
    )


def stable_mod(modulus: int, *parts) -> Column:
    """``stable_int(*parts) % modulus`` without leaving 64-bit arithmetic or code generation."""
    key = stable_key(*parts)
    high = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(key, 9, 8), 16, 10).cast("bigint")
    shift = (1 << 32) % modulus
    return ((high % modulus) * F.lit(shift) + low % modulus) % modulus


def digest_mod(modulus: int, identifier: Column) -> Column:
    """The whole 256-bit digest taken modulo ``modulus``."""
    return hex_mod(F.sha2(as_text(identifier), 256), modulus)


def key_prefix(key: Column, digits: int) -> Column:
    """Leading hex digits as an integer: a bucket that never decreases along the key order."""
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("bigint")


def canonical_hash(**fields: Column) -> Column:
    """SHA-256 of compact JSON with sorted keys; null fields are left out."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered)), 256)


def record_id(*parts) -> Column:
    return F.substring(digest(*parts), 1, 24)
