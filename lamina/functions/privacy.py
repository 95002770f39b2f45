"""Pseudonyms and generalisation, as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

from lamina.contract import PSEUDONYM_LENGTH

# SHA-256 block size and the two pads of the HMAC construction (RFC 2104).
_BLOCK, _INNER, _OUTER = 64, 0x36, 0x5C

# What counts as "no identifier": nothing but white space, Unicode included.
_BLANK = r"(?U)^[\s\x1c-\x1f]*$"


def pseudonymise(identifier: Column, salt: bytes, length: int = PSEUDONYM_LENGTH) -> Column:
    """Keyed, stable pseudonym; a blank identifier gives '' and is never hashed.

    Hashing a blank would make one false person of every row without an
    identifier. The value is hashed as it stands, not trimmed. Both pads are
    derived from the salt here, once; rows only meet built-in `sha2`.
    """
    if not salt:
        raise ValueError("a pseudonym needs a salt")
    key = (hashlib.sha256(salt).digest() if len(salt) > _BLOCK else salt).ljust(_BLOCK, b"\0")
    inner_pad = F.lit(bytearray(byte ^ _INNER for byte in key))
    outer_pad = F.lit(bytearray(byte ^ _OUTER for byte in key))
    text = identifier.cast("string")
    inner = F.unhex(F.sha2(F.concat(inner_pad, text.cast("binary")), 256))
    digest = F.sha2(F.concat(outer_pad, inner), 256)
    return F.when(text.isNull() | text.rlike(_BLANK), F.lit("")).otherwise(
        F.substring(digest, 1, length)
    )


def generalise_year(date_text: Column) -> Column:
    """Leading four digits of a date, '' when the text does not start with a year."""
    return F.regexp_extract(F.coalesce(date_text, F.lit("")), r"^\s*([0-9]{4})", 1)
