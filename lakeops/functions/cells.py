"""Expressions over raw row keys and cell values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded_text(value: Column) -> Column:
    """The text shown for a cell value: UTF-8 if printable, otherwise Base64."""
    one_line = F.translate(F.base64(value), "\r\n", "")
    return F.when(is_binary(value), one_line).otherwise(value.cast("string"))


def is_binary(value: Column) -> Column:
    """True unless the bytes are valid UTF-8 without control characters.

    Tab, line feed and carriage return count as text, and so does 0x7F.
    """
    text = value.cast("string")
    printable = F.is_valid_utf8(text) & ~text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]")
    return value.isNotNull() & ~printable


def display_key(key: Column) -> Column:
    """Printable ASCII as it is; backslash and every other byte as ``\\xNN``."""
    text = key.cast("string")
    pairs = F.regexp_extract_all(F.hex(key), F.lit("(..)"), F.lit(1))
    escaped = F.array_join(
        F.transform(
            pairs,
            lambda pair: F.when(
                pair.between("20", "7E") & (pair != "5C"), F.unhex(pair).cast("string")
            ).otherwise(F.concat(F.lit("\\x"), pair)),
        ),
        "",
    )
    plain = F.is_valid_utf8(text) & text.rlike(r"^[\x20-\x5B\x5D-\x7E]*$")
    return F.when(plain, text).otherwise(escaped)
