"""Shared column helpers."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\x0c\r"
# Splits at everything in ASCII which is no letter or digit; other characters are word characters.
TERM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_GAP = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else kept. ``lower`` is far faster, and the same on pure ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


#: As bytes: A-Z to a-z, gaps between terms to blanks, all else as it is.
_TERM_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def term_bytes(text: str | None) -> list[bytes]:
    """Lower-cased terms of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def word_bytes(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def split_words(text: Column, gap: str) -> Column:
    """Non-empty words between matches of ``gap``."""
    return F.filter(F.split(text, gap), lambda w: w != "")


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two longs which name a row by id and text, never null. Rows with the same key are
    repeats of each other, for which every operator has the same answer."""
    return (
        F.xxhash64(F.lit(11), doc_id, text).alias("k1"),
        F.xxhash64(F.lit(23), text, doc_id).alias("k2"),
    )


def put(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns; a column of the input with the same name gives way."""
    return df.withColumns(columns)
