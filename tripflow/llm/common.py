"""Expressions shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and leave every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.pmod(F.crc32(text), F.lit(modulus))


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes, 0 to 2^32 - 1; a null text counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def others(frame: DataFrame, added: tuple[str, ...], holder: str = "doc") -> list[Column]:
    """The columns of ``frame``, packed in the struct ``holder``, except those in ``added``."""
    return [F.col(holder).getField(c).alias(c) for c in frame.columns if c not in added]


def restore(kind: type, state: dict):
    """An object from its attributes: broadcasts carry plain values, which any worker can read."""
    made = kind.__new__(kind)
    made.__dict__.update(state)
    return made
