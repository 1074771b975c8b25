"""Byte-string forms of the text functions: one Latin-1 character stands for one byte."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHARSET = "ISO-8859-1"


def _chars(c: Column) -> Column:
    return F.decode(c, _CHARSET)


def _bytes(c: Column) -> Column:
    return F.encode(c, _CHARSET)


def trim(c: Column, chars: bytes) -> Column:
    """Strip leading and trailing bytes that occur in ``chars``."""
    return _bytes(F.btrim(_chars(c), F.lit(chars.decode("latin-1"))))


def position(c: Column, needle: bytes) -> Column:
    """1-based byte position of ``needle``, 0 when it does not occur."""
    return F.instr(_chars(c), needle.decode("latin-1"))


def overlay(c: Column, replacement: bytes, start: int, length: int) -> Column:
    return _bytes(F.overlay(_chars(c), F.lit(replacement.decode("latin-1")), F.lit(start), F.lit(length)))


def like(c: Column, pattern: bytes) -> Column:
    return _chars(c).like(pattern.decode("latin-1"))
