"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; no other character changes."""
    return F.translate(text, UPPER, LOWER)


def crc_of_id(doc_id: Column) -> Column:
    """CRC-32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that no other column of ``df`` can clash with a working name."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def free_name(taken: list[str], name: str) -> str:
    """A name that no column has, whatever its case."""
    own, name = {c.lower() for c in taken}, f"_{name}"
    while name.lower() in own:
        name = f"_{name}"
    return name
