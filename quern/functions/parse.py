"""Reading conventions for keys written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INTEGER_TEXT = r"^\s*(\d+)(?:\.0)?\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def integer_text(c: Column | str) -> Column:
    """Integer written as text, as bigint. Surrounding white space, leading zeros and one trailing ``.0`` do not
    matter; null, anything else and numbers beyond 64 bits give null."""
    return F.regexp_extract(_col(c), INTEGER_TEXT, 1).try_cast("bigint")


def same_id(c: Column | str) -> Column:
    """Identifier without regard to case and surrounding white space; null stays null."""
    return F.regexp_replace(F.lower(_col(c)), r"^\s+|\s+$", "")
