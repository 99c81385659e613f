"""Column functions on text cells; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of cells: space, tab, newline and the other ASCII controls that editors strip.
CELL_SPACE = " \t\n\r\x0b\x0c"
#: What Python's str.strip removes within ASCII.
STRIP_SPACE = CELL_SPACE + "\x1c\x1d\x1e\x1f"


def trimmed(c: Column) -> Column:
    """The cell without white space at both ends; null stays null."""
    return F.btrim(c, F.lit(CELL_SPACE))


def cell(c: Column) -> Column:
    """The trimmed cell; null, empty and white space are all ''."""
    return F.coalesce(trimmed(c), F.lit(""))


def canonical_decimal(c: Column) -> Column:
    """One writing for all decimal writings of a number; other text is unchanged.

    A decimal writing is ASCII digits with an optional sign and an optional
    point. The work is on the text itself, so no digit is lost at any length.
    """
    m = r"^([+-]?)0*([0-9]*?)(?:\.([0-9]*?)0*)?$"
    number = c.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$")
    whole = F.regexp_extract(c, m, 2)
    part = F.regexp_extract(c, m, 3)
    whole = F.when(whole == "", F.lit("0")).otherwise(whole)
    text = F.when(part == "", whole).otherwise(F.concat(whole, F.lit("."), part))
    minus = (F.regexp_extract(c, m, 1) == "-") & (text != "0")
    plain = c.rlike("^(0|-?[1-9][0-9]*)?$")  # what most cells are needs one look
    return F.when(plain, c).when(number, F.when(minus, F.concat(F.lit("-"), text)).otherwise(text)).otherwise(c)


def words_of(c: Column) -> Column:
    """The words of a label in lower case with single spaces; '' if it has none."""
    return F.coalesce(F.btrim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def micros(c: Column) -> Column:
    """Microseconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))
