"""Names and texts of fixed forms, as column functions and as plain functions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_name(text: str) -> str:
    """Lower case, with one underscore for each run of other than ASCII letters and digits, none at the ends."""
    return "_".join(re.findall("[a-zA-Z0-9]+", text)).lower()


def safe_name_col(c: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), F.lit("_")))


def stata_name(text: str) -> str:
    """At most 32 ASCII letters, digits and underscores."""
    return re.sub("[^a-zA-Z0-9_]", "_", text)[:32]


def stata_name_col(c: Column) -> Column:
    return F.left(F.regexp_replace(c, "[^a-zA-Z0-9_]", "_"), F.lit(32))


def padded(c: Column, width: int | Column) -> Column:
    """Blanks up to the width at the right; longer text stays whole."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), w - F.char_length(c))))


def quoted(c: Column, sep: str, alone: bool = False) -> Column:
    """A cell of separated text: quoted where it holds a separator, quote or line end; alone in its row also when empty."""
    hard = c.rlike(f'[{re.escape(sep)}"\\r\\n]')
    if alone:
        hard = hard | (c == "")
    return F.when(hard, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def double_text(c: Column, dcml: int = 6) -> Column:
    """A double as text: whole numbers exactly, others with at most dcml (six to nine) decimals less trailing zeros.

    '' for null, NaN and what counts as missing. All in the JVM. Its formatting
    rounds right while neighbouring doubles lie closer than the last decimal;
    beyond, it would show a number's shortest digits and not its value, but there
    a fraction has so few bits that it can be scaled without loss. Sizes of 1e38 and more give null, for them
    sources.container.double_text is exact.
    """
    n = max(dcml, 6)
    if n > 9:
        raise ValueError("at most nine decimals")
    missing = c.isNull() | F.isnan(c) | (c >= F.lit(1.7976931348623157e308) * 0.99)
    strip = lambda t: F.rtrim(F.rtrim(t, F.lit("0")), F.lit("."))
    small = strip(F.replace(F.format_number(c, n), F.lit(","), F.lit("")))
    size, step = F.abs(c), F.lit(float(1 << 60))
    scaled = F.rint((size % F.lit(1.0)) * F.lit(float(10**n))).cast("bigint")
    whole = F.floor(size) + F.when(scaled == 10**n, 1).otherwise(0)
    large = strip(F.concat(whole.cast("string"), F.lit("."), F.lpad((scaled % F.lit(10**n)).cast("string"), n, "0")))
    high = F.floor(size / step)
    huge = (high.cast("decimal(19,0)") * F.lit(str(1 << 60)).cast("decimal(19,0)") + (size - high.cast("double") * step).try_cast("bigint").cast("decimal(19,0)")).cast("string")
    beyond = F.when(size >= 1e38, F.lit(None)).otherwise(F.concat(F.when(c < 0, "-").otherwise(""), F.when(size < float(1 << 62), large).otherwise(huge)))
    return F.when(missing, "").when(c == F.rint(c), F.when(size < float(1 << 62), c.try_cast("bigint").cast("string")).otherwise(beyond)).when(size < float(1 << int(math.log2(2**53 / 10**n))), small).otherwise(beyond)
