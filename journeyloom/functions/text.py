"""Text helpers.  All of them stay inside generated code: no regular expressions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
    "\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks as Spark's ``trim`` does."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def double_text(c: Column) -> Column:
    """Text of a double without the trailing ``.0`` Spark writes for whole numbers."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(F.lower(c.cast("string")))


def tag(prefix: str, c: Column) -> Column:
    return F.concat(F.lit(prefix), c)


def pipe_join(*parts: Column) -> Column:
    """Join with a pipe; unlike ``concat_ws`` a NULL part makes the result NULL."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit("|"), part]
    return F.concat(*pieces[1:])


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)
