"""Whitespace handling shared by all text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: every character that counts as white space (Unicode)
WHITESPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(WHITESPACE))
