"""Scalar text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode as Java class members, and the ideographs that count as one token each.
SPACE = r"\s\x1c-\x1f\x85\xa0  -     　"
HAN = r"一-鿿"
TOKEN = rf"[{HAN}]|[^{SPACE}{HAN}]+"
PY_TOKEN = r"[一-鿿]|[^\s一-鿿]+"


def token_count(text: Column | str) -> Column:
    """Tokens of a text: each ideograph, and each run of other non-space characters. Null counts 0."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(TOKEN)), F.lit(0)).cast("int")


def blank(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.isNull() | (F.trim(c) == "")


def key(col: Column | str) -> Column:
    """Join key: trimmed, lower case, blank to null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.lower(F.trim(c)), F.lit(""))
