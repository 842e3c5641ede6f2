"""Text forms used as keys."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ASCII = {i: None for i in range(128) if not chr(i).isalnum()}


def plain(text: str | None) -> str | None:
    """Letters and digits of text, without case, accents, spacing and punctuation; compatibility forms count as their plain letter."""
    if text is None:
        return None
    if text.isascii():
        return text.lower().translate(_ASCII)
    folded = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return "".join(c for c in folded if c.isalnum())


@F.arrow_udf(T.StringType())
def _plain_form(text: pa.Array) -> pa.Array:
    return pa.array([plain(t) for t in text.to_pylist()], pa.string())


def plain_form(col: Column | str) -> Column:
    """The plain form as a column; null stays null, a text without letters or digits gives an empty string. Texts of ASCII alone never leave the JVM; only the others travel to Python."""
    x = F.col(col) if isinstance(col, str) else col
    other = F.octet_length(x) != F.char_length(x)
    return F.when(~other, F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")).otherwise(_plain_form(F.when(other, x)))
