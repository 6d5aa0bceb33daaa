"""Text helpers (X3, identifiers, omitempty)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an identifier as Go spells it (letters, digits, underscore).
IDENT = r"[\p{L}_][\p{L}\p{N}_]*"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def empty_to_null(c) -> Column:
    """``omitempty``: an empty string becomes NULL so JSON drops it."""
    return F.nullif(_c(c), F.lit(""))


def leading_identifier(text) -> Column:
    """The identifier a line starts with, or NULL."""
    return empty_to_null(F.regexp_extract(_c(text), rf"^({IDENT})", 1))


def comment_text(line) -> Column:
    """One ``//`` comment line as doc text: marker and one space removed."""
    return F.regexp_replace(F.trim(_c(line), " \t"), r"^//[ ]?", "")
