"""Request argument checks: length gate (F10) and required arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the longest string argument accepted, in bytes.
MAX_INPUT_BYTES = 2048


def too_long(c, limit: int = MAX_INPUT_BYTES) -> Column:
    """True when a string argument is longer than ``limit`` bytes (UTF-8)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.octet_length(col) > limit, F.lit(False))


def request_status(df: DataFrame, required: list[str], extra: Column | None = None) -> Column:
    """First failing check of a request row, or NULL when it may run.

    Order: any string argument over the byte limit, then any missing required
    argument, then ``extra`` (an operator-specific check).  Non-string
    arguments are never length-checked.
    """
    str_cols = [f.name for f in df.schema.fields
                if isinstance(f.dataType, T.StringType) and f.name != "req_id"]
    long_any = reduce(lambda a, b: a | b, [too_long(c) for c in str_cols], F.lit(False))
    missing_any = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in required], F.lit(False))
    st = F.when(long_any, F.lit("argument_too_long")).when(missing_any, F.lit("missing_argument"))
    if extra is not None:
        st = st.otherwise(extra)
    return st
