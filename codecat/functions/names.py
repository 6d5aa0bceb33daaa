"""Name predicates: exported check, match modes, qualified-name split."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted match modes (an absent mode means exact).
MATCH_MODES = ("exact", "prefix", "contains")

# Symbol kinds and type kinds of the catalogue.
SYMBOL_KINDS = ("func", "method", "type", "var", "const")
TYPE_KINDS = ("struct", "interface", "alias", "other")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_exported(name) -> Column:
    """Go's exported rule: the first rune is an upper-case letter."""
    return _c(name).rlike(r"^\p{Lu}")


def match_mode_status(mode) -> Column:
    """NULL for a valid (or absent) mode, else the error status."""
    m = _c(mode)
    return F.when(m.isNotNull() & ~m.isin(*MATCH_MODES), F.lit("unknown_match_mode"))


def cut_first(name, sep: str = "."):
    """Split at the first separator: ``A.B.C`` -> (``A``, ``B.C``, found)."""
    n = _c(name)
    pos = F.instr(n, sep)
    found = pos > 0
    head = F.when(found, F.substring_index(n, sep, 1)).otherwise(n)
    tail = F.when(found, n.substr(pos + F.lit(len(sep)), F.lit(1 << 30)))
    return head, tail, found
