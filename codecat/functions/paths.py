"""Path predicates: root containment, dirname, file matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_absolute(path) -> Column:
    return _c(path).startswith("/")


def dirname(path) -> Column:
    """Lexical dirname of a slash path; ``/a.go`` -> ``/``, ``a.go`` -> ``.``."""
    p = _c(path)
    d = F.regexp_replace(p, r"/[^/]*$", "")
    return F.when(~p.contains("/"), F.lit(".")).when(d == "", F.lit("/")).otherwise(d)


def under_root(path, root) -> Column:
    """True when ``path`` is ``root`` or inside it.

    The relative path from root to path must not start with ``..`` — so a
    child whose first segment starts with ``..`` (``/root/..x``) is outside,
    as is anything not below ``root``.  Both sides are clean absolute paths.
    """
    p, r = _c(path), _c(root)
    r_slash = F.when(r.endswith("/"), r).otherwise(F.concat(r, F.lit("/")))
    rel = F.when(p == r, F.lit(".")).when(p.startswith(r_slash), p.substr(F.length(r_slash) + 1, F.lit(1 << 30)))
    return F.coalesce(rel.isNotNull() & ~rel.startswith(".."), F.lit(False))


def file_matches(loc_file, query) -> Column:
    """Absolute query: equal; relative query: ``loc_file`` ends with ``/query``."""
    f, q = _c(loc_file), _c(query)
    return F.when(q.startswith("/"), f == q).otherwise(f.endswith(F.concat(F.lit("/"), q)))


def path_suffixes(path) -> Column:
    """Every proper suffix of ``path`` that starts right after a ``/``.

    ``/a/b/c.go`` -> [``a/b/c.go``, ``b/c.go``, ``c.go``].  Exploding these
    turns the relative-file look-up into an equi-join.
    """
    p = _c(path)
    parts = F.split(p, "/")
    n = F.size(parts)
    return F.transform(
        F.sequence(F.lit(1), n - 1),
        lambda i: F.array_join(F.slice(parts, i + 1, n), "/"),
    )
