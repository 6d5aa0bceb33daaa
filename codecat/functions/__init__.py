"""Column-expression helpers (scalar functions X1-X11 and predicates F1-F12).

All of them build JVM-side Catalyst expressions: no Python runs per row.
"""

from codecat.functions.names import (  # noqa: F401
    MATCH_MODES,
    cut_first,
    is_exported,
    match_mode_status,
)
from codecat.functions.paths import dirname, file_matches, is_absolute, under_root  # noqa: F401
from codecat.functions.text import comment_text, empty_to_null, leading_identifier  # noqa: F401
from codecat.functions.gate import MAX_INPUT_BYTES, too_long  # noqa: F401
