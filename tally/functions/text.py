"""String helpers (F1-F3, F13 and the quoting used in error messages).

All are built-in Column expressions: they run inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Unicode White_Space code points (Unicode Character Database, PropList.txt).
# A ledger cell is trimmed of these on both ends, as a "trim all Unicode white
# space" function does: U+0009..U+000D, U+0020, U+0085, U+00A0, U+1680,
# U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
UNICODE_WHITE_SPACE = "".join(
    chr(c)
    for c in (
        [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
        + list(range(0x2000, 0x200B))
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    )
)
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def trim_space(col) -> Column:
    """strip leading and trailing Unicode white space.

    ``trim(str, chars)`` is a codegen'd StringTrim, much cheaper than a
    regular expression on every cell.
    """
    return F.trim(_c(col), F.lit(UNICODE_WHITE_SPACE))


def strip_one_plus(col) -> Column:
    """drop exactly one leading ``+`` (``++5`` keeps one)."""
    c = _c(col)
    return F.when(c.startswith("+"), F.substr(c, F.lit(2))).otherwise(c)


def quote_text(col) -> Column:
    """Double-quoted rendering of a raw cell for error messages.

    Backslash, double quote, tab, new line and carriage return are escaped;
    a NULL cell (Spark reads an empty CSV cell as NULL) renders as ``""``.
    """
    c = F.coalesce(_c(col), F.lit(""))
    for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return F.concat(F.lit('"'), c, F.lit('"'))
