"""Text identifiers built from several columns.

The text form is an output column only.  Joins, groupings and distinct counts
always use the column tuple: without a separator ``1``+``23`` and ``12``+``3``
give the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def composite_key(*cols, sep: str = "") -> Column:
    """Concatenate the text of ``cols``; NULL when any part is NULL (as ``||``)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i and sep:
            parts.append(F.lit(sep))
        col = F.col(c) if isinstance(c, str) else c
        parts.append(col.cast("string"))
    return F.concat(*parts)


def all_present(*cols) -> Column:
    """True when none of ``cols`` is NULL."""
    out = None
    for c in cols:
        col = F.col(c) if isinstance(c, str) else c
        out = col.isNotNull() if out is None else out & col.isNotNull()
    return out


def tuple_or_null(*cols) -> Column:
    """A struct of ``cols`` when all are present, else NULL (for distinct counts)."""
    structured = F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])
    return F.when(all_present(*cols), structured)
