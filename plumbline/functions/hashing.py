"""SHA-256 of values and of joined texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_digest(*parts: Column | str | int) -> Column:
    """Lower-case hex SHA-256 of the parts as text with NUL between them; null if a part is null.

    Strings and numbers among the parts are literals. ``concat`` rather than
    ``concat_ws``, as the latter would skip nulls and let different inputs collide.
    """
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit("\x00"))
        pieces.append(part.cast("string") if isinstance(part, Column) else F.lit(str(part)))
    return F.sha2(F.concat(*pieces), 256)


def content_digest(c: Column | str) -> Column:
    """Lower-case hex SHA-256 of bytes, or of a text's UTF-8."""
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)
