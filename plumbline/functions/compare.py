"""How values compare across differently written deliveries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters with the Unicode property White_Space (fixed values).
WHITE_SPACE = "".join(map(chr, [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_GAP = f"[{WHITE_SPACE}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_text(c: Column | str) -> Column:
    """Without case and surrounding white space; blank text is null."""
    text = F.btrim(F.lower(_col(c)), F.lit(WHITE_SPACE))
    return F.when(text != "", text)


def category(c: Column | str) -> Column:
    """As ``key_text``, with ``_`` equal to ``-``."""
    return F.translate(key_text(c), "_", "-")


def digest(c: Column | str) -> Column:
    """A SHA-256 as bare lower-case hex, without white space and algorithm prefix; else null.

    Most values need no regular expression, which costs more than all the rest.
    """
    plain = F.btrim(F.lower(_col(c)), F.lit(WHITE_SPACE))
    bare = F.regexp_extract(F.regexp_replace(plain, _GAP, ""), r"^(?:[a-z0-9_-]+[:=])?(?:0x)?([0-9a-f]+)$", 1)
    return F.when((F.length(plain) == 64) & F.unhex(plain).isNotNull(), plain).otherwise(F.when(bare != "", bare))


def bits64(c: Column | str) -> Column:
    """A 64-bit number written in hex in any notation, as BIGINT; 0 ("not computed") and anything else is null."""
    text = F.translate(F.lower(_col(c)), f"{WHITE_SPACE}:_.-", "")
    digits = F.when(text.startswith("0x"), F.substring(text, 3, 64)).otherwise(text)
    bare = F.ltrim(digits, F.lit("0"))
    valid = (bare != "") & (F.length(bare) <= 16) & F.unhex(bare).isNotNull()
    return F.when(valid, F.conv(bare, 16, -10).cast("bigint"))
