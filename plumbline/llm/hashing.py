"""Permanent pseudo-random numbers for keys, the same in every engine that has SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits of the digest that make a number: 48 bits, exact as a DOUBLE.
DIGITS = 12


def hash_number(seed: str, *parts: Column) -> Column:
    """A BIGINT in [0, 2^48) that depends on the seed and the parts (none of them null) alone."""
    text = F.concat_ws("\x1f", F.lit(seed), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, DIGITS), 16, 10).cast("bigint")


def unit_number(seed: str, *parts: Column) -> Column:
    """A DOUBLE strictly between 0 and 1."""
    return (hash_number(seed, *parts).cast("double") + F.lit(0.5)) / F.lit(float(16**DIGITS))


def by_value() -> None:
    """Ships the calling module's functions with the job, so that executors need not have this package."""
    import inspect
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[inspect.currentframe().f_back.f_globals["__name__"]])
