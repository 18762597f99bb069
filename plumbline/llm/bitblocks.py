"""Pairs of 64-bit numbers that differ in few bits.

The bits are cut into ``k + agree`` blocks. Numbers at most ``k`` bits apart agree in at
least ``agree`` of them, so every such pair meets under the key made of some agreeing
blocks. More blocks make longer keys, under which fewer other numbers meet, and more keys
per number: for k = 3, two agreeing blocks give 26 bits and 10 keys, three give 32 bits
and 20 keys, four 37 bits and 35 keys. A stored table keeps the count it was built with;
``agree`` should be chosen so that the numbers expected are fewer than the keys have
values. A pair is kept only under its first agreeing blocks, hence once, without a
distinct.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AGREE = 2


def blocks(k: int, agree: int = AGREE, width: int = 64) -> list[tuple[int, int]]:
    """(shift, mask) of each block, the widths differing by one at most."""
    n = k + agree
    sizes = [width // n + (i < width % n) for i in range(n)]
    return [(sum(sizes[:i]), (1 << size) - 1) for i, size in enumerate(sizes)]


def _block(c: Column, shift: int, mask: int) -> Column:
    return F.shiftrightunsigned(c, shift).bitwiseAND(F.lit(mask))


def block_keys(c: Column, k: int, agree: int = AGREE) -> Column:
    """ARRAY<BIGINT>: for every choice of ``agree`` blocks, their bits and, in the top byte, which choice it is."""
    cut = blocks(k, agree)
    keys = []
    for n, chosen in enumerate(combinations(cut, agree)):
        key, used = F.shiftleft(F.lit(n).cast("bigint"), 56), 0
        for shift, mask in chosen:
            key, used = key + F.shiftleft(_block(c, shift, mask), used), used + mask.bit_length()
        keys.append(key)
    return F.array(*keys)


def agreeing(met: DataFrame, k: int, agree: int = AGREE) -> DataFrame:
    """Of pairs (bits_l, bits_r, block_key) that met under a key, those at most ``k`` bits apart, each under one key."""
    xor = F.col("bits_l").bitwiseXOR(F.col("bits_r"))
    first = None
    for n, chosen in reversed(list(enumerate(combinations(blocks(k, agree), agree)))):
        same = None
        for shift, mask in chosen:
            equal = _block(xor, shift, mask) == 0
            same = equal if same is None else same & equal
        first = F.when(same, F.lit(n)) if first is None else F.when(same, F.lit(n)).otherwise(first)
    return met.where((F.bit_count(xor) <= k) & (F.shiftrightunsigned("block_key", 56) == first))
