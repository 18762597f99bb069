"""Problem 6: same or near-same records across splits.

Edit-distance segment join: an evaluation string is cut into segments; k edits leave all
but k of them intact, so a training string within distance k holds the others at places
shifted by at most k. Segments and substrings meet in an equi-join, and the pairs that
meet are verified by dynamic programming in a band of width 2k + 1. Keys, join and
verification are built-in expressions, so no row passes through Python.

Two parameters fit the join to the strings. ``shift`` says how far edits may move a
segment: k in general, 0 where characters are only exchanged, as in hashes. ``agree``
says how many segments must be intact together to make a key: with ``k + agree``
segments, ``agree`` of them always are, and longer keys meet fewer other strings.

All values here are compared as strings by that one join: digests and cluster names with
k = 0, where the whole string is the one segment; perceptual hashes as 16 hex digits with
k = 3, as 3 changed bits change at most 3 digits. An exact count of the differing bits
follows.

Nulls and empty strings equal nothing. Repeated rows count once. Empty tables give empty
results. Columns other than the named ones are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _start(i: Column | int, length: Column, n: int) -> Column:
    """Where segment ``i`` of ``n`` begins, from 0; sizes differ by one at most."""
    return F.floor(length * i / F.lit(float(n))).cast("int")


def _piece(text: Column, length: Column, i: Column | int, n: int, at: Column | None = None) -> Column:
    """The substring of segment ``i``'s size, at its own place or at ``at``."""
    i = F.lit(i) if isinstance(i, int) else i
    begin = _start(i, length, n)
    return F.substring(text, (begin if at is None else at) + 1, _start(i + 1, length, n) - begin)


def _whole(length: Column) -> Column:
    """The key of strings that are too short to have all segments: their length alone."""
    return F.xxhash64(length, F.lit(-1))


def evaluation_keys(text: Column, k: int, agree: int = 1) -> Column:
    """ARRAY<BIGINT>: a key for every choice of ``agree`` of the segments."""
    n, length = k + agree, F.length(text)
    keys = [F.xxhash64(length, F.lit(c), *[_piece(text, length, i, n) for i in chosen]) for c, chosen in enumerate(combinations(range(n), agree))]
    return F.when(length < n, F.array(_whole(length))).otherwise(F.array(*keys))


def training_keys(text: Column, k: int, shift: int, agree: int = 1) -> Column:
    """ARRAY<BIGINT>: the keys that segments of an evaluation string can have here, at every allowed place."""
    if shift == 0:
        return evaluation_keys(text, k, agree)
    if agree != 1:
        raise ValueError("segments that may move are matched one by one")
    n, own = k + 1, F.length(text)

    def of_segment(length: Column, i: Column) -> Column:
        begin, size = _start(i, length, n), _start(i + 1, length, n) - _start(i, length, n)
        low, high = F.greatest(F.lit(0), begin - shift), F.least(own - size, begin + shift)
        places = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.xxhash64(length, i, _piece(text, length, i, n, at)))

    def of_length(length: Column) -> Column:
        each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: of_segment(length, i)))
        return F.when(length < n, F.array(_whole(length))).otherwise(each)

    lengths = F.sequence(F.greatest(F.lit(1), own - shift), own + shift)
    return F.array_distinct(F.flatten(F.transform(lengths, of_length)))


def edit_pairs(evaluation: DataFrame, training: DataFrame, k: int, shift: int | None = None, agree: int = 1, on: list[str] | None = None) -> DataFrame:
    """(on..., text_e, text_t): distinct strings of either side's ``text`` at most ``k`` edits apart.

    With ``on``, only strings with equal values there are compared. ``shift`` below ``k``
    leaves out pairs whose segments moved further; see above.
    """
    shift = k if shift is None else shift
    if k < 0 or shift < 0 or agree < 1:
        raise ValueError("k and shift must not be negative, and one segment at least must agree")
    on = on or []

    def keyed(df: DataFrame, name: str, keys: Column) -> DataFrame:
        texts = df.where("text is not null and text <> ''").select(*on, "text").distinct()
        return texts.select(*on, F.col("text").alias(name), F.explode(keys).alias("key"))

    text = F.col("text")
    met = keyed(evaluation, "text_e", evaluation_keys(text, k, agree)).join(keyed(training, "text_t", training_keys(text, k, shift, agree)), [*on, "key"])
    met = met.where(F.levenshtein("text_e", "text_t", k) >= 0).select(*on, "text_e", "text_t")
    return met.distinct() if k else met


def hash_text(bits: Column) -> Column:
    """A 64-bit number as 16 hex digits."""
    return F.lpad(F.hex(bits), 16, "0")


def _differing_bits(a: Column, b: Column) -> Column:
    number = lambda text: F.conv(text, 16, -10).cast("bigint")
    return F.bit_count(number(a).bitwiseXOR(number(b)))


def text_pairs(evaluation: DataFrame, training: DataFrame, bits: int = 3) -> DataFrame:
    """(manifest, how, text_e, text_t): values that overlap, not yet the records that have them.

    Both sides: (manifest, how, text), ``how`` being 'content', 'cluster' or 'perceptual'.
    """
    at = ["manifest", "how"]
    same = edit_pairs(evaluation.where("how <> 'perceptual'"), training.where("how <> 'perceptual'"), 0, on=at)
    near = edit_pairs(evaluation.where("how = 'perceptual'"), training.where("how = 'perceptual'"), bits, shift=0, agree=2, on=at)
    return same.unionByName(near.where(_differing_bits(F.col("text_e"), F.col("text_t")) <= bits))


def _sides(assigned: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (manifest, how, text, sample_id) of the evaluation and of the training side."""
    rows = assigned.join(values, "sample_id").select("manifest", "in_train", "how", "text", "sample_id").distinct()
    return rows.where("not in_train").drop("in_train"), rows.where("in_train").drop("in_train")


def overlaps(assigned: DataFrame, values: DataFrame) -> DataFrame:
    """(manifest, e_id, t_id): distinct pairs of an evaluation and a training record that are (nearly) the same.

    ``assigned``: distinct (manifest, sample_id, in_train). ``values``: (sample_id, how,
    text). Texts are matched first, each once however many records have it; records come
    in last, so that a text with a third of all records on the training side alone is
    joined with nothing. A text that is on both sides gives all pairs, as asked, and its
    rows are split by adaptive execution.
    """
    e, t = _sides(assigned, values)
    pairs = text_pairs(e, t)
    at = ["manifest", "how"]
    left = e.select(*at, F.col("text").alias("text_e"), F.col("sample_id").alias("e_id"))
    right = t.select(*at, F.col("text").alias("text_t"), F.col("sample_id").alias("t_id"))
    found = pairs.join(left, [*at, "text_e"]).join(right, [*at, "text_t"]).where("e_id <> t_id")
    return found.select("manifest", "e_id", "t_id").distinct()


def links(assigned: DataFrame, values: DataFrame) -> DataFrame:
    """(manifest, how, e_id, links): how many training records each evaluation record overlaps with, value by value.

    No pair of records is made: the training records of a text are counted first.
    """
    e, t = _sides(assigned, values)
    at = ["manifest", "how"]
    size = t.groupBy(*at, F.col("text").alias("text_t")).agg(F.count("*").alias("n"))
    per_text = text_pairs(e, t).join(size, [*at, "text_t"]).groupBy(*at, "text_e").agg(F.sum("n").alias("n"))
    left = e.select(*at, F.col("text").alias("text_e"), F.col("sample_id").alias("e_id"))
    both = e.select("manifest", "how", F.col("text").alias("text_e"), F.col("sample_id").alias("e_id")).join(t.select("manifest", "how", F.col("text").alias("text_e"), F.col("sample_id").alias("e_id")), [*at, "text_e", "e_id"])
    own = both.select(*at, "text_e", "e_id", F.lit(1).alias("own"))  # a record that is on both sides is no pair with itself
    rows = left.join(per_text, [*at, "text_e"]).join(own, [*at, "text_e", "e_id"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0)))
    return rows.groupBy(*at, "e_id").agg(F.sum("n").alias("links")).where("links > 0")
