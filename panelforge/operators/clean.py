"""Duplicate handling and filters by the keys of another table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.constants import DEDUP_KEYS

# Of a filter made from keys: bits that a key sets, bits for each, words at most (4 MB).
HASHES, BITS_PER_KEY, MAX_WORDS = 5, 16, 1 << 19
# What Spark estimates for a row of one number.
KEY_ROW_BYTES = 16


def drop_repeats(
    df: DataFrame, keys: Sequence[str] = DEDUP_KEYS, keep: str = "item_price", order: str = "ord"
) -> DataFrame:
    """One row per ``keys`` with the ``keep`` value that comes first by ``order``.

    An aggregate, not a sort: copies of a row are merged before the shuffle, so a key with
    very many copies costs one row per map task.
    """
    return df.groupBy(*keys).agg(F.min_by(keep, order).alias(keep))


def repeat_counts(df: DataFrame, keys: Sequence[str] = DEDUP_KEYS) -> DataFrame:
    """How many rows repeat an earlier row on ``keys`` and how many do not."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_key.agg(
        F.count(F.lit(1)).alias("first"), F.sum(F.col("_n") - 1).alias("repeated")
    )
    return (
        totals.unpivot([], ["first", "repeated"], "_kind", "n_rows")
        .where(F.col("n_rows") > 0)
        .select((F.col("_kind") == "repeated").alias("is_duplicate"), "n_rows")
    )


def keep_known(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` value occurs in ``known``."""
    return df.join(known.select(column), column, "left_semi")


def key_filter(known: DataFrame, column: str, n_known: int) -> Callable[[Column], Column]:
    """A test that every value of ``column`` in ``known`` passes, and few others.

    A Bloom filter in words of 64 bits: a value's hash picks a word, another one ``HASHES``
    bits of it that every known value sets. The words are one array, which Spark makes in a
    subquery of the query that uses the test; so the test needs no join and no shuffle and
    runs in the scan's stage. With ``BITS_PER_KEY`` about one unknown value in a hundred
    passes. There are at most ``MAX_WORDS`` words; longer key lists share them, so that more
    unknown values pass, but never fewer known ones.
    """
    n_words = 1
    while n_words < min(MAX_WORDS, BITS_PER_KEY * max(1, n_known) / 64):
        n_words *= 2

    def word_of(value: Column) -> Column:
        hashed = F.xxhash64(value.cast("long"), F.lit(0))
        return F.pmod(hashed, F.lit(n_words)).cast("int")

    def mask_of(value: Column) -> Column:
        hashed, one = F.xxhash64(value.cast("long"), F.lit(1)), F.lit(1).cast("long")
        places = [F.shiftrightunsigned(hashed, 6 * i).bitwiseAND(F.lit(63)) for i in range(HASHES)]
        masks = [F.call_function("shiftleft", one, place.cast("int")) for place in places]
        return reduce(lambda a, b: a.bitwiseOR(b), masks)

    words = known.groupBy(word_of(F.col(column)).alias("word")).agg(
        F.bit_or(mask_of(F.col(column))).alias("bits")
    )
    every = known.sparkSession.range(n_words).select(F.col("id").cast("int").alias("word"))
    filled = every.join(words, "word", "left").fillna(0, ["bits"])
    found = F.array_sort(F.collect_list(F.struct("word", "bits")))
    array = filled.agg(found.alias("found")).select(F.col("found.bits").alias("bits")).scalar()

    def passes(value: Column) -> Column:
        mask = mask_of(value)
        return F.get(array, word_of(value)).bitwiseAND(mask) == mask

    return passes


def keep_known_long(df: DataFrame, known: DataFrame, column: str, n_known: int) -> DataFrame:
    """As ``keep_known``, for a written key list of ``n_known`` rows of any length.

    While the list is short enough to be broadcast, that alone filters at the scan. A longer
    one makes both sides of the semi join shuffle, so a filter made from the keys runs at the
    scan first, and only the rows that pass are shuffled for the exact join.
    """
    limit = _bytes(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    if n_known * KEY_ROW_BYTES > limit:
        df = df.where(key_filter(known, column, n_known)(F.col(column)))
    return keep_known(df, known, column)


def _bytes(setting: str) -> int:
    """A size setting as a number: plain, or with a unit."""
    text = setting.strip().lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    if text[-1] in units:
        return int(text[:-1]) << units[text[-1]]
    return int(text)


def keep_unknown(df: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` value does not occur in ``known``.

    Known values are made distinct first, so a value with very many rows is one row.
    """
    return df.join(known.select(column).distinct(), column, "left_anti")


def reconcile(
    left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str]
) -> DataFrame:
    """All ``keys`` of two tables, with the number of rows that each table has of them.

    A full outer comparison as one aggregate: repeated keys are counted before the shuffle,
    and NULL keys meet each other.
    """

    def counted(df: DataFrame, own: int) -> DataFrame:
        flags = [F.lit(int(k == own)).cast("long").alias(name) for k, name in enumerate(names)]
        return df.select(*keys, *flags)

    both = counted(left, 0).unionByName(counted(right, 1))
    return both.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in names])
