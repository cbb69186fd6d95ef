"""Rows with long texts told apart by a list of keys, where only keys travel.

A join with a list too long to be broadcast shuffles every row, text and all. Here the list becomes a Bloom filter, which tells
most rows that are not listed where they lie; the others, listed or taken for it, are left to the caller. Which
side a row is on depends on its key alone, so rows of equal keys, in whichever table, are always on the same side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import pin

KEY_BITS, PLACES, WORD = 16, 4, 64
LEAST_WORDS, MOST_WORDS = 1 << 6, 1 << 22  # a longer list makes more rows look listed, not the filter longer


def _word_and_bits(df: DataFrame, like: DataFrame, words: int) -> tuple[Column, Column]:
    """The word of a key, and its bits in that word. ``df`` may hold keys in other types than the list does."""
    key = F.xxhash64(*[df[c].cast(like.schema[c].dataType) for c in like.columns])
    bits = F.lit(0).cast("bigint")
    for i in range(PLACES):
        place = F.shiftrightunsigned(key, 40 + 6 * i).bitwiseAND(F.lit(WORD - 1)).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), place))
    return key.bitwiseAND(F.lit(words - 1)).cast("int"), bits


def _filter_of(keys: DataFrame, words: int) -> DataFrame:
    """One row that holds the words of the filter, 32 MB at most."""
    word, bits = _word_and_bits(keys, keys, words)
    set_bits = keys.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found, made = set_bits.toArrow(), np.zeros(words, np.int64)
    made[found["word"].to_numpy()] = found["bits"].to_numpy()
    row = pa.table({"words": pa.ListArray.from_arrays(pa.array([0, words], pa.int32()), pa.array(made))})
    return keys.sparkSession.createDataFrame(row, "words array<bigint>")


def listed_by(keys: DataFrame, *tables: DataFrame) -> list[Column]:
    """Per table, whether ``keys`` may list a row's key; false says that it surely does not.

    ``keys`` holds the key columns alone and is read twice, so it is meant to be a written table; the tables have columns
    of these names. The list may hold keys more than once, and null ones.
    """
    count = keys.count()
    if not count:
        return [F.lit(False) for _ in tables]
    words = min(MOST_WORDS, max(LEAST_WORDS, 1 << (count * KEY_BITS // WORD).bit_length()))
    made = _filter_of(keys, words)
    found = []
    for table in tables:
        word, bits = _word_and_bits(table, keys, words)
        found.append(F.get(made.scalar(), word).bitwiseAND(bits) == bits)
    return found


def split_by_keys(keys: DataFrame, *tables: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Each table in two: rows that ``keys`` surely does not list, and all others; see :func:`listed_by`."""
    return [(table.where(~listed), table.where(listed)) for table, listed in zip(tables, listed_by(keys, *tables), strict=True)]


def without_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key ``keys`` does not list, as a left anti join has them. Keys that the filter wrongly takes for listed get
    a filter of their own: rows outside it are surely listed, so hardly a row is left for the join."""
    rest, some = split_by_keys(keys, rows)[0]
    wrong = some.select(*keys.columns).distinct().join(keys, keys.columns, "left_anti")
    unsure = some.where(listed_by(pin(wrong, "wrongly-listed"), some)[0])
    return rest.unionByName(unsure.join(keys, keys.columns, "left_anti").select(*rows.columns))
