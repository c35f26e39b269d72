"""Texts and lists as sets of 64-bit hashed items: the common ground of the similarity operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_set(text: Column) -> Column:
    """The distinct words of a text as sorted hashes: runs of a-z and 0-9 after lower-casing, and of a run of Han
    characters all pairs of neighbours (a single one as itself). Null for a null text."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[\\u4e00-\\u9fff]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.xxhash64(F.substring(r, k, F.lit(2))))
    words = F.transform(runs, lambda r: F.when(r.rlike("^[\\u4e00-\\u9fff]{2}"), pairs(r)).otherwise(F.array(F.xxhash64(r))))
    return F.array_sort(F.array_distinct(F.flatten(words)))


def word_sequence(text: Column) -> Column:
    """The words of a text in order: runs of a-z and 0-9 after lower-casing, and each Han character."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+|[\\u4e00-\\u9fff]"), F.lit(0))


def shingle_set(text: Column, width: int = 3, bits: int = 64) -> Column:
    """The distinct runs of ``width`` successive words, hashed to ``bits`` bits; empty for shorter texts, null for a null text."""

    def runs(w: Column) -> Column:  # w is a bound variable: the words are split once, not once an element
        def one(k: Column) -> Column:
            h = F.xxhash64(*(F.get(w, k + (j - 1)) for j in range(width)))
            return F.shiftrightunsigned(h, 64 - bits) if bits < 64 else h

        hashed = F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), one)
        return F.when(F.size(w) >= width, F.array_distinct(hashed)).when(w.isNotNull(), F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(word_sequence(text)), runs), 0)


def item_set(values: Column) -> Column:
    """The distinct values of an array of strings as sorted hashes, trimmed and lower-cased; nulls and blanks do not
    count. A null array is an empty set."""
    clean = F.transform(values, lambda x: F.lower(F.trim(x)))
    some = F.filter(clean, lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(some, lambda x: F.xxhash64(x)))), F.array().cast("array<bigint>"))


def set_key(items: Column) -> Column:
    """One key for equal sets: 128 bits of two hashes with different seeds."""
    return F.concat(F.lpad(F.hex(F.xxhash64(items)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit(11), items)), 16, "0"))


def distinct_sets(df: DataFrame, id_col: str, items: str) -> tuple[DataFrame, DataFrame]:
    """(members, classes): which class each id has, and each class with its set, once. Copies are collapsed here, so
    a group of copies, however large, costs the search no more than one record."""
    keyed = df.select(F.col(id_col).alias("id"), F.col(items).alias("items")).withColumn("cls", set_key(F.col("items")))
    members = keyed.select("id", "cls").distinct()
    classes = keyed.groupBy("cls").agg(F.first("items").alias("items")).withColumn("n", F.size("items"))
    return members, classes
