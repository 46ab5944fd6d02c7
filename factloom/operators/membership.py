"""Bitmaps of fixed size that say which rows can be left out of a join.

A bitmap has 2 ** BITS places and is a table of at most 2 ** BITS / 64 words of 64 bits, 262,144 rows with the default, so its broadcast
is bounded whatever the data. What it leaves out is certain; what it lets through is verified by a join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Places of a bitmap, as a power of two.
BITS = 24


def bitmap(places: DataFrame) -> DataFrame:
    """(_word, _bits) of the places in the one column of places, numbers from 0 to 2 ** BITS - 1; nulls are left out."""
    at = places.toDF("_place").where("_place IS NOT NULL")
    return at.groupBy(F.expr("shiftright(_place, 6)").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_place & 63 AS int))")).alias("_bits"))


def marked(rows: DataFrame, place: Column, bits: DataFrame, name: str) -> DataFrame:
    """rows with a boolean column: whether the bitmap has the row's place; a null place isn't there. Rows stay where they are."""
    at = rows.withColumn("_place", place)
    found = at.join(F.broadcast(bits), F.expr("shiftright(_place, 6)") == F.col("_word"), "left")
    return found.withColumn(name, F.expr("coalesce(bit_get(_bits, cast(_place & 63 AS int)) = 1, false)")).drop("_place", "_word", "_bits")


def place_of(columns: list[Column]) -> Column:
    """A place from the hash of columns; a null in any of them is null."""
    missing = reduce(lambda a, b: a | b, [c.isNull() for c in columns])
    return F.when(~missing, F.pmod(F.xxhash64(*columns), F.lit(1 << BITS).cast("bigint")))


def comparable(rows: DataFrame, known: DataFrame, keys: dict[str, str]) -> bool:
    """Whether equal keys have equal hashes: both have one type, and texts the plain order."""
    types = [(rows.select(F.col(a)).schema[0].dataType, known.select(F.col(b)).schema[0].dataType) for a, b in keys.items()]
    return all(a == b and (not isinstance(a, StringType) or a == StringType()) for a, b in types)


def split(rows: DataFrame, keys: dict[str, str], known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows surely without a partner in known, rows that a join has to verify). keys: column of rows to column of known.

    A row with a null key is surely without one. Where the types of keys differ every row is left to the join.
    Columns named _place, _word, _bits or _maybe are the function's own and mustn't be in rows.
    """
    if not comparable(rows, known, keys):
        return rows.where(F.lit(False)), rows
    bits = bitmap(known.select(place_of([F.col(k) for k in keys.values()])))
    flagged = marked(rows, place_of([F.col(k) for k in keys]), bits, "_maybe")
    return flagged.where("NOT _maybe").drop("_maybe"), flagged.where("_maybe").drop("_maybe")


def not_in(rows: DataFrame, keys: dict[str, str], known: DataFrame) -> DataFrame:
    """The rows of `rules.not_in`. Only rows that the bitmap lets through are shuffled, so it helps where most rows have no partner;
    where nearly all have one, or known has far more keys than the bitmap has places, it costs a pass over known and saves nothing."""
    sure, maybe = split(rows, keys, known)
    right = known.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys.values())])
    on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)])
    return sure.unionByName(maybe.join(right, on, "left_anti"))
