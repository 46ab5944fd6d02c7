"""Text and JSON predicates as columns; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C to U+001F.
BLANK = r"[\s\x1c-\x1f]"


def normal_eol(text: Column) -> Column:
    """CRLF and lone CR become LF."""
    return F.regexp_replace(text, r"\r\n?", "\n")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{BLANK}+|{BLANK}+\z", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){BLANK}+\z", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(text.rlike(rf"(?U)\A{BLANK}*\z"), F.lit(True))


def full_match(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(rf"\A(?:{pattern})\z"), F.lit(False))


def search(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return F.coalesce(text.rlike(("(?i)" if ignore_case else "") + pattern), F.lit(False))


def leaks(text: Column, patterns: dict[str, str]) -> Column:
    """The names of the patterns found in the text, in their given order."""
    return F.array_compact(F.array(*[F.when(search(text, p, True), F.lit(n)) for n, p in patterns.items()]))


def first_nonempty(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def missing(wanted: Column, present: Column) -> Column:
    """Sorted members of wanted that present hasn't."""
    return F.array_sort(F.array_except(F.coalesce(wanted, F.array().cast("array<string>")), F.coalesce(present, F.array().cast("array<string>"))))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(missing(a, b)) == 0


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def same_multiset(a: Column, b: Column) -> Column:
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def dense_ids(prefix: str, first: int, last: int, width: int = 3) -> Column:
    """The ids prefix-001, prefix-002, ... as an array."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda i: numbered_id(prefix, i, width))


def numbered_id(prefix: str, number: Column, width: int = 3) -> Column:
    """prefix and the number, padded with zeros to the width; longer numbers are kept whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < width, F.lpad(digits, width, "0")).otherwise(digits))


def variant_at(variant: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(variant, path, kind)


def variant_kind(variant: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, ..., ARRAY, OBJECT or VOID; null where the path is missing."""
    return F.regexp_extract(F.schema_of_variant(variant), r"\A(\w+)", 1)


def truthy(variant: Column) -> Column:
    """Neither missing, null, false, zero, an empty string, list nor mapping."""
    text = F.to_json(variant)
    return F.coalesce(~text.isin("null", "false", "0", "0.0", '""', "[]", "{}"), F.lit(False))


def all_keys(variant: Column, keys: list[str]) -> Column:
    """Whether a mapping has all keys, null values included."""
    have = F.json_object_keys(F.to_json(variant))
    return F.coalesce(F.size(F.array_except(F.array(*[F.lit(k) for k in keys]), have)) == 0, F.lit(False))


def every(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])
