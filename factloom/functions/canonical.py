"""Canonical bytes and the hashes over them."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import normal_eol


def canonical_json(value: Any) -> str:
    """Keys sorted at every level, no spaces, non-ASCII kept, numbers as Python writes them."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_hash(value: Any, without: tuple[str, ...] = ()) -> str:
    if without:
        value = {k: v for k, v in value.items() if k not in without}
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_sha256(json_text: Column, without: tuple[str, ...] = ()) -> Column:
    """SHA-256 of the canonical form of JSON text; null where it isn't JSON. VARIANT isn't used, as it rewrites numbers."""

    @F.pandas_udf(T.StringType())
    def hashed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return None if t is None else canonical_hash(json.loads(t), without)
            except (ValueError, AttributeError):
                return None

        return texts.map(one, na_action=None)

    return hashed(json_text)


@F.pandas_udf(T.BooleanType())
def same_json(a: pd.Series, b: pd.Series) -> pd.Series:
    """Whether two JSON texts say the same, as Python compares values: key order, spacing and 1 or 1.0 don't count."""

    def one(x: str | None, y: str | None) -> bool:
        try:
            return x is not None and y is not None and (x == y or json.loads(x) == json.loads(y))
        except ValueError:
            return False

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def json_equal(a: Column, b: Column) -> Column:
    """same_json, with Python looking only at texts that differ."""
    differ = ~a.eqNullSafe(b)
    return F.when(differ, same_json(F.when(differ, a), F.when(differ, b))).otherwise(a.isNotNull())


def file_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def blob_sha1(content: Column) -> Column:
    """The id that git gives to these bytes."""
    head = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.lit(b"\x00"))
    return F.sha1(F.concat(head, content))


def document_chunk(path: Column, text: Column) -> Column:
    """What a document adds to an ordered digest: path, zero, text with LF line ends, zero."""
    return F.concat(F.encode(path, "UTF-8"), F.lit(b"\x00"), F.encode(normal_eol(text), "UTF-8"), F.lit(b"\x00"))


def ordered_digest(order: Column, chunk: Column) -> Column:
    """An aggregate: SHA-256 of all chunks in order. One task sees all bytes, as the digest is serial; for small corpora."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), chunk.alias("c"))))
    # joined as hexadecimal text, which takes linear time; adding one chunk after the other doesn't
    return F.sha2(F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p["c"])), "")), 256)


def tree_digest(order: Column, chunk: Column) -> Column:
    """An aggregate for large corpora: SHA-256 over the chunks' own hashes in order. Not equal to ordered_digest."""
    parts = F.array_sort(F.collect_list(F.struct(order.alias("o"), F.sha2(chunk, 256).alias("h"))))
    return F.sha2(F.array_join(F.transform(parts, lambda p: p["h"]), ""), 256)
