"""Exact deduplication by grace hash partitioning.

Map tasks normalise whole texts and merge equal ones in an open-addressing table that compares
complete content, so a group of copies sends one record per task however large it is. The merged
records are written to the shared folder as spill tables; a bucket whose distinct content exceeds
the bound is partitioned again on other hash bits until each bucket fits one table. The tables give
one small row for each distinct text, which rows of the input then look up by digest; that join
carries no text unless the caller asks for it and may be split by the adaptive planner when one
digest is hot.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z;
of equal texts a row with the largest id stays, and of rows that tie on that id one stays; a null id
stays only when its group has no other; empty input gives empty output; input columns named like an
output column are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from factloom.session import discard, materialize, partitions, ship, without

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER, LOWER)
RECORD = "_digest string, _hash bigint, _content binary, _bytes bigint, _n bigint, _keep bigint, _ties bigint"
GROUP = "_digest string, _n bigint, _keep bigint, _ties bigint"
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]


class Table:
    """Open addressing with linear probing; entries are equal only when their whole contents are."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 1024
        self.rows: list[list] = []
        self.bytes = 0

    def add(self, digest: str, content: bytes, n: int, keep: int | None, ties: int) -> None:
        mask = len(self.slots) - 1
        at = int(digest[16:32], 16) & mask
        while (k := self.slots[at]) >= 0:
            row = self.rows[k]
            if row[0] == digest:
                if row[1] != content:
                    raise ValueError(f"two different texts have the SHA-256 digest {digest}")
                row[2] += n
                if row[3] is None or keep is not None and keep > row[3]:
                    row[3], row[4] = keep, ties if keep is not None else row[4] + ties
                elif keep == row[3]:
                    row[4] += ties
                return
            at = (at + 1) & mask
        self.slots[at] = len(self.rows)
        self.rows.append([digest, content, n, keep, ties])
        self.bytes += len(content) + 200
        if 2 * len(self.rows) > len(self.slots):
            self._grow()

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for k, row in enumerate(self.rows):
            at = int(row[0][16:32], 16) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def normalise(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def _signed(digest: str) -> int:
    x = int(digest[:16], 16)
    return x - (1 << 64) if x >> 63 else x


def _records(table: Table) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(table.rows), 2000):
        rows = table.rows[lo : lo + 2000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([_signed(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
             pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())],
            names=["_digest", "_hash", "_content", "_bytes", "_n", "_keep", "_ties"],
        )


def _merge(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = normalise(text.as_py())
                table.add(hashlib.sha256(content).hexdigest(), content, 1, key, 1)
                if table.bytes > limit:
                    yield from _records(table)
                    table = Table()
        yield from _records(table)

    return run


def _bucket_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket: one table at a time."""
    table, current = Table(), None

    def groups() -> pa.RecordBatch:
        rows = table.rows
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (2, 3, 4))], names=["_digest", "_n", "_keep", "_ties"])

    for batch in batches:
        cols = {name: batch.column(batch.schema.get_field_index(name)) for name in ("_bucket", "_digest", "_content", "_n", "_keep", "_ties")}
        small = zip(*(cols[k].to_pylist() for k in ("_bucket", "_digest", "_n", "_keep", "_ties")), strict=True)
        for (bucket, digest, n, keep, ties), content in zip(small, cols["_content"], strict=True):
            if bucket != current:
                if table.rows:
                    yield groups()
                table, current = Table(), bucket
            table.add(digest, content.as_py(), n, keep, ties)
    if table.rows:
        yield groups()


@F.pandas_udf(T.StringType())
def normal_digest(text: pd.Series) -> pd.Series:
    """SHA-256 of the normalised text."""
    return text.map(lambda t: hashlib.sha256(normalise(t)).hexdigest(), na_action=None)


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = 48 << 20, merge_bytes: int = 32 << 20, max_levels: int = 6) -> DataFrame:
    """One row for each distinct normalised text: digest, rows, largest id and how many rows bear it.

    table_bytes bounds the distinct content of a bucket, unless it is one longer text; a bucket that is still larger after
    max_levels partitionings, each on other hash bits, is one table whatever its size.
    """
    spark = docs.sparkSession
    pairs = docs.select(F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`").cast("string"))
    pending = materialize(pairs.mapInArrow(_merge(merge_bytes), RECORD), "dedup-spill-0")
    done, spilt = [], [pending]
    for level in range(max_levels):
        # the same text from several tasks counts once: its copies merge in the bucket's table
        distinct = pending.groupBy("_hash").agg(F.max("_bytes").alias("_bytes"))
        total = distinct.agg(F.sum("_bytes")).first()[0] or 0
        fanout = max(partitions(spark), -(-2 * total // table_bytes))
        bucket = F.pmod(F.xxhash64("_hash", F.lit(level)), F.lit(fanout))
        tagged, oversize = pending.withColumn("_bucket", bucket), None
        if level < max_levels - 1 and total > table_bytes:
            sizes = distinct.groupBy(bucket.alias("_bucket")).agg(F.sum("_bytes").alias("_total"), F.count("*").alias("_texts"))
            large = materialize(sizes.where((F.col("_total") > table_bytes) & (F.col("_texts") > 1)).select("_bucket"), f"dedup-large-{level}")
            oversize = None if large.isEmpty() else large
        fits = tagged if oversize is None else tagged.join(oversize, "_bucket", "left_anti")
        fits = fits.select("_bucket", *pending.columns).repartition(fanout if fanout < 100_000 else 100_000, "_bucket").sortWithinPartitions("_bucket")
        done.append(materialize(fits.mapInArrow(_bucket_tables, GROUP), f"dedup-groups-{level}"))
        if oversize is None:
            break
        pending = materialize(tagged.join(oversize, "_bucket", "left_semi").drop("_bucket"), f"dedup-spill-{level + 1}")
        spilt.append(pending)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    for df in spilt:
        discard(df)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds: int) -> DataFrame:
    """docs with keep_id, group_size, kept and text_sha256 for every row, dropped ones too."""
    ship(docs.sparkSession)
    groups = content_groups(docs, id_col, text_col, **bounds)
    rows = without(docs, OUTPUT).withColumn("_digest", normal_digest(F.col(f"`{text_col}`").cast("string")))
    joined = rows.join(groups.withColumnRenamed("_digest", "_of"), F.col("_digest") == F.col("_of"), "left")
    is_keep = F.col(f"`{id_col}`").cast("bigint").eqNullSafe(F.col("_keep"))
    tied = is_keep & (F.col("_ties") > 1)
    if groups.where("_ties > 1").isEmpty():
        out = joined.withColumn("_kept", is_keep)
    else:
        once = Window.partitionBy("_digest").orderBy(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c, kind in docs.dtypes if kind in ("string", "bigint", "int", "double", "boolean")]))
        first = joined.where(tied).withColumn("_kept", F.row_number().over(once) == 1)
        out = joined.where(~tied).withColumn("_kept", is_keep).unionByName(first)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != "_digest"], F.col("_keep").alias("keep_id"), F.col("_n").alias("group_size"), F.col("_kept").alias("kept"), F.col("_digest").alias("text_sha256"))
