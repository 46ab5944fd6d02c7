"""Audit records as a stream: schema findings as they arrive, and counts by disposition in event-time windows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.json_schema import first_problem, schema_problems
from factloom.session import ship

RAW = "record string"


def record_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of JSON files as they appear in a folder."""
    return spark.readStream.schema(RAW.replace("record", "value")).option("maxFilesPerTrigger", files_per_batch).text(folder).select(F.col("value").alias("record"))


def checked(records: DataFrame, schema: dict[str, Any]) -> DataFrame:
    """records with request_id, disposition, at, and the first problem of each, null where valid."""
    ship(records.sparkSession)
    found = first_problem(schema_problems(F.col("record"), schema))
    return records.select(
        "record", F.get_json_object("record", "$.request_id").alias("request_id"), F.get_json_object("record", "$.decision.disposition").alias("disposition"), F.try_to_timestamp(F.get_json_object("record", "$.started_at")).alias("at"), found.alias("problem")
    )


def by_window(rows: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, disposition, records, invalid) with late records up to `late`."""
    return rows.withWatermark("at", late).groupBy(F.window("at", width), "disposition").agg(F.count("*").alias("records"), F.count_if(F.col("problem").isNotNull()).alias("invalid"))
