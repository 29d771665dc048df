"""JSON lines with validation: bad lines become rows with an error, not failures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def validated(lines: DataFrame, value: str, required: Sequence[str]) -> DataFrame:
    """``lines`` without blank ones, plus ``record`` (struct of the required string fields) and ``error``: ``bad_json``, ``missing_<field>`` or null."""
    schema = ", ".join(f"{name} string" for name in (*required, "__corrupt"))
    parsed = F.from_json(F.col(value), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})
    rows = lines.filter(F.trim(value) != "").withColumn("record", parsed)
    error = F.when(F.col("record.__corrupt").isNotNull() | F.col("record").isNull(), "bad_json")
    for name in required:
        error = error.when(F.trim(F.coalesce(F.col(f"record.{name}"), F.lit(""))) == "", f"missing_{name}")
    return rows.withColumn("error", error)


def read_jsonl(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """``file, value, record, error`` of every non-blank line under ``path``."""
    return validated(spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value"), "value", required)
