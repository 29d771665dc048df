"""Directories of page files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def page_files(spark: SparkSession, path: str, id_pattern: str = r"([^/=]+?)(?:\.[A-Za-z]+)?$", whole: bool = True, least: int = 0) -> DataFrame:
    """``external_id, value`` of the files under ``path``: a row for each file (``whole``) or line, from ``least`` characters on.

    The id is group 1 of ``id_pattern`` in the file's path, by default the
    file's name without its ending.
    """
    read = spark.read.option("recursiveFileLookup", True).text(path, wholetext=whole)
    rows = read.select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("external_id"), "value")
    return rows.filter(F.length("value") >= least)
