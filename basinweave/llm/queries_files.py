"""Queries of problem 3: source files that nobody wrote by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.llm import sourcefiles
from basinweave.session import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated, minified and vendored source files, and data saved as code."""
    return sourcefiles.found_files(table(spark, sf_dir, "repositories"))


def p3_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files per kind, as ``p3_found`` has them; those written by hand or unknown have none."""
    files = sourcefiles.file_kinds(table(spark, sf_dir, "repositories"))
    return files.groupBy("kind").agg(F.count("*").alias("files"), F.countDistinct("full_name").alias("repositories"))


QUERIES = {f.__name__: f for f in (p3_found, p3_kinds)}
ORACLES: dict[str, str] = {}
