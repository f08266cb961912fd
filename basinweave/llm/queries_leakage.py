"""Queries of problem 8: evaluation passages in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.llm import leakage
from basinweave.session import table


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items whose passage they hold, wholly or by about a third."""
    return leakage.leaked_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items per suite and the documents that hold them."""
    items = table(spark, sf_dir, "eval_items").select("item_id", "suite").distinct()
    return p8_found(spark, sf_dir).join(items, "item_id").groupBy("suite").agg(F.countDistinct("item_id").alias("items"), F.countDistinct("doc_id").alias("documents"))


QUERIES = {f.__name__: f for f in (p8_found, p8_items)}
ORACLES: dict[str, str] = {}
