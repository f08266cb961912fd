"""Queries of problem 9: keyword-stuffed pages and link lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.llm import stuffing
from basinweave.session import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that for the most part are repeated keywords, links, tags or product lines."""
    return stuffing.stuffed_pages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and stuffed pages per source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    shares = stuffing.stuffed_pages(docs, scores=True).groupBy("doc_id").agg(F.max("share").alias("share"))
    found = docs.select("doc_id", "source").join(shares, "doc_id", "left")
    return found.groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("share") > stuffing.SHARE).alias("stuffed"))


QUERIES = {f.__name__: f for f in (p9_found, p9_sources)}
ORACLES: dict[str, str] = {}
