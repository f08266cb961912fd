"""Queries of problem 7: encoding of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.llm import tokenize
from basinweave.session import table


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters per language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.length("text").alias("n"))
    sizes = p7_ids(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("tokens"))
    return docs.join(sizes, "doc_id").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum("n").alias("chars"))


QUERIES = {f.__name__: f for f in (p7_ids, p7_token_counts)}
ORACLES: dict[str, str] = {}
