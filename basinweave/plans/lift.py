"""The sales tables as a graph: registered types and predicates only, ids from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.session import table


def _id(prefix: str, key: str):
    return F.concat(F.lit(prefix + "-"), F.col(key).cast("bigint").cast("string"))


def sales_entities(spark: SparkSession, d: str) -> DataFrame:
    """id, type, name."""
    parts = [
        table(spark, d, "region").select(_id("region", "r_regionkey").alias("id"), F.lit("Region").alias("type"), F.col("r_name").alias("name")),
        table(spark, d, "nation").select(_id("nation", "n_nationkey").alias("id"), F.lit("Location").alias("type"), F.col("n_name").alias("name")),
        table(spark, d, "customer").select(_id("customer", "c_custkey").alias("id"), F.lit("Stakeholder").alias("type"), F.col("c_name").alias("name")),
        table(spark, d, "supplier").select(_id("supplier", "s_suppkey").alias("id"), F.lit("Institution").alias("type"), F.col("s_name").alias("name")),
        table(spark, d, "part").select(_id("part", "p_partkey").alias("id"), F.lit("Dataset").alias("type"), F.col("p_name").alias("name")),
        table(spark, d, "orders").select(_id("order", "o_orderkey").alias("id"), F.lit("Event").alias("type"), F.col("o_orderstatus").alias("name")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sales_triples(spark: SparkSession, d: str) -> DataFrame:
    """subject, predicate, object."""

    def edge(df, s, p, o):
        return df.select(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))

    line = table(spark, d, "lineitem")
    parts = [
        edge(table(spark, d, "nation"), _id("nation", "n_nationkey"), "part_of", _id("region", "n_regionkey")),
        edge(table(spark, d, "customer"), _id("customer", "c_custkey"), "located_at", _id("nation", "c_nationkey")),
        edge(table(spark, d, "supplier"), _id("supplier", "s_suppkey"), "located_at", _id("nation", "s_nationkey")),
        edge(table(spark, d, "orders"), _id("order", "o_orderkey"), "performed_by", _id("customer", "o_custkey")),
        edge(line, _id("order", "l_orderkey"), "uses", _id("part", "l_partkey")),
        edge(line, _id("supplier", "l_suppkey"), "produces", _id("part", "l_partkey")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
