"""Queries of problem 1: free-entered values mapped to a reference list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.llm import canonical
from basinweave.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry that each freely entered research field and entity type means, or UNMATCHED."""
    fields = canonical.field_reference(table(spark, sf_dir, "research_fields"))
    types = canonical.type_reference(table(spark, sf_dir, "ontology_types"), table(spark, sf_dir, "type_alias"))
    applications = canonical.canonical_values(table(spark, sf_dir, "applications"), "id", "research_field", fields, "applications")
    return applications.unionByName(canonical.canonical_values(table(spark, sf_dir, "entities"), "id", "type", types, "entities"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records per table and entry, with the unmatched ones."""
    return p1_found(spark, sf_dir).groupBy("tbl", "canonical").agg(F.count("*").alias("records"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report)}
ORACLES: dict[str, str] = {}
