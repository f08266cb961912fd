"""Queries of problem 5: variant spellings of persons and organisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.llm import linkage
from basinweave.session import table


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.all_mentions(table(spark, sf_dir, "applications"), table(spark, sf_dir, "papers"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions of one person under different names, and different spellings of one organisation."""
    mentions = _mentions(spark, sf_dir)
    affiliations = mentions.select("affiliation")
    orgs = linkage.organisations(affiliations)
    persons = linkage.person_pairs(mentions, orgs).select(F.lit("person").alias("kind"), "key_a", "key_b")
    return persons.unionByName(linkage.organisation_pairs(affiliations, orgs).select(F.lit("organisation").alias("kind"), "key_a", "key_b"))


def p5_organisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings per organisation."""
    orgs = linkage.organisations(_mentions(spark, sf_dir).select("affiliation"))
    return orgs.groupBy("kind", "place").agg(F.count("*").alias("spellings"))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mention and affiliation with its person or organisation, and how many others of that are spelled differently."""
    mentions = _mentions(spark, sf_dir)
    orgs = linkage.organisations(mentions.select("affiliation"))
    people = linkage.person_classes(linkage.persons(mentions, orgs)).select(F.lit("person").alias("kind"), "key", "class", "links")
    return people.unionByName(linkage.organisation_classes(orgs).select(F.lit("organisation").alias("kind"), "key", "class", "links"))


QUERIES = {f.__name__: f for f in (p5_found, p5_organisations, p5_classes)}
ORACLES: dict[str, str] = {}
