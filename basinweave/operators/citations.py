"""Identifiers of papers: DOIs in texts, titles, and the record of a registry that a citation means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinweave.functions.text import doi, significant_tokens


def input_kind(c: Column) -> Column:
    """doi, repository, url or title: what an input looks like."""
    t = F.lower(F.trim(c))
    return (
        F.when(doi(t).isNotNull(), "doi").when(t.rlike(r"github\.com/"), "repository").when(t.rlike("^https?://"), "url")
        .when((F.size(F.split(t, r"\s+")) >= 4) & (F.length(t) >= 20), "title").otherwise("unknown")
    )


def citation_parts(c: Column) -> Column:
    """(year, volume, first_page) that a citation names."""
    first = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return F.struct(
        first(r"\b((?:19|20)[0-9]{2})\b").cast("int").alias("year"), first(r"(?i)\bvol(?:ume|\.)?\s*([0-9]+)").alias("volume"), first(r"(?i)\bpp?(?:ages|\.)?\s*([0-9]+)").alias("first_page")
    )


def title_keys(tokens: Column) -> Column:
    """Pairs of neighbouring tokens, by which titles meet; a single token is its own key."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.get(tokens, i - 1), F.get(tokens, i)))
    return F.when(F.size(tokens) >= 2, F.array_distinct(pairs)).otherwise(tokens)


def match_titles(queries: DataFrame, records: DataFrame) -> DataFrame:
    """(query_id, record_id, score): the record whose title shares the most tokens with the query's, a matching year first.

    Titles are candidates if they share two neighbouring tokens; single words are too common to meet on. A title that is met by
    several keys is scored once.
    """
    q = queries.select("query_id", F.col("year").alias("qy"), significant_tokens(F.col("title")).alias("qt"))
    r = records.select("record_id", F.col("year").alias("ry"), significant_tokens(F.col("title")).alias("rt"))
    keyed_q = q.select("query_id", F.explode(title_keys(F.col("qt"))).alias("k"))
    keyed_r = r.select("record_id", F.explode(title_keys(F.col("rt"))).alias("k"))
    met = keyed_q.join(keyed_r, "k").select("query_id", "record_id").distinct()
    hit = met.join(q, "query_id").join(r, "record_id")
    score = F.round(2 * F.size(F.array_intersect("qt", "rt")) / (F.size("qt") + F.size("rt")), 6)
    same = F.coalesce((F.col("qy") == F.col("ry")).cast("int"), F.lit(0))
    best = hit.select("query_id", F.struct(score.alias("score"), same.alias("same"), F.col("record_id").alias("record_id")).alias("b")).groupBy("query_id").agg(F.max("b").alias("b"))
    return best.select("query_id", "b.record_id", "b.score")
