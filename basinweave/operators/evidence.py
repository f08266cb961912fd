"""Evidence chains along outgoing support: levels, validation, sufficiency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basinweave.session import stable

CHAIN_RELATIONS = ("supports", "derives_from")
MERGE_ROUNDS = 8


def chain_nodes(starts: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(start, id, level): entities reached from each start, at their lowest level; literals end a chain.

    Breadth first, until a round adds nothing: each round joins only the nodes that the last round added, so every (start, id) is
    expanded once and cycles end. Rounds are written to the checkpoint folder, and every ``MERGE_ROUNDS`` rounds what was seen is
    written as one table, so the plan doesn't grow with them.
    """
    ids = entities.select("id").distinct()
    edges = triples.where(F.col("predicate").isin(*CHAIN_RELATIONS)).select(F.col("subject").alias("id"), F.col("object").alias("next")).distinct()
    edges = stable(edges.join(ids.withColumnRenamed("id", "next"), "next", "left_semi"))
    seen = stable(starts.select(F.col("id").alias("start"), "id").distinct().join(ids, "id", "left_semi").select("start", "id", F.lit(0).alias("level")))
    front, level = seen, 0
    while not front.isEmpty():
        level += 1
        step = front.join(edges, "id").select("start", F.col("next").alias("id")).distinct()
        front = stable(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
        if level % MERGE_ROUNDS == 0:
            seen = stable(seen)
    return seen


def chain_summary(nodes: DataFrame, entities: DataFrame, triples: DataFrame, min_depth: int = 2, min_confidence: float = 0.7) -> DataFrame:
    """Depth, mean confidence, gaps and sufficiency of each chain.

    A gap is a node above the deepest level without support of its own; weak nodes lack a source or have a confidence below 0.3.
    """
    facts = entities.select("id", F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.col("source"))
    supported = triples.where(F.col("predicate").isin(*CHAIN_RELATIONS)).select(F.col("subject").alias("id"), F.lit(True).alias("has_support")).distinct()
    rows = nodes.join(facts, "id").join(supported, "id", "left")
    depth = nodes.groupBy("start").agg(F.max("level").alias("depth"))
    weak = F.col("source").isNull() | (F.col("source") == "") | (F.col("confidence") < 0.3)
    gap = (F.col("level") < F.col("depth")) & F.col("has_support").isNull()
    out = rows.join(depth, "start").groupBy("start", "depth").agg(
        F.count("*").alias("nodes"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.count_if(weak).alias("weak"), F.count_if(gap).alias("gaps")
    )
    good = (F.col("depth") >= min_depth) & (F.col("avg_confidence") >= min_confidence) & (F.col("weak") == 0) & (F.col("gaps") == 0)
    return out.withColumn("sufficient", good)


def chain_text(nodes: DataFrame, entities: DataFrame) -> DataFrame:
    """(start, text): indented text of each chain, by level and name."""
    rows = nodes.join(entities.select("id", "type", F.coalesce(F.nullif("name", F.lit("")), F.col("id")).alias("label")), "id")
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.lit("["), F.col("type"), F.lit("] "), F.col("label"))
    ordered = F.array_sort(F.collect_list(F.struct("level", "id", line.alias("line"))))
    return rows.groupBy("start").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))
