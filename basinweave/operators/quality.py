"""Quality of decompositions and projects: weighted component scores, levels, readiness and next actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinweave.functions.js import round_half_up

# Weights of the components.
SOURCE_WEIGHTS = {"brief": 0.18, "route": 0.22, "traceability": 0.17, "fidelity": 0.2, "visuals": 0.08, "resources": 0.08, "coverage": 0.07}
PROJECT_WEIGHTS = {"brief": 0.24, "route": 0.32, "visuals": 0.12, "resources": 0.14, "integrity": 0.18}
PRODUCT_READY, REVIEWABLE = 82, 68


def coverage_score(level: Column) -> Column:
    return F.when(level == "full_text", 100).when(level == "structured", 75).when(level == "abstract_only", 55).otherwise(50)


def coverage_label(level: Column) -> Column:
    """Label of a content level."""
    return (
        F.when(level == "full_text", "Full text").when(level == "abstract_only", "Abstract only").when(level == "metadata_only", "Metadata only")
        .when(level.isNull() | (level == "unknown"), "Unknown coverage").otherwise(F.initcap(F.regexp_replace(level, "[_-]+", " ")))
    )


def weighted_score(weights: dict[str, float]) -> Column:
    """Whole weighted sum of the columns score_<component>."""
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.col(f"score_{k}") * w
    return round_half_up(F.round(total, 6)).cast("int")


def source_quality(sources: DataFrame) -> DataFrame:
    """Scores and level of decompositions.

    Needs: has_one_line, n_points, n_nodes, n_edges, trace_score, fidelity_score, visual_count, explained, resource_count, linked, content_level.
    Null trace and fidelity scores count 45.
    """
    c = F.col
    rows = sources.select(
        "*",
        F.when(c("has_one_line") & (c("n_points") >= 3), 90).when(c("has_one_line") | (c("n_points") > 0), 60).otherwise(20).alias("score_brief"),
        F.when((c("n_nodes") >= 3) & (c("n_edges") >= 2), 90).when(c("n_nodes") >= 2, 65).otherwise(25).alias("score_route"),
        F.coalesce("trace_score", F.lit(45)).alias("score_traceability"),
        F.coalesce("fidelity_score", F.lit(45)).alias("score_fidelity"),
        F.when(c("visual_count") == 0, 75).otherwise(round_half_up(c("explained") * 100 / F.greatest(c("visual_count"), F.lit(1)))).alias("score_visuals"),
        F.when(c("resource_count") == 0, 35).otherwise(round_half_up(c("linked") * 100 / F.greatest(c("resource_count"), F.lit(1)))).alias("score_resources"),
        coverage_score(c("content_level")).alias("score_coverage"),
    )
    rows = rows.withColumn("score", weighted_score(SOURCE_WEIGHTS))
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("int")  # noqa: E731 (an unknown level is not a weak one)
    weak = (
        flag(c("score_brief") < 55) + flag(c("score_route") < 55) + flag(c("trace_level").isin("weak", "limited", "missing")) + flag(c("fidelity_level").isin("weak", "limited", "missing"))
        + flag((c("visual_count") > 0) & (c("score_visuals") < 45)) + flag((c("resource_count") == 0) | (c("score_resources") < 45))
    )
    rows = rows.withColumn("weak", weak)
    level = F.when((c("score") >= PRODUCT_READY) & (c("weak") == 0), "product_ready").when((c("score") >= REVIEWABLE) & (c("weak") <= 1), "reviewable").otherwise("weak")
    return rows.withColumn("level", level)


def project_quality(projects: DataFrame) -> DataFrame:
    """Scores and level of recomposed projects.

    Needs: has_one_line, n_points, n_nodes, n_edges, visual_count, explained, resource_count, linked, ready, warnings.
    """
    c = F.col
    rows = projects.select(
        "*",
        F.when((c("n_points") >= 3) & c("has_one_line"), 100).when(c("has_one_line") | (c("n_points") > 0), 65).otherwise(20).alias("score_brief"),
        F.when((c("n_nodes") >= 3) & (c("n_edges") >= 2), 100).when(c("n_nodes") >= 2, 70).otherwise(35).alias("score_route"),
        F.when(c("visual_count") == 0, 75).otherwise(round_half_up(c("explained") * 100 / F.greatest(c("visual_count"), F.lit(1)))).alias("score_visuals"),
        F.when(c("resource_count") == 0, 35).when(c("linked") > 0, 100).otherwise(65).alias("score_resources"),
        F.when(c("ready"), 100).otherwise(F.greatest(F.lit(45), 85 - c("warnings") * 10)).alias("score_integrity"),
    )
    rows = rows.withColumn("score", weighted_score(PROJECT_WEIGHTS))
    return rows.withColumn("level", F.when(c("score") >= PRODUCT_READY, "product_ready").when(c("score") >= REVIEWABLE, "reviewable").otherwise("weak"))


def benchmark(scored: DataFrame) -> DataFrame:
    """Mean and least score, weak rows and whether all pass."""
    return scored.agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("avg_score"), F.min("score").alias("min_score"), F.count_if(F.col("level") == "weak").alias("weak"),
        F.bool_and(F.col("level") != "weak").alias("passed"),
    )


def readiness(signals: DataFrame) -> DataFrame:
    """(project_id, ready, total, score) of signals (project_id, signal, state): share of those that are ready, in percent."""
    ready = F.count_if(F.col("state") == "ready")
    return signals.groupBy("project_id").agg(ready.alias("ready"), F.count("*").alias("total"), round_half_up(ready * 100 / F.count("*")).alias("score"))


def action_plan(signals: DataFrame, most: int = 4) -> DataFrame:
    """(project_id, rank, signal): what to do next: missing signals first, then limited and pending ones, at most ``most``."""
    from pyspark.sql import Window

    rank = F.when(F.col("state") == "missing", 1).when(F.col("state") == "limited", 2).when(F.col("state") == "pending", 3)
    open_ = signals.withColumn("_r", rank).where("_r is not null")
    order = Window.partitionBy("project_id").orderBy("_r", "ord", "signal")
    return open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("project_id", "rank", "signal", "state")


def review_actions(entities: DataFrame) -> DataFrame:
    """(id, actions): what to review of an entity, by its layer and category; needs type_layer and type_category."""
    cat, layer = F.col("type_category"), F.col("type_layer")
    actions = F.array_compact(
        F.array(
            F.when(layer == "source", "Check the source"),
            F.when(cat.isin("data", "observation"), "Check coverage and units"),
            F.when(cat.isin("modeling", "method"), "Check inputs and outputs"),
            F.when(cat.isin("evidence", "knowledge"), "Check the supporting evidence"),
            F.when(layer == "world", "Check place and extent"),
            F.when(F.coalesce("verification_state", F.lit("extracted")) == "extracted", "Verify"),
        )
    )
    return entities.select("id", F.array_join(actions, "; ").alias("actions"))
