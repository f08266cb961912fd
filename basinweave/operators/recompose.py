"""Recomposition of a project's entities as a map: anchors, results, layers and diagnostics; needs type_layer and type_category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinweave.functions.js import any_attr, attr, has_attr

# Fixed values.
RESULT_CATEGORIES = ("risk", "hazard", "model-output", "scenario", "evidence", "socioeconomic", "resource", "earth-variable", "exposure")
RESULT_TYPES = ("ModelOutput", "Forecast", "Projection", "Indicator", "Metric", "Claim", "Assessment")
TEMPORAL = ("temporalCoverage", "timeRange", "date", "year", "start", "end", "validTime", "issueTime")
LAYERS = ("region-layer", "point-layer", "route-or-flow-layer", "raster-layer", "classified-area-layer")


def _box() -> Column:
    four = lambda n: F.coalesce(F.json_array_length(attr(n)) >= 4, F.lit(False))
    return four("bbox") | four("spatialCoverage") | four("bounds")


def _point() -> Column:
    two = lambda n: F.coalesce(F.json_array_length(F.coalesce(F.get_json_object(attr(n), "$.coordinates"), attr(n))) >= 2, F.lit(False))
    return two("centroid") | two("location") | two("coordinates")


def spatial_kind() -> Column:
    """How an entity is bound to the map: geometry, bbox, point, named-scope or none."""
    named = any_attr("region", "country", "basin", "area", "spatialExtent", "spatialCoverage")
    return F.when(has_attr("geometry"), "geometry").when(_box(), "bbox").when(_point(), "point").when(named, "named-scope").otherwise("none")


def classified(entities: DataFrame) -> DataFrame:
    """Entities with spatial_kind, whether they are anchors and results, what draws them and whether that can be drawn now."""
    c = F.col
    rows = entities.withColumn("spatial_kind", spatial_kind())
    located = c("spatial_kind").isin("geometry", "bbox", "point")
    anchor = c("type_layer").isin("world", "domain") | (c("type_category").isin("observation", "data", "socioeconomic") & (c("spatial_kind") != "none"))
    result = c("type_category").isin(*RESULT_CATEGORIES) | c("type").isin(*RESULT_TYPES) | any_attr("value", "metric", "result", "finding", "outputs", "riskMap", "classification")
    geo = F.get_json_object(attr("geometry"), "$.type")
    drawn_geo = F.when(geo.isin("Point", "MultiPoint"), "point-layer").when(geo.isin("LineString", "MultiLineString"), "route-or-flow-layer").otherwise("region-layer")
    anchor_primitive = (
        F.when(c("spatial_kind") == "geometry", drawn_geo).when(c("spatial_kind") == "bbox", "region-layer").when(c("spatial_kind") == "point", "point-layer")
        .when(c("type_category").isin("earth-variable", "model-output"), "attached-chart-or-value").otherwise("spatial-anchor")
    )
    keys = F.coalesce(F.json_object_keys("attributes"), F.array().cast("array<string>"))
    timed = F.arrays_overlap(keys, F.array(*map(F.lit, TEMPORAL))) & any_attr(*TEMPORAL)
    valued = any_attr("value", "result", "finding", "classification", "riskMap", "outputs", "performance", "trend", "impact")
    result_primitive = (
        F.when(any_attr("classification", "classes", "riskMap"), "classified-area-layer").when(c("spatial_kind").isin("geometry", "bbox"), "region-layer")
        .when(c("spatial_kind") == "point", "point-layer").when(timed, "attached-time-series").when(valued, "attached-chart-or-value").otherwise("evidence-chain-view")
    )
    ability = (
        F.when(any_attr("requiresExecution", "executionRequired", "codeRequired"), "requires-code-execution").when(located, "renderable-now")
        .when(timed | valued, "renderable-as-attachment").otherwise("not-renderable")
    )
    return rows.select(
        "*", anchor.alias("is_anchor"), result.alias("is_result"), located.alias("located"), anchor_primitive.alias("anchor_primitive"), result_primitive.alias("result_primitive"), ability.alias("renderability")
    )


def layers(rows: DataFrame, group: str) -> DataFrame:
    """(group, primitive, anchors, results): layers that a project's map has."""
    a = rows.where("is_anchor and located").select(group, F.col("anchor_primitive").alias("primitive"), F.lit(1).alias("a"), F.lit(0).alias("r"))
    r = rows.where("is_result and renderability = 'renderable-now'").select(group, F.col("result_primitive").alias("primitive"), F.lit(0).alias("a"), F.lit(1).alias("r"))
    drawn = a.unionByName(r).where(F.col("primitive").isin(*LAYERS)).groupBy(group, "primitive").agg(F.sum("a").alias("anchors"), F.sum("r").alias("results"))
    attached = rows.groupBy(group).agg(F.count_if("is_anchor").alias("anchors"), F.count_if(F.col("is_result") & F.col("result_primitive").startswith("attached-")).alias("results"))
    attached = attached.where("results > 0").select(group, F.lit("attached-results").alias("primitive"), "anchors", "results")
    return drawn.unionByName(attached)


def primary_mode(layer_rows: DataFrame, group: str) -> DataFrame:
    """(group, mode): what a map mainly shows."""
    has = lambda p: F.max(F.col("primitive") == p)
    flags = layer_rows.groupBy(group).agg(
        has("classified-area-layer").alias("_classes"), has("raster-layer").alias("_raster"), has("route-or-flow-layer").alias("_lines"), has("region-layer").alias("_areas"), has("point-layer").alias("_points")
    )
    c = F.col
    mode = (
        F.when(c("_classes"), "classified-map").when(c("_raster"), "raster-map").when(c("_lines"), "route-map").when(c("_areas"), "regional-map").when(c("_points"), "point-map").otherwise("spatial-overview")
    )
    return flags.select(group, mode.alias("mode"))


def diagnostics(rows: DataFrame, group: str) -> DataFrame:
    """Counts of anchors and results by what can be drawn, warnings and status of each project's map."""
    a, r = F.col("is_anchor"), F.col("is_result")
    out = rows.groupBy(group).agg(
        F.count_if(a).alias("anchors"), F.count_if(a & F.col("located")).alias("renderable_anchors"), F.count_if(r).alias("results"),
        F.count_if(r & (F.col("renderability") == "renderable-now")).alias("renderable_results"), F.count_if(r & F.col("result_primitive").startswith("attached-")).alias("attached_results"),
        F.count_if(r & (F.col("renderability") == "requires-code-execution")).alias("blocked_results"),
    )
    c = F.col
    warnings = (c("renderable_anchors") == 0).cast("int") + ((c("results") > 0) & (c("renderable_results") == 0) & (c("attached_results") == 0)).cast("int") + (c("blocked_results") > 0).cast("int")
    return out.withColumn("warnings", warnings).withColumn("status", F.when(warnings > 0, "needs_review").otherwise("ready"))


def bind_attachments(attachments: DataFrame, results: DataFrame, group: str, candidates: list[str]) -> DataFrame:
    """Adds ``result_id``: the first of an attachment's explicit ids (columns in order) that is a result of its group; never by caption."""
    each = attachments.select(group, "attachment_id", F.posexplode(F.array(*candidates)).alias("pos", "result_id")).where("result_id is not null and result_id != ''")
    known = each.join(results.select(group, F.col("id").alias("result_id")).distinct(), [group, "result_id"], "left_semi")
    first = known.groupBy(group, "attachment_id").agg(F.min_by("result_id", "pos").alias("result_id"))
    return attachments.join(first, [group, "attachment_id"], "left")


def accepted_hints(hints: DataFrame, profile: DataFrame, group: str) -> DataFrame:
    """Display hints (group, hint_id, field) whose field exists; others are rejected."""
    return hints.join(profile.select(group, "field").distinct(), [group, "field"], "left_semi")
