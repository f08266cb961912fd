"""Routes and evidence graphs of a source: stages in order, text-overlap links, duplicates among visuals, resources, facets, issues.

Similarity links are joins of tokens within a group (an inverted index), never a comparison of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinweave.functions.text import significant_tokens

# Stages and the categories that belong to each.
STAGE_ORDER = {"data": 10, "method": 20, "execution": 30, "resource": 35, "context": 40, "evidence": 50}
_STAGES = {
    "data": "data observation earth-variable", "method": "modeling method", "execution": "computing workflow process", "resource": "resource platform dependency code technical",
    "context": "earth-system earth-object spatial system hazard risk exposure infrastructure human-activity scenario", "evidence": "model-output evidence knowledge feedback",
}
STAGE_BY_CATEGORY = {c: s for s, cs in _STAGES.items() for c in cs.split()}
GENERIC = ("data", "dataset", "method", "model", "result", "results", "workflow", "evidence", "unknown", "untitled")


def stage_of(category: Column) -> Column:
    """Stage of a category; null if it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_BY_CATEGORY.items() for x in kv]), category)


def informative(label: Column) -> Column:
    """Whether a label says more than the kind of thing it stands for."""
    clean = F.lower(F.trim(label))
    return F.coalesce((F.length(clean) > 2) & ~clean.isin(*GENERIC) & clean.rlike("[a-z]"), F.lit(False))


def route_nodes(objects: DataFrame, group: str, most: int = 12) -> DataFrame:
    """Nodes of each group's route: informative objects (id, label, category) by stage and label, each label once, at most ``most``."""
    rows = objects.withColumn("stage", stage_of(F.col("category"))).where(F.col("stage").isNotNull() & informative(F.col("label")))
    order = F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_ORDER.items() for x in kv]), F.col("stage"))
    rows = rows.withColumn("stage_order", order)
    once = rows.groupBy(group, "stage", "stage_order", F.lower(F.trim("label")).alias("_k")).agg(F.min(F.struct("label", "id")).alias("m"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy("stage_order", "m.label", "m.id"))
    return once.select(group, "stage", "stage_order", F.col("m.label").alias("label"), F.col("m.id").alias("id"), rank.alias("pos")).where(F.col("pos") <= most)


def route_edges(nodes: DataFrame, group: str) -> DataFrame:
    """Edges between consecutive nodes of routes that have two and more."""
    w = Window.partitionBy(group).orderBy("pos")
    return nodes.select(group, F.col("id").alias("from_id"), F.lead("id").over(w).alias("to_id"), F.col("stage").alias("from_stage"), F.lead("stage").over(w).alias("to_stage")).where("to_id is not null")


def route_quality(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes, stages and level of each route."""
    out = nodes.groupBy(group).agg(F.count("*").alias("nodes"), F.countDistinct("stage").alias("stages"))
    level = F.when((F.col("nodes") >= 3) & (F.col("stages") >= 3), "content").when(F.col("nodes") >= 2, "partial").otherwise("limited")
    return out.withColumn("level", level)


def overlap_links(left: DataFrame, right: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, from_id, to_id, overlap) of texts (group, id, text) that share enough significant tokens by the smaller number."""
    a = left.select(group, F.col("id").alias("from_id"), significant_tokens(F.col("text")).alias("ts"))
    b = right.select(group, F.col("id").alias("to_id"), significant_tokens(F.col("text")).alias("ts"))
    a = a.select(group, "from_id", F.size("ts").alias("na"), F.explode("ts").alias("t"))
    b = b.select(group, "to_id", F.size("ts").alias("nb"), F.explode("ts").alias("t"))
    hit = a.join(b, [group, "t"]).where("from_id != to_id").groupBy(group, "from_id", "to_id", "na", "nb").agg(F.count("*").alias("shared"))
    return hit.select(group, "from_id", "to_id", F.round(F.col("shared") / F.least("na", "nb"), 6).alias("overlap")).where(F.col("overlap") >= threshold)


def evidence_graph(claims: DataFrame, visuals: DataFrame, resources: DataFrame, group: str) -> DataFrame:
    """Edges from claims to visuals (from 0.16 on) and to resources (from 0.14 on)."""
    v = overlap_links(claims, visuals, group, 0.16).select("*", F.lit("supported_by").alias("label"), F.lit(0.7).alias("confidence"))
    r = overlap_links(claims, resources, group, 0.14).select("*", F.lit("grounded_in").alias("label"), F.lit(0.6).alias("confidence"))
    return v.unionByName(r).dropDuplicates([group, "from_id", "to_id", "label"])


def dedupe_visuals(visuals: DataFrame, group: str, threshold: float = 0.65) -> DataFrame:
    """Visuals (group, id, pos, label, text) without those like an earlier one of the group: equal label, or captions that overlap."""
    pairs = overlap_links(visuals, visuals, group, threshold)
    at = visuals.select(group, "id", "pos")
    later = pairs.join(at.select(group, F.col("id").alias("from_id"), F.col("pos").alias("p1")), [group, "from_id"]).join(
        at.select(group, F.col("id").alias("to_id"), F.col("pos").alias("p2")), [group, "to_id"]
    )
    same = Window.partitionBy(group, F.lower(F.trim("label"))).orderBy("pos", "id")
    first = visuals.withColumn("_rn", F.row_number().over(same)).where(F.col("_rn").eqNullSafe(1) | F.col("label").isNull() | (F.trim("label") == "")).drop("_rn")
    gone = later.where("p2 < p1 or (p2 = p1 and to_id < from_id)").select(group, F.col("from_id").alias("id")).distinct()
    return first.join(gone, [group, "id"], "left_anti")


def facet_coverage(expected: DataFrame, covered: DataFrame, group: str) -> DataFrame:
    """Expected facets of each group, how many are covered, the share in percent and the level."""
    have = covered.select(group, "facet", F.lit(1).alias("has")).distinct()
    out = expected.select(group, "facet").distinct().join(have, [group, "facet"], "left").groupBy(group).agg(F.count("*").alias("expected"), F.count("has").alias("covered"))
    score = F.floor(F.col("covered") * 100 / F.col("expected") + 0.5)
    return out.withColumn("score", score).withColumn("level", F.when(score >= 80, "complete").when(score >= 50, "partial").otherwise("weak"))


def integrity_issues(sources: DataFrame) -> DataFrame:
    """(source_id, issue, severity) of extractions; needs method, content_level, n_capability, n_world, n_evidence, n_relations."""
    c = F.col
    rule = lambda cond, name, sev: F.when(cond, F.struct(F.lit(name).alias("issue"), F.lit(sev).alias("severity")))
    found = F.array_compact(
        F.array(
            rule(c("method") == "metadata", "metadata_only_extraction", "warning"), rule(c("content_level").isin("metadata_only", "abstract_only"), "limited_content", "warning"),
            rule(c("n_capability") + c("n_world") == 0, "no_objects", "error"), rule(c("n_evidence") == 0, "no_evidence", "warning"), rule(c("n_relations") == 0, "no_relations", "info"),
        )
    )
    return sources.select("source_id", F.explode(found).alias("x")).select("source_id", "x.*")


def resource_links(nodes: DataFrame, resources: DataFrame, group: str) -> DataFrame:
    """(group, url, node_id, label): resources (group, url, kind) joined to the route nodes of the stages that their kind serves.

    Kinds and stages are both few, so each side is joined on (group, stage) after the kind is unfolded to its stages.
    """
    kind = F.lower("kind")
    stages = F.array_compact(
        F.array(
            F.when(kind.isin("dataset", "data"), F.lit("data")), F.when(kind.isin("repository", "code", "software"), F.lit("method")),
            F.when(kind.isin("repository", "code", "software"), F.lit("execution")), F.when(kind.isin("source", "paper", "doi", "supplement"), F.lit("evidence")),
        )
    )
    r = resources.select(group, "url", kind.alias("kind"), F.explode(stages).alias("stage")).distinct()
    label = (
        F.when(F.col("stage") == "data", "provides_input").when(F.col("stage").isin("method", "execution"), F.when(F.col("kind") == "repository", "may_implement").otherwise("supports_method"))
        .when(F.col("stage") == "evidence", "supports_evidence").otherwise("relates_to")
    )
    return r.join(nodes.select(group, "stage", F.col("id").alias("node_id")), [group, "stage"]).select(group, "url", "node_id", label.alias("label"))


def resource_coverage(resources: DataFrame, links: DataFrame, group: str) -> DataFrame:
    """Resources of each group, how many are linked, the share in percent and the level."""
    linked = links.select(group, "url").distinct().withColumn("has", F.lit(1))
    out = resources.select(group, "url").distinct().join(linked, [group, "url"], "left").groupBy(group).agg(F.count("*").alias("resources"), F.count("has").alias("linked"))
    score = F.floor(F.col("linked") * 100 / F.col("resources") + 0.5)
    return out.withColumn("score", score).withColumn("level", F.when(score >= 80, "complete").when(score >= 45, "partial").otherwise("weak"))


def limitations(sources: DataFrame) -> DataFrame:
    """(source_id, limitation, severity) that follow from what an extraction lacks; needs n_world, n_capability, n_evidence, n_relations, deep."""
    c = F.col
    rule = lambda cond, name, sev: F.when(cond, F.struct(F.lit(name).alias("limitation"), F.lit(sev).alias("severity")))
    found = F.array_compact(
        F.array(
            rule(c("n_world") == 0, "spatial-context", "warning"), rule(c("n_capability") == 0, "method-route", "warning"), rule(c("n_evidence") == 0, "evidence-chain", "info"),
            rule(c("n_relations") == 0, "relations", "info"), rule(~c("deep"), "llm-extraction", "info"),
        )
    )
    return sources.select("source_id", F.explode(found).alias("x")).select("source_id", "x.*")
