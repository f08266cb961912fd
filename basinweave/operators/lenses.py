"""Views of a project's entities: map, evidence, workflow, timeline and comparison, and which of them suits a project.

Every view is a transformation of three tables: ``members`` (project_id, id, pos), current entities with ``type_layer`` and
``type_category``, and triples. Signals are boolean columns, so a view is a filter and an aggregate, never a loop over entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basinweave.functions.js import any_attr, attr, has_attr
from basinweave.operators.graph import display_name
from basinweave.session import stable

# Fixed values.
WORKFLOW_CATEGORIES = ("data", "modeling", "computing", "process", "method")
EVIDENCE_RELATIONS = ("supports", "supports_claim", "contradicts")
WORKFLOW_RELATIONS = ("uses", "applies", "produces", "implements", "depends_on", "trained_on")
SUPPORT_RELATIONS = ("supports", "supported_by", "contradicts", "derives_from", "refines", "based_on")
PROCESSING_CATEGORIES = ("modeling", "computing", "process", "method")
INPUT_CATEGORIES = ("data", "resource", "observation")
INPUT_USE_RELATIONS = ("uses", "applies", "trained_on", "depends_on")
OUTPUT_RELATIONS = ("produces", "generates", "outputs")
LENS_PRIORITY = ("map", "workflow", "evidence", "comparison", "timeline")


def project_members(projects: DataFrame) -> DataFrame:
    """(project_id, id, pos) of each project's latest row; nulls and repeated entries are left out."""
    from basinweave.operators.nested import latest_rows

    current = latest_rows(projects.select("id", "updated_at", "entities"), "id", "updated_at", "entities")
    each = current.select(F.col("id").alias("project_id"), F.posexplode("entities").alias("pos", "raw"))
    each = each.select("project_id", F.lower(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("id"), "pos").where("id is not null and id != ''")
    return each.groupBy("project_id", "id").agg(F.min("pos").alias("pos"))


def member_entities(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Existing entities of each project."""
    return members.join(entities.drop("project_id"), "id")


# --- signals ---------------------------------------------------------------------------------------------------------------


def spatial_signal() -> Column:
    return any_attr("geometry", "bbox", "centroid", "location", "spatialCoverage")


def temporal_signal() -> Column:
    return any_attr("year", "date", "time", "start", "end", "temporalCoverage")


def evidence_signal() -> Column:
    return any_attr("statement", "claim", "evidence", "confidence")


def workflow_signal() -> Column:
    return any_attr("inputs", "outputs", "steps", "parameters", "dependencies")


def edge_flags(triples: DataFrame) -> DataFrame:
    """One row per entity end: relations in and out and the predicates that views ask for; partial counts before the shuffle."""
    out = triples.select(F.col("subject").alias("id"), "predicate", F.lit(True).alias("o"))
    inc = triples.select(F.col("object").alias("id"), "predicate", F.lit(False).alias("o"))
    p, o = F.col("predicate"), F.col("o")
    return out.unionByName(inc).groupBy("id").agg(
        F.count_if(o).alias("n_out"),
        F.count_if(~o).alias("n_in"),
        F.max(o & p.isin(*EVIDENCE_RELATIONS)).alias("out_evidence"),
        F.max(o & p.isin(*WORKFLOW_RELATIONS)).alias("out_workflow"),
        F.max(o & (p == "produces")).alias("out_produces"),
        F.max(o & p.isin("uses", "provides")).alias("out_uses"),
        F.max(~o & (p == "produces")).alias("in_produces"),
        F.max(~o & p.isin(*SUPPORT_RELATIONS)).alias("in_support"),
    )


def with_edges(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities with ``edge_flags``; without relations all are 0 or false."""
    flags = edge_flags(triples)
    fill = {"n_out": 0, "n_in": 0} | {c: False for c in flags.columns if c.startswith(("out_", "in_"))}
    return entities.join(flags, "id", "left").fillna(fill)


# --- recommendation --------------------------------------------------------------------------------------------------------


def lens_scores(members: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Score of every view per project."""
    rows = member_entities(members, with_edges(entities, triples))
    n = lambda c: c.cast("int")
    cat, layer = F.col("type_category"), F.col("type_layer")
    related = (F.col("n_out") + F.col("n_in")) > 0
    return rows.groupBy("project_id").agg(
        F.sum(3 * n(spatial_signal()) + n(layer == "world")).alias("map"),
        F.sum(3 * n(cat.isin("evidence", "knowledge")) + n(evidence_signal()) + 2 * n(F.col("out_evidence"))).alias("evidence"),
        F.sum(2 * n(cat.isin(*WORKFLOW_CATEGORIES)) + n(workflow_signal()) + 2 * n(F.col("out_workflow"))).alias("workflow"),
        (F.sum(n(related)) + n(F.count("*") > 1)).alias("comparison"),
        F.sum(2 * n(temporal_signal())).alias("timeline"),
    )


def recommended_lens(members: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(project_id, lens): the view with the highest score, ties by priority; 'workflow' for projects without entities."""
    scores = lens_scores(members, entities, triples)
    best = F.greatest(*LENS_PRIORITY)
    pick = F.coalesce(*[F.when(F.col(name) == best, F.lit(name)) for name in LENS_PRIORITY])
    chosen = scores.select("project_id", pick.alias("lens"))
    return members.select("project_id").distinct().join(chosen, "project_id", "left").select("project_id", F.coalesce("lens", F.lit("workflow")).alias("lens"))


# --- graph and metadata ----------------------------------------------------------------------------------------------------


def project_graph(members: DataFrame, triples: DataFrame) -> DataFrame:
    """Edges with both ends in the project."""
    a = members.select("project_id", F.col("id").alias("subject"))
    b = members.select("project_id", F.col("id").alias("object"))
    return triples.join(a, "subject").join(b, ["project_id", "object"]).select("project_id", "subject", "predicate", "object", "confidence")


def project_metadata(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities per project, type and category."""
    return member_entities(members, entities).groupBy("project_id", "type", "type_category").agg(F.count("*").alias("n"))


# --- map -------------------------------------------------------------------------------------------------------------------


def geometry_kind() -> Column:
    """Which attribute gives the geometry, in order of precedence; null if none does."""
    coverage = attr("spatialCoverage")
    four = lambda c: F.coalesce(F.json_array_length(c) >= 4, F.lit(False))
    point = lambda name: has_attr(name)
    return (
        F.when(has_attr("geometry"), "geometry")
        .when(four(attr("bbox")), "bbox")
        .when(point("centroid"), "centroid")
        .when(point("location"), "location")
        .when(four(coverage), "coverage")
        .when(F.lower(coverage) == "global", "global")
    )


def bbox() -> Column:
    """Bounding box (min_lon, min_lat, max_lon, max_lat) of the geometry that ``geometry_kind`` chose, as a struct of doubles."""
    kind = geometry_kind()
    numbers = lambda c: F.from_json(c, "array<double>")
    box = lambda a: F.struct(*[F.get(a, i).alias(n) for i, n in enumerate(("min_lon", "min_lat", "max_lon", "max_lat"))])
    point = lambda c: F.coalesce(numbers(c), numbers(F.get_json_object(c, "$.coordinates")))
    dot = lambda a: F.struct(F.get(a, 0).alias("min_lon"), F.get(a, 1).alias("min_lat"), F.get(a, 0).alias("max_lon"), F.get(a, 1).alias("max_lat"))
    # coordinates of any depth: all numbers of the text, longitudes at even places
    raw = F.regexp_extract_all(F.get_json_object(attr("geometry"), "$.coordinates"), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"), F.lit(1))
    values = F.transform(raw, lambda x: x.cast("double"))
    lon, lat = F.filter(values, lambda x, i: i % 2 == 0), F.filter(values, lambda x, i: i % 2 == 1)
    geo = F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"))
    return (
        F.when(kind == "geometry", geo)
        .when(kind == "bbox", box(numbers(attr("bbox"))))
        .when(kind == "centroid", dot(point(attr("centroid"))))
        .when(kind == "location", dot(point(attr("location"))))
        .when(kind == "coverage", box(numbers(attr("spatialCoverage"))))
        .when(kind == "global", F.struct(F.lit(-180.0).alias("min_lon"), F.lit(-90.0).alias("min_lat"), F.lit(180.0).alias("max_lon"), F.lit(90.0).alias("max_lat")))
    )


def map_features(entities: DataFrame) -> DataFrame:
    """Entities with a geometry: kind of geometry and bounding box."""
    rows = entities.withColumn("geometry_from", geometry_kind()).where("geometry_from is not null").withColumn("box", bbox())
    return rows.select("*", "box.*").drop("box")


def map_bounds(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Bounds, features, regions (of the world layer) and layers of each project's map."""
    rows = member_entities(members, map_features(entities))
    return rows.groupBy("project_id").agg(
        F.count("*").alias("features"),
        F.count_if(F.col("type_layer") == "world").alias("regions"),
        F.countDistinct("type_layer").alias("layers"),
        F.min("min_lon").alias("min_lon"), F.min("min_lat").alias("min_lat"), F.max("max_lon").alias("max_lon"), F.max("max_lat").alias("max_lat"),
    )


def coverage(members: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(project_id, id, datasets): names of the project's entities that cover each region of its map."""
    regions = member_entities(members, map_features(entities)).where("type_layer = 'world'").select("project_id", "id")
    names = entities.select(F.col("id").alias("subject"), display_name(F.col("name")).alias("dataset"))
    covers = triples.where("predicate = 'covers'").select("subject", F.col("object").alias("id")).distinct()
    inside = members.select("project_id", F.col("id").alias("subject"))
    hit = covers.join(regions, "id").join(inside, ["project_id", "subject"]).join(names, "subject")
    return hit.groupBy("project_id", "id").agg(F.array_join(F.array_sort(F.collect_list("dataset")), "; ").alias("datasets"))


# --- evidence --------------------------------------------------------------------------------------------------------------


def evidence_claims(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Claims: entities of the category evidence that state something, and all others that anything supports."""
    stated = any_attr("statement", "claim", "hypothesis", "conclusion", "assertion")
    is_claim = F.when(F.col("type_category") == "evidence", stated).otherwise(F.col("in_support"))
    return with_edges(entities, triples).where(is_claim)


def support_edges(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(subject, id, predicate): what supports, or speaks against, what; ends that are no entities are left out."""
    known = entities.select(F.col("id").alias("subject"))
    support = triples.where(F.col("predicate").isin(*SUPPORT_RELATIONS)).select("subject", F.col("object").alias("id"), "predicate").distinct()
    return support.join(known, "subject", "left_semi")


def evidence_chains(claims: DataFrame, entities: DataFrame, triples: DataFrame, max_depth: int = 5) -> DataFrame:
    """(id, depth, supporters): length of the longest chain of incoming support, up to ``max_depth`` steps, and the number of direct
    supporters. A chain ends at an entity that it has already passed.

    Worked from the far end: the nodes that have a chain of k steps are those with a supporter that has one of k - 1 steps, so a
    round is one semi join of the support edges and nothing grows with the number of paths. Only where edges are left after
    ``max_depth`` rounds of taking off those that nothing leads to or away from, which may form cycles, the paths of the entities
    that come out at the bound are followed one by one.
    """
    support = stable(support_edges(entities, triples).select("subject", "id").distinct())
    counts = support.groupBy("id").agg(F.count("*").alias("supporters"))
    others = support.where("subject != id")
    level = counts.select("id")
    depths = level.select("id", F.lit(1).alias("depth"))
    for k in range(2, max_depth + 1):
        level = others.join(level.select(F.col("id").alias("subject")), "subject", "left_semi").select("id").distinct()
        depths = depths.unionByName(level.select("id", F.lit(k).alias("depth")))
    depth = depths.groupBy("id").agg(F.max("depth").alias("depth"))
    core = others
    for _ in range(max_depth):
        inner = core.join(core.select(F.col("id").alias("subject")), "subject", "left_semi").join(core.select(F.col("subject").alias("id")), "id", "left_semi")
        core = stable(inner)
        if core.isEmpty():
            break
    else:
        at_bound = claims.select("id").join(depth.where(F.col("depth") == max_depth), "id", "left_semi").select("id")
        front = at_bound.select(F.col("id").alias("start"), "id", F.array("id").alias("passed")).distinct()
        followed = front.select("start", F.lit(1).alias("depth"))
        going = others.join(counts.select(F.col("id").alias("subject")), "subject", "left_semi")
        for k in range(2, max_depth + 1):
            step = front.join(going, "id").where(~F.array_contains("passed", F.col("subject")))
            front = stable(step.select("start", F.col("subject").alias("id"), F.array_sort(F.array_append("passed", F.col("subject"))).alias("passed")).distinct())
            followed = followed.unionByName(front.select("start", F.lit(k).alias("depth")))
        exact = followed.groupBy(F.col("start").alias("id")).agg(F.max("depth").alias("exact"))
        depth = depth.join(exact, "id", "left").select("id", F.coalesce("exact", "depth").alias("depth"))
    return claims.select("id").join(depth, "id", "left").join(counts, "id", "left").fillna({"depth": 0, "supporters": 0})


def stated_confidence() -> Column:
    """Confidence of an entity as a view takes it: the attribute's, else its own, else one half; 0 counts as none."""
    stated = F.nullif(F.expr("try_cast(get_json_object(attributes, '$.confidence') as double)"), F.lit(0.0))
    return F.coalesce(stated, F.nullif("confidence", F.lit(0.0)), F.lit(0.5))


def evidence_summary(members: DataFrame, claims: DataFrame, chains: DataFrame) -> DataFrame:
    """Per project: claims, those with and without evidence, mean depth and confidence."""
    rows = members.select("project_id", "id").join(claims.select("id", stated_confidence().alias("confidence")), "id").join(chains, "id")
    return rows.groupBy("project_id").agg(
        F.count("*").alias("claims"), F.count_if(F.col("supporters") > 0).alias("complete"), F.count_if(F.col("supporters") == 0).alias("unconnected"),
        F.round(F.avg("depth"), 6).alias("avg_depth"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
    )


def evidence_graph(members: DataFrame, claims: DataFrame, entities: DataFrame, triples: DataFrame, max_depth: int = 5) -> DataFrame:
    """(project_id, source, relation, target): the edges of all chains of the claims of each project, once each."""
    support = support_edges(entities, triples)
    front = members.select("project_id", "id").join(claims.select("id"), "id", "left_semi").distinct()
    seen, edges = front, None
    for _ in range(max_depth):
        step = front.join(support, "id").select("project_id", F.col("subject").alias("source"), F.col("predicate").alias("relation"), F.col("id").alias("target"))
        edges = step if edges is None else edges.unionByName(step)
        front = step.select("project_id", F.col("source").alias("id")).distinct().join(seen, ["project_id", "id"], "left_anti")
        seen = seen.unionByName(front)
    return edges.distinct()


def claim_issues(claims: DataFrame) -> DataFrame:
    """(id, issue) of claims: no evidence, low confidence, not verified. Needs ``supporters`` and the entity's columns."""
    confidence = F.coalesce(F.nullif(F.expr("try_cast(get_json_object(attributes, '$.confidence') as double)"), F.lit(0.0)), F.nullif("confidence", F.lit(0.0)), F.lit(0.5))
    found = F.array_compact(
        F.array(
            F.when(F.col("supporters") == 0, F.lit("missing_evidence")),
            F.when(confidence < 0.5, F.lit("low_confidence")),
            F.when(F.coalesce("verification_state", F.lit("extracted")) == "extracted", F.lit("unverified")),
        )
    )
    return claims.select("id", F.explode(found).alias("issue"))


# --- workflow --------------------------------------------------------------------------------------------------------------


def workflow_stage() -> Column:
    """Stage of an entity that has ``edge_flags``: output, experiment, processing or input."""
    cat = F.col("type_category")
    keys = F.coalesce(F.json_object_keys("attributes"), F.array().cast("array<string>"))
    has_key = lambda n: F.array_contains(keys, n)
    return (
        F.when(has_key("result") | has_key("value") | has_key("metric") | F.col("in_produces"), "output")
        .when(any_attr("experiment", "trial", "scenario") | (cat == "assessment"), "experiment")
        .when(cat.isin(*PROCESSING_CATEGORIES) | any_attr("steps", "parameters") | F.col("out_produces"), "processing")
        .when(cat.isin(*INPUT_CATEGORIES) | F.col("out_uses"), "input")
        .when((F.col("n_in") > 0) & (F.col("n_out") == 0), "output")
        .when((F.col("n_out") > 0) & (F.col("n_in") == 0), "input")
        .otherwise("processing")
    )


def workflow_stages(members: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """Entities per project and stage."""
    staged = with_edges(entities, triples).select("id", workflow_stage().alias("stage"))
    return members.join(staged, "id").groupBy("project_id", "stage").agg(F.count("*").alias("n"))


#: Stages of a workflow in order.
STAGES = ("input", "processing", "experiment", "output")


def workflow_pipeline(members: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(project_id, position, stage, id, depends_on): the stages of each project in order with their entities, and the number of members
    that an entity leads to; within a stage those that lead to fewer come first, so that what others rest on stands before them."""
    staged = with_edges(entities, triples).select("id", workflow_stage().alias("stage"))
    own = members.select("project_id", "id").distinct()
    edges = triples.select("subject", "object").distinct()
    out = own.join(edges.withColumnRenamed("subject", "id"), "id").join(own.withColumnRenamed("id", "object"), ["project_id", "object"], "left_semi")
    degree = out.where("id != object").groupBy("project_id", "id").agg(F.count("*").alias("depends_on"))
    rows = own.join(staged, "id").join(degree, ["project_id", "id"], "left")
    position = F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")) - 1
    return rows.select("project_id", position.cast("int").alias("position"), "stage", "id", F.coalesce("depends_on", F.lit(0)).alias("depends_on"))


def data_flows(inputs: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(input, user, output, used_by): two-step flows from inputs over their users to what those bring forth (output may be null)."""
    ids = entities.select("id").distinct()
    use = triples.where(F.col("predicate").isin(*INPUT_USE_RELATIONS)).select(F.col("object").alias("input"), F.col("subject").alias("user"), F.col("predicate").alias("used_by"))
    use = use.join(inputs.select(F.col("id").alias("input")), "input", "left_semi").join(ids.select(F.col("id").alias("user")), "user", "left_semi")
    make = triples.where(F.col("predicate").isin(*OUTPUT_RELATIONS)).select(F.col("subject").alias("user"), F.col("object").alias("output"))
    make = make.join(ids.select(F.col("id").alias("output")), "output", "left_semi")
    return use.join(make, "user", "left").select("input", "user", "output", "used_by")


# --- timeline --------------------------------------------------------------------------------------------------------------


def year_of(c: Column) -> Column:
    """First four digits of a text."""
    return F.nullif(F.regexp_extract(c, "([0-9]{4})", 1), F.lit("")).cast("int")


def time_range() -> Column:
    """(start, end) years of an entity: its year, else start and end, else its coverage, else a date; null if it has none."""
    cov = F.coalesce(F.nullif(attr("temporalCoverage"), F.lit("")), F.nullif(attr("temporalSpan"), F.lit("")))
    pair = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    first, second = F.get(F.regexp_extract_all(cov, F.lit("([0-9]{4})"), F.lit(1)), 0), F.get(F.regexp_extract_all(cov, F.lit("([0-9]{4})"), F.lit(1)), 1)
    point = F.coalesce(*[F.nullif(attr(n), F.lit("")) for n in ("date", "time", "timestamp", "publishedAt", "createdAt", "updatedAt")])
    return (
        F.when(has_attr("year"), pair(year_of(attr("year")), year_of(attr("year"))))
        .when(any_attr("start", "end"), pair(year_of(attr("start")), year_of(F.coalesce(F.nullif(attr("end"), F.lit("")), attr("start")))))
        .when(cov.isNotNull(), pair(first, F.coalesce(second, first)))
        .when(point.isNotNull(), pair(year_of(point), year_of(point)))
    )


def timeline_events(entities: DataFrame) -> DataFrame:
    """Entities with a time: start and end year (null where the text has no year)."""
    return entities.withColumn("_t", time_range()).where("_t is not null").select("*", "_t.start", "_t.end").drop("_t")


def timeline_decades(members: DataFrame, entities: DataFrame) -> DataFrame:
    """Events per project and decade, with the number of types; decades without events are left out."""
    rows = members.join(timeline_events(entities).select("id", "type", "start", "end"), "id").where("start is not null")
    decade = (F.floor(F.col("start") / 10) * 10).cast("int")
    return rows.groupBy("project_id", decade.alias("decade")).agg(F.count("*").alias("events"), F.countDistinct("type").alias("types"), F.min("start").alias("first"), F.max("start").alias("last"))


# --- comparison ------------------------------------------------------------------------------------------------------------


def comparable_scope(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(project_id, scope, n): the largest type of a project if it has two entities, else the largest layer and category, else all."""
    rows = member_entities(members, entities)
    by_type = rows.groupBy("project_id", F.col("type").alias("k")).agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    by_cat = rows.groupBy("project_id", F.concat_ws(":", "type_layer", "type_category").alias("k")).agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    top = lambda df, name: df.groupBy("project_id").agg(F.max(F.struct("n", (-F.col("p")).alias("p"), "k")).alias(name))
    both = top(by_type, "t").join(top(by_cat, "c"), "project_id").join(rows.groupBy("project_id").agg(F.count("*").alias("all")), "project_id")
    return both.select(
        "project_id",
        F.when(F.col("t.n") >= 2, F.col("t.k")).when(F.col("c.n") >= 2, F.col("c.k")).otherwise(F.lit("all")).alias("scope"),
        F.when(F.col("t.n") >= 2, F.col("t.n")).when(F.col("c.n") >= 2, F.col("c.n")).otherwise(F.col("all")).alias("n"),
    )


def attribute_rows(entities: DataFrame) -> DataFrame:
    """(id, attribute, value) of all attributes, values as JSON text."""
    each = entities.select("id", "attributes", F.explode(F.json_object_keys("attributes")).alias("attribute"))
    return each.select("id", "attribute", F.expr("get_json_object(attributes, concat('$[\\'', attribute, '\\']'))").alias("value"))


def first_two_differences(members: DataFrame, entities: DataFrame) -> DataFrame:
    """(project_id, attribute, left, right): attributes in which the first two entities of a project differ."""
    order = Window.partitionBy("project_id").orderBy("pos", "id")
    two = member_entities(members, entities).withColumn("rn", F.row_number().over(order)).where("rn <= 2")
    pair = two.groupBy("project_id").agg(F.max(F.when(F.col("rn") == 1, F.col("id"))).alias("a"), F.max(F.when(F.col("rn") == 2, F.col("id"))).alias("b")).where("b is not null")
    rows = attribute_rows(entities)
    left = pair.select("project_id", F.col("a").alias("id")).join(rows, "id").select("project_id", "attribute", F.col("value").alias("left"))
    right = pair.select("project_id", F.col("b").alias("id")).join(rows, "id").select("project_id", "attribute", F.col("value").alias("right"))
    return left.join(right, ["project_id", "attribute"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def metrics(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(id, metric, value, relation): metrics that entities are evaluated by or that they outperform."""
    target = entities.select(F.col("id").alias("object"), display_name(F.col("name")).alias("metric"), attr("value").alias("value"))
    own = entities.select(F.col("id").alias("subject"))
    edges = triples.where(F.col("predicate").isin("evaluated_by", "outperforms")).select("subject", "object", F.col("predicate").alias("relation"))
    return edges.join(own, "subject", "left_semi").join(target, "object").select(F.col("subject").alias("id"), "metric", "value", "relation")
