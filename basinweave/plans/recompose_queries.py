"""Queries of routes, evidence graphs, map recomposition, citations and the activated vocabulary, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.functions.js import attr
from basinweave.operators import admission, citations, graph, lenses, ontology, recompose, registry, routes, state
from basinweave.plans.content_queries import _ADMIT, _P, _papers, _tok, sources
from basinweave.plans.graph_queries import E, T, _values
from basinweave.plans.lens_queries import _LE, _M, _NAME, _has, _in
from basinweave.session import table


def _members(spark, d):
    e = ontology.with_layers(graph.latest_entities(table(spark, d, "entities"), "type", "name", "attributes"), table(spark, d, "ontology_types"))
    return lenses.member_entities(lenses.project_members(table(spark, d, "projects")), e)


def _objects(spark, d):
    return _members(spark, d).select("project_id", "id", graph.display_name(F.col("name")).alias("label"), F.col("type_category").alias("category"))


def n_route_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Route of each project: nodes in order of their stages."""
    return routes.route_nodes(_objects(spark, d), "project_id")


def n_route_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the routes by the stages that they join."""
    return routes.route_edges(routes.route_nodes(_objects(spark, d), "project_id"), "project_id").groupBy("from_stage", "to_stage").agg(F.count("*").alias("n"))


def n_route_quality(spark: SparkSession, d: str) -> DataFrame:
    """Projects by the level of their route."""
    q = routes.route_quality(routes.route_nodes(_objects(spark, d), "project_id"), "project_id")
    return q.groupBy("level").agg(F.count("*").alias("projects"), F.sum("nodes").alias("nodes"))


def n_evidence_graph(spark: SparkSession, d: str) -> DataFrame:
    """Links from claims to datasets and papers of the same project whose texts overlap."""
    m = _members(spark, d)
    claims = m.where("type = 'Claim'").select("project_id", "id", attr("statement").alias("text"))
    visuals = m.where("type = 'Evidence'").select("project_id", "id", F.coalesce(attr("statement"), attr("description"), F.col("name")).alias("text"))
    res = m.where("type in ('Dataset', 'Paper')").select("project_id", "id", F.concat_ws(" ", "name", attr("title"), attr("description")).alias("text"))
    return routes.evidence_graph(claims, visuals, res, "project_id").select("project_id", "from_id", "to_id", "label", "overlap")


def n_facets(spark: SparkSession, d: str) -> DataFrame:
    """Share of the six stages that each project's entities cover."""
    o = _objects(spark, d)
    expected = o.select("project_id").distinct().withColumn("facet", F.explode(F.array(*map(F.lit, routes.STAGE_ORDER))))
    covered = o.select("project_id", routes.stage_of(F.col("category")).alias("facet")).where("facet is not null")
    return routes.facet_coverage(expected, covered, "project_id")


def n_map_layers(spark: SparkSession, d: str) -> DataFrame:
    """Layers of each project's map with their anchors and results."""
    return recompose.layers(recompose.classified(_members(spark, d)), "project_id")


def n_map_mode(spark: SparkSession, d: str) -> DataFrame:
    """What each project's map mainly shows."""
    return recompose.primary_mode(recompose.layers(recompose.classified(_members(spark, d)), "project_id"), "project_id")


def n_map_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Counts, warnings and status of each project's map."""
    return recompose.diagnostics(recompose.classified(_members(spark, d)), "project_id")


def n_cite_match(spark: SparkSession, d: str) -> DataFrame:
    """Paper entities and the paper record that their title and year mean."""
    e = graph.latest_entities(table(spark, d, "entities"), "type", "attributes").where("type in ('Paper', 'Preprint')")
    q = e.select(F.col("id").alias("query_id"), attr("title").alias("title"), F.expr("try_cast(get_json_object(attributes, '$.year') as int)").alias("year"))
    return citations.match_titles(q, _papers(spark, d).select(F.col("paper_id").alias("record_id"), "title", "year")).select("query_id", "score")


def n_input_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Inputs of sources by what they look like."""
    return sources(spark, d).groupBy(citations.input_kind(F.col("input")).alias("kind")).agg(F.count("*").alias("n"))


def n_activated_types(spark: SparkSession, d: str) -> DataFrame:
    """Types that sources of each kind activate: sources and primary types per layer."""
    a = admission.admit(sources(spark, d)).select("source_id", "type", "layers", "categories")
    hit = registry.activated_types(a, table(spark, d, "ontology_types"))
    return hit.groupBy("layer").agg(F.count("*").alias("n"), F.count_if("primary").alias("n_primary"), F.countDistinct("source_id").alias("n_sources"))


def n_allowed_relations(spark: SparkSession, d: str) -> DataFrame:
    """Triples by the type of their subject and whether that type's list of relations has the predicate."""
    e = graph.latest_entities(table(spark, d, "entities"), "type").select(F.col("id").alias("subject"), "type")
    t = graph.distinct_triples(table(spark, d, "triples"), "subject", "predicate").select("subject", "predicate")
    rows = t.join(e, "subject").where(F.col("type").isin(list(registry.ALLOWED_RELATIONS)))
    ok = F.array_contains(registry.allowed_relations(F.col("type")), F.col("predicate"))
    return rows.groupBy("type", ok.alias("allowed")).agg(F.count("*").alias("n"))


def n_status_fsm(spark: SparkSession, d: str) -> DataFrame:
    """State of each project's analysis, folded from its phases."""
    rows = table(spark, d, "projects").select("id", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("seq"), "status").where("id is not null").distinct()
    done = F.when(F.col("status") == "completed", "completed").when(F.col("status").isin("failed", "cancelled"), "failed").when(F.col("status") == "analyzing", "started").otherwise("pending")
    progress = rows.select(F.col("id").alias("project_id"), F.lit("analysis").alias("phase"), done.alias("status"), "seq")
    return state.analysis_state(progress).groupBy("state").agg(F.count("*").alias("projects"))


def n_metadata_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects that the metadata arrays of papers name, by type and field."""
    from basinweave.operators import decompose

    meta = F.to_json(F.struct("datasets", F.col("keywords").alias("variables"), F.transform("authors", lambda a: a["affiliation"]).alias("institutions")))
    o = decompose.metadata_objects(_papers(spark, d).select("paper_id", meta.alias("m")), "paper_id", "m")
    return o.groupBy("type", "origin").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.max("pos").alias("last_pos"))


def n_merge_points(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of each venue's papers, merged by their normalised form: the twelve first, with the papers that have each."""
    from basinweave.operators import decompose

    kw = _papers(spark, d).select("venue", F.col("paper_id").alias("source_id"), F.posexplode("keywords").alias("pos", "k")).where("venue is not null and k is not null")
    return decompose.merge_projects(kw, "venue", "k", 12).select("venue", "label", "sources", "rank")


QUERIES = {
    f.__name__: f
    for f in (
        n_metadata_objects, n_merge_points, n_route_nodes, n_route_edges, n_route_quality, n_evidence_graph, n_facets, n_map_layers, n_map_mode, n_map_diagnostics, n_cite_match, n_input_kinds, n_activated_types,
        n_allowed_relations, n_status_fsm,
    )
}

_CAT = _values([(c, s, routes.STAGE_ORDER[s]) for c, s in routes.STAGE_BY_CATEGORY.items()], "c, stage, stage_order")
_OBJ = f"{_LE}, {_M}, cat AS (SELECT * FROM {_CAT}), oj AS (SELECT m.project_id, le.id, {_NAME.replace('name,', 'le.name,').replace('attributes', 'le.attributes').replace(', id)', ', le.id)')} AS label, type_category AS category FROM m JOIN le ON le.id = m.id)"
_ROUTE = f"""{_OBJ}, r0 AS (SELECT oj.*, stage, stage_order FROM oj JOIN cat ON c = category WHERE length(lower(trim(label))) > 2 AND lower(trim(label)) NOT IN {_in(routes.GENERIC)} AND regexp_matches(lower(trim(label)), '[a-z]')),
 r1 AS (SELECT project_id, stage, stage_order, lower(trim(label)) AS k, min((label, id)) AS mn FROM r0 GROUP BY 1, 2, 3, 4), r2 AS (SELECT project_id, stage, stage_order, mn[1] AS label, mn[2] AS id, row_number() OVER (PARTITION BY project_id ORDER BY stage_order, mn[1], mn[2]) AS pos FROM r1),
 rn AS (SELECT * FROM r2 WHERE pos <= 12)"""
_ROUTE = _ROUTE.replace("min((label, id)) AS mn", "min(row(label, id)) AS mn").replace("mn[1]", "mn[1]")
_KIND2 = f"""CASE WHEN {_has('geometry')} THEN 'geometry' WHEN {" OR ".join(f"coalesce(json_array_length(CASE WHEN json_type(attributes, '$.{n}') = 'ARRAY' THEN attributes->'$.{n}' END) >= 4, false)" for n in ("bbox", "spatialCoverage", "bounds"))} THEN 'bbox'
 WHEN {" OR ".join(f"coalesce(json_array_length(CASE WHEN json_type(attributes, '$.{n}') = 'ARRAY' THEN attributes->'$.{n}' WHEN json_type(attributes, '$.{n}.coordinates') = 'ARRAY' THEN attributes->'$.{n}.coordinates' END) >= 2, false)" for n in ("centroid", "location", "coordinates"))} THEN 'point'
 WHEN {_has('region', 'country', 'basin', 'area', 'spatialExtent', 'spatialCoverage')} THEN 'named-scope' ELSE 'none' END"""
_MAP = f"""{_LE}, {_M}, k0 AS (SELECT m.project_id, le.*, {_KIND2} AS sk, {_has(*recompose.TEMPORAL)} AS timed, {_has('value', 'result', 'finding', 'classification', 'riskMap', 'outputs', 'performance', 'trend', 'impact')} AS valued,
 json_extract_string(attributes, '$.geometry.type') AS gt FROM m JOIN le ON le.id = m.id),
 kk AS (SELECT *, sk IN ('geometry', 'bbox', 'point') AS located, type_layer IN ('world', 'domain') OR (type_category IN ('observation', 'data', 'socioeconomic') AND sk <> 'none') AS is_anchor,
 type_category IN {_in(recompose.RESULT_CATEGORIES)} OR type IN {_in(recompose.RESULT_TYPES)} OR {_has('value', 'metric', 'result', 'finding', 'outputs', 'riskMap', 'classification')} AS is_result,
 CASE sk WHEN 'geometry' THEN CASE WHEN gt IN ('Point', 'MultiPoint') THEN 'point-layer' WHEN gt IN ('LineString', 'MultiLineString') THEN 'route-or-flow-layer' ELSE 'region-layer' END WHEN 'bbox' THEN 'region-layer' WHEN 'point' THEN 'point-layer' ELSE 'x' END AS ap,
 CASE WHEN {_has('classification', 'classes', 'riskMap')} THEN 'classified-area-layer' WHEN sk IN ('geometry', 'bbox') THEN 'region-layer' WHEN sk = 'point' THEN 'point-layer' WHEN timed THEN 'attached-time-series' WHEN valued THEN 'attached-chart-or-value' ELSE 'evidence-chain-view' END AS rp,
 CASE WHEN {_has('requiresExecution', 'executionRequired', 'codeRequired')} THEN 'requires-code-execution' WHEN sk IN ('geometry', 'bbox', 'point') THEN 'renderable-now' WHEN timed OR valued THEN 'renderable-as-attachment' ELSE 'not-renderable' END AS ra FROM k0),
 ly AS (SELECT project_id, primitive, sum(a)::BIGINT AS anchors, sum(r)::BIGINT AS results FROM (SELECT project_id, ap AS primitive, 1 AS a, 0 AS r FROM kk WHERE is_anchor AND located UNION ALL SELECT project_id, rp, 0, 1 FROM kk WHERE is_result AND ra = 'renderable-now') WHERE primitive IN {_in(recompose.LAYERS)} GROUP BY 1, 2
 UNION ALL SELECT project_id, 'attached-results', count(*) FILTER (WHERE is_anchor), count(*) FILTER (WHERE is_result AND starts_with(rp, 'attached-')) FROM kk GROUP BY 1 HAVING count(*) FILTER (WHERE is_result AND starts_with(rp, 'attached-')) > 0)"""


def _raw(c: str) -> str:
    """The significant tokens with their repetitions, in order."""
    return _tok(c).removeprefix("list_distinct(").removesuffix(")")


def _links(left: str, right: str, label: str, threshold: float) -> str:
    return f"SELECT project_id, from_id, to_id, '{label}' AS label, overlap FROM (SELECT a.project_id, a.id AS from_id, b.id AS to_id, round(len(list_intersect(a.ts, b.ts)) / least(len(a.ts), len(b.ts)), 6) AS overlap FROM {left} a JOIN {right} b ON b.project_id = a.project_id AND a.id <> b.id WHERE len(a.ts) > 0 AND len(b.ts) > 0 AND len(list_intersect(a.ts, b.ts)) > 0) WHERE overlap >= {threshold}"


ORACLES = {
    "n_input_kinds": rf"WITH {_ADMIT}, x AS (SELECT lower(trim(input)) AS t FROM src) SELECT CASE WHEN regexp_extract(t, '(10\.[0-9]{{4,9}}/[^\s\"<>]+)', 1) <> '' THEN 'doi' WHEN regexp_matches(t, 'github\.com/') THEN 'repository' WHEN regexp_matches(t, '^https?://') THEN 'url' WHEN len(regexp_split_to_array(t, '\s+')) >= 4 AND length(t) >= 20 THEN 'title' ELSE 'unknown' END AS kind, count(*) AS n FROM x GROUP BY 1",
    "n_allowed_relations": f"WITH {E}, {T}, al AS (SELECT * FROM {_values([(t, r) for t, rs in registry.ALLOWED_RELATIONS.items() for r in rs], 'ty, rel')}) SELECT e.type, EXISTS (SELECT 1 FROM al WHERE ty = e.type AND rel = t.predicate) AS allowed, count(*) AS n FROM t JOIN e ON e.id = t.subject WHERE e.type IN (SELECT ty FROM al) GROUP BY 1, 2",
    "n_metadata_objects": f"WITH {_P}, x AS (SELECT 'Dataset' AS type, 'datasets' AS origin, u.d.name AS name, u.i - 1 AS pos FROM p, LATERAL (SELECT unnest(datasets) AS d, generate_subscripts(datasets, 1) AS i) u UNION ALL SELECT 'Variable', 'variables', trim(u.k), u.i - 1 FROM p, LATERAL (SELECT unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i) u UNION ALL SELECT 'Institution', 'institutions', trim(u.a.affiliation), u.i - 1 FROM p, LATERAL (SELECT unnest(authors) AS a, generate_subscripts(authors, 1) AS i) u) SELECT type, origin, count(*) AS n, count(DISTINCT name) AS names, max(pos) AS last_pos FROM x WHERE name <> '' GROUP BY 1, 2",
    "n_merge_points": f"WITH {_P}, x AS (SELECT venue, paper_id, u.k AS k, u.i - 1 AS pos FROM p, LATERAL (SELECT unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i) u WHERE venue IS NOT NULL), y AS (SELECT venue, trim(regexp_replace(lower(k), '[^a-z0-9]+', ' ', 'g')) AS key, min(row(paper_id, pos, k)) AS m, count(DISTINCT paper_id) AS sources FROM x WHERE k IS NOT NULL GROUP BY 1, 2), z AS (SELECT venue, m[3] AS label, sources, row_number() OVER (PARTITION BY venue ORDER BY m[1], m[2], m[3]) AS rank FROM y WHERE key <> '') SELECT * FROM z WHERE rank <= 12",
    "n_route_nodes": f"WITH {_ROUTE} SELECT * FROM rn",
    "n_route_edges": f"WITH {_ROUTE}, e2 AS (SELECT stage AS from_stage, lead(stage) OVER (PARTITION BY project_id ORDER BY pos) AS to_stage FROM rn) SELECT from_stage, to_stage, count(*) AS n FROM e2 WHERE to_stage IS NOT NULL GROUP BY 1, 2",
    "n_route_quality": f"WITH {_ROUTE}, q AS (SELECT project_id, count(*) AS nodes, count(DISTINCT stage) AS stages FROM rn GROUP BY 1) SELECT CASE WHEN nodes >= 3 AND stages >= 3 THEN 'content' WHEN nodes >= 2 THEN 'partial' ELSE 'limited' END AS level, count(*) AS projects, sum(nodes)::BIGINT AS nodes FROM q GROUP BY 1",
    "n_evidence_graph": f"WITH {_LE}, {_M}, mm AS (SELECT m.project_id, le.* FROM m JOIN le ON le.id = m.id), cl AS (SELECT project_id, id, {_tok('attributes->>$$$.statement$$')} AS ts FROM mm WHERE type = 'Claim'), vi AS (SELECT project_id, id, {_tok('coalesce(attributes->>$$$.statement$$, attributes->>$$$.description$$, name)')} AS ts FROM mm WHERE type = 'Evidence'), re AS (SELECT project_id, id, {_tok('concat_ws($$ $$, name, attributes->>$$$.title$$, attributes->>$$$.description$$)')} AS ts FROM mm WHERE type IN ('Dataset', 'Paper')) {_links('cl', 'vi', 'supported_by', 0.16)} UNION ALL {_links('cl', 're', 'grounded_in', 0.14)}",
    "n_facets": f"WITH {_OBJ}, f AS (SELECT project_id, count(DISTINCT stage) AS covered FROM oj LEFT JOIN cat ON c = category GROUP BY 1) SELECT project_id, 6 AS expected, covered, floor(covered * 100 / 6 + 0.5)::BIGINT AS score, CASE WHEN floor(covered * 100 / 6 + 0.5) >= 80 THEN 'complete' WHEN floor(covered * 100 / 6 + 0.5) >= 50 THEN 'partial' ELSE 'weak' END AS level FROM f",
    "n_map_layers": f"WITH {_MAP} SELECT * FROM ly",
    "n_map_mode": f"WITH {_MAP} SELECT project_id, CASE WHEN bool_or(primitive = 'classified-area-layer') THEN 'classified-map' WHEN bool_or(primitive = 'raster-layer') THEN 'raster-map' WHEN bool_or(primitive = 'route-or-flow-layer') THEN 'route-map' WHEN bool_or(primitive = 'region-layer') THEN 'regional-map' WHEN bool_or(primitive = 'point-layer') THEN 'point-map' ELSE 'spatial-overview' END AS mode FROM ly GROUP BY 1",
    "n_map_diagnostics": f"WITH {_MAP}, g AS (SELECT project_id, count(*) FILTER (WHERE is_anchor) AS anchors, count(*) FILTER (WHERE is_anchor AND located) AS renderable_anchors, count(*) FILTER (WHERE is_result) AS results, count(*) FILTER (WHERE is_result AND ra = 'renderable-now') AS renderable_results, count(*) FILTER (WHERE is_result AND starts_with(rp, 'attached-')) AS attached_results, count(*) FILTER (WHERE is_result AND ra = 'requires-code-execution') AS blocked_results FROM kk GROUP BY 1), w AS (SELECT *, (renderable_anchors = 0)::INT + (results > 0 AND renderable_results = 0 AND attached_results = 0)::INT + (blocked_results > 0)::INT AS warnings FROM g) SELECT *, CASE WHEN warnings > 0 THEN 'needs_review' ELSE 'ready' END AS status FROM w",
    "n_cite_match": f"WITH {_LE}, {_P}, q0 AS (SELECT id AS query_id, {_raw('attributes->>$$$.title$$')} AS rs FROM e WHERE type IN ('Paper', 'Preprint')), r0 AS (SELECT paper_id AS record_id, {_raw('title')} AS rs FROM p), q AS (SELECT query_id, list_filter(rs, lambda x, i: list_position(rs, x) = i) AS ts FROM q0), r AS (SELECT record_id, list_filter(rs, lambda x, i: list_position(rs, x) = i) AS ts FROM r0), a AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(ts) >= 2 THEN [ts[i] || ' ' || ts[i + 1] FOR i IN range(1, len(ts))] ELSE ts END) AS k FROM q), b AS (SELECT DISTINCT record_id, unnest(CASE WHEN len(ts) >= 2 THEN [ts[i] || ' ' || ts[i + 1] FOR i IN range(1, len(ts))] ELSE ts END) AS k FROM r), m AS (SELECT DISTINCT query_id, record_id FROM a JOIN b USING (k)) SELECT query_id, max(round(2 * len(list_intersect(q.ts, r.ts)) / (len(q.ts) + len(r.ts)), 6)) AS score FROM m JOIN q USING (query_id) JOIN r USING (record_id) GROUP BY 1",
    "n_activated_types": f"WITH {_ADMIT}, u AS (SELECT source_id, unnest(layers) AS layer, categories FROM ad) SELECT u.layer, count(*) AS n, count(*) FILTER (WHERE coalesce(list_contains(categories, o.category), false)) AS n_primary, count(DISTINCT source_id) AS n_sources FROM u JOIN ontology_types o ON o.layer = u.layer GROUP BY 1",
    "n_status_fsm": "WITH x AS (SELECT DISTINCT id, epoch_us(updated_at) AS seq, CASE WHEN status = 'completed' THEN 'completed' WHEN status IN ('failed', 'cancelled') THEN 'failed' WHEN status = 'analyzing' THEN 'started' ELSE 'pending' END AS st FROM projects WHERE id IS NOT NULL), y AS (SELECT id, arg_max(st, (seq, st)) AS st FROM x GROUP BY 1) SELECT CASE st WHEN 'failed' THEN 'failed' WHEN 'completed' THEN 'completed' WHEN 'pending' THEN 'pending' ELSE 'inProgress' END AS state, count(*) AS projects FROM y GROUP BY 1",
}
