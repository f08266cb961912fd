"""Queries of the views and evidence chains, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.operators import evidence, graph, lenses, ontology, state
from basinweave.plans.graph_queries import E as ALL_COLUMNS
from basinweave.plans.graph_queries import MEMBERS as _M
from basinweave.plans.graph_queries import T
from basinweave.session import table

E = ALL_COLUMNS.replace("SELECT * FROM (", "SELECT * EXCLUDE (project_id) FROM (", 1)


COLUMNS = ("type", "name", "attributes", "confidence", "source", "verification_state")


def _entities(spark, d, *columns):
    """Current entities with their layers; ``columns`` (all that a view may read if none are given) are read."""
    return ontology.with_layers(graph.latest_entities(table(spark, d, "entities"), *(columns or COLUMNS)), table(spark, d, "ontology_types"))


def _triples(spark, d, *columns):
    return graph.distinct_triples(table(spark, d, "triples"), "subject", "predicate", "object", *columns)


def _members(spark, d):
    return lenses.project_members(table(spark, d, "projects"))


def l_members(spark: SparkSession, d: str) -> DataFrame:
    """Members of each project and whether they exist."""
    ids = graph.latest_entities(table(spark, d, "entities"), "seq").select("id", F.lit(1).alias("there"))
    return _members(spark, d).join(ids, "id", "left").groupBy("project_id").agg(F.count("*").alias("members"), F.count("there").alias("existing"))


def l_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the five views per project."""
    return lenses.lens_scores(_members(spark, d), _entities(spark, d, "type", "attributes"), _triples(spark, d))


def l_recommend(spark: SparkSession, d: str) -> DataFrame:
    """Recommended view per project."""
    return lenses.recommended_lens(_members(spark, d), _entities(spark, d, "type", "attributes"), _triples(spark, d))


def l_graph_edges_in_project(spark: SparkSession, d: str) -> DataFrame:
    """Edges with both ends in the project, per project and predicate."""
    edges = lenses.project_graph(_members(spark, d), _triples(spark, d, "confidence"))
    return edges.groupBy("project_id", "predicate").agg(F.count("*").alias("n"))


def l_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Entities per project, type and category."""
    return lenses.project_metadata(_members(spark, d), _entities(spark, d, "type"))


def l_map_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Bounds and feature counts of each project's map."""
    return lenses.map_bounds(_members(spark, d), _entities(spark, d, "type", "attributes"))


def l_geometry_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the attribute that gives their geometry."""
    return lenses.map_features(_entities(spark, d, "type", "attributes")).groupBy("geometry_from", "type_layer").agg(F.count("*").alias("n"))


def l_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Datasets that cover each region of a project's map."""
    return lenses.coverage(_members(spark, d), _entities(spark, d, "type", "name", "attributes"), _triples(spark, d))


def l_workflow_stage(spark: SparkSession, d: str) -> DataFrame:
    """Entities per project and workflow stage."""
    return lenses.workflow_stages(_members(spark, d), _entities(spark, d, "type", "attributes"), _triples(spark, d))


def l_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Entities of each project's pipeline per stage, in order, with the members they lead to."""
    rows = lenses.workflow_pipeline(_members(spark, d), _entities(spark, d, "type", "attributes"), _triples(spark, d))
    return rows.groupBy("project_id", "position", "stage").agg(F.count("*").alias("entities"), F.sum("depends_on").alias("links"))


def k_export_entities(spark: SparkSession, d: str) -> DataFrame:
    """Exported entities per project and type."""
    return state.export_entities(_members(spark, d), _entities(spark, d, "type")).groupBy("project_id", "type").agg(F.count("*").alias("n"))


def k_export_chains(spark: SparkSession, d: str) -> DataFrame:
    """Exported evidence chains per project: claims, nodes and the deepest level."""
    rows = state.export_chains(_members(spark, d), _entities(spark, d, "type"), _triples(spark, d))
    return rows.groupBy("project_id").agg(F.countDistinct("start").alias("claims"), F.count("*").alias("nodes"), F.max("level").alias("deepest"))


def l_data_flows(spark: SparkSession, d: str) -> DataFrame:
    """Flows from inputs over their users to outputs, counted by relation and whether an output follows."""
    ents, trip = _entities(spark, d, "type", "attributes"), _triples(spark, d)
    inputs = lenses.with_edges(ents, trip).where(lenses.workflow_stage() == "input").select("id")
    flows = lenses.data_flows(inputs, ents, trip)
    return flows.groupBy("used_by", F.col("output").isNotNull().alias("has_output")).agg(F.count("*").alias("flows"), F.countDistinct("input").alias("inputs"))


def l_timeline_decades(spark: SparkSession, d: str) -> DataFrame:
    """Events per project and decade."""
    return lenses.timeline_decades(_members(spark, d), _entities(spark, d, "type", "attributes"))


def l_compare_scope(spark: SparkSession, d: str) -> DataFrame:
    """What is compared in each project."""
    return lenses.comparable_scope(_members(spark, d), _entities(spark, d, "type")).select("project_id", "n")


def l_compare_diff(spark: SparkSession, d: str) -> DataFrame:
    """Attributes in which the first two entities of each project differ."""
    found = lenses.first_two_differences(_members(spark, d), _entities(spark, d, "type", "attributes"))
    return found.select("project_id", "attribute", F.col("left").isNull().alias("left_missing"), F.col("right").isNull().alias("right_missing"))


def l_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics that entities are evaluated by."""
    return lenses.metrics(_entities(spark, d, "type", "name", "attributes"), _triples(spark, d))


def ev_claims(spark: SparkSession, d: str) -> DataFrame:
    """Claims per type."""
    return lenses.evidence_claims(_entities(spark, d, "type", "attributes"), _triples(spark, d)).groupBy("type").agg(F.count("*").alias("claims"))


def ev_chain_depth(spark: SparkSession, d: str) -> DataFrame:
    """Claims by depth of their support and by direct supporters."""
    ents, trip = _entities(spark, d, "type", "attributes"), _triples(spark, d)
    chains = lenses.evidence_chains(lenses.evidence_claims(ents, trip), ents, trip)
    return chains.groupBy("depth").agg(F.count("*").alias("claims"), F.sum("supporters").alias("supporters"))


def ev_claim_issues(spark: SparkSession, d: str) -> DataFrame:
    """Claims per issue."""
    ents, trip = _entities(spark, d), _triples(spark, d)
    claims = lenses.evidence_claims(ents, trip)
    rows = claims.join(lenses.evidence_chains(claims, ents, trip).select("id", "supporters"), "id")
    return lenses.claim_issues(rows).groupBy("issue").agg(F.count("*").alias("claims"))


def ev_summary(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each project with and without evidence, their mean depth and confidence."""
    ents, trip = _entities(spark, d, "type", "attributes", "confidence"), _triples(spark, d)
    claims = lenses.evidence_claims(ents, trip)
    return lenses.evidence_summary(_members(spark, d), claims, lenses.evidence_chains(claims, ents, trip))


def ev_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the evidence graph of each project, by relation."""
    ents, trip = _entities(spark, d, "type", "attributes"), _triples(spark, d)
    edges = lenses.evidence_graph(_members(spark, d), lenses.evidence_claims(ents, trip), ents, trip)
    return edges.groupBy("project_id", "relation").agg(F.count("*").alias("edges"), F.countDistinct("source").alias("sources"), F.countDistinct("target").alias("targets"))


def _chains(spark, d):
    ents, trip = _entities(spark, d), _triples(spark, d)
    return evidence.chain_nodes(ents.where("type = 'Evidence'").select("id"), ents, trip), ents, trip


def ev_chain_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes per level of the chains that start at evidence."""
    nodes, _, _ = _chains(spark, d)
    return nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.countDistinct("start").alias("chains"))


def ev_sufficient(spark: SparkSession, d: str) -> DataFrame:
    """Depth, confidence, gaps and sufficiency of the chains that start at evidence."""
    nodes, ents, trip = _chains(spark, d)
    return evidence.chain_summary(nodes, ents, trip)


def ev_chain_text(spark: SparkSession, d: str) -> DataFrame:
    """Text of the chains of three and more nodes."""
    nodes, ents, _ = _chains(spark, d)
    big = nodes.groupBy("start").count().where("count >= 3").select("start")
    return evidence.chain_text(nodes.join(big, "start", "left_semi"), ents)


QUERIES = {
    f.__name__: f
    for f in (
        l_members, l_scores, l_recommend, l_graph_edges_in_project, l_metadata, l_map_bounds, l_geometry_kinds, l_coverage, l_workflow_stage, l_pipeline, k_export_entities, k_export_chains, l_data_flows,
        l_timeline_decades, l_compare_scope, l_compare_diff, l_metrics, ev_claims, ev_chain_depth, ev_claim_issues, ev_summary, ev_graph, ev_chain_nodes, ev_sufficient, ev_chain_text,
    )
}


def _has(*names: str) -> str:
    """SQL of ``any_attr``."""
    return "(" + " OR ".join(f"coalesce(attributes->>'$.{n}' NOT IN ('', '0', '0.0', 'false', '-0', '-0.0'), false)" for n in names) + ")"


def _in(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_LE = f"{E}, le AS (SELECT e.*, coalesce(o.layer, 'unknown') AS type_layer, coalesce(o.category, 'other') AS type_category FROM e LEFT JOIN ontology_types o ON o.name = e.type)"
_FLAGS = f"""fl AS (SELECT id, count(*) FILTER (WHERE o) AS n_out, count(*) FILTER (WHERE NOT o) AS n_in,
 coalesce(bool_or(o AND predicate IN {_in(lenses.EVIDENCE_RELATIONS)}), false) AS out_evidence, coalesce(bool_or(o AND predicate IN {_in(lenses.WORKFLOW_RELATIONS)}), false) AS out_workflow,
 bool_or(o AND predicate = 'produces') AS out_produces, bool_or(o AND predicate IN ('uses', 'provides')) AS out_uses,
 bool_or(NOT o AND predicate = 'produces') AS in_produces, bool_or(NOT o AND predicate IN {_in(lenses.SUPPORT_RELATIONS)}) AS in_support
 FROM (SELECT subject AS id, predicate, true AS o FROM t UNION ALL SELECT object, predicate, false FROM t) GROUP BY 1),
 fe AS (SELECT le.*, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(out_evidence, false) AS out_evidence, coalesce(out_workflow, false) AS out_workflow,
 coalesce(out_produces, false) AS out_produces, coalesce(out_uses, false) AS out_uses, coalesce(in_produces, false) AS in_produces, coalesce(in_support, false) AS in_support
 FROM le LEFT JOIN fl ON fl.id = le.id)"""
_SCORES = f"""sc AS (SELECT m.project_id,
 sum(3 * {_has('geometry', 'bbox', 'centroid', 'location', 'spatialCoverage')}::INT + (type_layer = 'world')::INT)::BIGINT AS map,
 sum(3 * (type_category IN ('evidence', 'knowledge'))::INT + {_has('statement', 'claim', 'evidence', 'confidence')}::INT + 2 * out_evidence::INT)::BIGINT AS evidence,
 sum(2 * (type_category IN {_in(lenses.WORKFLOW_CATEGORIES)})::INT + {_has('inputs', 'outputs', 'steps', 'parameters', 'dependencies')}::INT + 2 * out_workflow::INT)::BIGINT AS workflow,
 (sum((n_out + n_in > 0)::INT) + (count(*) > 1)::INT)::BIGINT AS comparison,
 sum(2 * {_has('year', 'date', 'time', 'start', 'end', 'temporalCoverage')}::INT)::BIGINT AS timeline
 FROM m JOIN fe ON fe.id = m.id GROUP BY 1)"""
_KIND = f"""CASE WHEN {_has('geometry')} THEN 'geometry' WHEN coalesce(json_array_length(CASE WHEN json_type(attributes, '$.bbox') = 'ARRAY' THEN attributes->'$.bbox' END) >= 4, false) THEN 'bbox'
 WHEN {_has('centroid')} THEN 'centroid' WHEN {_has('location')} THEN 'location'
 WHEN coalesce(json_array_length(CASE WHEN json_type(attributes, '$.spatialCoverage') = 'ARRAY' THEN attributes->'$.spatialCoverage' END) >= 4, false) THEN 'coverage'
 WHEN lower(attributes->>'$.spatialCoverage') = 'global' THEN 'global' END"""
_GEO = f"""ge AS (SELECT *, CASE k WHEN 'geometry' THEN regexp_extract_all(attributes->'$.geometry'->>'$.coordinates', '(-?[0-9]+(?:\\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)')::DOUBLE[]
 WHEN 'bbox' THEN (attributes->'$.bbox')::DOUBLE[] WHEN 'coverage' THEN (attributes->'$.spatialCoverage')::DOUBLE[]
 WHEN 'centroid' THEN regexp_extract_all(attributes->>'$.centroid', '(-?[0-9]+(?:\\.[0-9]+)?)')::DOUBLE[] WHEN 'location' THEN regexp_extract_all(attributes->>'$.location', '(-?[0-9]+(?:\\.[0-9]+)?)')::DOUBLE[]
 ELSE [-180, -90, 180, 90]::DOUBLE[] END AS xy FROM (SELECT *, {_KIND} AS k FROM le) WHERE k IS NOT NULL),
 gb AS (SELECT *, CASE WHEN k IN ('bbox', 'coverage', 'global') THEN xy[1] ELSE list_min([xy[i] FOR i IN range(1, len(xy) + 1, 2)]) END AS x1,
 CASE WHEN k IN ('bbox', 'coverage', 'global') THEN xy[2] ELSE list_min([xy[i] FOR i IN range(2, len(xy) + 1, 2)]) END AS y1,
 CASE WHEN k IN ('bbox', 'coverage', 'global') THEN xy[3] ELSE list_max([xy[i] FOR i IN range(1, len(xy) + 1, 2)]) END AS x2,
 CASE WHEN k IN ('bbox', 'coverage', 'global') THEN xy[4] ELSE list_max([xy[i] FOR i IN range(2, len(xy) + 1, 2)]) END AS y2 FROM ge)"""
_STAGE = f"""CASE WHEN list_has_any(coalesce(json_keys(attributes), []), ['result', 'value', 'metric']) OR in_produces THEN 'output'
 WHEN {_has('experiment', 'trial', 'scenario')} OR type_category = 'assessment' THEN 'experiment'
 WHEN type_category IN {_in(lenses.PROCESSING_CATEGORIES)} OR {_has('steps', 'parameters')} OR out_produces THEN 'processing'
 WHEN type_category IN {_in(lenses.INPUT_CATEGORIES)} OR out_uses THEN 'input'
 WHEN n_in > 0 AND n_out = 0 THEN 'output' WHEN n_out > 0 AND n_in = 0 THEN 'input' ELSE 'processing' END"""
_NAME = "coalesce(nullif(name, ''), nullif(attributes->>'$.name', ''), nullif(attributes->>'$.title', ''), nullif(attributes->>'$.statement', ''), nullif(attributes->>'$.text', ''), id)"
_CLAIM = f"CASE WHEN type_category = 'evidence' THEN {_has('statement', 'claim', 'hypothesis', 'conclusion', 'assertion')} ELSE in_support END"
_SUP = f"""su AS (SELECT DISTINCT subject, object AS id FROM t WHERE predicate IN {_in(lenses.SUPPORT_RELATIONS)} AND subject IN (SELECT id FROM e)),
 sn AS (SELECT id, count(*) AS supporters FROM su GROUP BY 1),
 pw(claim, node, k, seen) AS (SELECT id, id, 0, []::VARCHAR[] FROM fe WHERE {_CLAIM} UNION ALL SELECT claim, su.subject, k + 1, list_append(seen, node) FROM pw JOIN su ON su.id = pw.node WHERE k < 5 AND NOT list_contains(seen, node)),
 cs AS (SELECT fe.*, coalesce(supporters, 0) AS supporters, dp.depth FROM fe JOIN (SELECT claim, max(k) AS depth FROM pw GROUP BY 1) dp ON dp.claim = fe.id LEFT JOIN sn ON sn.id = fe.id)"""
_Y = "try_cast(nullif(regexp_extract({0}, '([0-9]{{4}})', 1), '') AS INT)"
_COV = "coalesce(nullif(attributes->>'$.temporalCoverage', ''), nullif(attributes->>'$.temporalSpan', ''))"
_PT = "coalesce(" + ", ".join(f"nullif(attributes->>'$.{n}', '')" for n in ("date", "time", "timestamp", "publishedAt", "createdAt", "updatedAt")) + ")"
_START = f"CASE WHEN {_has('year')} THEN {_Y.format('attributes->>$$$.year$$')} WHEN {_has('start', 'end')} THEN {_Y.format('attributes->>$$$.start$$')} WHEN {_COV} IS NOT NULL THEN {_Y.format(_COV)} ELSE {_Y.format(_PT)} END"
_CH = f"""ed AS (SELECT DISTINCT subject AS id, object AS nxt FROM t WHERE predicate IN {_in(evidence.CHAIN_RELATIONS)} AND object IN (SELECT id FROM e)),
 w(start, id, level) AS (SELECT id, id, 0 FROM e WHERE type = 'Evidence' UNION SELECT w.start, ed.nxt, w.level + 1 FROM w JOIN ed ON ed.id = w.id),
 nd AS (SELECT start, id, min(level) AS level FROM w GROUP BY 1, 2)"""

ORACLES = {
    "l_members": f"WITH {E}, {_M} SELECT project_id, count(*) AS members, count(e.id) AS existing FROM m LEFT JOIN e ON e.id = m.id GROUP BY 1",
    "l_scores": f"WITH {_LE}, {T}, {_FLAGS}, {_M}, {_SCORES} SELECT * FROM sc",
    "l_recommend": f"WITH {_LE}, {T}, {_FLAGS}, {_M}, {_SCORES}, g AS (SELECT *, greatest(map, workflow, evidence, comparison, timeline) AS b FROM sc) SELECT x.project_id, coalesce(CASE b WHEN map THEN 'map' WHEN workflow THEN 'workflow' WHEN evidence THEN 'evidence' WHEN comparison THEN 'comparison' WHEN timeline THEN 'timeline' END, 'workflow') AS lens FROM (SELECT DISTINCT project_id FROM m) x LEFT JOIN g ON g.project_id = x.project_id",
    "l_graph_edges_in_project": f"WITH {T}, {_M} SELECT a.project_id, predicate, count(*) AS n FROM t JOIN m a ON a.id = subject JOIN m b ON b.id = object AND b.project_id = a.project_id GROUP BY 1, 2",
    "l_metadata": f"WITH {_LE}, {_M} SELECT project_id, type, type_category, count(*) AS n FROM m JOIN le ON le.id = m.id GROUP BY 1, 2, 3",
    "l_map_bounds": f"WITH {_LE}, {_GEO}, {_M} SELECT project_id, count(*) AS features, count(*) FILTER (WHERE type_layer = 'world') AS regions, count(DISTINCT type_layer) AS layers, min(x1) AS min_lon, min(y1) AS min_lat, max(x2) AS max_lon, max(y2) AS max_lat FROM m JOIN gb ON gb.id = m.id GROUP BY 1",
    "l_geometry_kinds": f"WITH {_LE}, x AS (SELECT {_KIND} AS geometry_from, type_layer FROM le) SELECT geometry_from, type_layer, count(*) AS n FROM x WHERE geometry_from IS NOT NULL GROUP BY 1, 2",
    "l_coverage": f"WITH {_LE}, {T}, {_M}, r AS (SELECT m.project_id, m.id FROM m JOIN le ON le.id = m.id WHERE type_layer = 'world' AND {_KIND} IS NOT NULL), c AS (SELECT DISTINCT subject, object FROM t WHERE predicate = 'covers') SELECT r.project_id, r.id, string_agg({_NAME.replace('name,', 'le.name,').replace('attributes', 'le.attributes').replace(', id)', ', le.id)')}, '; ' ORDER BY {_NAME.replace('name,', 'le.name,').replace('attributes', 'le.attributes').replace(', id)', ', le.id)')}) AS datasets FROM c JOIN r ON r.id = c.object JOIN m s ON s.id = c.subject AND s.project_id = r.project_id JOIN le ON le.id = c.subject GROUP BY 1, 2",
    "l_workflow_stage": f"WITH {_LE}, {T}, {_FLAGS}, {_M} SELECT project_id, {_STAGE} AS stage, count(*) AS n FROM m JOIN fe ON fe.id = m.id GROUP BY 1, 2",
    "l_pipeline": f"WITH {_LE}, {T}, {_FLAGS}, {_M}, g AS (SELECT a.project_id, a.id, count(DISTINCT object) AS k FROM t JOIN m a ON a.id = subject JOIN m b ON b.id = object AND b.project_id = a.project_id WHERE subject <> object GROUP BY 1, 2), x AS (SELECT m.project_id, {_STAGE} AS stage, coalesce(k, 0) AS k FROM m JOIN fe ON fe.id = m.id LEFT JOIN g ON g.project_id = m.project_id AND g.id = m.id) SELECT project_id, list_position({list(lenses.STAGES)}, stage) - 1 AS position, stage, count(*) AS entities, sum(k)::BIGINT AS links FROM x GROUP BY 1, 2, 3",
    "k_export_entities": f"WITH {E}, {_M} SELECT project_id, type, count(*) AS n FROM m JOIN e ON e.id = m.id GROUP BY 1, 2",
    "k_export_chains": f"WITH RECURSIVE {E}, {T}, {_M}, cx AS (SELECT m.project_id, e.id FROM m JOIN e ON e.id = m.id WHERE type IN ('Claim', 'Hypothesis')), ed AS (SELECT DISTINCT subject AS id, object AS nxt FROM t WHERE predicate IN {_in(evidence.CHAIN_RELATIONS)} AND object IN (SELECT id FROM e)), w(start, id, level) AS (SELECT DISTINCT id, id, 0 FROM cx UNION SELECT w.start, ed.nxt, w.level + 1 FROM w JOIN ed ON ed.id = w.id), nd AS (SELECT start, id, min(level) AS level FROM w GROUP BY 1, 2) SELECT project_id, count(DISTINCT start) AS claims, count(*) AS nodes, max(level) AS deepest FROM cx JOIN nd ON nd.start = cx.id GROUP BY 1",
    "l_data_flows": f"WITH {_LE}, {T}, {_FLAGS}, i AS (SELECT id FROM fe WHERE {_STAGE} = 'input'), u AS (SELECT object AS input, subject AS usr, predicate AS used_by FROM t WHERE predicate IN {_in(lenses.INPUT_USE_RELATIONS)} AND object IN (SELECT id FROM i) AND subject IN (SELECT id FROM e)), k AS (SELECT subject AS usr, object AS output FROM t WHERE predicate IN {_in(lenses.OUTPUT_RELATIONS)} AND object IN (SELECT id FROM e)) SELECT used_by, output IS NOT NULL AS has_output, count(*) AS flows, count(DISTINCT input) AS inputs FROM u LEFT JOIN k ON k.usr = u.usr GROUP BY 1, 2",
    "l_timeline_decades": f"WITH {_LE}, {_M}, x AS (SELECT m.project_id, type, {_START} AS s FROM m JOIN le ON le.id = m.id) SELECT project_id, (floor(s / 10) * 10)::INT AS decade, count(*) AS events, count(DISTINCT type) AS types, min(s) AS first, max(s) AS last FROM x WHERE s IS NOT NULL GROUP BY 1, 2",
    "l_compare_scope": f"WITH {_LE}, {_M}, x AS (SELECT project_id, type, type_layer || ':' || type_category AS lc FROM m JOIN le ON le.id = m.id), a AS (SELECT project_id, max(n) AS n FROM (SELECT project_id, type, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1), b AS (SELECT project_id, max(n) AS n FROM (SELECT project_id, lc, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1), c AS (SELECT project_id, count(*) AS n FROM x GROUP BY 1) SELECT a.project_id, CASE WHEN a.n >= 2 THEN a.n WHEN b.n >= 2 THEN b.n ELSE c.n END AS n FROM a JOIN b USING (project_id) JOIN c USING (project_id)",
    "l_compare_diff": f"WITH {E}, {_M}, x AS (SELECT m.project_id, e.id, attributes, row_number() OVER (PARTITION BY m.project_id ORDER BY pos, e.id) AS rn FROM m JOIN e ON e.id = m.id), k AS (SELECT project_id, rn, unnest(json_keys(attributes)) AS attribute, attributes FROM x WHERE rn <= 2), v AS (SELECT project_id, rn, attribute, json_extract_string(attributes, '$.\"' || attribute || '\"') AS value FROM k), two AS (SELECT project_id FROM x WHERE rn = 2) SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.attribute, b.attribute) AS attribute, a.value IS NULL AS left_missing, b.value IS NULL AS right_missing FROM (SELECT * FROM v WHERE rn = 1 AND project_id IN (SELECT project_id FROM two)) a FULL JOIN (SELECT * FROM v WHERE rn = 2) b ON a.project_id = b.project_id AND a.attribute = b.attribute WHERE a.value IS DISTINCT FROM b.value",
    "l_metrics": f"WITH {E}, {T} SELECT subject AS id, {_NAME.replace('name,', 'o.name,').replace('attributes', 'o.attributes').replace(', id)', ', o.id)')} AS metric, o.attributes->>'$.value' AS value, predicate AS relation FROM t JOIN e o ON o.id = object WHERE predicate IN ('evaluated_by', 'outperforms') AND subject IN (SELECT id FROM e)",
    "ev_claims": f"WITH {_LE}, {T}, {_FLAGS} SELECT type, count(*) AS claims FROM fe WHERE {_CLAIM} GROUP BY 1",
    "ev_chain_depth": f"WITH RECURSIVE {_LE}, {T}, {_FLAGS}, {_SUP} SELECT depth, count(*) AS claims, sum(supporters)::BIGINT AS supporters FROM cs GROUP BY 1",
    "ev_claim_issues": f"WITH RECURSIVE {_LE}, {T}, {_FLAGS}, {_SUP}, x AS (SELECT *, coalesce(nullif(try_cast(attributes->>'$.confidence' AS DOUBLE), 0), nullif(confidence, 0), 0.5) AS c FROM cs) SELECT 'missing_evidence' AS issue, count(*) AS claims FROM x WHERE supporters = 0 HAVING count(*) > 0 UNION ALL SELECT 'low_confidence', count(*) FROM x WHERE c < 0.5 HAVING count(*) > 0 UNION ALL SELECT 'unverified', count(*) FROM x WHERE coalesce(verification_state, 'extracted') = 'extracted' HAVING count(*) > 0",
    "ev_summary": f"WITH RECURSIVE {_LE}, {T}, {_FLAGS}, {_SUP}, {_M}, x AS (SELECT *, coalesce(nullif(try_cast(attributes->>'$.confidence' AS DOUBLE), 0), nullif(confidence, 0), 0.5) AS c FROM cs) SELECT project_id, count(*) AS claims, count(*) FILTER (WHERE supporters > 0) AS complete, count(*) FILTER (WHERE supporters = 0) AS unconnected, round(avg(depth), 6) AS avg_depth, round(avg(c), 6) AS avg_confidence FROM m JOIN x ON x.id = m.id GROUP BY 1",
    "ev_graph": f"WITH RECURSIVE {_LE}, {T}, {_FLAGS}, {_SUP}, {_M}, n AS (SELECT DISTINCT m.project_id, node AS id FROM m JOIN pw ON pw.claim = m.id WHERE k < 5), g AS (SELECT DISTINCT project_id, t.subject AS source, predicate AS relation, n.id AS target FROM n JOIN t ON t.object = n.id WHERE predicate IN {_in(lenses.SUPPORT_RELATIONS)} AND t.subject IN (SELECT id FROM e)) SELECT project_id, relation, count(*) AS edges, count(DISTINCT source) AS sources, count(DISTINCT target) AS targets FROM g GROUP BY 1, 2",
    "ev_chain_nodes": f"WITH RECURSIVE {E}, {T}, {_CH} SELECT level, count(*) AS nodes, count(DISTINCT start) AS chains FROM nd GROUP BY 1",
    "ev_sufficient": f"WITH RECURSIVE {E}, {T}, {_CH}, d AS (SELECT start, max(level) AS depth FROM nd GROUP BY 1), sp AS (SELECT DISTINCT subject AS id FROM t WHERE predicate IN {_in(evidence.CHAIN_RELATIONS)}), x AS (SELECT nd.start, depth, count(*) AS nodes, round(avg(coalesce(confidence, 1.0)), 6) AS avg_confidence, count(*) FILTER (WHERE source IS NULL OR source = '' OR coalesce(confidence, 1.0) < 0.3) AS weak, count(*) FILTER (WHERE level < depth AND sp.id IS NULL) AS gaps FROM nd JOIN d ON d.start = nd.start JOIN e ON e.id = nd.id LEFT JOIN sp ON sp.id = nd.id GROUP BY 1, 2) SELECT *, depth >= 2 AND avg_confidence >= 0.7 AND weak = 0 AND gaps = 0 AS sufficient FROM x",
    "ev_chain_text": f"WITH RECURSIVE {E}, {T}, {_CH}, b AS (SELECT start FROM nd GROUP BY 1 HAVING count(*) >= 3) SELECT start, string_agg(repeat('  ', level::BIGINT) || '[' || type || '] ' || coalesce(nullif(name, ''), e.id), chr(10) ORDER BY level, e.id) AS text FROM nd JOIN e ON e.id = nd.id WHERE start IN (SELECT start FROM b) GROUP BY 1",
}
