"""Queries over the graph, the vocabulary and the event log, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.operators import eventlog, graph, ontology
from basinweave.operators.orphans import ENTITY_KEY
from basinweave.plans import lift
from basinweave.session import table

HUB = "wld-0001234567"


def _e(spark, d, *columns):
    return graph.latest_entities(table(spark, d, "entities"), *columns)


def _t(spark, d, *columns):
    return graph.distinct_triples(table(spark, d, "triples"), *(columns or SPO))


SPO = ("subject", "predicate", "object")


#: SQL of the same two tables, with one row per id.
E = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC, created_at DESC, ingested_at DESC) AS rn FROM entities WHERE id IS NOT NULL) WHERE rn = 1)"
T = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY triple_id ORDER BY seq DESC, created_at DESC) AS rn FROM triples WHERE triple_id IS NOT NULL) WHERE rn = 1)"

#: SQL of the members of projects.
MEMBERS = r"""m AS (SELECT project_id, id, min(pos) AS pos FROM (
 SELECT p.id AS project_id, lower(regexp_replace(u.x, '^\s+|\s+$', '', 'g')) AS id, u.i - 1 AS pos
 FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, entities DESC) AS rn FROM projects WHERE id IS NOT NULL) WHERE rn = 1) p,
 LATERAL (SELECT unnest(p.entities) AS x, generate_subscripts(p.entities, 1) AS i) u) WHERE id <> '' GROUP BY 1, 2)"""


def _values(rows, names):
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS v({names})"


_REGISTERED = sorted({n for names in ontology.RELATIONS.values() for n in names})


def g_path_2hop(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers per region, by the walk located_at, part_of."""
    ents, trip = lift.sales_entities(spark, d), lift.sales_triples(spark, d)
    walks = graph.query_path(ents.where("type = 'Institution'").select("id"), trip, ["located_at", "part_of"], ents, keep_start=False)
    return walks.select(F.col("end").alias("region"), F.col("walks").alias("suppliers"))


def g_path_3hop_bag(spark: SparkSession, d: str) -> DataFrame:
    """Orders per region, by the walk performed_by, located_at, part_of; walks are counted with repetition."""
    ents, trip = lift.sales_entities(spark, d), lift.sales_triples(spark, d)
    walks = graph.query_path(ents.where("type = 'Event'").select("id"), trip, ["performed_by", "located_at", "part_of"], ents, keep_start=False)
    return walks.select(F.col("end").alias("region"), "walks")


def g_path_triples(spark: SparkSession, d: str) -> DataFrame:
    """Walks uses, part_of from datasets to existing entities, by type of the end."""
    ents, trip = _e(spark, d, "type"), _t(spark, d)
    walks = graph.query_path(ents.where("type = 'Dataset'").select("id"), trip, ["uses", "part_of"], ents)
    types = ents.select(F.col("id").alias("end"), "type")
    return walks.join(types, "end").groupBy("type").agg(F.sum("walks").alias("walks"), F.countDistinct("start").alias("starts"))


def g_current_entities(spark: SparkSession, d: str) -> DataFrame:
    """The current row of each entity that was written more than once."""
    again = table(spark, d, "entities").groupBy("id").count().where("count > 1").select("id")
    return _e(spark, d, "type", "seq", "confidence", "created_at").join(again, "id", "left_semi").select("id", "type", "seq", "confidence", "created_at")


def g_query_sp(spark: SparkSession, d: str) -> DataFrame:
    """Subjects and objects of located_at, in order of writing."""
    return graph.query(_t(spark, d, *SPO, "seq"), predicate="located_at").select("subject", "object", "seq")


def g_query_inverse_po(spark: SparkSession, d: str) -> DataFrame:
    """Subjects that cover the hub."""
    return graph.query_inverse(_t(spark, d), "covers", HUB).select("subject")


def g_query_inverse_p(spark: SparkSession, d: str) -> DataFrame:
    """Subject and object of all part_of triples, with their number."""
    return graph.query_inverse(_t(spark, d), "part_of").groupBy("subject", "object").agg(F.count("*").alias("n"))


def g_match_exists(spark: SparkSession, d: str) -> DataFrame:
    """Datasets that cover a region and use anything."""
    return graph.match(_e(spark, d, "type", "name"), _t(spark, d), "Dataset", None, [("covers", {"type": "Region"}), ("uses", None)]).select("id", "name")


def g_match_attr(spark: SparkSession, d: str) -> DataFrame:
    """Datasets with global coverage."""
    return graph.match(_e(spark, d, "type", "name", "attributes", "confidence"), _t(spark, d), "Dataset", {"spatialCoverage": "global"}).select("id", "name", "confidence")


def g_relations_both_ways(spark: SparkSession, d: str) -> DataFrame:
    """Relations of all rivers, in and out, by predicate."""
    rel = graph.relations_of(_e(spark, d, "type").where("type = 'River'").select("id"), _t(spark, d, *SPO, "confidence", "verification_state"))
    return rel.groupBy("direction", "predicate").agg(F.count("*").alias("n"), F.countDistinct("id").alias("rivers"), F.round(F.avg("confidence"), 6).alias("avg_conf"))


def g_explore(spark: SparkSession, d: str) -> DataFrame:
    """Types and sources at the other end of the relations of all basins."""
    ents = _e(spark, d, "type", "name", "source", "attributes")
    found = graph.explore(ents.where("type = 'Basin'").select("id"), _t(spark, d, *SPO, "confidence", "verification_state"), ents)
    return found.groupBy("direction", "other_type").agg(F.count("*").alias("n"), F.countDistinct("other_source").alias("sources"))


def g_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts of entities by type and state and of triples by predicate and state."""
    return graph.stats(_e(spark, d, "type", "verification_state"), _t(spark, d, "predicate", "verification_state"))


def g_validation(spark: SparkSession, d: str) -> DataFrame:
    """Triples by reason of rejection; accepted ones have none."""
    checked = graph.validate_triples(_t(spark, d), _e(spark, d, "type"), ontology.relation_table(spark), F.lower(F.trim("object")).rlike(ENTITY_KEY))
    return checked.groupBy("reject_reason").agg(F.count("*").alias("n"), F.countDistinct("predicate").alias("predicates"))


def g_unverified(spark: SparkSession, d: str) -> DataFrame:
    """Unverified entities per type."""
    return graph.in_state(_e(spark, d, "type", "verification_state"), "extracted").groupBy("type").agg(F.count("*").alias("n"))


def g_verify(spark: SparkSession, d: str) -> DataFrame:
    """States after a review that accepts all extracted papers of confidence 0.8 and more."""
    where = (F.col("type") == "Paper") & (F.coalesce("verification_state", F.lit("extracted")) == "extracted") & (F.col("confidence") >= 0.8)
    done = graph.verify(_e(spark, d), where, "verified", "rv-00", "2026-01-01 00:00:00", "accepted in bulk")
    return done.where("type = 'Paper'").groupBy("verification_state").agg(F.count("*").alias("n"), F.count_if(F.col("reviewed_by") == "rv-00").alias("by_review"), F.sum(F.when(F.col("notes").isNull(), 0).otherwise(F.size("notes"))).cast("bigint").alias("notes"))


def g_display_names(spark: SparkSession, d: str) -> DataFrame:
    """Display names of the entities that have no name of their own."""
    return _e(spark, d, "name", "attributes").where("name is null or name = ''").select("id", graph.display_name(F.col("name")).alias("label"))


def g_degree_top(spark: SparkSession, d: str) -> DataFrame:
    """The 25 entities with the most relations."""
    t = _t(spark, d)
    ends = t.select(F.col("subject").alias("id")).unionByName(t.select(F.col("object").alias("id")))
    known = _e(spark, d, "type").select("id")
    return ends.groupBy("id").agg(F.count("*").alias("degree")).join(known, "id", "left_semi").orderBy(F.desc("degree"), "id").limit(25)


def g_dot(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the Graphviz text of the verified rivers."""
    ents = _e(spark, d, "type", "name", "attributes", "verification_state").where("type = 'River' and verification_state = 'verified'")
    return graph.to_dot(ents, _t(spark, d)).select("ord", "key", "line")


def o_layer_counts(spark: SparkSession, d: str) -> DataFrame:
    """Entities by layer and category of their type."""
    return ontology.with_layers(_e(spark, d, "type"), table(spark, d, "ontology_types")).groupBy("type_layer", "type_category").agg(F.count("*").alias("n"))


def o_types_by_category(spark: SparkSession, d: str) -> DataFrame:
    """Types of each layer and category."""
    return table(spark, d, "ontology_types").groupBy("layer", "category").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("types"))


def o_closure(spark: SparkSession, d: str) -> DataFrame:
    """All types above each type, and how far."""
    return ontology.type_closure(ontology.parent_table(spark), table(spark, d, "ontology_types"))


def o_alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Freely typed types that are a registered name or alias but for case and separators."""
    types = table(spark, d, "entities").where("type is not null").select("type").distinct()
    return ontology.resolve_types(types, "type", table(spark, d, "ontology_types"), table(spark, d, "type_alias")).where("resolved is not null")


def o_bridge_valid_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of types that occur in triples and the bridge predicates that allow them."""
    t, e = _t(spark, d), _e(spark, d, "type")
    s = e.select(F.col("id").alias("subject"), F.col("type").alias("subject_type"))
    o = e.select(F.col("id").alias("object"), F.col("type").alias("object_type"))
    pairs = t.select("subject", "object").join(s, "subject").join(o, "object").select("subject_type", "object_type").distinct()
    closure = ontology.type_closure(ontology.parent_table(spark), table(spark, d, "ontology_types"))
    return ontology.valid_bridges(pairs, closure, ontology.bridge_table(spark)).groupBy("predicate").agg(F.count("*").alias("pairs"))


def o_conf_cap(spark: SparkSession, d: str) -> DataFrame:
    """Triples whose confidence is above the cap of their predicate, with evidence where there is a source text."""
    t = _t(spark, d, "predicate", "provenance", "confidence")
    has = F.coalesce(F.col("provenance.source_text") != "", F.lit(False))
    cap = ontology.confidence_cap(F.col("predicate"), has)
    return t.withColumn("cap", cap).groupBy("predicate", "cap").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > F.col("cap")).alias("above"))


def _log(spark, d):
    return eventlog.lift_events(table(spark, d, "events"))


def e_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Lifecycle of every object of the event log."""
    return eventlog.lifecycle(_log(spark, d))


def e_lifecycle_of(spark: SparkSession, d: str) -> DataFrame:
    """Events of one user with the other objects."""
    return eventlog.lifecycle_of(_log(spark, d), "user-7")


def e_collaboration(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of objects by the events they share."""
    return eventlog.collaboration(_log(spark, d))


def e_top_objects(spark: SparkSession, d: str) -> DataFrame:
    """The ten most active objects."""
    return eventlog.top_objects(_log(spark, d))


def e_type_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events and objects per type."""
    return eventlog.type_stats(_log(spark, d))


def _merged(spark, d):
    types = table(spark, d, "ontology_types")
    above = types.select("name").unionByName(ontology.parent_table(spark).select(F.col("parent").alias("name"))).distinct()
    return ontology.merged_schemas(ontology.own_schemas(above))


def o_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Fields that each type requires, with those of the types above it, and how many defaults it has."""
    rows = _merged(spark, d).join(F.broadcast(table(spark, d, "ontology_types").select("name")), "name", "left_semi")
    return rows.select("name", F.array_join("required", ",").alias("required"), F.size("defaults").cast("long").alias("defaults"))


def o_completed(spark: SparkSession, d: str) -> DataFrame:
    """Required fields that entities of each type lack and that are filled in."""
    types = table(spark, d, "ontology_types").select("name")
    e = graph.latest_entities(table(spark, d, "entities"), "type", "attributes").where("type is not null").select("id", "type", "attributes")
    merged = _merged(spark, d).join(F.broadcast(types), "name", "left_semi")
    filled = ontology.complete_attributes(e, merged).select("type", F.explode(F.array_except(F.map_keys("completed"), F.coalesce(F.json_object_keys("attributes"), F.array().cast("array<string>")))).alias("field"))
    return filled.groupBy("type", "field").agg(F.count("*").alias("filled"))


QUERIES = {
    f.__name__: f
    for f in (
        g_path_2hop, g_path_3hop_bag, g_path_triples, g_current_entities, g_query_sp, g_query_inverse_po, g_query_inverse_p, g_match_exists, g_match_attr,
        g_relations_both_ways, g_explore, g_stats, g_validation, g_unverified, g_verify, g_display_names, g_degree_top, g_dot, o_layer_counts, o_types_by_category,
        o_closure, o_schemas, o_completed, o_alias_resolve, o_bridge_valid_pairs, o_conf_cap, e_lifecycle, e_lifecycle_of, e_collaboration, e_top_objects, e_type_counts,
    )
}

_LOG = """log AS (SELECT event_id, ts, event_type AS type, list_filter(['user-' || user_id::VARCHAR, 'type-' || event_type, 'k-' || (props->>'$.k')], lambda x: x IS NOT NULL) AS objects FROM events),
 oe AS (SELECT event_id, ts, type, unnest(list_distinct(objects)) AS object, len(list_distinct(objects)) - 1 AS others FROM log)"""
_CLOSURE = (
    "par AS (SELECT * FROM " + _values(sorted(ontology.PARENTS.items()), "name, parent") + "), "
    "clo(name, ancestor, steps) AS (SELECT name, name, 0 FROM ontology_types UNION ALL SELECT c.name, p.parent, c.steps + 1 FROM clo c JOIN par p ON c.ancestor = p.name)"
)
_OWN = [(n, f) for n in sorted({*ontology.PARENTS, *ontology.PARENTS.values(), *ontology.REQUIRED}) for f in ontology.REQUIRED.get(n, () if n in ontology.PARENTS else ("name",))]
_SCHEMAS = (
    "own0 AS (SELECT * FROM " + _values(_OWN, "ty, field") + "), own AS (SELECT * FROM own0 UNION ALL SELECT name, 'name' FROM ontology_types WHERE name NOT IN (SELECT ty FROM own0) AND name NOT IN (SELECT name FROM par)), "
    "fpar AS (SELECT * FROM par WHERE name NOT IN ('" + "', '".join(ontology.FIELD_ROOTS) + "')), fclo(name, ancestor) AS (SELECT name, name FROM ontology_types UNION SELECT c.name, p.parent FROM fclo c JOIN fpar p ON c.ancestor = p.name), "
    "rq AS (SELECT DISTINCT name, field FROM fclo JOIN own ON own.ty = ancestor), dk AS (SELECT * FROM " + _values([(n, k) for n, j in ontology.DEFAULTS.items() for k in json.loads(j)], "ty, key") + ")"
)
_NAME = "coalesce(nullif(name, ''), nullif(attributes->>'$.name', ''), nullif(attributes->>'$.title', ''), nullif(attributes->>'$.statement', ''), nullif(attributes->>'$.text', ''), id)"
_BRIDGE_ROWS = [(p, a, b) for p, (ds, rs, _, _) in ontology.BRIDGES.items() for a in ds for b in rs]

ORACLES = {
    "g_path_2hop": "SELECT 'region-' || n_regionkey AS region, count(*) AS suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "g_path_3hop_bag": "SELECT 'region-' || n_regionkey AS region, count(*) AS walks FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "g_path_triples": f"WITH {E}, {T} SELECT x.type, count(*) AS walks, count(DISTINCT s.id) AS starts FROM e s JOIN t a ON a.subject = s.id AND a.predicate = 'uses' JOIN t b ON b.subject = a.object AND b.predicate = 'part_of' JOIN e x ON x.id = b.object WHERE s.type = 'Dataset' GROUP BY 1",
    "g_current_entities": f"WITH {E} SELECT id, type, seq, confidence, created_at FROM e WHERE id IN (SELECT id FROM entities GROUP BY id HAVING count(*) > 1)",
    "g_query_sp": f"WITH {T} SELECT subject, object, seq FROM t WHERE predicate = 'located_at'",
    "g_query_inverse_po": f"WITH {T} SELECT subject FROM t WHERE predicate = 'covers' AND object = '{HUB}'",
    "g_query_inverse_p": f"WITH {T} SELECT subject, object, count(*) AS n FROM t WHERE predicate = 'part_of' GROUP BY 1, 2",
    "g_match_exists": f"WITH {E}, {T} SELECT id, name FROM e WHERE type = 'Dataset' AND EXISTS (SELECT 1 FROM t JOIN e o ON o.id = t.object AND o.type = 'Region' WHERE t.subject = e.id AND t.predicate = 'covers') AND EXISTS (SELECT 1 FROM t WHERE t.subject = e.id AND t.predicate = 'uses')",
    "g_match_attr": f"WITH {E} SELECT id, name, confidence FROM e WHERE type = 'Dataset' AND attributes->>'$.spatialCoverage' = 'global'",
    "g_relations_both_ways": f"WITH {E}, {T}, r AS (SELECT id FROM e WHERE type = 'River'), x AS (SELECT subject AS id, 'out' AS direction, predicate, confidence FROM t WHERE subject IN (SELECT id FROM r) UNION ALL SELECT object, 'in', predicate, confidence FROM t WHERE object IN (SELECT id FROM r)) SELECT direction, predicate, count(*) AS n, count(DISTINCT id) AS rivers, round(avg(confidence), 6) AS avg_conf FROM x GROUP BY 1, 2",
    "g_explore": f"WITH {E}, {T}, r AS (SELECT id FROM e WHERE type = 'Basin'), x AS (SELECT 'out' AS direction, object AS other FROM t WHERE subject IN (SELECT id FROM r) UNION ALL SELECT 'in', subject FROM t WHERE object IN (SELECT id FROM r)) SELECT direction, e.type AS other_type, count(*) AS n, count(DISTINCT e.source) AS sources FROM x LEFT JOIN e ON e.id = other GROUP BY 1, 2",
    "g_stats": f"WITH {E}, {T} SELECT 'entities' AS measure, NULL AS value, count(*) AS n FROM e UNION ALL SELECT 'entity_type', type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'entity_state', coalesce(verification_state, 'extracted'), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'triples', NULL, count(*) FROM t UNION ALL SELECT 'predicate', predicate, count(*) FROM t GROUP BY 2 UNION ALL SELECT 'triple_state', coalesce(verification_state, 'extracted'), count(*) FROM t GROUP BY 2",
    "g_validation": f"WITH {E}, {T}, p AS (SELECT * FROM {_values([(n,) for n in _REGISTERED], 'name')}), x AS (SELECT t.predicate, CASE WHEN subject NOT IN (SELECT id FROM e) THEN 'missing_subject' WHEN regexp_matches(lower(trim(object)), '{ENTITY_KEY}') AND object NOT IN (SELECT id FROM e) THEN 'missing_object' WHEN predicate NOT IN (SELECT name FROM p) THEN 'unregistered_predicate' END AS reject_reason FROM t) SELECT reject_reason, count(*) AS n, count(DISTINCT predicate) AS predicates FROM x GROUP BY 1",
    "g_unverified": f"WITH {E} SELECT type, count(*) AS n FROM e WHERE coalesce(verification_state, 'extracted') = 'extracted' GROUP BY 1",
    "g_verify": f"WITH {E}, x AS (SELECT *, coalesce(coalesce(verification_state, 'extracted') = 'extracted' AND confidence >= 0.8, false) AS hit FROM e WHERE type = 'Paper') SELECT CASE WHEN hit THEN 'verified' ELSE verification_state END AS verification_state, count(*) AS n, count(*) FILTER (WHERE hit) AS by_review, (sum(coalesce(len(notes), 0)) + count(*) FILTER (WHERE hit))::BIGINT AS notes FROM x GROUP BY 1",
    "g_display_names": f"WITH {E} SELECT id, {_NAME} AS label FROM e WHERE name IS NULL OR name = ''",
    "g_degree_top": f"WITH {E}, {T} SELECT id, count(*) AS degree FROM (SELECT subject AS id FROM t UNION ALL SELECT object FROM t) WHERE id IN (SELECT id FROM e) GROUP BY 1 ORDER BY degree DESC, id LIMIT 25",
    "g_dot": f"WITH {E}, {T}, r AS (SELECT * FROM e WHERE type = 'River' AND verification_state = 'verified') SELECT 1 AS ord, id AS key, '  \"' || id || '\" [label=\"' || type || '\\n' || replace({_NAME}, '\"', '\\\"') || '\"];' AS line FROM r UNION ALL SELECT 2, triple_id, '  \"' || subject || '\" -> \"' || object || '\" [label=\"' || predicate || '\"];' FROM t WHERE subject IN (SELECT id FROM r) AND object IN (SELECT id FROM r)",
    "o_layer_counts": f"WITH {E} SELECT coalesce(o.layer, 'unknown') AS type_layer, coalesce(o.category, 'other') AS type_category, count(*) AS n FROM e LEFT JOIN ontology_types o ON o.name = e.type GROUP BY 1, 2",
    "o_types_by_category": "SELECT layer, category, string_agg(name, ',' ORDER BY name) AS types FROM ontology_types GROUP BY 1, 2",
    "o_closure": f"WITH RECURSIVE {_CLOSURE} SELECT name, ancestor, min(steps) AS steps FROM clo GROUP BY 1, 2",
    "o_schemas": f"WITH RECURSIVE {_CLOSURE}, {_SCHEMAS}, df AS (SELECT DISTINCT name, key FROM fclo JOIN dk ON dk.ty = ancestor) SELECT o.name, coalesce(fields, '') AS required, coalesce(k.n, 0) AS defaults FROM ontology_types o LEFT JOIN (SELECT name, string_agg(DISTINCT field, ',' ORDER BY field) AS fields FROM rq GROUP BY 1) r ON r.name = o.name LEFT JOIN (SELECT name, count(*) AS n FROM df GROUP BY 1) k ON k.name = o.name",
    "o_completed": f"WITH RECURSIVE {E}, {_CLOSURE}, {_SCHEMAS}, x AS (SELECT id, type, coalesce(json_keys(attributes), []) AS ks FROM e WHERE type IS NOT NULL), n AS (SELECT x.id, x.type, coalesce(rq.field, 'name') AS field, ks FROM x LEFT JOIN rq ON rq.name = x.type WHERE rq.field IS NOT NULL OR x.type NOT IN (SELECT name FROM ontology_types)) SELECT type, field, count(*) AS filled FROM n WHERE NOT list_contains(ks, field) GROUP BY 1, 2",
    "o_alias_resolve": r"WITH k AS (SELECT lower(regexp_replace(name, '[\s_-]+', '', 'g')) AS t, name AS n, 0 AS r FROM ontology_types UNION ALL SELECT lower(regexp_replace(name, '[\s_-]+', '', 'g')) || 'object', name, 1 FROM ontology_types UNION ALL SELECT token, canonical, 2 FROM type_alias), f AS (SELECT t, arg_min(n, (r, n)) AS resolved FROM k GROUP BY 1) SELECT x.type, resolved FROM (SELECT DISTINCT type FROM entities WHERE type IS NOT NULL) x JOIN f ON f.t = lower(regexp_replace(x.type, '[\s_-]+', '', 'g'))",
    "o_bridge_valid_pairs": f"WITH RECURSIVE {_CLOSURE}, {E}, {T}, b AS (SELECT * FROM {_values(_BRIDGE_ROWS, 'predicate, dom, ran')}), c AS (SELECT DISTINCT name, ancestor FROM clo), pairs AS (SELECT DISTINCT s.type AS st, o.type AS ot FROM t JOIN e s ON s.id = t.subject JOIN e o ON o.id = t.object), hit AS (SELECT DISTINCT st, ot, predicate FROM pairs JOIN c x ON x.name = st JOIN b ON b.dom = x.ancestor JOIN c y ON y.name = ot AND y.ancestor = b.ran) SELECT predicate, count(*) AS pairs FROM hit GROUP BY 1",
    "o_conf_cap": f"WITH {T}, c AS (SELECT * FROM {_values([(p, x[3] if x[3] is not None else 0.0) for p, x in ontology.BRIDGES.items()], 'p, cap0')}), x AS (SELECT t.*, CASE WHEN p IS NULL THEN 0.5 WHEN coalesce(provenance.source_text <> '', false) THEN 0.9 ELSE cap0 END::DOUBLE AS cap FROM t LEFT JOIN c ON p = predicate) SELECT predicate, cap, count(*) AS n, count(*) FILTER (WHERE confidence > cap) AS above FROM x GROUP BY 1, 2",
    "e_lifecycle": f"WITH {_LOG} SELECT object, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts, sum(others)::BIGINT AS met FROM oe GROUP BY 1",
    "e_lifecycle_of": f"WITH {_LOG} SELECT event_id, ts, type, array_to_string(list_sort(list_filter(list_distinct(objects), lambda x: x <> 'user-7')), ',') AS others FROM log WHERE list_contains(objects, 'user-7')",
    "e_collaboration": f"WITH {_LOG} SELECT a.object AS a, b.object AS b, count(*) AS times FROM oe a JOIN oe b ON a.event_id = b.event_id AND a.object < b.object GROUP BY 1, 2",
    "e_top_objects": f"WITH {_LOG} SELECT object, count(*) AS events FROM oe GROUP BY 1 ORDER BY events DESC, object LIMIT 10",
    "e_type_counts": f"WITH {_LOG} SELECT type, count(DISTINCT event_id) AS events, count(DISTINCT object) AS objects FROM oe GROUP BY 1",
}
