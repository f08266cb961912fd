"""Queries of the core data-quality problems: units (2), nested records (4) and missing references (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.operators import nested, orphans, units
from basinweave.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid sizes in millimetres and time steps in seconds of all Resolution and Dataset entities."""
    return units.read_quantities(table(spark, sf_dir, "entities").select("id", "type", "attributes"))


def p2_unit_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the bare values that each extractor recorded, with shifts that match a change of unit."""
    rows = table(spark, sf_dir, "entities").where(F.col("attributes").contains('"value"'))
    value = F.expr("try_cast(get_json_object(attributes, '$.value') as double)")
    return units.unit_shifts(rows, "source", "created_at", value)


def p2_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bare values that each extractor recorded, in the unit of its first level."""
    rows = table(spark, sf_dir, "entities").where(F.col("attributes").contains('"value"'))
    value = F.expr("try_cast(get_json_object(attributes, '$.value') as double)")
    return units.convert_units(rows, "source", "created_at", value, "id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the nested arrays of each project's latest metadata, linked to the element around them."""
    linked = nested.flatten_projects(table(spark, sf_dir, "projects"))
    return linked.select(F.col("record_id").alias("project_id"), "parent_path", "item_path", "item_id")


def p4_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of nodes and of their documents per type of node."""
    linked = nested.flatten_projects(table(spark, sf_dir, "projects"))
    return linked.groupBy("node_type").agg(F.count("*").alias("nodes"), F.countDistinct("record_id").alias("documents"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    to_entities, to_applications = orphans.graph_references(
        table(spark, sf_dir, "triples"), table(spark, sf_dir, "projects"), table(spark, sf_dir, "invites")
    )
    entities = orphans.existence_rows(table(spark, sf_dir, "entities"), "id", "created_at")
    applications = orphans.existence_rows(table(spark, sf_dir, "applications"), "id", "created_at")
    return orphans.orphan_references(to_entities, entities).unionByName(orphans.orphan_references(to_applications, applications))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of triples, projects and invites to keys that are missing or were created later."""
    return _orphans(spark, sf_dir)


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphans.orphan_counts(_orphans(spark, sf_dir))


QUERIES = {f.__name__: f for f in (p2_found, p2_unit_shifts, p2_converted, p4_found, p4_node_counts, p6_found, p6_counts)}

_P6 = r"""
WITH refs AS (
  SELECT 'triples' AS tbl, triple_id AS from_key, lower(regexp_replace(e, '^\s+|\s+$', '', 'g')) AS to_key, created_at AS ref_at, 'e' AS kind
  FROM (SELECT triple_id, created_at, unnest([subject, object]) AS e FROM triples)
  UNION ALL
  SELECT 'projects', id, lower(regexp_replace(e, '^\s+|\s+$', '', 'g')), updated_at, 'e'
  FROM (SELECT id, updated_at, unnest(entities) AS e
        FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, entities DESC) AS rn FROM projects WHERE id IS NOT NULL)
        WHERE rn = 1)
  UNION ALL
  SELECT 'invites', code, lower(regexp_replace(application_id, '^\s+|\s+$', '', 'g')), created_at, 'a' FROM invites
), keys AS (
  SELECT 'e' AS kind, lower(trim(id)) AS k, min(created_at) AS c FROM entities WHERE id IS NOT NULL GROUP BY 2
  UNION ALL
  SELECT 'a', lower(trim(id)), min(created_at) FROM applications WHERE id IS NOT NULL GROUP BY 2
), found AS (
  SELECT DISTINCT tbl, strftime(ref_at, '%Y-%m') AS ref_month, from_key, to_key,
         CASE WHEN k IS NULL THEN 'missing' ELSE 'late' END AS reason
  FROM refs LEFT JOIN keys ON refs.kind = keys.kind AND to_key = k
  WHERE to_key <> '' AND from_key IS NOT NULL AND (refs.kind = 'a' OR regexp_matches(to_key, '^(cap|dom|fnd|src|wld)-[0-9a-f]{10}$'))
    AND (k IS NULL OR c > ref_at)
)
"""



def _dec(e: str) -> str:
    """The JSON that a value stands for: text which holds an object, an array or null is read."""
    return f"(CASE WHEN json_type({e}) = 'VARCHAR' AND json_valid({e}->>'$') AND regexp_matches({e}->>'$', '^\\s*([\\[{{]|null\\s*$)') THEN ({e}->>'$')::JSON ELSE {e} END)"


def _items(cte: str, src: str, step: str, parent: str, value: str) -> str:
    """A CTE with the elements (project_id, parent_path, item_path, v) of an array of the records in ``src``."""
    x, cond = _dec(f"json_extract({value}, '{step}')") if "brief" not in step else _dec(f"json_extract({_dec(f'json_extract({value}, {chr(39)}$.brief{chr(39)})')}, '$.keyPoints')"), f"json_type({value}) = 'OBJECT'"
    name = step[2:].replace('"', "")
    return f"""{cte}0 AS (SELECT project_id, {parent} AS parent_path, {x} AS a FROM {src} WHERE {cond}),
 {cte}1 AS (SELECT project_id, parent_path, CASE json_type(a) WHEN 'ARRAY' THEN json_extract(a, '$[*]') WHEN 'NULL' THEN []::JSON[] ELSE [a] END AS l FROM {cte}0 WHERE a IS NOT NULL),
 {cte}2 AS (SELECT project_id, parent_path, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS i FROM {cte}1),
 {cte} AS (SELECT project_id, parent_path, CASE WHEN parent_path = '' THEN '' ELSE parent_path || '.' END || '{name}[' || i || ']' AS item_path, {_dec('e')} AS v FROM {cte}2 WHERE json_type({_dec('e')}) <> 'NULL')"""


P4_NODES = f"""
WITH cur AS (SELECT id AS project_id, metadata FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, metadata DESC) AS rn FROM projects WHERE id IS NOT NULL) WHERE rn = 1),
 j0 AS (SELECT project_id, metadata::JSON AS v FROM cur WHERE json_valid(metadata)), j AS (SELECT project_id, {_dec('v')} AS v FROM j0),
 pr AS (SELECT project_id, {_dec("json_extract(v, '$.projectRecomposition')")} AS v FROM j WHERE json_type(v) = 'OBJECT'), mr AS (SELECT project_id, {_dec("json_extract(v, '$.mapRecomposition')")} AS v FROM j WHERE json_type(v) = 'OBJECT'),
 {_items('ps', 'pr', '$.sources', "''", 'v')}, {_items('kp', 'ps', '$.brief.keyPoints', 'item_path', 'v')}, {_items('ms', 'mr', '$.sources', "''", 'v')}, {_items('an', 'ms', '$.anchors', 'item_path', 'v')},
 {_items('re', 'ms', '$.results', 'item_path', 'v')}, {_items('ev', 're', '$.evidence', 'item_path', 'v')}, {_items('att', 'ms', '$.attachments', 'item_path', 'v')},
 nodes AS (SELECT project_id, replace(parent_path, 'sources[', 'projectRecomposition.sources[') AS parent_path, replace(item_path, 'sources[', 'projectRecomposition.sources[') AS item_path, v, t FROM (SELECT *, 'project_source' AS t FROM ps UNION ALL SELECT *, 'key_point' FROM kp)
 UNION ALL SELECT project_id, replace(parent_path, 'sources[', 'mapRecomposition.sources['), replace(item_path, 'sources[', 'mapRecomposition.sources['), v, t FROM (SELECT *, 'map_source' AS t FROM ms UNION ALL SELECT *, 'anchor' FROM an UNION ALL SELECT *, 'result' FROM re UNION ALL SELECT *, 'evidence' FROM ev UNION ALL SELECT *, 'attachment' FROM att))
"""

ORACLES = {
    "p4_found": P4_NODES + "SELECT project_id, parent_path, item_path, CASE WHEN json_type(v) = 'OBJECT' THEN coalesce(json_extract_string(v, '$.id'), '') ELSE '' END AS item_id FROM nodes",
    "p4_node_counts": P4_NODES + "SELECT t AS node_type, count(*) AS nodes, count(DISTINCT project_id) AS documents FROM nodes GROUP BY 1",
    "p6_found": _P6 + "SELECT * FROM found",
    "p6_counts": _P6
    + "SELECT tbl, ref_month, reason, count(*) AS refs, count(DISTINCT to_key) AS keys FROM found GROUP BY tbl, ref_month, reason",
}
