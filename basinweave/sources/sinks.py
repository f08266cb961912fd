"""Sinks: Parquet store, JSON lines, GeoJSON, Graphviz text and a readme for a project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_store(entities: DataFrame, triples: DataFrame, folder: str) -> None:
    """Entities by layer-free type and triples by predicate, so that later filters on these prune files."""
    entities.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/entities")
    triples.write.mode("overwrite").partitionBy("predicate").parquet(f"{folder}/triples")


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def geojson_features(features: DataFrame) -> DataFrame:
    """(value): one GeoJSON feature a line, from id, name, type and box columns."""
    ring = F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat"))])
    dot = (F.col("min_lon") == F.col("max_lon")) & (F.col("min_lat") == F.col("max_lat"))
    geometry = F.when(dot, F.to_json(F.struct(F.lit("Point").alias("type"), F.array("min_lon", "min_lat").alias("coordinates")))).otherwise(
        F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    )
    props = F.to_json(F.struct("name", "type"))
    return features.select(F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.struct("id")).substr(F.lit(7), F.length(F.to_json(F.struct("id"))) - 7), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Features as GeoJSON, one a line."""
    geojson_features(features).write.mode("overwrite").text(path)


def write_dot(lines: DataFrame, path: str) -> None:
    """Lines of ``graph.to_dot`` inside a digraph, in order."""
    ends = lines.sparkSession.createDataFrame([(0, "", "digraph {"), (9, "", "}")], "ord int, key string, line string")
    lines.unionByName(ends).repartitionByRange("ord", "key").sortWithinPartitions("ord", "key").select("line").write.mode("overwrite").text(path)


def project_readme(projects: DataFrame, counts: DataFrame) -> DataFrame:
    """(project_id, readme): a short text with name, description and the number of entities per type (counts: project_id, type, n)."""
    table = counts.groupBy("project_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "type", F.lit(": "), F.col("n").cast("string")))), "\n").alias("t"))
    head = F.concat(F.lit("# "), F.coalesce("name", "id"), F.lit("\n\n"), F.coalesce("description", F.lit("")), F.lit("\n\n## Entities\n\n"), F.coalesce("t", F.lit("none")), F.lit("\n"))
    return projects.join(table, projects["id"] == table["project_id"], "left").select(F.col("id").alias("project_id"), head.alias("readme"))
