"""Process-mining log: lifecycles, collaboration of objects, counts. Events: event_id, ts, type, objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lift_events(events: DataFrame) -> DataFrame:
    """Event rows with the objects they touch: the user, the type and the key in their properties."""
    key = F.get_json_object("props", "$.k")
    objects = F.array(F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.concat(F.lit("type-"), F.col("event_type")), F.concat(F.lit("k-"), key))
    return events.select("event_id", "ts", F.col("event_type").alias("type"), F.filter(objects, lambda x: x.isNotNull()).alias("objects"), F.col("value"))


def object_events(log: DataFrame) -> DataFrame:
    """One row per event and object."""
    return log.select("event_id", "ts", "type", F.explode(F.array_distinct("objects")).alias("object"))


def lifecycle(log: DataFrame) -> DataFrame:
    """Events of each object: number, first, last, span in seconds, and the distinct other objects met."""
    each = log.select("event_id", "ts", F.explode(F.array_distinct("objects")).alias("object"), (F.size(F.array_distinct("objects")) - 1).alias("others"))
    return each.groupBy("object").agg(
        F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("others").alias("met"),
    )


def lifecycle_of(log: DataFrame, obj: str) -> DataFrame:
    """Events of one object in order, with the other objects of each."""
    hit = log.where(F.array_contains("objects", obj))
    return hit.select("event_id", "ts", "type", F.array_join(F.array_sort(F.array_except("objects", F.array(F.lit(obj)))), ",").alias("others"))


def collaboration(log: DataFrame) -> DataFrame:
    """(a, b, times): unordered pairs of objects and the events they share.

    Pairs are formed inside each event, whose objects are few, not by joining events on objects, which would square hot objects.
    """
    ordered = F.array_sort(F.array_distinct("objects"))
    first = log.select(F.posexplode(ordered).alias("i", "a"), ordered.alias("all"))
    return first.select("a", F.explode(F.slice("all", F.col("i") + 2, F.size("all"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("times"))


def top_objects(log: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` most active objects."""
    return object_events(log).groupBy("object").agg(F.count("*").alias("events")).orderBy(F.desc("events"), "object").limit(k)


def type_stats(log: DataFrame) -> DataFrame:
    """Events and distinct objects per type."""
    return log.select("event_id", "type", F.explode_outer("objects").alias("object")).groupBy("type").agg(
        F.countDistinct("event_id").alias("events"), F.countDistinct("object").alias("objects")
    )
