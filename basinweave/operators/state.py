"""Keyed state: applications, invitations, sessions, projects and limits, as results of folds over their rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def clean_email(c: Column) -> Column:
    """Address as a key: trimmed, in lower case."""
    return F.lower(F.trim(c))


def current_rows(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by the given columns."""
    cols = [c for c in df.columns if c != key]
    best = F.max_by(F.struct(*cols), F.struct(*order)).alias("_b")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_b.{c}").alias(c) for c in cols])


def active_invites(invites: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Adds ``usable``: active and at most ``days`` days old at ``as_of``."""
    age = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return invites.withColumn("usable", F.coalesce(F.col("status") == "active", F.lit(False)) & F.coalesce(F.col("created_at") >= age, F.lit(False)))


def latest_sessions(events: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One session per user: the last event that opened one, and whether it still holds at ``as_of``."""
    last = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    until = F.col("m.ts") + F.make_dt_interval(days=F.lit(days))
    return last.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("issued_at"), (until > F.lit(as_of).cast("timestamp_ntz")).alias("valid"))


def window_counts(attempts: DataFrame, key: str, at: str, seconds: int = 3600) -> DataFrame:
    """Adds ``in_window``: attempts of the key within the last ``seconds``, itself included, denied ones too."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return attempts.withColumn("in_window", F.count("*").over(w))


def rate_limit(attempts: DataFrame, key: str, at: str, ident: str, limit: int = 3, seconds: int = 3600) -> DataFrame:
    """(key, ident, at, allowed): at most ``limit`` allowed attempts in any ``seconds``; denied attempts do not count.

    Rows are sorted within partitions of the key and folded as they stream by; the state is the last ``limit`` allowed times of
    one key, so a key with a third of all rows takes time but no memory.
    """
    rows = attempts.select(F.col(key).cast("string").alias("key"), F.col(ident).cast("string").alias("ident"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    rows = rows.where("key is not null and us is not null").repartition("key").sortWithinPartitions("key", "us", "ident")
    span = seconds * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seen = None, deque(maxlen=limit)
        for pdf in batches:
            out = []
            for k, us in zip(pdf["key"], pdf["us"]):
                if k != current:
                    current, seen = k, deque(maxlen=limit)
                ok = len(seen) < limit or us - seen[0] >= span
                if ok:
                    seen.append(us)
                out.append(ok)
            yield pdf.assign(allowed=out)

    return rows.mapInPandas(fold, "key string, ident string, us long, allowed boolean")


def merge_quota(current: Column, changes: Column) -> Column:
    """Quota map with changes put over it; values outside 1 to 10000 are left out."""
    valid = F.map_filter(changes, lambda k, v: (v >= 1) & (v <= 10000))
    kept = F.map_filter(current, lambda k, v: ~F.array_contains(F.map_keys(valid), k))
    return F.map_concat(kept, valid)


def analysis_state(progress: DataFrame) -> DataFrame:
    """State of each project's analysis from its phase events (project_id, phase, status, seq): failed, completed, inProgress or pending."""
    last = progress.groupBy("project_id", "phase").agg(F.max_by("status", F.struct("seq", "status")).alias("status"))
    done = F.count_if(F.col("status") == "completed")
    return last.groupBy("project_id").agg(
        F.when(F.count_if(F.col("status") == "failed") > 0, "failed").when(done == F.count("*"), "completed").when(F.count_if(F.col("status") != "pending") > 0, "inProgress").otherwise("pending").alias("state"),
        done.alias("done"), F.count("*").alias("phases"),
    )


def add_members(members: DataFrame, added: DataFrame) -> DataFrame:
    """Members (project_id, id) with further ones, each once."""
    return members.select("project_id", "id").unionByName(added.select("project_id", "id")).distinct()


def remove_members(members: DataFrame, removed: DataFrame) -> DataFrame:
    """Members without the given ones."""
    return members.join(removed.select("project_id", "id"), ["project_id", "id"], "left_anti")


def delete_projects(entities: DataFrame, triples: DataFrame, members: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and triples without those that only the given projects (project_id) have."""
    gone = members.join(projects, "project_id", "left_semi").select("id").distinct()
    kept = members.join(projects, "project_id", "left_anti").select("id").distinct()
    drop = gone.join(kept, "id", "left_anti")
    rest = entities.join(drop, "id", "left_anti")
    edges = triples.join(drop.withColumnRenamed("id", "subject"), "subject", "left_anti").join(drop.withColumnRenamed("id", "object"), "object", "left_anti")
    return rest, edges


def export_triples(members: DataFrame, triples: DataFrame) -> DataFrame:
    """(project_id, triple_id) of the triples with either end in a project; two joins, not one on an OR."""
    a = triples.join(members.select("project_id", F.col("id").alias("subject")), "subject").select("project_id", "triple_id")
    b = triples.join(members.select("project_id", F.col("id").alias("object")), "object").select("project_id", "triple_id")
    return a.unionByName(b).distinct()


def export_entities(members: DataFrame, entities: DataFrame) -> DataFrame:
    """The entities of each project, with all their columns; members that do not exist are left out."""
    return members.select("project_id", "id").distinct().join(entities, "id")


def export_events(members: DataFrame, log: DataFrame) -> DataFrame:
    """The events (event_id, objects and others) that name any member of a project, once for each project."""
    named = log.select("event_id", F.explode("objects").alias("id")).join(members.select("project_id", "id").distinct(), "id").select("project_id", "event_id").distinct()
    return named.join(log, "event_id")


def export_chains(members: DataFrame, entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(project_id, start, id, level): the evidence chain of each claim and hypothesis of a project; each chain is followed once."""
    from basinweave.operators.evidence import chain_nodes

    claims = members.select("project_id", "id").distinct().join(entities.where(F.col("type").isin("Claim", "Hypothesis")).select("id"), "id", "left_semi")
    nodes = chain_nodes(claims.select("id").distinct(), entities, triples)
    return claims.withColumnRenamed("id", "start").join(nodes, "start").select("project_id", "start", "id", "level")
