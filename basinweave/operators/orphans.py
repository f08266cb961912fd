"""References to records that do not exist, kept as signed counts per key.

Every change of a referring or a referred table is a delta: +1/-1 reference of a key, or +1/-1 existence of it, with the time
of creation. ``key_state`` sums the deltas per key (partial sums before the shuffle, so a key that holds a third of all rows
costs one row per task). Where deltas also take back, the times of what is gone must not count any more: ``timed_state`` keeps the
signed sums per key and time (of references only the day, so that a hot key has no more rows than days), ``merge_state`` adds a later
batch of deltas to it, and ``state_of_times`` gives the state per key. Keys with references and no existence are the orphans; keys
created after a reference are late for it. ``orphan_references`` joins only these keys back to the references. That join is on a
skewed key: healthy hot keys are gone from the small side by then, and a hot orphan key is split by adaptive skew handling.

Defined cases: keys are trimmed and in lower case; null and blank keys refer to nothing; null times of a reference are never
late and have a null month; repeated rows count once in the report; empty tables give empty reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Form of an entity id, after cleaning (fixed format of the data).
ENTITY_KEY = r"^(cap|dom|fnd|src|wld)-[0-9a-f]{10}$"


def clean_key(c: Column) -> Column:
    """Key without surrounding white space, in lower case."""
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def reference_rows(df: DataFrame, tbl: str, from_key: str, to_key: Column, at: str, pattern: str | None = None) -> DataFrame:
    """Uniform reference rows (tbl, kind-free): from_key, to_key, ref_at; rows that refer to nothing are left out."""
    key = clean_key(to_key)
    rows = df.select(F.lit(tbl).alias("tbl"), F.col(from_key).alias("from_key"), key.alias("to_key"), F.col(at).alias("ref_at"))
    rows = rows.where(F.col("to_key").isNotNull() & (F.col("to_key") != "") & F.col("from_key").isNotNull())
    return rows.where(F.col("to_key").rlike(pattern)) if pattern else rows


def existence_rows(df: DataFrame, id_col: str, at: str) -> DataFrame:
    """to_key and its time of creation, for each row of a referred table."""
    return df.select(clean_key(F.col(id_col)).alias("to_key"), F.col(at).alias("created_at")).where("to_key is not null and to_key != ''")


def reference_deltas(refs: DataFrame, sign: int = 1) -> DataFrame:
    """References as deltas; ``sign`` -1 takes them back."""
    return refs.select(
        "to_key",
        F.lit(sign).cast("long").alias("refs"),
        F.lit(0).cast("long").alias("rows"),
        F.lit(None).cast("timestamp").alias("first_created"),
        F.col("ref_at").cast("timestamp").alias("first_ref"),
    )


def existence_deltas(exists: DataFrame, sign: int = 1) -> DataFrame:
    """Existence as deltas; ``sign`` -1 stands for a deleted row."""
    return exists.select(
        "to_key",
        F.lit(0).cast("long").alias("refs"),
        F.lit(sign).cast("long").alias("rows"),
        F.col("created_at").cast("timestamp").alias("first_created"),
        F.lit(None).cast("timestamp").alias("first_ref"),
    )


def key_state(deltas: DataFrame) -> DataFrame:
    """One row per key: sums of references and existence, earliest creation and earliest reference. Deltas may not take back."""
    return deltas.groupBy("to_key").agg(
        F.sum("refs").alias("refs"),
        F.sum("rows").alias("rows"),
        F.min("first_created").alias("first_created"),
        F.min("first_ref").alias("first_ref"),
    )


def timed_state(deltas: DataFrame) -> DataFrame:
    """(to_key, refs, rows, first_created, first_ref): signed sums per key, time of creation and day of reference; those that cancel are gone."""
    days = deltas.withColumn("first_ref", F.date_trunc("day", "first_ref"))
    sums = days.groupBy("to_key", "first_created", "first_ref").agg(F.sum("refs").alias("refs"), F.sum("rows").alias("rows"))
    return sums.where("refs != 0 or rows != 0").select("to_key", "refs", "rows", "first_created", "first_ref")


def merge_state(state: DataFrame, deltas: DataFrame) -> DataFrame:
    """The state per key and time after a further batch of deltas, in any order; also after rows that were taken back."""
    return timed_state(state.select("to_key", "refs", "rows", "first_created", "first_ref").unionByName(deltas))


def state_of_times(timed: DataFrame) -> DataFrame:
    """The state per key of a ``timed_state``. References are known to the day, so ``first_ref`` may be up to a day early; which
    reference is late is decided by its own time afterwards."""
    return timed.groupBy("to_key").agg(
        F.sum("refs").alias("refs"),
        F.sum("rows").alias("rows"),
        F.min(F.when(F.col("rows") > 0, F.col("first_created"))).alias("first_created"),
        F.min(F.when(F.col("refs") > 0, F.col("first_ref"))).alias("first_ref"),
    )


def orphan_keys(state: DataFrame) -> DataFrame:
    """Keys with positive references and no existence, or created after their earliest reference, of a state per key or key and time."""
    state = state_of_times(state)
    missing = F.col("rows") <= 0
    late = F.col("first_created") > F.col("first_ref")
    return state.where((F.col("refs") > 0) & (missing | late)).select(
        "to_key", missing.alias("missing"), F.col("first_created").alias("key_created")
    )


def orphan_references(refs: DataFrame, exists: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """(tbl, ref_month, from_key, to_key, reason) of all references whose key is missing or was created later.

    ``state`` is the state per key, where it has been kept from deltas; ``refs`` are then the references that stand.
    """
    state = key_state(reference_deltas(refs).unionByName(existence_deltas(exists))) if state is None else state
    hit = refs.join(orphan_keys(state), "to_key")
    late = F.col("key_created") > F.col("ref_at")
    return (
        hit.where(F.col("missing") | late)
        .select(
            "tbl",
            F.date_format("ref_at", "yyyy-MM").alias("ref_month"),
            "from_key",
            "to_key",
            F.when(F.col("missing"), F.lit("missing")).otherwise(F.lit("late")).alias("reason"),
        )
        .distinct()
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphan references per table, month and reason."""
    return found.groupBy("tbl", "ref_month", "reason").agg(F.count("*").alias("refs"), F.countDistinct("to_key").alias("keys"))


def graph_references(triples: DataFrame, projects: DataFrame, invites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to entities (of triples and of each project's latest row), and references to applications."""
    from basinweave.operators.nested import latest_rows

    ends = triples.select("triple_id", "created_at", F.explode(F.array("subject", "object")).alias("end"))
    members = latest_rows(projects.select("id", "updated_at", "entities"), "id", "updated_at", "entities").select(
        "id", "updated_at", F.explode("entities").alias("end")
    )
    to_entities = reference_rows(ends, "triples", "triple_id", F.col("end"), "created_at", ENTITY_KEY).unionByName(
        reference_rows(members, "projects", "id", F.col("end"), "updated_at", ENTITY_KEY)
    )
    to_applications = reference_rows(invites, "invites", "code", F.col("application_id"), "created_at")
    return to_entities, to_applications
