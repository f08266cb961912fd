"""Entities and subject-predicate-object triples: upserts, validation, lookups, paths, patterns and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basinweave.functions.js import attr, first_true

STATES = ("extracted", "reviewed", "verified", "uncertain", "rejected")


def latest_entities(entities: DataFrame, *columns: str) -> DataFrame:
    """One row per id: the one that was written last. One shuffle on the id, with partial maxima before it.

    Only ``columns`` are read and kept if any are given; a maximum over whole rows would keep the scan from being pruned.
    """
    cols = list(dict.fromkeys(columns)) or [c for c in entities.columns if c != "id"]
    order = F.struct("seq", "created_at", "ingested_at")
    best = F.max_by(F.struct(*cols), order).alias("_e")
    return entities.where("id is not null").groupBy("id").agg(best).select("id", *[F.col(f"_e.{c}").alias(c) for c in cols])


def distinct_triples(triples: DataFrame, *columns: str) -> DataFrame:
    """One row per triple id, repeated rows removed; only ``columns`` if any are given."""
    cols = list(dict.fromkeys(columns)) or [c for c in triples.columns if c != "triple_id"]
    best = F.max_by(F.struct(*cols), F.struct("seq", "created_at")).alias("_t")
    return triples.where("triple_id is not null").groupBy("triple_id").agg(best).select("triple_id", *[F.col(f"_t.{c}").alias(c) for c in cols])


def display_name(name: Column | None = None) -> Column:
    """Name of an entity for people: its name, title, statement or text, else its id."""
    own = [name] if name is not None else []
    return first_true(*own, attr("name"), attr("title"), attr("statement"), attr("text"), F.col("id"))


def validate_triples(triples: DataFrame, entities: DataFrame, relations: DataFrame, entity_object: Column) -> DataFrame:
    """Adds ``reject_reason``: null for triples that may be stored.

    The subject must exist, an object that has the form of an id must exist, and the predicate must be registered. Ids are
    joined by left joins on distinct keys, so every triple comes out once.
    """
    ids = entities.select(F.col("id").alias("_id")).where("_id is not null").distinct()
    s = ids.select(F.col("_id").alias("subject"), F.lit(True).alias("_s"))
    o = ids.select(F.col("_id").alias("object"), F.lit(True).alias("_o"))
    p = relations.select(F.col("name").alias("predicate"), F.lit(True).alias("_p")).distinct()
    known = triples.join(s, "subject", "left").join(o, "object", "left").join(F.broadcast(p), "predicate", "left")
    reason = (
        F.when(F.col("_s").isNull(), F.lit("missing_subject"))
        .when(entity_object & F.col("_o").isNull(), F.lit("missing_object"))
        .when(F.col("_p").isNull(), F.lit("unregistered_predicate"))
    )
    return known.withColumn("reject_reason", reason).drop("_s", "_o", "_p").select(*triples.columns, "reject_reason")


def query(triples: DataFrame, subject: str | None = None, predicate: str | None = None) -> DataFrame:
    """Objects of a subject, all with their predicate, in the order of writing."""
    out = triples
    if subject is not None:
        out = out.where(F.col("subject") == subject)
    if predicate is not None:
        out = out.where(F.col("predicate") == predicate)
    return out.select("subject", "predicate", "object", "seq")


def query_inverse(triples: DataFrame, predicate: str | None = None, obj: str | None = None) -> DataFrame:
    """Subjects by predicate, object or both; nothing if neither is given."""
    if predicate is None and obj is None:
        return triples.select("subject", "predicate", "object").limit(0)
    out = triples
    if predicate is not None:
        out = out.where(F.col("predicate") == predicate)
    if obj is not None:
        out = out.where(F.col("object") == obj)
    return out.select("subject", "predicate", "object")


def query_path(starts: DataFrame, triples: DataFrame, predicates: list[str], entities: DataFrame | None = None, keep_start: bool = True) -> DataFrame:
    """(start, end, walks) of all walks along the predicates, with their number. ``starts``: id.

    Walks are counted, not listed, between hops: equal (start, end) pairs are merged with their number before the next join, so that
    bags do not multiply the rows that are shuffled. Where only the ends are asked for, ``keep_start`` False merges all that have come
    to one place: (end, walks).
    """
    walks = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).groupBy("start", "at").agg(F.count("*").alias("walks"))
    keys = ["start"] if keep_start else []
    for p in predicates:
        hop = triples.where(F.col("predicate") == p).groupBy(F.col("subject").alias("at"), F.col("object").alias("next")).agg(F.count("*").alias("n"))
        walks = walks.join(hop, "at").groupBy(*keys, F.col("next").alias("at")).agg(F.sum(F.col("walks") * F.col("n")).alias("walks"))
    if entities is not None:
        walks = walks.join(entities.select(F.col("id").alias("at")), "at", "left_semi")
    return walks.select(*keys, F.col("at").alias("end"), "walks")


def attribute_is(name: str, value: str | bool | int | float, json: str = "attributes") -> Column:
    """Whether an attribute has a value of the same type: the text '1' is not the number 1."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(json), f"$.{name}", "variant"))
    if isinstance(value, bool):
        return (attr(name, json) == str(value).lower()) & (kind == "BOOLEAN")
    if isinstance(value, (int, float)):
        return (attr(name, json).try_cast("double") == float(value)) & ~kind.isin("STRING", "BOOLEAN")
    return (attr(name, json) == value) & (kind == "STRING")


def match(
    entities: DataFrame,
    triples: DataFrame,
    type_: str | None = None,
    attributes: dict[str, str | bool | int | float] | None = None,
    relations: list[tuple[str, dict[str, str | bool | int | float] | None]] | None = None,
) -> DataFrame:
    """Entities of a type with the given attribute values and, for each relation, at least one object that fits its pattern.

    A pattern's ``type`` is the object's type; its other keys are attributes, whose values must have the same type too.
    """
    out = entities
    if type_ is not None:
        out = out.where(F.col("type") == type_)
    for k, v in (attributes or {}).items():
        out = out.where(attribute_is(k, v))
    for predicate, pattern in relations or []:
        edges = triples.where(F.col("predicate") == predicate).select(F.col("subject").alias("id"), "object")
        if pattern is not None:
            objects = entities
            for k, v in pattern.items():
                objects = objects.where((F.col("type") == v) if k == "type" else attribute_is(k, v))
            edges = edges.join(objects.select(F.col("id").alias("object")), "object", "left_semi")
        out = out.join(edges.select("id"), "id", "left_semi")
    return out


def relations_of(ids: DataFrame, triples: DataFrame) -> DataFrame:
    """(id, direction, predicate, other, confidence): outgoing and incoming relations; a loop is in both."""
    keys = ids.select("id").distinct()
    out = triples.join(keys.withColumnRenamed("id", "subject"), "subject").select(
        F.col("subject").alias("id"), F.lit("out").alias("direction"), "predicate", F.col("object").alias("other"), "confidence", "verification_state"
    )
    inc = triples.join(keys.withColumnRenamed("id", "object"), "object").select(
        F.col("object").alias("id"), F.lit("in").alias("direction"), "predicate", F.col("subject").alias("other"), "confidence", "verification_state"
    )
    return out.unionByName(inc)


def explore(ids: DataFrame, triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of entities with the type, name and source of the other end, where that is an entity."""
    other = entities.select(F.col("id").alias("other"), F.col("type").alias("other_type"), display_name(F.col("name")).alias("other_name"), F.col("source").alias("other_source"))
    return relations_of(ids, triples).join(other, "other", "left")


def stats(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(measure, value, n): counts of entities by type and state and of triples by predicate and state, in one pass each."""
    state = F.coalesce("verification_state", F.lit("extracted"))
    e = entities.select("type", state.alias("state")).groupingSets([["type"], ["state"], []], "type", "state").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    e = e.select(
        F.when(F.col("g") == 3, "entities").when(F.col("g") == 1, "entity_type").otherwise("entity_state").alias("measure"),
        F.when(F.col("g") == 1, F.col("type")).when(F.col("g") == 2, F.col("state")).alias("value"),
        "n",
    )
    t = triples.select("predicate", state.alias("state")).groupingSets([["predicate"], ["state"], []], "predicate", "state").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    t = t.select(
        F.when(F.col("g") == 3, "triples").when(F.col("g") == 1, "predicate").otherwise("triple_state").alias("measure"),
        F.when(F.col("g") == 1, F.col("predicate")).when(F.col("g") == 2, F.col("state")).alias("value"),
        "n",
    )
    return e.unionByName(t)


def in_state(df: DataFrame, state: str) -> DataFrame:
    """Rows in a verification state; rows without one count as extracted."""
    if state not in STATES:
        raise ValueError(f"unknown verification state {state!r}")
    return df.where(F.coalesce("verification_state", F.lit("extracted")) == state)


def verify(df: DataFrame, where: Column, state: str, reviewer: str, at: str, note: str | None = None) -> DataFrame:
    """Sets state, reviewer and time of the rows that ``where`` holds for, and appends a note."""
    if state not in STATES:
        raise ValueError(f"unknown verification state {state!r}")
    when = F.lit(at).cast("timestamp")
    out = df.withColumn("_hit", F.coalesce(where, F.lit(False)))
    where = F.col("_hit")
    out = out.withColumn("verification_state", F.when(where, F.lit(state)).otherwise(F.col("verification_state")))
    for name, value in (("reviewed_by", F.lit(reviewer)), ("reviewed_at", when)):
        if name in df.columns:
            out = out.withColumn(name, F.when(where, value.cast(df.schema[name].dataType)).otherwise(F.col(name)))
    if note is not None and "notes" in df.columns:
        kind = df.schema["notes"].dataType
        entry = F.struct(F.lit(note).alias("text"), F.lit(reviewer).alias("by"), when.alias("at"))
        out = out.withColumn("notes", F.when(where, F.concat(F.coalesce("notes", F.array().cast(kind)), F.array(entry).cast(kind))).otherwise(F.col("notes")))
    return out.drop("_hit")


def new_ids(df: DataFrame, prefix: Column, *keys: str) -> Column:
    """Ids that depend on the natural key only."""
    return F.concat_ws("-", prefix, F.substring(F.sha2(F.concat_ws("\x1f", *keys), 256), 1, 10))


def to_dot(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """(ord, key, line): lines of a Graphviz digraph: nodes and the edges between entities."""
    quote = lambda c: F.regexp_replace(c, '"', '\\\\\\\\"')
    nodes = entities.select(
        F.lit(1).alias("ord"), F.col("id").alias("key"), F.format_string('  "%s" [label="%s\\n%s"];', "id", "type", quote(display_name(F.col("name")))).alias("line")
    )
    ids = entities.select("id").distinct()
    edges = triples.join(ids.withColumnRenamed("id", "subject"), "subject", "left_semi").join(ids.withColumnRenamed("id", "object"), "object", "left_semi")
    edges = edges.select(F.lit(2).alias("ord"), F.col("triple_id").alias("key"), F.format_string('  "%s" -> "%s" [label="%s"];', "subject", "object", "predicate").alias("line"))
    return nodes.unionByName(edges)
