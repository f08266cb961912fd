"""Decomposition of sources into typed objects and relations: extraction, merging, scope, bridges, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
SKIP_SECTIONS = (
    "this article is cited by", "cited by", "associated content", "related articles", "similar content", "recommended", "author information", "author contributions",
    "competing interests", "ethics declarations", "additional information", "rights and permissions", "about this article", "metrics", "comments", "references",
)
RELATION_ALIASES: dict[str, str] = {
    "covered-by": "covers", "observed-by": "observes", "measured-by": "measures", "simulate": "simulates", "predict": "predicts", "forecasts": "predicts", "forecast": "predicts",
    "model": "models", "has-variable": "has_variable", "contains-variable": "has_variable", "uses-variable": "has_variable", "responds-to": "responds_to", "responds": "responds_to",
    "evaluates": "assesses", "validates": "assesses", "calibrates": "assesses", "compares-to": "assesses", "compares": "assesses", "feeds": "supports", "uses": "supports",
    "uses-data": "supports", "trains": "supports", "input-to": "supports", "applicable-to": "applicable_to", "applies-to": "applicable_to", "transferable-to": "transferable_to",
    "limited-by": "limited_by", "constrained-by": "limited_by",
}
BRIDGE_MATRIX: dict[str, dict[str, str]] = {
    "Dataset": {"covers": "Basin Region Watershed Glacier Lake", "contains": "EarthVariable Streamflow Precipitation"},
    "Satellite": {"observes": "EarthVariable Streamflow Precipitation Temperature Basin Region"},
    "Gauge": {"measures": "Streamflow", "located_at": "River Basin"},
    "Station": {"measures": "EarthVariable Temperature Precipitation", "located_at": "Region"},
    "Model": {"simulates": "Basin Watershed River", "predicts": "Streamflow Precipitation", "forecasts": "FloodEvent DroughtEvent"},
    "Simulation": {"simulates": "Basin Region"},
    "Policy": {"applies_to": "Region Basin", "addresses": "EarthRisk", "mitigates": "FloodRisk DroughtRisk"},
    "Institution": {"jurisdiction_over": "Region Basin"},
    "Intervention": {"reduces": "EarthRisk FloodRisk DroughtRisk", "targets": "Region"},
    "AdaptationMeasure": {"mitigates": "FloodRisk DroughtRisk", "addresses": "Heatwave"},
    "Assessment": {"evaluates": "Region Basin", "assesses": "EarthRisk"},
}
EXPECTED = {"deep": (3, 5, 2, 5), "structured": (2, 3, 1, 3), "light": (1, 0, 0, 0)}


def paper_objects(papers: DataFrame) -> DataFrame:
    """(source_id, type, name, confidence, pos, origin) of the objects that papers name: datasets, regions they cover, variables, coverage."""
    latest = papers.where("paper_id is not null")
    ds = latest.select(F.col("paper_id").alias("source_id"), F.posexplode("datasets").alias("pos", "d"))
    data = ds.select("source_id", F.lit("Dataset").alias("type"), F.col("d.name").alias("name"), F.lit(0.8).alias("confidence"), "pos", F.lit("datasets").alias("origin"))
    region = ds.where("lower(d.spatial_coverage) != 'global'").select(
        "source_id", F.lit("Region").alias("type"), F.col("d.spatial_coverage").alias("name"), F.lit(0.8).alias("confidence"), "pos", F.lit("coverage").alias("origin")
    )
    kw = latest.select(F.col("paper_id").alias("source_id"), F.posexplode("keywords").alias("pos", "k"))
    var = kw.select("source_id", F.lit("Variable").alias("type"), F.col("k").alias("name"), F.lit(0.9).alias("confidence"), "pos", F.lit("keywords").alias("origin"))
    return data.unionByName(region).unionByName(var).where("name is not null and trim(name) != ''")


def merge_first_wins(objects: DataFrame) -> DataFrame:
    """Objects of each source once per type and name, without regard to case; the first stays."""
    order = Window.partitionBy("source_id", "type", F.lower(F.trim("name"))).orderBy("origin", "pos", "name")
    return objects.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def merge_by_priority(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Objects of ``primary`` and those of ``fallback`` that it lacks, by source, type and name."""
    key = lambda df: df.withColumn("_k", F.lower(F.trim("name")))
    rest = key(fallback).join(key(primary).select("source_id", "type", "_k").distinct(), ["source_id", "type", "_k"], "left_anti").drop("_k")
    return merge_first_wins(primary.unionByName(rest))


def out_of_scope(section: Column) -> Column:
    """Whether a section of a source is no part of its own content (references and the like)."""
    s = F.lower(F.coalesce(section, F.lit("")))
    return F.exists(F.array(*map(F.lit, SKIP_SECTIONS)), lambda x: F.contains(s, x))


def canonical_relation(name: Column) -> Column:
    """Relation that a freely written name means; unknown names in lower case with hyphens."""
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), r"[\s_]+", "-")
    table = F.create_map(*[F.lit(x) for kv in RELATION_ALIASES.items() for x in kv])
    return F.when(n == "", name).otherwise(F.coalesce(F.try_element_at(table, n), n))


def bridge_relations(subjects: DataFrame, objects: DataFrame, by: str) -> DataFrame:
    """(by, subject, object, predicate, confidence): relations that the types of two objects of one source suggest.

    Both sides are reduced to types that occur in the matrix before they meet, and they meet on the source and the type pair.
    """
    spark = subjects.sparkSession
    rows = [(s, o, p) for s, ps in BRIDGE_MATRIX.items() for p, os_ in ps.items() for o in os_.split()]
    matrix = spark.createDataFrame(rows, "subject_type string, object_type string, predicate string")
    s = subjects.select(by, F.col("id").alias("subject"), F.col("type").alias("subject_type")).join(F.broadcast(matrix), "subject_type")
    o = objects.select(by, F.col("id").alias("object"), F.col("type").alias("object_type"))
    return s.join(o, [by, "object_type"]).where("subject != object").select(by, "subject", "object", "predicate", F.lit(0.75).alias("confidence")).distinct()


def bridge_counts(entities: DataFrame, by: str) -> DataFrame:
    """(by, predicate, n): number of relations that ``bridge_relations`` would give within each source, without listing them.

    Entities are counted per source and type first, so a source with a third of all entities costs a row per type.
    """
    rows = [(s, o, p) for s, ps in BRIDGE_MATRIX.items() for p, os_ in ps.items() for o in os_.split()]
    matrix = entities.sparkSession.createDataFrame(rows, "subject_type string, object_type string, predicate string")
    n = entities.groupBy(by, "type").agg(F.countDistinct("id").alias("n"))
    s = n.select(by, F.col("type").alias("subject_type"), F.col("n").alias("ns")).join(F.broadcast(matrix), "subject_type")
    o = n.select(by, F.col("type").alias("object_type"), F.col("n").alias("no"))
    return s.join(o, [by, "object_type"]).groupBy(by, "predicate").agg(F.sum(F.col("ns") * F.col("no")).alias("n"))


def paper_triples(objects: DataFrame) -> DataFrame:
    """(source_id, subject, predicate, object, confidence): what a paper's objects say of each other: it uses its datasets, studies its
    regions, and a dataset covers the region named with it."""
    d = objects.where("type = 'Dataset'").select("source_id", "pos", F.col("name").alias("dataset"))
    r = objects.where("type = 'Region'").select("source_id", "pos", F.col("name").alias("region"))
    edge = lambda df, s, p, o, c: df.select("source_id", s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"), F.lit(c).alias("confidence"))
    uses = edge(d, F.col("source_id"), "uses", F.col("dataset"), 0.8)
    studies = edge(r, F.col("source_id"), "studies", F.col("region"), 0.8)
    covers = edge(d.join(r, ["source_id", "pos"]), F.col("dataset"), "covers", F.col("region"), 0.7)
    return uses.unionByName(studies).unionByName(covers).distinct()


def extraction_confidence(depth: Column, capabilities: Column, world: Column, evidence: Column, relations: Column) -> Column:
    """Completeness of an extraction against what its depth leads one to expect, 0 to 1."""

    def part(n: Column, i: int) -> Column:
        expected = F.when(depth == "deep", EXPECTED["deep"][i]).when(depth == "structured", EXPECTED["structured"][i]).when(depth == "light", EXPECTED["light"][i]).otherwise(0)
        return F.when(expected > 0, F.least(n / expected, F.lit(1.0))).otherwise(F.when(n > 0, 1.0).otherwise(0.0))

    return F.round(F.least(F.lit(1.0), (1 + part(capabilities, 0) + part(world, 1) + part(evidence, 2) + part(relations, 3)) / 5), 6)


def capability_predicate(type_: Column) -> Column:
    """Predicate by which a source is linked to a capability of a type."""
    table = {
        "Variable": "analyzes", "Model": "applies", "Algorithm": "implements", "Simulation": "runs", "Software": "depends_on", "API": "integrates_with", "Workflow": "follows",
        "Pipeline": "executes", "Policy": "complies_with", "Regulation": "subject_to", "Institution": "associated_with", "Assessment": "evaluated_by", "Indicator": "measured_by",
        "Intervention": "proposes", "AdaptationMeasure": "recommends",
    }
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), type_), F.lit("uses"))


def source_triples(items: DataFrame) -> DataFrame:
    """(source_id, subject, predicate, object, confidence, section): what a source and its entities say of each other.

    ``items``: source_id, kind (dataset, method, model, region, experiment, claim, grade), id, name, confidence (null: 0.8), evidence
    (of claims; '' and null are none), uses (array of names; of methods and models the data they use). Each dataset covers each region
    of its source; they meet on the source, which has few of either.
    """
    of = lambda kind: items.where(F.col("kind") == kind)
    c = F.coalesce("confidence", F.lit(0.8))

    def edge(df: DataFrame, subject: str, predicate: str, object_: str, confidence: Column, section: str) -> DataFrame:
        return df.select("source_id", F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), F.col(object_).alias("object"), confidence.cast("double").alias("confidence"), F.lit(section).alias("section"))

    direct = [("dataset", "uses", "datasets"), ("method", "applies", "methods"), ("region", "studies", "spatial"), ("experiment", "consists_of", "experiments")]
    out = [edge(of(kind), "source_id", predicate, "id", c, section) for kind, predicate, section in direct]
    out.append(edge(of("claim"), "id", "derives_from", "source_id", c, "claims"))
    out.append(edge(of("claim").where("evidence is not null and evidence != ''"), "source_id", "supports", "id", c, "results"))
    out.append(edge(of("grade"), "source_id", "evaluated_by", "name", F.lit(0.9), "reproducibility"))
    data = of("dataset").select("source_id", F.col("id").alias("data"), F.col("name").alias("used"))
    named = of("method").select("source_id", "id", F.explode("uses").alias("used")).join(data, ["source_id", "used"])
    out.append(edge(named, "id", "uses", "data", F.lit(0.9), "methods"))
    trained = of("model").where("size(uses) > 0").select("source_id", "id").join(data, "source_id")
    out.append(edge(trained, "id", "trained_on", "data", F.lit(0.9), "methods"))
    region = of("region").select("source_id", F.col("id").alias("region"))
    out.append(edge(data.join(region, "source_id"), "data", "covers", "region", F.lit(0.7), "spatial"))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found.distinct()


def fallback_relations(subjects: DataFrame, objects: DataFrame, stated: DataFrame, closure: DataFrame, bridges: DataFrame) -> DataFrame:
    """(source_id, subject, predicate, object, confidence): relations inferred from the types of objects of one source.

    ``subjects`` (capabilities and evidence) and ``objects`` (of the world): source_id, id, type. ``stated``: source_id, subject, object;
    subjects that any stated relation names are left out. Only predicates that may be inferred count, with their cap. Types are
    matched once for each pair of types; then both sides meet on the source and the type.
    """
    from basinweave.operators.ontology import valid_bridges

    named = stated.select("source_id", F.explode(F.array("subject", "object")).alias("id"))
    free = subjects.join(named, ["source_id", "id"], "left_anti").select("source_id", F.col("id").alias("subject"), F.col("type").alias("subject_type")).distinct()
    worlds = objects.select("source_id", F.col("id").alias("object"), F.col("type").alias("object_type")).distinct()
    kinds = free.select("source_id", "subject_type").distinct().join(worlds.select("source_id", "object_type").distinct(), "source_id")
    valid = valid_bridges(kinds.select("subject_type", "object_type").distinct(), closure, bridges).where("fallback")
    valid = valid.select("subject_type", "object_type", "predicate", F.col("cap").alias("confidence")).distinct()
    pairs = free.join(F.broadcast(valid), "subject_type").join(worlds, ["source_id", "object_type"])
    return pairs.where("subject != object").select("source_id", "subject", "predicate", "object", "confidence").distinct()


def traceability(nodes: DataFrame, objects: DataFrame) -> DataFrame:
    """Object of the same source that each route node (source_id, node_id, tokens against source_id, name, tokens) stands for.

    A node whose id is an object's stands for it; else for the one that shares the most tokens, from a score of 0.18 on. Tokens are an
    inverted index within the source; a token that the source's objects all but share is no rarer than it is, so nothing is dropped.
    ``level``: traceable where the object is ``grounded`` (a column of ``objects``; grounded if absent), weak where it isn't or where
    the node is ``linked`` (a column of ``nodes``; not linked if absent), untraced else.
    """
    linked = F.col("linked") if "linked" in nodes.columns else F.lit(False)
    grounded = F.col("grounded") if "grounded" in objects.columns else F.lit(True)
    told = nodes.select("source_id", "node_id", "tokens", linked.alias("linked"))
    known = objects.select("source_id", "name", "tokens", grounded.alias("grounded"))
    n = told.select("source_id", "node_id", F.size("tokens").alias("na"), F.explode("tokens").alias("t"))
    o = known.select("source_id", "name", "grounded", F.size("tokens").alias("nb"), F.explode("tokens").alias("t"))
    hit = n.join(o, ["source_id", "t"]).groupBy("source_id", "node_id", "name", "grounded", "na", "nb").agg(F.count("*").alias("shared"))
    score = F.round(F.col("shared") / F.least("na", "nb"), 6)
    best = hit.groupBy("source_id", "node_id").agg(F.max(F.struct(score.alias("score"), "name", "grounded")).alias("b"))
    direct = known.select("source_id", F.col("name").alias("node_id"), F.struct(F.lit(1.0).alias("score"), "name", "grounded").alias("d")).distinct()
    rows = told.select("source_id", "node_id", "linked").distinct().join(best, ["source_id", "node_id"], "left").join(direct, ["source_id", "node_id"], "left")
    chosen = F.coalesce("d", F.when(F.col("b.score") >= 0.18, F.col("b")))
    rows = rows.select("source_id", "node_id", "linked", chosen.alias("c"), F.coalesce("d.score", "b.score", F.lit(0.0)).alias("score"))
    level = F.when(F.col("c.grounded"), "traceable").when(F.col("c").isNotNull() | F.col("linked"), "weak").otherwise("untraced")
    return rows.select("source_id", "node_id", F.col("c.name").alias("object"), "score", level.alias("level"))


def traceability_score(traced: DataFrame) -> DataFrame:
    """(source_id, nodes, traceable, weak, untraced, score, level) of the nodes of each source."""
    n = lambda x: F.count_if(F.col("level") == x)
    rows = traced.groupBy("source_id").agg(F.count("*").alias("nodes"), n("traceable").alias("traceable"), n("weak").alias("weak"), n("untraced").alias("untraced"))
    score = F.floor((F.col("traceable") + F.col("weak") * 0.5) * 100 / F.col("nodes") + 0.5).cast("int")
    rows = rows.withColumn("score", score)
    level = (
        F.when((F.col("traceable") == 0) | (F.col("score") < 50) | (F.col("untraced") > 0), "weak").when((F.col("score") < 80) | (F.col("weak") > 0), "partial").otherwise("traceable")
    )
    return rows.withColumn("level", level)


# Arrays of a source's metadata, the type of their items and the confidence that these have.
METADATA_ARRAYS: tuple[tuple[str, str, float], ...] = (
    ("datasets", "Dataset", 0.8), ("variables", "Variable", 0.9), ("satellites", "Satellite", 0.8), ("gauges", "Gauge", 0.8), ("stations", "Gauge", 0.8), ("models", "Model", 0.8),
    ("algorithms", "Algorithm", 0.8), ("packages", "Software", 0.8), ("dependencies", "Software", 0.8), ("workflows", "Workflow", 0.8), ("institutions", "Institution", 0.8),
    ("policies", "Policy", 0.8), ("exposures", "ExposureDataset", 0.8), ("assessments", "Assessment", 0.8), ("indicators", "Indicator", 0.8), ("interventions", "Intervention", 0.8),
    ("measures", "Intervention", 0.8), ("regions", "Region", 0.8), ("studyAreas", "Region", 0.8), ("geoFeatures", "Region", 0.8), ("earthVariables", "EarthVariable", 0.8), ("hazards", "Hazard", 0.8),
    ("risks", "EarthRisk", 0.8), ("impacts", "Exposure", 0.8), ("forecasts", "Forecast", 0.8), ("projections", "Projection", 0.8), ("claims", "Claim", 0.8), ("evidence", "Evidence", 0.8),
)


def metadata_objects(sources: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(source_id, type, name, confidence, pos, origin) of all objects that the arrays of JSON metadata name.

    Items are texts, or records with a name, title, statement or id; items without any are left out. The arrays are gathered into
    one and unfolded once, so the metadata are read in a single narrow pass.
    """

    def items(field: str, type_: str, confidence: float) -> Column:
        texts = F.coalesce(F.from_json(F.get_json_object(json_col, f"$.{field}"), "array<string>"), F.array().cast("array<string>"))
        return F.transform(
            texts, lambda x, k: F.struct(F.lit(type_).alias("type"), x.alias("x"), F.lit(confidence).alias("confidence"), k.alias("pos"), F.lit(field).alias("origin"))
        )

    parts = [items(*spec) for spec in METADATA_ARRAYS]
    each = sources.select(F.col(id_col).alias("source_id"), F.explode(F.concat(*parts)).alias("o")).select("source_id", "o.*")
    field = lambda n: F.nullif(F.get_json_object("x", f"$.{n}"), F.lit(""))
    name = F.when(F.ltrim("x").startswith("{"), F.coalesce(field("name"), field("title"), field("statement"), field("id"))).otherwise(F.trim("x"))
    return each.select("source_id", "type", name.alias("name"), "confidence", "pos", "origin").where("name is not null and name != ''")


def cap_by_rank(rows: DataFrame, group: str, most: int, *order: str) -> DataFrame:
    """The first ``most`` rows of each group in the given order, with their rank: a report's top list."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def merge_projects(items: DataFrame, group: str, label: str, most: int) -> DataFrame:
    """Items of several sources (group, source_id, label, pos) merged by their normalised label: sources per item, first label, top ``most``."""
    key = F.trim(F.regexp_replace(F.lower(F.col(label)), "[^a-z0-9]+", " "))
    merged = items.withColumn("_k", key).where("_k != ''").groupBy(group, "_k").agg(
        F.min(F.struct("source_id", "pos", F.col(label).alias("l"))).alias("m"), F.countDistinct("source_id").alias("sources")
    )
    flat = merged.select(group, F.col("m.l").alias("label"), "sources", F.col("m.source_id").alias("first_source"), F.col("m.pos").alias("pos"))
    return cap_by_rank(flat, group, most, "first_source", "pos", "label")


# Keys by which the sections of a role are found.
ROLE_HINTS: dict[str, tuple[str, ...]] = {
    "method": ("method", "model", "experiment", "algorithm"),
    "data": ("data availability", "input data", "data", "dataset"),
    "workflow": ("workflow", "experiment", "methods"),
    "abstract": ("abstract",),
    "evidence": (
        "results", "result", "key findings", "findings", "impact details", "impact", "overall performance", "temperature records", "future risks", "current status", "assessment",
    ),
}


def text_objects(sources: DataFrame) -> DataFrame:
    """(source_id, origin, type, name, description, section, confidence) of what the sections of a source's text tell, where nothing better is known.

    ``sources``: source_id, source_type, text, title, abstract. Texts of less than 100 characters give nothing. At most one object of
    each origin: method, data, workflow, claim and scope (of the abstract), evidence (unless it says what the claim says).
    """
    from basinweave.functions import text as t

    staged = t.with_sections(sources.where(F.length("text") >= 100)).withColumn("_map", t.section_map(F.col("sections")))
    for role, hints in ROLE_HINTS.items():
        staged = staged.withColumn(f"_{role}", t.section_by_role(F.col("_map"), hints))
    own = F.struct(F.lit("abstract").alias("key"), t.strip("abstract").alias("text"))
    staged = staged.withColumn("_abstract", F.coalesce("_abstract", F.when(F.length("abstract") > 0, own)))
    staged = staged.withColumn("_claim", t.claim_sentence(F.col("_abstract.text"))).withColumn("_said", t.claim_sentence(F.col("_evidence.text")))
    key = lambda role: F.col(f"_{role}.key")
    body = lambda role: F.col(f"_{role}.text")
    human = lambda role: F.array_join(F.transform(F.split(key(role), r"\s+"), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 10_000))), " ")
    address = F.nullif(F.regexp_extract(body("data"), r"(?i)(https?://[^\s),;]+)", 1), F.lit(""))
    again = F.coalesce(t.overlap(t.significant_tokens(F.col("_claim")), t.significant_tokens(F.col("_said"))) > 0.8, F.lit(False))

    def found(origin: str, type_: Column, name: Column, description: Column, section: Column, there: Column, confidence: float) -> Column:
        o = F.struct(
            F.lit(origin).alias("origin"), type_.alias("type"), name.alias("name"), description.alias("description"), section.alias("section"), F.lit(confidence).alias("confidence")
        )
        return F.when(F.coalesce(there, F.lit(False)), o)

    none = F.lit(None).cast("string")
    objects = F.array_compact(F.array(
        found("method", F.when(F.contains(key("method"), F.lit("model")), "Model").otherwise("Method"), human("method"), t.long_sentence(body("method")), key("method"), key("method").isNotNull(), 0.5),
        found("data", F.lit("Dataset"), F.coalesce(address, human("data")), t.long_sentence(body("data")), key("data"), key("data").isNotNull(), 0.5),
        found("workflow", F.lit("Workflow"), F.concat(F.coalesce(F.nullif("title", F.lit("")), F.lit("Source-described")), F.lit(" workflow")), t.long_sentence(body("workflow")), key("workflow"), key("workflow").isNotNull(), 0.5),
        found("claim", F.lit("Claim"), F.col("_claim"), none, key("abstract"), F.col("_claim").isNotNull(), 0.5),
        found("scope", F.lit("Region"), F.lit("Global scope"), none, key("abstract"), (F.length(body("abstract")) > 0) & (body("abstract").rlike(r"(?i)\bglobal\b") | F.coalesce(F.col("title").rlike(r"(?i)\bglobal\b"), F.lit(False))), 0.45),
        found("evidence", F.lit("Claim"), F.col("_said"), none, key("evidence"), F.col("_said").isNotNull() & ~again, 0.5),
    ))
    return staged.select("source_id", F.explode(objects).alias("o")).select("source_id", "o.*")
