"""Admission of sources: roles, density, evidence potential, activated vocabulary and the decision, all as columns of one pass.

Sources: source_id, input, type, description, n_sections, n_keywords, n_authors, language, n_tree, n_readme, n_variables, n_datasets,
n_models, n_hazards, n_regions, n_institutions, n_references, n_dependencies, spatial, temporal, jurisdiction, date, location,
citations. ``with_defaults`` adds those that a table lacks.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of source that have each role.
ROLES: dict[str, tuple[str, ...]] = {
    "earth_content": ("Report", "AssessmentReport", "WhitePaper", "Documentation"),
    "data_capability": ("DatasetPage", "DataCatalog", "KnowledgeGraph"),
    "observation_capability": ("Repository", "Documentation", "APIPage"),
    "modeling_capability": ("Repository", "ModelCard", "Paper", "Benchmark"),
    "computing_capability": ("Repository", "Package", "APIPage", "Documentation", "TechnicalBlog"),
    "governance_capability": ("PolicyDocument", "StandardDocument", "Report", "AssessmentReport"),
    "socioeconomic_capability": ("DatasetPage", "Report", "PolicyDocument"),
    "evidence_assessment": ("Paper", "Report", "AssessmentReport", "WhitePaper"),
    "action_capability": ("PolicyDocument", "Report", "News"),
    "event_signal": ("News", "PressRelease", "Report"),
}
# What a role of 0.2 and more activates.
ACTIVATES: tuple[tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]], ...] = (
    (("earth_content", "evidence_assessment"), ("capability",), ("evidence", "modeling")),
    (("data_capability",), ("capability", "world"), ("data", "earth-variable")),
    (("observation_capability",), ("capability", "world"), ("observation", "earth-variable")),
    (("modeling_capability",), ("capability", "world"), ("modeling", "earth-process", "model-output")),
    (("computing_capability",), ("capability",), ("computing",)),
    (("governance_capability",), ("capability", "world"), ("governance", "risk")),
    (("socioeconomic_capability",), ("capability", "world"), ("socioeconomic", "exposure")),
    (("action_capability",), ("capability", "world"), ("action", "risk")),
    (("event_signal",), ("world",), ("hazard", "earth-object")),
)
_NUMBERS = "n_sections n_keywords n_authors n_tree n_readme n_variables n_datasets n_models n_hazards n_regions n_institutions n_references n_dependencies citations".split()
_TEXTS = "input type description language spatial temporal jurisdiction date location".split()


def with_defaults(sources: DataFrame) -> DataFrame:
    """Sources with all columns; counts 0 and texts null where the table has none."""
    for c in _NUMBERS:
        sources = sources.withColumn(c, F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in sources.columns else F.lit(0))
    for c in _TEXTS:
        if c not in sources.columns:
            sources = sources.withColumn(c, F.lit(None).cast("string"))
    return sources


def _there(name: str) -> Column:
    return F.coalesce(F.col(name) != "", F.lit(False))


def detect_type(input_: Column, type_: Column) -> Column:
    """Type of a source: as stated, else by the form of its address."""
    text = F.lower(F.coalesce(input_, F.lit("")))
    return F.coalesce(
        F.nullif(type_, F.lit("")),
        F.when(text.rlike(r"10\.\d{4,}/\S+"), "Paper").when(text.rlike(r"github\.com/[\w-]+/[\w-]+"), "Repository").otherwise("Source"),
    )


def snake(c: Column) -> Column:
    """Type name as lower-case words joined by underscores."""
    t = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(F.regexp_replace(t, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def role_scores(sources: DataFrame) -> DataFrame:
    """Adds one column per role, 0 to 1."""
    t = snake(F.col("type"))
    n = F.col
    bonus = {
        "data_capability": F.when((n("n_datasets") > 0) | (n("n_variables") > 0), 0.3).otherwise(0.0) + F.when(_there("spatial") | _there("temporal"), 0.2).otherwise(0.0),
        "earth_content": F.when((n("n_regions") > 0) | (n("n_hazards") > 0) | _there("spatial"), 0.5).otherwise(0.0),
        "modeling_capability": F.when(n("n_models") > 0, 0.3).otherwise(0.0),
        "computing_capability": F.when(_there("language") | (n("n_dependencies") > 0) | (n("n_tree") > 5), 0.3).otherwise(0.0),
        "governance_capability": F.when(_there("jurisdiction"), 0.3).otherwise(0.0),
        "event_signal": F.when(_there("date") & _there("location"), 0.3).otherwise(0.0),
    }
    snakes = {r: ["_".join(_words(x)) for x in types] for r, types in ROLES.items()}
    columns = {r: F.least(F.lit(1.0), F.when(t.isin(snakes[r]), 0.5).otherwise(0.0) + bonus.get(r, F.lit(0.0))) for r in ROLES}
    return sources.select("*", *[c.alias(r) for r, c in columns.items()])


def _words(name: str) -> list[str]:
    out = [""]
    for i, ch in enumerate(name):
        if i and ch.isupper() and not name[i - 1].isupper():
            out.append("")
        out[-1] += ch.lower()
    return out


def density() -> Column:
    """How much a source holds, 0 to 1."""
    n, length = F.col, F.length(F.coalesce("description", F.lit("")))
    w = lambda c, v: F.when(c, v).otherwise(0.0)
    parts = [
        F.when(length > 5000, 0.3).when(length > 1000, 0.2).when(length > 100, 0.1).otherwise(0.0),
        w(n("n_sections") > 0, 0.2), w(n("n_keywords") > 0, 0.1), w(n("n_authors") > 0, 0.1), w(_there("language"), 0.15),
        F.when(n("n_tree") > 10, 0.15).when(n("n_tree") > 0, 0.1).otherwise(0.0), w(n("n_readme") > 500, 0.15), w(n("n_variables") > 0, 0.2),
        w(_there("spatial") | _there("temporal"), 0.15), w(n("citations") > 0, 0.1), w(n("n_references") > 0, 0.1),
    ]
    return F.least(F.lit(1.0), F.round(reduce(add, parts), 6))


def activated(kind: int) -> Column:
    """Layers (1) or categories (2) that the roles of a source activate, sorted."""
    base = ["source", "foundation"] if kind == 1 else []
    on = [F.when(reduce(lambda a, b: a | b, [F.col(r) >= 0.2 for r in rule[0]]), F.array(*map(F.lit, rule[kind]))).otherwise(F.array().cast("array<string>")) for rule in ACTIVATES]
    return F.array_sort(F.array_distinct(F.concat(F.array(*map(F.lit, base)).cast("array<string>"), *on)))


def admit(sources: DataFrame) -> DataFrame:
    """Roles, density, score, depth and admission of each source."""
    rows = role_scores(with_defaults(sources).withColumn("type", detect_type(F.col("input"), F.col("type"))))
    roles = [F.col(r) for r in ROLES]
    best, mean = F.greatest(*roles), reduce(add, roles) / 10
    others = F.greatest(*[F.col(r) for r in ROLES if r != "event_signal"])
    explicit = (F.col("n_hazards") > 0) | (F.col("n_regions") > 0) | (F.col("n_institutions") > 0)
    rows = rows.select(
        "*",
        F.coalesce(*[F.when((F.col(r) == best) & (best > 0), F.lit(r)) for r in ROLES], F.lit("earth_content")).alias("primary_role"),
        reduce(add, [(c > 0).cast("int") for c in roles]).alias("role_count"),
        density().alias("density"),
        ((F.col("event_signal") > 0) & (F.col("event_signal") <= 0.3) & (others < 0.2) & ~explicit).alias("weak_event"),
        activated(1).alias("layers"),
        activated(2).alias("categories"),
        F.round(mean, 6).alias("quick_score"),
        F.round(best * 0.6 + mean * 0.4, 6).alias("relevance"),
    )
    score = F.round(F.col("relevance") * 0.7 + F.col("density") * 0.3, 6)
    rows = rows.withColumn("score", score)
    depth = (
        F.when(F.col("weak_event") | (F.col("score") < 0.15) | (F.col("role_count") == 0), "reject")
        .when((F.col("score") < 0.3) | (F.col("role_count") < 2), "light")
        .when((F.col("score") < 0.5) | (F.size("categories") < 3), "structured")
        .otherwise("deep")
    )
    quick = F.when(F.col("quick_score") >= 0.4, "deep").when(F.col("quick_score") >= 0.25, "structured").when(F.col("quick_score") >= 0.15, "light").otherwise("reject")
    return rows.withColumn("depth", depth).withColumn("admitted", F.col("depth") != "reject").withColumn("quick_depth", quick)


def reasoning() -> Column:
    """Score and the three strongest roles, as text."""
    roles = F.array(*[F.struct((-F.col(r)).alias("o"), F.lit(i).alias("i"), F.lit(r).alias("r"), F.col(r).alias("s")) for i, r in enumerate(ROLES)])
    top = F.slice(F.array_sort(F.filter(roles, lambda x: x["s"] >= 0.2)), 1, 3)
    names = F.array_join(F.transform(top, lambda x: F.concat(x["r"], F.lit("("), F.format_string("%.2f", x["s"]), F.lit(")"))), ", ")
    return F.concat(F.lit("relevance "), F.format_string("%.2f", F.col("score")), F.lit("; roles "), F.coalesce(F.nullif(names, F.lit("")), F.lit("none detected")))


def admission_stats(admitted: DataFrame) -> DataFrame:
    """Sources, mean score and admitted per depth; depths without sources count 0."""
    depths = admitted.sparkSession.createDataFrame([("reject",), ("light",), ("structured",), ("deep",)], "depth string")
    sums = admitted.groupBy("depth").agg(F.count("*").alias("sources"), F.round(F.avg("score"), 6).alias("avg_score"), F.count_if("admitted").alias("admitted"))
    return F.broadcast(depths).join(sums, "depth", "left").fillna({"sources": 0, "admitted": 0})


def evidence_potential(has_methods: Column, has_results: Column, has_visuals: Column, has_metrics: Column, has_tests: Column) -> Column:
    """Potential of a source to give evidence, 0 to 1, by its type and content."""
    t = F.lower("type")
    w = lambda c, v: F.when(c, v).otherwise(0.0)
    code = t.isin("github", "code")
    total = (
        w(t == "paper", 0.4) + w(code, 0.3) + w(code & has_tests, 0.15) + w(t == "dataset", 0.3) + w(t == "report", 0.25) + w(t == "news", 0.1)
        + w(has_methods, 0.2) + w(has_results, 0.2) + w(has_visuals, 0.15) + w(has_metrics, 0.15)
    )
    return F.least(F.lit(1.0), F.round(total, 6))


def decide(relevance: Column, evidence: Column, dens: Column, is_research: Column) -> Column:
    """Depth by the weighted sum of relevance, evidence and density."""
    s = 0.5 * relevance + 0.3 * evidence + 0.2 * dens
    return F.when((s < 0.2) | ~is_research, "reject").when(s < 0.35, "light").when(s < 0.55, "structured").otherwise("deep")


# Roles by type where no evaluator is at hand.
TYPE_ROLES: dict[str, dict[str, float]] = {
    "Paper": {"modeling_capability": 0.3, "evidence_assessment": 0.4}, "Preprint": {"earth_content": 0.4}, "Report": {"governance_capability": 0.4, "evidence_assessment": 0.3},
    "AssessmentReport": {"evidence_assessment": 0.6, "governance_capability": 0.4}, "Repository": {"computing_capability": 0.5, "modeling_capability": 0.3},
    "ModelCard": {"modeling_capability": 0.7}, "DatasetPage": {"data_capability": 0.7}, "DataCatalog": {"data_capability": 0.6},
    "PolicyDocument": {"governance_capability": 0.7, "action_capability": 0.4}, "StandardDocument": {"governance_capability": 0.6}, "News": {"event_signal": 0.3}, "PressRelease": {"event_signal": 0.2},
}


def fallback_roles(sources: DataFrame) -> DataFrame:
    """Adds one column per role by the type alone, and for dates with places, hazards and regions; 0 for other types."""
    rows = with_defaults(sources)
    hazard = (F.col("n_hazards") > 0) | (F.col("n_regions") > 0)
    out = {}
    for role in ROLES:
        weights = [(t, w[role]) for t, w in TYPE_ROLES.items() if role in w]
        c = F.lit(0.0)
        if weights:
            c = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights for x in kv]), F.col("type")), F.lit(0.0))
        if role == "event_signal":
            c = F.least(F.lit(1.0), F.round(c + F.when(_there("date") & _there("location"), 0.3).otherwise(0.0) + F.when(hazard, 0.3).otherwise(0.0), 6))
        if role == "earth_content":
            c = F.greatest(c, F.when(hazard, 0.2).otherwise(0.0))
        out[role] = c
    return rows.select("*", *[c.alias(r) for r, c in out.items()])
