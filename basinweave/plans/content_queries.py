"""Queries of texts, admission, repositories, decomposition, quality, spatial views and state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basinweave.functions import text
from basinweave.operators import admission, decompose, graph, nested, ontology, quality, repositories, spatial, state
from basinweave.plans.core_problems import P4_NODES
from basinweave.plans.graph_queries import MEMBERS as _M
from basinweave.plans.graph_queries import E, T, _values
from basinweave.session import table

AS_OF = "2026-01-01 00:00:00"


def _docs(spark, d):
    return table(spark, d, "documents")


def _papers(spark, d):
    return state.current_rows(table(spark, d, "papers"), "paper_id", "ingested_at", "title", "abstract")


def _repos(spark, d):
    cols = ["full_name", "description", "language", "license", "readme", "stars", "tree", "fetched_at"]
    return state.current_rows(table(spark, d, "repositories").select(*cols), "full_name", "fetched_at", "tree")


# --- texts -----------------------------------------------------------------------------------------------------------------


def t_sections(spark: SparkSession, d: str) -> DataFrame:
    """Sections of all documents: type, title, lines and length."""
    rows = text.with_sections(_docs(spark, d).select("doc_id", "text", "source_type")).select("doc_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("doc_id", "pos", "s.type", "s.title", "s.start_line", "s.end_line", F.length("s.text").alias("chars"))


def t_section_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sections and characters per source type and section type."""
    rows = text.with_sections(_docs(spark, d).select("text", "source_type")).select("source_type", F.explode("sections").alias("s"))
    return rows.groupBy("source_type", "s.type").agg(F.count("*").alias("n"), F.sum(F.length("s.text")).alias("chars"), F.max("s.importance").alias("importance"))


def t_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the documents that need more than one."""
    rows = text.with_sections(_docs(spark, d).select("doc_id", "text", "source_type"))
    return rows.select("doc_id", text.chunk_sizes(F.col("sections")).alias("s")).where("size(s) > 1").select("doc_id", F.size("s").alias("chunks"), F.array_max("s").alias("largest"), F.aggregate("s", F.lit(0), lambda a, b: a + b).alias("chars"))


def t_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents per significant token of their whole texts, for tokens of at least 50 documents."""
    rows = _docs(spark, d).select(F.explode(text.significant_tokens(F.col("text"), None)).alias("token"))
    return rows.groupBy("token").agg(F.count("*").alias("documents")).where("documents >= 50")


def t_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of each paper's title with its abstract."""
    score = text.overlap(text.significant_tokens(F.col("title")), text.significant_tokens(F.col("abstract")))
    return _papers(spark, d).select("paper_id", F.round(score, 6).alias("score"))


def _traced(spark, d):
    from basinweave.operators.lenses import member_entities, project_members

    m = member_entities(project_members(table(spark, d, "projects")), graph.latest_entities(table(spark, d, "entities"), "type", "name", "attributes", "source"))
    value = lambda n: F.get_json_object("attributes", f"$.{n}")
    nodes = m.where("type = 'Claim'").select(F.col("project_id").alias("source_id"), F.col("id").alias("node_id"), text.significant_tokens(value("statement")).alias("tokens"))
    objects = m.where("type in ('Dataset', 'Paper', 'Variable')").select(
        F.col("project_id").alias("source_id"), F.col("id").alias("name"), text.significant_tokens(F.concat_ws(" ", "name", value("title"), value("description"))).alias("tokens"),
        F.coalesce(F.col("source") != "", F.lit(False)).alias("grounded"),
    )
    return decompose.traceability(nodes, objects)


def t_best_match(spark: SparkSession, d: str) -> DataFrame:
    """Claims of each project and how well the dataset, paper or variable of the project fits that shares the most tokens, through an inverted index."""
    return _traced(spark, d).select("source_id", "node_id", "score", "level")


def t_traceability(spark: SparkSession, d: str) -> DataFrame:
    """Traceability of the claims of each project."""
    return decompose.traceability_score(_traced(spark, d))


def t_validate_text(spark: SparkSession, d: str) -> DataFrame:
    """How the quotations of triples fit the abstract of a paper whose text they are compared with, by kind of match."""
    p = _papers(spark, d).where("abstract is not null").select("paper_id", "abstract", F.concat(F.upper(F.left("abstract", F.lit(60))), F.lit(" zzz")).alias("late"), "title")
    v = p.select(*[text.validate_source_text(F.col(c), F.col("abstract")).alias(c) for c in ("late", "title", "abstract")])
    each = v.select(F.explode(F.array(*[F.struct(F.lit(c).alias("quote"), F.col(f"{c}.valid").alias("valid"), F.col(f"{c}.match").alias("match")) for c in ("late", "title", "abstract")])).alias("x"))
    return each.groupBy("x.quote", "x.match", "x.valid").agg(F.count("*").alias("n"))


def t_find_span(spark: SparkSession, d: str) -> DataFrame:
    """Where the second sentence of each abstract begins."""
    p = _papers(spark, d).where("abstract is not null").withColumn("second", F.get(F.split("abstract", r"\. "), 1)).where("second is not null")
    return p.select("paper_id", text.find_span(F.upper("second"), F.col("abstract")).alias("start"))


def t_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses in documents by kind."""
    rows = _docs(spark, d).select("doc_id", F.explode(text.urls(F.col("text"))).alias("url"))
    return rows.groupBy(text.link_class(F.col("url")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def t_doi(spark: SparkSession, d: str) -> DataFrame:
    """DOIs of papers, cleaned, with the papers that have each."""
    return _papers(spark, d).select("paper_id", text.doi(F.col("doi")).alias("doi")).where("doi is not null").groupBy("doi").agg(F.count("*").alias("papers"))


def t_slug(spark: SparkSession, d: str) -> DataFrame:
    """Slugs and first sentences of papers."""
    return _papers(spark, d).select("paper_id", text.slug(F.col("title"), 50).alias("slug"), text.first_sentence(F.col("abstract")).alias("first"))


# --- admission -------------------------------------------------------------------------------------------------------------


def sources(spark: SparkSession, d: str) -> DataFrame:
    """Papers, repositories and documents as sources for admission."""
    p = _papers(spark, d).select(
        F.col("paper_id").alias("source_id"), F.coalesce("doi", "title").alias("input"), F.lit("Paper").alias("type"), F.col("abstract").alias("description"),
        F.coalesce(F.array_size("keywords"), F.lit(0)).alias("n_keywords"), F.coalesce(F.array_size("authors"), F.lit(0)).alias("n_authors"),
        F.coalesce(F.array_size("datasets"), F.lit(0)).alias("n_datasets"), F.coalesce("citation_count", F.lit(0)).alias("citations"),
        F.get(F.col("datasets"), 0)["spatial_coverage"].alias("spatial"), F.lit(None).cast("string").alias("language"), F.lit(0).alias("n_tree"), F.lit(0).alias("n_readme"),
    )
    none = F.lit(None).cast("string")
    r = _repos(spark, d).select(
        F.col("full_name").alias("source_id"), F.concat(F.lit("https://github.com/"), "full_name").alias("input"), none.alias("type"), "description", F.lit(0).alias("n_keywords"),
        F.lit(0).alias("n_authors"), F.lit(0).alias("n_datasets"), F.lit(0).alias("citations"), none.alias("spatial"), "language", F.coalesce(F.array_size("tree"), F.lit(0)).alias("n_tree"),
        F.coalesce(F.length("readme"), F.lit(0)).alias("n_readme"),
    )
    doc = _docs(spark, d).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source_id"), F.col("url").alias("input"), F.col("source_type").alias("type"), F.col("text").alias("description"),
        F.lit(0).alias("n_keywords"), F.lit(0).alias("n_authors"), F.lit(0).alias("n_datasets"), F.lit(0).alias("citations"), none.alias("spatial"), none.alias("language"),
        F.lit(0).alias("n_tree"), F.lit(0).alias("n_readme"),
    )
    return p.unionByName(r).unionByName(doc)


def a_decide(spark: SparkSession, d: str) -> DataFrame:
    """Score, roles and depth of every source."""
    return admission.admit(sources(spark, d)).select("source_id", "type", "primary_role", "role_count", "density", "score", "depth", "admitted", "quick_depth")


def a_roles(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of each role per type of source."""
    rows = admission.admit(sources(spark, d))
    return rows.groupBy("type").agg(*[F.round(F.avg(r), 6).alias(r) for r in admission.ROLES], F.count("*").alias("n"))


def a_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sources per depth of processing."""
    return admission.admission_stats(admission.admit(sources(spark, d)))


def a_activated(spark: SparkSession, d: str) -> DataFrame:
    """Sources by what their roles activate."""
    rows = admission.admit(sources(spark, d)).select("type", F.array_join("layers", ",").alias("layers"), F.array_join("categories", ",").alias("categories"))
    return rows.groupBy("type", "layers", "categories").agg(F.count("*").alias("n"))


def a_evidence_potential(spark: SparkSession, d: str) -> DataFrame:
    """Evidence potential of documents by type: methods and results sections, tables and figures."""
    low = F.lower("text")
    rows = _docs(spark, d).select(
        F.col("source_type").alias("type"), low.rlike("(?m)^#+ *method").alias("m"), low.rlike("(?m)^#+ *result").alias("r"), low.rlike("table [0-9]|figure [0-9]").alias("v")
    )
    no = F.lit(False)
    yes = lambda c: F.coalesce(F.col(c), no)
    score = admission.evidence_potential(yes("m"), yes("r"), yes("v"), no, no)
    return rows.withColumn("p", F.coalesce(score, F.lit(0.0))).groupBy("type").agg(F.round(F.avg("p"), 6).alias("avg_potential"), F.count_if(F.col("p") >= 0.3).alias("chains"))


# --- repositories ----------------------------------------------------------------------------------------------------------


def r_file_roles(spark: SparkSession, d: str) -> DataFrame:
    """Files per role."""
    return repositories.classified_files(table(spark, d, "repositories")).groupBy("role", "score").agg(F.count("*").alias("files"), F.countDistinct("full_name").alias("repositories"))


def r_key_files(spark: SparkSession, d: str) -> DataFrame:
    """The eight most telling files of each repository."""
    return repositories.key_files(repositories.classified_files(table(spark, d, "repositories"))).select("full_name", "rank", "path", "role")


def r_review(spark: SparkSession, d: str) -> DataFrame:
    """Static checks and grade of each repository."""
    return repositories.review(table(spark, d, "repositories"))


def r_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Repositories per dependency."""
    return repositories.dependencies(table(spark, d, "repositories")).groupBy("dependency").agg(F.count("*").alias("repositories"))


# --- decomposition ---------------------------------------------------------------------------------------------------------


def m_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """Objects of papers once per type and name."""
    return decompose.merge_first_wins(decompose.paper_objects(_papers(spark, d))).select("source_id", "type", "name", "confidence", "pos", "origin")


def m_priority_merge(spark: SparkSession, d: str) -> DataFrame:
    """Objects of papers by type: datasets and regions first, variables that these lack after them."""
    objects = decompose.paper_objects(_papers(spark, d))
    merged = decompose.merge_by_priority(objects.where("origin != 'keywords'"), objects.where("origin = 'keywords'"))
    return merged.groupBy("type", "origin").agg(F.count("*").alias("n"))


def m_paper_triples(spark: SparkSession, d: str) -> DataFrame:
    """What papers say of their datasets and regions."""
    return decompose.paper_triples(decompose.paper_objects(_papers(spark, d)))


def m_source_triples(spark: SparkSession, d: str) -> DataFrame:
    """What papers and their datasets and regions say of each other, by predicate: each dataset covers each region."""
    o = decompose.merge_first_wins(decompose.paper_objects(_papers(spark, d))).where("type in ('Dataset', 'Region')")
    none = F.lit(None).cast("string")
    items = o.select("source_id", F.lower("type").alias("kind"), F.concat_ws("/", "source_id", "name").alias("id"), "name", "confidence", none.alias("evidence"), F.array().cast("array<string>").alias("uses"))
    return decompose.source_triples(items).groupBy("predicate", "confidence", "section").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("papers"))


def m_fallback_bridges(spark: SparkSession, d: str) -> DataFrame:
    """Relations inferred between the datasets and regions that papers name, by predicate; those of datasets with a stated coverage are left out."""
    o = decompose.merge_first_wins(decompose.paper_objects(_papers(spark, d))).select("source_id", F.col("name").alias("id"), "type", "pos")
    stated = o.where("type = 'Dataset' and pos = 0").select("source_id", F.col("id").alias("subject"), F.col("id").alias("object"))
    closure = ontology.type_closure(ontology.parent_table(spark), table(spark, d, "ontology_types"))
    found = decompose.fallback_relations(o.where("type = 'Dataset'"), o.where("type in ('Region', 'Variable')"), stated, closure, ontology.bridge_table(spark))
    return found.groupBy("predicate", "confidence").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("papers"))


def m_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Records of papers, datasets and repositories turned into attributes by their rules: how often each is filled."""
    from basinweave.operators import mapping

    row = lambda df, kind, *c: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*c)).alias("record"))
    p = _papers(spark, d)
    papers = row(p, "paper", "title", "doi", "abstract", "year", "venue", F.col("citation_count").alias("citationCount"), "authors", "keywords")
    data = row(p.select(F.explode("datasets").alias("s")), "dataset", F.col("s.name").alias("name"), F.struct(F.col("s.spatial_coverage").alias("coverage")).alias("spatial"), F.col("s.role").alias("role"))
    repos = row(_repos(spark, d), "repository", F.split("full_name", "/")[1].alias("name"), F.col("full_name").alias("repo"), "language", "stars", "license", "description", "readme")
    mapped = mapping.map_all(papers.unionByName(data).unionByName(repos))
    each = mapped.select("type", "section", F.explode(F.map_keys(F.map_concat("attributes", "metadata"))).alias("field"))
    return each.groupBy("type", "section", "field").agg(F.count("*").alias("n"))


def m_text_objects(spark: SparkSession, d: str) -> DataFrame:
    """What the sections of documents tell of methods, data, workflows, claims and scope, by origin and section."""
    none = F.lit(None).cast("string")
    rows = _docs(spark, d).select(F.col("doc_id").alias("source_id"), "source_type", "text", "title", none.alias("abstract"))
    o = decompose.text_objects(rows)
    return o.groupBy("origin", "type", "section", "confidence").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.sum(F.length("description")).alias("chars"))


def m_scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Triples by section and whether it is out of scope."""
    t = graph.distinct_triples(table(spark, d, "triples"), "provenance")
    return t.groupBy(F.col("provenance.section").alias("section"), decompose.out_of_scope(F.col("provenance.section")).alias("dropped")).agg(F.count("*").alias("n"))


def m_canonical_relations(spark: SparkSession, d: str) -> DataFrame:
    """Predicates and the relation that each means."""
    t = graph.distinct_triples(table(spark, d, "triples"), "predicate")
    return t.groupBy("predicate", decompose.canonical_relation(F.col("predicate")).alias("relation")).agg(F.count("*").alias("n"))


def m_bridge_infer(spark: SparkSession, d: str) -> DataFrame:
    """Bridge relations that types suggest within each project's own entities, by predicate."""
    e = graph.latest_entities(table(spark, d, "entities"), "type", "project_id").select("id", "type", "project_id").where("project_id is not null")
    return decompose.bridge_counts(e, "project_id").groupBy("predicate").agg(F.sum("n").alias("n"), F.count("*").alias("projects"))


def m_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Completeness of each paper's extraction as a structured one."""
    o = decompose.merge_first_wins(decompose.paper_objects(_papers(spark, d)))
    n = o.groupBy("source_id").agg(F.count_if(F.col("type").isin("Dataset", "Variable")).alias("c"), F.count_if(F.col("type") == "Region").alias("w"))
    return n.select("source_id", decompose.extraction_confidence(F.lit("structured"), F.col("c"), F.col("w"), F.lit(0), F.lit(0)).alias("confidence"))


# --- quality ---------------------------------------------------------------------------------------------------------------


def _project_counts(spark, d):
    nodes = nested.flatten_projects(table(spark, d, "projects"))
    n = lambda t: F.count_if(F.col("node_type") == t)
    c = nodes.groupBy("record_id").agg(
        n("key_point").alias("n_points"), n("result").alias("n_nodes"), n("anchor").alias("n_edges"), n("attachment").alias("visual_count"), n("project_source").alias("resource_count"), n("evidence").alias("evidence")
    )
    return c.select(
        F.col("record_id").alias("project_id"), "n_points", "n_nodes", "n_edges", "visual_count", "resource_count", (F.col("n_points") > 0).alias("has_one_line"),
        F.least("visual_count", "evidence").alias("explained"), F.least("resource_count", "evidence").alias("linked"), (F.col("evidence") >= F.col("n_nodes")).alias("ready"),
        F.greatest(F.col("n_nodes") - F.col("evidence"), F.lit(0)).alias("warnings"),
    )


def q_project_quality(spark: SparkSession, d: str) -> DataFrame:
    """Score and level of each project with readable metadata."""
    rows = quality.project_quality(_project_counts(spark, d))
    return rows.select("project_id", "score", "level", *[f"score_{k}" for k in quality.PROJECT_WEIGHTS])


def q_benchmark(spark: SparkSession, d: str) -> DataFrame:
    """Mean and least score over all projects."""
    return quality.benchmark(quality.project_quality(_project_counts(spark, d)))


def q_paper_quality(spark: SparkSession, d: str) -> DataFrame:
    """Score and level of each paper's decomposition from what its record tells."""
    o = decompose.merge_first_wins(decompose.paper_objects(_papers(spark, d))).groupBy("source_id").agg(F.count("*").alias("n"))
    rows = _papers(spark, d).join(o, F.col("paper_id") == F.col("source_id"), "left").select(
        "paper_id", (F.coalesce(F.length("abstract"), F.lit(0)) > 0).alias("has_one_line"), F.coalesce("n", F.lit(0)).alias("n_points"),
        F.coalesce(F.array_size("datasets"), F.lit(0)).alias("n_nodes"), F.coalesce(F.array_size("keywords"), F.lit(0)).alias("n_edges"), F.lit(None).cast("int").alias("trace_score"),
        F.lit(None).cast("int").alias("fidelity_score"), F.lit(None).cast("string").alias("trace_level"), F.lit(None).cast("string").alias("fidelity_level"), F.lit(0).alias("visual_count"),
        F.lit(0).alias("explained"), F.coalesce(F.array_size("datasets"), F.lit(0)).alias("resource_count"), F.coalesce(F.array_size("datasets"), F.lit(0)).alias("linked"),
        F.when(F.col("abstract").isNotNull(), "abstract_only").otherwise("metadata_only").alias("content_level"),
    )
    return quality.source_quality(rows).groupBy("level", "score").agg(F.count("*").alias("papers"))


def _signals(spark, d):
    c = _project_counts(spark, d)
    s = lambda i, name, col: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("signal"), F.when(F.col(col) >= 3, "ready").when(F.col(col) > 0, "limited").otherwise("missing").alias("state"))
    rows = c.select("project_id", F.explode(F.array(s(1, "brief", "n_points"), s(2, "results", "n_nodes"), s(3, "anchors", "n_edges"), s(4, "visuals", "visual_count"), s(5, "sources", "resource_count"))).alias("x"))
    return rows.select("project_id", "x.*")


def q_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Readiness of each project."""
    return quality.readiness(_signals(spark, d))


def q_action_plan(spark: SparkSession, d: str) -> DataFrame:
    """Next actions of each project, four at most."""
    return quality.action_plan(_signals(spark, d))


def q_review_actions(spark: SparkSession, d: str) -> DataFrame:
    """Entities by the review actions they need."""
    e = ontology.with_layers(graph.latest_entities(table(spark, d, "entities"), "type", "verification_state"), table(spark, d, "ontology_types"))
    return quality.review_actions(e).groupBy("actions").agg(F.count("*").alias("n"))


# --- spatial ---------------------------------------------------------------------------------------------------------------


def s_profile_fields(spark: SparkSession, d: str) -> DataFrame:
    """Profile of the attributes of each type of entity."""
    e = graph.latest_entities(table(spark, d, "entities"), "type", "attributes").where("attributes is not null")
    return spatial.profile_fields(e, "type").select("type", "field", "features", "distinct", "coverage", "series", "is_series")


def s_resource_rank(spark: SparkSession, d: str) -> DataFrame:
    """Files of repositories of use for a map, ranked within their repository."""
    rows = table(spark, d, "repositories").select("full_name", F.explode("tree").alias("url")).where("url is not null").distinct()
    rows = rows.select("full_name", F.regexp_replace("url", r"\\", "/").alias("url"), F.col("url").alias("label"), F.lit("file").alias("kind"))
    return spatial.rank_resources(rows, "full_name").select("full_name", "label", "format", "readiness", "rank")


def s_containment(spark: SparkSession, d: str) -> DataFrame:
    """Entities with a centroid inside the boxes of basins, per basin: a grid join."""
    e = graph.latest_entities(table(spark, d, "entities"), "type", "attributes")
    num = lambda p: F.get_json_object("attributes", p).try_cast("double")
    pts = e.where("get_json_object(attributes, '$.centroid') is not null").select(F.col("id").alias("point"), num("$.centroid[0]").alias("lon"), num("$.centroid[1]").alias("lat")).where("lon is not null and lat is not null")
    box = e.where("type = 'Basin' and get_json_object(attributes, '$.bbox[3]') is not null").select(
        F.col("id").alias("box"), F.least(num("$.bbox[0]"), num("$.bbox[2]")).alias("min_lon"), F.least(num("$.bbox[1]"), num("$.bbox[3]")).alias("min_lat"),
        F.greatest(num("$.bbox[0]"), num("$.bbox[2]")).alias("max_lon"), F.greatest(num("$.bbox[1]"), num("$.bbox[3]")).alias("max_lat"),
    )
    return spatial.join_boxes(pts, box, 10.0).groupBy("box").agg(F.count("*").alias("points"))


# --- state -----------------------------------------------------------------------------------------------------------------


def k_applications(spark: SparkSession, d: str) -> DataFrame:
    """Current applications per status."""
    a = state.current_rows(table(spark, d, "applications"), "id", "updated_at", "created_at", "status")
    ok = state.clean_email(F.col("email")).rlike(state.EMAIL)
    return a.groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count("*").alias("n"), F.count_if(ok).alias("valid_email"))


def k_active_invites(spark: SparkSession, d: str) -> DataFrame:
    """Invitations per status and whether they may be used at the given time."""
    i = state.current_rows(table(spark, d, "invites"), "code", "created_at", "used_at", "status")
    return state.active_invites(i, AS_OF, 30).groupBy("status", "usable").agg(F.count("*").alias("n"))


def k_latest_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The one session of each user."""
    return state.latest_sessions(table(spark, d, "events"), "2024-02-10 00:00:00")


def k_window_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user within the hour before, by number."""
    rows = state.window_counts(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", "ts")
    return rows.groupBy("in_window").agg(F.count("*").alias("n"))


def k_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Attempts of each user that a limit of three an hour allows; denied ones do not count."""
    return state.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id").groupBy("key", "allowed").agg(F.count("*").alias("n"))


def k_export_triples(spark: SparkSession, d: str) -> DataFrame:
    """Triples with an end in each project."""
    from basinweave.operators.lenses import project_members

    found = state.export_triples(project_members(table(spark, d, "projects")), graph.distinct_triples(table(spark, d, "triples"), "subject", "object"))
    return found.groupBy("project_id").agg(F.count("*").alias("triples"))


QUERIES = {
    f.__name__: f
    for f in (
        t_sections, t_section_stats, t_chunks, t_tokens, t_overlap, t_best_match, t_traceability, t_validate_text, t_find_span, t_urls, t_doi, t_slug, a_decide, a_roles, a_stats, a_activated,
        a_evidence_potential, r_file_roles, r_key_files, r_review, r_dependencies, m_first_wins, m_priority_merge, m_paper_triples, m_source_triples, m_fallback_bridges, m_mapped, m_text_objects, m_scope_filter, m_canonical_relations,
        m_bridge_infer, m_confidence, q_project_quality, q_benchmark, q_paper_quality, q_readiness, q_action_plan, q_review_actions, s_profile_fields, s_resource_rank,
        s_containment, k_applications, k_active_invites, k_latest_sessions, k_window_counts, k_rate_limit, k_export_triples,
    )
}

# --- SQL -------------------------------------------------------------------------------------------------------------------

_P = "p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC, title DESC, abstract DESC) AS rn FROM papers WHERE paper_id IS NOT NULL) WHERE rn = 1)"
_R = "r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY fetched_at DESC, tree DESC NULLS LAST) AS rn FROM repositories WHERE full_name IS NOT NULL) WHERE rn = 1)"


def _head(line: str) -> str:
    arm = lambda ps: " ".join(f"WHEN regexp_matches({line}, '{p}') THEN '{n}'" for n, p in ps)
    report, news, base = text._REPORT, text._NEWS, text._BASE
    one = lambda ps, cond: " ".join(f"WHEN {cond} AND regexp_matches({line}, '{p}') THEN '{n}'" for n, p in ps)
    return f"CASE {one(report, chr(115) + 't IN (' + repr('Report') + ', ' + repr('Policy') + ')')} {one(news, 'st = ' + repr('News'))} {arm(base)} END"


_LINES = f"""ln AS (SELECT doc_id, st, u.i - 1 AS i, u.l AS l, n, text FROM (SELECT doc_id, source_type AS st, text, string_split(text, chr(10)) AS ls, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL AND text <> ''),
 LATERAL (SELECT unnest(ls) AS l, generate_subscripts(ls, 1) AS i) u),
 hd AS (SELECT *, {_head('l')} AS type FROM ln), hs AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM hd WHERE type IS NOT NULL),
 sl AS (SELECT doc_id, i, l FROM ln), sz AS (SELECT h.doc_id, h.i, coalesce(sum(length(x.l)) + count(*) - 1, 0) AS c, count(x.l) AS k FROM hs h LEFT JOIN sl x ON x.doc_id = h.doc_id AND x.i > h.i AND x.i < coalesce(h.nx, h.n) GROUP BY 1, 2),
 se AS (SELECT h.doc_id, h.st, pos, type, trim(regexp_replace(l, '^#+\\s*', ''), ' ') AS title, h.i AS start_line, coalesce(nx, n) - 1 AS end_line, CASE WHEN k > 0 THEN c WHEN nx IS NULL THEN 0 ELSE 1 END AS chars
 FROM hs h JOIN sz ON sz.doc_id = h.doc_id AND sz.i = h.i UNION ALL
 SELECT doc_id, any_value(st), 0, 'content', 'Content', 0, any_value(n) - 1, length(any_value(text)) FROM hd GROUP BY doc_id HAVING count(type) = 0)"""
_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: len(x) >= 4 AND x NOT IN ({1})){2})"


def _tok(c: str, most: str = "[1:80]") -> str:
    return _TOK.format(c, ", ".join(f"'{w}'" for w in text.STOP_WORDS), most)


_URL = r"list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(https?://[^\s<>\"''\])]+)'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))"
_KIND = r"CASE WHEN regexp_matches(lower(url), 'zenodo|figshare|dataverse|dryad|pangaea|osf\.io|huggingface\.co/datasets') THEN 'dataset' WHEN regexp_matches(lower(url), 'github\.com') THEN 'repository' WHEN regexp_matches(lower(url), 'doi\.org') THEN 'doi' WHEN regexp_matches(lower(url), '\.(geojson|json|csv|tsv|zip|tiff?|gpkg|nc)(\?|#|$)') THEN 'dataset' ELSE 'external' END"


def _role_sql(role: str) -> str:
    types = ", ".join("'" + "_".join(admission._words(t)) + "'" for t in admission.ROLES[role])
    bonus = {
        "data_capability": "CASE WHEN n_datasets > 0 THEN 0.3 ELSE 0 END + CASE WHEN coalesce(spatial <> '', false) THEN 0.2 ELSE 0 END",
        "earth_content": "CASE WHEN coalesce(spatial <> '', false) THEN 0.5 ELSE 0 END",
        "computing_capability": "CASE WHEN coalesce(language <> '', false) OR n_tree > 5 THEN 0.3 ELSE 0 END",
    }.get(role, "0")
    return f"least(1.0, CASE WHEN sn IN ({types}) THEN 0.5 ELSE 0 END + {bonus})::DOUBLE AS {role}"


_ROLES = list(admission.ROLES)
_ADMIT = rf"""{_P}, {_R}, src AS (
 SELECT paper_id AS source_id, coalesce(doi, title) AS input, 'Paper' AS type, abstract AS description, coalesce(len(keywords), 0) AS n_keywords, coalesce(len(authors), 0) AS n_authors, coalesce(len(datasets), 0) AS n_datasets,
 coalesce(citation_count, 0) AS citations, datasets[1].spatial_coverage AS spatial, NULL AS language, 0 AS n_tree, 0 AS n_readme FROM p
 UNION ALL SELECT full_name, 'https://github.com/' || full_name, NULL, description, 0, 0, 0, 0, NULL, language, coalesce(len(tree), 0), coalesce(length(readme), 0) FROM r
 UNION ALL SELECT 'doc-' || doc_id, url, source_type, text, 0, 0, 0, 0, NULL, NULL, 0, 0 FROM documents),
 ty AS (SELECT * REPLACE (coalesce(nullif(type, ''), CASE WHEN regexp_matches(lower(coalesce(input, '')), '10\.\d{{4,}}/\S+') THEN 'Paper' WHEN regexp_matches(lower(coalesce(input, '')), 'github\.com/[\w-]+/[\w-]+') THEN 'Repository' ELSE 'Source' END) AS type) FROM src),
 sn AS (SELECT *, lower(regexp_replace(type, '([a-z0-9])([A-Z])', '\1_\2', 'g')) AS sn FROM ty),
 ro AS (SELECT *, {", ".join(_role_sql(x) for x in _ROLES)},
 least(1.0, round(CASE WHEN length(description) > 5000 THEN 0.3 WHEN length(description) > 1000 THEN 0.2 WHEN length(description) > 100 THEN 0.1 ELSE 0 END + CASE WHEN n_keywords > 0 THEN 0.1 ELSE 0 END + CASE WHEN n_authors > 0 THEN 0.1 ELSE 0 END
 + CASE WHEN coalesce(language <> '', false) THEN 0.15 ELSE 0 END + CASE WHEN n_tree > 10 THEN 0.15 WHEN n_tree > 0 THEN 0.1 ELSE 0 END + CASE WHEN n_readme > 500 THEN 0.15 ELSE 0 END + CASE WHEN coalesce(spatial <> '', false) THEN 0.15 ELSE 0 END
 + CASE WHEN citations > 0 THEN 0.1 ELSE 0 END, 6))::DOUBLE AS density FROM sn),
 sc AS (SELECT *, greatest({", ".join(_ROLES)}) AS best, ({" + ".join(_ROLES)}) / 10 AS mean, {" + ".join(f"({x} > 0)::INT" for x in _ROLES)} AS role_count,
 event_signal > 0 AND event_signal <= 0.3 AND greatest({", ".join(x for x in _ROLES if x != "event_signal")}) < 0.2 AS weak_event,
 list_sort(list_distinct(list_concat(['source', 'foundation'], {", ".join("CASE WHEN " + " OR ".join(f"{x} >= 0.2" for x in a[0]) + " THEN " + str(list(a[1])) + " ELSE [] END" for a in admission.ACTIVATES)}))) AS layers,
 list_sort(list_distinct(list_concat({", ".join("CASE WHEN " + " OR ".join(f"{x} >= 0.2" for x in a[0]) + " THEN " + str(list(a[2])) + " ELSE []::VARCHAR[] END" for a in admission.ACTIVATES)}))) AS categories FROM ro),
 sd AS (SELECT *, round(mean, 6) AS quick, round(round(best * 0.6 + mean * 0.4, 6) * 0.7 + density * 0.3, 6) AS score FROM sc),
 ad AS (SELECT *, CASE {" ".join(f"WHEN {x} = best AND best > 0 THEN '{x}'" for x in _ROLES)} ELSE 'earth_content' END AS primary_role,
 CASE WHEN weak_event OR score < 0.15 OR role_count = 0 THEN 'reject' WHEN score < 0.3 OR role_count < 2 THEN 'light' WHEN score < 0.5 OR len(categories) < 3 THEN 'structured' ELSE 'deep' END AS depth,
 CASE WHEN quick >= 0.4 THEN 'deep' WHEN quick >= 0.25 THEN 'structured' WHEN quick >= 0.15 THEN 'light' ELSE 'reject' END AS quick_depth FROM sd)"""
_OBJ = f"""{_P}, ds AS (SELECT paper_id AS source_id, u.i - 1 AS pos, u.d AS d FROM p, LATERAL (SELECT unnest(datasets) AS d, generate_subscripts(datasets, 1) AS i) u),
 kw AS (SELECT paper_id AS source_id, u.i - 1 AS pos, u.k AS k FROM p, LATERAL (SELECT unnest(keywords) AS k, generate_subscripts(keywords, 1) AS i) u),
 ob AS (SELECT * FROM (SELECT source_id, 'Dataset' AS type, d.name AS name, 0.8::DOUBLE AS confidence, pos, 'datasets' AS origin FROM ds UNION ALL
 SELECT source_id, 'Region', d.spatial_coverage, 0.8, pos, 'coverage' FROM ds WHERE lower(d.spatial_coverage) <> 'global' UNION ALL SELECT source_id, 'Variable', k, 0.9, pos, 'keywords' FROM kw) WHERE trim(name) <> ''),
 fw AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_id, type, lower(trim(name)) ORDER BY origin, pos, name) AS rn FROM ob) WHERE rn = 1)"""
_MATRIX = _values([(s, o, p) for s, ps in decompose.BRIDGE_MATRIX.items() for p, os_ in ps.items() for o in os_.split()], "st, ot, predicate")
_SKIP = " OR ".join(f"contains(lower(coalesce(provenance.section, '')), '{x}')" for x in decompose.SKIP_SECTIONS)
_ALIAS = _values(sorted(decompose.RELATION_ALIASES.items()), "a, r")
_FILES = r"""f0 AS (SELECT DISTINCT full_name, unnest(tree) AS path FROM repositories), f1 AS (SELECT full_name, path, list_filter(list_transform(string_split(lower(replace(path, '\', '/')), '/'), lambda x: trim(x)), lambda x: x <> '') AS s FROM f0 WHERE path IS NOT NULL),
 f2 AS (SELECT *, s[-1] AS name, s[1:len(s) - 1] AS par, regexp_extract(s[-1], '(\.[^.]*)$', 1) AS ext FROM f1), ex AS (SELECT * FROM """ + _values(
    [(n, r, s) for n, (r, s) in repositories.EXACT.items()], "xname, xrole, xscore"
) + r"""), f3 AS (SELECT full_name, path, CASE WHEN list_has_any(par, ['data', 'dataset', 'datasets']) AND ext IN ('.md', '.rst', '.txt', '.json', '.yaml', '.yml') THEN 'data_descriptor'
 WHEN list_has_any(par, ['example', 'examples', 'demo', 'demos', 'notebooks']) AND ext IN ('.py', '.js', '.ts', '.sh', '.r') THEN 'example_entrypoint'
 WHEN list_has_any(par, ['docs', 'doc', 'documentation']) AND ext IN ('.md', '.rst', '.txt') THEN 'documentation' ELSE coalesce(xrole, CASE WHEN ext IN ('.md', '.rst', '.txt') THEN 'documentation' END) END AS role,
 CASE WHEN list_has_any(par, ['data', 'dataset', 'datasets']) AND ext IN ('.md', '.rst', '.txt', '.json', '.yaml', '.yml') THEN 4 WHEN list_has_any(par, ['example', 'examples', 'demo', 'demos', 'notebooks']) AND ext IN ('.py', '.js', '.ts', '.sh', '.r') THEN 3
 WHEN list_has_any(par, ['docs', 'doc', 'documentation']) AND ext IN ('.md', '.rst', '.txt') THEN 3 ELSE coalesce(xscore, CASE WHEN ext IN ('.md', '.rst', '.txt') THEN 2 END) END AS score FROM f2 LEFT JOIN ex ON xname = name), fc AS (SELECT * FROM f3 WHERE role IS NOT NULL)"""
_CUR_APP = "ca AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, created_at DESC, status DESC NULLS LAST) AS rn FROM applications WHERE id IS NOT NULL) WHERE rn = 1)"
_CUR_INV = "ci AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY created_at DESC, used_at DESC NULLS LAST, status DESC NULLS LAST) AS rn FROM invites WHERE code IS NOT NULL) WHERE rn = 1)"

_HALF_UP = "floor({0} + 0.5)"
_VISUALS = "CASE WHEN visual_count = 0 THEN 75 ELSE floor(explained * 100 / visual_count + 0.5) END AS score_visuals"


def _weighted(weights: dict[str, float]) -> str:
    return f"floor(round({' + '.join(f'score_{k} * {w}' for k, w in weights.items())}, 6) + 0.5)::INT AS score"


_COUNTS = P4_NODES + """, c0 AS (SELECT project_id, count(*) FILTER (WHERE t = 'key_point') AS n_points, count(*) FILTER (WHERE t = 'result') AS n_nodes, count(*) FILTER (WHERE t = 'anchor') AS n_edges,
 count(*) FILTER (WHERE t = 'attachment') AS visual_count, count(*) FILTER (WHERE t = 'project_source') AS resource_count, count(*) FILTER (WHERE t = 'evidence') AS evidence FROM nodes GROUP BY 1)"""
_QUALITY = f"""{_COUNTS}, c1 AS (SELECT *, n_points > 0 AS has_one_line, least(visual_count, evidence) AS explained, least(resource_count, evidence) AS linked, evidence >= n_nodes AS ready, greatest(n_nodes - evidence, 0) AS warnings FROM c0),
 c2 AS (SELECT *, CASE WHEN n_points >= 3 AND has_one_line THEN 100 WHEN has_one_line OR n_points > 0 THEN 65 ELSE 20 END AS score_brief, CASE WHEN n_nodes >= 3 AND n_edges >= 2 THEN 100 WHEN n_nodes >= 2 THEN 70 ELSE 35 END AS score_route, {_VISUALS},
 CASE WHEN resource_count = 0 THEN 35 WHEN linked > 0 THEN 100 ELSE 65 END AS score_resources, CASE WHEN ready THEN 100 ELSE greatest(45, 85 - warnings * 10) END AS score_integrity FROM c1),
 c3 AS (SELECT *, {_weighted(quality.PROJECT_WEIGHTS)} FROM c2), pq AS (SELECT *, CASE WHEN score >= {quality.PRODUCT_READY} THEN 'product_ready' WHEN score >= {quality.REVIEWABLE} THEN 'reviewable' ELSE 'weak' END AS level FROM c3)"""
_SIGNALS = f"""{_COUNTS}, sg AS (SELECT project_id, unnest([{{'ord': 1, 'signal': 'brief', 'n': n_points}}, {{'ord': 2, 'signal': 'results', 'n': n_nodes}}, {{'ord': 3, 'signal': 'anchors', 'n': n_edges}}, {{'ord': 4, 'signal': 'visuals', 'n': visual_count}}, {{'ord': 5, 'signal': 'sources', 'n': resource_count}}], recursive := true) FROM c0),
 si AS (SELECT project_id, ord, signal, CASE WHEN n >= 3 THEN 'ready' WHEN n > 0 THEN 'limited' ELSE 'missing' END AS state FROM sg)"""
_REVIEW = rf"""ro AS (SELECT full_name, list(DISTINCT role) AS roles FROM fc GROUP BY 1), nm AS (SELECT full_name, bool_or(coalesce(readme <> '', false)) AS rt, bool_or(coalesce(license <> '', false)) AS lt,
 bool_or(len(list_filter(coalesce(tree, []), lambda x: coalesce(regexp_matches(lower(x), '(^|[/\\])licen[cs]e(\.md|\.txt)?$'), false))) > 0) AS lf, bool_or(len(list_filter(coalesce(tree, []), lambda x: coalesce(lower(x) LIKE '%.ipynb', false))) > 0) AS nb,
 bool_or(coalesce(regexp_matches(lower(readme), 'python |node |npm (run|install)|pip install|docker run|make '), false)) AS rn FROM repositories GROUP BY 1),
 ck AS (SELECT nm.full_name, rt OR h('readme') AS c_readme, lt OR lf AS c_license, h('dependency_manifest') OR h('package_manifest') OR h('environment_manifest') AS c_dependencies, nb OR h('entrypoint') OR h('example_entrypoint') AS c_script,
 h('data_descriptor') AS c_data, h('container_manifest') AS c_docker, rn AS c_run FROM nm LEFT JOIN ro ON ro.full_name IS NOT DISTINCT FROM nm.full_name),
 cp AS (SELECT *, c_readme::INT + c_license::INT + c_dependencies::INT + c_script::INT + c_data::INT + c_docker::INT + c_run::INT AS passed FROM ck)"""
for _role in ("readme", "dependency_manifest", "package_manifest", "environment_manifest", "entrypoint", "example_entrypoint", "data_descriptor", "container_manifest"):
    _REVIEW = _REVIEW.replace(f"h('{_role}')", f"coalesce(list_contains(roles, '{_role}'), false)")
_SQUEEZED = r"lower(regexp_replace({0}, '\s+', ' ', 'g'))"
_MATCH = f"""CASE WHEN quote IS NULL OR quote = '' OR abstract = '' THEN 'missing' WHEN contains(abstract, quote) THEN 'exact' WHEN contains(f, q) THEN 'normalized' WHEN contains(f, left(q, 100)) THEN 'partial' ELSE 'similarity' END"""

_TRACE = f"""WITH {E.replace('SELECT * FROM (', 'SELECT * EXCLUDE (project_id) FROM (', 1)}, {_M}, mm AS (SELECT m.project_id, e.* FROM m JOIN e ON e.id = m.id), n AS (SELECT project_id, id AS node_id, {_tok('attributes->>$$$.statement$$')} AS ts FROM mm WHERE type = 'Claim'),
 o AS (SELECT project_id, id AS name, coalesce(source <> '', false) AS grounded, {_tok('concat_ws($$ $$, name, attributes->>$$$.title$$, attributes->>$$$.description$$)')} AS ts FROM mm WHERE type IN ('Dataset', 'Paper', 'Variable')),
 h AS (SELECT n.project_id, node_id, name, grounded, round(len(list_intersect(n.ts, o.ts)) / least(len(n.ts), len(o.ts)), 6) AS s FROM n JOIN o ON o.project_id = n.project_id AND len(list_intersect(n.ts, o.ts)) > 0),
 b AS (SELECT project_id, node_id, max((s, name, grounded)) AS m FROM h GROUP BY 1, 2),
 tr AS (SELECT n.project_id AS source_id, n.node_id, coalesce(m[1], 0) AS score, CASE WHEN m[1] >= 0.18 AND m[3] THEN 'traceable' WHEN m[1] >= 0.18 THEN 'weak' ELSE 'untraced' END AS level FROM (SELECT DISTINCT project_id, node_id FROM n) n LEFT JOIN b ON b.project_id = n.project_id AND b.node_id = n.node_id)"""

_HINTS = _values([(role, h, i) for role, hs in decompose.ROLE_HINTS.items() for i, h in enumerate(hs)], "role, h, hi")
_SHORT = r"(CASE WHEN length(trim(regexp_replace({0}, '\s+', ' ', 'g'))) > {1} THEN trim(left(trim(regexp_replace({0}, '\s+', ' ', 'g')), {1})) || '...' ELSE trim(regexp_replace({0}, '\s+', ' ', 'g')) END)"


def _claim(c: str) -> str:
    parts = f"list_filter(regexp_split_to_array(regexp_replace({_SHORT.format(c, 1200)}, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 80)"
    return f"coalesce(list_filter({parts}, lambda x: regexp_matches(x, '(?i)\\b(show|shows|demonstrate|achieve|achieves|provide|provides|improve|improves|result|results)\\b'))[1], {parts}[1])"


_LONG = r"coalesce(nullif(regexp_extract({0}, '^(.{{80,}}?[.!?])\s', 1), ''), {0})"
_TEXT_OBJECTS = rf"""{_LINES}, tx AS (SELECT h.doc_id, h.pos, h.type, lower(regexp_replace(regexp_replace(any_value(h.l), '^#+\s*', ''), '^\s+|\s+$', '', 'g')) AS title, regexp_replace(coalesce(string_agg(x.l, chr(10) ORDER BY x.i), ''), '^\s+|\s+$', '', 'g') AS body
 FROM hs h LEFT JOIN sl x ON x.doc_id = h.doc_id AND x.i > h.i AND x.i < coalesce(h.nx, h.n) WHERE length(h.text) >= 100 GROUP BY 1, 2, 3
 UNION ALL SELECT doc_id, 0, 'content', 'content', regexp_replace(any_value(text), '^\s+|\s+$', '', 'g') FROM hd GROUP BY doc_id HAVING count(type) = 0 AND any_value(length(text)) >= 100),
 ky AS (SELECT doc_id, key, body, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos, k) AS rn, pos * 2 + k AS ord FROM (SELECT doc_id, pos, 0 AS k, type AS key, body FROM tx WHERE length(body) >= 20 UNION ALL SELECT doc_id, pos, 1, title, body FROM tx WHERE length(body) >= 20) WHERE key <> ''),
 en AS (SELECT * FROM ky WHERE rn = 1 AND length(body) > 80), hi AS (SELECT * FROM {_HINTS}),
 ch AS (SELECT doc_id, role, arg_min(key, (rank, ord)) AS key, arg_min(body, (rank, ord)) AS body FROM (SELECT doc_id, key, body, ord, role, CASE WHEN key = h THEN 2 * hi ELSE 2 * hi + 1 END AS rank FROM en JOIN hi ON contains(key, h)) GROUP BY 1, 2),
 cl AS (SELECT doc_id, key, {_claim('body')} AS said FROM ch WHERE role = 'abstract'), ev AS (SELECT doc_id, key, {_claim('body')} AS said FROM ch WHERE role = 'evidence'),
 ob AS (SELECT doc_id, 'method' AS origin, CASE WHEN contains(key, 'model') THEN 'Model' ELSE 'Method' END AS type, key AS section, 0.5::DOUBLE AS confidence, key AS name, {_LONG.format(_SHORT.format('body', 800))} AS description FROM ch WHERE role = 'method'
 UNION ALL SELECT doc_id, 'data', 'Dataset', key, 0.5, coalesce(nullif(regexp_extract(body, '(?i)(https?://[^\s),;]+)', 1), ''), key), {_LONG.format(_SHORT.format('body', 800))} FROM ch WHERE role = 'data'
 UNION ALL SELECT ch.doc_id, 'workflow', 'Workflow', key, 0.5, coalesce(nullif(title, ''), 'Source-described'), {_LONG.format(_SHORT.format('body', 800))} FROM ch JOIN documents d ON d.doc_id = ch.doc_id WHERE role = 'workflow'
 UNION ALL SELECT doc_id, 'claim', 'Claim', key, 0.5, said, NULL FROM cl WHERE said IS NOT NULL
 UNION ALL SELECT ch.doc_id, 'scope', 'Region', key, 0.45, 'Global scope', NULL FROM ch JOIN documents d ON d.doc_id = ch.doc_id WHERE role = 'abstract' AND (regexp_matches(body, '(?i)\bglobal\b') OR coalesce(regexp_matches(title, '(?i)\bglobal\b'), false))
 UNION ALL SELECT ev.doc_id, 'evidence', 'Claim', ev.key, 0.5, ev.said, NULL FROM ev LEFT JOIN cl ON cl.doc_id = ev.doc_id
 WHERE ev.said IS NOT NULL AND NOT coalesce(len(list_intersect({_tok('cl.said')}, {_tok('ev.said')})) / nullif(least(len({_tok('cl.said')}), len({_tok('ev.said')})), 0) > 0.8, false))"""

RATE_LIMIT = "WITH RECURSIVE o AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS i FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), r(key, i, last, ok) AS (SELECT key, i, [us], true FROM o WHERE i = 1 UNION ALL SELECT o.key, o.i, CASE WHEN len(last) < 3 OR o.us - last[len(last) - 2] >= 3600000000 THEN list_append(last, o.us) ELSE last END, len(last) < 3 OR o.us - last[len(last) - 2] >= 3600000000 FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1) SELECT key, ok AS allowed, count(*) AS n FROM r GROUP BY 1, 2"

ORACLES = {
    "m_text_objects": f"WITH {_TEXT_OBJECTS} SELECT origin, type, section, confidence, count(*) AS n, count(DISTINCT name) AS names, sum(length(description))::BIGINT AS chars FROM ob GROUP BY 1, 2, 3, 4",
    "t_chunks": f"WITH RECURSIVE {_LINES}, im AS (SELECT * FROM {_values(list(text.IMPORTANCE.items()), 'ty, w')}), od AS (SELECT doc_id, chars, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(w, 0.5) DESC, pos) AS i FROM se LEFT JOIN im ON ty = type), pk(doc_id, i, opened, done) AS (SELECT doc_id, i, chars::BIGINT, []::BIGINT[] FROM od WHERE i = 1 UNION ALL SELECT od.doc_id, od.i, CASE WHEN opened + chars <= {text.MAX_CHUNK} THEN opened + 2 + chars ELSE chars END::BIGINT, CASE WHEN opened + chars <= {text.MAX_CHUNK} THEN done ELSE list_append(done, opened) END FROM pk JOIN od ON od.doc_id = pk.doc_id AND od.i = pk.i + 1), lp AS (SELECT doc_id, list_append(done, opened) AS s FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS rn FROM pk) WHERE rn = 1) SELECT doc_id, len(s) AS chunks, list_max(s) AS largest, list_sum(s)::BIGINT AS chars FROM lp WHERE len(s) > 1",
    "t_validate_text": f"WITH {_P}, a AS (SELECT paper_id, abstract, title FROM p WHERE abstract IS NOT NULL), b AS (SELECT abstract, 'late' AS name, upper(left(abstract, 60)) || ' zzz' AS quote FROM a UNION ALL SELECT abstract, 'title', title FROM a UNION ALL SELECT abstract, 'abstract', abstract FROM a), n AS (SELECT *, {_SQUEEZED.format('trim(quote)')} AS q, {_SQUEEZED.format('abstract')} AS f FROM b), x AS (SELECT *, {_MATCH} AS match, string_split(q, ' ')[1:20] AS ws FROM n) SELECT name AS quote, match, CASE match WHEN 'missing' THEN false WHEN 'similarity' THEN len(list_filter(ws, lambda w: contains(f, w))) / len(ws) >= 0.7 ELSE true END AS valid, count(*) AS n FROM x GROUP BY 1, 2, 3",
    "r_review": f"WITH {_FILES}, {_REVIEW} SELECT *, CASE WHEN c_readme AND c_license AND c_dependencies AND c_script AND c_run AND passed >= 6 THEN 'A' WHEN c_readme AND c_script AND (c_dependencies OR c_run) AND passed >= 4 THEN 'B' WHEN c_readme AND (c_script OR c_dependencies) AND passed >= 3 THEN 'C' WHEN c_readme OR passed >= 1 THEN 'D' ELSE 'E' END AS grade FROM cp",
    "q_project_quality": f"{_QUALITY} SELECT project_id, score, level, {', '.join(f'score_{k}' for k in quality.PROJECT_WEIGHTS)} FROM pq",
    "q_benchmark": f"{_QUALITY} SELECT count(*) AS n, round(avg(score), 4) AS avg_score, min(score) AS min_score, count(*) FILTER (WHERE level = 'weak') AS weak, bool_and(level <> 'weak') AS passed FROM pq",
    "q_paper_quality": f"WITH {_OBJ}, nf AS (SELECT source_id, count(*) AS n FROM fw GROUP BY 1), x AS (SELECT paper_id, coalesce(length(abstract), 0) > 0 AS has_one_line, coalesce(n, 0) AS n_points, coalesce(len(datasets), 0) AS n_nodes, coalesce(len(keywords), 0) AS n_edges, abstract FROM p LEFT JOIN nf ON source_id = paper_id), y AS (SELECT *, CASE WHEN has_one_line AND n_points >= 3 THEN 90 WHEN has_one_line OR n_points > 0 THEN 60 ELSE 20 END AS score_brief, CASE WHEN n_nodes >= 3 AND n_edges >= 2 THEN 90 WHEN n_nodes >= 2 THEN 65 ELSE 25 END AS score_route, 45 AS score_traceability, 45 AS score_fidelity, 75 AS score_visuals, CASE WHEN n_nodes = 0 THEN 35 ELSE 100 END AS score_resources, CASE WHEN abstract IS NOT NULL THEN 55 ELSE 50 END AS score_coverage FROM x), z AS (SELECT *, {_weighted(quality.SOURCE_WEIGHTS)}, (score_brief < 55)::INT + (score_route < 55)::INT + (n_nodes = 0)::INT AS weak FROM y) SELECT CASE WHEN score >= {quality.PRODUCT_READY} AND weak = 0 THEN 'product_ready' WHEN score >= {quality.REVIEWABLE} AND weak <= 1 THEN 'reviewable' ELSE 'weak' END AS level, score, count(*) AS papers FROM z GROUP BY 1, 2",
    "q_readiness": f"{_SIGNALS} SELECT project_id, count(*) FILTER (WHERE state = 'ready') AS ready, count(*) AS total, floor(count(*) FILTER (WHERE state = 'ready') * 100 / count(*) + 0.5)::BIGINT AS score FROM si GROUP BY 1",
    "q_action_plan": f"{_SIGNALS}, rk AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY CASE state WHEN 'missing' THEN 1 ELSE 2 END, ord) AS rank FROM si WHERE state <> 'ready') SELECT project_id, rank, signal, state FROM rk WHERE rank <= 4",
    "k_rate_limit": RATE_LIMIT,
    "t_sections": f"WITH {_LINES} SELECT doc_id, pos, type, title, start_line, end_line, chars FROM se",
    "t_section_stats": f"WITH {_LINES}, im AS (SELECT * FROM {_values(list(text.IMPORTANCE.items()), 'ty, w')}) SELECT st AS source_type, type, count(*) AS n, sum(chars)::BIGINT AS chars, max(coalesce(w, 0.5))::DOUBLE AS importance FROM se LEFT JOIN im ON ty = type GROUP BY 1, 2",
    "t_tokens": f"SELECT token, count(*) AS documents FROM (SELECT unnest({_tok('text', '')}) AS token FROM documents) GROUP BY 1 HAVING count(*) >= 50",
    "t_overlap": f"WITH {_P}, x AS (SELECT paper_id, {_tok('title')} AS a, {_tok('abstract')} AS b FROM p) SELECT paper_id, CASE WHEN least(len(a), len(b)) = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) END AS score FROM x",
    "t_best_match": f"{_TRACE} SELECT source_id, node_id, score, level FROM tr",
    "t_traceability": f"{_TRACE}, k AS (SELECT source_id, count(*) AS nodes, count(*) FILTER (WHERE level = 'traceable') AS traceable, count(*) FILTER (WHERE level = 'weak') AS weak, count(*) FILTER (WHERE level = 'untraced') AS untraced FROM tr GROUP BY 1), z AS (SELECT *, floor((traceable + weak * 0.5) * 100 / nodes + 0.5)::INT AS score FROM k) SELECT *, CASE WHEN traceable = 0 OR score < 50 OR untraced > 0 THEN 'weak' WHEN score < 80 OR weak > 0 THEN 'partial' ELSE 'traceable' END AS level FROM z",
    "m_source_triples": f"WITH {_OBJ}, dd AS (SELECT source_id, source_id || '/' || name AS id FROM fw WHERE type = 'Dataset'), rr AS (SELECT source_id, source_id || '/' || name AS id FROM fw WHERE type = 'Region'), x AS (SELECT DISTINCT source_id, source_id AS s, 'uses' AS predicate, id AS o, 0.8::DOUBLE AS confidence, 'datasets' AS section FROM dd UNION SELECT source_id, source_id, 'studies', id, 0.8, 'spatial' FROM rr UNION SELECT dd.source_id, dd.id, 'covers', rr.id, 0.7, 'spatial' FROM dd JOIN rr USING (source_id)) SELECT predicate, confidence, section, count(*) AS n, count(DISTINCT source_id) AS papers FROM x GROUP BY 1, 2, 3",
    "m_fallback_bridges": f"WITH {_OBJ}, br AS (SELECT * FROM {_values([(p, a, b, c) for p, (ds, rs, _, c) in ontology.BRIDGES.items() if c is not None for a in ds for b in rs if a in ('Dataset', 'Data') and b in ('Region', 'EarthObject', 'Object', 'Variable', 'Entity')], 'predicate, st, ot, cap')}), an AS (SELECT * FROM (VALUES ('Region', 'Region'), ('Region', 'EarthObject'), ('Region', 'Object'), ('Variable', 'Variable'), ('Variable', 'Entity')) v(ty, up)), nd AS (SELECT source_id, name FROM fw WHERE type = 'Dataset' AND pos = 0), x AS (SELECT DISTINCT a.source_id, a.name AS s, br.predicate, b.name AS o, cap::DOUBLE AS confidence FROM fw a JOIN fw b ON b.source_id = a.source_id AND b.type IN ('Region', 'Variable') JOIN an ON an.ty = b.type JOIN br ON br.ot = an.up WHERE a.type = 'Dataset' AND a.name <> b.name AND NOT EXISTS (SELECT 1 FROM nd WHERE nd.source_id = a.source_id AND nd.name = a.name)) SELECT predicate, confidence, count(*) AS n, count(DISTINCT source_id) AS papers FROM x GROUP BY 1, 2",
    "m_mapped": f"WITH {_P}, {_R}, f AS (SELECT 'Paper' AS type, 'metadata' AS section, unnest([CASE WHEN title IS NOT NULL THEN 'title' END, CASE WHEN doi IS NOT NULL THEN 'doi' END, CASE WHEN abstract IS NOT NULL THEN 'abstract' END, CASE WHEN year IS NOT NULL THEN 'year' END, CASE WHEN venue IS NOT NULL THEN 'venue' END, CASE WHEN citation_count IS NOT NULL THEN 'citationCount' END, CASE WHEN authors IS NOT NULL THEN 'authors' END, CASE WHEN keywords IS NOT NULL THEN 'keywords' END]) AS field FROM p UNION ALL SELECT 'Dataset', 'datasets', unnest([CASE WHEN s.name IS NOT NULL THEN 'name' END, CASE WHEN s.spatial_coverage IS NOT NULL THEN 'spatialCoverage' END, CASE WHEN s.role IS NOT NULL THEN 'role' END]) FROM (SELECT unnest(datasets) AS s FROM p) UNION ALL SELECT 'Repository', 'metadata', unnest(['repo', CASE WHEN contains(full_name, '/') THEN 'name' END, CASE WHEN language IS NOT NULL THEN 'language' END, CASE WHEN stars IS NOT NULL THEN 'stars' END, CASE WHEN license IS NOT NULL THEN 'license' END, CASE WHEN description IS NOT NULL THEN 'description' END, CASE WHEN readme IS NOT NULL THEN 'readme' END]) FROM r) SELECT type, section, field, count(*) AS n FROM f WHERE field IS NOT NULL GROUP BY 1, 2, 3",
    "t_urls": f"SELECT {_KIND} AS kind, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_URL}) AS url FROM documents) GROUP BY 1",
    "t_doi": rf"WITH {_P} SELECT doi, count(*) AS papers FROM (SELECT nullif(regexp_replace(regexp_extract(lower(doi), '(10\.[0-9]{{4,9}}/[^\s\"<>]+)', 1), '[.,;:)\]}}]+$', ''), '') AS doi FROM p) WHERE doi IS NOT NULL GROUP BY 1",
    "t_slug": rf"WITH {_P}, x AS (SELECT paper_id, title, trim(regexp_replace(abstract, '\s+', ' ', 'g')) AS a FROM p) SELECT paper_id, left(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 50) AS slug, coalesce(nullif(regexp_extract(a, '^(.+?[.!?])(\s|$)', 1), ''), a) AS first FROM x",
    "t_find_span": rf"WITH {_P}, x AS (SELECT paper_id, abstract, string_split(abstract, '. ')[2] AS s FROM p WHERE abstract IS NOT NULL) SELECT paper_id, CASE WHEN s <> '' AND position(left(lower(trim(s)), 100) IN lower(abstract)) > 0 THEN position(left(lower(trim(s)), 100) IN lower(abstract)) - 1 END AS start FROM x WHERE s IS NOT NULL",
    "a_decide": f"WITH {_ADMIT} SELECT source_id, type, primary_role, role_count, density, score, depth, depth <> 'reject' AS admitted, quick_depth FROM ad",
    "a_roles": f"WITH {_ADMIT} SELECT type, {', '.join(f'round(avg({x}), 6) AS {x}' for x in _ROLES)}, count(*) AS n FROM ad GROUP BY 1",
    "a_stats": f"WITH {_ADMIT} SELECT d.depth, count(ad.source_id) AS sources, round(avg(score), 6) AS avg_score, count(*) FILTER (WHERE ad.depth <> 'reject') AS admitted FROM (VALUES ('reject'), ('light'), ('structured'), ('deep')) d(depth) LEFT JOIN ad ON ad.depth = d.depth GROUP BY 1",
    "a_activated": f"WITH {_ADMIT} SELECT type, array_to_string(layers, ',') AS layers, array_to_string(categories, ',') AS categories, count(*) AS n FROM ad GROUP BY 1, 2, 3",
    "a_evidence_potential": "WITH x AS (SELECT source_type AS type, coalesce(regexp_matches(lower(text), '(?m)^#+ *method'), false) AS m, coalesce(regexp_matches(lower(text), '(?m)^#+ *result'), false) AS r, coalesce(regexp_matches(lower(text), 'table [0-9]|figure [0-9]'), false) AS v FROM documents), y AS (SELECT type, least(1.0, CASE lower(type) WHEN 'paper' THEN 0.4 WHEN 'report' THEN 0.25 WHEN 'news' THEN 0.1 WHEN 'dataset' THEN 0.3 ELSE 0 END + 0.2 * m::INT + 0.2 * r::INT + 0.15 * v::INT) AS p FROM x) SELECT type, round(avg(p), 6) AS avg_potential, count(*) FILTER (WHERE p >= 0.3) AS chains FROM y GROUP BY 1",
    "r_file_roles": f"WITH {_FILES} SELECT role, score, count(*) AS files, count(DISTINCT full_name) AS repositories FROM fc GROUP BY 1, 2",
    "r_key_files": f"WITH {_FILES} SELECT full_name, rank, path, role FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY score DESC, path) AS rank FROM fc WHERE role <> 'readme') WHERE rank <= 8",
    "m_first_wins": f"WITH {_OBJ} SELECT * FROM fw",
    "m_priority_merge": f"WITH {_OBJ}, a AS (SELECT * FROM ob WHERE origin <> 'keywords'), m AS (SELECT * FROM a UNION ALL SELECT * FROM ob WHERE origin = 'keywords' AND NOT EXISTS (SELECT 1 FROM a WHERE a.source_id = ob.source_id AND a.type = ob.type AND lower(trim(a.name)) = lower(trim(ob.name)))), z AS (SELECT *, row_number() OVER (PARTITION BY source_id, type, lower(trim(name)) ORDER BY origin, pos, name) AS rn FROM m) SELECT type, origin, count(*) AS n FROM z WHERE rn = 1 GROUP BY 1, 2",
    "m_paper_triples": f"WITH {_OBJ} SELECT DISTINCT source_id, source_id AS subject, 'uses' AS predicate, name AS object, 0.8::DOUBLE AS confidence FROM ob WHERE type = 'Dataset' UNION SELECT source_id, source_id, 'studies', name, 0.8 FROM ob WHERE type = 'Region' UNION SELECT a.source_id, a.name, 'covers', b.name, 0.7 FROM ob a JOIN ob b ON a.source_id = b.source_id AND a.pos = b.pos AND b.type = 'Region' WHERE a.type = 'Dataset'",
    "m_scope_filter": f"WITH {T} SELECT provenance.section AS section, {_SKIP} AS dropped, count(*) AS n FROM t GROUP BY 1, 2",
    "m_canonical_relations": rf"WITH {T}, al AS (SELECT * FROM {_ALIAS}), x AS (SELECT predicate, regexp_replace(lower(trim(predicate)), '[\s_]+', '-', 'g') AS n FROM t) SELECT predicate, coalesce(r, x.n) AS relation, count(*) AS n FROM x LEFT JOIN al ON a = x.n GROUP BY 1, 2",
    "m_bridge_infer": f"WITH {E}, mx AS (SELECT * FROM {_MATRIX}), w AS (SELECT type, project_id, count(*) AS c FROM e WHERE project_id IS NOT NULL GROUP BY 1, 2) SELECT predicate, sum(a.c * b.c)::BIGINT AS n, count(DISTINCT a.project_id) AS projects FROM w a JOIN mx ON st = a.type JOIN w b ON b.project_id = a.project_id AND b.type = ot GROUP BY 1",
    "m_confidence": f"WITH {_OBJ}, n AS (SELECT source_id, count(*) FILTER (WHERE type IN ('Dataset', 'Variable')) AS c, count(*) FILTER (WHERE type = 'Region') AS w FROM fw GROUP BY 1) SELECT source_id, round(least(1.0, (1 + least(c / 2, 1.0) + least(w / 3, 1.0)) / 5), 6) AS confidence FROM n",
    "q_review_actions": f"WITH {E}, le AS (SELECT e.*, coalesce(o.layer, 'unknown') AS l, coalesce(o.category, 'other') AS c FROM e LEFT JOIN ontology_types o ON o.name = e.type) SELECT array_to_string(list_filter([CASE WHEN l = 'source' THEN 'Check the source' END, CASE WHEN c IN ('data', 'observation') THEN 'Check coverage and units' END, CASE WHEN c IN ('modeling', 'method') THEN 'Check inputs and outputs' END, CASE WHEN c IN ('evidence', 'knowledge') THEN 'Check the supporting evidence' END, CASE WHEN l = 'world' THEN 'Check place and extent' END, CASE WHEN coalesce(verification_state, 'extracted') = 'extracted' THEN 'Verify' END], lambda x: x IS NOT NULL), '; ') AS actions, count(*) AS n FROM le GROUP BY 1",
    "s_profile_fields": f"WITH {E}, f AS (SELECT type, unnest(json_keys(attributes)) AS field, attributes FROM e WHERE attributes IS NOT NULL), v AS (SELECT type, field, json_extract_string(attributes, '$.\"' || field || '\"') AS v, json_type(attributes, '$.\"' || field || '\"') AS jt, json_array_length(attributes, '$.\"' || field || '\"') AS jl FROM f), w AS (SELECT * FROM v WHERE v IS NOT NULL AND v <> ''), n AS (SELECT type, count(*) AS features FROM e WHERE attributes IS NOT NULL GROUP BY 1), x AS (SELECT type, field, count(*) AS k, count(DISTINCT v) FILTER (WHERE jt NOT IN ('ARRAY', 'OBJECT') AND try_cast(v AS DOUBLE) IS NULL) AS dist, count(*) FILTER (WHERE jt = 'ARRAY' AND jl >= 3 AND regexp_matches(v, '[0-9]')) AS ns FROM w GROUP BY 1, 2) SELECT x.type, field, features, dist AS distinct, round(k / features, 6) AS coverage, round(ns / features, 6) AS series, round(ns / features, 6) >= 0.15 AS is_series FROM x JOIN n ON n.type IS NOT DISTINCT FROM x.type WHERE x.type IS NOT NULL",
    "s_resource_rank": r"WITH x AS (SELECT DISTINCT full_name, unnest(tree) AS label FROM repositories), y AS (SELECT *, CASE WHEN regexp_matches(lower(label), '\.(geojson|json)$') THEN 'geojson' WHEN regexp_matches(lower(label), '\.csv$') THEN 'csv' WHEN regexp_matches(lower(label), '\.tsv$') THEN 'tsv' WHEN regexp_matches(lower(label), '\.(shp|zip)$') THEN 'shapefile' END AS format FROM x WHERE label <> '') SELECT full_name, label, format, 'sampleable-now' AS readiness, row_number() OVER (PARTITION BY full_name ORDER BY label) AS rank FROM y WHERE format IS NOT NULL",
    "s_containment": f"WITH {E}, pt AS (SELECT id, (attributes->>'$.centroid[0]')::DOUBLE AS x, (attributes->>'$.centroid[1]')::DOUBLE AS y FROM e WHERE attributes->>'$.centroid' IS NOT NULL), b0 AS (SELECT id, (attributes->>'$.bbox[0]')::DOUBLE AS a, (attributes->>'$.bbox[1]')::DOUBLE AS b, (attributes->>'$.bbox[2]')::DOUBLE AS c, (attributes->>'$.bbox[3]')::DOUBLE AS d FROM e WHERE type = 'Basin' AND attributes->>'$.bbox[3]' IS NOT NULL) SELECT b0.id AS box, count(*) AS points FROM pt JOIN b0 ON x BETWEEN least(a, c) AND greatest(a, c) AND y BETWEEN least(b, d) AND greatest(b, d) GROUP BY 1",
    "k_applications": rf"WITH {_CUR_APP} SELECT lower(trim(status)) AS status, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(trim(email)), '^[^\s@]+@[^\s@]+\.[^\s@]+$')) AS valid_email FROM ca GROUP BY 1",
    "k_active_invites": f"WITH {_CUR_INV} SELECT status, coalesce(status = 'active', false) AND coalesce(created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY, false) AS usable, count(*) AS n FROM ci GROUP BY 1, 2",
    "k_latest_sessions": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS issued_at, max(ts) + INTERVAL 30 DAY > TIMESTAMP '2024-02-10 00:00:00' AS valid FROM events GROUP BY 1",
    "k_window_counts": "SELECT in_window, count(*) AS n FROM (SELECT count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window FROM events) GROUP BY 1",
    "k_export_triples": r"WITH m AS (SELECT DISTINCT project_id, id FROM (SELECT id AS project_id, lower(regexp_replace(unnest(entities), '^\s+|\s+$', '', 'g')) AS id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, entities DESC) AS rn FROM projects WHERE id IS NOT NULL) WHERE rn = 1) WHERE id <> ''), " + T + " SELECT project_id, count(DISTINCT triple_id) AS triples FROM (SELECT project_id, triple_id FROM t JOIN m ON m.id = subject UNION ALL SELECT project_id, triple_id FROM t JOIN m ON m.id = object) GROUP BY 1",
}
