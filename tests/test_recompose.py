import json

import pytest
from pyspark.sql import functions as F

from basinweave.functions import text
from basinweave.operators import citations, decompose, mapping, recompose, registry, routes, spatial


def test_route(spark):
    rows = [("p", "1", "Gauge records", "data"), ("p", "2", "gauge records ", "data"), ("p", "3", "Random forest", "modeling"), ("p", "4", "Data", "data"), ("p", "5", "Flood map", "hazard"), ("p", "6", "x", "nothing"), ("q", "7", "Only one", "data"), ("q", "8", None, "data")]
    o = spark.createDataFrame(rows, "g string, id string, label string, category string")
    nodes = routes.route_nodes(o, "g")
    assert [(r.stage, r.id) for r in nodes.where("g = 'p'").orderBy("pos").collect()] == [("data", "1"), ("method", "3"), ("context", "5")]
    assert [(r.from_id, r.to_id) for r in routes.route_edges(nodes, "g").orderBy("from_id").collect()] == [("1", "3"), ("3", "5")]
    assert {r.g: r.level for r in routes.route_quality(nodes, "g").collect()} == {"p": "content", "q": "limited"}


def test_evidence_links_and_visuals(spark):
    t = lambda rows: spark.createDataFrame(rows, "g string, id string, text string")
    claims = t([("p", "c", "streamflow declines during drought years"), ("q", "c", "streamflow declines during drought years")])
    edges = routes.evidence_graph(claims, t([("p", "v", "Figure: streamflow declines"), ("p", "w", "nothing shared")]), t([("q", "r", "drought archive")]), "g")
    assert {(r.g, r.to_id, r.label) for r in edges.collect()} == {("p", "v", "supported_by"), ("q", "r", "grounded_in")}
    rows = [("p", "a", 0, "Fig 1", "snow cover trend alps"), ("p", "b", 1, "Fig 2", "trend snow cover alps region"), ("p", "c", 2, "fig 1 ", "other words entirely"), ("p", "d", 3, None, "unlike everything else"), ("q", "e", 0, "Fig 1", "snow cover trend alps")]
    v = spark.createDataFrame(rows, "g string, id string, pos int, label string, text string")
    assert sorted(r.id for r in routes.dedupe_visuals(v, "g").collect()) == ["a", "d", "e"]


def test_map_recomposition(spark):
    rows = [
        ("p", "a", "Region", "world", "earth-object", '{"bbox": [1, 2, 3, 4]}'), ("p", "b", "Basin", "world", "earth-object", "{}"), ("p", "c", "Claim", "foundation", "knowledge", '{"value": 3}'),
        ("p", "d", "Dataset", "capability", "data", '{"spatialCoverage": "Alps"}'), ("q", "e", "Paper", "source", "academic", None), ("q", "f", "Hazard", "world", "hazard", '{"riskMap": "x", "codeRequired": true}'),
    ]
    e = recompose.classified(spark.createDataFrame(rows, "g string, id string, type string, type_layer string, type_category string, attributes string"))
    got = {r.id: (r.is_anchor, r.is_result, r.spatial_kind, r.renderability) for r in e.collect()}
    assert got["a"] == (True, False, "bbox", "renderable-now") and got["b"] == (True, False, "none", "not-renderable")
    assert got["c"] == (False, True, "none", "renderable-as-attachment") and got["d"][0] and got["e"][:2] == (False, False) and got["f"][3] == "requires-code-execution"
    layers = {(r.g, r.primitive): (r.anchors, r.results) for r in recompose.layers(e, "g").collect()}
    assert layers == {("p", "region-layer"): (1, 0), ("p", "attached-results"): (3, 1)}
    assert {r.g: r.mode for r in recompose.primary_mode(recompose.layers(e, "g"), "g").collect()} == {"p": "regional-map"}
    diag = {r.g: (r.anchors, r.renderable_anchors, r.status) for r in recompose.diagnostics(e, "g").collect()}
    assert diag == {"p": (3, 1, "ready"), "q": (1, 0, "needs_review")}
    att = spark.createDataFrame([("p", "v1", None, "c"), ("p", "v2", "zz", ""), ("q", "v3", "c", None)], "g string, attachment_id string, resultId string, objectId string")
    bound = {r.attachment_id: r.result_id for r in recompose.bind_attachments(att, e.where("is_result"), "g", ["resultId", "objectId"]).collect()}
    assert bound == {"v1": "c", "v2": None, "v3": None}


def test_citations(spark):
    q = spark.createDataFrame([("q1", "Snow depth record for the Alps", 2001), ("q2", "Entirely different words", None)], "query_id string, title string, year int")
    r = spark.createDataFrame([("r1", "Snow depth record of Alps", 1999), ("r2", "Snow depth record of Alps", 2001), ("r3", "Snow depth elsewhere", 2001), ("r4", None, None)], "record_id string, title string, year int")
    got = [(x.query_id, x.record_id) for x in citations.match_titles(q, r).collect()]
    assert got == [("q1", "r2")]
    one = lambda c: spark.createDataFrame([("Smith 2001, Vol. 12, pp. 345-350",)], "v string").select(c.alias("x")).first().x
    assert tuple(one(citations.citation_parts(F.col("v")))) == (2001, "12", "345")
    kinds = spark.createDataFrame([("10.1234/abc",), ("https://github.com/a/b",), ("https://x.example",), ("A long enough title of words",), ("x",)], "v string").select(citations.input_kind(F.col("v")).alias("k"))
    assert [x.k for x in kinds.collect()] == ["doi", "repository", "url", "title", "unknown"]


def test_registries(spark):
    reg = registry.Registry()
    reg.register("a", lambda s: s.range(1))
    reg.register("b", lambda s: 1 / 0)
    out = reg.run_all(spark)
    assert out["a"].count() == 1 and isinstance(out["b"], ZeroDivisionError) and reg.names() == ["a", "b"]
    assert reg.unregister("b") and not reg.has("b")
    with pytest.raises(KeyError):
        reg.run("b")
    ext = registry.Extensions()
    ext.register("soil", {"Horizon": "soil", "Region": "soil"}, ["overlies"])
    assert registry.Extensions.from_json(ext.to_json()).provider_of("Horizon") == "soil"
    types = spark.createDataFrame([("Region", "world", 4, "earth-object")], "name string, layer string, layer_rank int, category string")
    assert {(r.name, r.layer) for r in ext.extend_types(types).collect()} == {("Region", "world"), ("Horizon", "extension")}
    with pytest.raises(ValueError):
        ext.register("", {})


def test_metadata_and_mapping(spark):
    meta = {"datasets": ["Era", {"name": "Gauge set"}, {"x": 1}, None, ""], "claims": [{"statement": "It rains"}], "regions": "Alps", "models": None}
    df = spark.createDataFrame([("s", json.dumps(meta)), ("t", None), ("u", "{broken")], "id string, m string")
    got = {(r.source_id, r.type, r.name, r.pos) for r in decompose.metadata_objects(df, "id", "m").collect()}
    assert {x for x in got if x[1] != "Region"} == {("s", "Dataset", "Era", 0), ("s", "Dataset", "Gauge set", 1), ("s", "Claim", "It rains", 0)}
    row = mapping.map_any(spark.createDataFrame([("flood_event", '{"type": "flash", "n": 1, "z": null}')], "kind string, record string"), "kind").first()
    assert row.type == "FloodEvent" and json.loads(row.attributes) == {"floodType": "flash", "n": "1"}
    items = spark.createDataFrame([("p", "s1", "Snow Depth", 0), ("p", "s2", "snow-depth", 1), ("p", "s2", "Rain", 0), ("p", "s3", None, 0)], "g string, source_id string, k string, pos int")
    assert [(r.label, r.sources, r.rank) for r in decompose.merge_projects(items, "g", "k", 5).orderBy("rank").collect()] == [("Snow Depth", 2, 1), ("Rain", 1, 2)]


def test_small_functions(spark):
    one = lambda v, c: spark.createDataFrame([(v,)], "v string").select(c.alias("x")).first().x
    v = F.col("v")
    assert one("spatialCoverage_type", text.humanize_key(v)) == "Spatial Coverage type" and one("snow_depth-map", text.title_case(v)) == "Snow Depth Map"
    assert [one(w, text.singular(v)) for w in ("Basins", "studies", "boxes", "class", "axis")] == ["Basin", "study", "box", "class", "axis"]
    assert one("study", text.plural(v, F.lit(2))) == "2 studies" and one("box", text.plural(v, F.lit(1))) == "1 box"
    assert one("xx abc yy", text.context(F.lit("abc"), v, 2)) == "x abc y" and one("zz", text.context(F.lit("abc"), v)) is None
    assert one("a worldwide record", text.scope_signal(v)) and not one(None, text.scope_signal(v))
    assert one("flood near Neu Ulm, Germany today", text.place_pair(v)) == "Neu Ulm, Germany"
    assert tuple(one("https://zenodo.org/records/123", spatial.platform_of(v))) == ("zenodo", "123") and one("https://x.example", spatial.platform_of(v)) is None
    assert one("basin.geojson", spatial.candidate_score(v, F.lit(50.0))) == 145.0
    e = spark.createDataFrame([("1", "Ulm"), ("2", None), ("3", "nowhere")], "id string, place string")
    g = spark.createDataFrame([("ulm", 10.0, 48.0, 0.5), ("Ulm", 1.0, 2.0, 0.1)], "name string, lon double, lat double, importance double")
    assert [tuple(r) for r in spatial.geocode(e, g).collect()] == [("1", 10.0, 48.0, 0.675)]


def test_resources_limits_and_fallback(spark):
    from basinweave.operators import admission

    nodes = spark.createDataFrame([("p", "data", "n1"), ("p", "method", "n2"), ("q", "evidence", "n3")], "g string, stage string, id string")
    res = spark.createDataFrame([("p", "u1", "dataset"), ("p", "u2", "Repository"), ("p", "u3", "external"), ("q", "u4", "doi"), ("q", "u5", None)], "g string, url string, kind string")
    links = routes.resource_links(nodes, res, "g")
    assert {(r.url, r.node_id, r.label) for r in links.collect()} == {("u1", "n1", "provides_input"), ("u2", "n2", "may_implement"), ("u4", "n3", "supports_evidence")}
    assert {r.g: (r.resources, r.linked, r.level) for r in routes.resource_coverage(res, links, "g").collect()} == {"p": (3, 2, "partial"), "q": (2, 1, "partial")}
    src = spark.createDataFrame([("s", 0, 1, 1, 0, True), ("t", 1, 1, 1, 1, True)], "source_id string, n_world int, n_capability int, n_evidence int, n_relations int, deep boolean")
    assert {(r.source_id, r.limitation) for r in routes.limitations(src).collect()} == {("s", "spatial-context"), ("s", "relations")}
    roles = admission.fallback_roles(spark.createDataFrame([("News", "2024", "x", 1), ("Nothing", None, None, 0)], "type string, date string, location string, n_hazards int")).collect()
    assert (roles[0].event_signal, roles[0].earth_content, roles[1].event_signal) == (0.9, 0.2, 0.0)
