import datetime as dt
import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from basinweave.operators import evidence, eventlog, graph, lenses, ontology

T0 = dt.datetime(2024, 1, 1)
ENT = "id string, type string, name string, attributes string, confidence double, source string, verification_state string, reviewed_by string, reviewed_at timestamp, notes array<struct<text:string,by:string,at:timestamp>>, created_at timestamp, ingested_at timestamp, seq long"


def ents(spark, rows):
    full = [(i, t, n, a, c, "s", v, None, None, None, T0, T0, k) for k, (i, t, n, a, c, v) in enumerate(rows)]
    return spark.createDataFrame(full, ENT)


def trips(spark, edges):
    rows = [(f"t{k}", s, p, o, 0.5, None, k, T0) for k, (s, p, o) in enumerate(edges)]
    return spark.createDataFrame(rows, "triple_id string, subject string, predicate string, object string, confidence double, verification_state string, seq long, created_at timestamp")


BASE = [("a", "Dataset", "A", '{"spatialCoverage": "global"}', 0.0, None), ("b", "Region", None, '{"title": "Bee"}', 0.9, "verified"), ("c", "Region", "", "{}", None, "reviewed"), ("d", "Model", "D", None, 0.4, None)]


def test_upsert_keeps_the_last_row(spark):
    df = ents(spark, [*BASE, ("a", "Dataset", "A2", "{}", 0.0, None), (None, "X", "x", "{}", 1.0, None)])
    got = {r.id: r.name for r in graph.latest_entities(df).collect()}
    assert got == {"a": "A2", "b": None, "c": "", "d": "D"}
    assert {r.id: r.l for r in graph.latest_entities(ents(spark, BASE)).select("id", graph.display_name(F.col("name")).alias("l")).collect()} == {"a": "A", "b": "Bee", "c": "c", "d": "D"}


def test_validation_gives_every_triple_once(spark):
    t = trips(spark, [("a", "covers", "b"), ("x", "covers", "b"), ("a", "covers", "ent-zz"), ("a", "studies", "b"), ("a", "covers", "some words")])
    e = ents(spark, [*BASE, BASE[0]])
    got = {r.triple_id: r.reject_reason for r in graph.validate_triples(t, e, ontology.relation_table(spark), F.col("object").startswith("ent-")).collect()}
    assert got == {"t0": None, "t1": "missing_subject", "t2": "missing_object", "t3": "unregistered_predicate", "t4": None}


def test_paths_are_bags(spark):
    edges = [("a", "uses", "b"), ("a", "uses", "c"), ("b", "uses", "d"), ("c", "uses", "d"), ("d", "uses", "a"), ("d", "uses", "word")]
    t, e = trips(spark, edges), ents(spark, BASE)
    got = {(r.start, r.end): r.walks for r in graph.query_path(e.where("id = 'a'").select("id"), t, ["uses", "uses"], e).collect()}
    assert got == {("a", "d"): 2}
    three = graph.query_path(e.where("id = 'a'").select("id"), t, ["uses"] * 3, e).collect()
    assert {(r.end, r.walks) for r in three} == {("a", 2)}
    rng = random.Random(0)
    many = [(rng.choice("abcd"), rng.choice("pq"), rng.choice("abcde")) for _ in range(40)]
    want = Counter((s, o2) for (s, p, o), (s2, p2, o2) in itertools.product(many, many) if p == "p" and p2 == "q" and o == s2 and o2 != "e")
    got = {(r.start, r.end): r.walks for r in graph.query_path(e.select("id"), trips(spark, many), ["p", "q"], e).collect()}
    assert got == want


def test_match_and_relations(spark):
    t, e = trips(spark, [("a", "covers", "b"), ("d", "covers", "c"), ("a", "uses", "a")]), ents(spark, BASE)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(graph.match(e, t, "Dataset", {"spatialCoverage": "global"}, [("covers", {"type": "Region"})])) == ["a"]
    assert ids(graph.match(e, t, None, None, [("covers", None)])) == ["a", "d"]
    assert ids(graph.match(e, t, None, None, [("covers", {"type": "Region", "title": "Bee"})])) == ["a"]
    rel = {(r.direction, r.predicate, r.other) for r in graph.relations_of(e.where("id = 'a'"), t).collect()}
    assert rel == {("out", "covers", "b"), ("out", "uses", "a"), ("in", "uses", "a")}
    assert graph.query_inverse(t).count() == 0
    with pytest.raises(ValueError):
        graph.in_state(e, "unknown")


def test_verify_appends_a_note(spark):
    done = graph.verify(ents(spark, BASE), F.col("id") == "a", "verified", "me", "2024-05-05 00:00:00", "ok")
    rows = {r.id: r for r in done.collect()}
    assert rows["a"].verification_state == "verified" and rows["a"].reviewed_by == "me" and [n.text for n in rows["a"].notes] == ["ok"]
    assert rows["b"].notes is None and rows["c"].verification_state == "reviewed"


def test_closure_and_bridges(spark):
    types = spark.createDataFrame([(n,) for n in ("Basin", "Dataset", "DataProduct", "Model", "Streamflow")], "name string")
    closure = ontology.type_closure(ontology.parent_table(spark), types)
    up = {(r.name, r.ancestor) for r in closure.collect()}
    assert {("Basin", "Basin"), ("Basin", "Region"), ("Basin", "Object"), ("Streamflow", "Variable"), ("Streamflow", "Entity")} <= up
    pairs = spark.createDataFrame([("DataProduct", "Basin"), ("Model", "Streamflow"), ("Basin", "Dataset")], "subject_type string, object_type string")
    got = {(r.subject_type, r.predicate) for r in ontology.valid_bridges(pairs, closure, ontology.bridge_table(spark)).collect()}
    assert {("DataProduct", "covers"), ("Model", "simulates"), ("Model", "models"), ("Model", "predicts")} <= got
    assert not any(s == "Basin" for s, _ in got)
    caps = spark.createDataFrame([("covers", False), ("measures", False), ("measures", True), ("zzz", True)], "p string, e boolean").select("p", "e", ontology.confidence_cap(F.col("p"), F.col("e")).alias("c"))
    assert [r.c for r in caps.collect()] == [0.6, 0.0, 0.9, 0.5]


def layered(spark, rows):
    layer = {"Dataset": ("capability", "data"), "Region": ("world", "earth-object"), "Model": ("foundation", "method"), "Claim": ("foundation", "knowledge"), "Assessment": ("capability", "evidence")}
    types = spark.createDataFrame([(n, la, 1, c) for n, (la, c) in layer.items()], "name string, layer string, layer_rank int, category string")
    return ontology.with_layers(ents(spark, rows), types)


def members(spark, pairs):
    return spark.createDataFrame([(p, i, k) for k, (p, i) in enumerate(pairs)], "project_id string, id string, pos int")


def test_recommended_lens(spark):
    e = layered(spark, BASE + [("k", "Claim", "K", '{"statement": "x"}', 0.5, None)])
    m = members(spark, [("map", "a"), ("map", "b"), ("ev", "k"), ("none", "zz")])
    got = {r.project_id: r.lens for r in lenses.recommended_lens(m, e, trips(spark, [("k", "supports", "a")])).collect()}
    assert got == {"map": "map", "ev": "evidence", "none": "workflow"}


def test_boxes_and_times(spark):
    rows = [
        ("g", "Region", "g", '{"geometry": {"type": "Polygon", "coordinates": [[[1, 2], [3, -4.5], [5, 6]]]}, "bbox": [9, 9, 9, 9]}', 1.0, None), ("b", "Region", "b", '{"bbox": [1, 2, 3, 4]}', 1.0, None),
        ("c", "Region", "c", '{"centroid": [7, 8]}', 1.0, None), ("l", "Region", "l", '{"location": {"coordinates": [1, 1]}}', 1.0, None), ("w", "Dataset", "w", '{"spatialCoverage": "Global"}', 1.0, None),
        ("n", "Dataset", "n", '{"spatialCoverage": "Europe", "bbox": [1, 2]}', 1.0, None),
    ]
    got = {r.id: (r.geometry_from, r.min_lon, r.min_lat, r.max_lon, r.max_lat) for r in lenses.map_features(layered(spark, rows)).collect()}
    assert got == {"g": ("geometry", 1, -4.5, 5, 6), "b": ("bbox", 1, 2, 3, 4), "c": ("centroid", 7, 8, 7, 8), "l": ("location", 1, 1, 1, 1), "w": ("global", -180, -90, 180, 90)}
    times = [("y", "Claim", "y", '{"year": 1999, "start": 2001}', 1.0, None), ("s", "Claim", "s", '{"start": "2001-05-01"}', 1.0, None), ("r", "Claim", "r", '{"temporalCoverage": "1980-2010"}', 1.0, None), ("d", "Claim", "d", '{"date": "no year"}', 1.0, None), ("x", "Claim", "x", "{}", 1.0, None)]
    got = {r.id: (r.start, r.end) for r in lenses.timeline_events(layered(spark, times)).collect()}
    assert got == {"y": (1999, 1999), "s": (2001, 2001), "r": (1980, 2010), "d": (None, None)}


def test_stages_and_chains(spark):
    rows = [(i, t, i, a, 0.9, None) for i, t, a in [("in", "Dataset", "{}"), ("m", "Model", "{}"), ("out", "Region", '{"value": null}'), ("cl", "Claim", "{}"), ("e1", "Claim", "{}"), ("e2", "Claim", "{}")]]
    e = layered(spark, rows)
    t = trips(spark, [("m", "uses", "in"), ("m", "produces", "out"), ("e1", "supports", "cl"), ("e2", "supports", "e1"), ("cl", "supports", "e2"), ("e1", "supports", "e1")])
    stages = {r.id: r.stage for r in lenses.with_edges(e, t).select("id", lenses.workflow_stage().alias("stage")).collect()}
    assert stages["in"] == "input" and stages["m"] == "processing" and stages["out"] == "output"
    flows = [tuple(r) for r in lenses.data_flows(e.where("id = 'in'"), e, t).collect()]
    assert flows == [("in", "m", "out", "uses")]
    claims = lenses.evidence_claims(e, t)
    got = {r.id: (r.depth, r.supporters) for r in lenses.evidence_chains(claims, e, t).collect()}
    assert got == {"cl": (3, 1), "e1": (3, 2), "e2": (3, 1)}  # the third step leads back to where the chain began
    line = trips(spark, [(f"x{k + 1}", "supports", f"x{k}") for k in range(9)])
    chain = layered(spark, [(f"x{k}", "Claim", f"x{k}", "{}", 0.9, None) for k in range(10)])
    got = {r.id: r.depth for r in lenses.evidence_chains(chain, chain, line).collect()}
    assert got == {f"x{k}": min(5, 9 - k) for k in range(10)}
    nodes = evidence.chain_nodes(e.where("id = 'e2'"), e, t)
    assert {(r.id, r.level) for r in nodes.collect()} == {("e2", 0), ("e1", 1), ("cl", 2)}
    top = evidence.chain_summary(nodes, e, t).first()
    assert (top.depth, top.nodes, top.weak, top.gaps, top.sufficient) == (2, 3, 0, 0, True)


def test_long_chains_are_followed_to_their_end(spark):
    n = 2 * evidence.MERGE_ROUNDS + 3
    e = layered(spark, [(f"c{i:02d}", "Evidence" if i == 0 else "Claim", f"c{i:02d}", "{}", 0.9, None) for i in range(n)])
    t = trips(spark, [(f"c{i:02d}", "supports", f"c{i + 1:02d}") for i in range(n - 1)] + [(f"c{n - 1:02d}", "derives_from", "c00")])
    nodes = evidence.chain_nodes(e.where("type = 'Evidence'"), e, t)
    assert sorted((r.id, r.level) for r in nodes.collect()) == [(f"c{i:02d}", i) for i in range(n)]
    top = evidence.chain_summary(nodes, e, t).first()
    assert (top.depth, top.nodes, top.gaps) == (n - 1, n, 0)
    assert evidence.chain_text(nodes, e).first().text.count("\n") == n - 1


def test_event_log(spark):
    log = spark.createDataFrame([(1, T0, "x", ["a", "b", "a"]), (2, T0, "y", ["a", "b", "c"]), (3, T0, "y", [])], "event_id long, ts timestamp, type string, objects array<string>")
    assert {(r.a, r.b): r.times for r in eventlog.collaboration(log).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert [(r.object, r.events) for r in eventlog.top_objects(log, 2).collect()] == [("a", 2), ("b", 2)]
    assert {r.type: (r.events, r.objects) for r in eventlog.type_stats(log).collect()} == {"x": (1, 2), "y": (2, 3)}


def test_attribute_values_have_types(spark):
    rows = [(str(i), "Dataset", "n", a, 1.0, None) for i, a in enumerate(['{"v": 1}', '{"v": "1"}', '{"v": true}', '{"v": "true"}', '{"v": 1.0}', '{"v": null}', "{}", None, "no json"])]
    e = layered(spark, rows)
    hit = lambda v: sorted(r.id for r in graph.match(e, trips(spark, []), "Dataset", {"v": v}).collect())
    assert (hit(1), hit("1"), hit(True), hit("true")) == (["0", "4"], ["1"], ["2"], ["3"])


def test_walks_by_their_end_only(spark):
    e = layered(spark, [(i, "X", i, "{}", 1.0, None) for i in "abcz"])
    t = trips(spark, [("a", "p", "z"), ("b", "p", "z"), ("a", "p", "c"), ("a", "q", "z")])
    assert {(r.end, r.walks) for r in graph.query_path(e.select("id"), t, ["p"], e, keep_start=False).collect()} == {("z", 2), ("c", 1)}


def test_pipeline_and_evidence_graph(spark):
    e = layered(spark, [(i, t, i, "{}", 0.9, None) for i, t in [("in", "Dataset"), ("m", "Model"), ("cl", "Claim"), ("e1", "Claim")]])
    t = trips(spark, [("m", "uses", "in"), ("m", "uses", "in"), ("m", "uses", "m"), ("e1", "supports", "cl"), ("cl", "contradicts", "e1")])
    members = spark.createDataFrame([("p", "in", 0), ("p", "m", 1), ("p", "cl", 2), ("q", "m", 0)], "project_id string, id string, pos int")
    got = {(r.project_id, r.id): (r.position, r.depends_on) for r in lenses.workflow_pipeline(members, e, t).collect()}
    assert got["p", "m"] == (1, 1) and got["q", "m"] == (1, 0) and got["p", "in"] == (0, 0) and len(got) == 4
    claims = lenses.evidence_claims(e, t)
    edges = {tuple(r) for r in lenses.evidence_graph(members, claims, e, t).collect()}
    assert edges == {("p", "e1", "supports", "cl"), ("p", "cl", "contradicts", "e1")}
    s = lenses.evidence_summary(members, claims, lenses.evidence_chains(claims, e, t)).first()
    assert (s.project_id, s.claims, s.complete, s.unconnected, s.avg_depth) == ("p", 1, 1, 0, 2.0)
