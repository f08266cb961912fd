import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from basinweave.functions import text
from basinweave.operators import admission, decompose, mapping, ontology, quality, repositories, spatial, state
from basinweave.sources import readers, sinks
from basinweave.streaming import events

TEXT = "lost\n# Abstract\nshort\n## Sub One\n\nbody a\nbody b\n# References\n"


def one(spark, value, column):
    return spark.createDataFrame([(value, "Paper")], "v string, t string").select(column.alias("x")).first().x


def secs(spark, value):
    return text.with_sections(spark.createDataFrame([(value, "Paper")], "v string, t string"), "v", "t").first().sections


def test_sections(spark):
    got = secs(spark, TEXT)
    assert [(s.type, s.title, s.start_line, s.end_line, s.text) for s in got] == [("abstract", "Abstract", 1, 2, "short"), ("subsection", "Sub One", 3, 6, "\nbody a\nbody b"), ("references", "References", 7, 8, "")]
    assert [s.type for s in secs(spark, "no header")] == ["content"]
    assert secs(spark, None) == secs(spark, "") == []


def brute_chunks(secs, most=8000):
    out, cur = [], None
    for s in sorted(secs, key=lambda s: -s[0]):
        if cur is None:
            cur = s[1]
        elif cur + s[1] <= most:
            cur += 2 + s[1]
        else:
            out.append(cur)
            cur = s[1]
    return out + ([cur] if cur is not None else [])


def test_chunks_against_brute_force(spark):
    rng = random.Random(5)
    names = ["Abstract", "Methods", "Results", "Discussion", "References"]
    docs = ["".join(f"# {n}\n{'x' * rng.randint(1, 6000)}\n" for n in rng.sample(names, rng.randint(1, 5))) for _ in range(20)]
    df = spark.createDataFrame([(d, "Paper") for d in docs], "v string, t string")
    for r in text.with_sections(df, "v", "t").select(F.col("sections").alias("s"), text.chunk_sizes(F.col("sections")).alias("c")).collect():
        assert r.c == brute_chunks([(s.importance, len(s.text)) for s in r.s])


@pytest.mark.parametrize(("quote", "full", "want"), [("abc d", "xx abc d", (True, "exact", 1.0)), ("ABC\n d", "xx abc   d", (True, "normalized", 0.95)), ("q" * 100 + "zzz", "q" * 120, (True, "partial", 0.7)), ("one two three zzz", "one two three", (True, "similarity", 0.75)), ("aaa bbb", "zzz", (False, "similarity", 0.0)), ("", "x", (False, "missing", 0.0)), (None, "x", (False, "missing", 0.0))])
def test_source_text(spark, quote, full, want):
    row = spark.createDataFrame([(quote, full)], "q string, f string").select(text.validate_source_text(F.col("q"), F.col("f")).alias("x")).first().x
    assert tuple(row) == want


def test_document_counts_read_whole_texts(spark, tmp_path):
    from basinweave.plans.content_queries import t_tokens

    body = " ".join(f"tok{i:03d}" for i in range(100))
    rows = [(i, body + " lastword lastword", "Report") for i in range(50)] + [(99, "tok000", "Report"), (100, None, "Report")]
    spark.createDataFrame(rows, "doc_id long, text string, source_type string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.token: r.documents for r in t_tokens(spark, str(tmp_path)).collect()}
    assert got == {f"tok{i:03d}": 50 + (i == 0) for i in range(100)} | {"lastword": 50}


def test_tokens_and_overlap(spark):
    many = " ".join(f"tok{i:03d}" for i in range(100))
    assert len(one(spark, many + " tok000", text.significant_tokens(F.col("v")))) == 80
    assert one(spark, "The DATA model, alpha-Beta beta!", text.significant_tokens(F.col("v"))) == ["alpha", "beta"]
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"), F.lit("w"))
    assert one(spark, "", text.overlap(a, b)) == one(spark, "", text.overlap(b, a)) == 0.5
    assert one(spark, "see https://a.example/x.csv, (http://b.example).", text.urls(F.col("v"))) == ["https://a.example/x.csv", "http://b.example"]
    assert one(spark, "doi:10.1234/AbC.5).", text.doi(F.col("v"))) == "10.1234/abc.5"
    assert one(spark, "  Hello, World--x ", text.slug(F.col("v"))) == "hello-world-x"


def test_admission(spark):
    rows = [
        ("news", "News", "2024", "here", 0, 0), ("bare", "Nothing", None, None, 0, 0), ("data", "DatasetPage", None, None, 3, 1), ("repo", None, None, None, 0, 0), ("event", "Source", "2024", "here", 0, 0),
    ]
    df = spark.createDataFrame(rows, "source_id string, type string, date string, location string, n_variables int, n_regions int")
    df = df.withColumn("input", F.when(F.col("source_id") == "repo", "https://github.com/a/b"))
    got = {r.source_id: r for r in admission.admit(df).collect()}
    assert got["repo"].type == "Repository" and got["repo"].primary_role == "observation_capability" and got["repo"].role_count == 3
    assert got["bare"].depth == "reject" and got["event"].depth == "reject" and got["event"].weak_event
    assert got["data"].data_capability == pytest.approx(0.8) and got["data"].earth_content == 0.5
    assert got["news"].event_signal == 0.8 and got["news"].admitted
    stats = {r.depth: r.sources for r in admission.admission_stats(admission.admit(df)).collect()}
    assert set(stats) == {"reject", "light", "structured", "deep"} and sum(stats.values()) == 5


def test_repositories(spark):
    tree = ["README.md", "requirements.txt", "main.py", "docs\\guide.md", "data/info.json", "examples/run.py", "Dockerfile", "LICENSE", "src/x.py", None]
    keys = {"requirements.txt": "# c\nnumpy==1.2\n-r other\nPandas>=2 ; x\n", "package.json": '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}', "broken/package.json": "{"}
    rows = [("o/r", "pip install x", "MIT", tree, keys), ("o/e", None, None, None, None)]
    df = spark.createDataFrame(rows, "full_name string, readme string, license string, tree array<string>, key_files map<string,string>")
    roles = {r.path: r.role for r in repositories.classified_files(df).collect()}
    assert roles == {"README.md": "readme", "requirements.txt": "dependency_manifest", "main.py": "entrypoint", "docs\\guide.md": "documentation", "data/info.json": "data_descriptor", "examples/run.py": "example_entrypoint", "Dockerfile": "container_manifest"}
    assert {r.full_name: r.grade for r in repositories.review(df).collect()} == {"o/r": "A", "o/e": "E"}
    assert {r.dependency for r in repositories.dependencies(df).collect()} == {"numpy", "pandas", "a", "b"}
    assert [r.path for r in repositories.key_files(repositories.classified_files(df), 2).orderBy("rank").collect()] == ["Dockerfile", "requirements.txt"]


def test_merging_and_confidence(spark):
    rows = [("p", "Dataset", "Era", 0.8, 0, "datasets"), ("p", "Dataset", " era", 0.8, 1, "datasets"), ("p", "Region", "era", 0.8, 0, "coverage")]
    o = spark.createDataFrame(rows, "source_id string, type string, name string, confidence double, pos int, origin string")
    first = decompose.merge_first_wins(o)
    assert sorted((r.type, r.name) for r in first.collect()) == [("Dataset", "Era"), ("Region", "era")]
    assert decompose.merge_first_wins(first).count() == first.count()
    got = spark.range(1).select(*[decompose.extraction_confidence(F.lit(d), F.lit(3), F.lit(0), F.lit(1), F.lit(0)).alias(d) for d in ("deep", "light", "none")]).first()
    assert tuple(got) == (0.5, 0.6, 0.6)
    rel = {v: one(spark, v, decompose.canonical_relation(F.col("v"))) for v in ("covered by", "derived_from", "uses", "COVERS", "")}
    assert rel == {"covered by": "covers", "derived_from": "derived-from", "uses": "supports", "COVERS": "covers", "": ""}
    e = spark.createDataFrame([("s", "d1", "Dataset"), ("s", "d2", "Dataset"), ("s", "b", "Basin"), ("u", "b2", "Basin")], "src string, id string, type string")
    listed = decompose.bridge_relations(e, e, "src")
    assert listed.count() == 2 and decompose.bridge_counts(e, "src").first().n == 2


def test_mapping(spark):
    df = spark.createDataFrame([('{"name": "A", "spatial": {"coverage": "x"}}',)], "record string")
    row = mapping.map_records(df, "dataset").first()
    assert row.type == "Dataset" and json.loads(row.attributes) == {"name": "A", "spatialCoverage": "x"}
    assert one(spark, 'Sure:\n```json\n{"a": [1, 2,],}\n``` ok', mapping.json_in_text(F.col("v"))) == '{"a": [1, 2]}'
    assert one(spark, "no json", mapping.json_in_text(F.col("v"))) is None
    assert json.loads(one(spark, '{"a": "1"}', mapping.fill_defaults(F.col("v"), {"a": "0", "b": "2"}))) == {"a": "1", "b": "2"}


def test_quality_levels(spark):
    cols = "has_one_line boolean, n_points int, n_nodes int, n_edges int, trace_score int, fidelity_score int, trace_level string, fidelity_level string, visual_count int, explained int, resource_count int, linked int, content_level string"
    rows = [(True, 3, 3, 2, 90, 90, "complete", "complete", 0, 0, 2, 2, "full_text"), (False, 0, 0, 0, None, None, None, None, 2, 0, 0, 0, None)]
    got = quality.source_quality(spark.createDataFrame(rows, cols)).collect()
    assert [(r.score, r.level) for r in got] == [(90, "product_ready"), (32, "weak")]
    signals = spark.createDataFrame([("p", 1, "a", "ready"), ("p", 2, "b", "limited"), ("p", 3, "c", "missing"), ("p", 4, "d", "pending")], "project_id string, ord int, signal string, state string")
    assert quality.readiness(signals).first().score == 25
    assert [r.signal for r in quality.action_plan(signals).orderBy("rank").collect()] == ["c", "b", "d"]


def test_spatial(spark, tmp_path):
    (tmp_path / "p.csv").write_text('Name,Latitude,Lon.\n"a, ""b""",1.5,2\nc,,3\nd,x,4\ne,100,0\n')
    pts = readers.read_point_table(spark, str(tmp_path / "p.csv")).collect()
    assert [(r.lon, r.lat, r.properties) for r in pts] == [(2.0, 1.5, {"Name": 'a, "b"'})]
    geo = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "n"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}, {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(geo))
    (tmp_path / "b.geojson").write_text('{"type": "LineString", "coordinates": [[0, 0], [5, -1]]}')
    got = {(r.name, r.geometry_type, r.min_lon, r.max_lat) for r in readers.read_geojson(spark, str(tmp_path)).where("name is not null").collect() if r.geometry_type}
    assert ("n", "Point", 1.0, 2.0) in got and ("Feature 1", "LineString", 0.0, 0.0) in got
    boxes = spark.createDataFrame([("x", 0.0, 0.0, 10.0, 10.0)], "box string, min_lon double, min_lat double, max_lon double, max_lat double")
    p = spark.createDataFrame([(i, float(i), 10.0) for i in range(-2, 13)], "i int, lon double, lat double")
    assert sorted(r.i for r in spatial.join_boxes(p, boxes, 3.0).collect()) == list(range(11))
    assert one(spark, "MÃ¼nchen", spatial.repair_mojibake(F.col("v"))) == "München"
    line = sinks.geojson_features(spark.createDataFrame([("i", "n", "Region", 0.0, 0.0, 1.0, 1.0)], "id string, name string, type string, min_lon double, min_lat double, max_lon double, max_lat double")).first().value
    assert json.loads(line)["geometry"]["type"] == "Polygon" and json.loads(line)["id"] == "i"


def test_pages_and_stores(spark, tmp_path):
    html = '<html><head><title>T</title><meta property="og:title" content="Better"></head><body><nav>x</nav><p>Hello <a href="https://zenodo.example/1">data</a></p><script>z</script></body></html>'
    page = readers.parse_pages(spark.createDataFrame([("1", html), ("2", None)], "id string, html string"), "id", "html")
    rows = {r.id: r for r in page.collect()}
    assert rows["1"].title == "Better" and rows["1"].body == "Hello data" and rows["2"].body == ""
    assert [(r.url, r.kind) for r in readers.page_links(page).collect()] == [("https://zenodo.example/1", "dataset")]
    idx = spark.createDataFrame([("p", {"we": [0, 2], "and": [1]})], "id string, idx map<string,array<int>>")
    assert readers.abstract_from_index(idx, "id", "idx").first().abstract == "we and we"
    (tmp_path / "s.json").write_text(json.dumps({"version": "1.0", "entities": [{"id": "a", "type": "X", "attributes": {"name": "n"}, "metadata": {"confidence": 0}}], "triples": [{"subject": "a", "predicate": "p", "object": "b"}]}))
    e, t = readers.read_store(spark, str(tmp_path / "s.json"))
    assert e.first().confidence == 0 and e.first().verification_state == "extracted" and t.first().triple_id.startswith("t-")
    (tmp_path / "e.jsonl").write_text('{"id": "1", "type": "x", "timestamp": "2024-01-01T00:00:00Z", "objects": ["a"]}\n{broken\n')
    assert [r.event_id for r in readers.read_event_log(spark, str(tmp_path / "e.jsonl")).collect()] == ["1"]


T0 = dt.datetime(2024, 1, 1)


def brute_limit(times, limit=3, span=3600):
    seen, out = [], []
    for t in times:
        ok = len([s for s in seen if t - s < span]) < limit
        if ok:
            seen.append(t)
        out.append(ok)
    return out


def test_rate_limit(spark):
    rng = random.Random(3)
    rows = [(k, i, T0 + dt.timedelta(seconds=rng.randint(0, 20000))) for k in ("a", "b") for i in range(60)] + [(None, 1, T0), ("a", 99, None)]
    df = spark.createDataFrame(rows, "ip string, n int, ts timestamp")
    got = state.rate_limit(df, "ip", "ts", "n").collect()
    for k in ("a", "b"):
        mine = sorted((r.us // 1_000_000, r.ident, r.allowed) for r in got if r.key == k)
        assert [m[2] for m in mine] == brute_limit([m[0] for m in mine])
    assert len(got) == 120


def test_keyed_state(spark):
    inv = spark.createDataFrame([("a", "active", T0), ("b", "active", T0 - dt.timedelta(seconds=1)), ("c", None, T0), ("d", "used", T0)], "code string, status string, created_at timestamp_ntz")
    assert {r.code: r.usable for r in state.active_invites(inv, "2024-01-08 00:00:00").collect()} == {"a": True, "b": False, "c": False, "d": False}
    prog = spark.createDataFrame([("p", "x", "started", 1), ("p", "x", "completed", 2), ("p", "y", "started", 3), ("q", "x", "completed", 1), ("r", "x", "failed", 1)], "project_id string, phase string, status string, seq int")
    assert {r.project_id: r.state for r in state.analysis_state(prog).collect()} == {"p": "inProgress", "q": "completed", "r": "failed"}
    e = spark.createDataFrame([("a",), ("b",)], "id string")
    t = spark.createDataFrame([("1", "a", "b"), ("2", "b", "b")], "triple_id string, subject string, object string")
    m = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "b")], "project_id string, id string")
    rest, edges = state.delete_projects(e, t, m, m.where("project_id = 'p'").select("project_id").distinct())
    assert [r.id for r in rest.collect()] == ["b"] and [r.triple_id for r in edges.collect()] == ["2"]


def test_streams(spark, tmp_path):
    rows = [(i, T0 + dt.timedelta(minutes=7 * i), i % 3, "x", 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.write.parquet(str(tmp_path / "events.parquet"))
    stream = events.read_events(spark, str(tmp_path))
    counts = events.run_to_table(events.window_counts(stream), "w")
    assert counts.agg(F.sum("n")).first()[0] == 60
    limited = events.run_to_table(events.limit_rate(stream), "l", "append").collect()
    for u in range(3):
        mine = sorted((r.event_id, r.allowed) for r in limited if r.user_id == u)
        assert [a for _, a in mine] == brute_limit([7 * 60 * i for i, _ in mine])


def test_chunks_and_spans(spark):
    body = "# Abstract\n" + "a" * 5000 + "\n# Methods\n" + "b" * 4000 + "\n# Results\n" + "c" * 100 + " The end is near."
    df = text.with_sections(spark.createDataFrame([(1, body, "Paper"), (2, "", "Paper"), (3, None, None)], "doc_id long, text string, source_type string"))
    rows = {r.doc_id: r for r in df.select("doc_id", text.chunks(F.col("sections")).alias("c"), text.chunk_sizes(F.col("sections")).alias("n"), text.text_span(F.lit("THE end"), F.col("text"), F.col("sections")).alias("s")).collect()}
    assert sorted(len(c.text) for c in rows[1].c) == sorted(rows[1].n) and sum(len(c.types) for c in rows[1].c) == 3
    assert [c.importance for c in rows[1].c] == sorted((c.importance for c in rows[1].c), reverse=True)
    s = rows[1].s
    assert (body[s.start : s.end], s.text, s.length, s.section) == ("The end", "The end", 7, "results")
    assert rows[2].c == [] and rows[2].s is None and rows[3].c == [] and rows[3].s is None


def test_rules_of_all_kinds(spark):
    rows = [("s", "dataset", '{"name": "A", "spatial": {"coverage": "x"}, "access": {"url": "u"}, "size": null}'), ("s", "claim", '{"statement": "b", "confidence": 0.4, "figureRef": 2}'), ("s", "floodEvent", '{"type": "flash"}'), ("s", "nothing", "{}"), ("s", "gauge", None), ("s", "gauge", "no json")]
    got = {r.type: r for r in mapping.map_all(spark.createDataFrame(rows, "source_id string, kind string, record string")).collect()}
    assert set(got) == {"Dataset", "Claim", "FloodEvent", "Gauge"} and len(mapping.RULES) == 59
    assert got["Dataset"].attributes == {"name": "A", "spatialCoverage": "x"} and got["Dataset"].metadata == {"accessUrl": "u"} and got["Dataset"].section == "datasets"
    assert got["Claim"].attributes == {"statement": "b", "confidence": "0.4"} and got["Claim"].metadata == {"figureRef": "2"} and got["Claim"].confidence == 0.4
    assert got["FloodEvent"].attributes == {"floodType": "flash"} and got["Gauge"].attributes == {} and got["Gauge"].confidence == 0.8


def test_triples_and_relations_of_a_source(spark):
    items = [("s", k, f"{k}1", n, None, e, u) for k, n, e, u in [("dataset", "D", None, []), ("method", "M", None, ["D", "X"]), ("model", "N", None, ["X"]), ("region", "R", None, []), ("experiment", "E", None, []), ("claim", "C", "seen", []), ("grade", "B", None, [])]]
    items += [("s", "claim", "claim2", "C2", 0.5, "", []), ("t", "region", "region2", "R", None, None, [])]
    df = spark.createDataFrame(items, "source_id string, kind string, id string, name string, confidence double, evidence string, uses array<string>")
    got = {(r.subject, r.predicate, r.object): r.confidence for r in decompose.source_triples(df).collect()}
    assert got == {
        ("s", "uses", "dataset1"): 0.8, ("s", "applies", "method1"): 0.8, ("s", "studies", "region1"): 0.8, ("t", "studies", "region2"): 0.8, ("s", "consists_of", "experiment1"): 0.8,
        ("claim1", "derives_from", "s"): 0.8, ("claim2", "derives_from", "s"): 0.5, ("s", "supports", "claim1"): 0.8, ("method1", "uses", "dataset1"): 0.9,
        ("model1", "trained_on", "dataset1"): 0.9, ("dataset1", "covers", "region1"): 0.7, ("s", "evaluated_by", "B"): 0.9,
    }
    assert decompose.source_triples(df.limit(0)).count() == 0
    types = spark.createDataFrame([("Dataset",), ("Basin",), ("Sensor",)], "name string")
    closure = ontology.type_closure(ontology.parent_table(spark), types)
    caps = spark.createDataFrame([("s", "d1", "Dataset"), ("s", "d2", "Dataset"), ("s", "q", "Sensor"), ("u", "d3", "Dataset")], "source_id string, id string, type string")
    worlds = spark.createDataFrame([("s", "b", "Basin")], "source_id string, id string, type string")
    stated = spark.createDataFrame([("s", "d2", "b"), ("u", "d1", "x")], "source_id string, subject string, object string")
    found = {(r.subject, r.predicate, r.confidence) for r in decompose.fallback_relations(caps, worlds, stated, closure, ontology.bridge_table(spark)).collect()}
    assert ("d1", "covers", 0.6) in found and not any(s in ("d2", "d3") for s, *_ in found) and ("q", "covers", 0.6) in found


def test_nodes_without_an_object_are_untraced(spark):
    nodes = spark.createDataFrame([("s", "n1", ["flow", "model"], False), ("s", "n2", ["other"], False), ("s", "n3", ["else"], True), ("s", "o2", ["none"], False)], "source_id string, node_id string, tokens array<string>, linked boolean")
    objects = spark.createDataFrame([("s", "o1", ["flow", "data"], True), ("s", "o2", ["soil"], False), ("t", "o3", ["other"], True)], "source_id string, name string, tokens array<string>, grounded boolean")
    traced = decompose.traceability(nodes, objects)
    assert {r.node_id: (r.object, r.level) for r in traced.collect()} == {"n1": ("o1", "traceable"), "n2": (None, "untraced"), "n3": (None, "weak"), "o2": ("o2", "weak")}
    s = decompose.traceability_score(traced).first()
    assert (s.nodes, s.traceable, s.weak, s.untraced, s.score, s.level) == (4, 1, 2, 1, 50, "weak")


def test_schemas(spark):
    types = spark.createDataFrame([("StreamReach",), ("Claim",), ("Gauge",), ("Preprint",), ("Strange",)], "name string")
    every = types.union(ontology.parent_table(spark).select("parent")).distinct()
    got = {r.name: (r.required, r.defaults) for r in ontology.merged_schemas(ontology.own_schemas(every)).collect()}
    assert got["Claim"] == (["statement"], {"confidence": "0.8"}) and got["Gauge"][0] == ["name", "stationId"] and got["Strange"] == (["name"], {})
    assert got["Preprint"] == (["identifier", "name", "title", "type"], {"server": "arXiv"}) and ontology.PARENTS["Benchmark"] == "Source" and "Intervention" not in ontology.PARENTS
    e = spark.createDataFrame([("Claim", '{"confidence": 1}'), ("Weird", None), ("Preprint", '{"title": null}')], "type string, attributes string")
    done = {r.type: r.completed for r in ontology.complete_attributes(e, ontology.merged_schemas(ontology.own_schemas(every))).collect()}
    assert done == {"Claim": {"confidence": "1", "statement": "No statement"}, "Weird": {"name": "Unnamed Weird"}, "Preprint": {"title": None, "identifier": "", "name": "Unnamed Preprint", "type": "unknown"}}


def test_wide_boxes_have_few_rows(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)] + [(300, None, 1.0)]
    boxes = [(0, -180.0, -90.0, 180.0, 90.0), (1, 0.0, 0.0, 0.0, 0.0), (2, 5.0, 5.0, 4.0, 9.0), (3, None, 0.0, 1.0, 1.0)]
    for k in range(4, 60):
        x, y, w = rng.uniform(-180, 170), rng.uniform(-90, 80), 10 ** rng.uniform(-1, 2.4)
        boxes.append((k, x, y, x + w, y + w * rng.random()))
    p = spark.createDataFrame(points, "i int, lon double, lat double")
    b = spark.createDataFrame(boxes, "k int, min_lon double, min_lat double, max_lon double, max_lat double")
    want = sorted((i, k) for i, x, y in points if x is not None for k, a, c, e, f in boxes if a is not None and a <= x <= e and c <= y <= f)
    assert sorted((r.i, r.k) for r in spatial.join_boxes(p, b).collect()) == want


LONG = "The gauge network shows that mean flow in the upper reach depends on snow in the early season of most years."


def test_objects_from_sections(spark):
    body = f"# Abstract\n{LONG} A global view.\n# Model setup\nignored\n# Methods\n{LONG} It has a second sentence.\n# Data\nSee https://a.example/d1, for {LONG}\n# Results\nShort start. This other sentence tells of turbidity, algae and nutrients that were sampled in ponds, lakes and ditches.\n"
    rows = [("a", "Paper", body, "Flow", None), ("b", "Paper", "too short", "x", LONG), ("c", None, None, None, None), ("d", "Paper", "z" * 200, None, LONG), ("e", "Paper", "# Abstract\n" + LONG + "\n# Results\n" + LONG, None, None)]
    df = spark.createDataFrame(rows, "source_id string, source_type string, text string, title string, abstract string")
    got = {(r.source_id, r.origin): r for r in decompose.text_objects(df).collect()}
    assert {k[1] for k in got if k[0] == "a"} == {"method", "data", "workflow", "claim", "scope", "evidence"}
    assert got["a", "method"].name == "Methods" and got["a", "method"].description == LONG and got["a", "data"].name == "https://a.example/d1"
    assert got["a", "workflow"].name == "Flow workflow" and got["a", "claim"].name == LONG and got["a", "evidence"].name.startswith("This other") and got["a", "scope"].confidence == 0.45
    assert {k for k in got if k[0] in "bcde"} == {("d", "claim"), ("e", "claim")}  # what the results say again is no further claim
    assert decompose.text_objects(df.limit(0)).count() == 0


def test_exports(spark):
    members = spark.createDataFrame([("p", "a", 0), ("p", "a", 1), ("p", "gone", 2), ("q", "b", 0), ("q", "a", 1)], "project_id string, id string, pos int")
    ents = spark.createDataFrame([("a", "Claim"), ("b", "Dataset"), ("c", "Evidence")], "id string, type string")
    trip = spark.createDataFrame([("a", "supports", "c"), ("c", "supports", "a"), ("b", "uses", "a")], "subject string, predicate string, object string")
    assert sorted((r.project_id, r.id) for r in state.export_entities(members, ents).collect()) == [("p", "a"), ("q", "a"), ("q", "b")]
    log = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["z"]), (3, None)], "event_id long, objects array<string>")
    assert sorted((r.project_id, r.event_id) for r in state.export_events(members, log).collect()) == [("p", 1), ("q", 1)]
    chains = state.export_chains(members, ents, trip)
    assert sorted(tuple(r) for r in chains.collect()) == [("p", "a", "a", 0), ("p", "a", "c", 1), ("q", "a", "a", 0), ("q", "a", "c", 1)]
