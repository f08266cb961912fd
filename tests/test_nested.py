import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from basinweave.operators import nested as N


def meta(**k):
    return json.dumps(k)


FULL = {
    "projectRecomposition": {"sources": [{"id": "s1", "brief": {"keyPoints": [{"id": "k1"}, None, "plain"]}}, None, "text"]},
    "mapRecomposition": {
        "sources": {"id": "m1", "anchors": {"id": "a1"}, "results": [{"id": "r1", "evidence": [{"id": "e1"}, {"q": 1}]}, {"evidence": {"id": "e2"}}], "attachments": '[{"id": "t1", "evidence": {"id": "no"}}]'}
    },
}
WANT = {
    ("", "projectRecomposition.sources[0]", "s1"), ("projectRecomposition.sources[0]", "projectRecomposition.sources[0].brief.keyPoints[0]", "k1"),
    ("projectRecomposition.sources[0]", "projectRecomposition.sources[0].brief.keyPoints[2]", ""), ("", "projectRecomposition.sources[2]", ""), ("", "mapRecomposition.sources[0]", "m1"),
    ("mapRecomposition.sources[0]", "mapRecomposition.sources[0].anchors[0]", "a1"), ("mapRecomposition.sources[0]", "mapRecomposition.sources[0].results[0]", "r1"),
    ("mapRecomposition.sources[0].results[0]", "mapRecomposition.sources[0].results[0].evidence[0]", "e1"),
    ("mapRecomposition.sources[0].results[0]", "mapRecomposition.sources[0].results[0].evidence[1]", ""), ("mapRecomposition.sources[0]", "mapRecomposition.sources[0].results[1]", ""),
    ("mapRecomposition.sources[0].results[1]", "mapRecomposition.sources[0].results[1].evidence[0]", "e2"), ("mapRecomposition.sources[0]", "mapRecomposition.sources[0].attachments[0]", "t1"),
}


def rows(spark, data):
    df = spark.createDataFrame(data, "id string, updated_at timestamp, metadata string, item_id string")
    return {(r.record_id, r.parent_path, r.item_path, r.item_id) for r in N.flatten_projects(df).collect()}


def test_forms(spark):
    import datetime as dt

    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)
    once, twice = json.dumps(FULL), json.dumps(json.dumps(FULL))
    data = [
        ("a", t1, once, "x"), ("a", t0, meta(projectRecomposition={"sources": [1, 2]}), "x"), ("b", t1, twice, "x"), ("b", t1, twice, "x"), ("c", t1, once[:-30], "x"),
        ("d", t1, None, "x"), ("e", t1, "null", "x"), ("f", t1, "[1]", "x"), ("g", t1, "", "x"), (None, t1, once, "x"), ("h", None, meta(mapRecomposition="none"), "x"),
    ]
    assert rows(spark, data) == {(k, *w) for k in "ab" for w in WANT}
    assert rows(spark, data[:0]) == set()


def test_long_arrays_and_depth(spark):
    big = meta(mapRecomposition={"sources": [{"id": str(i), "results": [{"id": f"{i}-{j}", "evidence": ["q"] * 3} for j in range(20)]} for i in range(40)]})
    got = rows(spark, [("p", None, big, "x"), ("q", None, "[" * 100000, "x")])
    assert len(got) == 40 + 800 + 2400
    assert all(path.startswith(parent) for _, parent, path, _ in got)


NODE = st.recursive(st.none() | st.text("ab", max_size=3) | st.integers(0, 3), lambda c: st.lists(c, max_size=3), max_leaves=5)


def brute(record, specs, path=""):
    out = []
    for spec in specs:
        v = record
        for s in spec.steps:
            v = N._value(v.get(s)) if isinstance(v, dict) else None
        if v is None:
            continue
        for i, x in enumerate(v if isinstance(v, list) else [v]):
            x = N._value(x)
            if x is None:
                continue
            p = f"{path + '.' if path else ''}{'.'.join(spec.steps)}[{i}]"
            out.append((path, p))
            if isinstance(x, dict):
                out += brute(x, spec.children, p)
    return out


def test_intervals_link_like_recursion(spark):
    rng = random.Random(2)

    def item(spec):
        if rng.random() < 0.2:
            return rng.choice([None, "x", 3])
        out = {"id": str(rng.random())}
        for c in spec.children:
            value = [item(c) for _ in range(rng.randint(0, 3))]
            for s in reversed(c.steps):
                value = {s: value}
            out |= value
        return out

    docs = []
    for k in range(30):
        doc = {}
        for spec in N.PROJECT_ARRAYS:
            doc[spec.steps[0]] = {spec.steps[1]: [item(spec) for _ in range(rng.randint(0, 4))]}
        docs.append((f"d{k}", None, json.dumps(doc), "x"))
    want = {(k, a, b) for k, _, m, _ in docs for a, b in brute(json.loads(m), N.PROJECT_ARRAYS)}
    assert {(k, a, b) for k, a, b, _ in rows(spark, docs)} == want


@settings(max_examples=50, deadline=None)
@given(NODE)
def test_labels_nest(value):
    nodes = N.walk_record(json.dumps({"mapRecomposition": {"sources": value}}), N.PROJECT_ARRAYS)
    marks = sorted(x for n in nodes for x in (n[2], n[3]))
    assert marks == list(range(1, len(marks) + 1))
