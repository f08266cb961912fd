import pytest

from basinweave.llm import sourcefiles as S

HAND_PY = 'def regrid(rows, step=None):\n    """Return the rows of one step."""\n    if step is None:\n        step = 4\n    return [x * step for x in rows]\n'
HAND_JS = "export function regrid(grid) {\n  // skip empty values\n  const out = [];\n  for (const x of grid) {\n    if (x) out.push(x * 36);\n  }\n  return out;\n}\n"
MINIFIED = "!function(){" + "".join(f"function a{i}(e,t){{return e.b?t[{i}]:void 0}}var c{i}={i * 7};" for i in range(20)) + "}();"
SERIAL = "".join(f'_F_{i:04d} = _d.Field(name="x", index={i}, number={i + 1})\n' for i in range(12))
PAYLOAD = "PAYLOAD = (\n" + "".join(f'    b"{"aG9Kx3" * 12}{i}"\n' for i in range(8)) + ")\n"


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        (HAND_PY, None),
        (HAND_JS, None),
        (None, None),
        ("", None),
        ("// minified copies are built by the release job\n" + HAND_JS, None),
        ("# NOTE: edit by hand, nothing here is produced automatically\n" + HAND_PY, None),
        ("# The report is generated by make_report().\n" + HAND_PY, None),
        ("// Copyright (c) 2024 my-tool. MIT licence.\n" + HAND_JS, None),
        ("/*!\n * my-tool v2.0 | (c) 2020 the my-tool contributors | MIT\n */\n" + HAND_JS, None),
        (HAND_PY + 'USAGE = "' + "grid step mask " * 30 + '"\n', None),
        ('CLASSES = ["a", "b"]\n\n' + HAND_PY, None),
        ("/*!\n * leaflink v3.1 | (c) 2016 the leaflink contributors | MIT licence\n */\n" + HAND_JS, "vendored"),
        ("/*!\n * @license geozip 1.2\n */\n" + HAND_JS, "vendored"),
        ("# Code generated by gridgen 0.24. DO NOT EDIT.\n" + HAND_PY, "generated"),
        ("# Automatisch erzeugt, nicht bearbeiten\n" + HAND_PY, "generated"),
        ("HEAD = '# Code generated by gridgen. DO NOT EDIT.'\n" + HAND_PY, None),
        ("const HEAD = '// Code generated by gridgen. DO NOT EDIT.';\n" + HAND_JS, None),
        ('"""Autogenerated bindings, see tools/bind.cfg"""\n' + HAND_PY, "generated"),
        (SERIAL, "generated"),
        (MINIFIED, "minified"),
        ("/* app */\n" + MINIFIED + "\n//# sourceMappingURL=app.map\n", "minified"),
        ("MASK = [\n" + ", ".join(f"0.{i:04d}" for i in range(200)) + "]\n", "data"),
        (PAYLOAD, "data"),
        ('const a = "' + "aGVsbG8rd29ybGQ/" * 60 + '";\n', "data"),
        ("STATIONS = [" + ", ".join(f'{{"id": {i}, "lon": {i}.5}}' for i in range(40)) + "]\n", "data"),
        (HAND_PY * 2000, None),
    ],
)
def test_content(text, kind):
    assert S.content_kind(text, {"me", "my-tool"}) == kind


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("# licence text\n" * 40 + "\n# Code generated by gridgen 0.24. DO NOT EDIT.\n" + HAND_PY, "generated"),
        ("/*\n" + "   licence text\n" * 40 + "   Code generated by gridgen. DO NOT EDIT.\n*/\n" + HAND_JS, "generated"),
        ("// licence text of some length, all rights kept\n" * 200 + "// @license geozip 1.2\n" + HAND_JS, "vendored"),
        ("/* licence text */\n" * 20 + HAND_JS + "// Code generated by gridgen. DO NOT EDIT.\n", None),
        ("/* a */\n" * 20 + 'const a = 1; /* b */\nconst s = "Code generated by gridgen";\n' + HAND_JS, None),
    ],
)
def test_long_headers(text, kind):
    assert S.content_kind(text, {"me", "my-tool"}) == kind


def test_attribute_precedence():
    files = {
        ".gitattributes": "lib/** linguist-vendored\n*.gen.py linguist-generated=true\n# *.py linguist-generated\n",
        "lib/own/.gitattributes": "* -linguist-vendored\ncopy.js linguist-vendored\n",
        "a/.gitattributes": "/b/*.js linguist-generated\nx[0-9].py linguist-generated=false\n",
    }
    rules = S.attribute_rules(files)
    want = {
        "lib/x.js": True, "lib/own/x.js": False, "lib/own/copy.js": True, "src/t.gen.py": True, "src/t.py": None, "a/b/c.js": True, "b/c.js": None,
        "a/b/d/c.js": None, "a/q/x3.py": False,
    }
    assert {p: S.declared(p, rules) for p in want} == want


def test_files(spark):
    tree = ["src/a.py", "src/b.js", "vendor/x/i.js", "a\\node_modules\\y.js", "src/vendors.py", "app.min.js", "README.md", "z_pb2.py", None, "src/gen.py"]
    keys = {"src/a.py": HAND_PY, "src/b.js": MINIFIED, ".gitattributes": "src/gen.py linguist-generated\nvendor/** -linguist-vendored\n"}
    rows = [("o/r", tree, keys, 1), ("o/r", tree, keys, 1), ("o/s", None, keys, 1), (None, tree, keys, 1), ("o/t", ["lib/q.js"], None, 1)]
    banner = "/*!\n * @license quux 1.2\n */\n" + HAND_JS
    rows += [(f"m/{i}", ["lib/quux.js"], {"lib/quux.js": banner}, 1) for i in range(6)] + [("m/last", ["js/quux.js", "js/other.js"], {}, 1)]
    df = spark.createDataFrame(rows, "full_name string, tree array<string>, key_files map<string,string>, path int")
    got = {tuple(r) for r in S.found_files(df).collect()}
    want = {("o/r", p) for p in ("src/b.js", "a\\node_modules\\y.js", "app.min.js", "z_pb2.py", "src/gen.py")}
    assert got == want | {(f"m/{i}", "lib/quux.js") for i in range(6)} | {("m/last", "js/quux.js")}
    assert S.found_files(df.limit(0)).count() == 0


def test_declared_and_undeclared_repositories_meet(spark):
    """Patterns mined from repositories that declare files mark the files of those that declare nothing."""
    attributes = "bindings/** linguist-generated\n*-stub.py linguist-generated=true\nlib/quux.js linguist-vendored\nlib/own.js -linguist-vendored\n"
    trees = [[f"bindings/a{i}.py", "src/b-stub.py", "lib/quux.js", "lib/own.js", "src/hand.py"] for i in range(5)]
    rows = [(f"d/{i}", tree, {".gitattributes": attributes, "src/hand.py": HAND_PY}) for i, tree in enumerate(trees)]
    rows += [("u/one", ["x/bindings/deep/c.js", "core/z-stub.py", "static/quux-1.2.js", "lib/new.js", "src/z.py"], None)]
    rows += [("u/two", ["lib/own.js", "lib/two.js"], {"lib/own.js": HAND_JS})]
    df = spark.createDataFrame(rows, "full_name string, tree array<string>, key_files map<string,string>")
    got = {(r.full_name, r.path): r.kind for r in S.file_kinds(df).collect() if r.kind}
    want = {(f"d/{i}", p): "declared" for i in range(5) for p in trees[i][:3]} | {("u/one", p): "mined" for p in ("x/bindings/deep/c.js", "core/z-stub.py", "static/quux-1.2.js")}
    assert got == want
    few = {(r.full_name, r.path) for r in S.found_files(df.where("full_name != 'd/0'")).collect()}
    assert not {k for k in few if k[0].startswith("u/")}
