"""Repositories: roles of files, key files, dependencies and a grade from static checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles of files by their exact name.
EXACT: dict[str, tuple[str, int]] = {
    "requirements.txt": ("dependency_manifest", 5), "setup.py": ("package_manifest", 5), "pyproject.toml": ("package_manifest", 5), "package.json": ("package_manifest", 5),
    "environment.yml": ("environment_manifest", 5), "environment.yaml": ("environment_manifest", 5), "dockerfile": ("container_manifest", 5), "citation.cff": ("citation_metadata", 5),
    "codemeta.json": ("citation_metadata", 5), "config.yaml": ("configuration", 4), "config.yml": ("configuration", 4), "config.json": ("configuration", 4), "main.py": ("entrypoint", 4),
    "train.py": ("entrypoint", 4), "run.py": ("entrypoint", 4), "model.py": ("entrypoint", 4), "readme.md": ("readme", 1),
}
_DATA, _DOCS, _EXAMPLES = ("data", "dataset", "datasets"), ("docs", "doc", "documentation"), ("example", "examples", "demo", "demos", "notebooks")


def file_role(path: Column) -> Column:
    """(role, score) of a file by its directories and name; null for other files."""
    clean = F.lower(F.regexp_replace(path, r"\\", "/"))
    parts = F.filter(F.transform(F.split(clean, "/"), lambda x: F.trim(x)), lambda x: x != "")
    name = F.try_element_at(parts, F.lit(-1))
    parents = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    ext = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    inside = lambda names: F.arrays_overlap(parents, F.array(*map(F.lit, names)))
    role = lambda r, s: F.struct(F.lit(r).alias("role"), F.lit(s).alias("score"))
    exact = F.create_map(*[x for n, (r, s) in EXACT.items() for x in (F.lit(n), role(r, s))])
    return (
        F.when(inside(_DATA) & ext.isin(".md", ".rst", ".txt", ".json", ".yaml", ".yml"), role("data_descriptor", 4))
        .when(inside(_EXAMPLES) & ext.isin(".py", ".js", ".ts", ".sh", ".r"), role("example_entrypoint", 3))
        .when(inside(_DOCS) & ext.isin(".md", ".rst", ".txt"), role("documentation", 3))
        .otherwise(F.coalesce(F.try_element_at(exact, name), F.when(ext.isin(".md", ".rst", ".txt"), role("documentation", 2))))
    )


def classified_files(repositories: DataFrame) -> DataFrame:
    """(full_name, path, role, score) of all files that have a role."""
    each = repositories.select("full_name", F.explode("tree").alias("path")).where("path is not null").distinct()
    return each.withColumn("_r", file_role(F.col("path"))).where("_r is not null").select("full_name", "path", "_r.role", "_r.score")


def key_files(files: DataFrame, limit: int = 8) -> DataFrame:
    """The ``limit`` most telling files of each repository, readmes left out."""
    order = Window.partitionBy("full_name").orderBy(F.desc("score"), "path")
    return files.where("role != 'readme'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def dependencies(repositories: DataFrame) -> DataFrame:
    """(full_name, dependency) of requirement and package files, in lower case."""
    each = repositories.select("full_name", F.explode("key_files").alias("path", "content")).where("content is not null")
    name = F.regexp_extract(F.lower("path"), r"([^/\\]+)$", 1)
    lines = F.split("content", r"\r?\n")
    req = F.transform(
        F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("-")), lambda x: F.regexp_extract(x, r"^([A-Za-z0-9_.-]+)", 1)
    )
    keys = lambda p: F.coalesce(F.json_object_keys(F.get_json_object("content", p)), F.array().cast("array<string>"))
    toml = F.transform(lines, lambda x: F.regexp_extract(x, r"^\s*\"?([A-Za-z0-9_.-]+)\"?\s*[=><~!]", 1))
    found = F.when(name == "requirements.txt", req).when(name == "package.json", F.concat(keys("$.dependencies"), keys("$.devDependencies"))).when(name == "pyproject.toml", toml)
    return each.select("full_name", F.explode(found).alias("d")).where("d != ''").select("full_name", F.lower("d").alias("dependency")).distinct()


def review(repositories: DataFrame) -> DataFrame:
    """Seven static checks and the grade (A to E) of each repository."""
    roles = classified_files(repositories).groupBy("full_name").agg(F.collect_set("role").alias("roles"))
    names = repositories.groupBy("full_name").agg(
        F.max(F.coalesce(F.col("readme") != "", F.lit(False))).alias("readme_text"),
        F.max(F.coalesce(F.col("license") != "", F.lit(False))).alias("license_text"),
        F.max(F.coalesce(F.exists("tree", lambda p: F.lower(p).rlike(r"(^|[/\\])licen[cs]e(\.md|\.txt)?$")), F.lit(False))).alias("license_file"),
        F.max(F.coalesce(F.exists("tree", lambda p: F.lower(p).endswith(".ipynb")), F.lit(False))).alias("notebook"),
        F.max(F.coalesce(F.lower("readme").rlike("(python |node |npm (run|install)|pip install|docker run|make )"), F.lit(False))).alias("run"),
    )
    rows = names.join(roles, "full_name", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    has = lambda *r: F.arrays_overlap("roles", F.array(*map(F.lit, r)))
    checks = {
        "c_readme": F.col("readme_text") | has("readme"), "c_license": F.col("license_text") | F.col("license_file"),
        "c_dependencies": has("dependency_manifest", "package_manifest", "environment_manifest"), "c_script": F.col("notebook") | has("entrypoint", "example_entrypoint"),
        "c_data": has("data_descriptor"), "c_docker": has("container_manifest"), "c_run": F.col("run"),
    }
    rows = rows.select("full_name", *[c.alias(k) for k, c in checks.items()])
    passed = sum((F.col(k).cast("int") for k in checks), F.lit(0))
    rows = rows.withColumn("passed", passed)
    c = F.col
    grade = (
        F.when(c("c_readme") & c("c_license") & c("c_dependencies") & c("c_script") & c("c_run") & (c("passed") >= 6), "A")
        .when(c("c_readme") & c("c_script") & (c("c_dependencies") | c("c_run")) & (c("passed") >= 4), "B")
        .when(c("c_readme") & (c("c_script") | c("c_dependencies")) & (c("passed") >= 3), "C")
        .when(c("c_readme") | (c("passed") >= 1), "D")
        .otherwise("E")
    )
    return rows.withColumn("grade", grade)
