"""Flattening of deeply nested records by interval labels.

``label_nodes`` walks every JSON document depth first and gives each node of interest the pre-order number at which it is
entered and the post-order number at which it is left (one counter for both). Node ``a`` encloses node ``b`` exactly when
``a.pre < b.pre and b.post < a.post``. ``link_nodes`` turns the labels into parent-child rows: walking a document's nodes by
``pre``, the nearest enclosing node of the parent type is the last one entered, provided its interval is still open, so one
window pass (a sort of the document's nodes) replaces the quadratic containment join.

Defined cases
    * null or unreadable text gives no node, as does a JSON value that is not an object;
    * text that holds a JSON object or array stands for that value, at any depth, also several times encoded;
    * a lone value stands for an array of one; nulls give no node but keep their position;
    * a record without a text id gives the empty id; numbers are rendered as JSON text;
    * empty tables give empty results with the same schema; clashing extra columns are dropped on entry.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE_SCHEMA = "record_id string, node_type string, parent_type string, pre long, post long, item_path string, item_id string"


@dataclass(frozen=True)
class ArraySpec:
    """An array inside a record: ``steps`` are the keys from the enclosing record to it, ``children`` its own arrays."""

    node_type: str
    steps: tuple[str, ...]
    children: tuple[ArraySpec, ...] = field(default=())


PROJECT_ARRAYS = (
    ArraySpec("project_source", ("projectRecomposition", "sources"), (ArraySpec("key_point", ("brief", "keyPoints")),)),
    ArraySpec(
        "map_source",
        ("mapRecomposition", "sources"),
        (
            ArraySpec("anchor", ("anchors",)),
            ArraySpec("result", ("results",), (ArraySpec("evidence", ("evidence",)),)),
            ArraySpec("attachment", ("attachments",)),
        ),
    ),
)


def _value(x):
    """The value that ``x`` stands for: text which holds a JSON object or array is read, as often as it was encoded."""
    while isinstance(x, str):
        text = x.strip()
        if not text or text[0] not in '{["' and text != "null":
            return x
        try:
            read = json.loads(text)
        except (ValueError, RecursionError):
            return x
        if not isinstance(read, (dict, list, str)) and read is not None:
            return x
        x = read
    return x


def _node_id(x) -> str:
    if not isinstance(x, dict) or x.get("id") is None:
        return ""
    return x["id"] if isinstance(x["id"], str) else json.dumps(x["id"])


def walk_record(text: str | None, specs: tuple[ArraySpec, ...]) -> list[tuple]:
    """(node_type, parent_type, pre, post, path, id) of each array element of one document, in pre-order."""
    if text is None:
        return []
    try:
        root = _value(json.loads(text))
    except (ValueError, RecursionError):
        return []
    if not isinstance(root, dict):
        return []
    out: list[tuple] = []
    clock = 0
    # An explicit stack: deep documents must not end the walk. Items are ("open", ...) or ("close", index into out).
    stack: list[tuple] = [("arrays", root, specs, "", "")]
    while stack:
        what, *rest = stack.pop()
        if what == "close":
            clock += 1
            out[rest[0]][3] = clock
            continue
        if what == "arrays":
            record, arrays, path, parent_type = rest
            for spec in reversed(arrays):
                value = record
                for step in spec.steps:
                    value = _value(value.get(step)) if isinstance(value, dict) else None
                if value is None:
                    continue
                items = value if isinstance(value, list) else [value]
                prefix = f"{path}." if path else ""
                base = prefix + ".".join(spec.steps)
                for i in range(len(items) - 1, -1, -1):
                    stack.append(("open", items[i], spec, f"{base}[{i}]", parent_type))
            continue
        item, spec, path, parent_type = rest
        item = _value(item)
        if item is None:
            continue
        clock += 1
        out.append([spec.node_type, parent_type, clock, 0, path, _node_id(item)])
        stack.append(("close", len(out) - 1))
        if isinstance(item, dict) and spec.children:
            stack.append(("arrays", item, spec.children, path, spec.node_type))
    return [tuple(x) for x in out]


def label_nodes(records: DataFrame, id_col: str, json_col: str, specs: tuple[ArraySpec, ...] = PROJECT_ARRAYS) -> DataFrame:
    """Node table with interval labels of all documents; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["record_id", "node_type", "parent_type", "pre", "post", "item_path", "item_id"]
        for pdf in batches:
            rows = [(key, *node) for key, text in zip(pdf["k"], pdf["v"]) for node in walk_record(text, specs)]
            yield pd.DataFrame(rows, columns=columns)

    return records.select(F.col(id_col).alias("k"), F.col(json_col).alias("v")).mapInPandas(run, NODE_SCHEMA)


def link_nodes(nodes: DataFrame, parent_types: dict[str, str]) -> DataFrame:
    """Adds ``parent_pre`` and ``parent_path`` by interval containment; '' and null for nodes without an enclosing node."""
    by_pre = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    mark = F.struct("pre", "post", F.col("item_path").alias("path"))
    open_parent: Column | None = None
    for child, parent in parent_types.items():
        last = F.last(F.when(F.col("node_type") == parent, mark), ignorenulls=True).over(by_pre)
        chosen = F.when(F.col("node_type") == child, last)
        open_parent = chosen if open_parent is None else F.coalesce(open_parent, chosen)
    if open_parent is None:
        open_parent = F.lit(None).cast("struct<pre:bigint,post:bigint,path:string>")
    linked = nodes.withColumn("_p", open_parent)
    inside = F.col("_p.post") > F.col("post")
    return linked.select(
        *nodes.columns,
        F.when(inside, F.col("_p.pre")).alias("parent_pre"),
        F.coalesce(F.when(inside, F.col("_p.path")), F.lit("")).alias("parent_path"),
    )


def parent_types(specs: tuple[ArraySpec, ...]) -> dict[str, str]:
    """node type -> enclosing node type, for all but the outermost arrays."""
    out: dict[str, str] = {}
    for spec in specs:
        for child in spec.children:
            out[child.node_type] = spec.node_type
        out |= parent_types(spec.children)
    return out


def latest_rows(df: DataFrame, key: str, time_col: str, *values: str) -> DataFrame:
    """The row with the latest time of each key; equal times are settled by the largest values, so the result is stable."""
    best = F.max(F.struct(F.col(time_col), *[F.col(v) for v in values])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(best).select(key, *[f"_best.{c}" for c in (time_col, *values)])


def flatten_projects(projects: DataFrame, specs: tuple[ArraySpec, ...] = PROJECT_ARRAYS) -> DataFrame:
    """Flat, linked rows of the nested arrays of each project's latest metadata."""
    current = latest_rows(projects.select("id", "updated_at", "metadata"), "id", "updated_at", "metadata")
    return link_nodes(label_nodes(current, "id", "metadata", specs), parent_types(specs))
