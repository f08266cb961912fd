"""Registries: views, readers and vocabulary extensions by name, and what the roles of a source activate of the vocabulary."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Relations that some types may have.
ALLOWED_RELATIONS: dict[str, tuple[str, ...]] = {
    "Paper": ("uses", "applies", "references", "studies", "proposes", "has_figure", "cited_by", "produces", "cites"),
    "Repository": ("uses", "implements", "depends_on", "produces", "references", "depends_on_software"),
    "Dataset": ("covers", "has_variable", "subset_of", "derived_from_data", "used_by", "references"),
    "Model": ("uses", "applies", "implements", "trained_on", "produces", "evaluated_by", "validated_on", "simulates"),
    "Claim": ("supports", "contradicts", "derives_from", "refines", "evaluated_by", "based_on", "supports_claim"),
    "Method": ("uses", "applies", "implements", "produces", "evaluated_by", "compares", "refines", "based_on"),
    "Workflow": ("uses", "applies", "implements", "consists_of", "executes", "depends_on", "depends_on_software", "runs_on"),
    "Sensor": ("observes", "part_of_network", "has_coverage"),
    "Gauge": ("observes", "measures", "part_of_network", "drains_to"),
    "Basin": ("drains_to", "upstream_of", "downstream_of", "part_of_system", "flows_through", "discharges_to"),
    "Region": ("contains", "adjacent_to", "drains_to", "part_of_system"),
    "FloodEvent": ("triggers_hazard", "affects", "located_at", "occurs_at", "causes", "caused_by"),
    "Hazard": ("exposed_to", "vulnerable_to", "generates_risk", "mitigates_hazard", "triggers_hazard"),
    "Risk": ("exposed_to", "vulnerable_to", "generates_risk", "mitigates_hazard", "reduces_risk"),
    "HydrologicalModel": ("uses", "forecasts", "calibrates_with", "evaluated_by", "outperforms", "models_basin", "simulates"),
    "River": ("drains_to", "upstream_of", "downstream_of", "flows_through", "discharges_to"),
    "GaugeStation": ("measures", "drains_to", "studies", "observes", "measured_at"),
}


class Registry:
    """Named functions, in order of registration."""

    def __init__(self) -> None:
        self._items: dict[str, Callable] = {}

    def register(self, name: str, item: Callable) -> None:
        if not name or not callable(item):
            raise ValueError("a name and a function are needed")
        self._items[name] = item

    def unregister(self, name: str) -> bool:
        return self._items.pop(name, None) is not None

    def get(self, name: str) -> Callable | None:
        return self._items.get(name)

    def has(self, name: str) -> bool:
        return name in self._items

    def names(self) -> list[str]:
        return list(self._items)

    def run(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self._items:
            raise KeyError(name)
        return self._items[name](*args, **kwargs)

    def run_all(self, *args, **kwargs) -> dict[str, DataFrame | Exception]:
        """Results of all functions; one that fails gives its error and doesn't stop the others."""
        out: dict[str, DataFrame | Exception] = {}
        for name, f in self._items.items():
            try:
                out[name] = f(*args, **kwargs)
            except Exception as e:  # noqa: BLE001
                out[name] = e
        return out


class Extensions:
    """Vocabulary extensions: namespaced types and relations put after the layers."""

    def __init__(self) -> None:
        self._all: dict[str, dict] = {}

    def register(self, name: str, types: dict[str, str], relations: list[str] = ()) -> None:
        if not name or not name.replace("-", "").replace("_", "").isalnum():
            raise ValueError("an extension needs a plain name")
        if not types and not relations:
            raise ValueError("an extension needs types or relations")
        self._all[name] = {"types": dict(types), "relations": list(relations)}

    def unregister(self, name: str) -> bool:
        return self._all.pop(name, None) is not None

    def provider_of(self, type_: str) -> str | None:
        return next((n for n, x in self._all.items() if type_ in x["types"]), None)

    def to_json(self) -> str:
        return json.dumps(self._all, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Extensions:
        out = cls()
        for n, x in json.loads(text).items():
            out.register(n, x["types"], x["relations"])
        return out

    def extend_types(self, types: DataFrame) -> DataFrame:
        """Type table with the extensions' types; types that a layer has stay as they are."""
        rows = [(t, "extension", 6, c) for x in self._all.values() for t, c in x["types"].items()]
        if not rows:
            return types
        more = types.sparkSession.createDataFrame(rows, "name string, layer string, layer_rank int, category string")
        return types.select("name", "layer", "layer_rank", "category").unionByName(more.join(types, "name", "left_anti").select("name", "layer", "layer_rank", "category"))


def allowed_relations(type_: Column) -> Column:
    """Relations that a type may have, as an array; empty for other types."""
    table = F.create_map(*[x for t, r in ALLOWED_RELATIONS.items() for x in (F.lit(t), F.array(*map(F.lit, r)))])
    return F.coalesce(F.try_element_at(table, type_), F.array().cast("array<string>"))


def activated_types(sources: DataFrame, types: DataFrame) -> DataFrame:
    """(source_id, name, layer, category, primary): types of the layers that a source activates (arrays layers, categories).

    Types of an activated category are primary; types are a fixed table and are broadcast.
    """
    layer = sources.select("source_id", "categories", F.explode("layers").alias("layer"))
    hit = layer.join(F.broadcast(types.select("name", "layer", "category")), "layer")
    return hit.select("source_id", "name", "layer", "category", F.coalesce(F.array_contains("categories", F.col("category")), F.lit(False)).alias("primary"))


def relation_stats(spark: SparkSession) -> DataFrame:
    """Registered relations per layer."""
    from basinweave.operators.ontology import relation_table

    return relation_table(spark).groupBy("layer").agg(F.count("*").alias("relations"))
