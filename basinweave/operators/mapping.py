"""Rules that turn records into entity attributes, and JSON helpers for texts that models write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fields = tuple[str | tuple[str, str], ...]

# By kind of record, the type, the section that it is taken from, the fields that become attributes and those that become
# metadata; a pair is a path in the record and another name. Further kinds are added by ``register``.
RULES: dict[str, tuple[str, str, Fields, Fields]] = {
    "source": ("Source", "header", ("identifier", "type", "title"), (("url", "sourceUrl"),)),
    "paper": ("Paper", "metadata", ("title", "doi", "abstract", "year", "venue", "citationCount", "authors"), (("url", "source"), "keywords")),
    "repository": ("Repository", "metadata", ("name", "repo", "language", "stars", "license", "description"), (("url", "source"), "readme", "dependencies")),
    "datasetPage": ("DatasetPage", "metadata", ("name", "title", "url", "variables", "spatialCoverage", "temporalCoverage"), ("accessUrl", "format")),
    "report": ("Report", "metadata", ("title", "institution", "year", ("type", "reportType")), (("url", "source"),)),
    "dataset": ("Dataset", "datasets", ("name", "acronym", "variables", ("spatial.coverage", "spatialCoverage"), ("spatial.resolution", "spatialResolution"), ("temporal.coverage", "temporalCoverage"), ("temporal.resolution", "temporalResolution"), "size", "role"), (("access.url", "accessUrl"), ("access.license", "license"), "confidence")),
    "variable": ("Variable", "variables", ("name", "unit", "description", "range"), ("confidence",)),
    "coverage": ("Coverage", "data", ("spatial", "temporal", "resolution"), ()),
    "sensor": ("Sensor", "methods", ("name", "type", "platform", "resolution"), ()),
    "satellite": ("Satellite", "methods", ("name", "sensors", "resolution", "revisitTime"), ()),
    "gauge": ("Gauge", "methods", ("name", "stationId", "river", "location"), ()),
    "station": ("Station", "methods", ("name", ("id", "stationId"), ("type", "stationType"), "location"), ()),
    "model": ("Model", "methods", ("name", "type", "architecture", "framework", "hyperparameters"), ("innovation", "description")),
    "algorithm": ("Algorithm", "methods", ("name", "category", "purpose"), ()),
    "simulation": ("Simulation", "methods", ("name", "model", "parameters", "duration"), ()),
    "calibration": ("Calibration", "methods", ("method", ("parameters", "calibratedParams"), "performance"), ()),
    "validation": ("Validation", "methods", ("method", "metrics", ("dataset", "validationDataset")), ()),
    "software": ("Software", "dependencies", ("name", "version", "language"), ()),
    "api": ("API", "metadata", ("name", "endpoint", "description"), ()),
    "workflow": ("Workflow", "methods", ("name", "steps", "purpose"), ("dependencies",)),
    "pipeline": ("Pipeline", "methods", ("name", "stages", "input", "output"), ()),
    "policy": ("Policy", "text", ("name", "jurisdiction", "effectiveDate", "status"), ()),
    "regulation": ("Regulation", "text", ("name", "jurisdiction", "authority", "requirements"), ()),
    "institution": ("Institution", "metadata", ("name", "type", "jurisdiction"), ()),
    "populationDataset": ("PopulationDataset", "data", ("name", "source", "resolution"), ()),
    "exposureDataset": ("ExposureDataset", "data", ("name", "type", "coverage"), ()),
    "vulnerabilityIndex": ("VulnerabilityIndex", "results", ("name", "value", "factors"), ()),
    "assessment": ("Assessment", "results", ("name", "type", "scope", "confidence"), ()),
    "indicator": ("Indicator", "results", ("name", "value", "unit", "trend"), ()),
    "intervention": ("Intervention", "discussion", ("name", "type", "target", "status"), ()),
    "adaptationMeasure": ("AdaptationMeasure", "discussion", ("name", "type", "target"), ()),
    "mitigationMeasure": ("MitigationMeasure", "discussion", ("name", "type", "effect"), ()),
    "emergencyResponse": ("EmergencyResponse", "text", ("name", "trigger", "actions"), ()),
    "region": ("Region", "spatial", ("name", "bbox", "geometry", "area", ("type", "regionType")), ()),
    "basin": ("Basin", "spatial", ("name", "bbox", "geometry", "area"), ()),
    "watershed": ("Watershed", "spatial", ("name", "bbox", "area"), ()),
    "glacier": ("Glacier", "spatial", ("name", "location", "area"), ()),
    "lake": ("Lake", "spatial", ("name", "location", "area"), ()),
    "aquifer": ("Aquifer", "spatial", ("name", "location", ("type", "aquiferType")), ()),
    "river": ("River", "spatial", ("name", "length", "basin"), ()),
    "earthVariable": ("EarthVariable", "variables", ("name", "unit", "range", "temporalResolution"), ()),
    "streamflow": ("Streamflow", "variables", ("name", "unit", "gauge"), ()),
    "precipitation": ("Precipitation", "variables", ("name", "unit", ("type", "precipType")), ()),
    "temperature": ("Temperature", "variables", ("name", "unit", ("type", "tempType")), ()),
    "hazard": ("Hazard", "text", ("name", "type", "magnitude", "probability", "location", "date"), ()),
    "floodEvent": ("FloodEvent", "text", ("name", ("type", "floodType"), "magnitude", "location", "date"), ()),
    "droughtEvent": ("DroughtEvent", "text", ("name", "severity", "location", "duration"), ()),
    "heatwave": ("Heatwave", "text", ("name", "intensity", "duration", "location"), ()),
    "wildfire": ("Wildfire", "text", ("name", "location", "area", "date"), ()),
    "earthRisk": ("EarthRisk", "results", ("name", "type", "likelihood", "impact", "exposure"), ()),
    "floodRisk": ("FloodRisk", "results", ("name", "location", "probability", "impact"), ()),
    "droughtRisk": ("DroughtRisk", "results", ("name", "location", "probability"), ()),
    "forecast": ("Forecast", "results", ("name", "variable", "leadTime", "resolution", "skill"), ()),
    "projection": ("Projection", "results", ("name", "scenario", "timeHorizon", "variable"), ()),
    "claim": ("Claim", "claims", ("statement", "confidence", "type"), ("evidence", "figureRef")),
    "evidence": ("Evidence", "results", ("type", "description", "strength"), ("supportsClaim",)),
    "method": ("Method", "methods", ("name", "aliases", "category", ("architecture.type", "architecture"), ("architecture.layers", "layers")), ("innovation", "description")),
    "experiment": ("Experiment", "experiments", ("name", "purpose", "design"), ()),
    "result": ("Result", "results", (("mainResult", "value"), "description"), (("performanceBreakdown", "performance"),)),
}
#: Confidence of a record that states none.
CONFIDENCE = 0.8


def register(kind: str, type_: str, fields: Fields, section: str = "text", metadata: Fields = ()) -> None:
    """Adds or replaces the rule of a kind of record."""
    RULES[kind] = (type_, section, fields, metadata)


def _pairs(fields: Fields) -> list[tuple[str, str]]:
    return [(f, f) if isinstance(f, str) else f for f in fields]


def map_records(records: DataFrame, kind: str, json: str = "record") -> DataFrame:
    """(type, attributes) of JSON records by the rule of their kind; absent and null fields are left out."""
    type_, _, fields, _ = RULES[kind]
    found = [F.get_json_object(json, "$." + path).alias(name) for path, name in _pairs(fields)]
    return records.select(*[c for c in records.columns if c != json], F.lit(type_).alias("type"), F.to_json(F.struct(*found)).alias("attributes"))


def map_all(records: DataFrame, kind_col: str = "kind", json: str = "record") -> DataFrame:
    """(type, section, attributes, metadata, confidence) of JSON records of any kinds by their rules, in one narrow pass.

    Attributes and metadata are maps of JSON texts; absent and null fields are left out. Records of kinds without a rule, and null
    records, are left out.
    """
    pair = lambda p: F.struct(F.lit(p[0]).alias("path"), F.lit(p[1]).alias("name"))
    none = F.array().cast("array<struct<path:string,name:string>>")
    rule = F.create_map(*[x for k, (t, s, f, m) in RULES.items() for x in (
        F.lit(k), F.struct(F.lit(t).alias("type"), F.lit(s).alias("section"), F.array(*map(pair, _pairs(f))).alias("fields"), (F.array(*map(pair, _pairs(m))) if m else none).alias("metadata")),
    )])
    value = lambda p: F.call_function("get_json_object", F.col(json), F.concat(F.lit("$."), p["path"]))
    read = lambda c: F.map_from_entries(F.filter(F.transform(c, lambda p: F.struct(p["name"].alias("k"), value(p).alias("v"))), lambda e: e["v"].isNotNull()))
    rows = records.withColumn("_r", F.try_element_at(rule, F.col(kind_col))).where(F.col("_r").isNotNull() & F.col(json).isNotNull())
    stated = F.nullif(F.get_json_object(json, "$.confidence").try_cast("double"), F.lit(0.0))
    return rows.select(
        *[c for c in records.columns if c not in (json, kind_col)], F.col("_r.type").alias("type"), F.col("_r.section").alias("section"),
        read(F.col("_r.fields")).alias("attributes"), read(F.col("_r.metadata")).alias("metadata"), F.coalesce(stated, F.lit(CONFIDENCE)).alias("confidence"),
    )


def unregistered(entities: DataFrame, types: DataFrame) -> DataFrame:
    """Entities whose type isn't registered; they may not be stored."""
    return entities.join(F.broadcast(types.select(F.col("name").alias("type"))), "type", "left_anti")


def json_in_text(c: Column) -> Column:
    """The outermost JSON object of a text, without fences and words around it; null if there is none that can be read."""
    body = F.nullif(F.regexp_extract(F.regexp_replace(c, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))
    repaired = F.regexp_replace(F.regexp_replace(body, r",\s*([}\]])", "$1"), "[“”]", '"')
    ok = lambda x: F.json_object_keys(x).isNotNull()
    return F.when(ok(body), body).when(ok(repaired), repaired)


def fill_defaults(attributes: Column, required: dict[str, str]) -> Column:
    """Attributes with the defaults of the required fields that they lack."""
    own = F.from_json(attributes, "map<string,string>")
    defaults = F.create_map(*[F.lit(x) for kv in required.items() for x in kv])
    missing = F.map_filter(defaults, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys(own), k), F.lit(False)))
    return F.to_json(F.map_concat(F.coalesce(own, F.create_map().cast("map<string,string>")), missing))


# Fields whose attribute has another name, by kind; all other fields keep theirs.
RENAMED: dict[str, dict[str, str]] = {
    "station": {"type": "stationType", "id": "stationId"}, "aquifer": {"type": "aquiferType"}, "precipitation": {"type": "precipType"}, "temperature": {"type": "tempType"},
    "flood": {"type": "floodType"}, "flood_event": {"type": "floodType"},
}


def kind_type(c: Column) -> Column:
    """Type that a kind of record stands for: its words with capital letters, joined."""
    return F.regexp_replace(F.initcap(F.regexp_replace(c, r"[\s_-]+", " ")), " ", "")


def map_any(records: DataFrame, kind_col: str, json: str = "record") -> DataFrame:
    """(type, attributes) of JSON records of kinds without a rule of their own: fields keep their names but for ``RENAMED``."""
    own = F.from_json(json, "map<string,string>")
    names = F.create_map(*[x for k, m in RENAMED.items() for x in (F.lit(k), F.create_map(*[F.lit(y) for kv in m.items() for y in kv]))])
    rename = F.coalesce(F.try_element_at(names, F.col(kind_col)), F.create_map().cast("map<string,string>"))
    fields = F.map_filter(F.transform_keys(own, lambda k, v: F.coalesce(F.try_element_at(rename, k), k)), lambda k, v: v.isNotNull())
    return records.select(*[c for c in records.columns if c != json], kind_type(F.col(kind_col)).alias("type"), F.to_json(fields).alias("attributes"))
