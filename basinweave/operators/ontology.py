"""The layered vocabulary: types, relations, aliases, hierarchy and the semantics of relations between layers.

All tables here are fixed and small (a few hundred rows); they are built once and broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The registered relations by layer.
RELATIONS: dict[str, tuple[str, ...]] = {
    "foundation": (
        "is_a", "has_part", "part_of", "connected_to", "causes", "caused_by", "triggers", "precedes", "follows", "performs", "performed_by", "targets",
        "uses", "produces", "consumes", "claims", "supports", "contradicts", "derives_from", "applies", "implements", "evaluates", "evaluated_by",
        "measures", "measured_by", "located_at", "occurs_at", "during", "relates_to",
    ),
    "source": (
        "cited_by", "cites", "references", "version_of", "derived_from", "has_figure", "has_section", "has_dataset", "depends_on", "uses_package",
        "hosted_on", "published_by", "reviewed_by", "validated_by",
    ),
    "capability": (
        "has_variable", "observes", "simulates", "trained_on", "validated_on", "calibrated_with", "runs_on", "depends_on_software", "implements_method",
        "issued_by", "implements_policy", "represents", "exposes", "assessed_by", "has_indicator", "supports_claim", "has_coverage", "derived_from_data",
        "part_of_network", "applies_to", "responds_to", "planned_in", "targets_entity", "reduces_risk", "evaluated_by",
    ),
    "world": (
        "drains_to", "upstream_of", "downstream_of", "flows_through", "recharges", "withdraws_from", "supplies", "affects", "triggers_hazard",
        "exposed_to", "vulnerable_to", "generates_risk", "mitigates_hazard", "driven_by", "modifies", "feeds_back", "exacerbates", "under_scenario",
        "projects", "interacts_with", "teleconnected_to", "part_of_system", "approaches_threshold",
    ),
    "bridge": (
        "covers", "observes", "measures", "simulates", "predicts", "models", "has_variable", "represents", "mitigates", "targets", "responds_to",
        "governs", "assesses", "supports", "contradicts", "applicable_to", "transferable_to", "limited_by",
    ),
}

# Domain, range, inverse and the confidence that an inferred relation may have (None: it must be stated).
BRIDGES: dict[str, tuple[tuple[str, ...], tuple[str, ...], str, float | None]] = {
    "covers": (("Dataset", "DataProduct", "Sensor", "Satellite", "Model"), ("Region", "Basin", "Watershed", "Location", "Glacier", "Lake"), "covered_by", 0.6),
    "observes": (("Sensor", "Satellite", "Gauge", "Station", "RemoteSensingSystem", "InSituNetwork"), ("EarthVariable", "Streamflow", "Precipitation", "Temperature", "SoilMoisture", "Entity"), "observed_by", 0.65),
    "measures": (("Sensor", "Gauge", "Station", "Instrument"), ("EarthVariable", "Metric", "Entity"), "measured_by", None),
    "simulates": (("Model", "Simulation", "HydrologicalModel", "ClimateModel"), ("EarthProcess", "Basin", "Watershed", "System", "EarthVariable"), "simulated_by", 0.65),
    "predicts": (("Model", "Forecasting", "Method"), ("EarthVariable", "Event", "Hazard", "TimeSeries"), "predicted_by", None),
    "models": (("Model", "Method", "Algorithm"), ("EarthProcess", "EarthVariable", "System", "Phenomenon"), "modeled_by", 0.6),
    "has_variable": (("Dataset", "DataProduct", "ModelOutput"), ("Variable", "EarthVariable", "Streamflow", "Precipitation", "Temperature"), "in_dataset", None),
    "represents": (("Dataset", "DataProduct", "Model", "ExposureDataset", "VulnerabilityIndex"), ("Entity", "Location", "Population", "Infrastructure", "EarthVariable"), "represented_by", 0.55),
    "mitigates": (("Intervention", "AdaptationMeasure", "MitigationMeasure", "Infrastructure", "EngineeringMeasure"), ("EarthRisk", "FloodRisk", "DroughtRisk", "Hazard"), "mitigated_by", 0.55),
    "targets": (("Intervention", "AdaptationMeasure", "Policy", "ManagementAction"), ("Entity", "Location", "Risk", "Hazard", "Population"), "targeted_by", None),
    "responds_to": (("EmergencyResponse", "Intervention", "Action"), ("Event", "Hazard", "FloodEvent", "DroughtEvent", "Risk"), "responded_by", None),
    "governs": (("Policy", "Regulation", "Standard", "Agreement"), ("Entity", "Process", "Location", "Activity"), "governed_by", 0.6),
    "assesses": (("Assessment", "RiskAssessment", "ImpactAssessment", "Indicator", "Index"), ("Risk", "Entity", "Location", "Condition", "Status"), "assessed_by", 0.6),
    "supports": (("Evidence", "Data", "Dataset", "Measurement", "Result"), ("Claim", "Conclusion", "Hypothesis"), "supported_by", None),
    "contradicts": (("Evidence", "Data", "Result", "Observation"), ("Claim", "Hypothesis", "Assumption"), "contradicted_by", None),
    "applicable_to": (("Method", "Model", "Algorithm", "Dataset"), ("Domain", "Task", "Region", "Process"), "can_apply", 0.5),
    "transferable_to": (("Method", "Model", "Algorithm"), ("Domain", "Task", "Application", "Region"), "transferable_from", None),
    "limited_by": (("Model", "Method", "Dataset", "Assessment"), ("Condition", "Assumption", "DataAvailability", "Resource"), "limits", None),
}

# The type above each type, in the order of definition. Foundation types have none.
PARENTS: dict[str, str] = {
    # source
    "Source": "Entity", "Paper": "Source", "Preprint": "Paper", "Thesis": "Paper", "Repository": "Source", "Package": "Source", "APIPage": "Source",
    "DatasetPage": "Source", "DataCatalog": "Source", "Report": "Source", "AssessmentReport": "Report", "WhitePaper": "Report", "News": "Source",
    "PressRelease": "News", "PolicyDocument": "Source", "StandardDocument": "Source", "Documentation": "Source", "ModelCard": "Source",
    "Benchmark": "Source", "TechnicalBlog": "Source", "OntologyFile": "Source", "KnowledgeGraph": "Source",
    # capability
    "Dataset": "Data", "DataProduct": "Dataset", "Variable": "Entity", "Feature": "Entity", "Coverage": "Entity", "Resolution": "Entity",
    "DataQuality": "Entity", "Sensor": "Entity", "Satellite": "Sensor", "Gauge": "Sensor", "Station": "Sensor", "RemoteSensingSystem": "Sensor",
    "InSituNetwork": "Entity", "MonitoringProgram": "Process", "Algorithm": "Method", "Simulation": "Process", "Forecasting": "Process",
    "Calibration": "Process", "Validation": "Process", "UncertaintyQuantification": "Method", "Software": "Entity", "API": "Entity",
    "Workflow": "Process", "Pipeline": "Workflow", "Interface": "Entity", "ExecutionEnvironment": "Entity", "CloudService": "Entity",
    "Policy": "Entity", "Regulation": "Policy", "Institution": "Agent", "Stakeholder": "Agent", "ManagementPlan": "Entity", "Standard": "Entity",
    "Protocol": "Method", "Agreement": "Entity", "PopulationDataset": "Dataset", "EconomicIndicator": "Metric", "LandUseClassification": "Dataset",
    "InfrastructureInventory": "Dataset", "ExposureDataset": "Dataset", "VulnerabilityIndex": "Metric", "DemandModel": "Model",
    "BehaviorModel": "Model", "Assessment": "Process", "Indicator": "Metric", "Index": "Indicator", "EvidenceChain": "Entity",
    "EvaluationFramework": "Method", "RiskAssessment": "Assessment", "ImpactAssessment": "Assessment", "ConfidenceLevel": "Entity",
    "ScenarioAssessment": "Assessment", "AdaptationMeasure": "Intervention", "MitigationMeasure": "Intervention", "ManagementAction": "Intervention",
    "EmergencyResponse": "Intervention", "ResourceAllocation": "Action", "EngineeringMeasure": "Intervention", "PolicyAction": "Intervention",
    "OperationalPlan": "Entity",
    # world
    "EarthSystem": "System", "Hydrosphere": "EarthSystem", "Atmosphere": "EarthSystem", "Biosphere": "EarthSystem", "Cryosphere": "EarthSystem",
    "Lithosphere": "EarthSystem", "Anthroposphere": "EarthSystem", "EarthObject": "Object", "Region": "EarthObject", "Basin": "Region",
    "Watershed": "Basin", "Glacier": "EarthObject", "Lake": "EarthObject", "Aquifer": "EarthObject", "Coastline": "EarthObject",
    "MountainRange": "EarthObject", "EarthProcess": "Process", "WaterCycle": "EarthProcess", "CarbonCycle": "EarthProcess",
    "Erosion": "EarthProcess", "Sedimentation": "EarthProcess", "EarthVariable": "Variable", "Streamflow": "EarthVariable",
    "Precipitation": "EarthVariable", "Temperature": "EarthVariable", "SoilMoisture": "EarthVariable", "GroundwaterLevel": "EarthVariable",
    "Evapotranspiration": "EarthVariable", "ResourceStock": "Resource", "WaterResource": "ResourceStock", "EnergyResource": "ResourceStock",
    "ResourceFlow": "Process", "WaterWithdrawal": "ResourceFlow", "Hazard": "Event", "FloodEvent": "Hazard", "DroughtEvent": "Hazard",
    "Heatwave": "Hazard", "Wildfire": "Hazard", "Landslide": "Hazard", "EarthRisk": "Risk", "FloodRisk": "EarthRisk", "DroughtRisk": "EarthRisk",
    "Exposure": "Entity", "Vulnerability": "Entity", "Infrastructure": "Object", "Dam": "Infrastructure", "Reservoir": "Lake",
    "PowerGrid": "Infrastructure", "WaterSupplySystem": "Infrastructure", "HumanActivity": "Process", "Irrigation": "HumanActivity",
    "Urbanization": "HumanActivity", "Deforestation": "HumanActivity", "EarthScenario": "Scenario", "ClimateScenario": "EarthScenario",
    "DevelopmentScenario": "EarthScenario", "ModelOutput": "Data", "Forecast": "ModelOutput", "Projection": "ModelOutput", "Feedback": "Relation",
    "Teleconnection": "Relation", "Threshold": "Entity",
    # domain
    "River": "EarthObject", "StreamReach": "River", "GaugeStation": "Gauge", "PrecipitationGauge": "Gauge", "HydrologicalModel": "Model",
    "RainfallRunoffModel": "HydrologicalModel", "GroundwaterModel": "HydrologicalModel", "RunoffGeneration": "EarthProcess",
    "Infiltration": "EarthProcess", "FlashFlood": "FloodEvent", "RiverineFlood": "FloodEvent", "WaterQualityIndicator": "Indicator",
    "ClimateZone": "Region", "ClimateIndex": "Index", "ENSO": "ClimateIndex", "ClimateModel": "Model", "GCM": "ClimateModel", "RCM": "ClimateModel",
    "ClimateProjection": "Projection", "ExtremesIndicator": "Indicator", "City": "Region", "Building": "Infrastructure",
    "DrainageNetwork": "Infrastructure", "UrbanFlood": "FloodEvent", "TrafficFlow": "EarthVariable", "UrbanHeatIsland": "Process",
    "Substation": "Infrastructure", "TransmissionLine": "Infrastructure", "RenewableGeneration": "Infrastructure", "EnergyStorage": "Infrastructure",
    "EnergyDemand": "EarthVariable", "HydropowerPlant": "RenewableGeneration", "Ecosystem": "EarthObject", "Vegetation": "EarthVariable",
    "Habitat": "Region", "Species": "Entity", "BiodiversityIndex": "Index", "CarbonSink": "Entity", "EcosystemService": "Entity", "Crop": "Entity",
    "CropYield": "EarthVariable", "IrrigationDemand": "EarthVariable", "SoilCondition": "EarthVariable", "GrowingSeason": "TimeRange",
    "AgriculturalDrought": "DroughtEvent",
}
# Fields that a type requires beside those of the types above it. Foundation types that are not listed require a name.
REQUIRED: dict[str, tuple[str, ...]] = {
    "Claim": ("statement",), "Evidence": ("type",), "Measurement": ("name", "value"), "Method": ("name", "category"), "Metric": ("name", "value"),
    "Uncertainty": ("value",), "Time": ("value",), "Relation": ("type", "subject", "object"), "Source": ("type", "identifier"), "Paper": ("title",),
    "Repository": ("repo",), "Package": ("registry",), "APIPage": ("apiName",), "DatasetPage": ("datasetName",), "Report": ("title",),
    "News": ("title",), "PolicyDocument": ("title",), "StandardDocument": ("standardId",), "ModelCard": ("modelName",), "TechnicalBlog": ("title",),
    "Coverage": ("type",), "Resolution": ("value", "unit"), "Gauge": ("stationId",), "Station": ("stationId",), "Standard": ("standardId",),
    "ConfidenceLevel": ("level",), "ResourceAllocation": ("resource",), "EarthVariable": ("name",), "Feedback": ("name",), "Teleconnection": ("name",), "Threshold": ("value",),
    "GaugeStation": ("stationId",), "PrecipitationGauge": ("stationId",), "WaterQualityIndicator": ("name", "value"), "ClimateIndex": ("name",),
    "ExtremesIndicator": ("name",), "BiodiversityIndex": ("name",),
}
# Types that take no fields from the type above them, which belongs to a layer where their own is not looked for.
FIELD_ROOTS = (
    "EarthVariable", "GaugeStation", "PrecipitationGauge", "WaterQualityIndicator", "ExtremesIndicator", "ClimateIndex", "BiodiversityIndex", "GrowingSeason",
)
# Defaults of a type as JSON, beside those of the types above it.
DEFAULTS: dict[str, str] = {
    "System": '{"components": [], "interfaces": []}', "Process": '{"steps": []}', "Claim": '{"confidence": 0.8}', "Evidence": '{"confidence": 0.8}',
    "Uncertainty": '{"type": "standard_error"}', "Time": '{"unit": "ISO"}', "Preprint": '{"server": "arXiv"}',
    "DataCatalog": '{"datasets": [], "totalRecords": 0}', "PolicyDocument": '{"status": "active"}', "Dataset": '{"version": "1.0", "samples": 0}',
    "DataProduct": '{"processingLevel": "derived"}', "InSituNetwork": '{"stations": []}', "Workflow": '{"steps": [], "dependencies": []}',
    "Regulation": '{"status": "active"}', "Hydrosphere": '{"type": "hydrosphere"}', "Atmosphere": '{"type": "atmosphere"}',
    "Biosphere": '{"type": "biosphere"}', "Cryosphere": '{"type": "cryosphere"}', "Lithosphere": '{"type": "lithosphere"}',
    "Anthroposphere": '{"type": "anthroposphere"}', "Region": '{"type": "region"}', "Streamflow": '{"units": "m3/s"}',
    "Precipitation": '{"units": "mm"}', "Temperature": '{"units": "°C"}', "SoilMoisture": '{"units": "m3/m3"}', "GroundwaterLevel": '{"units": "m"}',
    "Evapotranspiration": '{"units": "mm"}', "HydrologicalModel": '{"modelType": "distributed"}',
}

LAYER_RANK = {"foundation": 1, "source": 2, "capability": 3, "world": 4, "domain": 5}


def relation_table(spark: SparkSession) -> DataFrame:
    """(name, layer) of each registered relation, in the first layer that has it."""
    seen: dict[str, str] = {}
    for layer, names in RELATIONS.items():
        for n in names:
            seen.setdefault(n, layer)
    return spark.createDataFrame(sorted(seen.items()), "name string, layer string")


def bridge_table(spark: SparkSession) -> DataFrame:
    """One row per predicate, subject type and object type that its definition names."""
    rows = [(p, d, r, inv, cap is not None, cap) for p, (ds, rs, inv, cap) in BRIDGES.items() for d in ds for r in rs]
    return spark.createDataFrame(rows, "predicate string, domain string, range string, inverse string, fallback boolean, cap double")


def parent_table(spark: SparkSession) -> DataFrame:
    """(name, parent) by definition."""
    return spark.createDataFrame(sorted(PARENTS.items()), "name string, parent string")


def type_closure(parents: DataFrame, names: DataFrame) -> DataFrame:
    """(name, ancestor, steps): each type with itself and all types above it, at the least number of steps; circles end."""
    from basinweave.session import stable

    seen = names.select("name", F.col("name").alias("ancestor"), F.lit(0).alias("steps")).distinct()
    up = parents.select(F.col("name").alias("ancestor"), F.col("parent").alias("next")).dropna().distinct()
    front, steps = seen, 0
    while True:
        steps += 1
        step = front.join(up, "ancestor").select("name", F.col("next").alias("ancestor")).distinct()
        front = stable(step.join(seen.select("name", "ancestor"), ["name", "ancestor"], "left_anti").withColumn("steps", F.lit(steps)))
        if front.isEmpty():
            return seen
        seen = stable(seen.unionByName(front))


def own_schemas(types: DataFrame) -> DataFrame:
    """(name, parent, required, defaults) of registered types by definition, without what the types above them add; ``parent`` is null
    where no fields are taken from it."""
    spark = types.sparkSession
    rows = [(n, None if n in FIELD_ROOTS else PARENTS.get(n), list(REQUIRED.get(n, () if n in PARENTS else ("name",))), DEFAULTS.get(n)) for n in {*PARENTS, *PARENTS.values(), *REQUIRED, *DEFAULTS}]
    own = spark.createDataFrame(rows, "name string, parent string, required array<string>, defaults string")
    return types.select("name").distinct().join(F.broadcast(own), "name", "left").select("name", "parent", F.coalesce("required", F.array(F.lit("name"))).alias("required"), "defaults")


def merged_schemas(schemas: DataFrame) -> DataFrame:
    """(name, required, defaults): the fields that each type and all types above it require, and their defaults; the nearest type's count.

    ``schemas``: name, parent, required, defaults (a JSON object whose values are kept as they are written).
    """
    closure = type_closure(schemas, schemas.select("name"))
    above = closure.join(F.broadcast(schemas.select(F.col("name").alias("ancestor"), "required", "defaults")), "ancestor")
    fields = above.select("name", F.explode("required").alias("field")).groupBy("name").agg(F.array_sort(F.collect_set("field")).alias("required"))
    each = above.select("name", "steps", F.explode(F.from_json("defaults", "map<string,string>")).alias("key", "value"))
    nearest = each.groupBy("name", "key").agg(F.min_by("value", "steps").alias("value")).groupBy("name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("defaults"))
    empty = F.create_map().cast("map<string,string>")
    out = schemas.select("name").distinct().join(fields, "name", "left").join(nearest, "name", "left")
    return out.select("name", F.coalesce("required", F.array().cast("array<string>")).alias("required"), F.coalesce("defaults", empty).alias("defaults"))


def complete_attributes(entities: DataFrame, merged: DataFrame, type_col: str = "type", json: str = "attributes") -> DataFrame:
    """Adds ``completed``: attributes with all fields that their type requires. Missing ones get the type's default, else one by name.

    Types without a schema need only a name. Values stay JSON texts; unreadable and null attributes count as empty.
    """
    type_ = F.col(type_col)
    by_name = {"type": F.lit("unknown"), "statement": F.lit("No statement"), "value": F.lit("0"), "category": F.lit("general"), "repo": F.lit("unknown-repo")}
    plain = lambda f: F.coalesce(*[F.when(f == k, v) for k, v in by_name.items()], F.when(f == "name", F.concat(F.lit("Unnamed "), type_)), F.when(f == "title", F.concat(F.lit("Untitled "), type_)), F.lit(""))
    rows = entities.join(F.broadcast(merged.select(F.col("name").alias(type_col), F.col("required").alias("_r"), F.col("defaults").alias("_d"))), type_col, "left")
    empty = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.from_json(json, "map<string,string>"), empty)
    needed = F.coalesce("_r", F.array(F.lit("name")))
    lacking = F.array_except(needed, F.map_keys(own))
    filled = F.map_from_arrays(lacking, F.transform(lacking, lambda f: F.coalesce(F.try_element_at(F.coalesce("_d", empty), f), plain(f))))
    return rows.withColumn("completed", F.map_concat(own, filled)).drop("_r", "_d")


def type_token(c: Column) -> Column:
    """Type name in the form that aliases have."""
    return F.lower(F.regexp_replace(c, r"[\s_-]+", ""))


def resolve_types(df: DataFrame, col: str, types: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds ``resolved``, the registered type that a name or alias means (exactly, but for case and separators), else null."""
    names = types.select(type_token(F.col("name")).alias("_t"), F.col("name").alias("_n"), F.lit(0).alias("_r"))
    objects = types.select(F.concat(type_token(F.col("name")), F.lit("object")).alias("_t"), F.col("name").alias("_n"), F.lit(1).alias("_r"))
    known = names.unionByName(objects).unionByName(aliases.select(F.col("token").alias("_t"), F.col("canonical").alias("_n"), F.lit(2).alias("_r")))
    first = known.groupBy("_t").agg(F.min_by("_n", F.struct("_r", "_n")).alias("resolved"))
    return df.withColumn("_t", type_token(F.col(col))).join(F.broadcast(first), "_t", "left").drop("_t")


def with_layers(df: DataFrame, types: DataFrame, col: str = "type") -> DataFrame:
    """Adds the ``type_layer`` and ``type_category`` of a type: 'unknown' and 'other' where they have none."""
    lookup = types.groupBy("name").agg(F.min(F.struct("layer_rank", "layer", "category")).alias("_m"))
    lookup = lookup.select(F.col("name").alias("_name"), F.col("_m.layer").alias("_l"), F.col("_m.category").alias("_c"))
    joined = df.join(F.broadcast(lookup), F.col(col) == F.col("_name"), "left").drop("_name")
    return joined.withColumn("type_layer", F.coalesce("_l", F.lit("unknown"))).withColumn("type_category", F.coalesce("_c", F.lit("other"))).drop("_l", "_c")


def confidence_cap(predicate: Column, has_evidence: Column) -> Column:
    """Confidence that a relation may have: 0.9 with evidence, the cap of its predicate when inferred, 0.5 if unknown."""
    caps = F.create_map(*[F.lit(x) for p, (_, _, _, c) in BRIDGES.items() for x in (p, c if c is not None else 0.0)])
    known = predicate.isin(list(BRIDGES))
    return F.when(~known | predicate.isNull(), F.lit(0.5)).when(has_evidence, F.lit(0.9)).otherwise(F.element_at(caps, predicate))


def valid_bridges(pairs: DataFrame, closure: DataFrame, bridges: DataFrame) -> DataFrame:
    """Adds each ``predicate`` that allows the pair (subject_type, object_type): either, or a type above it, is in domain and range."""
    s = closure.select(F.col("name").alias("subject_type"), F.col("ancestor").alias("domain"))
    o = closure.select(F.col("name").alias("object_type"), F.col("ancestor").alias("range"))
    hit = pairs.join(F.broadcast(s), "subject_type").join(F.broadcast(bridges), "domain").join(F.broadcast(o), ["object_type", "range"])
    return hit.select(*pairs.columns, "predicate", "inverse", "fallback", "cap").distinct()
