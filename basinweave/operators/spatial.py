"""Spatial samples and resources: coordinates of tables, boxes, property profiles, styling choices and ranking of resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How formats are drawn.
FORMAT_PRIMITIVE = {
    "geojson": "region-layer", "shapefile": "region-layer", "gpkg": "region-layer", "kml": "region-layer", "geotiff": "raster-layer", "netcdf": "raster-layer", "zarr": "raster-layer",
    "raster": "raster-layer", "csv": "attached-table", "tsv": "attached-table", "xlsx": "attached-table", "table": "attached-table",
}
_LAT = ("lat", "latitude", "y", "ylat", "latdd", "decimallatitude", "latitudedecimal")
_LON = ("lon", "lng", "long", "longitude", "x", "xlon", "londd", "decimallongitude", "longitudedecimal")
_METRIC = "value metric score index rate area count total mean median risk hazard magnitude".split()
_CATEGORY = "class category status type cluster group zone region basin continent".split()


def geometry_kind(type_: Column) -> Column:
    return F.when(type_.isin("Point", "MultiPoint"), "point").when(type_.isin("Polygon", "MultiPolygon"), "region").when(type_.isin("LineString", "MultiLineString"), "line").otherwise("geometry")


def primitive_from_geometry(type_: Column) -> Column:
    kind = geometry_kind(type_)
    return F.when(kind == "point", "point-layer").when(kind == "line", "route-or-flow-layer").otherwise("region-layer")


def format_of_url(url: Column) -> Column:
    """Open format that an address ends in; '' if none."""
    p = F.lower(F.split_part(url, F.lit("?"), F.lit(1)))
    return (
        F.when(p.rlike(r"\.(geojson|json)$"), "geojson").when(p.rlike(r"\.(shp|zip)$"), "shapefile").when(p.endswith(".gpkg"), "gpkg").when(p.endswith(".kml"), "kml")
        .when(p.rlike(r"\.tiff?$"), "geotiff").when(p.endswith(".nc"), "netcdf").when(p.endswith(".csv"), "csv").when(p.endswith(".tsv"), "tsv").when(p.endswith(".xlsx"), "xlsx").otherwise("")
    )


def primitive_of_format(fmt: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMAT_PRIMITIVE.items() for x in kv]), F.lower(fmt))


def coordinate_fields(columns: list[str]) -> tuple[str | None, str | None]:
    """(latitude, longitude) among the columns of a table, by their names without punctuation."""
    clean = {c: "".join(ch for ch in c.lower() if ch.isalnum()) for c in columns}
    pick = lambda names: next((c for n in names for c in columns if clean[c] == n), None)
    return pick(_LAT), pick(_LON)


def points_of_table(table: DataFrame) -> DataFrame:
    """Rows of a table with usable coordinates as points: lon, lat and the other columns as properties."""
    lat, lon = coordinate_fields(table.columns)
    if lat is None or lon is None:
        raise ValueError("no coordinate columns")
    num = lambda c: F.expr(f"try_cast(nullif(trim(cast(`{c}` as string)), '') as double)")
    rest = [c for c in table.columns if c not in (lat, lon)]
    props = F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda k, v: v.isNotNull() & (v != "")) if rest else F.create_map().cast("map<string,string>")
    rows = table.select(num(lon).alias("lon"), num(lat).alias("lat"), props.alias("properties"), F.lit(0.84).alias("confidence"))
    return rows.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat) and abs(lon) <= 180 and abs(lat) <= 90")


def features_of_geojson(raw: DataFrame, col: str = "value") -> DataFrame:
    """Features of GeoJSON texts (collections, single features, bare geometries): name, geometry type, box and properties; features without geometry are left out."""
    kind = F.get_json_object(col, "$.type")
    items = (
        F.when(kind == "FeatureCollection", F.from_json(F.get_json_object(col, "$.features"), "array<string>"))
        .when(kind == "Feature", F.array(F.col(col)))
        .when(F.get_json_object(col, "$.coordinates").isNotNull(), F.array(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.col(col), F.lit("}"))))
    )
    f = raw.select(F.posexplode(items).alias("pos", "f"))
    geo = F.get_json_object("f", "$.geometry")
    nums = F.transform(F.regexp_extract_all(F.get_json_object(geo, "$.coordinates"), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"), F.lit(1)), lambda x: x.cast("double"))
    lon, lat = F.filter(nums, lambda x, i: i % 2 == 0), F.filter(nums, lambda x, i: i % 2 == 1)
    name = F.coalesce(*[F.nullif(F.get_json_object("f", f"$.properties.{n}"), F.lit("")) for n in ("name", "Name", "NAME", "title", "label", "id")], F.get_json_object("f", "$.id"))
    rows = f.where(geo.isNotNull() & (geo != "null")).select(
        F.coalesce(name, F.concat(F.lit("Feature "), (F.col("pos") + 1).cast("string"))).alias("name"), F.get_json_object(geo, "$.type").alias("geometry_type"),
        F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat"),
        F.get_json_object("f", "$.properties").alias("properties"), F.lit(0.9).alias("confidence"),
    )
    return rows.where("min_lon is not null and min_lat is not null")


def repair_mojibake(c: Column) -> Column:
    """Text that was read as Latin-1 though it was UTF-8, repaired; other text as it is."""
    fixed = F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")
    return F.when(c.rlike("[ÃÂ][\\u0080-\\u00BF]") & ~F.contains(fixed, F.lit("�")), fixed).otherwise(c)


def profile_fields(features: DataFrame, group: str, props: str = "attributes") -> DataFrame:
    """Coverage of each property of each group's features: numeric, categorical, series, and distinct categories.

    Properties are unfolded once and aggregated by (group, field); category counts use partial sums per value, so hot fields are
    combined before the shuffle.
    """
    keys = F.explode(F.json_object_keys(props)).alias("field")
    rows = features.select(group, props, keys).select(group, "field", F.expr(f"get_json_object({props}, concat('$[\\'', field, '\\']'))").alias("v"))
    rows = rows.where("v is not null and v != ''")
    is_array = F.col("v").startswith("[")
    is_object = F.col("v").startswith("{")
    number = F.expr("try_cast(v as double)")
    numeric = ~is_array & ~is_object & number.isNotNull()
    category = ~is_array & ~is_object & number.isNull()
    series = is_array & F.coalesce(F.json_array_length("v") >= 3, F.lit(False)) & F.col("v").rlike("[0-9]")
    sums = rows.groupBy(group, "field").agg(
        F.count("*").alias("n"), F.count_if(numeric).alias("n_num"), F.count_if(category).alias("n_cat"), F.count_if(series).alias("n_series"),
        F.countDistinct(F.when(category, F.col("v"))).alias("distinct"),
    )
    total = features.groupBy(group).agg(F.count("*").alias("features"))
    share = lambda c: F.round(F.col(c) / F.col("features"), 6)
    out = sums.join(total, group)
    return out.select(
        group, "field", "features", "distinct", share("n").alias("coverage"), share("n_num").alias("numeric"), share("n_cat").alias("categorical"), share("n_series").alias("series"),
        (share("n_num") >= 0.35).alias("is_numeric"),
        ((share("n_cat") >= 0.35) & (F.col("distinct") >= 2) & (F.col("distinct") <= F.greatest(F.lit(12.0), F.col("features") * 0.7))).alias("is_categorical"),
        (share("n_series") >= 0.15).alias("is_series"),
    )


def field_score(name: Column, category: bool = False) -> Column:
    """How many telling words a field's name has."""
    total = F.lit(0)
    for w in _CATEGORY if category else _METRIC:
        total = total + F.contains(F.lower(name), F.lit(w)).cast("int")
    return total


def primary_visual(profile: DataFrame, geometry: DataFrame, group: str) -> DataFrame:
    """(group, visual) by the fields and geometries (group, geometry_type, n) of its features."""
    flags = profile.groupBy(group).agg(F.max("is_categorical").alias("cat"), F.max("is_numeric").alias("num"))
    t = F.col("geometry_type")
    geo = geometry.groupBy(group).agg(F.max(t.rlike("(?i)polygon|bbox")).alias("area"), F.max(t.rlike("(?i)point")).alias("point"), F.max(t.rlike("(?i)linestring")).alias("line"))
    c = F.col
    visual = (
        F.when(c("cat") & c("area"), "classified-region-map").when(c("num") & c("point"), "scaled-point-map").when(c("line"), "route-flow-map")
        .when(c("area"), "regional-feature-map").when(c("point"), "point-feature-map").otherwise("spatial-overview")
    )
    return geo.join(flags, group, "left").fillna(False).select(group, visual.alias("visual"))


def rank_resources(resources: DataFrame, group: str) -> DataFrame:
    """Resources (group, url, label, kind) of use for a map: format, relevance, readiness and rank within the group."""
    fmt = format_of_url(F.col("url"))
    rows = resources.where("url is not null and url != ''").withColumn("format", fmt).withColumn("primitive", F.coalesce(primitive_of_format(fmt), F.lit("evidence-resource")))
    drawn = F.col("primitive").isin("region-layer", "point-layer", "route-or-flow-layer", "raster-layer", "classified-area-layer", "attached-table")
    relevance = F.when(drawn, "spatial-data").when(F.lower("kind").isin("dataset", "data", "supplement"), "possible-spatial-data")
    ready = (
        F.when(F.col("format").isin("geojson", "csv", "shapefile", "geotiff"), "sampleable-now")
        .when(F.col("primitive").isin("raster-layer", "region-layer", "attached-table"), "requires-light-processing")
        .when(F.col("primitive") == "workflow-resource", "blocked-code-execution")
        .otherwise("needs-review")
    )
    rows = rows.withColumn("relevance", relevance).where("relevance is not null").withColumn("readiness", ready)
    score = F.when(F.col("readiness") == "rendered-from-linked-resource", 5).when(F.col("readiness") == "sampleable-now", 4).when(F.col("readiness") == "requires-light-processing", 3).when(F.col("readiness") == "needs-review", 2).otherwise(1)
    order = Window.partitionBy(group).orderBy(F.desc("score"), "label", "url")
    return rows.withColumn("score", score).withColumn("rank", F.row_number().over(order))


def join_boxes(points: DataFrame, boxes: DataFrame, cell: float = 1.0, levels: int = 3, step: int = 8) -> DataFrame:
    """Points (lon, lat) with the boxes (min_lon, min_lat, max_lon, max_lat) that hold them: an equi join on grid cells, then the exact test.

    Each box is laid on the finest of ``levels`` grids, each ``step`` times as coarse as the one before, on which it covers at most
    ``step`` + 1 cells in either direction; boxes wider than that on the coarsest grid share one cell. So a box has few rows however
    wide it is, and a point one row a grid.
    """
    sizes = [cell * step**k for k in range(levels)]
    wide = F.greatest(F.col("max_lon") - F.col("min_lon"), F.col("max_lat") - F.col("min_lat"))
    level = F.coalesce(*[F.when(wide <= size * step, F.lit(k)) for k, size in enumerate(sizes)], F.lit(levels))
    size = F.element_at(F.array(*map(F.lit, sizes)), F.least(F.col("_l"), F.lit(levels - 1)) + 1)
    at = lambda c: F.when(F.col("_l") == levels, 0).otherwise(F.floor(c / size).cast("int"))
    p = points.withColumn("_l", F.explode(F.array(*[F.lit(k) for k in range(levels + 1)]))).withColumn("_x", at(F.col("lon"))).withColumn("_y", at(F.col("lat")))
    b = boxes.withColumn("_l", level).where("min_lon <= max_lon and min_lat <= max_lat")
    b = b.withColumn("_x", F.explode(F.sequence(at(F.col("min_lon")), at(F.col("max_lon")))))
    b = b.withColumn("_y", F.explode(F.sequence(at(F.col("min_lat")), at(F.col("max_lat")))))
    inside = F.col("lon").between(F.col("min_lon"), F.col("max_lon")) & F.col("lat").between(F.col("min_lat"), F.col("max_lat"))
    return p.join(b, ["_l", "_x", "_y"]).where(inside).drop("_l", "_x", "_y")


def platform_of(url: Column) -> Column:
    """(platform, record) of an address of a data platform; null for other addresses."""
    u = F.lower(url)
    hit = lambda name, p: F.when(F.regexp_extract(u, p, 1) != "", F.struct(F.lit(name).alias("platform"), F.regexp_extract(u, p, 1).alias("record")))
    return F.coalesce(
        hit("zenodo", r"zenodo\.org/(?:records?|deposit)/([0-9]+)"), hit("figshare", r"figshare\.com/articles/(?:[a-z_]+/)?(?:[^/]+/)?([0-9]+)"),
        hit("dryad", r"datadryad\.org/.*(doi:10\.[0-9]+/[^\s?#]+)"), hit("dataverse", r"dataverse[^/]*/.*persistentid=([^&\s]+)"), hit("osf", r"osf\.io/([a-z0-9]{4,6})"),
        hit("pangaea", r"pangaea\.(?:de/)?([0-9]+)"), hit("huggingface", r"huggingface\.co/datasets/([^/\s?#]+/[^/\s?#]+)"),
    )


def candidate_score(name: Column, size_mb: Column) -> Column:
    """How promising a file of a data repository is for a map: by format and words in its name, less for its size."""
    fmt = format_of_url(name)
    eligible = fmt.isin("geojson", "csv", "shapefile", "geotiff")
    by = F.when(fmt.isin("geojson", "shapefile"), 40).when(fmt == "csv", 28).when(fmt == "geotiff", 20).otherwise(0)
    words = F.when(F.lower(name).rlike("basin|catchment|station|gauge|region|boundary|grid|map|spatial|geo"), 10).otherwise(0)
    return F.when(eligible, 100).otherwise(0) + by + words - F.least(F.lit(20.0), F.coalesce(size_mb, F.lit(0.0)) / 10)


def place_query(names: list[Column], kind: Column) -> Column:
    """Name to look up for an entity that has no geometry; null for those that stand for the whole globe or for no place."""
    name = F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])
    whole = name.rlike(r"(?i)^(global|world|worldwide|earth|planet)\b")
    return F.when(kind.isin("Region", "Basin", "Watershed", "Location", "City", "River", "Lake", "Glacier", "FloodEvent", "DroughtEvent", "Heatwave", "Wildfire", "Landslide") & ~whole, name)


def geocode(entities: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Entities (id, place) with the place of a gazetteer (name, lon, lat, importance): the most important of that name; confidence .45 to .9."""
    best = gazetteer.groupBy(F.lower(F.trim("name")).alias("_k")).agg(F.max(F.struct("importance", "lon", "lat")).alias("g"))
    hit = entities.where("place is not null").withColumn("_k", F.lower(F.trim("place"))).join(best, "_k")
    confidence = F.round(F.least(F.lit(0.9), F.greatest(F.lit(0.45), 0.45 + F.coalesce("g.importance", F.lit(0.0)) * 0.45)), 4)
    return hit.select("id", F.col("g.lon").alias("lon"), F.col("g.lat").alias("lat"), confidence.alias("confidence"))
