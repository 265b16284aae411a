"""Cleaning rules of the feature and point sources. Input frames hold the publisher's columns and a geometry column."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, cells, geometry, projection, tags
from ..functions.cells import blank_to_null, strip, to_int, to_numeric
from ..operators.relate import replace_by_key

# Published column names and their names here, and the codes of the signal types.
PLACE_NAMES = {
    "State": "state", "DivisionID": "division_id", "DivisionNm": "division_name", "PollingPlaceID": "polling_place_id",
    "PollingPlaceTypeID": "polling_place_type_id", "PollingPlaceNm": "polling_place_name", "PremisesNm": "premises_name",
    "PremisesAddress1": "premises_address_1", "PremisesAddress2": "premises_address_2", "PremisesAddress3": "premises_address_3",
    "PremisesSuburb": "premises_suburb", "PremisesPostCode": "premises_post_code"}
PLACE_INTS = ["division_id", "polling_place_id", "polling_place_type_id", "premises_post_code"]
SIGNAL_TYPES = {"veh": "Vehicle", "vehicle": "Vehicle", "ped": "Pedestrian", "pedestrian": "Pedestrian"}
BOUNDARY_INTS = ["SA2_CODE21", "CHG_FLAG21", "SA3_CODE21", "SA4_CODE21", "STE_CODE21"]
BOUNDARY_COLUMNS = ["SA2_CODE21", "SA2_NAME21", "CHG_FLAG21", "CHG_LBL21", "SA3_CODE21", "SA3_NAME21", "SA4_CODE21", "SA4_NAME21",
                    "GCC_CODE21", "GCC_NAME21", "STE_CODE21", "STE_NAME21", "AUS_CODE21", "AUS_NAME21", "AREASQKM21", "LOCI_URI21"]


def place_points(frame: DataFrame, lon: Column, lat: Column, box: tuple | None) -> DataFrame:
    """Add `lon` and `lat`, both missing unless they are present, not 0 and (with a box) inside it. No row is dropped."""
    placed = frame.withColumns({"_lon": lon, "_lat": lat})
    good = boxes.usable_point(F.col("_lon"), F.col("_lat"), box)
    return placed.withColumns({"lon": F.when(good, F.col("_lon")), "lat": F.when(good, F.col("_lat"))}).drop("_lon", "_lat")


def unplaced_examples(frame: DataFrame, key: str, lon: str, lat: str, box: tuple, most: int = 20) -> DataFrame:
    """Up to `most` rows with unusable coordinates, for the source's record (the count itself is of all rows)."""
    bad = ~boxes.usable_point(F.col(lon), F.col(lat), box)
    return frame.filter(bad).select(F.col(key).cast("string").alias("id"), F.col(lat).alias("lat"), F.col(lon).alias("lon")).limit(most)


def clean_boundaries(features: DataFrame, city: str = "Greater Sydney") -> DataFrame:
    kept = features.filter(F.col("GCC_NAME21") == city)
    return kept.select(*[to_int(F.col(c)).alias(c) if c in BOUNDARY_INTS else F.col(c) for c in BOUNDARY_COLUMNS], "geom")


def clean_polling_places(rows: DataFrame, state: str = "NSW") -> DataFrame:
    kept = rows.filter(F.col("State") == state).withColumnsRenamed(PLACE_NAMES)
    placed = place_points(kept, to_numeric(F.col("Longitude")), to_numeric(F.col("Latitude")), None)
    return placed.select(*[to_int(F.col(c)).alias(c) if c in PLACE_INTS else F.col(c) for c in PLACE_NAMES.values()], "lon", "lat")


def clean_stops(rows: DataFrame) -> DataFrame:
    """GTFS stops, one row per id. A column the feed lacks is all missing; a blank location type is 0, an ordinary stop."""
    def text(name):
        return blank_to_null(F.col(name)) if name in rows.columns else F.lit(None).cast("string")

    def whole(name):
        return to_int(F.col(name)) if name in rows.columns else F.lit(None).cast("bigint")
    placed = place_points(rows, to_numeric(F.col("stop_lon")), to_numeric(F.col("stop_lat")), boxes.COUNTRY_BOX)
    return placed.select("stop_id", text("stop_code").alias("stop_code"), "stop_name",
                         F.coalesce(whole("location_type"), F.lit(0)).alias("location_type"), text("parent_station").alias("parent_station"),
                         whole("wheelchair_boarding").alias("wheelchair_boarding"), text("platform_code").alias("platform_code"), "lon", "lat")


def snake_columns(frame: DataFrame) -> DataFrame:
    """Columns in snake case with the usual synonyms; of columns with the same new name the first stays."""
    taken, kept = set(), []
    numbered = frame.toDF(*[f"_c{i}" for i in range(len(frame.columns))])
    for i, name in enumerate(frame.columns):
        snake = cells.snake_name(name)
        if snake not in taken:
            taken.add(snake)
            kept.append(F.col(f"_c{i}").alias(snake))
    return numbered.select(*kept)


def clean_traffic_lights(rows: DataFrame) -> DataFrame:
    named = snake_columns(rows)
    texts = {c for c, t in named.dtypes if t == "string"}
    trimmed = named.select(*[strip(F.col(c)).alias(c) if c in texts else F.col(c) for c in named.columns])
    if "asset_type" in trimmed.columns:
        trimmed = trimmed.withColumn("asset_type", cells.recode(F.col("asset_type"), SIGNAL_TYPES))
    placed = place_points(trimmed, to_numeric(F.col("longitude")), to_numeric(F.col("latitude")), boxes.STATE_BOX).drop("longitude", "latitude")
    return placed.select(*[blank_to_null(F.col(c)).alias(c) if c in texts else F.col(c) for c in placed.columns])


def dated_installs(lights: DataFrame) -> DataFrame:
    """`date_install` as dates when any of its cells is one, the others then missing; left as it is otherwise."""
    if "date_install" not in lights.columns:
        return lights
    date = cells.date_or_null(F.col("date_install"))
    return lights.withColumn("date_install", date) if lights.filter(date.isNotNull()).limit(1).count() else lights


def clean_hospitals(features: DataFrame) -> DataFrame:
    kept = features.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    whole = ("topoid", "classsubtype", "operationalstatus")
    names = ("topoid", "generalname", "alternativelabel", "classsubtype", "operationalstatus")
    return kept.select(*[to_numeric(F.col(c)).try_cast("bigint").alias(c) if c in whole else F.col(c) for c in names], "lon", "lat")


def clean_catchments(primary: DataFrame, secondary: DataFrame, future: DataFrame) -> DataFrame:
    """Primary and secondary catchments, with each school's future catchments in place of its current one."""
    columns = ["USE_ID", "CATCH_TYPE", "USE_DESC", "geom"]
    current = (primary.select(*columns, F.lit(0).alias("_layer")).unionByName(secondary.select(*columns, F.lit(1).alias("_layer"))))
    order = [F.col("_layer"), F.coalesce("USE_DESC", F.lit("")), F.coalesce("CATCH_TYPE", F.lit(""))]
    both = replace_by_key(current, future.select(*columns, F.lit(2).alias("_layer")), "USE_ID", ["CATCH_TYPE", "USE_DESC"], order)
    return both.withColumn("USE_ID", to_int(F.col("USE_ID"))).select(*columns)


def clean_local_layer(features: DataFrame) -> DataFrame:
    return features.toDF(*[c.lower() for c in features.columns])


def _tag(key: str) -> Column:
    return F.try_element_at("tags", F.lit(key))


def with_tags(features: DataFrame) -> DataFrame:
    return features.withColumn("tags", tags.tag_map(F.col("other_tags")))


def clean_amenities(points: DataFrame) -> DataFrame:
    found = with_tags(points).withColumn("amenity", _tag("amenity")).filter(F.col("amenity").isin(tags.AMENITIES))
    return found.select(F.col("osm_id").cast("string").alias("osm_id"), "amenity", "name", "lon", "lat")


def clean_crossings(points: DataFrame) -> DataFrame:
    found = with_tags(points.filter(F.col("highway") == "crossing"))
    kinds = [_tag("crossing"), _tag("crossing_ref"), _tag("crossing:markings")]
    names = ["crossing", "crossing_ref", "crossing_markings"]
    return found.select(F.col("osm_id").cast("string").alias("osm_id"), *[k.alias(n) for k, n in zip(kinds, names)],
                        tags.zebra(*kinds).alias("is_zebra"), "lon", "lat")


def clean_roads(lines: DataFrame) -> DataFrame:
    """Streets people can walk along; `lines` is already cut to the metropolitan box by the scan."""
    kept = with_tags(lines.filter(F.col("highway").isin(tags.WALKING_STREETS))).filter(tags.walkable(F.col("tags")))
    return kept.select(F.col("osm_id").cast("string").alias("osm_id"), "highway", "name", F.col("line").alias("geom"))


def _metric_centre(polygon: Column) -> Column:
    metres = geometry.map_vertices(polygon, lambda x, y: projection.to_metres(x, y))
    return geometry.polygon_centroid(metres)


def clean_shops(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Shops mapped as points and, at their centre in metres, as areas; anything that is not an everyday shop is dropped."""
    nodes = with_tags(points).select(
        F.concat(F.lit("n"), F.col("osm_id").cast("string")).alias("osm_id"), _tag("shop").alias("shop"), _tag("amenity").alias("amenity"),
        "name", _tag("brand").alias("brand"), F.lit("node").alias("mapped_as"), "lon", "lat")
    centred = with_tags(areas).withColumn("_m", _metric_centre(F.col("geom")))
    centred = centred.withColumn("_c", projection.to_degrees(F.col("_m.x"), F.col("_m.y")))
    way = F.concat(F.lit("w"), F.col("osm_way_id").cast("string"))
    built = centred.select(
        F.coalesce(way, F.concat(F.lit("r"), F.col("osm_id").cast("string"))).alias("osm_id"), "shop", "amenity", "name", _tag("brand").alias("brand"),
        F.lit("area").alias("mapped_as"), F.col("_c.x").alias("lon"), F.col("_c.y").alias("lat"))
    text = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("brand", F.lit("")))
    every = nodes.unionByName(built).withColumn("kind", tags.shop_kind(F.col("shop"), F.col("amenity"), text)).filter(F.col("kind").isNotNull())
    return every.select("osm_id", "kind", "shop", "amenity", "name", "brand", "mapped_as", "lon", "lat")


def source_metrics(source: str, frame: DataFrame, by: str | None = None) -> DataFrame:
    """Row counts of a source, in all or per class, as rows of the metrics table (source, metric, value)."""
    if by is None:
        return frame.agg(F.count(F.lit(1)).alias("value")).select(F.lit(source).alias("source"), F.lit("rows").alias("metric"), "value")
    return frame.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("none")).alias("k")).agg(F.count(F.lit(1)).alias("value")).select(
        F.lit(source).alias("source"), F.concat(F.lit(f"{by}="), F.col("k")).alias("metric"), "value")
