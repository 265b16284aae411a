"""The built-in checks of each source, as limits on aggregates plus coverage against the area boundaries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import METRO_BOUNDS_LIMIT, STATE_BOX
from ..functions.cells import AGE_BANDS, INDUSTRIES
from ..operators.areas import total_bounds
from ..operators.contracts import (Check, contract_failures, contract_record, duplicate_rows, issue_record, missing_measures, placed_share,
                                   profile, reconcile, run_checks)
from ..operators.network import ring_problems
from ..operators.relate import coverage, stack_tables
from .contracts import CONTRACTS, KEYS, LOCAL_LAYERS, TURNOVER_COUNTS

# The sizes a healthy release has.
CITY_AREAS = 373
LEAST_ROWS = {"stops": 10_000, "traffic_lights": 3_000, "polling_places": 2_500, "schools": 1_500, "hospitals": 250, "roads": 50_000,
              "cos_trees": 40_000, "cos_stairs": 400, "cos_mobility_parking": 300}
LEAST_SHOPS = {"supermarket": 300, "convenience": 500}
TYPICAL_AMENITIES, TYPICAL_ZEBRA = 6_595, 1_825


def _rows() -> Column:
    return F.count(F.lit(1))


def _inside(name: str, box: tuple) -> list[Check]:
    west, south, east, north = box
    text = f"{name} fall outside the expected box"
    outside = (F.min("lon") <= west) | (F.max("lon") >= east) | (F.min("lat") <= south) | (F.max("lat") >= north)
    return [Check(F.coalesce(outside, F.lit(False)).cast("int"), text, high=0)]


def _unique(frame: DataFrame, dataset: str, key: list[str], message: str, level: str = "error") -> DataFrame:
    return run_checks(duplicate_rows(frame, key), dataset, [Check(F.max("duplicates"), message, level=level, high=0)], start=50)


def _coverage(frame: DataFrame, dataset: str, boundaries: DataFrame | None, both: bool = False, inside_only: bool = False) -> DataFrame:
    """Compare a table's area codes with the boundaries; without boundaries the check is skipped with a warning."""
    if boundaries is None:
        return frame.sparkSession.range(1).select(
            F.lit(dataset).alias("dataset"), F.lit(90).alias("position"), F.lit("warn").alias("level"),
            F.lit("coverage is unchecked: this run has no boundaries").alias("message"))
    found = coverage(frame.select("SA2_CODE21"), boundaries.select("SA2_CODE21"), "SA2_CODE21")
    missing = Check(F.max("missing"), "boundary areas without a row: {value}", high=0)
    unknown = Check(F.max("unknown"), "areas outside the boundaries: {value}", high=0)
    checks = [missing, unknown] if both else [unknown] if inside_only else [missing]
    return run_checks(found, dataset, checks, start=90)


def check_boundaries(frame: DataFrame) -> DataFrame:
    name = "sa2_boundaries"
    west, south, east, north = METRO_BOUNDS_LIMIT
    wide = (F.min("minx") <= west) | (F.max("maxx") >= east) | (F.min("miny") <= south) | (F.max("maxy") >= north)
    return stack_tables(
        run_checks(frame, name, [Check(_rows(), f"{{value}} areas instead of {CITY_AREAS}", equals=CITY_AREAS),
                                 Check(F.count_if(F.coalesce(F.size("geom"), F.lit(0)) <= 0), "geometry without parts: {value}", high=0)]),
        _unique(frame, name, ["SA2_CODE21"], "duplicate area codes"),
        run_checks(total_bounds(frame, "geom"), name, [Check(F.coalesce(wide, F.lit(True)).cast("int"), "the box of all areas leaves the city", high=0)], 60),
        run_checks(ring_problems(frame, "SA2_CODE21").select("SA2_CODE21").distinct(), name, [Check(_rows(), "areas with faulty rings: {value}", "warn", high=0)], 70))


def check_businesses(frame: DataFrame, boundaries: DataFrame | None) -> DataFrame:
    name = "businesses"
    listed = frame.sparkSession.range(1).select(F.explode(F.array(*[F.lit(i) for i in INDUSTRIES])).alias("industry_code"))
    letters = coverage(frame.select("industry_code"), listed, "industry_code")
    empty = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in TURNOVER_COUNTS), F.lit(0))
    per_area = frame.groupBy("SA2_CODE21").agg(_rows().alias("n"))
    return stack_tables(
        run_checks(letters, name, [Check(F.max(F.col("missing") + F.col("unknown")), "the industry letters are not A to S", high=0)]),
        run_checks(per_area, name, [Check(_rows(), "too few areas of the state: {value}", low=600)], 10),
        _unique(frame, name, ["industry_code", "SA2_CODE21"], "duplicate industry and area rows"),
        run_checks(frame, name, [Check(empty, "counts left blank: {value}", "warn", high=0)], 60), _coverage(frame, name, boundaries))


def check_income(frame: DataFrame, boundaries: DataFrame | None) -> DataFrame:
    name, measures = "income", ["earners", "median_age", "median_income", "mean_income"]
    return stack_tables(
        run_checks(frame, name, [Check(_rows(), "too few areas of the state: {value}", low=600),
                                 Check(F.coalesce(F.min("median_income"), F.lit(5_001)), "smallest median income: {value}", low=5_001),
                                 Check(F.coalesce(F.max("median_income"), F.lit(5_001)), "largest median income: {value}", high=399_999)]),
        _unique(frame, name, ["SA2_CODE21"], "duplicate area codes"),
        run_checks(missing_measures(frame, measures, "SA2_CODE21"), name, [Check(F.max("rows_with_missing"), "areas without some measure: {value}", "warn", high=0)], 60),
        _coverage(frame, name, boundaries))


def check_population(frame: DataFrame, boundaries: DataFrame | None) -> DataFrame:
    name, bands = "population", [f"{b}_people" for b in AGE_BANDS]
    empty = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in [*bands, "total_people"]), F.lit(0))
    off = reconcile(frame, bands, "total_people")
    return stack_tables(
        run_checks(frame, name, [Check(_rows(), f"{{value}} areas instead of {CITY_AREAS}", equals=CITY_AREAS), Check(empty, "population counts left blank", high=0),
                                 Check(F.sum("total_people"), "sum of people out of range: {value}", low=4_500_001, high=6_999_999)]),
        _unique(frame, name, ["SA2_CODE21"], "duplicate area codes"),
        run_checks(off, name, [Check(_rows(), "areas whose age bands miss their total: {value}", "warn", high=0)], 60),
        _coverage(frame, name, boundaries, both=True))


def check_mesh_blocks(frame: DataFrame, boundaries: DataFrame | None) -> DataFrame:
    name = "mesh_blocks"
    return stack_tables(
        run_checks(frame, name, [Check(_rows(), "number of mesh blocks out of range: {value}", low=30_000, high=90_000),
                                 Check(F.sum("dwellings"), "sum of dwellings out of range: {value}", low=1_800_000, high=2_800_000),
                                 Check(F.sum("persons"), "sum of persons out of range: {value}", low=4_500_000, high=6_000_000),
                                 Check(F.count_if(F.col("dwellings").isNull()), "mesh blocks without dwellings: {value}", "warn", high=0)]),
        _unique(frame, name, ["MB_CODE21"], "duplicate mesh block codes"), _coverage(frame, name, boundaries, inside_only=True))


def check_schools(frame: DataFrame) -> DataFrame:
    name = "schools"
    return stack_tables(
        run_checks(frame, name, [Check(_rows(), "too few catchments: {value}", low=LEAST_ROWS[name]),
                                 Check(F.count_if(F.coalesce(F.size("geom"), F.lit(0)) <= 0), "catchments without shape: {value}", high=0),
                                 Check(F.count_if(F.col("USE_ID").isNull()), "catchments of no school: {value}", high=0)]),
        run_checks(ring_problems(frame, "USE_ID").select("USE_ID").distinct(), name, [Check(_rows(), "schools with faulty rings: {value}", "warn", high=0)], 60))


def _check_points(frame: DataFrame, name: str, key: str, level: str = "error") -> DataFrame:
    return stack_tables(run_checks(frame, name, [Check(_rows(), f"too few {name}: {{value}}", low=LEAST_ROWS[name]), *_inside(name, STATE_BOX)]),
                        _unique(frame, name, [key], f"duplicate {name} ids", level))


def check_hospitals(frame: DataFrame) -> DataFrame:
    return _check_points(frame, "hospitals", "topoid", "warn")


def check_polling_places(frame: DataFrame) -> DataFrame:
    lost = Check(F.count_if(F.col("lon").isNull()), "polling places left without a point: {value}", "warn", high=0)
    return stack_tables(_check_points(frame, "polling_places", "polling_place_id"), run_checks(frame, "polling_places", [lost], 60))


def check_stops(frame: DataFrame) -> DataFrame:
    name = "stops"
    return stack_tables(
        run_checks(frame, name, [Check(_rows(), "too few stops: {value}", low=LEAST_ROWS[name]),
                                 Check(F.count_if(F.col("location_type") == 1), "the feed has no stations", "warn", low=1)]),
        _unique(frame, name, ["stop_id"], "duplicate stop ids"), placed_share(frame, name, "stops", start=60))


def check_traffic_lights(frame: DataFrame) -> DataFrame:
    name = "traffic_lights"
    parts = [run_checks(frame, name, [Check(_rows(), "too few traffic lights: {value}", low=LEAST_ROWS[name])]), placed_share(frame, name, "traffic lights", start=60)]
    if "asset_type" not in frame.columns:
        parts.append(run_checks(frame, name, [Check(F.lit(1), "the asset_type column is gone", "warn", high=0)], 70))
    return stack_tables(*parts)


def check_map_features(amenities: DataFrame, crossings: DataFrame, roads: DataFrame, shops: DataFrame) -> DataFrame:
    name = "osm_nsw"
    kinds = [Check(F.count_if(F.col("amenity") == k), f"points of kind {k}: none", low=1) for k in ("toilets", "drinking_water")]
    typical = Check(_rows(), f"number of amenities far from {TYPICAL_AMENITIES:,}: {{value}}", "warn", low=TYPICAL_AMENITIES / 2, high=TYPICAL_AMENITIES * 2)
    zebras = Check(F.count_if("is_zebra"), f"zebra crossings far below {TYPICAL_ZEBRA:,}: {{value}}", "warn", low=TYPICAL_ZEBRA / 2)
    ends = roads.select(F.explode(F.flatten("geom")).alias("p")).select(F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    return stack_tables(
        run_checks(amenities, name, [*kinds, typical, *_inside("amenities", STATE_BOX)]),
        run_checks(crossings, name, [Check(_rows(), "crossings: none", low=1), zebras, *_inside("crossings", STATE_BOX)], 20),
        run_checks(roads, name, [Check(_rows(), "too few road segments: {value}", low=LEAST_ROWS["roads"])], 40), run_checks(ends, name, _inside("roads", STATE_BOX), 45),
        run_checks(shops, name, [Check(F.count_if(F.col("kind") == k), f"too few shops of kind {k}: {{value}}", low=n) for k, n in LEAST_SHOPS.items()]
                   + _inside("shops", STATE_BOX), 60))


def check_local_layer(frame: DataFrame, name: str) -> DataFrame:
    if name not in LOCAL_LAYERS:
        raise ValueError(f"unknown layer: {name}")
    lost = Check(F.count_if(F.col("lon").isNull()), "rows without a point: {value}", high=0)
    return stack_tables(_check_points(frame, name, "objectid"), run_checks(frame, name, [lost], 60))


def assess(source: str, tables: dict[str, DataFrame], issues: DataFrame) -> DataFrame:
    """All quality records of a source: its built-in checks, then one contract record per table."""
    profiles = {n: profile(f, n, KEYS.get(n, [])) for n, f in tables.items()}
    records = [issue_record(issues, stack_tables(*profiles.values()), source)]
    for name, frame in tables.items():
        if name in CONTRACTS:
            records.append(contract_record(contract_failures(frame, CONTRACTS[name], name), profiles[name], name))
    return stack_tables(*records)
