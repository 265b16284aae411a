"""Declared table contracts compiled to aggregates, source checks, and the quality records made from both."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo

FAILURE = "dataset string, position int, column string, rule string, n bigint, example string"
ISSUE = "dataset string, position int, level string, message string"


@dataclass(frozen=True)
class Field:
    """What one column must look like. Kinds: int, text, float, bool, any, point (columns lon and lat), polygon, line."""
    name: str
    kind: str
    nullable: bool = False
    unique: bool = False
    allowed: tuple = ()
    low: float | None = None
    high: float | None = None
    above: float | None = None
    box: tuple | None = None

    @property
    def columns(self) -> list[str]:
        return ["lon", "lat"] if self.kind == "point" else [self.name]


@dataclass(frozen=True)
class Contract:
    fields: tuple[Field, ...]
    strict: bool = True
    unique: tuple[str, ...] = ()


_CASTS = {"int": "bigint", "float": "double", "text": "string", "bool": "boolean"}


def _field_rules(f: Field) -> list[tuple[str, str, Column, Column]]:
    """(column, rule, is it broken, value to show) for one field, with values coerced first."""
    if f.kind == "point":
        placed = F.col("lon").isNotNull() & F.col("lat").isNotNull()
        west, south, east, north = f.box
        inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
        shown = F.concat_ws(" ", F.col("lon").cast("string"), F.col("lat").cast("string"))
        rules = [(f.name, f"inside {f.box}", placed & ~inside, shown)]
        return rules if f.nullable else [(f.name, "not null", ~placed, F.lit("null")), *rules]
    raw = F.col(f"`{f.name}`")
    if f.kind in ("polygon", "line"):
        points = geo.vertices(raw) if f.kind == "polygon" else F.flatten(raw)
        broken = F.coalesce(F.size(points), F.lit(0)) == 0
        if f.kind == "line":
            broken = broken | (F.size(raw) > 1)
        missing = [] if f.nullable else [(f.name, "not null", raw.isNull(), F.lit("null"))]
        return [*missing, (f.name, "not empty" if f.kind == "polygon" else "a line", raw.isNotNull() & broken, F.lit("empty"))]
    value = raw.try_cast(_CASTS[f.kind]) if f.kind in _CASTS else raw
    shown = raw.cast("string")
    rules = []
    if f.kind in ("int", "float", "bool"):
        lost = raw.isNotNull() & value.isNull()
        if f.kind == "int":  # a number with a fraction is not a whole number
            lost = lost | F.coalesce(raw.try_cast("double") != value, F.lit(False))
        rules.append((f.name, f"is {f.kind}", lost, shown))
    if not f.nullable:
        rules.append((f.name, "not null", raw.isNull(), F.lit("null")))
    checks = []
    if f.allowed:
        checks.append((f"in {list(f.allowed)}", value.isin(list(f.allowed))))
    if f.low is not None and f.high is not None:
        checks.append((f"in range {f.low} to {f.high}", value.between(f.low, f.high)))
    elif f.low is not None:
        checks.append((f"at least {f.low}", value >= f.low))
    if f.above is not None:
        checks.append((f"above {f.above}", value > f.above))
    return rules + [(f.name, rule, value.isNotNull() & ~ok, shown) for rule, ok in checks]


def contract_failures(frame: DataFrame, contract: Contract, dataset: str) -> DataFrame:
    """All broken rules with the number of rows and one example each; an empty result means the table passes.

    All value rules go in one pass over the table; each uniqueness rule is one aggregate on its key.
    """
    spark = frame.sparkSession
    wanted = [c for f in contract.fields for c in f.columns]
    fixed = [(c, "column present", c) for c in wanted if c not in frame.columns]
    if contract.strict:
        fixed += [(c, "no other columns", c) for c in frame.columns if c not in wanted]
    present = [f for f in contract.fields if all(c in frame.columns for c in f.columns)]
    rules = [r for f in present for r in _field_rules(f)]
    parts = []
    if fixed:
        listed = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.lit(rule).alias("rule"),
                                    F.lit(1).cast("bigint").alias("n"), F.lit(e).alias("example")) for i, (c, rule, e) in enumerate(fixed)])
        parts.append(spark.range(1).select(F.explode(listed).alias("f")).select("f.*"))
    if rules:
        measures = []
        for i, (_, _, broken, shown) in enumerate(rules):
            measures += [F.count_if(broken).alias(f"n{i}"), F.min(F.when(broken, F.substring(shown, 1, 40))).alias(f"e{i}")]
        listed = F.array(*[F.struct(F.lit(100 + i).alias("position"), F.lit(c).alias("column"), F.lit(rule).alias("rule"),
                                    F.col(f"n{i}").alias("n"), F.col(f"e{i}").alias("example")) for i, (c, rule, _, _) in enumerate(rules)])
        parts.append(frame.agg(*measures).select(F.explode(listed).alias("f")).select("f.*").filter("n > 0"))
    keys = [([f.name], f.name) for f in present if f.unique]
    if contract.unique and all(c in frame.columns for c in contract.unique):
        keys.append((list(contract.unique), "table"))
    for i, (key, column) in enumerate(keys):
        repeated = frame.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
        shown = F.substring(F.concat_ws(",", *[F.col(c).cast("string") for c in key]), 1, 40)
        parts.append(repeated.agg(F.sum("_n").alias("n"), F.min(shown).alias("example"))
                     .select(F.lit(1000 + i).alias("position"), F.lit(column).alias("column"),
                             F.lit("unique " + ", ".join(key)).alias("rule"), "n", "example").filter("n > 0"))
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], FAILURE)
    return out.select(F.lit(dataset).alias("dataset"), "position", "column", "rule", "n", "example")


def profile(frame: DataFrame, dataset: str, key: Sequence[str] = ()) -> DataFrame:
    """One row: rows, columns, empty cells over all columns, and rows that repeat an earlier row's key (missing keys are equal)."""
    cells = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in frame.columns), F.lit(0))
    one = frame.agg(F.count(F.lit(1)).alias("rows"), cells.alias("missing_values"))
    key = [k for k in key if k in frame.columns]
    if key:
        one = one.unionByName(duplicate_rows(frame, key).withColumnRenamed("duplicates", "duplicate_keys"), allowMissingColumns=True)
    else:
        one = one.withColumn("duplicate_keys", F.lit(0).cast("bigint"))
    totals = one.agg(*[F.sum(c).alias(c) for c in ("rows", "missing_values", "duplicate_keys")])
    return totals.select(F.lit(dataset).alias("dataset"), "rows", F.lit(len(frame.columns)).cast("bigint").alias("columns"),
                         "missing_values", "duplicate_keys")


@dataclass(frozen=True)
class Check:
    """An aggregate that must stay within limits. The message may hold {value}."""
    value: Column
    message: str
    level: str = "error"
    low: float | None = None
    high: float | None = None
    equals: float | None = None


def run_checks(frame: DataFrame, dataset: str, checks: Sequence[Check], start: int = 0) -> DataFrame:
    """Issues (dataset, position, level, message) of all checks of a table, from one aggregate."""
    one = frame.agg(*[c.value.cast("double").alias(f"v{i}") for i, c in enumerate(checks)])
    rows = []
    for i, c in enumerate(checks):
        v = F.col(f"v{i}")
        broken = F.lit(False)
        if c.low is not None:
            broken = broken | F.coalesce(v < c.low, F.lit(True))
        if c.high is not None:
            broken = broken | F.coalesce(v > c.high, F.lit(True))
        if c.equals is not None:
            broken = broken | ~v.eqNullSafe(F.lit(float(c.equals)))
        whole = F.when(v == F.floor(v), F.format_number(v, 0)).otherwise(v.cast("string"))
        text = F.replace(F.lit(c.message), F.lit("{value}"), F.coalesce(whole, F.lit("none")))
        rows.append(F.struct(F.lit(start + i).alias("position"), F.lit(c.level).alias("level"), text.alias("message"), broken.alias("broken")))
    return (one.select(F.explode(F.array(*rows)).alias("i")).select(F.lit(dataset).alias("dataset"), "i.*")
            .filter("broken").drop("broken"))


def duplicate_rows(frame: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row: how many rows repeat an earlier row's key."""
    return (frame.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates")))


def placed_share(frame: DataFrame, dataset: str, label: str, limit: float = 0.01, start: int = 0) -> DataFrame:
    """Rows without usable coordinates: a warning, or an error when they are more than `limit` of all rows."""
    one = frame.agg(F.count_if(F.col("lon").isNull() | F.col("lat").isNull()).alias("missing"), F.count(F.lit(1)).alias("rows"))
    much = F.col("missing") > F.col("rows") * limit
    error = F.concat(F.col("missing").cast("string"), F.lit(" of "), F.col("rows").cast("string"), F.lit(f" {label} have unusable coordinates"))
    warn = F.concat(F.col("missing").cast("string"), F.lit(f" {label} have unusable coordinates and are kept without a point"))
    return one.filter("missing > 0").select(
        F.lit(dataset).alias("dataset"), F.lit(start).alias("position"), F.when(much, "error").otherwise("warn").alias("level"),
        F.when(much, error).otherwise(warn).alias("message"))


def reconcile(frame: DataFrame, parts: Sequence[str], total: str, tolerance: float = 5) -> DataFrame:
    """Rows whose parts do not add up to the total within the tolerance."""
    added = sum((F.coalesce(F.col(f"`{p}`"), F.lit(0)) for p in parts), F.lit(0))
    return frame.withColumn("difference", added - F.col(total)).filter(F.abs("difference") > tolerance)


def missing_measures(frame: DataFrame, measures: Sequence[str], key: str) -> DataFrame:
    """One row: rows in which any measure is missing, and the number of distinct keys."""
    gone = F.lit(False)
    for m in measures:
        gone = gone | F.col(f"`{m}`").isNull()
    per_key = frame.groupBy(key).agg(F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.sum("n").alias("rows"), F.sum("gone").alias("rows_with_missing"), F.count(key).alias("distinct_keys"))


def contract_record(failures: DataFrame, profiled: DataFrame, dataset: str) -> DataFrame:
    """One quality record from a contract's failures: PASS, or FAIL with the number of failing cases, the first three rules and the number of the rest."""
    name = f"contract:{dataset}"
    shown = F.concat(F.col("column"), F.lit(": "), F.col("rule"), F.lit(" (e.g. "), F.coalesce("example", F.lit("null")), F.lit(")"))
    # A contract has a fixed, small number of rules, so its list of failures is bounded by the contract.
    listed = failures.agg(F.sort_array(F.collect_list(F.struct("position", shown.alias("text")))).alias("f"), F.count(F.lit(1)).alias("k"),
                          F.coalesce(F.sum("n"), F.lit(0)).alias("cases"))
    notes = F.concat(F.lit("schema failed with "), F.col("cases").cast("string"), F.lit(" failing case(s) of "), F.col("k").cast("string"), F.lit(" rule(s): "),
                     F.array_join(F.transform(F.slice("f", 1, 3), lambda s: s["text"]), "; "),
                     F.when(F.col("k") > 3, F.concat(F.lit(" and "), (F.col("k") - 3).cast("string"), F.lit(" more"))).otherwise(""))
    judged = listed.select(F.lit(name).alias("_name"), F.when(F.col("k") > 0, "FAIL").otherwise("PASS").alias("status"),
                           F.when(F.col("k") > 0, notes).otherwise("schema validation passed").alias("notes"))
    return _record(judged, profiled.withColumn("_name", F.lit(name)))


def issue_record(issues: DataFrame, profiles: DataFrame, dataset: str) -> DataFrame:
    """One quality record for a source: its worst issue decides, its notes are joined, its tables' profiles are added up."""
    listed = issues.agg(F.sort_array(F.collect_list(F.struct("position", "message"))).alias("m"),
                        F.count_if(F.col("level") == "error").alias("errors"), F.count(F.lit(1)).alias("k"))
    status = F.when(F.col("errors") > 0, "FAIL").when(F.col("k") > 0, "WARNING").otherwise("PASS")
    notes = F.when(F.col("k") > 0, F.array_join(F.transform("m", lambda s: s["message"]), "; ")).otherwise("ok")
    judged = listed.select(F.lit(dataset).alias("_name"), status.alias("status"), notes.alias("notes"))
    return _record(judged, profiles.withColumn("_name", F.lit(dataset)))


def _record(judged: DataFrame, profiles: DataFrame) -> DataFrame:
    totals = profiles.groupBy("_name").agg(*[F.sum(c).alias(c) for c in ("rows", "columns", "missing_values", "duplicate_keys")])
    return judged.join(totals, "_name").select(F.col("_name").alias("dataset"), "status", "rows", "columns", "missing_values",
                                               "duplicate_keys", "notes")


def passes(records: DataFrame) -> bool:
    """The gate before a write: no record of the source may be FAIL."""
    return records.filter(F.col("status") == "FAIL").limit(1).count() == 0
