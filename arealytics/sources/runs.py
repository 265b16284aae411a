"""Runs of sources: tables written behind the gate, with row counts and metrics taken on the way out, and the report of the run."""
from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import passes
from . import releases

REPORT = "source string, status string, release string, seconds double, rows map<string,bigint>, issues array<string>, reason string"
METRICS = "source string, metric string, value bigint"


class Run:
    """One run over several sources. Counts come from the pass that writes a table (`DataFrame.observe`), so nothing is read twice for them."""

    def __init__(self, spark: SparkSession, folder: str, run: str):
        self.spark, self.folder, self.run = spark, folder.rstrip("/"), run
        self._report: list[tuple] = []
        self._metrics: list[tuple] = []

    def load(self, source: str, release: str, tables: dict[str, DataFrame], records: DataFrame, measures: dict[str, dict[str, Column]] | None = None) -> bool:
        """Release a source's tables if none of its quality records is FAIL. `measures` are counts per table by name, beside its rows. A source that
        fails is reported with its reason and leaves its earlier release as it was; the run goes on."""
        began, rows = time.time(), {}
        issues = [f"{r['dataset']}: {r['notes']}" for r in records.filter(F.col("status") != "PASS").select("dataset", "notes").collect()]  # one per table at most
        try:
            if not passes(records):
                raise ValueError("failed its checks: " + "; ".join(issues))
            seen = {name: Observation(f"{source} {name} {uuid.uuid4().hex}") for name in tables}
            watched = {}
            for name, frame in tables.items():
                counts = [v.cast("long").alias(m) for m, v in (measures or {}).get(name, {}).items()]
                watched[name] = frame.observe(seen[name], F.count(F.lit(1)).alias("rows"), *counts)
            releases.publish(self.spark, watched, f"{self.folder}/{source}", self.run)
            for name, observation in seen.items():
                found = observation.get
                rows[name] = found["rows"]
                self._metrics += [(source, f"{name}.{metric}", value) for metric, value in found.items()]
            self._report.append((source, "ok", release, time.time() - began, rows, issues, None))
            return True
        except Exception as error:  # reported; other sources still run
            self._report.append((source, "failed", release, time.time() - began, {}, issues, str(error).splitlines()[0]))
            return False

    def report(self) -> DataFrame:
        """(source, status, release, seconds, rows, issues, reason), one row per source."""
        return self.spark.createDataFrame(self._report, REPORT)

    def metrics(self) -> DataFrame:
        """(source, metric, value): rows and measures of every table that was released."""
        return self.spark.createDataFrame(self._metrics, METRICS)
