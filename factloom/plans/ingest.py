"""From a raw file to a typed, profiled and described dataset."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import COLUMN_TYPES
from factloom.operators.brief import FactSet, build_facts
from factloom.operators.dashboards import auto_dashboard, rebuild_dashboard
from factloom.operators.inference import ColumnPlan, coerce, plan_columns, retype
from factloom.operators.profiling import profile_table
from factloom.sources.tables import committed_versions, drop_versions, file_type, read_files, read_typed, write_typed

log = logging.getLogger(__name__)
WIDGETS = (
    "dataset_id string, position int, chart_type string, title string, x string, y string, aggregation string, "
    "split string, time_grain string, `limit` int, kind string"
)


@dataclass(frozen=True)
class Dataset:
    """A stored dataset: the raw file, where its tables live, and its column plans."""

    dataset_id: str
    source: str
    folder: str
    typed_path: str
    plans: tuple[ColumnPlan, ...]
    inferred: tuple[str, ...]

    @property
    def types(self) -> dict[str, str]:
        return {p.name: p.type for p in self.plans}

    @property
    def overrides(self) -> dict[str, str]:
        """Override types; one equal to the inferred type is none."""
        return {p.name: p.type for p, kind in zip(self.plans, self.inferred) if p.type != kind}

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return _stored(spark, f"{self.folder}/{name}")

    def typed(self, spark: SparkSession, hot: bool = False) -> DataFrame:
        return read_typed(spark, self.typed_path, hot)


def ingest(spark: SparkSession, path: str, folder: str, dataset_id: str) -> Dataset:
    """T5: parse, infer, coerce, profile, store, chart and describe one file.

    The raw file is read for the type statistics and once more to write the typed
    table; everything after that reads columns of Parquet. Every write replaces
    its own output, so a rerun starts clean.
    """
    raw = read_files(spark, path, file_type(path))
    plans = plan_columns(raw)
    home = f"{folder.rstrip('/')}/{dataset_id}"
    typed_path = write_typed(coerce(raw, plans), f"{home}/typed")
    dataset = Dataset(dataset_id, path, home, typed_path, tuple(plans), tuple(p.type for p in plans))
    profiles = profile_table(dataset.typed(spark), dataset.types, dataset_id)
    _describe(spark, dataset, profiles)
    drop_versions(spark, f"{home}/typed", typed_path)
    return dataset


def override_type(spark: SparkSession, dataset: Dataset, column: str, kind: str | None) -> Dataset:
    """One column coerced again from the original strings; None resets it.

    Only that column is profiled again. The typed table is rewritten from the raw
    scan as a whole, so rows can never be paired by position.
    """
    if kind is not None and kind not in COLUMN_TYPES:
        raise ValueError("Choose a valid column type.")
    names = [p.name for p in dataset.plans]
    if column not in names:
        raise KeyError(column)
    wanted = kind or dataset.inferred[names.index(column)]
    raw = read_files(spark, dataset.source, file_type(dataset.source))
    plans = tuple(retype(list(dataset.plans), raw, column, wanted))
    typed_path = write_typed(coerce(raw, list(plans)), f"{dataset.folder}/typed")
    changed = Dataset(dataset.dataset_id, dataset.source, dataset.folder, typed_path, plans, dataset.inferred)
    fresh = profile_table(changed.typed(spark).select(column), {column: wanted}, dataset.dataset_id)
    fresh = fresh.withColumn("position", F.lit(names.index(column)))
    kept = dataset.table(spark, "profiles").filter(F.col("name") != column)
    _describe(spark, changed, kept.unionByName(fresh))
    drop_versions(spark, f"{dataset.folder}/typed", typed_path)
    return changed


def _replace(df: DataFrame, path: str) -> DataFrame:
    """Stores a schema-sized table as a new version; the one it may derive from goes only then."""
    spark = df.sparkSession
    rows = spark.createDataFrame(df.collect(), df.schema)
    version = write_typed(rows.coalesce(1), path)
    drop_versions(spark, path, version)
    return spark.read.parquet(version)


def _describe(spark: SparkSession, dataset: Dataset, profiles: DataFrame) -> None:
    profiles = _replace(profiles, f"{dataset.folder}/profiles")
    # Only a dataset without widgets yet has no previous ones; a failed read fails.
    first = not committed_versions(spark, f"{dataset.folder}/widgets")
    previous = spark.createDataFrame([], WIDGETS) if first else _stored(spark, f"{dataset.folder}/widgets")
    widgets = _replace(rebuild_dashboard(auto_dashboard(profiles), previous), f"{dataset.folder}/widgets")
    try:
        # A dataset is usable without a brief, so a failed one does not fail the dataset.
        brief(spark, dataset, profiles, widgets)
    except Exception:
        log.exception("brief of %s failed", dataset.dataset_id)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    versions = committed_versions(spark, path)
    return spark.read.parquet(versions[-1] if versions else path)


def brief(spark: SparkSession, dataset: Dataset, profiles: DataFrame, widgets: DataFrame) -> FactSet:
    """The facts, anomalies and brief of a dataset, stored beside it."""
    told = build_facts(dataset.typed(spark), profiles, widgets)
    told.facts().coalesce(1).write.mode("overwrite").parquet(f"{dataset.folder}/facts")
    told.anomalies().coalesce(1).write.mode("overwrite").parquet(f"{dataset.folder}/anomalies")
    told.brief().coalesce(1).write.mode("overwrite").parquet(f"{dataset.folder}/brief")
    return told
