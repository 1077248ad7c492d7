"""Fitted models in folders: saved in versions, loaded in a later session.

A folder has `payload/<name>` per saved version and a table `manifests` with a row
for each: number, kind, where its payload lies, and the input columns with their types.
The row is appended after the payload is complete, so a reader sees whole versions
only and an interrupted save leaves nothing that is read. Versions are never
changed; `load` takes the latest, or the one it is asked for.

Loading checks the kind and, against the table to be scored, every input column and
its type: a model never meets columns that it was not fitted on.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.scaling import Scaler
from tidewire.plans.tail_models import LinearModel

#: Layout of the folder; a loader refuses others.
FORMAT = 1
_MANIFEST = "format int, version int, kind string, payload string, inputs string, notes string"
_SCALER = "place int, feature string, mean double, deviation double"
_LINEAR = "number int, name string, place int, feature string, value double"


class ModelMismatch(ValueError):
    """What is stored is not what the caller asked for, or does not fit the table to be scored."""


@dataclass(frozen=True)
class Manifest:
    """One stored version; ``notes`` are the caller's, such as the limits of the fit."""

    version: int
    kind: str
    payload: str
    inputs: Mapping[str, str]
    notes: Mapping[str, object]


def manifests(spark: SparkSession, path: str) -> list[Manifest]:
    """The versions of a folder, oldest first; none if the folder is missing.

    One row per save. Two savers at the same time may take the same number; the larger
    payload name then counts, for every reader alike.
    """
    try:
        rows = spark.read.schema(_MANIFEST).json(f"{path}/manifests").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    other = {r["format"] for r in rows} - {FORMAT}
    if other:
        raise ModelMismatch(f"{path} has the layouts {sorted(map(str, other))}, this library reads {FORMAT}")
    latest = {r["version"]: r for r in sorted(rows, key=lambda r: (r["version"], r["payload"]))}
    return [Manifest(v, r["kind"], r["payload"], json.loads(r["inputs"]), json.loads(r["notes"])) for v, r in latest.items()]


def _commit(spark: SparkSession, path: str, kind: str, payload: str, inputs: Mapping[str, str], notes: Mapping | None) -> int:
    version = max((m.version for m in manifests(spark, path)), default=0) + 1
    row = (FORMAT, version, kind, payload, json.dumps(dict(inputs)), json.dumps(dict(notes or {})))
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifests")
    return version


def find(spark: SparkSession, path: str, kind: str, version: int | None = None, scored: DataFrame | None = None) -> Manifest:
    """The manifest of a version, checked against its kind and the table to be scored."""
    known = manifests(spark, path)
    chosen = [m for m in known if version is None or m.version == version]
    if not chosen:
        raise FileNotFoundError(f"{path} holds no model" + ("" if version is None else f" of version {version}"))
    found = chosen[-1]
    if found.kind != kind:
        raise ModelMismatch(f"{path} version {found.version} is a {found.kind}, not a {kind}")
    if scored is not None:
        types = dict(scored.dtypes)
        wrong = [f"{c}: {t} wanted, {types.get(c, 'missing')}" for c, t in found.inputs.items() if types.get(c) != t]
        if wrong:
            raise ModelMismatch(f"{path} version {found.version} does not fit the table: {'; '.join(wrong)}")
    return found


def _inputs(fitted_on: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    types = dict(fitted_on.dtypes)
    return {c: types[c] for c in columns}


def _target(path: str) -> tuple[str, str]:
    name = uuid.uuid4().hex
    return name, f"{path}/payload/{name}"


def save_pipeline(model: PipelineModel, fitted_on: DataFrame, columns: Sequence[str], path: str, notes: Mapping | None = None) -> int:
    """Save a Spark ML pipeline that reads ``columns`` of tables like ``fitted_on``; returns the version."""
    inputs = _inputs(fitted_on, columns)
    name, payload = _target(path)
    model.write().save(payload)
    return _commit(fitted_on.sparkSession, path, "pipeline", name, inputs, notes)


def load_pipeline(spark: SparkSession, path: str, version: int | None = None, scored: DataFrame | None = None) -> PipelineModel:
    found = find(spark, path, "pipeline", version, scored)
    return PipelineModel.load(f"{path}/payload/{found.payload}")


def save_linear(
    models: Sequence[LinearModel], scaler: Scaler, fitted_on: DataFrame, path: str, notes: Mapping | None = None
) -> int:
    """Save linear models with the scaler of their features, so that unscaled rows can be scored later.

    ``fitted_on`` is the table before scaling. Coefficients and statistics are rows of
    doubles: nothing is rounded.
    """
    lacking = {f for m in models for f in m.coefficients} - set(scaler.statistics)
    if lacking:
        raise ValueError(f"the scaler lacks {sorted(lacking)}")
    spark = fitted_on.sparkSession
    inputs = _inputs(fitted_on, list(scaler.statistics))
    name, payload = _target(path)
    _write_scaler(spark, scaler, f"{payload}/scaler")
    rows = [
        (m.number, m.name, place, feature, float(value))
        for m in models
        for place, (feature, value) in enumerate([(None, m.intercept), *m.coefficients.items()])
    ]
    spark.createDataFrame(rows, _LINEAR).coalesce(1).write.parquet(f"{payload}/models")
    return _commit(spark, path, "linear", name, inputs, notes)


def load_linear(
    spark: SparkSession, path: str, version: int | None = None, scored: DataFrame | None = None
) -> tuple[list[LinearModel], Scaler]:
    """The models in the order of their numbers, and the scaler to apply first."""
    payload = f"{path}/payload/{find(spark, path, 'linear', version, scored).payload}"
    rows = spark.read.schema(_LINEAR).parquet(f"{payload}/models").orderBy("number", "name", "place").collect()
    parts: dict[tuple[int, str], list] = {}
    for r in rows:
        parts.setdefault((r["number"], r["name"]), []).append((r["feature"], r["value"]))
    models = [LinearModel(number, name, values[0][1], dict(values[1:])) for (number, name), values in parts.items()]
    return models, _read_scaler(spark, f"{payload}/scaler")


def save_scaler(scaler: Scaler, fitted_on: DataFrame, path: str, notes: Mapping | None = None) -> int:
    spark = fitted_on.sparkSession
    inputs = _inputs(fitted_on, list(scaler.statistics))
    name, payload = _target(path)
    _write_scaler(spark, scaler, payload)
    return _commit(spark, path, "scaler", name, inputs, notes)


def load_scaler(spark: SparkSession, path: str, version: int | None = None, scored: DataFrame | None = None) -> Scaler:
    return _read_scaler(spark, f"{path}/payload/{find(spark, path, 'scaler', version, scored).payload}")


def _write_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    rows = [(place, c, *values) for place, (c, values) in enumerate(scaler.statistics.items())]
    spark.createDataFrame(rows, _SCALER).coalesce(1).write.parquet(path)


def _read_scaler(spark: SparkSession, path: str) -> Scaler:
    rows = spark.read.schema(_SCALER).parquet(path).orderBy("place").collect()
    return Scaler({r["feature"]: (r["mean"], r["deviation"]) for r in rows})


def save_profiles(profiles: DataFrame, text_type: str, text_col: str, path: str, notes: Mapping | None = None) -> int:
    """Save language profiles, of all words or of slots: any size, written by the tasks that hold them."""
    name, payload = _target(path)
    profiles.write.parquet(payload)
    kept = {"columns": profiles.columns, **(notes or {})}
    return _commit(profiles.sparkSession, path, "profiles", name, {text_col: text_type}, kept)


def load_profiles(spark: SparkSession, path: str, version: int | None = None, scored: DataFrame | None = None) -> DataFrame:
    """The profiles as a table whose languages stand in the order of the fit: ties go to the first."""
    found = find(spark, path, "profiles", version, scored)
    return spark.read.parquet(f"{path}/payload/{found.payload}").select(*[F.col(c) for c in found.notes["columns"]])
