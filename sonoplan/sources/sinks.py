"""Sinks: manifests, reports, metrics, audio. Tables go through Spark's commit protocol; small control files are written whole and renamed."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoplan.operators import balance, checks, metrics
from sonoplan.operators.audio import encode_wav
from sonoplan.session import durable, exists, write_text
from sonoplan.sources.metadata import MANIFEST, canonical_json


def write_json(path: str, value, spark: SparkSession | None = None) -> None:
    """Sorted keys, no NaN, whole or not at all; with a session in whatever file system the path names."""
    if spark is not None:
        write_text(spark, path, canonical_json(value))
        return
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent)
    with os.fdopen(handle, "w", encoding="utf-8") as out:
        out.write(canonical_json(value))
        out.flush()
        os.fsync(out.fileno())
    os.replace(name, target)


def append_manifest(df: DataFrame, path: str) -> None:
    """Adds checked rows; none, nothing. Illegal labels, and ids that the manifest holds already, are errors."""
    gone = set(MANIFEST) - set(df.columns)
    if gone:
        raise ValueError(f"missing columns: {sorted(gone)}")
    rows = df.select(*MANIFEST)
    if rows.isEmpty():
        return
    if not checks.label_violations(rows).isEmpty() or not rows.where("sample_id IS NULL OR dataset IS NULL").isEmpty():
        raise ValueError("illegal label, or no sample_id or dataset")
    both = rows.select("dataset", "sample_id")
    if exists(df.sparkSession, path):
        both = both.unionByName(df.sparkSession.read.parquet(path).select("dataset", "sample_id"))
    if not both.groupBy("dataset", "sample_id").count().where("count > 1").isEmpty():
        raise ValueError("a sample_id would stand twice")
    rows.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """A small report as one CSV; an existing one is an error."""
    df.orderBy(*order).coalesce(1).write.mode("error").option("header", True).csv(path)


def write_reports(df: DataFrame, folder: str) -> None:
    """The five balance tables as CSV, and a summary."""
    sets = durable(balance.balance_sets(df))
    for name, fields in {"label": ["label"], "label,language": ["label", "language"], "label,speaker_id": ["label", "speaker_id"], "generator": ["generator"], "language,generator": ["language", "generator"]}.items():
        write_csv(sets.where(F.col("table_name") == name).select(*fields, *balance.MEASURES), f"{folder}/balance_{name.replace(',', '_')}", fields)
    told: dict[str, dict] = {}
    for r in balance.summary(df, ["dataset", "label", "language", "gender", "codec", "generator", "split", "sample_rate"]).collect():
        told.setdefault(r["section"], {})[r["name"]] = r["value"]
    write_json(f"{folder}/summary.json", told, df.sparkSession)


def write_metrics(scored: DataFrame, folder: str) -> None:
    """metrics.json, and the tables metrics, per_class, calibration_bins, roc_points and precision_recall_points of (label, score) as CSV; an existing folder is an error."""
    scores = metrics.score_table(scored)
    parts = (metrics.derived(metrics.confusion(scored)), metrics.roc_auc(scores), metrics.average_precision(scores), metrics.probability_losses(scored), metrics.calibration_error(metrics.reliability(scored)))
    values = {k: v for part in parts for k, v in part.first().asDict().items()}
    spark = scored.sparkSession
    write_csv(spark.createDataFrame([(k, None if v is None else float(v)) for k, v in values.items()], "metric string, value double"), f"{folder}/metrics", ["metric"])
    tn, fp, fn, tp = (values[k] for k in ("tn", "fp", "fn", "tp"))
    share = lambda a, b: a / b if b else None
    classes = [("genuine", share(tn, tn + fn), share(tn, tn + fp), share(2 * tn, 2 * tn + fn + fp), tn + fp), ("synthetic", share(tp, tp + fp), share(tp, tp + fn), share(2 * tp, 2 * tp + fp + fn), tp + fn)]
    write_csv(spark.createDataFrame(classes, "class_name string, precision double, recall double, f1 double, support bigint"), f"{folder}/per_class", ["class_name"])
    write_csv(metrics.reliability(scored), f"{folder}/calibration_bins", ["bin"])
    write_csv(metrics.roc_points(scores), f"{folder}/roc_points", ["threshold"])
    write_csv(metrics.pr_points(scores), f"{folder}/precision_recall_points", ["threshold"])
    write_json(f"{folder}/metrics.json", values, spark)


def write_audio(df: DataFrame, folder: str, key: str, samples: str, rate: int) -> DataFrame:
    """key, file of each written clip: 16-bit WAV, written by the tasks to a folder that all share."""

    def run(batches):
        Path(folder).mkdir(parents=True, exist_ok=True)
        for b in batches:
            names = []
            for k, x in zip(b["key"], b["x"]):
                name = f"{folder}/{k}.wav"
                partial = f"{name}.{os.getpid()}"
                Path(partial).write_bytes(encode_wav(np.asarray(x, np.float32), rate))
                os.replace(partial, name)
                names.append(name)
            yield b[["key"]].assign(file=names)

    return df.select(F.col(key).cast("string").alias("key"), F.col(samples).alias("x")).mapInPandas(run, "key string, file string")
