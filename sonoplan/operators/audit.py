"""Bias audit between two classes: missing rates, distribution distances, ratios, dominance, confounding, severities."""

from __future__ import annotations

from dataclasses import dataclass
from math import isfinite

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoplan.operators.balance import EXACT, seconds
from sonoplan.session import durable

CLASSES = ("bonafide", "spoof")


@dataclass(frozen=True)
class Thresholds:
    """medium and high limits."""

    categorical: tuple[float, float] = (0.20, 0.50)
    duration_ratio: tuple[float, float] = (1.25, 2.0)
    speaker_share: tuple[float, float] = (0.10, 0.25)
    generator_share: tuple[float, float] = (0.60, 0.80)
    rms_gap: tuple[float, float] = (0.03, 0.10)
    missing: tuple[float, float] = (0.20, 0.80)

    def __post_init__(self) -> None:
        for name, (medium, high) in vars(self).items():
            if not (isfinite(medium) and isfinite(high)) or medium < 0 or medium >= high:
                raise ValueError(f"{name}: the medium limit must be from 0 on and below the high one")
            if name not in ("duration_ratio", "rms_gap") and high > 1:
                raise ValueError(f"{name}: shares are at most 1")
        if self.duration_ratio[0] <= 1:
            raise ValueError("duration_ratio: ratios must exceed 1")


def severity(value: Column, limits: tuple[float, float]) -> Column:
    return F.when(value >= limits[1], "HIGH").when(value >= limits[0], "MEDIUM").otherwise("LOW")


def missing_rates(df: DataFrame, columns: list[str], class_only: dict[str, str]) -> DataFrame:
    """column_name, label, rate of null cells, 1 for a column that isn't there; class_only: columns that are judged in one class."""
    gone = lambda c: F.col(c).isNull() if c in df.columns else F.lit(True)
    cells = [F.struct(F.lit(c).alias("column_name"), gone(c).alias("gone")) for c in columns if c not in class_only]
    alone = [F.when(F.col("label") == k, F.struct(F.lit(c).alias("column_name"), gone(c).alias("gone"))) for c, k in class_only.items()]
    flat = df.where(F.col("label").isin(*CLASSES)).select("label", F.explode(F.array_compact(F.array(*cells, *alone))).alias("x"))
    return flat.groupBy("x.column_name", "label").agg((F.count(F.when(F.col("x.gone"), 1)) / F.count(F.lit(1))).alias("rate"))


def class_distances(df: DataFrame, columns: list[str], weight: str | None = None) -> DataFrame:
    """column_name, distance: total variation between the classes' shares of known values, by clips or by a weight. Null where a class has none; columns that aren't there are left out."""
    columns = [c for c in columns if c in df.columns]
    w = F.lit(1).cast(EXACT) if weight is None else F.col(weight).cast(EXACT)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns)))
    flat = df.where(F.col("label").isin(*CLASSES)).select("label", w.alias("w"), cells.alias("x")).where("x.value IS NOT NULL AND w IS NOT NULL")
    by_value = flat.groupBy("x.column_name", "x.value").agg(*(F.coalesce(F.sum(F.when(F.col("label") == k, F.col("w"))), F.lit(0)).cast("double").alias(k) for k in CLASSES))
    totals = by_value.groupBy("column_name").agg(*(F.sum(k).alias(f"all_{k}") for k in CLASSES))
    a, b = (F.col(k) / F.nullif(F.col(f"all_{k}"), F.lit(0.0)) for k in CLASSES)
    return by_value.join(totals, "column_name").groupBy("column_name").agg((F.sum(F.abs(a - b)) / 2).alias("distance"))


def mean_ratio(df: DataFrame, column: str) -> DataFrame:
    """mean of each class, ratio of the larger to the smaller (1 if both are 0, null if one is), gap."""
    mean = lambda k: seconds(F.when(F.col("label") == k, F.col(column))) / F.nullif(F.count(F.when(F.col("label") == k, F.col(column))), F.lit(0))
    a, b = F.col("mean_bonafide"), F.col("mean_spoof")
    low, high = F.least(a, b), F.greatest(a, b)
    known = a.isNotNull() & b.isNotNull()
    ratio = F.when(known & (low > 0), high / F.nullif(low, F.lit(0.0))).when(known & (high == 0), 1.0)
    return df.agg(mean("bonafide").alias("mean_bonafide"), mean("spoof").alias("mean_spoof")).select("*", ratio.alias("ratio"), F.abs(a - b).alias("gap"))


def mean_gap(df: DataFrame, column: str) -> DataFrame:
    """mean of each class, and their distance; null where a class has none."""
    mean = lambda k: F.avg(F.when(F.col("label") == k, F.col(column).cast("double")))
    return df.agg(mean("bonafide").alias("mean_bonafide"), mean("spoof").alias("mean_spoof")).select("*", F.abs(F.col("mean_bonafide") - F.col("mean_spoof")).alias("gap"))


def audit_state(df: DataFrame) -> DataFrame:
    """status: `audited`, or `insufficient_data` where a class has no row and findings() gives none."""
    return df.agg(F.when(F.countDistinct(F.when(F.col("label").isin(*CLASSES), F.col("label"))) == 2, "audited").otherwise("insufficient_data").alias("status"))


def dominance(df: DataFrame, key: str, by: str = "label") -> DataFrame:
    """by, clip_share, duration_share of the largest known key."""
    groups = df.where(F.col(key).isNotNull()).groupBy(by, key).agg(F.count(F.lit(1)).alias("n"), seconds("duration").alias("s"))
    total = F.sum(F.col("s").cast(EXACT)).cast("double")
    return groups.groupBy(by).agg((F.max("n") / F.sum("n")).alias("clip_share"), F.when(total > 0, F.max("s") / total).alias("duration_share"))


def confounding(df: DataFrame) -> DataFrame:
    """n_datasets, n_single, confounded: whether there are several datasets and each has one class only."""
    per = df.groupBy("dataset").agg(F.countDistinct("label").alias("k"))
    return per.agg(F.count(F.lit(1)).alias("n_datasets"), F.count(F.when(F.col("k") == 1, 1)).alias("n_single")).select("*", ((F.col("n_datasets") > 1) & (F.col("n_single") == F.col("n_datasets"))).alias("confounded"))


def one_class_values(df: DataFrame, column: str) -> DataFrame:
    """value, found_in: common, only_a (bonafide), only_b (spoof)."""
    known = df.where(F.col(column).isNotNull() & F.col("label").isin(*CLASSES))
    a, b = (known.where(F.col("label") == k).select(F.col(column).alias("value")) for k in CLASSES)
    tag = lambda d, t: d.withColumn("found_in", F.lit(t))
    return tag(a.intersect(b), "common").unionByName(tag(a.distinct().exceptAll(b.distinct()), "only_a")).unionByName(tag(b.distinct().exceptAll(a.distinct()), "only_b"))


#: Columns whose missing cells are judged, and those whose distribution is; generator is judged in one class.
RATED = ("duration", "sample_rate", "codec", "file_format", "language", "gender", "speaker_id", "rms")
SHAPE = ("sample_rate", "channels", "codec", "file_format", "language", "gender")


def findings(df: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """code, value, severity of all findings that the columns allow, low ones included; none where a class has no row.

    df: label, dataset, duration, speaker_id, generator, and any of RATED and SHAPE. It is read once."""
    used = [c for c in dict.fromkeys(("label", "dataset", "generator", *RATED, *SHAPE)) if c in df.columns]
    df = durable(df.select(*used))
    if audit_state(df).first()["status"] != "audited":
        return df.sparkSession.createDataFrame([], "code string, value double, severity string")
    one = lambda d, code, value, band: d.select(code.alias("code"), value.cast("double").alias("value"), severity(value, band).alias("severity")).where("value IS NOT NULL")
    missing = missing_rates(df, list(RATED), {"generator": "spoof"}).groupBy("column_name").agg(F.max("rate").alias("v"))
    apart = class_distances(df, list(SHAPE)).unionByName(class_distances(df, list(SHAPE), "duration")).groupBy("column_name").agg(F.max("distance").alias("v"))
    out = one(missing, F.concat(F.lit("missing_"), "column_name"), F.col("v"), limits.missing).unionByName(one(apart, F.col("column_name"), F.col("v"), limits.categorical))
    classes = df.where(F.col("language").isNotNull() & F.col("label").isin(*CLASSES)).groupBy("language").agg((F.min("label") == F.max("label")).alias("single"))
    out = out.unionByName(one(classes.agg(F.max("single").alias("some")).where("some"), F.lit("one_class_language"), F.lit(1.0), limits.categorical))
    means = mean_ratio(df, "duration").where("mean_bonafide IS NOT NULL AND mean_spoof IS NOT NULL")
    out = out.unionByName(one(means, F.lit("duration"), F.coalesce("ratio", F.lit(limits.duration_ratio[1])), limits.duration_ratio))
    largest = F.greatest("clip_share", "duration_share")
    for key, band, rows in (("speaker_id", limits.speaker_share, df), ("generator", limits.generator_share, df.where("label = 'spoof'"))):
        out = out.unionByName(one(dominance(rows.where(F.col("label").isin(*CLASSES)), key), F.concat(F.lit(f"{key}_dominance_"), "label"), largest, band))
    if "rms" in df.columns:
        out = out.unionByName(one(mean_gap(df, "rms"), F.lit("loudness_rms"), F.col("gap"), limits.rms_gap))
    return out.unionByName(one(confounding(df).where("confounded"), F.lit("dataset_class_confounding"), F.lit(1.0), limits.categorical))
