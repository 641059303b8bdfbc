"""Balance of a recording table: counts, seconds and speakers by group, frequencies, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoplan.operators.quality import curves, distribution, placed_values
from sonoplan.session import durable

EXACT = "decimal(20,6)"


def seconds(c: Column | str) -> Column:
    """Sum of seconds through decimals, so that the order of rows doesn't show in the last digits. Null if all are null."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(EXACT)).cast("double")


MEASURES = ["clips", "known_duration_clips", "duration_seconds", "unique_speakers"]


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("clips"), F.count("duration").alias("known_duration_clips"), seconds("duration").alias("duration_seconds"), F.countDistinct("speaker_id").alias("unique_speakers")]


def balance_table(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per combination, nulls included: clips, clips with known duration, seconds, hours, missing durations, distinct speakers."""
    out = df.groupBy(*fields).agg(*_measures())
    return out.select(*fields, *MEASURES, (F.col("duration_seconds") / 3600).alias("duration_hours"), (F.col("clips") - F.col("known_duration_clips")).alias("missing_duration_clips"))


def balance_sets(df: DataFrame) -> DataFrame:
    """The five report tables in one pass over grouping sets; set_no names the table, generator tables are of spoof only."""
    view = "sonoplan_balance"
    df.createOrReplaceTempView(view)
    spark = df.sparkSession
    measures = "count(*) clips, count(duration) known_duration_clips, CAST(sum(CAST(duration AS DECIMAL(20,6))) AS DOUBLE) duration_seconds, count(DISTINCT speaker_id) unique_speakers"
    all_rows = spark.sql(f"SELECT grouping_id(label, language, speaker_id) g, label, language, speaker_id, CAST(NULL AS STRING) generator, {measures} FROM {view} GROUP BY GROUPING SETS ((label), (label, language), (label, speaker_id))".replace("count(DISTINCT speaker_id)", "count(DISTINCT speaker)").replace(f"FROM {view}", f"FROM (SELECT *, speaker_id speaker FROM {view})"))
    spoof = spark.sql(f"SELECT grouping_id(generator, language) g, CAST(NULL AS STRING) label, language, CAST(NULL AS STRING) speaker_id, generator, {measures} FROM {view} WHERE label = 'spoof' GROUP BY GROUPING SETS ((generator), (language, generator))")
    names = {3: "label", 1: "label,language", 2: "label,speaker_id"}
    name = F.coalesce(*(F.when(F.col("g") == k, v) for k, v in names.items()))
    return all_rows.withColumn("table_name", name).unionByName(spoof.withColumn("table_name", F.when(F.col("g") == 1, "generator").otherwise("language,generator"))).drop("g")


def numeric_stats(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """known, missing, total, mean, exact median, min, max; NaN counts as missing; all null where nothing is known.

    The medians are read off counted values in sorted blocks, so that no task holds all values of a group."""
    by = by or []
    x = F.when(~F.isnan(column), F.col(column))
    total = seconds(x)
    group = F.struct(*by) if by else F.lit(True)
    counts = df.select(group.alias("load_id"), x.cast("double").alias("number")).where("number IS NOT NULL").groupBy("load_id", "number").agg(F.count(F.lit(1)).alias("n"))
    shaped = counts.select(F.lit(column).alias("column_name"), "load_id", F.lit("ok").alias("status"), "number", F.lit(None).cast("string").alias("words"), "n")
    medians = distribution(curves(placed_values(durable(shaped)))).select(F.col("load_id").alias("__group"), "median")
    out = df.groupBy(*by).agg(F.count(x).alias("known"), (F.count(F.lit(1)) - F.count(x)).alias("missing"), total.alias("total"), (total / F.nullif(F.count(x), F.lit(0))).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"))
    return out.join(medians, group.eqNullSafe(F.col("__group")), "left").select(*by, "known", "missing", "total", "mean", "median", "minimum", "maximum")


def summary(df: DataFrame, categories: list[str], refuse: bool = True) -> DataFrame:
    """section, name, value of a whole table: rows, source files, speakers; statistics of durations and hours; frequencies of each category, `missing` beside them.

    A negative duration is an error unless refuse is False. A category that isn't there is missing everywhere; an empty table gives counts of 0."""
    df = durable(df.select("source_file", "speaker_id", "duration", *(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in categories if c not in ("source_file", "speaker_id", "duration"))))
    if refuse and not df.where("duration < 0").isEmpty():
        raise ValueError("negative duration")
    stats = numeric_stats(df, "duration").withColumn("total_hours", F.col("total") / 3600)
    counts = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count("source_file").alias("known_source_files"), F.countDistinct("speaker_id").alias("unique_speakers"), F.count(F.when(F.col("speaker_id").isNull(), 1)).alias("missing_speaker_rows"))
    long = lambda d, section: d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in d.columns))).alias("x")).select(F.lit(section).alias("section"), "x.*")
    each = frequencies(df, categories).select(F.concat(F.lit("distribution:"), "field").alias("section"), F.coalesce("value", F.lit("missing")).alias("name"), F.col("n").cast("double").alias("value"))
    return long(counts, "rows").unionByName(long(stats, "duration")).unionByName(each)


def histogram(df: DataFrame, column: str, by: str, bins: int = 20) -> DataFrame:
    """by, bin, low, high, n: counts in equal bins that all groups share, from the least to the greatest known value; the last bin holds its upper end. Empty bins give no row."""
    x = F.when(~F.isnan(column), F.col(column).cast("double"))
    ends = df.agg(F.min(x), F.max(x)).first()
    low, high = ends if ends[0] is not None else (0.0, 0.0)
    width = (high - low) / bins or 1.0
    place = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(x.isNotNull()).groupBy(by, place.alias("bin")).agg(F.count(F.lit(1)).alias("n")).select(by, "bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), "n")


def frequencies(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, value, n of each value of each field, null values included."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)))
    return df.select(cells.alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("n"))


def languages_of(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def flag_share(df: DataFrame, flag: Column) -> DataFrame:
    """Percent of true over known, known and missing."""
    return df.agg((F.lit(100.0) * F.count(F.when(flag, 1)) / F.nullif(F.count(flag), F.lit(0))).alias("percent"), F.count(flag).alias("known"), (F.count(F.lit(1)) - F.count(flag)).alias("missing"))


def column_preview(df: DataFrame) -> DataFrame:
    """column_name, n_known: cells of each column that are neither null nor empty text."""
    seen = [F.count(F.when(F.col(f"`{n}`").isNotNull() & ((F.col(f"`{n}`") != "") if t == "string" else F.lit(True)), 1)).alias(n) for n, t in df.dtypes]
    row = df.agg(*seen)
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column_name"), F.col(f"`{n}`").alias("n_known")) for n in df.columns))).alias("x")).select("x.*")
