"""The views that catalogue queries share, with the SQL that builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoplan.functions import fields as f
from sonoplan.functions.text import tidy
from sonoplan.sources.tables import table

_EDGE = r"^[\s\x{a0}]+|[\s\x{a0}]+$"


def tidy_sql(c: str) -> str:
    return f"regexp_replace({c}, '{_EDGE}', '', 'g')"


def scalar_sql(c: str) -> str:
    t = tidy_sql(c)
    return rf"CASE WHEN lower({t}) IN ('', 'null', 'nan', 'none', '<na>') THEN NULL WHEN regexp_full_match({t}, '-?[0-9]+\.0+') THEN regexp_replace({t}, '\.0+$', '') ELSE {t} END"


def language_sql(c: str) -> str:
    token = f"replace(lower({scalar_sql(c)}), '_', '-')"
    known = lambda x: "CASE " + " ".join(f"WHEN {x} IN ({', '.join(repr(a) for a in g)}) THEN '{g[0]}'" for g in f.LANGUAGES) + " END"
    return f"coalesce({known(token)}, {known(f'split_part({token}, chr(45), 1)')}, {token})"


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest in canonical spelling; NaN durations are null. Stored rows are kept as they are, repeated ones too."""
    m = table(spark, folder, "manifest")
    return m.select(
        "sample_id", "source_file", "processed_file", "dataset", "label", f.scalar(F.col("speaker_id")).alias("speaker_id"), f.language(F.col("language")).alias("language"), "gender",
        F.when(~F.isnan("duration"), F.col("duration")).alias("duration"), "sample_rate", "segment_start", f.scalar(F.col("generator")).alias("generator"), f.scalar(F.col("attack_type")).alias("attack_type"),
        f.scalar(F.col("codec")).alias("codec"), F.lower(tidy(F.col("split"))).alias("split"), "load_id", "loaded_at",
    )


SAMPLES = f"""samples AS (
  SELECT sample_id, source_file, processed_file, dataset, label, {scalar_sql('speaker_id')} speaker_id, {language_sql('language')} AS language, gender, CASE WHEN NOT isnan(duration) THEN duration END duration, sample_rate, segment_start,
    {scalar_sql('generator')} generator, {scalar_sql('attack_type')} attack_type, {scalar_sql('codec')} codec, lower({tidy_sql('split')}) AS split, load_id, loaded_at FROM manifest)"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """id, label, score (a made-up score with many ties, between the classes overlapping), language, attack (the source of a synthetic recording)."""
    rows = table(spark, folder, "baseline_rows").select("id", "label", "language", "source").distinct()
    score = F.floor((f.bucket("score", F.col("id"), 600) + 400 * F.col("label")) / 10) / F.lit(100.0)
    return rows.select("id", "label", score.alias("score"), "language", F.when(F.col("label") == 1, F.col("source")).alias("attack"))


def bucket_sql(seed: str, c: str, of: int = 100) -> str:
    return f"(('0x' || substr(sha256('{seed}:' || {c}), 1, 8))::BIGINT % {of})"


PREDICTIONS = f"""preds AS (
  SELECT id, label, (({bucket_sql('score', 'id', 600)} + 400 * label) // 10) / 100.0::DOUBLE score, language, CASE WHEN label = 1 THEN source END attack FROM (SELECT DISTINCT id, label, language, source FROM baseline_rows))"""
