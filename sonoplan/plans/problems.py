"""Queries of the general problems 1 and 2, with the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoplan.functions.text import tidy
from sonoplan.operators.quality import Checked, findings, profile
from sonoplan.operators.skew import aggregate_by_key, frequent_values
from sonoplan.sources.tables import table

#: A key counts as frequent from this share of the rows on.
FREQUENT = 0.02


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent_values(table(spark, folder, "manifest"), ["generator", "speaker_id"], FREQUENT).select("field_name", "key_value")


def _seconds(name: str) -> F.Column:
    """Seconds as a decimal, whose sum doesn't depend on the order of rows; null for NaN."""
    return F.when(~F.isnan(name), F.col(name)).cast("decimal(20,6)")


def p1_key_results(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, seconds, rows per split and source files of each stored value of generator and of speaker_id."""
    rows = table(spark, folder, "manifest")
    split = F.lower(tidy(F.col("split")))
    is_split = lambda s: F.when(split == s, 1).otherwise(0)
    sums = {"n_rows": F.lit(1), "seconds": _seconds("duration"), "train_rows": is_split("train"), "dev_rows": is_split("dev"), "test_rows": is_split("test")}
    out = None
    for field in ("generator", "speaker_id"):
        one = aggregate_by_key(rows, field, sums, ("n_files", F.col("source_file"))).select(
            F.lit(field).alias("field_name"), F.col(field).alias("key_value"), "n_rows", F.col("seconds").cast("double").alias("seconds"), "train_rows", "dev_rows", "test_rows", "n_files",
        )
        out = one if out is None else out.unionByName(one)
    return out


#: What a well-formed value of each column is.
PLAIN = "^[a-z0-9_]+$"
SPEAKER = "^(indicvoices|indicsynth|asvspoof|mlaad|local)::[0-9]+$"


def _columns() -> list[Checked]:
    return [Checked("duration", between=(0.1, 60.0)), Checked("codec", pattern=PLAIN), Checked("speaker_id", pattern=SPEAKER), Checked("generator", pattern=PLAIN, where=F.col("label") == "spoof")]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    shaped = {"duration", "codec", "generator"}
    return findings(table(spark, folder, "manifest"), "load_id", _columns(), constant=shaped, shift=shaped)


def p2_profile(spark: SparkSession, folder: str) -> DataFrame:
    out = profile(table(spark, folder, "manifest"), "load_id", _columns())
    rounded = ("ks_all", "ks_previous", "tv_all", "q25", "median", "q75")
    return out.select(*(F.round(c, 9).alias(c) if c in rounded else F.col(c) for c in out.columns))


QUERIES = {f.__name__: f for f in (p1_found, p1_key_results, p2_found, p2_profile)}

_MISSING = r"({0} IS NULL OR lower(regexp_replace({0}, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')) IN ('', 'nan', 'none', 'null'))"
_UNPIVOT = f"""
raw AS (
  SELECT load_id, 'duration' column_name, CASE WHEN duration IS NULL OR isnan(duration) THEN 'missing' WHEN duration BETWEEN 0.1 AND 60 THEN 'ok' ELSE 'malformed' END status, CASE WHEN NOT isnan(duration) THEN duration END number, NULL::VARCHAR words FROM manifest
  UNION ALL SELECT load_id, 'codec', CASE WHEN {_MISSING.format('codec')} THEN 'missing' WHEN regexp_matches(codec, '{PLAIN}') THEN 'ok' ELSE 'malformed' END, NULL, codec FROM manifest
  UNION ALL SELECT load_id, 'speaker_id', CASE WHEN {_MISSING.format('speaker_id')} THEN 'missing' WHEN regexp_matches(speaker_id, '{SPEAKER}') THEN 'ok' ELSE 'malformed' END, NULL, speaker_id FROM manifest
  UNION ALL SELECT load_id, 'generator', CASE WHEN {_MISSING.format('generator')} THEN 'missing' WHEN regexp_matches(generator, '{PLAIN}') THEN 'ok' ELSE 'malformed' END, NULL, generator FROM manifest WHERE label = 'spoof'),
cells AS (SELECT load_id, column_name, status, number, CASE WHEN status <> 'missing' THEN words END words, count(*) n FROM raw GROUP BY ALL),
summary AS (
  SELECT column_name, load_id, sum(n)::BIGINT n_rows, coalesce(sum(n) FILTER (status = 'missing'), 0)::BIGINT n_missing, coalesce(sum(n) FILTER (status = 'malformed'), 0)::BIGINT n_malformed, coalesce(sum(n) FILTER (status = 'ok'), 0)::BIGINT n_ok,
    count(*) FILTER (status <> 'missing') n_distinct, min(number) min_number, max(number) max_number, min(words) min_words, max(words) max_words, coalesce(max(n) FILTER (status = 'ok'), 0)::BIGINT n_top FROM cells GROUP BY 1, 2),
ok AS (SELECT * FROM cells WHERE status = 'ok'),
every AS (SELECT column_name, number, words, sum(n) n_all FROM ok GROUP BY ALL),
pooled AS (SELECT *, sum(n_all) OVER (PARTITION BY column_name ORDER BY number, words) cum_all, sum(n_all) OVER (PARTITION BY column_name) total_all FROM every),
curve AS (
  SELECT ok.column_name, ok.load_id, n, n_all, cum_all, total_all, sum(n) OVER (PARTITION BY ok.column_name, ok.load_id ORDER BY ok.number, ok.words) cum, sum(n) OVER (PARTITION BY ok.column_name, ok.load_id) total
  FROM ok JOIN pooled p ON ok.column_name = p.column_name AND ok.number IS NOT DISTINCT FROM p.number AND ok.words IS NOT DISTINCT FROM p.words),
spread AS (
  SELECT column_name, load_id, max(greatest(abs(cum / total - cum_all / total_all), abs((cum - n) / total - (cum_all - n_all) / total_all))) ks_all,
    (sum(abs(n / total - n_all / total_all)) + 1 - sum(n_all / total_all)) / 2 tv_all FROM curve GROUP BY 1, 2),
quartiles AS (SELECT column_name, load_id, quantile_cont(number, 0.25) q25, quantile_cont(number, 0.5) median, quantile_cont(number, 0.75) q75 FROM raw WHERE status = 'ok' GROUP BY 1, 2)"""
_BETWEEN = """,
loads AS (SELECT column_name, load_id, lead(load_id) OVER (PARTITION BY column_name ORDER BY load_id) later FROM (SELECT DISTINCT column_name, load_id FROM ok)),
steps AS (
  SELECT column_name, load_id, number, words, sum(own) own, sum(prev) prev FROM (
    SELECT column_name, load_id, number, words, n own, 0 prev FROM ok
    UNION ALL SELECT ok.column_name, later, number, words, 0, n FROM ok JOIN loads l ON ok.column_name = l.column_name AND ok.load_id = l.load_id WHERE later IS NOT NULL) GROUP BY 1, 2, 3, 4),
walked AS (
  SELECT column_name, load_id, sum(own) OVER w own_cum, sum(prev) OVER w prev_cum, sum(own) OVER (PARTITION BY column_name, load_id) own_total, sum(prev) OVER (PARTITION BY column_name, load_id) prev_total
  FROM steps WINDOW w AS (PARTITION BY column_name, load_id ORDER BY number, words)),
previous AS (SELECT column_name, load_id, max(abs(own_cum / own_total - prev_cum / prev_total)) ks_previous FROM walked WHERE own_total > 0 AND prev_total > 0 GROUP BY 1, 2)"""

SQL = {
    "p1_found": " UNION ALL ".join(
        f"SELECT '{c}' field_name, {c} key_value FROM manifest WHERE NOT {_MISSING.format(c)} GROUP BY {c} HAVING count(*) >= {FREQUENT} * (SELECT count(*) FROM manifest)" for c in ("generator", "speaker_id")
    ),
    "p1_key_results": " UNION ALL ".join(
        f"""SELECT '{c}' field_name, {c} key_value, count(*) n_rows, CAST(sum(CAST(CASE WHEN NOT isnan(duration) THEN duration END AS DECIMAL(20,6))) AS DOUBLE) AS seconds,
        count(*) FILTER (lower(trim(split)) = 'train') train_rows, count(*) FILTER (lower(trim(split)) = 'dev') dev_rows, count(*) FILTER (lower(trim(split)) = 'test') test_rows, count(DISTINCT source_file) n_files
        FROM manifest GROUP BY {c}"""
        for c in ("generator", "speaker_id")
    ),
    "p2_found": f"""WITH {_UNPIVOT},
judged AS (
  SELECT s.load_id, s.column_name, n_missing / n_rows - median(n_missing / n_rows) OVER w extra, n_malformed / nullif(n_rows - n_missing, 0) malformed, n_top / nullif(n_ok, 0) top, q.median m, median(q.median) OVER w usual, tv_all
  FROM summary s LEFT JOIN spread d USING (column_name, load_id) LEFT JOIN quartiles q USING (column_name, load_id) WINDOW w AS (PARTITION BY s.column_name))
SELECT load_id, column_name, 'missing' finding FROM judged WHERE extra > 0.15
UNION ALL SELECT load_id, column_name, CASE WHEN column_name = 'duration' THEN 'range' ELSE 'format' END FROM judged WHERE malformed > 0.12
UNION ALL SELECT load_id, column_name, 'constant' FROM judged WHERE column_name <> 'speaker_id' AND top > 0.7
UNION ALL SELECT load_id, column_name, 'shift' FROM judged WHERE (column_name = 'duration' AND greatest(m / usual, usual / m) > 1.5) OR (column_name IN ('codec', 'generator') AND tv_all > 0.4)""",
    "p2_profile": f"""WITH {_UNPIVOT}{_BETWEEN}
SELECT s.*, round(ks_all, 9) ks_all, round(tv_all, 9) tv_all, round(q25, 9) q25, round(median, 9) median, round(q75, 9) q75, round(ks_previous, 9) ks_previous
FROM summary s LEFT JOIN spread USING (column_name, load_id) LEFT JOIN quartiles USING (column_name, load_id) LEFT JOIN previous USING (column_name, load_id)""",
}
