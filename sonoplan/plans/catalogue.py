"""Queries of the operators over recordings, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoplan.functions import fields as f

from sonoplan.functions.text import digest_key
from sonoplan.operators import audit, balance, checks, metrics, sampling, splits
from sonoplan.plans.views import PREDICTIONS, SAMPLES, bucket_sql, language_sql, predictions, samples, scalar_sql, tidy_sql
from sonoplan.sources.metadata import lookup
from sonoplan.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 9) for n in names})


# balance -------------------------------------------------------------------------------------------------------------

_SECONDS = "CAST(sum(CAST(duration AS DECIMAL(20,6))) AS DOUBLE)"
_MEASURES = f"count(*) clips, count(duration) known_duration_clips, {_SECONDS} duration_seconds, count(DISTINCT speaker_id) unique_speakers"


@query(f"WITH {SAMPLES} SELECT label, language, {_MEASURES}, round({_SECONDS} / 3600, 9) duration_hours, count(*) - count(duration) missing_duration_clips FROM samples GROUP BY label, language")
def q01_balance(spark, folder):
    return _round(balance.balance_table(samples(spark, folder), ["label", "language"]), "duration_hours")


@query(
    f"WITH {SAMPLES} "
    + " UNION ALL ".join(
        f"SELECT '{n}' table_name, {', '.join(c if c in n.split(',') else f'NULL::VARCHAR AS {c}' for c in ('label', 'language', 'speaker_id', 'generator'))}, {_MEASURES} FROM samples {w} GROUP BY {n}"
        for n, w in (("label", ""), ("label,language", ""), ("label,speaker_id", ""), ("generator", "WHERE label = 'spoof'"), ("language,generator", "WHERE label = 'spoof'"))
    )
)
def q02_balance_sets(spark, folder):
    return balance.balance_sets(samples(spark, folder))


_STATS = f"count(duration) known, count(*) - count(duration) missing, {_SECONDS} total, round({_SECONDS} / nullif(count(duration), 0), 9) mean, median(duration) median, min(duration) minimum, max(duration) maximum"


@query(f"WITH {SAMPLES} SELECT {_STATS} FROM samples")
def q03_duration_stats(spark, folder):
    return _round(balance.numeric_stats(samples(spark, folder), "duration"), "mean")


@query(f"WITH {SAMPLES} SELECT label, generator, {_STATS} FROM samples GROUP BY label, generator")
def q04_duration_stats_by_class(spark, folder):
    return _round(balance.numeric_stats(samples(spark, folder), "duration", ["label", "generator"]), "mean")


_FIELDS = ["label", "language", "gender", "codec", "generator", "attack_type", "split", "sample_rate"]


@query(f"WITH {SAMPLES} " + " UNION ALL ".join(f"SELECT '{c}' field, {c}::VARCHAR AS value, count(*) n FROM samples GROUP BY {c}" for c in _FIELDS))
def q05_frequencies(spark, folder):
    return balance.frequencies(samples(spark, folder), _FIELDS)


@query(f"WITH {SAMPLES} SELECT generator, coalesce(string_agg(DISTINCT language, ',' ORDER BY language), '') languages FROM samples WHERE generator IS NOT NULL GROUP BY generator")
def q06_languages_of_generators(spark, folder):
    return balance.languages_of(samples(spark, folder), "generator")


@query(f"WITH {SAMPLES} SELECT round(100.0::DOUBLE * count(*) FILTER (duration < 2) / nullif(count(duration), 0), 9) percent, count(duration) known, count(*) - count(duration) missing FROM samples")
def q07_short_share(spark, folder):
    return _round(balance.flag_share(samples(spark, folder), F.col("duration") < 2), "percent")


# fields --------------------------------------------------------------------------------------------------------------

_IDENTITY = rf"CASE WHEN lower({tidy_sql('speaker_id')}) NOT IN ('', 'nan', 'none', 'null') THEN regexp_replace({tidy_sql('speaker_id')}, '^(-?[0-9]+)\.0+$', '\1') END"


@query(f"SELECT {scalar_sql('speaker_id')} scalar_value, {_IDENTITY} identity_value, count(*) n FROM indicvoices GROUP BY 1, 2")
def q08_scalars(spark, folder):
    rows = table(spark, folder, "indicvoices")
    return rows.groupBy(f.scalar(F.col("speaker_id")).alias("scalar_value"), f.identity(F.col("speaker_id")).alias("identity_value")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT lang typed, {language_sql('lang')} AS language, count(*) n FROM indicvoices GROUP BY 1, 2")
def q09_languages(spark, folder):
    return table(spark, folder, "indicvoices").groupBy(F.col("lang").alias("typed"), f.language(F.col("lang")).alias("language")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH v AS (SELECT event_id, json_extract_string(props, '$.k') t, CASE WHEN value IS NULL THEN NULL ELSE value END d FROM events),
    s AS (SELECT CASE WHEN t IS NULL OR t = '' THEN 'missing' WHEN try_cast(t AS DOUBLE) IS NULL THEN 'text' WHEN try_cast(t AS DOUBLE) < 0 THEN 'negative' WHEN try_cast(t AS DOUBLE) <= 0 THEN 'not_positive_integer' ELSE 'ok' END integer_state,
      CASE WHEN d IS NULL OR isnan(d) THEN 'missing' WHEN isinf(d) THEN 'not_finite' WHEN d < 0 THEN 'negative' ELSE 'ok' END number_state FROM v)
    SELECT integer_state, number_state, count(*) n FROM s GROUP BY 1, 2"""
)
def q10_number_states(spark, folder):
    rows = table(spark, folder, "events").select(F.get_json_object("props", "$.k").alias("t"), "value")
    return rows.groupBy(f.number_state(F.col("t"), integer=True).alias("integer_state"), f.number_state(F.col("value")).alias("number_state")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT coalesce(json_extract_string(props, '$.\"missing.key\"'), json_extract_string(props, '$.k')) first_known, json_extract_string(props, '$.a.b') nested, count(*) n FROM events GROUP BY 1, 2")
def q11_alias_lookup(spark, folder):
    row = F.parse_json("props")
    rows = table(spark, folder, "events").select(F.coalesce(lookup(row, "missing.key"), lookup(row, "k")).alias("first_known"), lookup(row, "a.b").alias("nested"))
    return rows.groupBy("first_known", "nested").agg(F.count(F.lit(1)).alias("n"))


_STEM = r"regexp_replace(regexp_replace(regexp_extract(replace(source_file, '\', '/'), '([^/]*)$', 1), '(.)\.[^.]*$', '\1'), '[^\p{L}\p{N}_-]', '_', 'g')"


@query(
    f"""SELECT DISTINCT {_STEM} || '__' || printf('%.3f', segment_start) || '_' || printf('%.3f', segment_end) window_id, dataset || '__' || substr(sha256(coalesce(nullif(source_file, ''), sample_id)), 1, 24) made_id FROM manifest WHERE segment_start IS NOT NULL AND segment_end IS NOT NULL AND dataset IS NOT NULL"""
)
def q12_identifiers(spark, folder):
    rows = table(spark, folder, "manifest").where("segment_start IS NOT NULL AND segment_end IS NOT NULL AND dataset IS NOT NULL")
    made = f.made_id(F.col("dataset"), F.nullif(F.col("source_file"), F.lit("")), F.col("sample_id"))
    return rows.select(f.window_id(F.col("source_file"), F.col("segment_start"), F.col("segment_end")).alias("window_id"), made.alias("made_id")).distinct()


_PATHS = ["a/b.WAV?x=1", "c/.hidden", "d", "https://h.example/x/y.flac#t", "e\\f.Mp3", "g."]
_STEP = r"regexp_replace(regexp_replace(replace(p, '\', '/'), '[?#].*$', ''), '^.*/', '')"


@query(
    f"""WITH paths AS (SELECT source_file p FROM manifest UNION ALL SELECT unnest([{', '.join(repr(x).replace(chr(92) * 2, chr(92)) for x in _PATHS)}]))
    SELECT nullif(lower(regexp_extract({_STEP}, '[^.]\\.([^.]+)$', 1)), '') file_format, count(*) n FROM paths GROUP BY 1"""
)
def q13_file_formats(spark, folder):
    paths = table(spark, folder, "manifest").select(F.col("source_file").alias("p")).unionByName(spark.createDataFrame([(x,) for x in _PATHS], "p string"))
    return paths.groupBy(f.file_format(F.lit(None).cast("string"), F.col("p")).alias("file_format")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT CASE WHEN NOT regexp_full_match(c_name, 'Customer#[0-9]{9}') THEN 'bad_id' WHEN c_nationkey NOT BETWEEN 0 AND 24 THEN 'bad_nation' WHEN c_acctbal < 0 THEN 'negative' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'other_segment' END reason, count(*) n FROM customer GROUP BY 1"""
)
def q14_contract_reasons(spark, folder):
    reasons = {"bad_id": ~F.col("c_name").rlike("^Customer#[0-9]{9}$"), "bad_nation": ~F.col("c_nationkey").between(0, 24), "negative": F.col("c_acctbal") < 0, "other_segment": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")}
    return table(spark, folder, "customer").groupBy(checks.first_reason(reasons).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_FLAT = r"replace(source_file, '\', '/')"


@query(
    rf"""WITH p AS (SELECT {_FLAT} x, string_split({_FLAT}, '/') s FROM manifest),
    k AS (SELECT regexp_extract(x, '([^/]*)$', 1) base, CASE WHEN len(list_filter(s, lambda y: y IN ('real', 'fake'))) = 1 AND NOT list_contains(s, '..')
      THEN regexp_replace(array_to_string(s[greatest(coalesce(list_position(s, 'real'), 0), coalesce(list_position(s, 'fake'), 0)):], '/'), '(\.[^./]*)?$', '.wav') END original FROM p)
    SELECT original, base, count(*) n FROM k GROUP BY 1, 2"""
)
def q15_original_keys(spark, folder):
    rows = table(spark, folder, "manifest")
    return rows.groupBy(f.original_key(F.col("source_file"), ("real", "fake")).alias("original"), f.basename(F.col("source_file")).alias("base")).agg(F.count(F.lit(1)).alias("n"))


_TEXT_KEY = "nullif(regexp_replace(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\\s]+', ' ', 'g'), '^[\\s\\x{a0}]+|[\\s\\x{a0}]+$', '', 'g'), '')"


@query("SELECT doc_id, sha256(text) AS raw_key, n_chars, text IS NULL AS is_null FROM documents")
def q16_text_digests(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("raw_key"), "n_chars", F.col("text").isNull().alias("is_null"))


@query()
def q16_text_keys(spark, folder):
    """The raw and the normalised digest of each text. (No SQL: the engine's lower() is no case folding; tested against the reference's rule.)"""
    return table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("raw_key"), f.text_key(F.col("text")).alias("text_key"))


_MANIFEST_TEXT = ["sample_id", "source_file", "speaker_id", "language", "gender", "generator", "codec", "split"]


@query(" UNION ALL ".join(f"SELECT '{c}' column_name, count(*) FILTER ({c} IS NOT NULL AND {c} <> '') n_known FROM manifest" for c in _MANIFEST_TEXT) + " UNION ALL SELECT 'duration', count(duration) FROM manifest")
def q17_column_preview(spark, folder):
    return balance.column_preview(table(spark, folder, "manifest").select(*_MANIFEST_TEXT, "duration"))


# audit ---------------------------------------------------------------------------------------------------------------

_RATED = ["duration", "sample_rate", "codec", "language", "gender", "speaker_id"]


def _rates_sql(columns: list[str]) -> str:
    rates = [f"SELECT '{c}' column_name, label, count(*) FILTER ({c} IS NULL) / count(*) rate FROM samples WHERE label IN ('bonafide', 'spoof') GROUP BY label" for c in columns]
    return " UNION ALL ".join([*rates, "SELECT 'generator', label, count(*) FILTER (generator IS NULL) / count(*) FROM samples WHERE label = 'spoof' GROUP BY label"])


_RATES = _rates_sql(_RATED) + " UNION ALL SELECT 'channels', label, 1.0::DOUBLE FROM (SELECT DISTINCT label FROM samples WHERE label IN ('bonafide', 'spoof'))"


@query(f"WITH {SAMPLES} SELECT column_name, label, round(rate, 9) rate FROM ({_RATES})")
def q18_missing_rates(spark, folder):
    """Channels aren't stored, so that all of them are missing."""
    return _round(audit.missing_rates(samples(spark, folder), [*_RATED, "channels"], {"generator": "spoof"}), "rate")


_SHAPE = ["sample_rate", "codec", "language", "gender"]


def _distance_sql(weight: str, columns: list[str] = _SHAPE) -> str:
    flat = " UNION ALL ".join(f"SELECT '{c}' column_name, {c}::VARCHAR AS value, label, CAST({weight} AS DECIMAL(20,6)) w FROM samples WHERE {c} IS NOT NULL AND {weight} IS NOT NULL AND label IN ('bonafide', 'spoof')" for c in columns)
    return f"""SELECT column_name, sum(abs(a / ta - b / tb)) / 2 distance FROM (
      SELECT *, sum(a) OVER (PARTITION BY column_name) ta, sum(b) OVER (PARTITION BY column_name) tb FROM (
        SELECT column_name, value, coalesce(sum(w) FILTER (label = 'bonafide'), 0)::DOUBLE a, coalesce(sum(w) FILTER (label = 'spoof'), 0)::DOUBLE b FROM ({flat}) GROUP BY 1, 2)) GROUP BY column_name"""


@query(f"WITH {SAMPLES} SELECT column_name, round(distance, 9) distance FROM ({_distance_sql('1')})")
def q19_distances_by_clips(spark, folder):
    return _round(audit.class_distances(samples(spark, folder), _SHAPE), "distance")


@query(f"WITH {SAMPLES} SELECT column_name, round(distance, 9) distance FROM ({_distance_sql('duration')})")
def q20_distances_by_duration(spark, folder):
    return _round(audit.class_distances(samples(spark, folder), _SHAPE, "duration"), "distance")


_MEANS = "SELECT CAST(sum(CAST(duration AS DECIMAL(20,6))) FILTER (label = 'bonafide') AS DOUBLE) / count(duration) FILTER (label = 'bonafide') a, CAST(sum(CAST(duration AS DECIMAL(20,6))) FILTER (label = 'spoof') AS DOUBLE) / count(duration) FILTER (label = 'spoof') b FROM samples"


@query(f"WITH {SAMPLES}, m AS ({_MEANS}) SELECT round(a, 9) mean_bonafide, round(b, 9) mean_spoof, round(CASE WHEN least(a, b) > 0 THEN greatest(a, b) / least(a, b) WHEN greatest(a, b) = 0 THEN 1.0 END, 9) ratio, round(abs(a - b), 9) gap FROM m")
def q21_mean_ratio(spark, folder):
    return _round(audit.mean_ratio(samples(spark, folder), "duration"), "mean_bonafide", "mean_spoof", "ratio", "gap")


def _dominance_sql(key: str, where: str) -> str:
    return f"""SELECT label, max(n) / sum(n) clip_share, CASE WHEN sum(s) > 0 THEN CAST(max(s) AS DOUBLE) / CAST(sum(s) AS DOUBLE) END duration_share FROM (
      SELECT label, {key}, count(*) n, sum(CAST(duration AS DECIMAL(20,6))) s FROM samples WHERE {key} IS NOT NULL AND {where} GROUP BY 1, 2) GROUP BY label"""


@query(f"WITH {SAMPLES} SELECT 'speaker_id' key_name, label, round(clip_share, 9) clip_share, round(duration_share, 9) duration_share FROM ({_dominance_sql('speaker_id', 'true')}) UNION ALL SELECT 'generator', label, round(clip_share, 9), round(duration_share, 9) FROM ({_dominance_sql('generator', 'true')})")
def q22_dominance(spark, folder):
    rows = samples(spark, folder)
    one = lambda k: audit.dominance(rows, k).select(F.lit(k).alias("key_name"), "label", "clip_share", "duration_share")
    return _round(one("speaker_id").unionByName(one("generator")), "clip_share", "duration_share")


@query(f"WITH {SAMPLES}, p AS (SELECT dataset, count(DISTINCT label) k FROM samples GROUP BY dataset) SELECT count(*) n_datasets, count(*) FILTER (k = 1) n_single, count(*) > 1 AND count(*) FILTER (k = 1) = count(*) AS confounded FROM p")
def q23_confounding(spark, folder):
    return audit.confounding(samples(spark, folder))


@query(
    f"""WITH {SAMPLES}, a AS (SELECT DISTINCT codec v FROM samples WHERE label = 'bonafide' AND codec IS NOT NULL), b AS (SELECT DISTINCT codec v FROM samples WHERE label = 'spoof' AND codec IS NOT NULL)
    SELECT v AS value, 'common' found_in FROM (SELECT v FROM a INTERSECT SELECT v FROM b) UNION ALL SELECT v, 'only_a' FROM (SELECT v FROM a EXCEPT SELECT v FROM b) UNION ALL SELECT v, 'only_b' FROM (SELECT v FROM b EXCEPT SELECT v FROM a)"""
)
def q24_one_class_values(spark, folder):
    return audit.one_class_values(samples(spark, folder), "codec")


def _banded(code: str, value: str, band: tuple[float, float], source: str) -> str:
    return f"SELECT {code} code, round({value}, 9) AS value, CASE WHEN {value} >= {band[1]} THEN 'HIGH' WHEN {value} >= {band[0]} THEN 'MEDIUM' ELSE 'LOW' END severity FROM ({source}) WHERE {value} IS NOT NULL"


_T = audit.Thresholds()
_CLASS = "label IN ('bonafide', 'spoof')"


#: The manifest with a file format and a made-up loudness.
_AUDITED = SAMPLES.replace("samples AS", "stored AS", 1) + f""", samples AS (SELECT *, nullif(lower(regexp_extract({_STEP.replace('replace(p,', 'replace(source_file,')}, '[^.]\\.([^.]+)$', 1)), '') file_format,
  ({bucket_sql('rms', 'sample_id', 1000)} + CASE WHEN label = 'spoof' THEN 500 ELSE 0 END) / 10000.0::DOUBLE rms FROM stored)"""
_FULL_RATED, _FULL_SHAPE = [c for c in audit.RATED], [c for c in audit.SHAPE if c != "channels"]


@query(
    f"WITH {_AUDITED}, m AS ({_MEANS}) "
    + " UNION ALL ".join(
        [
            _banded("'missing_' || column_name", "v", _T.missing, f"SELECT column_name, max(rate) v FROM ({_rates_sql(_FULL_RATED)}) GROUP BY 1"),
            _banded("column_name", "v", _T.categorical, f"SELECT column_name, max(distance) v FROM (({_distance_sql('1', _FULL_SHAPE)}) UNION ALL ({_distance_sql('duration', _FULL_SHAPE)})) GROUP BY 1"),
            _banded("'one_class_language'", "v", _T.categorical, f"SELECT 1.0::DOUBLE v FROM (SELECT language FROM samples WHERE language IS NOT NULL AND {_CLASS} GROUP BY language HAVING count(DISTINCT label) = 1) HAVING count(*) > 0"),
            _banded("'duration'", "v", _T.duration_ratio, f"SELECT CASE WHEN least(a, b) > 0 THEN greatest(a, b) / least(a, b) WHEN greatest(a, b) = 0 THEN 1.0 ELSE {_T.duration_ratio[1]} END v FROM m WHERE a IS NOT NULL AND b IS NOT NULL"),
            _banded("'speaker_id_dominance_' || label", "v", _T.speaker_share, f"SELECT label, greatest(clip_share, duration_share) v FROM ({_dominance_sql('speaker_id', _CLASS)})"),
            _banded("'generator_dominance_' || label", "v", _T.generator_share, f"SELECT label, greatest(clip_share, duration_share) v FROM ({_dominance_sql('generator', 'label = ' + repr('spoof'))})"),
            _banded("'loudness_rms'", "v", _T.rms_gap, "SELECT abs(avg(rms) FILTER (label = 'bonafide') - avg(rms) FILTER (label = 'spoof')) v FROM samples"),
            _banded("'dataset_class_confounding'", "v", _T.categorical, "SELECT 1.0::DOUBLE v FROM (SELECT dataset, count(DISTINCT label) k FROM samples GROUP BY dataset) HAVING count(*) > 1 AND count(*) FILTER (k = 1) = count(*)"),
        ]
    )
)
def q25_findings(spark, folder):
    rows = samples(spark, folder)
    loud = (f.bucket("rms", F.col("sample_id"), 1000) + F.when(F.col("label") == "spoof", 500).otherwise(0)) / F.lit(10000.0)
    return _round(audit.findings(rows.withColumns({"file_format": f.file_format(F.lit(None).cast("string"), F.col("source_file")), "rms": loud})), "value")


# checks --------------------------------------------------------------------------------------------------------------

_LEVELS = {"split": ["train", "dev", "test"], "language": ["hi", "pa", "ta", "en", "sa"], "label": ["bonafide", "spoof"]}
_GRID = " CROSS JOIN ".join(f"(SELECT unnest({v}) AS {k})" for k, v in _LEVELS.items())


@query(
    f"""WITH {SAMPLES}, h AS (SELECT split, language, label, count(*) n, count(DISTINCT speaker_id) k FROM samples GROUP BY ALL)
    SELECT g.split, g.language, g.label, coalesce(n, 0) n_rows, coalesce(k, 0) n_distinct, coalesce(n, 0) >= 20 AS enough FROM (SELECT * FROM {_GRID}) g LEFT JOIN h USING (split, language, label)"""
)
def q26_cells(spark, folder):
    return checks.cell_counts(samples(spark, folder), list(_LEVELS), _LEVELS, 20, "speaker_id")


_REASONS = """CASE WHEN dataset IS NULL OR dataset NOT IN ('indicvoices', 'indicsynth') THEN 'external_or_nonprimary' WHEN language IS NULL OR language NOT IN ('hi', 'pa', 'ta') THEN 'unselected_language' WHEN duration IS NULL OR duration <= 0 THEN 'missing_or_zero_duration'
  WHEN coalesce(trim(speaker_id), '') = '' THEN 'missing_speaker' WHEN generator IN ('lipi_flow') THEN 'reserved_generator' WHEN label = 'spoof' AND generator IS NULL THEN 'missing_generator' END"""


def _eligible(spark, folder):
    return checks.eligibility(samples(spark, folder), ["indicvoices", "indicsynth"], ["hi", "pa", "ta"], ["lipi_flow"])


@query(f"WITH {SAMPLES} SELECT {_REASONS} reason, count(*) n FROM samples GROUP BY 1")
def q27_exclusions(spark, folder):
    return _eligible(spark, folder).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT 'null_id' check_name, count(*) FILTER (sample_id IS NULL) n_rows FROM manifest UNION ALL SELECT 'processed_rows', count(*) FILTER (processed_file IS NOT NULL OR segment_start IS NOT NULL) FROM manifest
    UNION ALL SELECT 'illegal_label', count(*) FILTER (label IS NULL OR label NOT IN ('bonafide', 'spoof')) FROM manifest
    UNION ALL SELECT 'source_class_mismatch', count(*) FILTER ((dataset = 'indicvoices' AND label <> 'bonafide') OR (dataset = 'indicsynth' AND label <> 'spoof')) FROM manifest
    UNION ALL SELECT 'duplicate_id', coalesce(sum(k) FILTER (k > 1), 0)::BIGINT FROM (SELECT count(*) k FROM manifest GROUP BY dataset, sample_id)
    UNION ALL SELECT 'duplicate_file', coalesce(sum(k) FILTER (k > 1), 0)::BIGINT FROM (SELECT count(*) k FROM manifest WHERE source_file IS NOT NULL GROUP BY dataset, source_file)"""
)
def q28_preconditions(spark, folder):
    return checks.preconditions(table(spark, folder, "manifest"), {"indicvoices": "bonafide", "indicsynth": "spoof"})


@query(f"WITH {SAMPLES} SELECT generator, count(*) n FROM samples WHERE generator IS NULL OR generator NOT IN ('tarang_tts', 'swaravani_2') GROUP BY generator")
def q29_holdout(spark, folder):
    kept = samples(spark, folder).where(~F.coalesce(F.col("generator").isin("tarang_tts", "swaravani_2"), F.lit(False)))
    return kept.groupBy("generator").agg(F.count(F.lit(1)).alias("n"))


def _thirds_sql(b: str, train: int = 60, dev: int = 80) -> str:
    return f"CASE WHEN {b} < {train} THEN 'train' WHEN {b} < {dev} THEN 'dev' ELSE 'test' END"


@query(f"WITH {SAMPLES} SELECT speaker_id, {bucket_sql('42', 'speaker_id')} AS bucket, {_thirds_sql(bucket_sql('42', 'speaker_id'))} new_split FROM samples WHERE speaker_id IS NOT NULL GROUP BY speaker_id")
def q30_hash_split(spark, folder):
    b = f.bucket("42", F.col("speaker_id"))
    return samples(spark, folder).where("speaker_id IS NOT NULL").select("speaker_id", b.alias("bucket"), f.thirds(b).alias("new_split")).distinct()


@query(
    f"""WITH p AS (SELECT id, len(list_distinct([{_thirds_sql(bucket_sql('42', 'k'))} FOR k IN speakers])) c, [{_thirds_sql(bucket_sql('42', 'k'))} FOR k IN speakers] s FROM (SELECT DISTINCT id, speakers FROM baseline_rows))
    SELECT CASE WHEN c = 1 THEN s[1] END new_split, count(*) n FROM p GROUP BY 1"""
)
def q31_pair_split(spark, folder):
    rows = table(spark, folder, "baseline_rows").select("id", "speakers").distinct()
    return rows.groupBy(splits.pair_split(F.col("speakers"), "42").alias("new_split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH r AS (SELECT DISTINCT id, split, unnest(reference_keys) k FROM baseline_rows), c AS (SELECT k FROM r GROUP BY k HAVING count(DISTINCT split) > 1)
    SELECT split, source, count(*) n FROM baseline_rows WHERE id NOT IN (SELECT id FROM r WHERE k IN (SELECT k FROM c)) GROUP BY 1, 2"""
)
def q32_conflict_free(spark, folder):
    return checks.conflict_free(table(spark, folder, "baseline_rows"), "id", F.col("reference_keys")).groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


@query("WITH d AS (SELECT DISTINCT split, language, source, id FROM baseline_rows) SELECT split, language, source, id FROM (SELECT *, row_number() OVER (PARTITION BY split, language, source ORDER BY sha256('42|' || id), id) r FROM d) WHERE r <= 40")
def q33_quota(spark, folder):
    rows = table(spark, folder, "baseline_rows").select("split", "language", "source", "id").distinct()
    return sampling.quota(rows, ["split", "language", "source"], "id", 40, "42")


_CROSSED = ["speaker_id", "source_file", "sample_id"]


@query(
    f"WITH {SAMPLES} "
    + " UNION ALL ".join(f"SELECT '{c}' field, count(*) FILTER (k > 1) n_values FROM (SELECT {c}, count(DISTINCT split) k FROM samples WHERE {c} IS NOT NULL AND split IS NOT NULL GROUP BY {c})" for c in _CROSSED)
)
def q34_split_overlap(spark, folder):
    return checks.split_overlap(samples(spark, folder), _CROSSED)


@query(f"""WITH {SAMPLES} SELECT coalesce(w.split, g.split) AS split, coalesce(expected, 0) expected, coalesce(found, 0) AS found, coalesce(expected, 0) = coalesce(found, 0) AS agrees
    FROM (SELECT unnest(['train', 'dev', 'extra']) AS split, unnest([100, 1852, 0])::BIGINT expected) w FULL JOIN (SELECT split, count(*) found FROM samples GROUP BY 1) g ON w.split = g.split""")
def q35_contract(spark, folder):
    return checks.against_contract(samples(spark, folder), "split", {"train": 100, "dev": 1852, "extra": 0})


@query(f"WITH {SAMPLES} SELECT label, language, count(*) n_rows, count(DISTINCT speaker_id) n_speakers FROM samples WHERE label IS NOT NULL GROUP BY 1, 2 HAVING count(*) < 100 OR count(DISTINCT speaker_id) < 5")
def q36_small_cells(spark, folder):
    cells = samples(spark, folder).where("label IS NOT NULL").groupBy("label", "language").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("speaker_id").alias("n_speakers"))
    return cells.where("n_rows < 100 OR n_speakers < 5")


_PRIORITY = "CASE split WHEN 'test' THEN 0 WHEN 'dev' THEN 1 WHEN 'train' THEN 2 ELSE 3 END"


@query(
    f"""WITH d AS (SELECT DISTINCT id, split, source, window_sha256 FROM baseline_rows), r AS (SELECT *, row_number() OVER (PARTITION BY window_sha256 ORDER BY {_PRIORITY}, id) r FROM d)
    SELECT split, source, count(*) n FROM r WHERE r = 1 OR window_sha256 IS NULL GROUP BY 1, 2"""
)
def q37_holdout_first(spark, folder):
    rows = table(spark, folder, "baseline_rows").select("id", "split", "source", "window_sha256").distinct()
    return splits.first_wins(rows, "window_sha256", F.expr(_PRIORITY), "id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


def _digest_sql(c: str) -> str:
    bare = rf"regexp_replace(regexp_replace(lower({c}), '[\s\x{{a0}}_-]+', '', 'g'), '^(sha256:?|0x)+', '')"
    return f"CASE WHEN regexp_full_match({bare}, '[0-9a-f]{{64}}') AND replace({bare}, left({bare}, 1), '') <> '' THEN {bare} END"


@query(
    f"""WITH d AS (SELECT DISTINCT id, split, source, {_digest_sql('window_sha256')} w FROM baseline_rows), r AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY {_PRIORITY}, id) r FROM d)
    SELECT split, source, count(*) n FROM r WHERE r = 1 OR w IS NULL GROUP BY 1, 2"""
)
def q37_holdout_first_digests(spark, folder):
    """As q37_holdout_first, by the digest in one spelling; recordings with a placeholder are no copies of each other."""
    rows = table(spark, folder, "baseline_rows").select("id", "split", "source", digest_key(F.col("window_sha256")).alias("w")).distinct()
    return splits.first_wins(rows, "w", F.expr(_PRIORITY), "id").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sha256(text) AS text_key, count(*) n, count(DISTINCT source) n_sources, min(doc_id) first_doc FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY 1 HAVING count(DISTINCT source) > 1")
def q38_conflicting_copies(spark, folder):
    rows = table(spark, folder, "documents").where("text IS NOT NULL AND text <> ''")
    found = rows.groupBy(F.sha2("text", 256).alias("text_key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("n_sources"), F.min("doc_id").alias("first_doc"))
    return found.where("n_sources > 1")


@query(f"""WITH g AS (SELECT DISTINCT speakers[1] s FROM baseline_rows WHERE speakers[1] IS NOT NULL) SELECT CASE WHEN s IS NULL THEN NULL WHEN {bucket_sql('42', 's')} < 60 THEN 'train' WHEN {bucket_sql('42', 's')} < 80 THEN 'dev' ELSE 'test' END new_split, label, count(*) n
    FROM baseline_rows LEFT JOIN g ON speakers[1] = s GROUP BY 1, 2""")
def q39_assignment_join(spark, folder):
    """Rows take the split that their group was assigned; rows without a group have none."""
    rows = table(spark, folder, "baseline_rows").withColumn("s", F.get("speakers", F.lit(0)))
    assigned = rows.where("s IS NOT NULL").select("s").distinct().withColumn("new_split", f.thirds(f.bucket("42", F.col("s"))))
    return rows.join(assigned, "s", "left").groupBy("new_split", "label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SAMPLES} SELECT generator, CASE WHEN generator IN ('tarang_tts', 'lipi_flow') THEN 'train' WHEN generator = 'swaravani_2' THEN 'dev' WHEN generator = 'echo_morph_vc' THEN 'test' ELSE split END new_split, count(*) n FROM samples GROUP BY 1, 2")
def q40_generator_split(spark, folder):
    named = {"train": ["tarang_tts", "lipi_flow"], "dev": ["swaravani_2"], "test": ["echo_morph_vc"]}
    return samples(spark, folder).groupBy("generator", splits.generator_split(named, F.col("split")).alias("new_split")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """WITH a AS (SELECT id FROM baseline_rows), b AS (SELECT id FROM recording_windows WHERE window_index = 0)
    SELECT 'left_only' side, count(DISTINCT id) n FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'right_only', count(DISTINCT id) FROM b WHERE id NOT IN (SELECT id FROM a)
    UNION ALL SELECT 'left_repeated', count(*) FROM (SELECT id FROM a GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'right_repeated', count(*) FROM (SELECT id FROM b GROUP BY id HAVING count(*) > 1)"""
)
def q41_bijection(spark, folder):
    """Recordings against the inventory of their first windows."""
    return checks.bijection(table(spark, folder, "baseline_rows"), table(spark, folder, "recording_windows").where("window_index = 0"), "id")


# metrics -------------------------------------------------------------------------------------------------------------

_COUNTS = "count(*) FILTER (label = 0 AND score < 0.5) tn, count(*) FILTER (label = 0 AND score >= 0.5) fp, count(*) FILTER (label = 1 AND score < 0.5) fn, count(*) FILTER (label = 1 AND score >= 0.5) tp"
_DERIVED = """tn, fp, fn, tp, n, round((tp + tn) / n, 9) accuracy, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) f1, round(tn / nullif(tn + fp, 0), 9) specificity,
  round(fp / nullif(tn + fp, 0), 9) fpr, round(fn / nullif(tp + fn, 0), 9) fnr, round(tn / nullif(tn + fn, 0), 9) npv, round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 9) balanced_accuracy,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 9) mcc,
  round((2 * tp / nullif(2 * tp + fp + fn, 0) + 2 * tn / nullif(2 * tn + fn + fp, 0)) / 2, 9) macro_f1, round((2 * tp / nullif(2 * tp + fp + fn, 0) * (tp + fn) + 2 * tn / nullif(2 * tn + fn + fp, 0) * (tn + fp)) / n, 9) weighted_f1, round((tp + fn) / n, 9) prevalence"""
_RATES_OUT = ["accuracy", "precision", "recall", "f1", "specificity", "fpr", "fnr", "npv", "balanced_accuracy", "mcc", "macro_f1", "weighted_f1", "prevalence"]


@query(f"WITH {PREDICTIONS} SELECT {_COUNTS} FROM preds")
def q42_confusion(spark, folder):
    return metrics.confusion(predictions(spark, folder))


@query(f"WITH {PREDICTIONS}, c AS (SELECT {_COUNTS}, count(*) n FROM preds) SELECT {_DERIVED} FROM c")
def q43_rates(spark, folder):
    return _round(metrics.derived(metrics.confusion(predictions(spark, folder))), *_RATES_OUT)


@query(f"WITH {PREDICTIONS}, c AS (SELECT {_COUNTS} FROM preds) SELECT tp + tn AS hits, round((tp + tn) / greatest(tn + fp + fn + tp, 1), 9) accuracy, round(tp / greatest(tp + fp, 1), 9) AS precision, round(tp / greatest(tp + fn, 1), 9) recall, round(2 * tp / greatest(2 * tp + fp + fn, 1), 9) f1 FROM c")
def q44_rates_zero_default(spark, folder):
    return _round(metrics.zero_defaults(metrics.confusion(predictions(spark, folder))), "accuracy", "precision", "recall", "f1")


_AUC = "SELECT {by} (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2) / nullif(count(*) FILTER (label = 1) * count(*) FILTER (label = 0), 0) v FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {by} score) - 1) / 2 r FROM preds)"


@query(f"WITH {PREDICTIONS} SELECT round(v, 9) roc_auc FROM ({_AUC.format(by='', part='')})")
def q45_roc_auc(spark, folder):
    return _round(metrics.roc_auc(metrics.score_table(predictions(spark, folder))), "roc_auc")


_STEPS = "steps AS (SELECT score, sum(pos) OVER w tp, sum(neg) OVER w fp, sum(pos) OVER () n_pos, sum(neg) OVER () n_neg, pos FROM (SELECT score, sum(label) pos, sum(1 - label) neg FROM preds GROUP BY score) WINDOW w AS (ORDER BY score DESC))"


@query(f"WITH {PREDICTIONS}, {_STEPS} SELECT score threshold, round(fp / n_neg, 9) fpr, round(tp / n_pos, 9) tpr FROM steps UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0")
def q46_roc_points(spark, folder):
    return _round(metrics.roc_points(metrics.score_table(predictions(spark, folder))), "fpr", "tpr")


@query(f"WITH {PREDICTIONS}, {_STEPS} SELECT score threshold, round(tp / (tp + fp), 9) AS precision, round(tp / n_pos, 9) recall FROM steps UNION ALL SELECT NULL, 1.0, 0.0")
def q47_pr_points(spark, folder):
    return _round(metrics.pr_points(metrics.score_table(predictions(spark, folder))), "precision", "recall")


@query(f"WITH {PREDICTIONS}, {_STEPS} SELECT round(sum(pos / n_pos * tp / (tp + fp)), 9) average_precision FROM steps")
def q48_average_precision(spark, folder):
    return _round(metrics.average_precision(metrics.score_table(predictions(spark, folder))), "average_precision")


@query(f"WITH {PREDICTIONS}, c AS (SELECT *, least(greatest(score, 2.220446049250313e-16), 1 - 2.220446049250313e-16) p FROM preds) SELECT round(avg(pow(label - score, 2)), 9) brier, round(avg(-(label * ln(p) + (1 - label) * ln(1 - p))), 9) log_loss FROM c")
def q49_losses(spark, folder):
    return _round(metrics.probability_losses(predictions(spark, folder)), "brier", "log_loss")


_BINS = "SELECT least(floor(score * 10), 9)::INT bin, count(*) n, avg(score) mean_score, avg(label) positive_fraction FROM preds GROUP BY 1"


@query(f"WITH {PREDICTIONS} SELECT bin, n, round(mean_score, 9) mean_score, round(positive_fraction, 9) positive_fraction FROM ({_BINS})")
def q50_reliability(spark, folder):
    return _round(metrics.reliability(predictions(spark, folder)), "mean_score", "positive_fraction")


@query(f"WITH {PREDICTIONS} SELECT round(sum(n * abs(mean_score - positive_fraction)) / sum(n), 9) ece FROM ({_BINS})")
def q51_calibration_error(spark, folder):
    return _round(metrics.calibration_error(metrics.reliability(predictions(spark, folder))), "ece")


@query(f"WITH {PREDICTIONS}, c AS (SELECT language, {_COUNTS}, count(*) n FROM preds GROUP BY language), a AS ({_AUC.format(by='language,', part='PARTITION BY language')} GROUP BY language) SELECT language, {_DERIVED}, round(v, 9) roc_auc FROM c JOIN a USING (language)")
def q52_rates_by_language(spark, folder):
    rows = predictions(spark, folder)
    auc = metrics.roc_auc(metrics.score_table(rows, ["language"]), ["language"])
    return _round(metrics.derived(metrics.confusion(rows, by=["language"])).join(auc, "language"), *_RATES_OUT, "roc_auc")


@query(
    f"""WITH {PREDICTIONS}, x AS (SELECT a.attack, a.score, (SELECT count(*) FROM preds h WHERE h.label = 0 AND h.score < a.score) + (SELECT count(*) FROM preds h WHERE h.label = 0 AND h.score = a.score) / 2 w FROM preds a WHERE a.label = 1)
    SELECT attack, count(*) n, count(*) FILTER (score >= 0.5) detected, round(count(*) FILTER (score >= 0.5) / count(*), 9) recall, round(avg(score), 9) mean_score, round(sum(w) / (count(*) * (SELECT count(*) FROM preds WHERE label = 0)), 9) roc_auc FROM x GROUP BY attack"""
)
def q53_attacks(spark, folder):
    return _round(metrics.attacks_against_humans(predictions(spark, folder), "attack"), "recall", "mean_score", "roc_auc")


@query(f"WITH {PREDICTIONS} SELECT CASE WHEN abs(score - 0.5) < 0.1 THEN 'inconclusive' WHEN score >= 0.5 THEN 'synthetic' ELSE 'genuine' END verdict, count(*) n FROM preds GROUP BY 1")
def q77_verdicts(spark, folder):
    return predictions(spark, folder).groupBy(f.verdict(F.col("score")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_IDENTITY = ["id", "source", "split", "language", "label", "audio_sha256", "window_sha256"]


@query(
    f"""WITH r AS (SELECT sha256({" || ',' || ".join(f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in _IDENTITY)}) h FROM (SELECT DISTINCT {', '.join(_IDENTITY)} FROM baseline_rows)),
    g AS (SELECT substr(h, 1, 4) g, sha256(string_agg(h, '' ORDER BY h)) d, count(*) n FROM r GROUP BY 1) SELECT sha256(string_agg(d, '' ORDER BY g)) digest, sum(n)::BIGINT n_rows FROM g"""
)
def q78_content_identity(spark, folder):
    return metrics.content_identity(table(spark, folder, "baseline_rows").select(*_IDENTITY).distinct(), _IDENTITY)


@query("SELECT CASE WHEN sample_rate IS NULL OR sample_rate NOT BETWEEN 8000 AND 44100 THEN 'sample_rate' WHEN channels IS NULL OR channels NOT BETWEEN 1 AND 1 THEN 'channels' WHEN duration IS NULL OR duration NOT BETWEEN 2 AND 12 THEN 'duration' END reason, count(*) n FROM indicvoices GROUP BY 1")
def q81_header_bounds(spark, folder):
    return table(spark, folder, "indicvoices").groupBy(checks.first_reason(f.header_reason((2.0, 12.0), (8000, 44100), (1, 1))).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT sample_id, sha1(encode('blob ' || octet_length(encode(source_file)) || chr(0) || source_file)) AS blob FROM manifest WHERE source_file IS NOT NULL")
def q82_blob_digests(spark, folder):
    return table(spark, folder, "manifest").where("source_file IS NOT NULL").select("sample_id", f.blob_digest(F.col("source_file")).alias("blob"))


@query(f"WITH {PREDICTIONS}, z AS (SELECT label, 8 * (score - 0.5) z FROM preds) SELECT round(avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))), 9) loss, round(avg(CASE WHEN (z > 0)::INT = label THEN 1.0::DOUBLE ELSE 0 END), 9) accuracy FROM z")
def q83_logit_losses(spark, folder):
    rows = predictions(spark, folder).withColumn("logit", 8 * (F.col("score") - 0.5))
    return _round(metrics.logit_losses(rows), "loss", "accuracy")


_WALKED = f"""r AS (SELECT id, split, {_digest_sql('audio_sha256')} a, {_digest_sql('window_sha256')} w, {_PRIORITY} p FROM baseline_rows),
  one AS (SELECT *, row_number() OVER (ORDER BY p, id) n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, split NULLS FIRST, a NULLS FIRST, w NULLS FIRST) k FROM r) WHERE k = 1),
  walk AS (SELECT 0::BIGINT n, []::VARCHAR[] seen, false fresh UNION ALL SELECT n, CASE WHEN fresh THEN list_concat(seen, list_filter(mine, lambda x: x IS NOT NULL)) ELSE seen END, fresh
    FROM (SELECT o.n, seen, ['a' || o.a, 'w' || o.w] mine, NOT coalesce(list_contains(seen, 'a' || o.a), false) AND NOT coalesce(list_contains(seen, 'w' || o.w), false) fresh FROM walk JOIN one o ON o.n = walk.n + 1))"""


@query(f"WITH RECURSIVE {_WALKED} SELECT o.id, o.split, o.a, o.w FROM walk JOIN one o USING (n) WHERE fresh")
def q85_two_key_walk(spark, folder):
    """Recordings that stay when copies by bytes or by window are dropped, test before dev before train. An id stored in several ways counts as the first of them."""
    rows = table(spark, folder, "baseline_rows").select("id", "split", digest_key(F.col("audio_sha256")).alias("a"), digest_key(F.col("window_sha256")).alias("w"))
    first = rows.groupBy("id").agg(F.min(F.struct(F.expr(_PRIORITY).alias("p"), "split", "a", "w")).alias("m")).select("id", "m.split", "m.a", "m.w")
    return splits.first_wins_all(first, "id", ["a", "w"], F.expr(_PRIORITY))
