"""Queries of summaries, metadata audits, partitions, evaluation reports and detectors, with the SQL that must agree with them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoplan.functions import fields as f
from sonoplan.functions.text import digest_key
from sonoplan.operators import audio, audit, balance, leakage, metrics, sampling, splits
from sonoplan.operators.checks import first_reason
from sonoplan.plans.catalogue import _digest_sql, _round
from sonoplan.plans.views import PREDICTIONS, SAMPLES, bucket_sql, predictions, samples
from sonoplan.sources.metadata import by_ordinal
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


# summaries -----------------------------------------------------------------------------------------------------------

_CATEGORIES = ["dataset", "label", "language", "gender", "codec", "generator", "attack_type", "split", "sample_rate", "channels"]
_TOTAL = "CAST(sum(CAST(duration AS DECIMAL(20,6))) AS DOUBLE)"
_COUNTS = {"total_rows": "count(*)", "known_source_files": "count(source_file)", "unique_speakers": "count(DISTINCT speaker_id)", "missing_speaker_rows": "count(*) FILTER (speaker_id IS NULL)"}
_STATS = {"known": "count(duration)", "missing": "count(*) - count(duration)", "total": _TOTAL, "mean": f"{_TOTAL} / count(duration)", "median": "median(duration)", "minimum": "min(duration)", "maximum": "max(duration)", "total_hours": f"{_TOTAL} / 3600"}


@query(
    f"WITH {SAMPLES} "
    + " UNION ALL ".join(
        [f"SELECT 'rows' section, '{n}' AS name, round(({e})::DOUBLE, 9) AS value FROM samples" for n, e in _COUNTS.items()]
        + [f"SELECT 'duration', '{n}', round(({e})::DOUBLE, 9) FROM samples" for n, e in _STATS.items()]
        + [f"SELECT 'distribution:{c}', coalesce({c}::VARCHAR, 'missing'), count(*)::DOUBLE FROM samples GROUP BY {c}" for c in _CATEGORIES[:-1]]
        + ["SELECT 'distribution:channels', 'missing', count(*)::DOUBLE FROM samples"]
    )
)
def q88_summary(spark, folder):
    """The manifest in one long table; impossible durations are part of it, so that they aren't refused."""
    return _round(balance.summary(samples(spark, folder), _CATEGORIES, refuse=False), "value")


@query(
    f"""WITH {SAMPLES}, e AS (SELECT min(duration) a, (max(duration) - min(duration)) / 20 w FROM samples), b AS (SELECT label, least(floor((duration - a) / w), 19)::INT AS bin FROM samples, e WHERE duration IS NOT NULL)
    SELECT label, bin, round(a + bin * w, 6) low, round(a + (bin + 1) * w, 6) high, count(*) n FROM b, e GROUP BY label, bin, a, w"""
)
def q89_histogram(spark, folder):
    found = balance.histogram(samples(spark, folder), "duration", "label")
    return found.withColumns({c: F.round(c, 6) for c in ("low", "high")})


def _clips(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "embedding", F.when(F.col("label") % 2 == 0, "bonafide").otherwise("spoof").alias("label"))


_RMS = "sqrt(list_sum(list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 32)"


@query(f"WITH c AS (SELECT label % 2 k, {_RMS} r FROM embeddings), m AS (SELECT avg(r) FILTER (k = 0) a, avg(r) FILTER (k = 1) b FROM c) SELECT round(a, 9) mean_bonafide, round(b, 9) mean_spoof, round(abs(a - b), 9) gap FROM m")
def q90_loudness_gap(spark, folder):
    from sonoplan.operators import waveform

    clips = _clips(spark, folder).withColumn("rms", waveform.rms(F.slice("embedding", 1, 32)))
    return _round(audit.mean_gap(clips, "rms"), "mean_bonafide", "mean_spoof", "gap")


# metadata audits -----------------------------------------------------------------------------------------------------


def _delivered(spark, folder) -> DataFrame:
    """Documents in the shape of a delivery's metadata."""
    n = F.col("doc_id")
    split = F.when(n % 7 == 0, F.lit(None)).when(n % 5 == 0, "evaluation").when(n % 5 == 1, "validation").otherwise("train")
    return table(spark, folder, "documents").select(
        F.when(n % 11 > 0, F.coalesce("sample_id", n.cast("string"))).alias("row_id"), F.col("sample_id").alias("utterance_id"), F.when(n % 3 > 0, F.col("source")).alias("speaker_id"), F.when(n % 50 == 0, "none").when(n % 4 > 0, F.sha2("text", 256)).alias("audio_sha256"),
        F.col("lang").alias("language"), split.cast("string").alias("split"), F.when(n % 2 == 0, "bonafide").otherwise("spoof").alias("label"), "text", (n % 2 == 0).alias("is_text_exact"),
    )


_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_FLAT = f"trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'), ' ')"
_LANGUAGES = ", ".join(map(repr, leakage.Contract().languages))
_DELIVERED = f"""d AS (SELECT CASE WHEN doc_id % 11 > 0 THEN coalesce(sample_id, doc_id::VARCHAR) END row_id, sample_id utterance_id, CASE WHEN doc_id % 3 > 0 THEN source END speaker_id, CASE WHEN doc_id % 50 = 0 THEN 'none' WHEN doc_id % 4 > 0 THEN sha256(text) END audio_sha256,
    lang AS language, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'evaluation' WHEN doc_id % 5 = 1 THEN 'validation' ELSE 'train' END AS split, CASE WHEN doc_id % 2 = 0 THEN 'bonafide' ELSE 'spoof' END label, CASE WHEN doc_id % 2 = 0 AND length({_FLAT}) >= 20 THEN sha256({_FLAT}) END exact_text FROM documents),
  r AS (SELECT *, CASE WHEN language IS NULL OR language NOT IN ({_LANGUAGES}) THEN 'unknown_language' WHEN split IS NULL OR coalesce(row_id, '') = '' THEN 'invalid_split_label_or_row_id' END reason, NOT regexp_full_match(audio_sha256, '[0-9a-f]{{64}}') AS odd FROM d),
  fine AS (SELECT * FROM r WHERE reason IS NULL), cell AS (SELECT split || '/' || language || '/' || label AS name, count(*) n FROM fine GROUP BY 1),
  v AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, {c} v, split FROM fine WHERE {c} IS NOT NULL AND trim({c}) <> ''" + (" AND NOT odd" if c == "audio_sha256" else "") for c in (*leakage.IDENTITIES, "exact_text"))}),
  g AS (SELECT name, v, count(*) n, count(DISTINCT split) > 1 AS c FROM v GROUP BY 1, 2), f AS (SELECT name, count(*) FILTER (c) c, sum(n) n FROM g GROUP BY 1), named AS (SELECT unnest([{", ".join(map(repr, (*leakage.IDENTITIES, "exact_text")))}]) AS name),
  audit AS (SELECT 'invalid' kind, reason AS name, count(*) n FROM r WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'invalid', 'duplicate_row_id', n FROM (SELECT count(*) - count(DISTINCT row_id) n FROM fine) WHERE n > 0
    UNION ALL SELECT 'invalid', 'invalid_audio_sha256', n FROM (SELECT count(*) n FROM fine WHERE odd) WHERE n > 0
    UNION ALL SELECT 'count', name, n FROM cell
    UNION ALL SELECT 'missing_cell', s || '/' || l || '/' || k, 0 FROM (SELECT unnest(['evaluation', 'train', 'validation']) s), (SELECT unnest([{_LANGUAGES}]) l), (SELECT unnest(['bonafide', 'spoof']) k) WHERE s || '/' || l || '/' || k NOT IN (SELECT name FROM cell)
    UNION ALL SELECT 'overlap', name, coalesce(c, 0)::BIGINT FROM named LEFT JOIN f USING (name)
    UNION ALL SELECT 'coverage', name, coalesce(n, 0)::BIGINT FROM named LEFT JOIN f USING (name) WHERE name IN ('speaker_id', 'audio_sha256'))"""


@query(f"WITH {_DELIVERED} SELECT kind, name, n FROM audit")
def q91_metadata_audit(spark, folder):
    return leakage.metadata_audit(_delivered(spark, folder), "all")


@query(
    f"""WITH {_DELIVERED}, s AS (SELECT coalesce(sum(n) FILTER (kind = 'count'), 0)::BIGINT records, coalesce(sum(n) FILTER (kind = 'invalid' OR kind = 'overlap' AND name IN ('row_id', 'audio_sha256', 'speaker_id')), 0) + count(*) FILTER (kind = 'missing_cell') bad,
      sum(n) FILTER (kind = 'coverage' AND name = 'speaker_id') sp, sum(n) FILTER (kind = 'coverage' AND name = 'audio_sha256') au FROM audit)
    SELECT CASE WHEN bad > 0 THEN 'issues_found' ELSE 'metadata_checks_passed' END status, records, CASE WHEN records > 0 AND sp = records THEN 'checked_for_supplied_ids' ELSE 'unverified' END speaker_separation, CASE WHEN records > 0 AND au = records THEN 'checked_for_supplied_hashes' ELSE 'unverified' END audio_duplicates FROM s"""
)
def q91_audit_status(spark, folder):
    return leakage.audit_status(leakage.metadata_audit(_delivered(spark, folder), "all"))


@query("WITH v AS (SELECT source, speakers[1] s, count(DISTINCT split) k FROM baseline_rows WHERE coalesce(speakers[1], '') <> '' GROUP BY 1, 2) SELECT count(*) FILTER (k > 1) n_values FROM v")
def q92_voice_overlap(spark, folder):
    return leakage.voice_overlap(table(spark, folder, "baseline_rows").withColumn("voice", F.get("speakers", F.lit(0))), "source", "voice")


@query("SELECT id, sha256(source || ':r1:' || split || ':' || label) AS row_id, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label_code, CASE split WHEN 'dev' THEN NULL ELSE split END AS renamed FROM baseline_rows WHERE split <> 'test'")
def q93_row_ids(spark, folder):
    """Ids from where rows stand, labels as numbers, splits renamed (dev is no name of the source)."""
    rows = table(spark, folder, "baseline_rows").where("split <> 'test'")
    label = f.encoded_label(F.when(F.col("label") == 1, "spoof").otherwise("bonafide"))
    return rows.select("id", f.row_id(F.col("source"), F.lit("r1"), F.col("split"), F.col("label")).alias("row_id"), label.alias("label_code"), f.renamed_split(F.col("split")).alias("renamed"))


# partitions, samples -------------------------------------------------------------------------------------------------

_PARTS = f"""b AS (SELECT DISTINCT id, label, coalesce(speakers[1], 'row ' || id) o, {_digest_sql('window_sha256')} || label w FROM baseline_rows),
  star AS (SELECT w, min(o) m FROM b WHERE w IS NOT NULL GROUP BY w), edge AS (SELECT DISTINCT o a, m b FROM b JOIN star USING (w) WHERE o <> m), links AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
  walk AS (SELECT a node, b seen FROM links UNION SELECT w.node, l.b FROM walk w JOIN links l ON w.seen = l.a), roots AS (SELECT o, least(o, coalesce(min(seen), o)) root FROM (SELECT DISTINCT o FROM b) LEFT JOIN walk ON o = node GROUP BY o)"""


@query(
    f"""WITH RECURSIVE {_PARTS}, k AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY id) r FROM b), h AS (SELECT id, label, root, {bucket_sql('42', 'root')} h FROM k JOIN roots USING (o) WHERE r = 1 OR w IS NULL)
    SELECT id, label, root, CASE WHEN h < 80 THEN 'train' WHEN h < 90 THEN 'validation' ELSE 'test' END new_split FROM h"""
)
def q94_partition(spark, folder):
    """New partitions of the recordings: those of one first speaker or one window keep together, copies of a window go. (Windows are told apart by label, which here only copies differ in.)"""
    rows = table(spark, folder, "baseline_rows").select("id", "label", F.get("speakers", F.lit(0)).alias("original"), F.concat(digest_key(F.col("window_sha256")), F.col("label").cast("string")).alias("w")).distinct()
    return splits.partition(rows, "id", "label", "original", "w", [], minimum=0)


@query(
    f"""WITH {PREDICTIONS}, s AS (SELECT id, label, attack, row_number() OVER (PARTITION BY attack ORDER BY sha256('7|' || id), id) r FROM preds WHERE label = 1 AND attack IS NOT NULL), n AS (SELECT count(DISTINCT attack) * 5 n FROM s),
    h AS (SELECT id, label, attack, row_number() OVER (ORDER BY sha256('7|' || id), id) r FROM preds WHERE label = 0) SELECT id, label, attack FROM s WHERE r <= 5 UNION ALL SELECT id, label, attack FROM h, n WHERE r <= n"""
)
def q95_attack_sample(spark, folder):
    return sampling.attack_sample(predictions(spark, folder).select("id", "label", "attack"), "attack", "id", 5, "7")


@query("SELECT sample_id, language, sha256('42|' || sample_id) AS place FROM (SELECT DISTINCT sample_id, language FROM manifest WHERE language = 'Hindi' AND sample_id IS NOT NULL) ORDER BY place LIMIT 500")
def q96_language_stream(spark, folder):
    """The first 500 records of one language in a seeded order: filter and columns reach the scan."""
    rows = table(spark, folder, "manifest").where("language = 'Hindi' AND sample_id IS NOT NULL").select("sample_id", "language").distinct()
    return rows.withColumn("place", sampling.hash_order("42", "sample_id")).orderBy("place").limit(500)


# evaluation ----------------------------------------------------------------------------------------------------------


@query(f"WITH {PREDICTIONS} SELECT count(*) n_humans, round(avg((score >= 0.5)::INT), 9) false_positive_rate, round(avg(score), 9) mean_score FROM preds WHERE label = 0")
def q97_human_errors(spark, folder):
    return _round(metrics.human_errors(predictions(spark, folder)), "false_positive_rate", "mean_score")


@query(f"WITH {PREDICTIONS} SELECT id, label, score FROM preds")
def q98_scored(spark, folder):
    """Recordings with the score of their id, never of their place."""
    rows = predictions(spark, folder)
    return metrics.scored(rows.select("id", "label"), rows.select("id", "score"), "id").select("id", "label", "score")


_SAVED = {"accuracy": 0.9, "precision": None, "unknown": 0.5, "n": 1000.0}


@query(
    f"""WITH {PREDICTIONS}, c AS (SELECT count(*)::DOUBLE n, count(*) FILTER ((score >= 0.5) = (label = 1)) / count(*) accuracy, count(*) FILTER (score >= 0.5 AND label = 1) / nullif(count(*) FILTER (score >= 0.5), 0) AS precision FROM preds),
    s AS (SELECT * FROM (VALUES ('accuracy', 0.9::DOUBLE), ('precision', NULL), ('unknown', 0.5), ('n', 1000.0)) t(metric, saved)), f AS (UNPIVOT c ON accuracy, precision, n INTO NAME metric VALUE found)
    SELECT metric, saved, round(found, 9) AS found, coalesce(abs(saved - found) <= greatest(1e-6 * greatest(abs(saved), abs(found)), 1e-8), true) agrees FROM s LEFT JOIN f USING (metric)"""
)
def q99_against_saved(spark, folder):
    found = metrics.derived(metrics.confusion(predictions(spark, folder)))
    return _round(metrics.against_saved(found, _SAVED), "found")


@query("WITH h AS (SELECT (event_id % 12)::INT AS epoch, round(avg(value), 6) dev_loss FROM events WHERE value IS NOT NULL GROUP BY 1) SELECT epoch, dev_loss FROM h ORDER BY dev_loss, epoch LIMIT 1")
def q100_best_epoch(spark, folder):
    """Events stand for losses, by twelve epochs."""
    history = table(spark, folder, "events").where("value IS NOT NULL").groupBy((F.col("event_id") % 12).cast("int").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("dev_loss"))
    return metrics.best_epoch(history)


@query(
    """WITH s AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) / len(embedding) * 5 AS score FROM embeddings)
    SELECT vec_id, round(score, 9) synthetic_score, CASE WHEN abs(score - 0.5) < 0.1 THEN 'inconclusive' WHEN score >= 0.5 THEN 'synthetic' ELSE 'genuine' END verdict FROM s"""
)
def q101_detector(spark, folder):
    """A detector plugged in: the mean loudness of a clip, scaled."""

    def loudness() -> Callable[[np.ndarray], float]:
        return lambda x: float(np.abs(x.astype(np.float64)).mean() * 5)

    return _round(audio.score_clips(_clips(spark, folder), "vec_id", "embedding", loudness), "synthetic_score")


@query("SELECT vec_id, CASE WHEN list_max(embedding) <= 0.35 THEN round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 2, 5) END total, list_max(embedding) > 0.35 AS failed FROM embeddings")
def q104_transformed(spark, folder):
    """A function of each clip; one that fails on loud clips stops nothing."""

    def doubled(x: np.ndarray) -> tuple[np.ndarray, dict[str, str]]:
        if x.max() > np.float32(0.35):
            raise ValueError("too loud")
        return x * 2, {"n": str(len(x))}

    found = audio.transformed(_clips(spark, folder), "vec_id", "embedding", doubled)
    total = F.aggregate("feature", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return found.select("vec_id", F.round(total, 5).alias("total"), F.col("error").isNotNull().alias("failed"))


_NAMES = "list_sort(list_distinct(list_transform(list_filter(reference_keys, lambda x: x IS NOT NULL AND lower(trim(x)) NOT IN ('', 'nan', 'none', 'null')), lambda x: 'indicsynth:reference:' || split_part(replace(x, chr(92), '/'), '/', -1))))"


@query(f"SELECT id, array_to_string({_NAMES}, ',') AS names FROM (SELECT DISTINCT id, reference_keys[1:2] reference_keys FROM baseline_rows)")
def q105_references(spark, folder):
    """The names of up to two files that each recording was made from."""
    rows = table(spark, folder, "baseline_rows").select("id", F.slice("reference_keys", 1, 2).alias("r")).distinct()
    return rows.select("id", F.array_join(f.references("indicsynth", F.get("r", F.lit(0)), F.get("r", F.lit(1))), ",").alias("names"))


@query(
    """WITH s AS (SELECT CASE WHEN t IS NULL THEN 'missing_target_speaker' WHEN g IS NULL THEN 'missing_generator' END reason FROM (SELECT CASE WHEN lower(trim(target_speaker_id, ' ' || chr(9) || chr(160))) NOT IN ('', 'nan', 'none', 'null') THEN 1 END t, CASE WHEN lower(trim(generative_model, ' ' || chr(9) || chr(160))) NOT IN ('', 'nan', 'none', 'null') THEN 1 END g FROM indicsynth))
    SELECT reason, count(*) n FROM s GROUP BY 1"""
)
def q106_speaker_reasons(spark, folder):
    """Synthetic recordings by what their speakers lack."""
    rows = table(spark, folder, "indicsynth")
    why = f.speaker_reason(True, F.lit(None), F.col("target_speaker_id"), F.lit("s"), F.col("generative_model"))
    return rows.groupBy(first_reason(why).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN vec_id % 9 = 0 THEN 'missing' WHEN vec_id % 7 = 0 THEN 'shape' WHEN vec_id % 5 = 0 THEN 'rate' WHEN len(embedding) <> 64 THEN 'shape' END reason, count(*) n FROM embeddings GROUP BY 1")
def q102_feature_checks(spark, folder):
    """Stored features by what is wrong with them; every ninth is missing, every seventh too short, every fifth of another rate."""
    n = F.col("vec_id")
    w = F.when(n % 9 == 0, F.lit(None)).when(n % 7 == 0, F.slice("embedding", 1, 60)).otherwise(F.col("embedding"))
    return _clips(spark, folder).groupBy(audio.feature_reason(w, 64, F.when(n % 5 == 0, 8000).otherwise(16000), 16000).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_no, label, round(CAST(embedding[1] AS DOUBLE), 9) AS first_sample FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_no, label FROM embeddings) m JOIN (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_no, embedding FROM embeddings) a USING (row_no) WHERE label = 1")
def q103_audio_of_chosen_rows(spark, folder):
    """Metadata chosen by label meets the audio of the same row number; of the audio only the chosen rows are kept."""
    rows = table(spark, folder, "embeddings")
    chosen = rows.where("label = 1").select(F.col("vec_id").alias("row_no"), "label")
    low = rows.agg(F.min("vec_id")).first()[0]
    return by_ordinal(chosen, rows.select(F.col("vec_id").alias("row_no"), "embedding"), "row_no").select((F.col("row_no") - F.lit(low)).alias("row_no"), "label", F.round(F.col("embedding")[0].cast("double"), 9).alias("first_sample"))
