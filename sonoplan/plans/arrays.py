"""Queries of the waveform, graph, sampling, streaming and audio operators. Embeddings stand for clips of 64 samples at 16 a second."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.functions.fields import bucket, thirds
from sonoplan.operators import audio, metrics, sampling, splits, waveform
from sonoplan.operators.graph import connected_components
from sonoplan.plans.catalogue import _eligible, _round
from sonoplan.plans.views import SAMPLES, bucket_sql, samples
from sonoplan.session import durable
from sonoplan.sources.metadata import row_group_counts, row_groups
from sonoplan.sources.tables import table
from sonoplan.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
RATE = 16


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _clips(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("w"), "label")


_CLIPS = "clips AS (SELECT vec_id, embedding w, label, len(embedding) n FROM embeddings)"
_SUM = "list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE)))"


def _sum(w: F.Column) -> F.Column:
    return F.aggregate(w, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))


@query("SELECT a.vec_id, round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (CAST(p[1] AS DOUBLE) + CAST(p[2] AS DOUBLE)) / 2)), 7) total FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def q54_mono(spark, folder):
    a = _clips(spark, folder)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("v"))
    stereo = F.transform(F.array("w", "v"), lambda c: F.transform(c, lambda x: x.cast("double")))
    return a.join(b, "vec_id").select("vec_id", F.round(_sum(waveform.mono(stereo)), 7).alias("total"))


def _segments_sql(keep: bool) -> str:
    rest = "CASE WHEN f * 16 < n THEN 1 ELSE 0 END" if keep else "0"
    return f"""WITH {_CLIPS}, k AS (SELECT *, CASE WHEN n >= 24 THEN (n - 24) // 16 + 1 ELSE 0 END f FROM clips), s AS (SELECT vec_id, w, n, unnest(range(0, (f + {rest})::BIGINT)) * 16 s FROM k)
    SELECT vec_id, (s / {RATE})::DOUBLE start_seconds, ((s + 24) / {RATE})::DOUBLE end_seconds, s + 24 > n AS padded, round({_SUM.format('w[s + 1:s + 24]')}, 7) total FROM s"""


def _segments(spark, folder, keep: bool) -> DataFrame:
    parts = _clips(spark, folder).select("vec_id", F.explode(waveform.segments(F.col("w"), RATE, 24, 16, keep)).alias("s"))
    return parts.select("vec_id", "s.start_seconds", "s.end_seconds", "s.padded", F.round(_sum(F.col("s.samples")), 7).alias("total"))


@query(_segments_sql(True))
def q55_segments_padded(spark, folder):
    return _segments(spark, folder, True)


@query(_segments_sql(False))
def q56_segments_full(spark, folder):
    return _segments(spark, folder, False)


@query(f"WITH {_CLIPS} SELECT vec_id, round({_SUM.format('w[(n - 40) // 2 + 1:(n - 40) // 2 + 40]')}, 7) centre_total, round({_SUM.format('w')}, 7) padded_total, 100::INT padded_length FROM clips")
def q57_centre(spark, folder):
    long = waveform.centre(F.col("w"), 100)
    return _clips(spark, folder).select("vec_id", F.round(_sum(waveform.centre(F.col("w"), 40)), 7).alias("centre_total"), F.round(_sum(long), 7).alias("padded_total"), F.size(long).alias("padded_length"))


@query(f"WITH {_CLIPS}, s AS (SELECT vec_id, w, unnest(range(0, 3)) i FROM clips) SELECT vec_id, i::INT AS place, round({_SUM.format('w[i * 24 + 1:i * 24 + 24]')}, 7) total FROM s")
def q58_consecutive(spark, folder):
    parts = _clips(spark, folder).select("vec_id", F.posexplode(waveform.consecutive(F.col("w"), 24)).alias("place", "x"))
    return parts.select("vec_id", "place", F.round(_sum(F.col("x")), 7).alias("total"))


@query(f"WITH {_CLIPS} SELECT vec_id, round(sqrt(list_sum(list_transform(w, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / n), 9) rms, len(list_filter(w, lambda x: isnan(x) OR isinf(x))) = 0 finite, (n / {RATE})::DOUBLE AS seconds FROM clips")
def q59_rms(spark, folder):
    w = F.col("w")
    return _clips(spark, folder).select("vec_id", F.round(waveform.rms(w), 9).alias("rms"), waveform.finite(w).alias("finite"), (F.size(w) / RATE).alias("seconds"))


_LOUD = "len(list_filter(range(0, 8), lambda i: sqrt(list_sum(list_transform(w[i * 8 + 1:i * 8 + 8], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 8) > 0.125)) / 8"


@query(f"WITH {_CLIPS} SELECT vec_id, ({_LOUD})::DOUBLE loud_share FROM clips")
def q60_loud_share(spark, folder):
    return _clips(spark, folder).select("vec_id", waveform.loud_share(F.col("w"), 8, 0.125).alias("loud_share"))


_RMS = "sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / len({0}))"
_LOUD_12 = f"len(list_filter(range(0, 8), lambda i: {_RMS.format('w[i * 8 + 1:i * 8 + 8]')} > 0.12)) / 8"


@query(
    f"""WITH {_CLIPS}, c AS (SELECT vec_id, unnest([{{'name': 'readable_array', 'passed': w IS NOT NULL}}, {{'name': 'sample_rate', 'passed': {RATE} > 0}}, {{'name': 'empty_waveform', 'passed': n > 0}},
      {{'name': 'finite_samples', 'passed': len(list_filter(w, lambda x: isnan(x) OR isinf(x))) = 0}}, {{'name': 'min_duration', 'passed': n / {RATE} >= 4.0}}, {{'name': 'channels', 'passed': true}},
      {{'name': 'not_completely_silent', 'passed': {_RMS.format('w')} >= 0.12}}, {{'name': 'not_almost_silent', 'passed': ({_LOUD_12}) >= 0.5}}]) c FROM clips)
    SELECT c.name check_name, c.passed, count(*) n FROM c GROUP BY 1, 2"""
)
def q61_validation(spark, folder):
    checks = waveform.report(F.col("w"), F.lit(RATE), F.lit(1), minimum=4.0, silence=0.12, frame_seconds=0.5, least_loud=0.5)
    flat = _clips(spark, folder).select(F.explode(checks).alias("c"))
    return flat.groupBy(F.col("c.name").alias("check_name"), F.col("c.passed").alias("passed")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_CLIPS} SELECT vec_id, list_sum(list_transform(w, lambda x: CAST(floor(CAST(greatest(-1, least(1, x)) AS DOUBLE) * 32767 + 0.5) AS BIGINT)))::BIGINT total FROM clips")
def q62_pcm(spark, folder):
    return _clips(spark, folder).select("vec_id", F.aggregate(waveform.pcm16(F.col("w")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT label::BIGINT AS recording, (i - 1)::INT place, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS value FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2")
def q63_pooled(spark, folder):
    rows = _clips(spark, folder).select(F.col("label").cast("bigint").alias("recording"), "w")
    return _round(metrics.pooled(rows, "recording", "w"), "value")


@query(f"WITH {_CLIPS}, p AS (SELECT vec_id, w, (('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT % (n - 20 + 1)) s FROM clips) SELECT vec_id, round({_SUM.format('w[s + 1:s + 20]')}, 7) total FROM p")
def q84_hashed_crop(spark, folder):
    return _clips(spark, folder).select("vec_id", F.round(_sum(waveform.hashed_crop(F.col("w"), 20, F.col("vec_id"))), 7).alias("total"))


# graph, sampling -----------------------------------------------------------------------------------------------------


_ROOTS = """RECURSIVE pairs AS (SELECT DISTINCT id, s FROM (SELECT id, unnest(speakers) s FROM baseline_rows)), star AS (SELECT s, min(id) b FROM pairs GROUP BY s), edge AS (SELECT DISTINCT p.id a, star.b FROM pairs p JOIN star USING (s) WHERE p.id <> star.b),
  links AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge), walk AS (SELECT a node, b seen FROM links UNION SELECT w.node, l.b FROM walk w JOIN links l ON w.seen = l.a),
  roots AS (SELECT id node, least(id, coalesce(min(seen), id)) root FROM (SELECT DISTINCT id FROM pairs) LEFT JOIN walk ON id = node GROUP BY id)"""


def _speaker_roots(spark, folder) -> DataFrame:
    pairs = table(spark, folder, "baseline_rows").select("id", F.explode("speakers").alias("s")).distinct()
    star = pairs.groupBy("s").agg(F.min("id").alias("b"))
    edges = pairs.join(star, "s").select(F.col("id").alias("a"), "b")
    roots = connected_components(edges)
    return pairs.select(F.col("id").alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


@query(f"WITH {_ROOTS} SELECT node, root FROM roots")
def q64_components(spark, folder):
    """Recordings that share a speaker, directly or through others."""
    return _speaker_roots(spark, folder)


@query(f"WITH {_ROOTS} SELECT node, root, CASE WHEN {bucket_sql('42', 'root')} < 80 THEN 'train' WHEN {bucket_sql('42', 'root')} < 90 THEN 'dev' ELSE 'test' END new_split FROM roots")
def q65_component_split(spark, folder):
    roots = _speaker_roots(spark, folder)
    return roots.select("node", "root", thirds(bucket("42", F.col("root")), 80, 90).alias("new_split"))


@query(
    """WITH d AS (SELECT DISTINCT split, label, language, id FROM baseline_rows), c AS (SELECT split, label, language, count(*) n FROM d GROUP BY ALL), k AS (SELECT split, least(min(n), 50) k FROM c GROUP BY split),
    r AS (SELECT *, row_number() OVER (PARTITION BY split, label, language ORDER BY sha256('42|' || id), id) r FROM d) SELECT split, label, language, id FROM r JOIN k USING (split) WHERE r <= k"""
)
def q66_balanced(spark, folder):
    rows = table(spark, folder, "baseline_rows").select("split", "label", "language", "id").distinct()
    return sampling.balanced(rows, "split", ["label", "language"], "id", 50, "42")


@query(
    """WITH d AS (SELECT DISTINCT sample_id, attack_type FROM manifest WHERE attack_type IS NOT NULL) SELECT attack_type, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY attack_type ORDER BY sha256('7|' || sample_id), sample_id) r FROM d) WHERE r <= 15"""
)
def q67_per_attack(spark, folder):
    rows = table(spark, folder, "manifest").where("attack_type IS NOT NULL").select("attack_type", "sample_id").distinct()
    return sampling.quota(rows, ["attack_type"], "sample_id", 15, "7")


@query(f"WITH {SAMPLES} SELECT label, count(*) n, round(1.0::DOUBLE / count(*), 12) weight FROM samples GROUP BY label")
def q68_weights(spark, folder):
    return sampling.inverse_weights(samples(spark, folder), "label").withColumn("weight", F.round("weight", 12))


@query(
    """WITH r AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(sha256('42:r:' || id), 1, 8))::BIGINT, id) - 1 at_, count(*) OVER (PARTITION BY label) n FROM (SELECT DISTINCT id, label FROM baseline_rows WHERE label IS NOT NULL)),
    c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 c, count(*) OVER () m FROM (SELECT DISTINCT label FROM r)), d AS (SELECT i draw_no, ('0x' || substr(sha256('42:d:' || i), 1, 8))::BIGINT x FROM range(500) t(i))
    SELECT draw_no, r.label, id FROM d JOIN c ON x % m = c.c JOIN r ON r.label = c.label AND at_ = (x // m) % n"""
)
def q68_class_draws(spark, folder):
    rows = table(spark, folder, "baseline_rows").select("id", "label").distinct()
    return sampling.class_draws(rows, "label", "id", 500, "42")


_CELLS = [(k, lang) for k in ("bonafide", "spoof") for lang in ("hi", "pa", "ta")]
_BUDGET = sampling.Budget({"bonafide": 1800.0, "spoof": 1800.0}, speakers_per_cell=2)


def _plan(spark, folder) -> DataFrame:
    eligible = _eligible(spark, folder).where("reason IS NULL").dropDuplicates(["dataset", "sample_id"])
    return sampling.greedy_plan(eligible, _CELLS, _BUDGET)


@query()
def q69_greedy_plan(spark, folder):
    return _plan(spark, folder)


@query()
def q69_plan_report(spark, folder):
    return sampling.plan_report(_plan(spark, folder), _CELLS, _BUDGET)


@query(
    f"""WITH RECURSIVE {SAMPLES}, u AS (SELECT split, load_id::VARCHAR AS unit, count(*) FILTER (label = 'bonafide') x, count(*) FILTER (label = 'spoof') y, count(*) * 1000 b FROM samples WHERE load_id IS NOT NULL AND split IN ('train', 'dev', 'test') GROUP BY 1, 2),
    share AS (SELECT split, CAST(floor((SELECT coalesce(sum(b), 0)::BIGINT // 2 FROM u) * s) AS BIGINT) room FROM (VALUES ('train', 0.8::DOUBLE), ('dev', 0.1), ('test', 0.1)) t(split, s)),
    walk AS (SELECT split, room, 0::BIGINT x, 0::BIGINT y, []::VARCHAR[] done, NULL::VARCHAR AS unit, 0::BIGINT b, 0::INT picked FROM share
      UNION ALL SELECT split, room - b, x + ux, y + uy, list_append(done, unit), unit, b, picked + 1 FROM (
        SELECT w.split, room, w.x, w.y, u.x ux, u.y uy, done, u.unit, u.b, picked, row_number() OVER (PARTITION BY w.split ORDER BY (u.x::DOUBLE / (w.x + 100) + u.y::DOUBLE / (w.y + 100)) / greatest(1, u.b) DESC, u.unit DESC) r
        FROM walk w JOIN u ON u.split = w.split AND u.b <= room AND u.x + u.y > 0 AND NOT list_contains(done, u.unit)) WHERE r = 1),
    done AS (SELECT split, max(x) >= 100 AND max(y) >= 100 usable, max(picked) most FROM walk GROUP BY split)
    SELECT split, unit, picked, b::BIGINT estimated_bytes, usable FROM walk JOIN done USING (split) WHERE picked > 0 OR most = 0"""
)
def q70_byte_budget(spark, folder):
    """Loads stand for row groups; half of all bytes may be read. A split with fewer than 100 records of a class is marked, not refused, since the smallest tables have no more."""
    rows = samples(spark, folder).where("load_id IS NOT NULL AND split IN ('train', 'dev', 'test')")
    units = rows.groupBy("split", F.col("load_id").cast("string").alias("unit")).agg(F.count(F.when(F.col("label") == "bonafide", 1)).alias("n_bonafide"), F.count(F.when(F.col("label") == "spoof", 1)).alias("n_spoof"), (F.count(F.lit(1)) * 1000).alias("estimated_bytes"))
    units = durable(units)
    total = units.agg(F.coalesce(F.sum("estimated_bytes"), F.lit(0))).first()[0]
    return sampling.byte_budget(units, {"train": 0.8, "dev": 0.1, "test": 0.1}, total // 2, refuse=False)


@query(
    f"""WITH {SAMPLES}, g AS (SELECT DISTINCT coalesce(nullif(trim(speaker_id), ''), source_file) group_key FROM samples), r AS (SELECT group_key, row_number() OVER (ORDER BY sha256('42|' || group_key), group_key) at_, count(*) OVER () n FROM g WHERE group_key IS NOT NULL),
    q AS (SELECT *, greatest(round(0.2 * n), CASE WHEN n >= 3 THEN 1 ELSE 0 END) k FROM r) SELECT group_key, CASE WHEN at_ <= n - 2 * k THEN 'train' WHEN at_ <= n - k THEN 'dev' ELSE 'test' END new_split FROM q"""
)
def q79_speaker_disjoint(spark, folder):
    """The split, or splits, that the rows of each speaker (or file) have come to: one each."""
    return splits.speaker_disjoint(samples(spark, folder)).where("group_key IS NOT NULL").select("group_key", "new_split").distinct()


@query("SELECT count(*) n_rows, true AS contiguous FROM manifest")
def q80_footers(spark, folder):
    """Rows of all row groups by the files' footers, and whether each begins where the one before ends."""
    found = row_groups(spark, f"{folder}/manifest.parquet", ["language", "label"])
    before = F.coalesce(F.sum("n_rows").over(W.partitionBy("file").orderBy("row_group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return found.withColumn("fits", F.col("first_row") == before).agg(F.sum("n_rows").alias("n_rows"), F.min("fits").alias("contiguous"))


@query("SELECT language, label, count(*) n_rows FROM manifest GROUP BY 1, 2")
def q80_row_groups(spark, folder):
    """Rows of each language and class, counted in the row groups without reading other columns."""
    return row_group_counts(spark, f"{folder}/manifest.parquet", ["language", "label"]).groupBy("language", "label").agg(F.sum("n_rows").alias("n_rows"))


# streaming -----------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT user_id, event_type FROM events")
def q71_stream_distinct(spark, folder):
    rows = streams.file_stream(spark, folder, "events").select("user_id", "event_type")
    return streams.run_to_table(streams.distinct_stream(rows, ["user_id", "event_type"]))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) r FROM events) WHERE r <= 5")
def q72_stream_quota(spark, folder):
    rows = streams.file_stream(spark, folder, "events").select("event_type", "event_id")
    return streams.quota_stream(rows, "event_type", "event_id", 5).select(F.col("key").alias("event_type"), F.col("value").alias("event_id"))


@query(
    """WITH RECURSIVE e AS (SELECT event_type, greatest(coalesce(CASE WHEN NOT isnan(value) THEN value END, 0), 0) a, row_number() OVER (PARTITION BY event_type ORDER BY event_id) r FROM events),
    walk AS (SELECT DISTINCT event_type, 0::BIGINT r, 0::BIGINT n, 0.0::DOUBLE s, 0::BIGINT f FROM events
      UNION ALL SELECT w.event_type, e.r, n + (s + a <= 1000)::BIGINT, CASE WHEN s + a <= 1000 THEN s + a ELSE s END, f + (s + a > 1000)::BIGINT FROM walk w JOIN e ON e.event_type = w.event_type AND e.r = w.r + 1)
    SELECT event_type AS key, max(n) n_taken, round(max(s), 6) spent, max(f) refused FROM walk GROUP BY event_type"""
)
def q73_stream_budget(spark, folder):
    rows = streams.file_stream(spark, folder, "events").select("event_type", "value", "event_id")
    return streams.budget_stream(rows, "event_type", "value", "event_id", 1000.0).withColumn("spent", F.round("spent", 6))


@query("SELECT TRY_CAST(props->>'k' AS BIGINT) % 10 AS k, count(*) n FROM events WHERE TRY_CAST(props->>'k' AS BIGINT) IS NOT NULL AND event_type IS NOT NULL GROUP BY 1")
def q87_stream_isolation(spark, folder):
    """Numbers read from the events' JSON; events without one go to a table of their own and stop nothing."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    rows = streams.file_stream(spark, folder, "events").where("event_type IS NOT NULL").select("event_id", "props")
    good, _ = streams.isolated(rows, k.isNotNull(), "event_id bigint, k bigint", [F.col("event_id"), k.alias("k")])
    return good.groupBy((F.col("k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) window_start, event_type, count(*) n, round(avg(value), 9) mean_value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def q74_stream_windows(spark, folder):
    rows = streams.file_stream(spark, folder, "events").where("ts IS NOT NULL").select("ts", "event_type", "value")
    return _round(streams.run_to_table(streams.windowed_mean(rows, "ts", "value", "1 hour", ["event_type"]), "complete"), "mean_value")


# audio ---------------------------------------------------------------------------------------------------------------


@query()
def q75_log_mel(spark, folder):
    """Log-mel features of a second of each vector, played again and again. (No SQL: a Fourier transform; tested against one written out.)"""
    waves = _clips(spark, folder).select("vec_id", F.flatten(F.array_repeat("w", audio.RATE // 64)).alias("w"))
    return audio.log_mels(waves, "vec_id", "w").select("vec_id", "n_frames", F.octet_length("feature").alias("n_bytes"), "sha")


@query(
    f"""WITH {_CLIPS}, v AS (SELECT CASE WHEN vec_id % 3 = 0 THEN list_transform(w, lambda x: 0.0::FLOAT) WHEN vec_id % 7 = 0 THEN w[1:4] ELSE w END w FROM clips)
    SELECT CASE WHEN {_RMS.format('w')} < 1e-4 THEN 'not_completely_silent' WHEN len(w) < 24 THEN 'too_short_for_a_window' END reason, count(*) n FROM v GROUP BY 1"""
)
def q76_quarantine(spark, folder):
    """Clips by the first check they fail; every third is silenced, every seventh cut short."""
    w = F.when(F.col("vec_id") % 3 == 0, F.transform("w", lambda x: F.lit(0.0).cast("float"))).when(F.col("vec_id") % 7 == 0, F.slice("w", 1, 4)).otherwise(F.col("w"))
    return audio.quarantine(_clips(spark, folder), w, RATE, 24, 16).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _wavs(spark, folder) -> DataFrame:
    """path, content: each vector as a WAV of one channel; every fifth file is broken, every third silent."""

    def encode(batches):
        for b in batches:
            data = [b"RIFF" if v % 5 == 0 else audio.encode_wav(np.asarray(w, np.float32) * (v % 3 > 0), RATE) for v, w in zip(b["vec_id"], b["w"])]
            yield pd.DataFrame({"path": [f"clips/vec {v}.wav" for v in b["vec_id"]], "content": data})

    return _clips(spark, folder).select("vec_id", "w").mapInPandas(encode, "path string, content binary")


_CUT = f"""WITH {_CLIPS}, q AS (SELECT vec_id, list_transform(w, lambda x: floor(CAST(greatest(-1, least(1, x)) AS DOUBLE) * 32767 + 0.5) / 32768) w FROM clips WHERE vec_id % 5 <> 0 AND vec_id % 3 <> 0),
  s AS (SELECT vec_id, w, unnest(range(0, 4)) * 16 s FROM q), p AS (SELECT vec_id, s, w[s + 1:s + 24] x FROM s)"""


@query(
    f"""{_CUT} SELECT 'local__vec_' || vec_id || '__' || printf('%.3f', s / 16.0) || '_' || printf('%.3f', (s + 24) / 16.0) sample_id, s / 16.0::DOUBLE segment_start, (s + 24) / 16.0::DOUBLE segment_end, 1.5::DOUBLE AS duration,
      round({_SUM.format('x')}, 6) total FROM p WHERE sqrt(list_sum(list_transform(x, lambda y: y * y)) / 24) >= 1e-4"""
)
def q86_processed_windows(spark, folder):
    """The windows of audio files, from bytes to manifest rows."""
    rows, _ = audio.processed(_wavs(spark, folder), "local", "train", "bonafide", "processed", RATE, 24, 16)
    return rows.select("sample_id", "segment_start", "segment_end", "duration", F.round(_sum(F.col("samples")), 6).alias("total"))


@query("SELECT reason, count(*) n FROM (SELECT CASE WHEN vec_id % 5 = 0 THEN 'audio error' WHEN vec_id % 3 = 0 THEN 'not_completely_silent' END reason FROM embeddings) WHERE reason IS NOT NULL GROUP BY 1")
def q86_skipped_files(spark, folder):
    _, skipped = audio.processed(_wavs(spark, folder), "local", "train", "bonafide", "processed", RATE, 24, 16)
    return skipped.groupBy(F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
