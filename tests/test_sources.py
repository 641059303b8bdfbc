"""Readers, adapters, sinks and streams on small files."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan.functions import fields
from sonoplan.operators import audio, checks, sampling
from sonoplan.plans import arrays
from sonoplan.sources import metadata, sinks
from sonoplan.streaming import streams


def write(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding)
    return str(path)


def values(df):
    return [json.loads(r[0]) for r in df.orderBy("row_no").select(F.to_json("row")).collect()]


def test_read_rows(spark, tmp_path):
    csv = write(tmp_path / "a.csv", '﻿id,text\n007,"a ""q"" b"\n008,"two\nlines"\n')
    assert values(metadata.read_rows(spark, csv)) == [{"id": "007", "text": 'a "q" b'}, {"id": "008", "text": "two\nlines"}]
    lines = write(tmp_path / "b.jsonl", '{"a": 1}\n\n{"a": {"b": 2}}\n')
    assert values(metadata.read_rows(spark, lines)) == [{"a": 1}, {"a": {"b": 2}}]
    array = write(tmp_path / "c.json", '[{"a": 1}, {"a": null}]')
    assert values(metadata.read_rows(spark, array)) == [{"a": 1}, {"a": None}]
    with pytest.raises(Exception):
        metadata.read_rows(spark, write(tmp_path / "d.jsonl", '{"a": 1}\n[1]\n')).collect()
    with pytest.raises(ValueError):
        metadata.read_rows(spark, lines, most_rows=1)
    with pytest.raises(ValueError):
        metadata.read_rows(spark, lines, most_bytes=3)


def test_adapters(spark, tmp_path):
    real = write(tmp_path / "r.json", json.dumps([{"sample_id": "r1", "audio.path": "x/y.WAV", "speaker_id": 42.0, "lang": "hi_IN", "gender": "M", "duration": 4, "sample_rate": 48000, "channels": 1}, {"audio": {"path": "nested/z.flac"}, "speaker_id": "nan", "lang": "Punjabi"}]))
    fake = write(tmp_path / "f.json", json.dumps([{"sample_id": "f1", "Target Speaker ID": "7", "Generative Model": "m", "language": "Hindi", "Gender": "Female"}]))
    other = write(tmp_path / "o.jsonl", '{"sample_id": "o1", "label": "1", "notes": "{\\"speaker_id\\": \\"s9\\", \\"codec\\": \\"opus\\", \\"vocoder\\": \\"v\\"}"}\n')
    got = metadata.load_inputs(spark, {"indicvoices": [{"path": real}], "indicsynth": [{"path": fake}], "asvspoof": [{"path": other, "label_map": {"1": "spoof"}}]})
    assert got.columns == [*metadata.MANIFEST, *metadata.EXTRA]
    rows = {r.sample_id: r for r in got.collect()}
    r = rows["r1"]
    assert (r.speaker_id, r.language, r.gender, r.duration, r.file_format, r.label, r.source_file) == ("indicvoices::42", "hi", "male", 4.0, "wav", "bonafide", "x/y.WAV")
    made = next(r for k, r in rows.items() if k.startswith("indicvoices__"))
    assert made.source_file == "nested/z.flac" and made.speaker_id is None and len(made.sample_id) == len("indicvoices__") + 24
    assert (rows["f1"].generator, rows["f1"].speaker_id, rows["f1"].label, rows["f1"].gender) == ("m", "indicsynth::7", "spoof", "female")
    o = rows["o1"]
    assert (o.label, o.speaker_id, o.codec, o.generator, o.split) == ("spoof", "asvspoof::s9", "opus", "v", "external")
    with pytest.raises(ValueError):
        metadata.load_inputs(spark, {"indicvoices": [{"path": real}, {"path": real}]})
    with pytest.raises(ValueError):
        metadata.load_inputs(spark, {})
    with pytest.raises(ValueError):
        metadata.adapt(metadata.read_rows(spark, real), "indicvoices", field_map={"nothing": "x"})


def test_other_readers(spark, tmp_path):
    table = write(tmp_path / "m.csv", "path;original_file;language\na;b;en\n")
    assert metadata.read_sniffed(spark, table).columns == ["path", "original_file", "language"]
    with pytest.raises(Exception):
        metadata.read_strict_json(spark, write(tmp_path / "n.json", '{"x": NaN}'), "x double").collect()
    spark.range(10).write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError):
        metadata.read_required(spark, str(tmp_path / "t"), ["id", "gone"])
    assert metadata.row_groups(spark, str(tmp_path / "t"), ["id"]).agg(F.sum("n_rows")).first()[0] == 10
    assert metadata.contiguous(spark.range(5), "id").first().contiguous
    assert not metadata.contiguous(spark.range(1, 5), "id").first().contiguous
    offered = spark.createDataFrame([("Hindi",), ("Tamil",)], "config string")
    assert {tuple(r) for r in metadata.requested_subsets(["hindi", "odia"], offered).collect()} == {("hindi", "Hindi"), ("odia", None)}
    probe = {(r.source, r.status) for r in metadata.source_probe(spark, {("a", "hi"): str(tmp_path / "t"), ("b", "hi"): str(tmp_path / "none")}).collect()}
    assert probe == {("a", "inspected"), ("b", "error")}
    good = spark.createDataFrame([(1, b"x")], "id int, feature binary").withColumn("sha", F.sha2("feature", 256))
    assert metadata.feature_errors(good).count() == 0 and metadata.feature_errors(good.withColumn("sha", F.lit("0"))).count() == 1


def manifest(spark, ids):
    kinds = ", ".join(f"{c} {metadata.TYPES.get(c, 'string')}" for c in metadata.MANIFEST)
    return spark.createDataFrame([(i, f"{i}.wav", None, "d", "bonafide", "d::1", "hi", None, 1.0, 16000, 0.0, 1.0, None, None, None, "unassigned") for i in ids], kinds)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "manifest")
    sinks.append_manifest(manifest(spark, ["a", "b"]), path)
    sinks.append_manifest(manifest(spark, []), path)
    sinks.append_manifest(manifest(spark, ["c"]), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        sinks.append_manifest(manifest(spark, ["c"]), path)
    with pytest.raises(ValueError):
        sinks.append_manifest(manifest(spark, ["z"]).withColumn("label", F.lit("maybe")), path)
    sinks.write_json(str(tmp_path / "x.json"), {"b": 1, "a": None})
    assert (tmp_path / "x.json").read_text() == '{\n  "a": null,\n  "b": 1\n}\n'
    with pytest.raises(ValueError):
        sinks.write_json(str(tmp_path / "y.json"), {"a": math.nan})
    sinks.write_reports(spark.read.parquet(path), str(tmp_path / "reports"))
    assert spark.read.option("header", True).csv(str(tmp_path / "reports/balance_label")).first().clips == "3"


def test_audio_files(spark, tmp_path):
    tones = spark.createDataFrame([("t1", [0.25] * 1600), ("t2", [0.0] * 1600)], "id string, w array<float>")
    sinks.write_audio(tones, str(tmp_path / "wavs"), "id", "w", 8000).collect()
    (tmp_path / "wavs/broken.wav").write_bytes(b"RIFFnothing")
    got = audio.decoded(metadata.audio_files(spark, str(tmp_path / "wavs")))
    rows = {r.path.rsplit("/", 1)[1]: r for r in got.collect()}
    assert rows["t1.wav"].sample_rate == 8000 and len(rows["t1.wav"].samples) == 3200 and abs(np.median(rows["t1.wav"].samples) - 0.25) < 1e-2
    assert rows["broken.wav"].audio_error and rows["broken.wav"].samples is None
    listed = got.select("path").withColumn("audio_error0", F.lit(1))
    seen = {r.path.rsplit("/", 1)[1]: r for r in audio.inspected(listed, got, "path").collect()}
    assert seen["t2.wav"].almost_silent and not seen["t1.wav"].almost_silent and seen["broken.wav"].rms is None


def test_resumable_sink(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(i, i * 2) for i in range(20)], "id int, v int").repartition(3).write.parquet(str(source))
    folder, schema = f"file://{tmp_path}/sink", "id int, v int"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    assert streams.resumable_copy(stream(), folder, "id", {"v": 1}) >= 1
    assert streams.resumable_copy(stream(), folder, "id", {"v": 1}) == 0
    spark.createDataFrame([(5, 0), (99, 0)], schema).write.mode("append").parquet(str(source))
    streams.resumable_copy(stream(), folder, "id", {"v": 1})
    rows = {r.id: r.v for r in spark.read.parquet(f"{folder}/data").collect()}
    assert len(rows) == 21 and rows[5] == 10
    with pytest.raises(ValueError):
        streams.resumable_copy(stream(), folder, "id", {"v": 2})


def test_streams_of_many_files(spark, tmp_path):
    """A rare key of the first file only, one file a batch; the same results as of one batch."""
    rng = random.Random(3)
    rows = [(k, "rare" if k in (1, 4) else rng.choice(["a", "b", None]), rng.choice([None, float("nan"), -1.0, *[rng.random() * 40 for _ in range(9)]])) for k in range(600)]
    schema = "event_id bigint, kind string, amount double"
    for k in range(12):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    stream = lambda: streams.file_stream(spark, str(tmp_path), "events", 1)
    want = {}
    for i, k, a in rows:
        a = 0.0 if a is None or a != a or a < 0 else a
        n, s, r = want.get(k, (0, 0.0, 0))
        want[k] = (n + 1, s + a, r) if s + a <= 500 else (n, s, r + 1)
    got = {r.key: (r.n_taken, r.spent, r.refused) for r in streams.budget_stream(stream(), "kind", "amount", "event_id", 500.0).collect()}
    assert {k: (n, round(s, 6), r) for k, (n, s, r) in got.items()} == {k: (n, round(s, 6), r) for k, (n, s, r) in want.items()} and got["rare"][0] == 2 and got["a"][2]
    quota = sorted(((r.key or "", r.value) for r in streams.quota_stream(stream(), "kind", "event_id", 4).collect()))
    assert quota == sorted((k or "", i) for k in ("a", "b", "rare", None) for i in [i for i, x, _ in rows if x == k][:4])
    good, bad = streams.isolated(stream(), F.col("amount") >= 0, "event_id bigint", [F.col("event_id")])
    assert good.count() + bad.count() == 600 and bad.where("amount >= 0 AND NOT isnan(amount)").count() == 0


def test_greedy_plan_keeps_its_limits(spark):
    rows = [(d, f"{d}{i}", lab, "hi", f"s{i % 7}{lab}", g, float(3 + i % 4)) for i in range(200) for d, lab, g in (("a", "bonafide", None), ("b", "spoof", f"g{i % 3}"))]
    df = spark.createDataFrame(rows, "dataset string, sample_id string, label string, language string, speaker_id string, generator string, duration double")
    budget = sampling.Budget({"bonafide": 120.0, "spoof": 120.0}, clips_per_speaker=5, speakers=12)
    got = sampling.greedy_plan(df, [("bonafide", "hi"), ("spoof", "hi")], budget).toPandas()
    assert got.groupby("label").duration.sum().max() <= 120 and got.groupby("speaker_id").size().max() <= 5 and got.speaker_id.nunique() <= 12
    spoof = got[got.label == "spoof"]
    assert spoof.groupby("generator").duration.sum().max() <= 0.6 * spoof.duration.sum() + 1e-9
    assert sampling.greedy_plan(df.limit(0), [("bonafide", "hi")], budget).count() == 0


def greedy_over_all(rows, cells, b):
    """The reference's loop: every row is a candidate of every pick. Chosen (dataset, sample_id)."""
    target = {c: b.seconds[c[0]] / sum(x[0] == c[0] for x in cells) for c in cells}
    rank = {r: hashlib.sha256(f"{b.seed}|{r[0]}|{r[1]}".encode()).hexdigest() for r in rows}
    used, clips, seen, gen, left, chosen = Counter(), Counter(), {c: set() for c in cells}, Counter(), set(rows), []
    while True:
        best = None
        for r in left:
            cell, who, maker, d = (r[2], r[3]), r[4], r[5], r[6]
            if used[cell] + d > target[cell] + 1e-9 or clips[who] >= b.clips_per_speaker or (not clips[who] and len(+clips) >= b.speakers):
                continue
            if r[2] == "spoof" and gen[maker] + d > b.seconds["spoof"] * b.generator_share + 1e-9:
                continue
            fresh = len(seen[cell]) < b.speakers_per_cell and who not in seen[cell]
            score = (not fresh, used[cell] / target[cell], clips[who], gen[maker] if r[2] == "spoof" else 0, rank[r])
            best = min(best, (score, r)) if best else (score, r)
        if not best:
            break
        r = best[1]
        left.remove(r)
        chosen.append(r)
        used[r[2], r[3]] += r[6]
        clips[r[4]] += 1
        seen[r[2], r[3]].add(r[4])
        if r[2] == "spoof":
            gen[r[5]] += r[6]
    while True:
        total = Counter()
        for r in chosen:
            if r[2] == "spoof":
                total[r[5]] += r[6]
        if not total or max(total.values()) <= b.generator_share * sum(total.values()) + 1e-9:
            return {r[:2] for r in chosen}
        top = min(g for g in total if total[g] == max(total.values()))
        chosen.remove([r for r in chosen if r[5] == top][-1])


def test_greedy_plan_against_all_rows(spark):
    """One speaker with far more clips than it may give, most too long for what is left; more speakers than are tried at first."""
    rng = random.Random(21)
    cells = [(a, b) for a in ("bonafide", "spoof") for b in ("hi", "ta")]
    for speakers, limit in ((4, 3), (60, 45), (90, 80)):
        rows = []
        for i in range(500):
            label, lang = rng.choice(cells)
            who = "loud" if rng.random() < 0.3 else f"s{rng.randrange(speakers)}"
            rows.append(("d", f"{i}", label, lang, who, f"g{rng.randrange(3)}" if label == "spoof" else None, rng.choice([1.5, 2.25, 7.0, 19.5, 31.0])))
        budget = sampling.Budget({"bonafide": 240.0, "spoof": 200.0}, clips_per_speaker=20, speakers=limit)
        df = spark.createDataFrame(rows, "dataset string, sample_id string, label string, language string, speaker_id string, generator string, duration double")
        got = sampling.greedy_plan(df, cells, budget).select("dataset", "sample_id").collect()
        assert {tuple(r) for r in got} == greedy_over_all(rows, cells, budget) and len(got) == len(set(got))


def test_byte_budget_against_a_loop(spark):
    rng = random.Random(22)
    units = [(f"u{i:02d}", rng.choice(["train", "dev", "test"]), rng.randrange(60), rng.randrange(60), rng.randrange(1, 9000)) for i in range(90)]
    shape, shares, budget = "unit string, split string, n_bonafide bigint, n_spoof bigint, estimated_bytes bigint", {"train": 0.8, "dev": 0.1, "test": 0.1}, 200_000
    want = []
    for split, share in shares.items():
        left, a, b, pool, n = int(budget * share), 0, 0, sorted(u for u in units if u[1] == split and u[2] + u[3]), 0
        while fits := [u for u in pool if u[4] <= left]:
            u = max(fits, key=lambda u: ((u[2] / (a + 100) + u[3] / (b + 100)) / u[4], u[0]))
            pool.remove(u)
            a, b, left, n = a + u[2], b + u[3], left - u[4], n + 1
            want.append((split, u[0], n, u[4], True))
        assert min(a, b) >= 100
    df = spark.createDataFrame(units, shape)
    assert sorted(map(tuple, sampling.byte_budget(df, shares, budget).collect())) == sorted(want)
    # too few bytes, or a split without units, is an error or marked
    for few, bytes_ in ((df, 2_000), (df.where("split <> 'dev'"), budget)):
        with pytest.raises(Exception, match="no usable"):
            sampling.byte_budget(few, shares, bytes_).collect()
        marked = sampling.byte_budget(few, shares, bytes_, refuse=False).collect()
        assert {r.split for r in marked} == set(shares) and not any(r.usable for r in marked if r.split == "dev")


def test_byte_budget_grows_with_the_table(spark):
    for size in ("sf0.01", "sf0.1"):
        got = arrays.q70_byte_budget(spark, f"/root/testdata/{size}").collect()
        assert {r.split for r in got} == {"train", "dev", "test"} and all(r.usable and r.unit for r in got)


def test_archives_and_features(spark, tmp_path):
    import io
    import tarfile

    data = audio.encode_wav(np.full(70000, 0.1, np.float32), 16000)
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        for name, content in (("x/one.wav", data), ("x/readme.txt", b"no")):
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    found = metadata.archive_members(spark, str(tmp_path / "a.tar.gz"), ".wav")
    assert [r.member for r in found.select("member").collect()] == ["x/one.wav"]
    assert metadata.archive_members(spark, str(tmp_path / "a.tar.gz"), ".wav", found.select("archive", "member")).count() == 0
    clips = audio.decoded(found.select(F.col("member").alias("path"), "content"))
    rows = {r.place: r.n_frames for r in audio.window_features(clips).collect()}
    assert rows == {0: 401, 1: 401}


def test_reasons_and_plans(spark):
    rows = [(0, "LA_T_0000001", "LA_0001", "-"), (1, "LA_T_0000002", "LA_0001", "A01"), (1, "LA_T_0000003", "LA_0001", "-"), (1, "LA_D_0000003", "LA_0001", "A01"), (None, "LA_T_0000003", "LA_0001", "A01"), (1, "LA_T_0000003", "x", "A01")]
    df = spark.createDataFrame(rows, "key int, audio_file_name string, speaker_id string, system_id string")
    assert [r[0] for r in df.select(checks.first_reason(fields.contract_reason("T"))).collect()] == [None, None, "attack", "id", "label", "speaker"]
    scores = spark.createDataFrame([(0.5, 0.5, 10.0, 2.0, 4.0), (1.5, 0.5, 10.0, 2.0, 4.0), (float("nan"), 0.5, 10.0, 2.0, 4.0), (0.5, 0.5, 5.0, 2.0, 4.0), (None, 0.5, 5.0, 2.0, 4.0)], "synthetic_score double, threshold double, duration_seconds double, window_start_seconds double, window_seconds double")
    assert [r[0] for r in scores.select(checks.first_reason(fields.score_reason())).collect()] == [None, "score", "score", "window", "score"]
    inventory, known = spark.createDataFrame([("a", 1), ("b", 2)], "path string, size int"), spark.createDataFrame([("a", "x"), ("b", "y")], "path string, text string")
    assert metadata.enriched_plan(inventory, known, "path").count() == 2
    with pytest.raises(ValueError):
        metadata.enriched_plan(inventory, known.limit(1), "path")


def test_metric_files(spark, tmp_path):
    scored = spark.createDataFrame([(0, 0.1), (0, 0.6), (1, 0.4), (1, 0.9)], "label int, score double")
    sinks.write_metrics(scored, str(tmp_path / "m"))
    assert json.loads((tmp_path / "m/metrics.json").read_text())["roc_auc"] == 0.75
    assert spark.read.option("header", True).csv(str(tmp_path / "m/per_class")).count() == 2
    with pytest.raises(Exception):
        sinks.write_metrics(scored, str(tmp_path / "m"))
