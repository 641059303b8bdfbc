"""Audits, partitions, settings, row groups and archives on small cases: errors, nulls, ties, repeats and empty tables."""

from __future__ import annotations

import dataclasses
import io
import json
import random
import tarfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sonoplan.operators import audio, audit, balance, checks, leakage, metrics, sampling, splits
from sonoplan.sources import metadata, sinks
from sonoplan.streaming import streams


def test_settings_refuse_what_makes_no_sense():
    for wrong in ({"categorical": (0.5, 0.2)}, {"missing": (0.2, 1.5)}, {"duration_ratio": (0.9, 2.0)}, {"rms_gap": (float("nan"), 1.0)}):
        with pytest.raises(ValueError):
            audit.Thresholds(**wrong)
    for wrong in ({"seconds": {"spoof": 0.0}}, {"seconds": {}, "speakers": 0}, {"seconds": {}, "generator_share": 0.0}, {"seconds": {}, "tolerance": 1.0}, {"seconds": {}, "speakers": True}):
        with pytest.raises(ValueError):
            sampling.Budget(**wrong)
    assert sampling.class_seconds(2.0) == {"bonafide": 3600.0, "spoof": 3600.0} and sampling.class_seconds() == {"bonafide": 3600.0, "spoof": 3600.0}
    for wrong in ({"total_hours": -1.0}, {"per_class": {"spoof": 1.0}}):
        with pytest.raises(ValueError):
            sampling.class_seconds(**wrong)


def test_findings_without_a_class(spark):
    rows = spark.createDataFrame([("spoof", "d", 1.0, "s", "g", "hi", None)], "label string, dataset string, duration double, speaker_id string, generator string, language string, codec string")
    assert audit.audit_state(rows).first()[0] == "insufficient_data" and audit.findings(rows).count() == 0
    both = rows.unionByName(rows.withColumn("label", F.lit("bonafide")).withColumn("duration", F.lit(4.0)))
    got = {r.code: (r.value, r.severity) for r in audit.findings(both).collect()}
    assert got["missing_rms"] == (1.0, "HIGH") and got["missing_codec"] == (1.0, "HIGH") and got["duration"] == (4.0, "HIGH") and "codec" not in got and "loudness_rms" not in got
    assert audit.findings(both.limit(0)).count() == 0


def test_summary_of_nothing_and_of_negative_durations(spark):
    rows = spark.createDataFrame([("f", "s", -1.0, "hi")], "source_file string, speaker_id string, duration double, language string")
    with pytest.raises(ValueError):
        balance.summary(rows, ["language"])
    got = {(r.section, r.name): r.value for r in balance.summary(rows.limit(0), ["language", "codec"]).collect()}
    assert got["rows", "total_rows"] == 0 and got["duration", "mean"] is None
    assert {(r.section, r.name) for r in balance.summary(rows, ["language", "codec"], refuse=False).collect()} >= {("distribution:language", "hi"), ("distribution:codec", "missing")}
    assert balance.histogram(rows.limit(0), "duration", "language").count() == 0
    assert [(r.bin, r.n) for r in balance.histogram(rows, "duration", "language").collect()] == [(0, 1)]


DELIVERED = "row_id string, utterance_id string, speaker_id string, audio_sha256 string, language string, split string, label string, text string, is_text_exact boolean"


def test_metadata_audit(spark):
    digest, long = "a" * 64, "This  is a Long enough\ttext"
    rows = [
        ("r1", "u1", "s1", digest, "en", "train", "spoof", long, True), ("r2", "u1", None, "A" * 64, "en", "validation", "bonafide", "this is a long enough text", True), ("r2", "u3", " ", digest, "en", "evaluation", "spoof", "short", True),
        ("r4", None, "s1", None, "xx", "train", "spoof", None, None), ("", None, "s1", None, "en", "train", "spoof", None, None), ("r5", None, "s9", None, "en", None, "spoof", None, None), ("r6", "u1", "s1", None, "hi", "train", "spoof", long, False),
    ]
    found = leakage.metadata_audit(spark.createDataFrame(rows, DELIVERED), "en")
    got = {(r.kind, r.name): r.n for r in found.collect()}
    assert got["invalid", "unknown_language"] == 1 and got["invalid", "invalid_split_label_or_row_id"] == 2 and got["invalid", "duplicate_row_id"] == 1 and got["invalid", "invalid_audio_sha256"] == 1
    assert got["count", "train/en/spoof"] == 1 and got["missing_cell", "train/en/bonafide"] == 0 and ("missing_cell", "train/hi/spoof") not in got
    assert [got["overlap", c] for c in ("row_id", "utterance_id", "speaker_id", "audio_sha256", "exact_text")] == [1, 1, 0, 1, 1] and got["coverage", "speaker_id"] == 1
    assert tuple(leakage.audit_status(found).first()) == ("issues_found", 3, "unverified", "unverified")
    clean = [(f"r{n}", f"u{n}", f"s{n}", f"{n:064x}", "en", s, k, None, None) for n, (s, k) in enumerate((s, k) for s in ("train", "validation", "evaluation") for k in ("spoof", "bonafide"))]
    assert tuple(leakage.audit_status(leakage.metadata_audit(spark.createDataFrame(clean, DELIVERED), "en")).first()) == ("metadata_checks_passed", 6, "checked_for_supplied_ids", "checked_for_supplied_hashes")
    empty = leakage.audit_status(leakage.metadata_audit(spark.createDataFrame([], DELIVERED), "all")).first()
    assert tuple(empty) == ("issues_found", 0, "unverified", "unverified")
    with pytest.raises(ValueError):
        leakage.metadata_audit(spark.createDataFrame([], DELIVERED), "xx")


def test_partition_keeps_originals_and_refuses(spark):
    schema = "id string, label int, original string, w string, t string"
    rng = random.Random(5)
    rows = [(f"i{n:03d}", n % 2, f"o{n // 2}", f"w{n}", rng.choice([None, f"t{n // 10}"])) for n in range(200)]
    rows += [("j0", 0, "o500", "w0", None), ("j1", 1, None, None, None), ("j2", 0, None, None, None)]
    made = lambda x: spark.createDataFrame(x, schema)
    got = splits.partition(made(rows), "id", "label", "original", "w", ["t"], minimum=0).toPandas().set_index("id")
    assert len(got) == 202 and "j0" not in got.index and got.root["j1"] != got.root["j2"]
    of = {r[0]: r for r in rows}
    for key in (2, 4):
        held = {}
        for i in got.index:
            if of[i][key] is not None:
                held.setdefault(of[i][key], set()).add(got.new_split[i])
        assert all(len(s) == 1 for s in held.values())
    for wrong in ([*rows, rows[0]], [*rows, ("x", 2, "o", None, None)], [*rows, ("x", 1, "o1", "w0", None)]):
        with pytest.raises(ValueError):
            splits.partition(made(wrong), "id", "label", "original", "w", ["t"], minimum=0)
    with pytest.raises(ValueError):
        splits.partition(made(rows), "id", "label", "original", "w", ["t"], minimum=100)


def test_profiles_and_disjointness(spark):
    rows = spark.createDataFrame([("a", "train", 0, "x"), ("b", "validation", 1, "y"), ("c", "test", 0, "z"), ("d", "test", 1, "x")], "id string, split string, label int, speaker string")
    with pytest.raises(ValueError):
        checks.Profile().check(rows)
    loose = dataclasses.replace(checks.Profile(), identities=("id",), counts=(("test", 2),))
    assert loose.check(rows).count() == 4
    for wrong in ({"counts": (("test", 3),)}, {"splits": ("train",)}, {"minimum": 2}):
        with pytest.raises(ValueError):
            dataclasses.replace(loose, **wrong).check(rows)
    with pytest.raises(ValueError):
        sampling.balanced(rows, "split", ["label"], "id", 5, "1", minimum=2)


def test_scores_by_id(spark):
    rows, scores = spark.createDataFrame([("a", 1), ("b", 0)], "id string, label int"), spark.createDataFrame([("b", 0.2), ("a", 0.9)], "id string, score double")
    assert {r.id: r.score for r in metrics.scored(rows, scores, "id").collect()} == {"a": 0.9, "b": 0.2}
    for wrong in (scores.where("id = 'a'"), scores.unionByName(scores.where("id = 'a'")), scores.unionByName(spark.createDataFrame([("z", 0.1)], "id string, score double"))):
        with pytest.raises(Exception, match="no single score"):
            metrics.scored(rows, wrong, "id").collect()
    with pytest.raises(ValueError):
        sampling.attack_sample(rows.withColumn("attack", F.lit("A1")), "attack", "id", 2, "7")
    assert metrics.best_epoch(spark.createDataFrame([(2, 0.5), (1, 0.5), (3, None)], "epoch int, dev_loss double")).first().epoch == 1
    assert metrics.best_epoch(spark.createDataFrame([], "epoch int, dev_loss double")).count() == 0


def test_row_groups_by_plan(spark, tmp_path):
    kinds = [(f"r{n}", "en" if n % 3 else "hi", "train", "spoof" if n % 2 else "bonafide", n) for n in range(60)]
    table = pa.table({c: [r[k] for r in kinds] for k, c in enumerate(("row_id", "language", "split", "label", "value"))})
    path = tmp_path / "part.parquet"
    pq.write_table(table, path, row_group_size=20)
    counts = metadata.row_group_counts(spark, str(path), ["language", "label"])
    assert counts.agg(F.sum("n_rows")).first()[0] == 60 and counts.where("language = 'en' AND row_group = 1").agg(F.sum("n_rows")).first()[0] == sum(n % 3 > 0 for n in range(20, 40))
    plan = counts.where("language = 'en' AND row_group > 0").groupBy("file", "row_group").agg(F.sum("n_rows").alias("n_rows")).withColumn("unit", F.concat(F.lit("u"), "row_group"))
    read = metadata.read_planned_groups(spark, plan, "en", "train")
    assert sorted(r.value for r in read.collect()) == [n for n in range(20, 60) if n % 3]
    assert metadata.covered(read, plan).count() == 0 and metadata.covered(read.where("unit = 'u1'"), plan).first().unit == "u2"
    for wrong in (lambda: metadata.read_planned_groups(spark, plan, "en", "test").collect(), lambda: metadata.read_planned_groups(spark, plan.withColumn("n_rows", F.lit(1)), "en", "train").collect(), lambda: metadata.read_planned_groups(spark, plan.limit(0), "en", "train")):
        with pytest.raises(Exception):  # noqa: B017
            wrong()
    assert metadata.row_groups(spark, str(path), ["value"]).count() == 3
    with pytest.raises(Exception, match="no audio of row 9"):
        metadata.by_ordinal(spark.createDataFrame([(1,), (9,)], "n int"), spark.createDataFrame([(1, "x")], "n int, audio string"), "n").collect()


def test_archives_are_pinned_and_complete(spark, tmp_path):
    path = tmp_path / "a.tar"
    with tarfile.open(path, "w") as tar:
        for name in ("x/one.wav", "x/two.wav", "x/notes.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tar.addfile(info, io.BytesIO(b"abc"))
    names = lambda **more: sorted(r.member for r in metadata.archive_members(spark, str(path), ".wav", **more).collect())
    assert names() == ["x/one.wav", "x/two.wav"] and names(wanted=["x/two.wav"], sizes={"a.tar": path.stat().st_size}) == ["x/two.wav"]
    with pytest.raises(ValueError):
        names(sizes={"a.tar": 1})
    with pytest.raises(Exception, match="lacks"):
        names(wanted=["x/three.wav"])


def test_archives_as_a_data_source(spark, tmp_path):
    from sonoplan.sources.archives import TarMembers

    for archive in ("a.tar.gz", "b.tar"):
        with tarfile.open(tmp_path / archive, "w:gz" if archive.endswith("gz") else "w") as tar:
            for name in ("x/one.WAV", "notes.txt"):
                info = tarfile.TarInfo(name)
                info.size = 3
                tar.addfile(info, io.BytesIO(b"abc"))
    spark.dataSource.register(TarMembers)
    read = lambda **more: spark.read.format("tar_members").options(suffix=".wav", **more).load(f"{tmp_path}/a.tar.gz,{tmp_path}/b.tar").collect()
    assert [(r.member, bytes(r.content)) for r in read()] == [("x/one.WAV", b"abc")] * 2
    with pytest.raises(Exception, match="at most 2"):
        read(most_bytes="2")


def test_small_group_splits_and_previews(spark, tmp_path):
    rows = lambda n: spark.createDataFrame([(f"s{k}", "f") for k in range(n)], "speaker_id string, source_file string")
    for n, ratios, want in ((3, (0.05, 0.5, 0.45), (1, 1, 1)), (4, (0.05, 0.5, 0.45), (1, 1, 2)), (2, (0.6, 0.2, 0.2), (2, 0, 0)), (10, (0.6, 0.2, 0.2), (6, 2, 2)), (4, (0.0, 0.5, 0.5), (0, 2, 2))):
        got = {r["new_split"]: r["count"] for r in splits.speaker_disjoint(rows(n), ratios).groupBy("new_split").count().collect()}
        assert tuple(got.get(s, 0) for s in ("train", "dev", "test")) == want, (n, ratios, got)
    cells = spark.createDataFrame([(1, []), (2, ["text"])], "row_no int, cells array<string>")
    metadata.check_preview(["a", "b"], cells.where("row_no = 1"))
    for wrong in ((["a", "a"], cells.where("row_no = 1")), (["a"], cells)):
        with pytest.raises(ValueError):
            metadata.check_preview(*wrong)
    folder = f"file://{tmp_path}/sink"
    first = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, sha string")
    for _ in range(2):
        streams.append_new(first, folder, "id", "sha")
    assert spark.read.parquet(f"{folder}/data").count() == 2
    with pytest.raises(ValueError):
        streams.append_new(spark.createDataFrame([("a", "9")], "id string, sha string"), folder, "id", "sha")


def test_command_line(spark, tmp_path, capsys):
    from sonoplan.__main__ import main

    rows = [{"row_id": f"{s}{k}", "language": "en", "split": s, "label": k, "speaker_id": f"{s}{k}", "audio_sha256": f"{n:064x}"} for n, (s, k) in enumerate((s, k) for s in ("train", "validation", "evaluation") for k in ("spoof", "bonafide"))]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    assert main(["audit", str(tmp_path / "a.jsonl")], spark) == 0 and '"metadata_checks_passed"' in capsys.readouterr().out
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(r) for r in rows[1:]))
    assert main(["audit", str(tmp_path / "b.jsonl")], spark) == 1
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert main(["probe", f"one={tmp_path}/t"], spark) == 0 and main(["probe", f"one={tmp_path}/t", f"two={tmp_path}/none"], spark) == 2


def test_bounded_and_sniffed_readers(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "t"))
    assert metadata.read_required(spark, str(tmp_path / "t"), ["id"], 5).count() == 5
    with pytest.raises(ValueError):
        metadata.read_required(spark, str(tmp_path / "t"), ["id"], 4)
    (tmp_path / "m.csv").write_text("path|original_file|language\na.wav|o|en\nb.wav|o|en\n")
    files = spark.createDataFrame([("a.wav",), ("b.wav",)], "path string")
    assert metadata.read_sniffed(spark, str(tmp_path / "m.csv"), languages=["en"], inventory=files).count() == 2
    for more in ({"languages": ["hi"]}, {"inventory": files.where("path = 'a.wav'")}):
        with pytest.raises(ValueError):
            metadata.read_sniffed(spark, str(tmp_path / "m.csv"), **more)


def test_voice_conversion_needs_its_source(spark):
    from sonoplan.functions import fields

    rows = spark.createDataFrame([("7", "8", "FreeVC24"), ("7", "nan", "freevc"), (None, "8", "x"), ("7", None, "tts"), ("7", None, " ")], "t string, s string, g string")
    why = checks.first_reason(fields.speaker_reason(True, F.lit(None), F.col("t"), F.col("s"), F.col("g")))
    assert [r[0] for r in rows.select(why).collect()] == [None, "missing_source_speaker", "missing_target_speaker", None, "missing_generator"]
    assert rows.limit(1).select(checks.first_reason(fields.speaker_reason(False, F.col("s"), F.lit(None), F.lit(None), F.lit(None)))).first()[0] is None


def test_adapters_take_namespaces_and_languages(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('[{"sample_id": "a", "speaker_id": 7}, {"sample_id": "b", "language": "ta"}]')
    got = {r.sample_id: r for r in metadata.adapt(metadata.read_rows(spark, str(path)), "indicvoices", language="Hindi", namespace="shared").collect()}
    assert (got["a"].language, got["a"].speaker_id, got["b"].language, got["a"].role) == ("hi", "shared::7", "ta", "train_dev")
    path.write_text('[{"sample_id": "a", "speaker_id": {"name": 7}}]')
    with pytest.raises(Exception, match="no scalar"):
        metadata.adapt(metadata.read_rows(spark, str(path)), "indicvoices").collect()
    assert metadata.ADAPTERS["asvspoof"][3] == "external_benchmark"


def test_files_to_manifest(spark, tmp_path):
    at = np.arange(16000 * 5) / 16000
    tone = 0.3 * np.sin(2 * np.pi * 220 * at)
    half = np.concatenate([tone[:32000], np.zeros(48000)])
    files = spark.createDataFrame([("d/tone.wav", audio.encode_wav(tone, 16000)), ("d/half.wav", audio.encode_wav(half, 16000)), ("d/none.wav", audio.encode_wav(np.zeros(8000), 16000)), ("d/tiny.wav", audio.encode_wav(tone[:100], 16000)), ("d/x.flac", b"fLaCxxxx")], "path string, content binary").withColumn("language", F.lit("hi"))
    rows, skipped = audio.processed(files, "local", "train", "bonafide", "out", hop=4 * 16000)
    got = {(r.source_file, r.segment_start, r.segment_end, r.language, r.sample_id) for r in rows.collect()}
    assert got == {("d/tone.wav", 0.0, 4.0, "hi", "local__tone__0.000_4.000"), ("d/tone.wav", 4.0, 8.0, "hi", "local__tone__4.000_8.000"), ("d/half.wav", 0.0, 4.0, "hi", "local__half__0.000_4.000")}
    assert {r.path: r.reason for r in skipped.collect()} == {"d/none.wav": "not_completely_silent", "d/tiny.wav": "min_duration", "d/x.flac": "audio error: no decoder for flac"}
    sinks.append_manifest(rows, str(tmp_path / "manifest"))
    with pytest.raises(ValueError):
        sinks.append_manifest(rows, str(tmp_path / "manifest"))
    with pytest.raises(ValueError):
        audio.processed(files, "asvspoof", "train", "spoof", "out")


def test_log_mel_against_a_written_out_transform():
    """The same features by a direct Fourier sum, one frame and one filter at a time."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=900)
    padded = np.concatenate([x[256:0:-1], x, x[-2:-258:-1]])
    window = np.zeros(512)
    window[56:456] = [0.5 - 0.5 * np.cos(2 * np.pi * k / 400) for k in range(400)]
    bank = np.zeros((64, 257))
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = [700 * (10 ** (m / 2595) - 1) for m in np.linspace(mel(20.0), mel(7600.0), 66)]
    for m in range(64):
        for k in range(257):
            f = 8000 * k / 256
            bank[m, k] = max(0.0, min((f - points[m]) / (points[m + 1] - points[m]), (points[m + 2] - f) / (points[m + 2] - points[m + 1])))
    frames = []
    for start in range(0, len(padded) - 511, 160):
        part = padded[start : start + 512] * window
        power = np.array([abs(sum(part * np.exp(-2j * np.pi * k * np.arange(512) / 512))) ** 2 for k in range(257)])
        frames.append(np.log(np.maximum(bank @ power, 1e-8)))
    want = np.array(frames).T
    want = (want - want.mean()) / max(want.std(ddof=1), 1e-5)
    got = audio.log_mel(x)
    assert got.shape == want.shape == (64, 6) and np.abs(got - want).max() < 1e-4
