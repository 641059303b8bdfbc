"""Defined results for nulls, blanks, ties, repeats, empty tables and clashing names; brute force where SQL has no word for it."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoplan.functions import fields, text
from sonoplan.operators import audio, metrics, quality, sampling, skew, splits, waveform
from sonoplan.operators.graph import connected_components
from sonoplan.plans import catalogue


def one(spark, column, **values):
    kinds = ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first()["x"]


# text ------------------------------------------------------------------------------------------------------------------


def test_missing_words(spark):
    rows = [None, "", "  ", "NaN", "\tnull ", "None", " x ", "nan1", " "]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r[0] for r in df.select(text.is_missing(F.col("v"))).collect()] == [True, True, True, True, True, True, False, False, True]


def test_speaker_and_file_spellings(spark):
    same = ["indicvoices::56", "Indicvoices:: 56", "INDICVOICES::56", "indicvoices:speaker:56", " indicvoices::56", "indicvoices::56.0", "indicvoices::056"]
    df = spark.createDataFrame([(r,) for r in same], "v string")
    assert {r[0] for r in df.select(text.speaker_key(F.col("v"))).collect()} == {"indicvoices::56"}
    files = ["real/Hindi/1.wav", "./real/Hindi/1.wav", "real//Hindi/1.wav", "real\\Hindi\\1.wav", "REAL/HINDI/1.WAV", " real/Hindi/1.wav"]
    df = spark.createDataFrame([(r,) for r in files], "v string")
    assert {r[0] for r in df.select(text.file_key(F.col("v"))).collect()} == {"real/hindi/1.wav"}


def test_digest_spellings(spark):
    d = "4fd8c88a8bd8b0e8a3a994659247cf1c96397a8f5d9f05a40953f310f464ea2b"
    rows = [d, d.upper(), "sha256:" + d, " " + d, "0" * 64, "f" * 64, "pending", "-", None, "", "n/a"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r[0] for r in df.select(text.digest_key(F.col("v"))).collect()] == [d] * 4 + [None] * 7


def test_scalars(spark):
    assert one(spark, fields.scalar(F.col("v")), v="456.0") == "456"
    assert one(spark, fields.scalar(F.col("v")), v=" <NA> ") is None
    assert one(spark, fields.language(F.col("v")), v="hi_IN") == "hi"
    assert one(spark, fields.language(F.col("v")), v="Klingon") == "klingon"
    assert one(spark, fields.window_id(F.col("p"), F.col("a"), F.col("b")), p="x\\y z.wav", a=1.0, b=2.5) == "y_z__1.000_2.500"
    assert one(spark, fields.original_key(F.col("v"), ("en_US", "en_UK")), v="a\\en_US\\b.flac") == "en_US/b.wav"
    assert one(spark, fields.original_key(F.col("v"), ("en_US",)), v="en_US/../en_US/b") is None
    with pytest.raises(Exception, match="no measurement"):
        one(spark, fields.number(F.col("v")), v="-1")


# skew ------------------------------------------------------------------------------------------------------------------


def test_frequent_values_against_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 50 + [None] * 20 + ["nan"] * 5 + [f"k{i}" for i in range(100)]), rng.choice(["a", "a ", "b", ""])) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, s string")
    got = {(r.field_name, r.key_value, r.n_rows) for r in skew.frequent_values(df, ["g", "s"], 0.02).collect()}
    want = {(c, k, n) for c, i in (("g", 0), ("s", 1)) for k, n in Counter(r[i] for r in rows).items() if n >= 0.02 * len(rows) and k is not None and k.strip().lower() not in ("", "nan")}
    assert got == want


def test_aggregate_by_key_against_counts(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", None, None] + [f"k{i}" for i in range(30)]), rng.randrange(40), rng.randrange(5)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "key string, unit int, n int").withColumn("__salt", F.lit("clash"))
    got = {(r.key, r.total, r.units) for r in skew.aggregate_by_key(df, "key", {"total": F.col("n")}, ("units", F.col("unit"))).collect()}
    total, units = Counter(), defaultdict(set)
    for k, u, n in rows:
        total[k] += n
        units[k].add(u)
    assert got == {(k, n, len(units[k])) for k, n in total.items()}


def test_skew_on_empty_table(spark):
    empty = spark.createDataFrame([], "key string, n int")
    assert skew.aggregate_by_key(empty, "key", {"total": F.col("n")}).count() == 0
    assert skew.frequent_values(empty, ["key"], 0.02).count() == 0


# quality ---------------------------------------------------------------------------------------------------------------


def ks(a, b):
    points = sorted(set(a) | set(b))
    share = lambda xs, v: sum(x <= v for x in xs) / len(xs)
    return max(abs(share(a, v) - share(b, v)) for v in points)


def test_profile_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(load, rng.choice([None, float("nan"), *(round(rng.gauss(10 + load, 3), 1) for _ in range(9))])) for load in range(1, 6) for _ in range(rng.randrange(30, 200))]
    rows += [(None, 5.0), (9, None)]
    df = spark.createDataFrame(rows, "load_id int, v double").withColumn("column_name", F.lit("clash")).withColumn("n", F.lit(7))
    got = {r.load_id: r for r in quality.profile(df, "load_id", [quality.Checked("v", between=(0.1, 60.0))]).collect()}
    good = defaultdict(list)
    for load, v in rows:
        if v is not None and 0.1 <= v <= 60:
            good[load].append(v)
    everything = [v for vs in good.values() for v in vs]
    order = sorted(good, key=lambda x: (x is not None, x))
    for k, load in enumerate(order):
        r = got[load]
        assert r.n_ok == len(good[load]) and math.isclose(r.median, median(good[load]), abs_tol=1e-9)
        assert math.isclose(r.ks_all, ks(good[load], everything), abs_tol=1e-9)
        if k:
            assert math.isclose(r.ks_previous, ks(good[load], good[order[k - 1]]), abs_tol=1e-9)
    assert got[9].n_missing == 1 and got[9].median is None and got[9].ks_all is None


def test_findings_of_planted_loads(spark):
    rng = random.Random(4)
    rows = []
    for load in range(1, 10):
        for k in range(200):
            codec, duration = rng.choice(["flac", "mp3", "opus"]), rng.uniform(2, 8)
            if load == 2 and k < 60:
                codec = rng.choice([None, "nan", " "])
            if load == 3 and k < 60:
                codec = "FLAC"
            if load == 4:
                duration *= 3
            if load == 5 and k < 60:
                duration = -duration
            if load == 6:
                codec = "opus"
            rows.append((load, codec, duration))
    df = spark.createDataFrame(rows, "load_id int, codec string, duration double")
    columns = [quality.Checked("duration", between=(0.1, 60.0)), quality.Checked("codec", pattern="^[a-z0-9_]+$")]
    got = {tuple(r) for r in quality.findings(df, "load_id", columns, {"duration", "codec"}, {"duration", "codec"}).collect()}
    assert got == {(2, "codec", "missing"), (3, "codec", "format"), (4, "duration", "shift"), (5, "duration", "range"), (6, "codec", "constant"), (6, "codec", "shift")}
    assert quality.findings(df.limit(0), "load_id", columns, {"codec"}, {"codec"}).count() == 0


# graph, splits -----------------------------------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(40)] + [("hub", f"h{i}") for i in range(50)] + [(f"c{i}", f"c{i + 1}") for i in range(40)] + [(None, "x"), ("y", None), ("z", "z")]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    want = {(x, find(x)) for x in root}
    got = {tuple(r) for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_generator_split_refuses_doubles():
    with pytest.raises(ValueError):
        splits.generator_split({"train": ["a"], "dev": ["a"]}, F.col("split"))


def test_component_split_keeps_components(spark):
    df = spark.createDataFrame([("a", "x", None), ("b", "x", "t"), ("c", None, "t"), ("d", None, None)], "node string, w string, t string")
    got = {r.node: (r.root, r.new_split) for r in splits.component_split(df, "node", ["w", "t"], "42").collect()}
    assert got["a"] == got["b"] == got["c"] and got["a"][0] == "a" and got["d"][0] == "d"


# metrics -----------------------------------------------------------------------------------------------------------------


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


def test_known_metrics(spark):
    df = scored(spark, [(0, 0.1), (0, 0.6), (1, 0.4), (1, 0.9)])
    assert tuple(metrics.confusion(df).first()) == (1, 1, 1, 1)
    assert metrics.roc_auc(metrics.score_table(df)).first()[0] == 0.75
    assert metrics.derived(metrics.confusion(df)).first().f1 == 0.5
    assert metrics.roc_auc(metrics.score_table(scored(spark, [(0, 0.5), (1, 0.5)]))).first()[0] == 0.5
    r = metrics.derived(spark.createDataFrame([(90, 10, 20, 80)], "tn bigint, fp bigint, fn bigint, tp bigint")).first()
    assert (r.accuracy, r.recall, r.specificity) == (0.85, 0.8, 0.9)
    r = metrics.derived(spark.createDataFrame([(10, 0, 10, 0)], "tn bigint, fp bigint, fn bigint, tp bigint")).first()
    assert r.precision is None and r.recall == 0
    assert metrics.zero_defaults(spark.createDataFrame([(10, 0, 10, 0)], "tn bigint, fp bigint, fn bigint, tp bigint")).first().precision == 0


def test_published_rates(spark):
    r = metrics.derived(spark.createDataFrame([(7141, 214, 8497, 55385)], "tn bigint, fp bigint, fn bigint, tp bigint")).first()
    want = {"accuracy": 0.8777180397826972, "precision": 0.9961510099102502, "recall": 0.8669891362199055, "f1": 0.9270930106041965, "specificity": 0.9709041468388852, "fpr": 0.029095853161114887, "fnr": 0.13301086378009455, "npv": 0.4566440721319862, "balanced_accuracy": 0.9189466415293953, "mcc": 0.615949639049528, "macro_f1": 0.7741192883230177, "weighted_f1": 0.8955048828790517, "prevalence": 0.8967530917921867}
    for name, value in want.items():
        assert math.isclose(r[name], value, rel_tol=1e-9), name


def test_metrics_on_empty_table(spark):
    empty = scored(spark, [])
    assert metrics.roc_auc(metrics.score_table(empty)).first()[0] is None
    assert metrics.reliability(empty).count() == 0


# waveforms ---------------------------------------------------------------------------------------------------------------


def starts_by_loop(n, window, hop, keep):
    if n < window:
        return [0] if keep else []
    out, at = [], 0
    while at + window <= n:
        out.append(at)
        at += hop
    if keep and at < n:
        out.append(at)
    return out


def test_window_starts(spark):
    cases = [(w, h, k) for w in (1, 4, 6) for h in (1, 2, 4, 6) for k in (True, False)]
    frame = spark.createDataFrame([(n,) for n in (0, 1, 3, 4, 7, 10, 16)], "n int")
    for w, h, k in cases:
        for r in frame.select("n", waveform.starts(F.col("n"), w, h, k).alias("s")).collect():
            assert r.s == starts_by_loop(r.n, w, h, k), (r.n, w, h, k)


def test_ten_seconds(spark):
    clip = spark.createDataFrame([([0.5] * 160,)], "w array<float>")
    for keep, want in ((True, [0, 2, 4, 6, 8]), (False, [0, 2, 4, 6])):
        got = clip.select(waveform.segments(F.col("w"), 16, 64, 32, keep).alias("s")).first().s
        assert [int(x.start_seconds) for x in got] == want and all(len(x.samples) == 64 for x in got)


def test_segments_and_the_table_function_agree(spark):
    spark.udtf.register("segment_waveform", audio.SegmentWaveform)
    clips = spark.createDataFrame([(n, [float(k + 1) for k in range(n)]) for n in (0, 1, 5, 8, 9, 10, 17)], "id int, w array<float>")
    clips.createOrReplaceTempView("udtf_clips")
    for hop in (1, 3, 8, 11):
        own = clips.select("id", F.explode(waveform.segments(F.col("w"), 16, 8, hop)).alias("s")).select("id", (F.col("s.start_seconds") * 16).cast("int").alias("a"), "s.padded", "s.samples", (F.col("s.end_seconds") * 16).cast("int").alias("e"))
        got = spark.sql(f"SELECT id, start_sample, padded, samples FROM udtf_clips, LATERAL segment_waveform(w, 8, {hop})")
        assert sorted((r.id, r.a, r.padded, r.samples) for r in own.collect()) == sorted(map(tuple, got.collect()))
        assert all(r.e == r.a + 8 for r in own.collect())
    first = clips.where("id = 5").select(waveform.segments(F.col("w"), 16, 8, 4, at_end=False).alias("s")).first().s
    assert [x.samples for x in first] == [[0.0, 0.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]]


def test_checks_of_bad_clips(spark):
    clips = spark.createDataFrame([(1, [0.5, -0.5] * 16), (2, [0.0] * 32), (3, []), (4, None), (5, [float("nan")] * 32)], "id int, w array<float>")
    got = {r.id: {c.name: c.passed for c in r.c} for r in clips.select("id", waveform.report(F.col("w"), F.lit(16), F.lit(1)).alias("c")).collect()}
    assert all(got[1].values())
    assert not got[2]["not_completely_silent"] and not got[3]["empty_waveform"] and not got[4]["readable_array"] and not got[5]["finite_samples"]
    assert {r.id: r.reason for r in audio.quarantine(clips, F.col("w"), 16, 16, 8).collect()} == {1: None, 2: "not_completely_silent", 3: "empty_waveform", 4: "readable_array", 5: "finite_samples"}


def test_wav_of_24_bits_and_other_containers():
    import io
    import wave

    values = [0, 1, -1, 8388607, -8388608]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(3), w.setframerate(8000)
        w.writeframes(b"".join(v.to_bytes(3, "little", signed=True) for v in values))
    got, rate = audio.decode_wav(out.getvalue())
    assert rate == 8000 and np.allclose(got[:, 0] * 8388608, values)
    assert audio.decode_wav(b"fLaC1234") == "no decoder for flac" and audio.decode_wav(b"OggS1234") == "no decoder for ogg"


def test_wav_round_trip_and_resampling():
    at = np.arange(16000) / 16000
    tone = (0.4 * np.sin(2 * np.pi * 220 * at)).astype(np.float32)
    back, rate = audio.decode_wav(audio.encode_wav(tone, 16000))
    assert rate == 16000 and np.abs(back[:, 0] - tone).max() < 1e-4
    up = audio.resample(tone, 16000, 48000)
    assert len(up) == 48000 and np.abs(up[3000:-3000] - 0.4 * np.sin(2 * np.pi * 220 * np.arange(48000) / 48000)[3000:-3000]).max() < 2e-3
    assert audio.resample(tone, 16000, 16000) is tone
    assert isinstance(audio.decode_wav(b"junk"), str) and isinstance(audio.decode_wav(None), str)
    with pytest.raises(ValueError):
        audio.encode_wav(np.array([np.nan]), 16000)
    assert audio.log_mel(np.tile(tone, 4)).shape == (64, 401)


def test_two_key_walk(spark):
    rng = random.Random(13)
    rows = [(f"r{k:03d}", rng.randrange(3), rng.choice([None, *range(40)]), rng.choice([None, *range(60)])) for k in range(150)]
    df = spark.createDataFrame(rows, "id string, p int, a int, w int")
    kept, seen_a, seen_w = set(), set(), set()
    for i, p, a, w in sorted(rows, key=lambda r: (r[1], r[0])):
        if (a is None or a not in seen_a) and (w is None or w not in seen_w):
            kept.add(i)
            seen_a.add(a)
            seen_w.add(w)
    assert {r.id for r in splits.first_wins_all(df, "id", ["a", "w"], F.col("p")).collect()} == kept
    assert splits.first_wins_all(df.limit(0), "id", ["a", "w"], F.col("p")).count() == 0


def test_layouts_and_records(spark):
    tall, wide = [[1.0, 3.0], [2.0, 4.0], [5.0, 7.0]], [[1.0, 2.0, 5.0], [3.0, 4.0, 7.0]]
    df = spark.createDataFrame([(1, tall), (2, wide)], "id int, w array<array<double>>")
    assert all(r.m == [2.0, 3.0, 6.0] for r in df.select(waveform.mono_of_layout(F.col("w")).alias("m")).collect())
    row = spark.createDataFrame([("a", float("nan"), 1 / 3, None)], "s string, x double, y double, z string")
    assert row.select(fields.record_json(row.dtypes)).first()[0] == '{"s":"a","x":null,"y":0.333333333333,"z":null}'
    files = spark.createDataFrame([(f"f{k}", "hi" if k % 2 else "pa", 10) for k in range(20)], "path string, language string, size bigint")
    assert sampling.shard_plan(files, ["language"], "path", "size", 4, 100, "1").count() == 8
    with pytest.raises(ValueError):
        sampling.shard_plan(files, ["language"], "path", "size", 4, 50, "1")


def test_holdout_first_by_digest(spark, tmp_path):
    d = ["4fd8c88a8bd8b0e8a3a994659247cf1c96397a8f5d9f05a40953f310f464ea2b", "4FD8C88A8BD8B0E8A3A994659247CF1C96397A8F5D9F05A40953F310F464EA2B"]
    rows = [("a", "train", "x", d[0]), ("b", "test", "x", d[1]), ("c", "train", "x", "n/a"), ("d", "dev", "x", "n/a"), ("e", "dev", "x", "0" * 64), ("f", "train", "x", "0" * 64)]
    spark.createDataFrame(rows, "id string, split string, source string, window_sha256 string").write.parquet(str(tmp_path / "baseline_rows.parquet"))
    got = catalogue.q37_holdout_first_digests(spark, str(tmp_path)).collect()
    assert {(r.split, r.n) for r in got} == {("test", 1), ("train", 2), ("dev", 2)}


def test_text_keys_against_the_rule(spark, tmp_path):
    def rule(t):
        flat = " ".join((t or "").casefold().split())
        return hashlib.sha256(flat.encode()).hexdigest() if flat else None

    texts = [None, "", " \u00a0\n", "Straße", "STRASSE", " strasse\t", "a\u00a0\u2003 b", "A B", "ΟΔΟΣ", "οδος", "ﬁne", "FINE", "ŉ İ ẞ", "a\u200bb", "ſ"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for folder in (str(tmp_path), "/root/testdata/sf0.1"):
        text = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
        got = catalogue.q16_text_keys(spark, folder).collect()
        assert [(text[r.doc_id], r.text_key) for r in got if r.text_key != rule(text[r.doc_id])] == []
