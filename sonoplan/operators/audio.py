"""Decoding, resampling and log-mel features: signal processing that has no expression in the engine, as Arrow-batched maps."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoplan.functions.fields import MANIFEST, verdict, window_id
from sonoplan.operators import waveform
from sonoplan.session import durable

RATE, N_FFT, WINDOW, HOP, MELS, LOW, HIGH = 16000, 512, 400, 160, 64, 20.0, 7600.0
#: First bytes of containers that need a decoder of their own.
CONTAINERS = {b"fLaC": "flac", b"OggS": "ogg", b"caff": "caf", b"FORM": "aiff"}


def decode_wav(data: bytes | None) -> tuple[np.ndarray, int] | str:
    """Samples (frames, channels) in -1..1 and rate of a WAV of 8, 16, 24 or 32 bits, or what is wrong. Other containers are named, not decoded."""
    if not data:
        return "empty file"
    if data[:4] in CONTAINERS or data[:3] == b"ID3":
        return f"no decoder for {CONTAINERS.get(data[:4], 'mp3')}"
    try:
        with wave.open(io.BytesIO(data)) as f:
            width, channels, rate, frames = f.getsampwidth(), f.getnchannels(), f.getframerate(), f.readframes(f.getnframes())
    except (wave.Error, EOFError, ValueError) as e:
        return f"not decodable: {e}"
    if rate <= 0:
        return "bad sample rate"
    if width == 2:
        x = np.frombuffer(frames, "<i2").astype(np.float32) / 32768
    elif width == 4:
        x = np.frombuffer(frames, "<i4").astype(np.float32) / 2147483648
    elif width == 3:
        parts = np.frombuffer(frames, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((parts[:, 0] | parts[:, 1] << 8 | parts[:, 2] << 16) ^ 0x800000) - 0x800000).astype(np.float32) / 8388608
    elif width == 1:
        x = (np.frombuffer(frames, np.uint8).astype(np.float32) - 128) / 128
    else:
        return f"{8 * width}-bit samples"
    return x.reshape(-1, channels), rate


def encode_wav(samples: np.ndarray, rate: int) -> bytes:
    """16-bit WAV of clipped samples; samples that aren't finite are an error."""
    if not np.isfinite(samples).all():
        raise ValueError("samples are not finite")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1 if samples.ndim == 1 else samples.shape[1])
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.floor(np.clip(np.asarray(samples, np.float64), -1, 1) * 32767 + 0.5).astype("<i2").tobytes())
    return out.getvalue()


@lru_cache(maxsize=32)
def _kernel(old: int, new: int, zeros: int = 6, rolloff: float = 0.99) -> tuple[np.ndarray, int, int, int]:
    g = int(np.gcd(old, new))
    old, new = old // g, new // g
    base = min(old, new) * rolloff
    width = int(np.ceil(zeros * old / base))
    at = np.arange(-width, width + old)[None, :] / old
    t = np.clip((np.arange(0, -new, -1)[:, None] / new + at) * base, -zeros, zeros)
    window = np.cos(t * np.pi / zeros / 2) ** 2
    return np.sinc(t) * window * base / old, width, old, new


def resample(x: np.ndarray, old: int, new: int) -> np.ndarray:
    """Windowed-sinc resampling; equal rates give the samples back."""
    if old == new or not len(x):
        return x
    kernel, width, a, b = _kernel(old, new)
    padded = np.concatenate([np.zeros(width), x, np.zeros(width + a)])
    views = np.lib.stride_tricks.sliding_window_view(padded, kernel.shape[1])[::a]
    return (views @ kernel.T).reshape(-1)[: int(np.ceil(new * len(x) / old))].astype(np.float32)


@lru_cache(maxsize=4)
def _mel_bank(rate: int = RATE) -> np.ndarray:
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    points = 700 * (10 ** (np.linspace(mel(LOW), mel(HIGH), MELS + 2) / 2595) - 1)
    bins = np.linspace(0, rate // 2, N_FFT // 2 + 1)
    slope = points[:, None] - bins[None, :]
    rise, fall = -slope[:-2] / np.diff(points)[:-1, None], slope[2:] / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(rise, fall))


def log_mel(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Standardised log-mel spectrogram, mels by frames; centred frames, reflected at the ends."""
    x = np.asarray(x, np.float64)
    if len(x) <= N_FFT // 2:
        x = np.pad(x, (0, N_FFT // 2 + 1 - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(np.pad(x, N_FFT // 2, mode="reflect"), N_FFT)[::HOP]
    window = np.zeros(N_FFT)
    window[(N_FFT - WINDOW) // 2 : (N_FFT + WINDOW) // 2] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(WINDOW) / WINDOW)
    power = np.abs(np.fft.rfft(frames * window, axis=1)) ** 2
    mel = np.log(np.maximum(_mel_bank(rate) @ power.T, 1e-8))
    return ((mel - mel.mean()) / max(mel.std(ddof=1), 1e-5)).astype(np.float32)


def log_mels(df: DataFrame, key: str, samples: str, rate: int = RATE) -> DataFrame:
    """key, n_frames, feature (bytes of float32, mels by frames), sha: null samples give no row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["x"].notna()]
            m = [log_mel(np.asarray(x), rate) for x in b["x"]]
            yield pd.DataFrame({"key": b["key"], "n_frames": [x.shape[1] for x in m], "feature": [x.tobytes() for x in m]})

    made = df.select(F.col(key).alias("key"), F.col(samples).alias("x")).mapInPandas(run, f"key {kind}, n_frames int, feature binary")
    return made.select(F.col("key").alias(key), "n_frames", "feature", F.sha2("feature", 256).alias("sha"))


def decoded(files: DataFrame, to_rate: int | None = RATE) -> DataFrame:
    """path, sample_rate, channels, n_frames, samples (mono at to_rate, or at the file's rate), audio_error: one row per file of a binary scan (path, content); a broken file has an error and no samples."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                got = decode_wav(content)
                if isinstance(got, str):
                    rows.append((path, None, None, None, None, got))
                else:
                    x, rate = got
                    rows.append((path, rate, x.shape[1], len(x), resample(x.mean(1), rate, to_rate or rate).astype(np.float32), None))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "channels", "n_frames", "samples", "audio_error"]).astype({"sample_rate": "Int32", "channels": "Int32", "n_frames": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, channels int, n_frames bigint, samples array<float>, audio_error string")


def inspected(rows: DataFrame, decoded_files: DataFrame, path: str) -> DataFrame:
    """rows with rms, almost_silent and audio_error of their files; rows without a file keep nulls."""
    measured = decoded_files.select(F.col("path").alias("__path"), "audio_error", F.when(F.col("samples").isNotNull(), waveform.rms(F.col("samples"))).alias("rms"))
    return rows.join(measured, F.col(path) == F.col("__path"), "left").drop("__path").withColumn("almost_silent", F.col("rms") < 1e-4)


def quarantine(df: DataFrame, samples: Column, rate: int, window: int, hop: int) -> DataFrame:
    """df with reason: null where the clip passes all checks and gives a window, else the first failed check. Both kinds of record go the same way."""
    short = F.size(waveform.starts(F.coalesce(F.size(samples), F.lit(0)), window, hop, False)) == 0
    return df.withColumn("reason", F.coalesce(waveform.first_failure(waveform.report(samples, F.lit(rate), F.lit(1))), F.when(short, F.lit("too_short_for_a_window"))))


def resampled(df: DataFrame, samples: str, rate: str, to_rate: int) -> DataFrame:
    """df with its samples at to_rate; null samples stay null."""
    at, rates = df.columns.index(samples), df.columns.index(rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b.isetitem(at, pd.Series([None if x is None else resample(np.asarray(x, np.float32), int(r), to_rate) for x, r in zip(b.iloc[:, at], b.iloc[:, rates])], dtype=object, index=b.index))
            yield b

    return df.mapInPandas(run, df.schema)


def processed(files: DataFrame, dataset: str, split: str, label: str, folder: str, rate: int = RATE, window: int = 4 * RATE, hop: int = 2 * RATE, keep_rest: bool = True, external: tuple[str, ...] = ("asvspoof",)) -> tuple[DataFrame, DataFrame]:
    """The whole way of audio files (path, content; further columns are metadata): decoded, checked, made mono, resampled, checked again, cut into windows.

    Gives a manifest row (the canonical columns, and samples) for each window that passes the checks, its file named by its id below folder/split,
    and path, reason of the files that give none: an audio error, a failed check, `post-resample` before one of the second round, or that no window
    came out. Silent windows are left out. Data sets in `external` may only be processed for the split `external`."""
    if dataset in external and split != "external":
        raise ValueError(f"{dataset} is for evaluation only")
    if label not in ("bonafide", "spoof"):
        raise ValueError(f"illegal label {label}")
    given = [c for c in ("speaker_id", "language", "gender", "generator", "attack_type", "codec") if c in files.columns]
    clips = decoded(files.select("path", "content"), None).join(files.select("path", *given), "path")
    first = F.coalesce(F.when(F.col("audio_error").isNotNull(), F.concat(F.lit("audio error: "), "audio_error")), waveform.first_failure(waveform.report(F.col("samples"), F.col("sample_rate"), F.col("channels"))))
    told = resampled(clips.withColumn("reason", first), "samples", "sample_rate", rate)
    again = waveform.first_failure(waveform.report(F.col("samples"), F.lit(rate), F.lit(1)))
    cut = told.withColumn("reason", F.coalesce("reason", F.concat(F.lit("post-resample "), again))).withColumn("s", F.when(F.col("reason").isNull(), waveform.segments(F.col("samples"), rate, window, hop, keep_rest)))
    kept = durable(cut.withColumn("reason", F.coalesce("reason", F.when(F.size("s") == 0, F.lit("no segments")))).drop("samples", "audio_error"))
    parts = kept.where("reason IS NULL").select("path", *given, F.explode("s").alias("s"))
    good = parts.where(waveform.first_failure(waveform.report(F.col("s.samples"), F.lit(rate), F.lit(1))).isNull())
    made = F.concat(F.lit(f"{dataset}__"), window_id(F.col("path"), F.col("s.start_seconds"), F.col("s.end_seconds")))
    own = {
        "sample_id": made, "source_file": F.col("path"), "processed_file": F.concat(F.lit(f"{folder}/{split}/"), made, F.lit(".wav")), "dataset": F.lit(dataset), "label": F.lit(label), "duration": F.lit(window / rate),
        "sample_rate": F.lit(rate), "segment_start": F.col("s.start_seconds"), "segment_end": F.col("s.end_seconds"), "split": F.lit(split),
    }
    manifest = good.select(*(own.get(c, F.col(c) if c in given else F.lit(None).cast("string")).alias(c) for c in MANIFEST), F.col("s.samples").alias("samples"))
    return manifest, kept.where("reason IS NOT NULL").select("path", "reason")


@F.udtf(returnType="start_sample: int, padded: boolean, samples: array<float>")
class SegmentWaveform:
    """SELECT ... FROM t, LATERAL segment_waveform(samples, window, hop): the windows of waveform.segments, the last padded at its end."""

    def eval(self, samples, window: int, hop: int):
        if samples is None:
            return
        x, at = list(samples), 0
        while at + window <= len(x):
            yield at, False, x[at : at + window]
            at += hop
        if at < len(x) or at == 0:
            part = x[at:]
            yield at, True, part + [0.0] * (window - len(part))


WAVE = T.ArrayType(T.FloatType())


def score_clips(df: DataFrame, key: str, samples: str, factory: Callable[[], Callable[[np.ndarray], float]], threshold: float = 0.5) -> DataFrame:
    """key, synthetic_score, verdict of each clip by a detector: factory() is called once a task and gives a function of the samples. A null clip has a null score."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = factory()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "synthetic_score": pd.array([None if x is None else float(detect(np.asarray(x))) for x in b["x"]], "Float64")})

    found = df.select(F.col(key).alias("key"), F.col(samples).alias("x")).mapInPandas(run, f"key {kind}, synthetic_score double")
    return found.select(F.col("key").alias(key), "synthetic_score", verdict(F.col("synthetic_score"), threshold).alias("verdict"))


def transformed(df: DataFrame, key: str, samples: str, change: Callable[[np.ndarray], tuple[np.ndarray, dict[str, str]]]) -> DataFrame:
    """key, feature, properties, error: what a function of the samples gives, an array and texts by name. A record on which it fails has the error, and stops nothing; a null clip is such a record."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, x in zip(b["key"], b["x"]):
                try:
                    feature, told = change(np.asarray(x, np.float32)) if x is not None else ({}["no samples"], {})
                    rows.append((k, np.asarray(feature, np.float32).ravel(), {str(n): str(v) for n, v in told.items()}, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "feature", "properties", "error"])

    return df.select(F.col(key).alias("key"), F.col(samples).alias("x")).mapInPandas(run, f"key {kind}, feature array<float>, properties map<string,string>, error string").withColumnRenamed("key", key)


def centre_features(clips: DataFrame, window: int = 4 * RATE) -> DataFrame:
    """path, n_frames, feature, sha of the middle window of each decoded clip; clips with an error give none."""
    good = clips.where("audio_error IS NULL AND size(samples) > 0")
    return log_mels(good.select("path", waveform.centre(F.col("samples"), window).alias("w")), "path", "w")


def feature_reason(w: Column, length: int, rate: Column, expected_rate: int) -> Column:
    """What is wrong with a stored feature or decoded clip: missing, shape, not_finite, rate, in this order; null where nothing is."""
    return F.when(w.isNull(), "missing").when(F.size(w) != length, "shape").when(~waveform.finite(w), "not_finite").when(rate.isNull() | (rate != expected_rate), "rate")


def window_features(clips: DataFrame, window: int = 4 * RATE, most: int = 120 * RATE) -> DataFrame:
    """path, place, n_frames, feature, sha of each consecutive window of each decoded clip; clips with an error give none."""
    good = clips.where("audio_error IS NULL")
    flat = good.select("path", F.posexplode(waveform.consecutive(F.col("samples"), window, most)).alias("place", "w"))
    named = flat.select(F.concat_ws("#", "path", F.col("place").cast("string")).alias("id"), "w")
    return log_mels(named, "id", "w").select(F.regexp_replace("id", "#[0-9]+$", "").alias("path"), F.regexp_extract("id", "#([0-9]+)$", 1).cast("int").alias("place"), "n_frames", "feature", "sha")
