"""Waveforms as arrays: expressions that stay in the engine. An array of samples is ARRAY<FLOAT> or ARRAY<DOUBLE>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def _n(w: Column) -> Column:
    return F.size(w)


def mono(channels: Column) -> Column:
    """Mean over channels at each sample; an array of equally long channels."""
    first = F.sequence(F.lit(1), F.size(channels[0]))
    return F.transform(first, lambda i: F.aggregate(channels, F.lit(0.0).cast("double"), lambda a, ch: a + F.element_at(ch, i)) / F.size(channels))


def padded(w: Column, length: int, at_end: bool = True) -> Column:
    """Exactly `length` samples: cut, or filled with zeros at the end or at the start."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - _n(w), F.lit(0)))
    return F.slice(F.concat(w, zeros), 1, length) if at_end else F.when(_n(w) >= length, F.slice(w, 1, length)).otherwise(F.concat(zeros, w))


def starts(n: Column, window: int, hop: int, keep_rest: bool) -> Column:
    """First samples of the windows. With keep_rest a last, padded window begins at the next hop whenever that lies before the end, and a clip shorter than a window, an empty one too, gives one padded window; without it only full windows count."""
    full = F.floor((n - window) / hop).cast("int") + 1
    count = F.when(n >= window, full + F.when(F.lit(keep_rest) & (full * hop < n), 1).otherwise(0)).otherwise(1 if keep_rest else 0)
    return F.when(n.isNotNull() & (count > 0), F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: (i * hop).cast("int"))).otherwise(F.array().cast("array<int>"))


def segments(w: Column, rate: int, window: int, hop: int, keep_rest: bool = True, at_end: bool = True) -> Column:
    """array of struct(start_seconds, end_seconds, padded, samples). A padded window, with zeros at its end or its start, counts with its whole length."""
    return F.transform(
        starts(_n(w), window, hop, keep_rest),
        lambda s: F.struct(
            (s / rate).alias("start_seconds"), ((s + window) / rate).alias("end_seconds"), (s + window > _n(w)).alias("padded"), padded(F.slice(w, s + 1, F.lit(window)), window, at_end).alias("samples"),
        ),
    )


def centre(w: Column, length: int) -> Column:
    """The middle `length` samples; a shorter clip is padded at its end."""
    skip = F.greatest(F.lit(0), F.floor((_n(w) - length) / 2)).cast("int")
    return F.slice(F.concat(w, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - _n(w), F.lit(0)))), skip + 1, F.lit(length))


def hashed_crop(w: Column, length: int, key: Column) -> Column:
    """`length` samples from a place that the key's digest decides."""
    room = F.greatest(_n(w) - length + 1, F.lit(1))
    place = (F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % room).cast("int")
    return F.slice(F.concat(w, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(length) - _n(w), F.lit(0)))), place + 1, F.lit(length))


def consecutive(w: Column, window: int, most: int | None = None) -> Column:
    """Windows one after another without overlap, the last padded; a clip longer than `most` samples is cut there."""
    clip = w if most is None else F.slice(w, 1, most)
    n = F.size(clip)
    count = F.ceil(n / window).cast("int")
    long = F.concat(clip, F.array_repeat(F.lit(0.0).cast("float"), window))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(long, i * window + 1, F.lit(window)))).otherwise(F.array().cast("array<array<float>>"))


def rms(w: Column) -> Column:
    """Root mean square in double; 0 for an empty clip."""
    total = F.aggregate(w, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.when(_n(w) > 0, F.sqrt(total / _n(w))).otherwise(0.0)


def finite(w: Column) -> Column:
    return F.forall(w, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def loud_share(w: Column, frame: int | Column, threshold: float) -> Column:
    """Share of frames, the last perhaps shorter, with an RMS above the threshold; 0 for an empty clip. A frame with a NaN isn't loud."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    count = F.ceil(_n(w) / frame).cast("int")
    frames = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.slice(w, i * frame + 1, frame))
    loud = F.filter(F.transform(frames, rms), lambda r: ~F.isnan(r) & (r > threshold))
    return F.when(_n(w) > 0, F.size(loud) / count).otherwise(0.0)


def report(w: Column, rate: Column, channels: Column, minimum: float = 0.05, silence: float = 1e-4, frame_seconds: float = 0.02, least_loud: float = 0.01) -> Column:
    """Eight named checks in order, each with passed and value. Silence is an RMS below `silence`, of the whole clip or of all but `least_loud` of its frames. A null clip fails all that need samples."""
    readable = w.isNotNull()
    n = F.coalesce(_n(w), F.lit(0))
    seconds = F.when(rate > 0, n / rate).otherwise(0.0)
    frame = F.greatest(F.lit(1), F.bround(F.greatest(rate, F.lit(1)) * F.lit(frame_seconds), 0)).cast("int")
    level, share = rms(w), loud_share(w, frame, silence)
    one = lambda name, passed, value: F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), value.cast("double").alias("value"))
    return F.array(
        one("readable_array", readable, n), one("sample_rate", rate > 0, rate), one("empty_waveform", n > 0, n), one("finite_samples", readable & finite(w), n), one("min_duration", seconds >= minimum, seconds),
        one("channels", channels >= 1, channels), one("not_completely_silent", readable & ~F.isnan(level) & (level >= silence), level), one("not_almost_silent", readable & (share >= least_loud), share),
    )


def first_failure(checks: Column) -> Column:
    """The name of the first check of report() that wasn't passed, null if all were."""
    return F.get(F.filter(checks, lambda c: ~c["passed"]), F.lit(0))["name"]


def clipped(w: Column) -> Column:
    return F.transform(w, lambda x: F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), x)))


def pcm16(w: Column) -> Column:
    """16-bit values of the clipped samples, never scaled to the peak."""
    return F.transform(clipped(w), lambda x: F.floor(x.cast("double") * 32767 + 0.5).cast("int"))


def mono_of_layout(w: Column) -> Column:
    """One channel of a two-dimensional clip in either layout: the shorter side is taken for the channels, samples first if both are equal."""
    rows, columns = F.size(w), F.size(w[0])
    by_sample = F.transform(w, lambda s: F.aggregate(s, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")) / F.size(s))
    by_channel = mono(F.transform(w, lambda ch: F.transform(ch, lambda x: x.cast("double"))))
    return F.when(rows >= columns, by_sample).otherwise(by_channel)
