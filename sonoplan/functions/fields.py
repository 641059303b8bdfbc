"""Column builders for the canonical record: scalars, languages, genders, numbers, identifiers, paths, digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonoplan.functions.text import tidy

#: The canonical columns.
MANIFEST = ("sample_id", "source_file", "processed_file", "dataset", "label", "speaker_id", "language", "gender", "duration", "sample_rate", "segment_start", "segment_end", "generator", "attack_type", "codec", "split")
#: Words that mean no value, in metadata exports and in identities.
NO_SCALAR = ("", "null", "nan", "none", "<na>")
NO_IDENTITY = ("", "nan", "none", "null")
#: Names and codes of a language; the first is the one kept.
LANGUAGES = (
    ("as", "asm", "assamese"), ("bn", "ben", "bengali", "bangla"), ("brx", "bodo"), ("doi", "dogri"), ("gu", "guj", "gujarati"), ("hi", "hin", "hindi"),
    ("kn", "kan", "kannada"), ("ks", "kas", "kashmiri"), ("kok", "gom", "konkani"), ("mai", "maithili"), ("ml", "mal", "malayalam"), ("mr", "mar", "marathi"),
    ("mni", "manipuri", "meitei"), ("ne", "nep", "nepali"), ("or", "ori", "ory", "odia", "oriya"), ("pa", "pan", "punjabi", "panjabi"), ("sa", "san", "sanskrit"),
    ("sat", "santali"), ("sd", "snd", "sindhi"), ("ta", "tam", "tamil"), ("te", "tel", "telugu"), ("ur", "urd", "urdu"), ("en", "eng", "english"),
)


def scalar(c: Column) -> Column:
    """Trimmed text, null for words that mean no value; a whole decimal loses its zeros (456.0 is 456)."""
    text = tidy(c.cast("string"))
    whole = F.when(text.rlike(r"^-?[0-9]+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.when(~F.lower(text).isin(*NO_SCALAR), whole)


def identity(c: Column) -> Column:
    text = tidy(c.cast("string"))
    return F.when(~F.lower(text).isin(*NO_IDENTITY), F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1"))


def language(c: Column) -> Column:
    """The kept code of a known name or code, also before a dash; other tokens stay, in lower case."""
    known = F.create_map(*(F.lit(x) for group in LANGUAGES for alias in group for x in (alias, group[0])))
    token = F.replace(F.lower(scalar(c)), F.lit("_"), F.lit("-"))
    return F.coalesce(F.try_element_at(known, token), F.try_element_at(known, F.split_part(token, F.lit("-"), F.lit(1))), token)


def gender(c: Column) -> Column:
    token = F.lower(scalar(c))
    return F.when(token == "m", "male").when(token == "f", "female").otherwise(token)


def number_state(c: Column, integer: bool = False) -> Column:
    """missing, ok, or why the value is no measurement: text, not_finite, negative, not_positive_integer."""
    text = scalar(c)
    value = text.try_cast("double")
    state = F.when(text.isNull(), "missing").when(value.isNull(), "text").when(F.isnan(value) | (F.abs(value) == float("inf")), "not_finite").when(value < 0, "negative")
    if integer:
        state = state.when((value <= 0) | (value != F.floor(value)), "not_positive_integer")
    return state.otherwise("ok")


def number(c: Column, integer: bool = False) -> Column:
    """The measurement; a value that is none fails the query."""
    value = scalar(c).try_cast("double")
    state = number_state(c, integer)
    return F.when(state == "ok", value).when(state != "missing", F.raise_error(F.concat(F.lit("no measurement: "), c.cast("string"))).cast("double"))


def namespaced(space: Column | str, c: Column) -> Column:
    """space::id, null without an id."""
    return F.concat(F.lit(space) if isinstance(space, str) else space, F.lit("::"), c)


def file_format(stated: Column, path: Column) -> Column:
    """The stated format, else the suffix of the path of a file name or address; lower case without dots, null where there is none."""
    step = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"[?#].*$", ""), r"^.*/", "")
    suffix = F.lower(F.regexp_extract(step, r"[^.]\.([^.]+)$", 1))
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(scalar(stated)), r"^\.+", ""), F.lit("")), F.nullif(suffix, F.lit("")))


def basename(path: Column) -> Column:
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def window_id(path: Column, start: Column, end: Column) -> Column:
    """Stem of the file with the window's seconds; other characters than letters, digits, - and _ become _."""
    stem = F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(stem, r"[^\p{L}\p{N}_-]", "_")
    return F.concat(safe, F.lit("__"), F.format_string("%.3f", start), F.lit("_"), F.format_string("%.3f", end))


def made_id(dataset: Column, *parts: Column) -> Column:
    """dataset__digest of the first known part; fails where none is known."""
    return F.concat(dataset, F.lit("__"), F.substring(F.sha2(F.coalesce(*parts, F.raise_error(F.lit("no identity")).cast("string")), 256), 1, 24))


def bucket(seed: str, c: Column, of: int = 100) -> Column:
    """A number below `of` by the digest of seed and key: the same on every engine."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), c), 256), 1, 8), 16, 10).cast("bigint") % of


def thirds(b: Column, train: int = 60, dev: int = 80) -> Column:
    return F.when(b < train, "train").when(b < dev, "dev").otherwise("test")


#: White space as the reference splits at it.
_SPACES = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Lower-case letters that case folding changes further: to one letter, and to several.
_FOLDED = {c: c.casefold() for c in map(chr, range(0x110000)) if c.lower() == c != c.casefold()}
_LETTERS = {c: x for c, x in _FOLDED.items() if len(x) == 1}
_LONG = {c: x for c, x in _FOLDED.items() if len(x) > 1}


def spaced(c: Column) -> Column:
    """Single spaces for white space of any kind and length, none at the ends."""
    return F.btrim(F.regexp_replace(c, _SPACES, " "))


def row_id(source: Column, revision: Column, path: Column, index: Column) -> Column:
    """Digest of where a row stands: source, revision, path and number."""
    return F.sha2(F.concat_ws(":", source, revision, path, index.cast("string")), 256)


#: The splits' names in a source, and ours.
SOURCE_SPLITS = {"train": "train", "validation": "validation", "evaluation": "test"}


def encoded_label(c: Column) -> Column:
    """1 for spoof, 0 for bonafide; another label fails the query, a null one stays null."""
    return F.when(c == "spoof", 1).when(c == "bonafide", 0).when(c.isNotNull(), F.raise_error(F.concat(F.lit("illegal label: "), c)).cast("int"))


def renamed_split(c: Column) -> Column:
    """Our name of a source's split, null for others."""
    return reduce(lambda out, kv: out.when(c == kv[0], kv[1]), list(SOURCE_SPLITS.items())[1:], F.when(c == next(iter(SOURCE_SPLITS)), next(iter(SOURCE_SPLITS.values()))))


def text_key(c: Column) -> Column:
    """Digest of the case-folded text (sharp s as ss) with single spaces; null for null and blank texts."""
    low = F.translate(F.lower(c), "".join(_LETTERS), "".join(_LETTERS.values()))
    # few texts have such letters
    folded = F.when(low.rlike(f"[{''.join(_LONG)}]"), reduce(lambda t, x: F.replace(t, F.lit(x[0]), F.lit(x[1])), _LONG.items(), low)).otherwise(low)
    flat = spaced(folded)
    return F.when(flat != "", F.sha2(flat, 256))


def original_key(path: Column, roots: tuple[str, ...]) -> Column:
    """The path from its one step named as a root on, with suffix .wav; null where a step is `..` or not exactly one is a root."""
    steps = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    hits = F.filter(steps, lambda s: s.isin(*roots))
    at = reduce(lambda a, b: F.greatest(a, b), [F.array_position(steps, r) for r in roots] + [F.lit(0).cast("bigint")])
    tail = F.array_join(F.slice(steps, at.cast("int"), F.size(steps)), "/")
    return F.when((F.size(hits) == 1) & ~F.array_contains(steps, ".."), F.concat(F.regexp_replace(tail, r"\.[^./]*$", ""), F.lit(".wav")))


def sorted_keys(space: str, *parts: Column) -> Column:
    """Sorted distinct known identities with their namespace."""
    return F.array_sort(F.array_distinct(F.transform(F.array_compact(F.array(*map(identity, parts))), lambda x: F.concat(F.lit(f"{space}:"), x))))


def references(space: str, *paths: Column) -> Column:
    """Sorted distinct names of the files that a record was made from, with their namespace."""
    named = F.transform(F.array_compact(F.array(*map(identity, paths))), lambda p: F.concat(F.lit(f"{space}:reference:"), F.element_at(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), -1)))
    return F.array_sort(F.array_distinct(named))


def speaker_reason(synthetic: bool, speaker: Column, target: Column, source: Column, generator: Column) -> dict[str, Column]:
    """What is missing of a record's speakers, in order: the speaker of a genuine one; of a synthetic one its target, for voice conversion (generators named freevc...) its source, its generator."""
    if not synthetic:
        return {"missing_speaker": identity(speaker).isNull()}
    convert = F.coalesce(F.lower(generator.cast("string")).startswith("freevc"), F.lit(False))
    return {"missing_target_speaker": identity(target).isNull(), "missing_source_speaker": convert & identity(source).isNull(), "missing_generator": identity(generator).isNull()}


def verdict(score: Column, threshold: float = 0.5, margin: float = 0.1) -> Column:
    return F.when(F.abs(score - F.lit(threshold)) < margin, "inconclusive").when(score >= threshold, "synthetic").otherwise("genuine")


def blob_digest(c: Column) -> Column:
    """SHA-1 that a version control system gives a file of these bytes: of `blob`, the length, a zero byte and the bytes."""
    data = c.cast("binary")
    head = F.concat(F.lit("blob "), F.octet_length(c).cast("string")).cast("binary")
    return F.sha1(F.concat(head, F.unhex(F.lit("00")), data))


def contract_reason(split_letter: str) -> dict[str, Column]:
    """What is wrong with a row of the challenge corpus (key, audio_file_name, speaker_id, system_id), in order."""
    name, who, system, key = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("audio_file_name", "speaker_id", "system_id", "key"))
    return {
        "label": ~key.isin("0", "1"), "id": ~name.rlike(f"^LA_{split_letter}_[0-9]{{7}}$"), "speaker": ~who.rlike("^LA_[0-9]{4}$"),
        "attack": F.when(key == "0", system != "-").otherwise(~system.rlike("^A[0-9]{2}$")),
    }


def header_reason(seconds: tuple[float, float], rates: tuple[int, int], channels: tuple[int, int]) -> dict[str, Column]:
    """What puts an audio header (duration, sample_rate, channels) out of bounds, in order; an unknown value is out of bounds."""
    out = lambda c, b: ~F.coalesce(F.col(c).between(*b), F.lit(False))
    return {"sample_rate": out("sample_rate", rates), "channels": out("channels", channels), "duration": out("duration", seconds)}


#: Seconds, rates and channels of the headers that each use takes.
HEADER_BOUNDS = {
    "baseline": ((1.0, 30.0), (8000, 192000), (1, 8)), "english": ((0.0, 120.0), (16000, 16000), (1, 1)), "recording": ((0.0, 120.0), (8000, 96000), (1, 2)), "demo": ((1.0, 120.0), (8000, 192000), (1, 8)),
}


def score_reason() -> dict[str, Column]:
    """What is wrong with a scored clip (synthetic_score, threshold, duration_seconds, window_start_seconds, window_seconds), in order."""
    bad = lambda c, low, high: ~F.coalesce(F.col(c).between(low, high), F.lit(False)) | F.isnan(c)
    end = F.col("window_start_seconds") + F.col("window_seconds")
    return {"score": bad("synthetic_score", 0.0, 1.0), "threshold": bad("threshold", 0.0, 1.0), "duration": bad("duration_seconds", 0.0, 1e9), "window": bad("window_start_seconds", 0.0, 1e9) | bad("window_seconds", 0.0, 1e9) | (end > F.col("duration_seconds") + 1e-6)}


def record_json(df_types: list[tuple[str, str]], digits: int = 12) -> Column:
    """The row as JSON: doubles rounded, NaN and infinities as null."""
    fine = lambda n: F.when(~F.isnan(n) & (F.abs(n) < float("inf")), F.round(n, digits))
    return F.to_json(F.struct(*((fine(n) if t in ("double", "float") else F.col(n)).alias(n) for n, t in df_types)), {"ignoreNullFields": "false"})
