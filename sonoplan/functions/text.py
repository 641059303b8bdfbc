"""Column builders for typed-in text: trimming, missing words, digests, names of speakers and files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space beyond what trim() strips.
BLANK = r"[\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
_EDGES = " " + "".join(map(chr, [*range(9, 14), 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))
#: Words that stand for a missing value.
MISSING_WORDS = ("nan", "none", "null")


def tidy(c: Column) -> Column:
    """c without white space of any kind at its ends."""
    return F.btrim(c, F.lit(_EDGES))


def is_missing(c: Column) -> Column:
    """Null, blank, or a word standing for null. Never null itself."""
    return c.isNull() | F.lower(tidy(c)).isin("", *MISSING_WORDS)


def known(c: Column) -> Column:
    """The trimmed value, null where it is missing."""
    return F.when(~is_missing(c), tidy(c))


def speaker_key(c: Column) -> Column:
    """One spelling for a speaker: namespace::number in lower case, without blanks, decimals or leading zeros; null where missing.

    `Indicvoices:: 56`, `indicvoices:speaker:56` and `indicvoices::56.0` name the same speaker."""
    bare = F.lower(F.regexp_replace(c, f"{BLANK}+", ""))
    joined = F.regexp_replace(bare, r"^([^:]+):+(?:speaker:+)?", "$1::")
    full = F.when(~is_missing(c), F.regexp_replace(F.regexp_replace(joined, r"\.0*$", ""), r"::0+(?=\d)", "::"))
    # most values need no repair
    return F.when(c.rlike(r"^[a-z]+::(0|[1-9][0-9]*)\z"), c).otherwise(full)


def file_key(c: Column) -> Column:
    """One spelling for a file: lower case, forward slashes, no `.` or empty steps; null where missing."""
    path = F.regexp_replace(F.lower(tidy(c)), r"[\\/]+", "/")
    full = F.when(~is_missing(c), F.regexp_replace(path, r"(^|/)(\./)+", "$1"))
    return F.when(c.rlike(r"^[A-Za-z0-9_]+(/[A-Za-z0-9_]+)+[.][A-Za-z0-9]+\z"), F.lower(c)).otherwise(full)


def digest_key(c: Column) -> Column:
    """64 lower-case hex digits of a SHA-256 in any spelling; null for missing values, placeholders and other text.

    A placeholder is text that is no digest, or a digest of one repeated digit."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"[\s\u00a0\-_]+", ""), r"^(sha256:?|0x)+", "")
    return F.when(bare.rlike(r"^[0-9a-f]{64}$") & ~bare.rlike(r"^(.)\1{63}$"), bare)
