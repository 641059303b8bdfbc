"""Audit of delivered metadata: records that break the contract, empty cells, identities that cross splits, and what was and wasn't checked."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonoplan.functions.fields import spaced
from sonoplan.functions.text import tidy
from sonoplan.session import durable


@dataclass(frozen=True)
class Contract:
    """The languages, splits and labels that the delivered corpus has."""

    languages: Sequence[str] = ("en", "hi", "id", "ms", "ta", "th", "vi")
    splits: Sequence[str] = ("evaluation", "train", "validation")
    labels: Sequence[str] = ("bonafide", "spoof")


IDENTITIES = ("row_id", "utterance_id", "speaker_id", "audio_sha256")


def exact_text_key(text: Column, exact: Column, least: int = 20) -> Column:
    """Digest of the lower-case text with single spaces, where the text is said to be exact and has at least so many characters."""
    flat = spaced(F.lower(text))
    return F.when(F.coalesce(exact, F.lit(False)) & (F.length(flat) >= least), F.sha2(flat, 256))


def metadata_audit(df: DataFrame, language: str, contract: Contract = Contract()) -> DataFrame:
    """kind, name, n: invalid records by reason, records by split/language/label, missing cells (n is 0), values of each identity in more than one split, and rows that name it.

    df: row_id, utterance_id, speaker_id, audio_sha256, language, split, label, text, is_text_exact (boolean). A record of an unknown language, or
    without a legal split, label and id, counts for nothing else; those of other languages than the one asked for (unless `all`) aren't looked
    at; a repeated id is counted, and the record too. Null fields are just not named."""
    if language != "all" and language not in contract.languages:
        raise ValueError(f"no language {language}")
    legal = lambda c, among: F.coalesce(F.col(c).isin(*among), F.lit(False))
    asked = F.lit(True) if language == "all" else F.col("language") == language
    unknown = ~legal("language", contract.languages)
    broken = ~(legal("split", contract.splits) & legal("label", contract.labels) & (F.coalesce(F.col("row_id"), F.lit("")) != ""))
    rows = df.where(unknown | asked).withColumn("reason", F.when(unknown, "unknown_language").when(broken, "invalid_split_label_or_row_id"))
    counted = lambda d, kind, name: d.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    fine = rows.where("reason IS NULL")
    cells = durable(counted(fine, "count", F.concat_ws("/", "split", "language", "label")))
    wanted = df.sparkSession.createDataFrame([("/".join(x),) for x in product(contract.splits, contract.languages if language == "all" else [language], contract.labels)], "name string")
    missing = wanted.join(cells.select("name"), "name", "left_anti").select(F.lit("missing_cell").alias("kind"), "name", F.lit(0).cast("bigint").alias("n"))
    bad_digest = F.col("audio_sha256").isNotNull() & (tidy(F.col("audio_sha256")) != "") & ~F.col("audio_sha256").rlike(r"^[0-9a-f]{64}\z")
    named = [F.struct(F.lit(c).alias("field"), F.when(tidy(F.col(c)) != "", F.when(~bad_digest, F.col(c)) if c == "audio_sha256" else F.col(c)).alias("value")) for c in IDENTITIES]
    texts = F.struct(F.lit("exact_text").alias("field"), exact_text_key(F.col("text"), F.col("is_text_exact")).alias("value"))
    values = fine.select("split", F.explode(F.array(*named, texts)).alias("x")).where("x.value IS NOT NULL").groupBy("x.field", "x.value").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.count(F.lit(1)).alias("n"))
    per = durable(values.groupBy("field").agg(F.count(F.when(F.col("low") != F.col("high"), 1)).alias("crossing"), F.sum("n").alias("rows")))
    fields = df.sparkSession.createDataFrame([(c,) for c in (*IDENTITIES, "exact_text")], "field string").join(per, "field", "left")
    one = lambda d, kind, n: d.select(F.lit(kind).alias("kind"), F.col("field").alias("name"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n"))
    again = fine.groupBy("row_id").agg(F.count(F.lit(1)).alias("k")).agg((F.coalesce(F.sum("k"), F.lit(0)) - F.count(F.lit(1))).cast("bigint").alias("n")).where("n > 0").select(F.lit("invalid").alias("kind"), F.lit("duplicate_row_id").alias("name"), "n")
    parts = [
        counted(rows.where("reason IS NOT NULL"), "invalid", F.col("reason")), again, counted(fine.where(bad_digest), "invalid", F.lit("invalid_audio_sha256")), cells, missing,
        one(fields, "overlap", F.col("crossing")), one(fields.where(F.col("field").isin("speaker_id", "audio_sha256")), "coverage", F.col("rows")),
    ]
    return reduce(DataFrame.unionByName, parts)


def audit_status(audit: DataFrame) -> DataFrame:
    """status, records, speaker_separation, audio_duplicates of a metadata audit. Shared utterance ids or texts are no failure by themselves."""
    total = lambda kind, *names: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("name").isin(*names) if names else F.lit(True)), F.col("n"))), F.lit(0))
    row = audit.agg(
        total("count").alias("records"), (total("invalid") + F.count(F.when(F.col("kind") == "missing_cell", 1)) + total("overlap", "row_id", "audio_sha256", "speaker_id")).alias("failures"), total("coverage", "speaker_id").alias("speakers"), total("coverage", "audio_sha256").alias("digests"),
    )
    checked = lambda c, of: F.when((F.col("records") > 0) & (F.col(c) == F.col("records")), f"checked_for_supplied_{of}").otherwise("unverified")
    return row.select(F.when(F.col("failures") > 0, "issues_found").otherwise("metadata_checks_passed").alias("status"), F.col("records").cast("bigint").alias("records"), checked("speakers", "ids").alias("speaker_separation"), checked("digests", "hashes").alias("audio_duplicates"))


def voice_overlap(df: DataFrame, source: str, voice: str, split: str = "split") -> DataFrame:
    """n_values: voices, each within its source, that stand in more than one split; rows without a voice don't count."""
    per = df.where(F.col(voice).isNotNull() & (F.col(voice) != "")).groupBy(source, voice).agg((F.min(split) != F.max(split)).alias("crosses"))
    return per.agg(F.count(F.when(F.col("crosses"), 1)).alias("n_values"))
