"""Queries of the problems on training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.llm import calibrate, grouped_split
from sonoplan.llm.bpe import encode_texts
from sonoplan.llm.canonical import canonical
from sonoplan.llm.leak import find_leaks, find_near
from sonoplan.llm.overlap import overlap_pairs, overlap_report, overlap_spans
from sonoplan.llm.pieces import split_oversized
from sonoplan.llm.sql import SQL
from sonoplan.session import durable
from sonoplan.sources.tables import table


def _typed_languages(spark: SparkSession, folder: str) -> DataFrame:
    """source_table, sample_id, typed, code, exact of each distinct sample of both tables."""
    typed = lambda name, c: table(spark, folder, name).select(F.lit(name).alias("source_table"), "sample_id", F.col(c).alias("typed")).distinct()
    rows = typed("indicvoices", "lang").unionByName(typed("indicsynth", "language"))
    return canonical(rows, table(spark, folder, "language_list"), "language_code", ["iso3"], "name", "other_names")


def p3_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """source_table, sample_id, typed, code of each distinct sample of both tables; code is null where nothing was typed."""
    return _typed_languages(spark, folder).drop("exact")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _typed_languages(spark, folder).where("NOT exact").select("source_table", "sample_id", F.col("code").alias("language_code"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Samples and distinct values of each code and table, `none` for the unmatched."""
    return p3_mapped(spark, folder).where("typed IS NOT NULL").groupBy("source_table", F.col("code").alias("language_code")).agg(F.count(F.lit(1)).alias("n_samples"), F.countDistinct("typed").alias("n_values"))


def p4_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_pairs(table(spark, folder, "baseline_rows"), table(spark, folder, "recording_windows"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_pairs(spark, folder).select("id_a", "id_b")


def p4_spans(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_spans(table(spark, folder, "baseline_rows"), table(spark, folder, "recording_windows"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap_report(table(spark, folder, "baseline_rows"), p4_pairs(spark, folder))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    planned, _ = calibrate.plan(table(spark, folder, "manifest"), table(spark, folder, "sample_targets"))
    return calibrate.report(spark, planned)


def p5_margins(spark: SparkSession, folder: str) -> DataFrame:
    """What the sample's shares by language, label and generator miss of their targets."""
    planned, _ = calibrate.plan(table(spark, folder, "manifest"), table(spark, folder, "sample_targets"))
    return calibrate.margin_report(spark, planned)


def p5_cells(spark: SparkSession, folder: str) -> DataFrame:
    """All cells with what they hold, want and lack."""
    return p5_report(spark, folder).select("cell_id", "n_available", "n_wanted", "n_missing")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_report(spark, folder).where("n_available < n_wanted").select("cell_id")


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return calibrate.draw(*calibrate.plan(table(spark, folder, "manifest"), table(spark, folder, "sample_targets")))


def p5_checks(spark: SparkSession, folder: str) -> DataFrame:
    """n_rows and n_ids of the sample, and what must be 0: rows that aren't of their cell (n_outside), cells drawn below their floor though they hold it (n_below)."""
    planned, held = calibrate.plan(table(spark, folder, "manifest"), table(spark, folder, "sample_targets"))
    drawn = calibrate.draw(planned, held)
    joined = drawn.join(held.select("sample_id", "cells"), "sample_id", "left")
    floors = spark.createDataFrame([(int(r.cell_id), int(min(r.min_rows or 0, r.n_own))) for r in planned.itertuples()], "cell_id int, floor bigint")
    below = floors.join(drawn.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")), "cell_id", "left").agg(F.count(F.when(F.coalesce("n", F.lit(0)) < F.col("floor"), 1)).alias("n_below"))
    n_below = below.first()["n_below"]
    totals = joined.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("sample_id").alias("n_ids"), F.count(F.when(~F.coalesce(F.array_contains("cells", F.col("cell_id")), F.lit(False)), 1)).alias("n_outside"))
    return totals.withColumn("n_below", F.lit(n_below).cast("bigint"))


#: Shares of the new splits.
RATIOS = {"train": 0.6, "dev": 0.2, "test": 0.2}


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_split.broken(grouped_split.grouped(table(spark, folder, "manifest")))


def p6_splits(spark: SparkSession, folder: str) -> DataFrame:
    return grouped_split.split_groups(grouped_split.grouped(table(spark, folder, "manifest")), RATIOS)


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """Records and components of each new split, with its share of all records."""
    found = p6_splits(spark, folder).groupBy("new_split").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("component").alias("n_components"))
    total = F.sum("n_records").over(W.partitionBy())
    return found.select("new_split", "n_records", "n_components", F.round(F.col("n_records") / total, 6).alias("share"))


def p6_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Records and groups, and the groups that the new splits tear apart: none."""
    found = p6_splits(spark, folder)
    per = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"), (F.min("new_split") != F.max("new_split")).alias("torn"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_records"), F.count(F.lit(1)).alias("n_components"), F.count(F.when(F.col("torn"), 1)).alias("n_torn"))


def p6_quotas(spark: SparkSession, folder: str) -> DataFrame:
    """new_split, label (bonafide or other), n_quota, met: whether the split misses its quota of the label by less than a record."""
    rows = durable(grouped_split.grouped(table(spark, folder, "manifest")))
    label = F.when(F.col("label") == "bonafide", "bonafide").otherwise("other").alias("label")
    found = grouped_split.split_groups(rows, RATIOS).join(rows.select("sample_id", label), "sample_id").groupBy("new_split", "label").agg(F.count(F.lit(1)).alias("n"))
    shares = F.create_map(*(F.lit(x) for pair in RATIOS.items() for x in pair))
    quota = F.sum("n").over(W.partitionBy("label")) * F.element_at(shares, F.col("new_split"))
    return found.withColumn("n_quota", F.round(quota, 6)).select("new_split", "label", "n_quota", (F.abs(F.col("n") - F.col("n_quota")) < 1).alias("met"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pieces(spark, folder).where("piece_no = 0").select("doc_id")


def p8_passages(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an item's words within runs of eight or more."""
    return p8_passages(spark, folder).where("covered_words * 2 >= item_words").select("doc_id", "item_id")


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """Per item: documents that hold it whole, by half, or any run of it."""
    is_ = lambda c: F.count(F.when(c, 1))
    return p8_passages(spark, folder).groupBy("item_id").agg(is_(F.expr("covered_words = item_words")).alias("n_whole"), is_(F.expr("covered_words * 2 >= item_words")).alias("n_half"), F.count(F.lit(1)).alias("n_any"), F.max("longest_run").alias("longest_run"))


def p8_near(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an item's windows nearly, with words put in, left out or changed."""
    found = find_near(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")
    return found.where("near_windows * 2 >= item_windows")


QUERIES = {f.__name__: f for f in (p3_found, p3_mapped, p3_report, p4_found, p4_pairs, p4_spans, p4_report, p5_found, p5_report, p5_cells, p5_margins, p5_sample, p5_checks, p6_found, p6_splits, p6_report, p6_checks, p6_quotas, p8_found, p8_passages, p8_items, p8_near, p7_ids, p9_pieces, p9_found)}
__all__ = ["QUERIES", "SQL"]
