"""Metrics of a binary classifier on (label 0/1, score). Everything that depends on order is read off one table of distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def confusion(df: DataFrame, threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    hit = F.col("score") >= threshold
    n = lambda c: F.count(F.when(c, 1))
    return df.where("label IS NOT NULL AND score IS NOT NULL").groupBy(*(by or [])).agg(n((F.col("label") == 0) & ~hit).alias("tn"), n((F.col("label") == 0) & hit).alias("fp"), n((F.col("label") == 1) & ~hit).alias("fn"), n((F.col("label") == 1) & hit).alias("tp"))


def derived(counts: DataFrame) -> DataFrame:
    """Rates of a confusion table; what is undefined is null."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    f1 = _ratio(2 * tp, 2 * tp + fp + fn)
    f1_genuine = _ratio(2 * tn, 2 * tn + fn + fp)
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return counts.select(
        "*", n.alias("n"), _ratio(tp + tn, n).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"), recall.alias("recall"), f1.alias("f1"), specificity.alias("specificity"), _ratio(fp, tn + fp).alias("fpr"),
        _ratio(fn, tp + fn).alias("fnr"), _ratio(tn, tn + fn).alias("npv"), ((recall + specificity) / 2).alias("balanced_accuracy"), _ratio(tp.cast("double") * tn - fp.cast("double") * fn, root).alias("mcc"),
        ((f1 + f1_genuine) / 2).alias("macro_f1"), _ratio(f1 * (tp + fn) + f1_genuine * (tn + fp), n).alias("weighted_f1"), _ratio(tp + fn, n).alias("prevalence"),
    )


def zero_defaults(counts: DataFrame) -> DataFrame:
    """The older flavour: what is undefined is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    safe = lambda c: F.greatest(c, F.lit(1))
    precision, recall = tp / safe(tp + fp), tp / safe(tp + fn)
    return counts.select((tp + tn).alias("hits"), ((tp + tn) / safe(tn + fp + fn + tp)).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), (2 * tp / safe(2 * tp + fp + fn)).alias("f1"))


def score_table(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, score, pos, neg, and tp, fp: rows with at least this score; n_pos, n_neg in all. One row per distinct score.

    Scores are counted before they are ordered. Where no slice is named, the running sums run inside 256 score ranges, and
    over the ranges' totals: no task holds all scores."""
    by = by or []
    counted = df.where("label IS NOT NULL AND score IS NOT NULL").groupBy(*by, "score").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    ranged = counted.withColumn("__b", F.least(F.greatest(F.floor(F.col("score") * 256), F.lit(0)), F.lit(255)))
    held = ranged.groupBy(*by, "__b").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    above = W.partitionBy(*by).orderBy(F.desc("__b")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    before = held.select(*by, "__b", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_before") for c in ("__p", "__n")), F.sum("__p").over(whole).alias("n_pos"), F.sum("__n").over(whole).alias("n_neg"))
    run = W.partitionBy(*by, "__b").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = ranged.withColumns({"__tp": F.sum("pos").over(run), "__fp": F.sum("neg").over(run)})
    return inside.join(F.broadcast(before), [*by, "__b"]).select(*by, "score", "pos", "neg", (F.col("__tp") + F.col("__p_before")).alias("tp"), (F.col("__fp") + F.col("__n_before")).alias("fp"), "n_pos", "n_neg")


def roc_auc(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties by half; null without both classes."""
    wins = F.sum(F.col("pos").cast("double") * (F.col("n_neg") - F.col("fp")) + F.col("pos") * F.col("neg") / 2)
    return scores.groupBy(*(by or [])).agg(_ratio(wins, F.max(F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"))


def average_precision(scores: DataFrame, by: list[str] | None = None) -> DataFrame:
    return scores.groupBy(*(by or [])).agg(F.sum(F.col("pos") / F.nullif(F.col("n_pos"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def roc_points(scores: DataFrame) -> DataFrame:
    """threshold, fpr, tpr of each distinct score, and the origin at an infinite threshold."""
    points = scores.select(F.col("score").alias("threshold"), _ratio(F.col("fp"), F.col("n_neg")).alias("fpr"), _ratio(F.col("tp"), F.col("n_pos")).alias("tpr"))
    return points.unionByName(scores.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double"))


def pr_points(scores: DataFrame) -> DataFrame:
    """threshold, precision, recall of each distinct score, and the end point (1, 0) without a threshold."""
    points = scores.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _ratio(F.col("tp"), F.col("n_pos")).alias("recall"))
    return points.unionByName(scores.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double"))


def probability_losses(df: DataFrame) -> DataFrame:
    """Brier score and log loss, probabilities kept off 0 and 1 by the double's epsilon."""
    eps = 2.220446049250313e-16
    p = F.least(F.greatest(F.col("score"), F.lit(eps)), F.lit(1 - eps))
    y = F.col("label")
    return df.where("label IS NOT NULL AND score IS NOT NULL").agg(F.avg(F.pow(y - F.col("score"), F.lit(2))).alias("brier"), F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"))


def reliability(df: DataFrame, bins: int = 10) -> DataFrame:
    """bin, n, mean_score, positive_fraction of the bins that hold rows; a score of 1 falls into the last."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return df.where("label IS NOT NULL AND score IS NOT NULL").groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("label").cast("double")).alias("positive_fraction"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("positive_fraction"))) / F.sum("n")).alias("ece"))


def attacks_against_humans(df: DataFrame, attack: str) -> DataFrame:
    """attack, n, detected, recall, mean_score, roc_auc of each attack against all genuine rows.

    The genuine scores are counted once by distinct score and met by range-free sums: no genuine row is repeated per attack."""
    humans = df.where("label = 0 AND score IS NOT NULL").groupBy("score").agg(F.count(F.lit(1)).alias("neg"))
    attacks = df.where((F.col("label") == 1) & F.col(attack).isNotNull() & F.col("score").isNotNull()).groupBy(attack, "score").agg(F.count(F.lit(1)).alias("pos"))
    # genuine rows below each score that an attack has: a running sum over the distinct scores of both, by ranges
    both = attacks.select("score").distinct().join(humans, "score", "full").select("score", F.coalesce("neg", F.lit(0)).alias("neg")).withColumn("b", F.least(F.greatest(F.floor(F.col("score") * 256), F.lit(0)), F.lit(255)))
    held = both.groupBy("b").agg(F.sum("neg").alias("k"))
    base = held.select("b", F.coalesce(F.sum("k").over(W.partitionBy().orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(W.partitionBy()).alias("n_neg"))
    inside = F.coalesce(F.sum("neg").over(W.partitionBy("b").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = both.withColumn("inside", inside).join(F.broadcast(base), "b").select("score", "neg", (F.col("inside") + F.col("before")).alias("below"), "n_neg")
    met = attacks.join(ranked, "score")
    hits = F.sum(F.when(F.col("score") >= 0.5, F.col("pos")).otherwise(0))
    n = F.sum("pos")
    auc = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(n.cast("double") * F.max("n_neg"), F.lit(0.0))
    return met.groupBy(attack).agg(n.alias("n"), hits.alias("detected"), (hits / n).alias("recall"), (F.sum(F.col("score") * F.col("pos")) / n).alias("mean_score"), auc.alias("roc_auc"))


def human_errors(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """n_humans, false_positive_rate, mean_score of the genuine rows."""
    mine = df.where("label = 0 AND score IS NOT NULL")
    return mine.agg(F.count(F.lit(1)).alias("n_humans"), F.avg((F.col("score") >= threshold).cast("double")).alias("false_positive_rate"), F.avg("score").alias("mean_score"))


def scored(rows: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """rows with the score of their id. A row without a score, a score without a row, or an id scored twice is an error: nothing is matched by place."""
    once = predictions.groupBy(key).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("__k"))
    both = rows.withColumn("__here", F.lit(True)).join(once, key, "full")
    fine = F.col("__here").isNotNull() & F.col("__k").isNotNull() & (F.col("__k") == 1)
    wrong = F.raise_error(F.concat(F.lit("no single score and row for "), F.col(key).cast("string"))).cast("double")
    return both.withColumn("score", F.when(fine, F.col("score")).otherwise(wrong)).drop("__here", "__k")


def against_saved(found: DataFrame, saved: dict[str, float | None]) -> DataFrame:
    """metric, saved, found, agrees of one row of metrics: a saved value that is close to the recomputed one, or missing on either side, agrees."""
    spark = found.sparkSession
    table = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in saved.items()], "metric string, saved double")
    here = [c for c in saved if c in found.columns]
    flat = found.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("found")) for c in here))).alias("x")).select("x.*")
    return table.join(flat, "metric", "left").withColumn("agrees", F.coalesce(close_enough(F.col("saved"), F.col("found")), F.lit(True)))


def best_epoch(history: DataFrame) -> DataFrame:
    """The row of the least dev_loss, the first epoch among equals; none of an empty history."""
    return history.where("dev_loss IS NOT NULL AND NOT isnan(dev_loss)").agg(F.min_by(F.struct(*(F.col(c) for c in history.columns)), F.struct("dev_loss", "epoch")).alias("x")).where("x IS NOT NULL").select("x.*")


def pooled(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, place, value: mean over a recording's rows at each place of the vector; rows without a vector don't count."""
    flat = df.where(F.col(vector).isNotNull()).select(key, F.posexplode(vector).alias("place", "x"))
    return flat.groupBy(key, "place").agg(F.avg(F.col("x").cast("double")).alias("value"))


def close_enough(a: Column, b: Column, relative: float = 1e-6, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(relative) * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def content_identity(df: DataFrame, columns: list[str]) -> DataFrame:
    """digest, n_rows: one SHA-256 of all rows, whatever their order. Rows are digested, their digests gathered in 65,536 ranges, each range digested in order, then the ranges.

    A row is its columns as text, in the order named, each with its length before it and a null as `-`, so that no two rows look alike."""
    text = lambda c: F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    row = F.sha2(F.concat_ws(",", *map(text, columns)), 256)
    ranges = df.select(row.alias("h")).groupBy(F.substring("h", 1, 4).alias("g")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("d"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("g", "d"))), lambda x: x["d"])
    return ranges.agg(F.sha2(F.array_join(ordered, ""), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"))


def logit_losses(df: DataFrame, logit: str = "logit") -> DataFrame:
    """Mean binary cross-entropy of logits and accuracy of their signs; stable for large logits."""
    z, y = F.col(logit), F.col("label")
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return df.where(z.isNotNull() & y.isNotNull()).agg(F.avg(loss).alias("loss"), F.avg(F.when((z > 0).cast("int") == y, 1.0).otherwise(0.0)).alias("accuracy"))
