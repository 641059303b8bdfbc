"""Splits by hash, group and name, and duplicates across them. All are decided per row or per key: no order of rows matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.functions.fields import bucket, thirds
from sonoplan.operators.graph import connected_components
from sonoplan.session import durable


def group_key() -> Column:
    """Speaker, else source file; null where both are missing."""
    return F.coalesce(F.nullif(F.trim("speaker_id"), F.lit("")), F.col("source_file"))


def speaker_disjoint(df: DataFrame, ratios: tuple[float, float, float] = (0.6, 0.2, 0.2), seed: str = "42") -> DataFrame:
    """df with new_split, equal for all rows of a group. Groups are taken in the order of their hash; each split with a ratio gets at least one group of three.

    Ranks come from prefix counts over hash buckets, so that no task sees all groups. Rows without a group stay null."""
    keyed = df.withColumn("group_key", group_key())
    order = F.sha2(F.concat(F.lit(f"{seed}|"), "group_key"), 256)
    groups = durable(keyed.where("group_key IS NOT NULL").select("group_key").distinct().withColumn("h", order).withColumn("b", F.substring("h", 1, 2)))
    held = groups.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    # 256 rows
    before = held.select("b", F.coalesce(F.sum("k").over(W.partitionBy().orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(W.partitionBy()).alias("n"))
    at = F.row_number().over(W.partitionBy("b").orderBy("h", "group_key")) + F.col("before")
    ranked = groups.join(F.broadcast(before), "b").withColumn("at", at)
    n = F.col("n")
    enough = lambda r, c: F.greatest(F.round(F.lit(r) * c), F.when(n >= 3, F.lit(1 if r else 0)).otherwise(F.lit(0)))
    dev, test = enough(ratios[1], n), enough(ratios[2], n)
    # where rounding leaves train without a group, the larger of the others gives it
    lack = F.greatest(F.lit(0), F.when(n >= 3, F.lit(1 if ratios[0] else 0)).otherwise(F.lit(0)) - (n - dev - test))
    dev, test = F.when(dev >= test, dev - lack).otherwise(dev), F.when(dev >= test, test).otherwise(test - lack)
    split = F.when(F.col("at") <= n - dev - test, "train").when(F.col("at") <= n - test, "dev").otherwise("test")
    return keyed.join(ranked.select("group_key", split.alias("new_split")), "group_key", "left")


def generator_split(names: dict[str, list[str]], current: Column) -> Column:
    """The split whose list names the generator; others, null included, keep theirs. A generator in two lists is an error."""
    flat = [g for gs in names.values() for g in gs]
    if len(flat) != len(set(flat)):
        raise ValueError("a generator is named for two splits")
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for split, gs in names.items():
        if gs:
            out = out.when(F.col("generator").isin(*gs), split)
    return F.coalesce(out, current)


def pair_split(keys: Column, seed: str) -> Column:
    """The split that all keys of a row hash to; null if they differ or there are none."""
    parts = F.array_distinct(F.transform(keys, lambda k: thirds(bucket(seed, k))))
    return F.when(F.size(parts) == 1, parts[0])


def first_wins(df: DataFrame, key: str, priority: Column, order: str) -> DataFrame:
    """One row per key: the one of the first priority, then the first in order. Rows with a null key all stay."""
    # an aggregate, so that a key that holds a third of the rows is combined before the shuffle
    first = F.min_by(F.struct(*(F.col(c) for c in df.columns)), F.struct(priority.alias("p"), F.col(order).alias("o")))
    known = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(first.alias("__row")).select("__row.*")
    return known.unionByName(df.where(F.col(key).isNull()))


def component_split(df: DataFrame, node: str, shared: list[str], seed: str, train: int = 80, dev: int = 90) -> DataFrame:
    """node, root, new_split: nodes that share a value are one component, and a component's hash gives its split.

    Each value links its nodes to the least of them (a star), so that n rows of a value make n edges."""
    edges = None
    for c in shared:
        known = df.where(F.col(c).isNotNull()).select(F.col(node).cast("string").alias("a"), F.col(c).alias("v")).distinct()
        star = known.groupBy("v").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("k")).where("k > 1")
        one = known.join(star, "v").select("a", "b")
        edges = one if edges is None else edges.unionByName(one)
    roots = connected_components(edges)
    nodes = df.select(F.col(node).cast("string").alias("node")).where("node IS NOT NULL").distinct().join(roots, "node", "left")
    named = nodes.select("node", F.coalesce("root", "node").alias("root"))
    return named.withColumn("new_split", thirds(bucket(seed, F.col("root")), train, dev))




def partition(df: DataFrame, key: str, label: str, original: str, window: str, shared: list[str], seed: str = "42", minimum: int = 100) -> DataFrame:
    """key, label, root, new_split (train, validation, test by 80/10/10): recordings of one original, window or shared value keep together, and of identical windows only the first by key stays.

    A repeated or null key, a label other than 0 and 1, one window with both labels, or fewer than `minimum` rows of a class in a split are errors.
    Rows without an original are one by themselves; null windows and shared values relate nothing."""
    rows = df.select(key, label, F.coalesce(F.col(original), F.concat(F.lit("row "), F.col(key).cast("string"))).alias("__o"), window, *shared)
    if not rows.groupBy(key).agg(F.count(F.lit(1)).alias("k")).where(F.col(key).isNull() | (F.col("k") > 1)).isEmpty() or not rows.where(F.col(label).isNull() | ~F.col(label).isin(0, 1)).isEmpty():
        raise ValueError("a repeated identity or an illegal class")
    if not rows.where(F.col(window).isNotNull()).groupBy(window).agg((F.min(label) != F.max(label)).alias("c")).where("c").isEmpty():
        raise ValueError("an identical window has both labels")
    roots = component_split(rows, "__o", [window, *shared], seed, 80, 90)
    named = F.when(F.col("new_split") == "dev", "validation").otherwise(F.col("new_split")).alias("new_split")
    out = durable(first_wins(rows, window, F.lit(0), key).join(roots, F.col("__o") == F.col("node")).select(key, label, "root", named))
    counts = {(r["new_split"], r[label]): r["n"] for r in out.groupBy("new_split", label).agg(F.count(F.lit(1)).alias("n")).collect()}
    short = [s for s in ("train", "validation", "test") if min(counts.get((s, k), 0) for k in (0, 1)) < minimum]
    if short:
        raise ValueError(f"{short} lack {minimum} rows of each class: {counts}")
    return out


def first_wins_all(df: DataFrame, key: str, keys: list[str], priority: Column) -> DataFrame:
    """df's rows that a walk in the order of (priority, key) keeps when it drops each row one of whose keys a kept row has. key is unique; null keys match nothing.

    Exactly the walk's result, without the walk: in each round the rows that come first for all their keys are kept, and those
    that share a key with them are dropped. Rounds are as many as the longest chain of such decisions."""
    slim = df.select(F.col(key).alias("__id"), F.struct(priority.alias("p"), F.col(key).alias("i")).alias("__o"), *(F.col(k).alias(f"__k{n}") for n, k in enumerate(keys)))
    names = [f"__k{n}" for n in range(len(keys))]
    open_, kept = durable(slim), None
    while not open_.isEmpty():
        judged, first = open_, F.lit(True)
        for n in names:
            least = open_.where(F.col(n).isNotNull()).groupBy(n).agg(F.min("__o").alias(f"__m{n}"))
            judged = judged.join(least, n, "left")
            first = first & (F.col(n).isNull() | (F.col("__o") == F.col(f"__m{n}")))
        winners = durable(judged.where(first).select("__id", *names))
        rest = open_.join(winners.select("__id"), "__id", "left_anti")
        for n in names:
            rest = rest.join(winners.where(F.col(n).isNotNull()).select(n).distinct(), n, "left_anti")
        open_ = durable(rest.select("__id", "__o", *names))
        kept = winners.select("__id") if kept is None else kept.unionByName(winners.select("__id"))
    return df.limit(0) if kept is None else df.join(kept, F.col(key) == F.col("__id"), "left_semi")
