"""Profile of columns per load.

Values are unpivoted and counted per (column, load, value) before anything is shuffled. The counted values are sorted by
range of (column, value) into blocks; what a block needs of those before it is a prefix sum over one small row per
(block, column, load). Cumulative counts are then exact everywhere: quantiles are read off at their ranks, and the curves of
a load, of all loads and of the load before meet at each value for exact Kolmogorov-Smirnov distances.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.functions.text import is_missing
from sonoplan.session import durable, partitions

#: Counted values of a block, about.
BLOCK = 500_000


@dataclass(frozen=True)
class Checked:
    """A column to profile. pattern: what a well-formed text matches; between: limits of a well-formed number; where: the rows that count."""

    name: str
    pattern: str | None = None
    between: tuple[float, float] | None = None
    where: Column | None = None


def counted_values(df: DataFrame, load: str, columns: list[Checked]) -> DataFrame:
    """column_name, load_id, status (missing, malformed, ok), number, words, n: one row per distinct value of a load.

    NaN, blank and words standing for null are missing; a null load is a load of its own."""
    items = []
    for c in columns:
        value = F.col(c.name)
        if c.between:
            number = value.cast("double")
            status = F.when(number.isNull() | F.isnan(number), "missing").when(number.between(*c.between), "ok").otherwise("malformed")
            number, words = F.when(status != "missing", number), F.lit(None).cast("string")
        else:
            words = value.cast("string")
            status = F.when(is_missing(words), "missing").when(words.rlike(c.pattern), "ok").otherwise("malformed")
            number, words = F.lit(None).cast("double"), F.when(status != "missing", words)
        inside = F.lit(True) if c.where is None else F.coalesce(c.where, F.lit(False))
        items.append(F.when(inside, F.struct(F.lit(c.name).alias("column_name"), status.alias("status"), number.alias("number"), words.alias("words"))))
    cells = df.select(F.col(load).alias("load_id"), F.explode(F.array(*items)).alias("v")).where(F.col("v").isNotNull())
    return cells.select("v.column_name", "load_id", "v.status", "v.number", "v.words").groupBy("column_name", "load_id", "status", "number", "words").agg(F.count(F.lit(1)).alias("n"))


def load_summary(counts: DataFrame) -> DataFrame:
    """Per column and load: rows, missing, malformed, well-formed, distinct malformed values, range of those present, rows of the commonest well-formed value."""
    n, status = F.col("n"), F.col("status")
    present = status != "missing"
    part = lambda s: F.coalesce(F.sum(F.when(status == s, n)), F.lit(0)).cast("bigint")
    return counts.groupBy("column_name", "load_id").agg(
        F.sum("n").alias("n_rows"), part("missing").alias("n_missing"), part("malformed").alias("n_malformed"), part("ok").alias("n_ok"),
        F.count(F.when(status == "malformed", 1)).alias("n_odd"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"), F.min("words").alias("min_words"), F.max("words").alias("max_words"),
        F.coalesce(F.max(F.when(status == "ok", n)), F.lit(0)).cast("bigint").alias("n_top"),
    )


def placed_values(counts: DataFrame) -> DataFrame:
    """Well-formed counted values, sorted by range into blocks of bounded size. Kept in the shared folder: a block keeps its bounds when a task is run again."""
    ok = counts.where(F.col("status") == "ok").select("column_name", "load_id", "number", "words", "n")
    blocks = max(partitions(counts.sparkSession), -(-ok.count() // BLOCK))
    ranged = ok.repartitionByRange(blocks, "column_name", "number", "words")
    return durable(ranged.withColumn("block", F.spark_partition_id()))


def _prefix(placed: DataFrame, by: list[str], name: str) -> DataFrame:
    """What lies in earlier blocks, for each block and group."""
    held = placed.groupBy("block", *by).agg(F.sum("n").alias("held"))
    before = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return held.select(*(F.col(c).alias(f"__{c}") for c in ("block", *by)), F.coalesce(F.sum("held").over(before), F.lit(0)).alias(name), F.sum("held").over(W.partitionBy(*by)).alias(f"{name}_total"))


def _joined(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return left.join(right, on).drop(*(f"__{c}" for c in by))


def curves(placed: DataFrame) -> DataFrame:
    """For each value of a load: rows up to it in the load (cum of total) and in all loads (cum_all of total_all), n and n_all of them at it."""
    value = ["number", "words"]
    own = W.partitionBy("block", "column_name", "load_id").orderBy(*value).rowsBetween(W.unboundedPreceding, W.currentRow)
    pooled = W.partitionBy("block", "column_name").orderBy(*value).rangeBetween(W.unboundedPreceding, W.currentRow)
    peers = W.partitionBy("block", "column_name", *value)
    inside = placed.withColumns({"n_all": F.sum("n").over(peers), "in_all": F.sum("n").over(pooled), "in_own": F.sum("n").over(own)})
    both = _joined(_joined(inside, _prefix(placed, ["column_name", "load_id"], "own"), ["block", "column_name", "load_id"]), _prefix(placed, ["column_name"], "pool"), ["block", "column_name"])
    return both.select(
        "column_name", "load_id", *value, "n", "n_all", (F.col("in_own") + F.col("own")).alias("cum"), F.col("own_total").alias("total"),
        (F.col("in_all") + F.col("pool")).alias("cum_all"), F.col("pool_total").alias("total_all"),
    )


def _at(rank: Column) -> Column:
    return F.max(F.when((F.col("cum") - F.col("n") <= rank) & (rank < F.col("cum")), F.col("number")))


def distribution(curve: DataFrame) -> DataFrame:
    """Per column and load: places of the curve (distinct well-formed values), exact quartiles (numbers), Kolmogorov-Smirnov and total-variation distance to all loads together."""
    total, share, share_all = F.col("total"), F.col("n") / F.col("total"), F.col("n_all") / F.col("total_all")
    gap = F.greatest(
        F.abs(F.col("cum") / total - F.col("cum_all") / F.col("total_all")),
        F.abs((F.col("cum") - F.col("n")) / total - (F.col("cum_all") - F.col("n_all")) / F.col("total_all")),
    )
    sides = {}
    for name, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        rank = (total - 1) * F.lit(q)
        sides |= {f"{name}_low": _at(F.floor(rank)), f"{name}_high": _at(F.ceil(rank))}
    out = curve.groupBy("column_name", "load_id").agg(
        F.count(F.lit(1)).alias("n_places"), F.max("total").alias("total"), F.max(gap).alias("ks_all"), F.sum(F.abs(share - share_all)).alias("near"), F.sum(share_all).alias("seen"), *(e.alias(n) for n, e in sides.items()),
    )
    between = lambda n, q: F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * ((total - 1) * F.lit(q) % 1)
    return out.select("column_name", "load_id", "n_places", "ks_all", ((F.col("near") + 1 - F.col("seen")) / 2).alias("tv_all"), between("q25", 0.25).alias("q25"), between("median", 0.5).alias("median"), between("q75", 0.75).alias("q75"))


def between_loads(placed: DataFrame) -> DataFrame:
    """Exact Kolmogorov-Smirnov distance of each load to the load before it (by load_id) that holds values of the column."""
    loads = placed.groupBy("column_name", "load_id").agg(F.sum("n").alias("total")).withColumn("later", F.lead("load_id").over(W.partitionBy("column_name").orderBy("load_id")))
    named = _joined(placed, loads.select(F.col("column_name").alias("__column_name"), F.col("load_id").alias("__load_id"), "later", "total"), ["column_name", "load_id"])
    steps = named.select(
        "block", "column_name", "number", "words",
        F.explode(F.array(F.struct(F.col("load_id").alias("load_id"), F.col("n").alias("own"), F.lit(0).cast("bigint").alias("prev")), F.struct(F.col("later").alias("load_id"), F.lit(0).cast("bigint").alias("own"), F.col("n").alias("prev")))).alias("s"),
    ).select("block", "column_name", "number", "words", "s.*").groupBy("block", "column_name", "load_id", "number", "words").agg(F.sum("own").alias("own"), F.sum("prev").alias("prev"))
    by = ["column_name", "load_id"]
    held = steps.groupBy("block", *by).agg(F.sum("own").alias("own"), F.sum("prev").alias("prev"))
    before = W.partitionBy(*by).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    at = held.select(F.col("block").alias("__block"), *(F.col(c).alias(f"__{c}") for c in by), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("own", "prev")), *(F.sum(c).over(whole).alias(f"{c}_total") for c in ("own", "prev")))
    run = W.partitionBy("block", *by).orderBy("number", "words").rowsBetween(W.unboundedPreceding, W.currentRow)
    walked = _joined(steps.withColumns({"own_in": F.sum("own").over(run), "prev_in": F.sum("prev").over(run)}), at, ["block", *by]).where((F.col("own_total") > 0) & (F.col("prev_total") > 0))
    gap = F.abs((F.col("own_in") + F.col("own_before")) / F.col("own_total") - (F.col("prev_in") + F.col("prev_before")) / F.col("prev_total"))
    return walked.groupBy(*by).agg(F.max(gap).alias("ks_previous"))


def profile(df: DataFrame, load: str, columns: list[Checked]) -> DataFrame:
    """The whole profile, one row per column and load. Distances and quartiles are null where a load has no well-formed value."""
    counts = durable(counted_values(df, load, columns))
    placed = placed_values(counts)
    parts = [(distribution(curves(placed)), "d"), (between_loads(placed), "b")]
    out = load_summary(counts)
    for part, tag in parts:
        named = part.select(F.col("column_name").alias(f"__column_name{tag}"), F.col("load_id").alias(f"__load_id{tag}"), *[c for c in part.columns if c not in ("column_name", "load_id")])
        out = out.join(named, (F.col("column_name") == F.col(f"__column_name{tag}")) & F.col("load_id").eqNullSafe(F.col(f"__load_id{tag}")), "left").drop(f"__column_name{tag}", f"__load_id{tag}")
    return out.withColumn("n_distinct", F.col("n_odd") + F.coalesce("n_places", F.lit(0))).drop("n_odd", "n_places")


@dataclass(frozen=True)
class Limits:
    missing: float = 0.15
    malformed: float = 0.12
    constant: float = 0.7
    factor: float = 1.5
    distance: float = 0.4


def findings(df: DataFrame, load: str, columns: list[Checked], constant: set[str], shift: set[str], limits: Limits = Limits()) -> DataFrame:
    """load_id, column_name, finding (missing, format, range, constant, shift) of the loads that depart from the rest.

    constant, shift: columns for which these findings apply. A load without well-formed values has neither of them."""
    counts = durable(counted_values(df, load, columns))
    placed = placed_values(counts)
    spread = distribution(curves(placed)).select(F.col("column_name").alias("__column"), F.col("load_id").alias("__load"), "median", "tv_all")
    base = load_summary(counts).join(spread, (F.col("column_name") == F.col("__column")) & F.col("load_id").eqNullSafe(F.col("__load")), "left")
    every = W.partitionBy("column_name")
    missing, present = F.col("n_missing") / F.col("n_rows"), F.col("n_rows") - F.col("n_missing")
    numbers = [c.name for c in columns if c.between]
    is_number = F.col("column_name").isin(*numbers)
    judged = base.select(
        "load_id", "column_name", missing.alias("missing"), F.percentile(missing, F.lit(0.5)).over(every).alias("usual_missing"),
        (F.col("n_malformed") / F.when(present > 0, present)).alias("malformed"), (F.col("n_top") / F.when(F.col("n_ok") > 0, F.col("n_ok"))).alias("top"),
        "median", F.percentile("median", F.lit(0.5)).over(every).alias("usual"), "tv_all",
    )
    factor = F.greatest(F.col("median") / F.col("usual"), F.col("usual") / F.col("median"))
    found = F.array(
        F.when(F.col("missing") - F.col("usual_missing") > limits.missing, "missing"),
        F.when(F.col("malformed") > limits.malformed, F.when(is_number, "range").otherwise("format")),
        F.when(F.col("column_name").isin(*constant) & (F.col("top") > limits.constant), "constant"),
        F.when(F.col("column_name").isin(*shift) & F.when(is_number, factor > limits.factor).otherwise(F.col("tv_all") > limits.distance), "shift"),
    )
    return judged.select("load_id", "column_name", F.explode(F.array_compact(found)).alias("finding"))
