"""Checks whose result is a table of what is wrong, or of counts that must agree."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(reasons: dict[str, Column]) -> Column:
    """The first reason that holds, null where none does; conditions that are null don't hold."""
    return F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in reasons.items()))


def eligibility(df: DataFrame, datasets: list[str], languages: list[str], holdout: list[str]) -> DataFrame:
    """df with reason: why a record can't be chosen, in the order of the checks. A null generator is not a held-out one."""
    blank = F.coalesce(F.trim("speaker_id"), F.lit("")) == ""
    reasons = {
        "external_or_nonprimary": ~F.coalesce(F.col("dataset").isin(*datasets), F.lit(False)),
        "unselected_language": ~F.coalesce(F.col("language").isin(*languages), F.lit(False)),
        "missing_or_zero_duration": F.col("duration").isNull() | (F.col("duration") <= 0),
        "missing_speaker": blank,
        "reserved_generator": F.col("generator").isin(*holdout),
        "missing_generator": (F.col("label") == "spoof") & F.col("generator").isNull(),
    }
    return df.withColumn("reason", first_reason(reasons))


def preconditions(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """check_name, n_rows: rows that break what planning relies on. expected: the class of each dataset."""
    doubled = lambda keys: F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).cast("bigint")
    named = reduce(lambda a, kv: a.when(F.col("dataset") == kv[0], F.lit(kv[1])), list(expected.items())[1:], F.when(F.col("dataset") == next(iter(expected)), F.lit(expected[next(iter(expected))])))
    count = lambda c: F.count(F.when(c, 1))
    row = df.agg(
        count(F.col("sample_id").isNull()).alias("null_id"), count(F.col("processed_file").isNotNull() | F.col("segment_start").isNotNull()).alias("processed_rows"),
        count(F.col("label").isNull() | ~F.col("label").isin("bonafide", "spoof")).alias("illegal_label"), count(named.isNotNull() & (F.col("label") != named)).alias("source_class_mismatch"),
    )
    flat = row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check_name"), F.col(c).alias("n_rows")) for c in row.columns))).alias("x")).select("x.*")
    twice = lambda name, d, keys: d.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(doubled(keys).alias("n_rows")).select(F.lit(name).alias("check_name"), "n_rows")
    return flat.unionByName(twice("duplicate_id", df, ["dataset", "sample_id"])).unionByName(twice("duplicate_file", df.where("source_file IS NOT NULL"), ["dataset", "source_file"]))


def split_overlap(df: DataFrame, fields: list[str], split: str = "split") -> DataFrame:
    """field, n_values: known values of each identity field that stand in more than one split; 0 where none does."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields)))
    flat = df.where(F.col(split).isNotNull()).select(F.col(split).alias("s"), cells.alias("x")).where("x.value IS NOT NULL")
    per = flat.groupBy("x.field", "x.value").agg((F.min("s") != F.max("s")).alias("crosses"))
    return per.groupBy("field").agg(F.count(F.when(F.col("crosses"), 1)).alias("n_values"))


def require_disjoint(df: DataFrame, fields: list[str], split: str = "split") -> None:
    """Refuses rows of which an identity stands in more than one split."""
    crossing = {r["field"]: r["n_values"] for r in split_overlap(df, fields, split).where("n_values > 0").collect()}
    if crossing:
        raise ValueError(f"identities in several splits: {crossing}")


@dataclass(frozen=True)
class Profile:
    """What a run asks of its partitions; a run on another corpus overrides what differs (dataclasses.replace)."""

    splits: tuple[str, ...] = ("train", "validation", "test")
    identities: tuple[str, ...] = ("id", "audio_sha256", "speaker")
    counts: tuple[tuple[str, int], ...] = ()
    minimum: int = 1
    notice: str = ""

    def check(self, df: DataFrame, split: str = "split", label: str = "label") -> DataFrame:
        """split, label, n of the partitions, after all that the profile asks has been found true."""
        out = df.groupBy(split, label).agg(F.count(F.lit(1)).alias("n"))
        held = {(r[split], r[label]): r["n"] for r in out.collect()}
        if {s for s, _ in held} - set(self.splits):
            raise ValueError(f"unknown splits: {sorted(map(str, {s for s, _ in held} - set(self.splits)))}")
        totals = {s: sum(n for (x, _), n in held.items() if x == s) for s in self.splits}
        if any(totals[s] != n for s, n in self.counts) or any(min((n for (x, _), n in held.items() if x == s), default=0) < self.minimum for s in self.splits):
            raise ValueError(f"counts differ from the profile: {held}")
        require_disjoint(df, [c for c in self.identities if c in df.columns], split)
        return out


def cell_counts(df: DataFrame, dims: list[str], levels: dict[str, list[str]], minimum: int, distinct: str) -> DataFrame:
    """All combinations of the levels with rows, distinct keys and whether they have enough; absent cells count 0."""
    spark = df.sparkSession
    grid = spark.createDataFrame(list(product(*(levels[d] for d in dims))), ", ".join(f"{d} string" for d in dims))
    held = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(distinct).alias("k"))
    return F.broadcast(grid).join(held, dims, "left").select(*dims, F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows"), F.coalesce("k", F.lit(0)).cast("bigint").alias("n_distinct")).withColumn("enough", F.col("n_rows") >= minimum)


def against_contract(df: DataFrame, key: str, contract: dict[str, int]) -> DataFrame:
    """key, expected, found, agrees: counts against a contract, both ways."""
    wanted = df.sparkSession.createDataFrame(list(contract.items()), f"{key} string, expected bigint")
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    return wanted.join(found, key, "full").select(key, F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"), F.coalesce("found", F.lit(0)).cast("bigint").alias("found")).withColumn("agrees", F.col("expected") == F.col("found"))


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """side, n: keys of one side only, and repeated ones; all 0 if the sides name the same keys once."""
    a, b = left.select(key).where(F.col(key).isNotNull()), right.select(key).where(F.col(key).isNotNull())
    n = lambda d, side: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    again = lambda d: d.groupBy(key).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return n(a.join(b, key, "left_anti").distinct(), "left_only").unionByName(n(b.join(a, key, "left_anti").distinct(), "right_only")).unionByName(n(again(a), "left_repeated")).unionByName(n(again(b), "right_repeated"))


def conflict_free(df: DataFrame, key: str, refs: Column, split: str = "split") -> DataFrame:
    """df without the rows that touch a reference standing in more than one split."""
    flat = df.select(F.col(key).alias("__key"), F.col(split).alias("__split"), F.explode(refs).alias("__ref"))
    shared = flat.groupBy("__ref").agg((F.min("__split") != F.max("__split")).alias("c")).where("c").select("__ref")
    touched = flat.join(shared, "__ref", "left_semi").select("__key").distinct()
    return df.join(touched, F.col(key) == F.col("__key"), "left_anti")


def label_violations(df: DataFrame) -> DataFrame:
    """Rows whose label is none of the legal ones; a null label passes."""
    return df.where(~F.col("label").isin("bonafide", "spoof"))
