"""Results per key where a few keys hold most rows.

A frequent-items sketch (one mergeable aggregate, map-side combined) finds the heavy keys. Their rows meet the short list of
heavy keys in a broadcast join and are aggregated over salts; all other keys take an ordinary shuffle; the two are united.
The broadcast list has at most 2 / share keys whatever the table's size.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonoplan.functions.text import is_missing


def heavy_keys(df: DataFrame, columns: list[str], share: float) -> tuple[dict[str, list], int]:
    """Keys (null included) of each column that may hold at least `share` of the rows, and the number of rows.

    The sketch never underestimates a key that it reports and its error is below share / 16, so that no key with the full
    share is left out; at most 2 / share keys come back for each column."""
    tracked, k = 1 << max(10, math.ceil(math.log2(64 / share))), math.ceil(2 / share)
    found: Row = df.agg(
        F.count(F.lit(1)).alias("__rows"),
        *(F.expr(f"approx_top_k(`{c}`, {k}, {tracked})").alias(f"__{i}") for i, c in enumerate(columns)),
    ).first()
    rows = found["__rows"]
    return {c: [x["item"] for x in found[f"__{i}"] or [] if x["count"] >= share * rows] for i, c in enumerate(columns)}, rows


def aggregate_by_key(df: DataFrame, key: str, sums: dict[str, Column], distinct: tuple[str, Column] | None = None, share: float = 0.01, salts: int = 32, heavy: list | None = None) -> DataFrame:
    """One row per value of `key` (null is a value): the sums, and the number of distinct non-null values of one expression.

    heavy: the heavy keys, where they are known already.
    Salts follow the counted expression, so that partial distinct counts of a heavy key add up. An empty table gives no rows.
    Other columns of df don't matter, whatever their names."""
    if heavy is None:
        heavy = heavy_keys(df.select(key), [key], share)[0][key]
    kind = df.schema[key].dataType
    listed = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in heavy], T.StructType([T.StructField("__heavy", kind)])))
    narrow = df.select(F.col(key).alias("__key"), (distinct[1] if distinct else F.lit(0)).alias("__unit"), F.monotonically_increasing_id().alias("__row"), *(e.alias(n) for n, e in sums.items()))
    salt = F.pmod(F.xxhash64("__unit") if distinct else F.col("__row"), F.lit(salts))
    measures = [F.sum(n).alias(n) for n in sums] + ([F.countDistinct("__unit").alias(distinct[0])] if distinct else [])
    merged = [F.sum(n).alias(n) for n in [*sums, *([distinct[0]] if distinct else [])]]
    match = F.col("__key").eqNullSafe(F.col("__heavy"))
    of_heavy = narrow.join(listed, match, "inner").groupBy("__key", salt.alias("__salt")).agg(*measures).groupBy("__key").agg(*merged)
    of_rest = narrow.join(listed, match, "left_anti").groupBy("__key").agg(*measures)
    return of_heavy.unionByName(of_rest).withColumnRenamed("__key", key)


def frequent_values(df: DataFrame, columns: list[str], share: float) -> DataFrame:
    """field_name, key_value, n_rows of each non-missing value, as stored, that stands in at least `share` of all rows.

    All keys are counted, the sketch's heavy ones over salts and the others by an ordinary shuffle, so that the result doesn't rest on the sketch."""
    narrow = df.select(*(F.col(c).cast("string").alias(c) for c in columns))
    heavy, rows = heavy_keys(narrow, columns, share)
    per = [aggregate_by_key(narrow, c, {"n_rows": F.lit(1)}, heavy=heavy[c]).select(F.lit(c).alias("field_name"), F.col(c).alias("key_value"), "n_rows") for c in columns]
    return reduce(DataFrame.unionByName, per).where((F.col("n_rows") >= F.lit(share) * F.lit(rows)) & ~is_missing(F.col("key_value")))
