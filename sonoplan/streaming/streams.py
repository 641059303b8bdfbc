"""Structured Streaming forms of the resumable scans: deduplication, quotas, budgets, idempotent sinks, windowed scores.

Offsets live in the query's checkpoint, so a stopped run goes on where it ended; sinks are idempotent, so a repeated batch
adds nothing.
"""

from __future__ import annotations

import glob
import json
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.session import delete, exists, read_text, shared_folder, write_text

#: Contract of a sink's folder, beside its data.
CONTRACT = "_contract.json"


def file_stream(spark: SparkSession, folder: str, name: str, per_trigger: int = 8) -> DataFrame:
    """A Parquet table as a stream, with the schema of its files."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    pattern = path if glob.glob(f"{path}/*.parquet") else f"{path}*"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(pattern)


def _work(spark: SparkSession) -> str:
    base = shared_folder(spark)
    local = base.removeprefix("file://")
    if base.startswith("file://") or base.startswith("/"):
        return f"file://{tempfile.mkdtemp(prefix='stream-', dir=_made(local))}"
    return f"{base}/stream-{uuid.uuid4().hex}"


def _made(path: str) -> str:
    Path(path).mkdir(parents=True, exist_ok=True)
    return path


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, through the stream to a table in the shared folder. Rewritten whole in complete mode."""
    spark = stream.sparkSession
    work = _work(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{work}/out").outputMode("append").start()
    elif mode == "complete":
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{work}/out")).start()
    else:
        raise ValueError(f"no mode {mode}")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def folded(stream: DataFrame, fold: Callable[[DataFrame | None, DataFrame], DataFrame], schema: str) -> DataFrame:
    """The state after all batches: fold(state before or None, batch) gives the state after each, kept as a table in the shared folder.

    A batch that is run again writes the same table from the same state before it. The two latest states are kept."""
    spark = stream.sparkSession
    work, last = _work(spark), -1

    def step(batch: DataFrame, number: int) -> None:
        nonlocal last
        before = spark.read.schema(schema).parquet(f"{work}/state-{number - 1}") if number else None
        fold(before, batch).write.mode("overwrite").parquet(f"{work}/state-{number}")
        if number > 1:
            delete(spark, f"{work}/state-{number - 2}")
        last = number

    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{work}/state-{last}") if last >= 0 else spark.createDataFrame([], schema)


def distinct_stream(stream: DataFrame, keys: list[str], time: str | None = None, late: str = "1 day") -> DataFrame:
    """First row of each key; with a time column the state of old keys is dropped."""
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def quota_stream(stream: DataFrame, key: str, value: str, most: int) -> DataFrame:
    """key, value: the `most` least values of each key of all that has arrived, in whatever batches it came. A hot key is cut to its least values in each of many salts first."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def least(rows: DataFrame, *by: str) -> DataFrame:
        return rows.withColumn("r", F.row_number().over(W.partitionBy("key", *by).orderBy("value"))).where(F.col("r") <= most).drop("r")

    def fold(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        own = least(batch.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(64))), "salt").drop("salt")
        return least(own if before is None else own.unionByName(before))

    narrow = stream.select(F.col(key).alias("key"), F.col(value).alias("value")).where("value IS NOT NULL")
    return folded(narrow, fold, f"key {kinds[key]}, value {kinds[value]}")


def budget_stream(stream: DataFrame, key: str, amount: str, order: str, most: float) -> DataFrame:
    """key, n_taken, spent, refused: amounts are reserved in the order of arrival (batch, then `order`), and one that would exceed the key's budget is refused; later, smaller ones may fit.

    Missing and negative amounts count as 0. Room only shrinks, so what is above the room that a batch finds is refused without being ordered;
    the rest of a key is one sequence, walked in sorted portions of bounded size."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"key {kinds[key]}, n_taken bigint, spent double, refused bigint"

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for b in batches:
            for k, amount_, spent in zip(b["key"], b["amount"], b["spent"]):
                if now is None or not (k == now[0] or k is None and now[0] is None):
                    if now is not None:
                        yield pd.DataFrame([now], columns=["key", "n_taken", "spent", "refused"])
                    now = [k, 0, spent, 0]
                fits = now[2] + amount_ <= most
                now[1], now[2], now[3] = now[1] + fits, now[2] + amount_ if fits else now[2], now[3] + (not fits)
        if now is not None:
            yield pd.DataFrame([now], columns=["key", "n_taken", "spent", "refused"])

    def fold(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        state = batch.sparkSession.createDataFrame([], schema) if before is None else before
        room = batch.join(state.select(F.col("key").alias("k"), "spent"), F.col("key").eqNullSafe(F.col("k")), "left").select("key", "amount", "place", F.coalesce("spent", F.lit(0.0)).alias("spent"))
        fits = room["spent"] + room["amount"] <= most
        none = F.lit(0).cast("bigint")
        refused = room.where(~fits).groupBy("key").agg(F.count(F.lit(1)).alias("refused")).select("key", none.alias("n_taken"), F.lit(None).cast("double").alias("spent"), "refused")
        walked = room.where(fits).repartition("key").sortWithinPartitions("key", "place").select("key", "amount", "spent").mapInPandas(walk, schema)
        parts = state.unionByName(refused).unionByName(walked)
        return parts.groupBy("key").agg(F.sum("n_taken").alias("n_taken"), F.coalesce(F.max("spent"), F.lit(0.0)).alias("spent"), F.sum("refused").alias("refused"))

    value = F.when(F.isnan(amount) | F.col(amount).isNull() | (F.col(amount) < 0), 0.0).otherwise(F.col(amount).cast("double"))
    return folded(stream.select(F.col(key).alias("key"), value.alias("amount"), F.col(order).alias("place")), fold, schema)


def isolated(stream: DataFrame, good: Column, schema: str, columns: list[Column]) -> tuple[DataFrame, DataFrame]:
    """The rows for which `good` holds, as columns with this schema, and the others as they came, both as tables: a bad record stops nothing."""
    spark = stream.sparkSession
    work = _work(spark)
    fine = F.coalesce(good, F.lit(False))

    def step(batch: DataFrame, number: int) -> None:
        batch.where(fine).select(*columns).write.mode("overwrite").parquet(f"{work}/good/batch={number}")
        batch.where(~fine).write.mode("overwrite").parquet(f"{work}/bad/batch={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    read = lambda kind, s: spark.read.schema(s).parquet(f"{work}/{kind}/batch=*") if exists(spark, f"{work}/{kind}") else spark.createDataFrame([], s)
    return read("good", schema), read("bad", stream.schema)


def windowed_mean(stream: DataFrame, time: str, value: str, window: str, by: list[str], late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *by, "n", "mean_value")


def check_contract(spark: SparkSession, folder: str, contract: dict) -> None:
    """Notes the contract of a new sink; refuses to go on with another one."""
    path, said = f"{folder}/{CONTRACT}", json.dumps(contract, sort_keys=True)
    if exists(spark, path):
        if read_text(spark, path) != said:
            raise ValueError("the sink was begun under another contract")
    else:
        write_text(spark, path, said)


def append_new(batch: DataFrame, folder: str, key: str, digest: str | None = None) -> None:
    """For foreachBatch: adds the rows whose key the sink doesn't hold; a repeated batch adds nothing.

    digest: a column that must be the same wherever a key comes again; another one is an error."""
    spark = batch.sparkSession
    fresh = batch.dropDuplicates([key])
    target = f"{folder}/data"
    if digest is not None:
        known = batch.select(key, digest)
        if exists(spark, target):
            known = known.unionByName(spark.read.parquet(target).join(batch.select(key).distinct(), key, "left_semi").select(key, digest))
        if not known.groupBy(key).agg((F.min(digest) != F.max(digest)).alias("c")).where("c").isEmpty():
            raise ValueError(f"a {key} has come with another {digest}")
    if exists(spark, target):
        fresh = fresh.join(spark.read.parquet(target).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(target)


def resumable_copy(stream: DataFrame, folder: str, key: str, contract: dict, digest: str | None = None) -> int:
    """Streams rows into an idempotent sink and returns the batches run; a run after a finished one reads nothing."""
    check_contract(stream.sparkSession, folder, contract)
    query = stream.writeStream.foreachBatch(lambda df, _: append_new(df, folder, key, digest)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len([p for p in query.recentProgress if p["numInputRows"]])
