"""A sample whose shares follow target proportions.

The category moments (distinct records of each cell) are aggregated over the cluster; on these few numbers Newton iterations
on the dual of exponential tilting find the size drawn from each cell, so that the shares by language, label and generator
hold as far as floors and supply allow: what a scarce cell can't give is taken from other cells of the same categories. With
the resulting probabilities records are drawn by the pivotal method, in blocks of bounded size that only the records' ids
decide, and then among the one open record that each block leaves of a cell, so that each cell's size comes out exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoplan.functions.text import is_missing, tidy
from sonoplan.session import durable

TINY = 1e-9
#: Categories whose shares are held.
MARGINS = ("language", "label", "generator")
#: Records of a cell that one block of the draw has, about.
BLOCK = 50_000
#: Cells that come to the driver and to each task at most; more are refused.
MOST_CELLS = 10_000
#: How soft the margins are: see tilt.
SOFT = 0.01


def members(records: DataFrame, cells: DataFrame) -> DataFrame:
    """sample_id, cells (sorted, distinct): the cells of each record that has one. The cells are a short list of fixed length."""
    folded = lambda c: F.lower(tidy(F.col(c)))
    kind = F.when(~is_missing(F.col("generator")), folded("generator"))
    wanted = F.broadcast(cells.select("cell_id", folded("language").alias("l"), folded("label").alias("k"), kind.alias("g")))
    mine = records.where("sample_id IS NOT NULL").select("sample_id", folded("language").alias("rl"), folded("label").alias("rk"), kind.alias("rg"))
    met = mine.join(wanted, (F.col("rl") == F.col("l")) & (F.col("rk") == F.col("k")) & F.col("rg").eqNullSafe(F.col("g")))
    return met.groupBy("sample_id").agg(F.array_sort(F.collect_set("cell_id")).alias("cells"))


def tilt(supply: np.ndarray, share: np.ndarray, floor: np.ndarray, size: int, categories: list[np.ndarray], rounds: int = 200) -> np.ndarray:
    """Rows to draw of each cell (not whole): floor..supply, in all `size` or the whole supply.

    categories: number of the category of each cell, for each margin whose shares are to hold. A category that can't be met (with the
    others) misses its target by SOFT of it for each e-fold by which its cells are tilted, so that it doesn't spoil single cells without
    end. Newton's steps go down the convex dual, whose gradient is what the margins miss and whose Hessian the moments of the cells that
    are free to move; `rounds` is far more than they take. With enough supply the targets themselves come out."""
    low, high = np.minimum(floor, supply).astype(float), supply.astype(float)
    wanted = share * size
    if high.sum() <= size:
        return high
    if low.sum() >= size:  # floors alone are too many: share the size out among them
        return low * size / low.sum()
    live = high > 0
    base, low_, high_ = np.maximum(wanted, TINY)[live], low[live], high[live]
    marks = np.concatenate([(c[:, None] == np.unique(c)[None, :]).astype(float) for c in [np.zeros(len(supply), int), *categories]], 1)
    goal = np.clip(marks.T @ wanted, marks.T @ low, marks.T @ high)
    goal[0] = size
    marks = marks[live]
    soft = SOFT * np.maximum(goal, 1.0)
    soft[0] = TINY
    bottom, top = np.log(np.maximum(low_, TINY * TINY) / base), np.log(high_ / base)
    drawn = lambda x: np.clip(base * np.exp(np.clip(x, bottom, top)), low_, high_)
    # the integral of drawn: exponential between the bounds, straight beyond them
    height = lambda x: (drawn(x) + low_ * np.minimum(x - bottom, 0) + high_ * np.maximum(x - top, 0)).sum()
    value = lambda d: height(marks @ d) - goal @ d + (soft * d * d).sum() / 2
    dual = np.zeros(marks.shape[1])
    for _ in range(rounds):
        x = marks @ dual
        n = drawn(x)
        gradient = marks.T @ n - goal + soft * dual
        if np.abs(gradient).max() < 1e-7 * size:
            break
        free = n * ((x > bottom) & (x < top))
        step, scale, now = np.linalg.solve((marks * free[:, None]).T @ marks + np.diag(soft + TINY), gradient), 1.0, value(dual)
        step /= max(1.0, np.abs(marks @ step).max() / 4)
        while scale > 1e-6 and value(dual - scale * step) > now - 1e-4 * scale * (gradient @ step):
            scale /= 2
        if scale <= 1e-6:
            break
        dual -= scale * step
    x = marks @ dual
    # one factor for all brings the total to the size
    a, b = -40.0, 40.0
    for _ in range(200):
        mid = (a + b) / 2
        a, b = (mid, b) if drawn(x + mid).sum() < size else (a, mid)
    out = np.zeros(len(supply))
    out[live] = drawn(x + b)
    return out


def whole(n: np.ndarray, supply: np.ndarray) -> np.ndarray:
    """Whole numbers with the same total, by largest remainders."""
    total, out = int(round(n.sum())), np.floor(n + TINY).astype(np.int64)
    order = np.argsort(-(n - out), kind="stable")
    for i in [*order, *order]:
        if out.sum() >= total:
            break
        out[i] += out[i] < supply[i]
    return out


def plan(records: DataFrame, cells: DataFrame, margins: tuple[str, ...] = MARGINS) -> tuple[pd.DataFrame, DataFrame]:
    """The cells with what they hold, want and give, and the members. Only two numbers per cell come to the driver.

    A record of several cells is available to each of them, but may be drawn for the least of them only (n_own)."""
    if cells.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    held = durable(members(records, cells))
    counts = held.select(F.posexplode("cells").alias("at", "cell_id")).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("at") == 0, 1)).alias("own")).collect()
    out = cells.toPandas().sort_values("cell_id", ignore_index=True)
    for name, of in (("n_available", "n"), ("n_own", "own")):
        out[name] = out["cell_id"].map({r["cell_id"]: r[of] for r in counts}).fillna(0).astype("int64")
    share, floor = out["target_share"].fillna(0).to_numpy(float), out["min_rows"].fillna(0).to_numpy(float)
    size = int(out["sample_size"].max()) if len(out) else 0
    out["n_wanted"] = np.maximum(floor, np.floor(share * size + 0.5)).astype("int64")
    coded = [pd.factorize(out[m].fillna(""))[0] for m in margins]
    supply = out["n_own"].to_numpy()
    out["n_drawn"] = whole(tilt(supply, share, floor, size, coded), supply) if len(out) else np.zeros(0, np.int64)
    out["n_missing"] = np.maximum(0, out["n_wanted"] - out["n_available"])
    return out, held


def report(spark, planned: pd.DataFrame) -> DataFrame:
    """cell_id, n_available, n_wanted, n_drawn, n_missing, share_drawn: one row per cell."""
    total = max(1, int(planned["n_drawn"].sum()))
    rows = [(int(r.cell_id), int(r.n_available), int(r.n_wanted), int(r.n_drawn), int(r.n_missing), r.n_drawn / total) for r in planned.itertuples()]
    return spark.createDataFrame(rows, "cell_id int, n_available bigint, n_wanted bigint, n_drawn bigint, n_missing bigint, share_drawn double")


def margin_report(spark, planned: pd.DataFrame, margins: tuple[str, ...] = MARGINS) -> DataFrame:
    """margin, category, n_target, n_supply, n_drawn, n_gap: what each category of each margin wants of the sample, can give and gives. The generator of genuine records is null."""
    rows = []
    for m in margins:
        for category, part in planned.groupby(planned[m].fillna(""), sort=True):
            wanted = float((part["target_share"].fillna(0) * part["sample_size"]).sum())
            rows.append((m, category or None, wanted, int(part["n_own"].sum()), int(part["n_drawn"].sum()), float(part["n_drawn"].sum() - wanted)))
    return spark.createDataFrame(rows, "margin string, category string, n_target double, n_supply bigint, n_drawn bigint, n_gap double")


def pivotal(chance: list[float], luck: np.ndarray) -> list[float]:
    """Duels between neighbours until each but the last open one is 0 or 1; totals and inclusion probabilities are kept."""
    out, open_ = list(chance), -1
    for i, (p, u) in enumerate(zip(chance, luck.tolist())):
        if p <= TINY or p >= 1 - TINY:
            out[i] = float(p > 0.5)
            continue
        if open_ < 0:
            open_ = i
            continue
        q = out[open_]
        total = p + q
        if total < 1 - TINY:
            winner, loser = (open_, i) if u * total < q else (i, open_)
            out[winner], out[loser], open_ = total, 0.0, winner
        else:
            winner, loser = (open_, i) if u * (2 - total) < 1 - p else (i, open_)
            rest = total - 1
            out[winner], out[loser], open_ = 1.0, rest, loser
            if rest <= TINY:
                out[loser], open_ = 0.0, -1
    return out


def pivotal_equal(n: int, p: float, luck) -> tuple[list[int], int, float]:
    """The pivotal method for n records of the same chance: those drawn, the one left open (-1 if none), and its chance.

    As long as chances add up to less than one, who is left of a run of records is decided by one number for the whole run."""
    if p <= TINY or p >= 1 - TINY:
        return (list(range(n)) if p > 0.5 else []), -1, 0.0
    drawn, open_, q, i = [], -1, 0.0, 0
    while i < n:
        if open_ < 0:
            open_, q, i = i, p, i + 1
            continue
        m = min(n - i, int((1 - TINY - q) / p))
        if m > 0:
            q, before = q + m * p, q
            u = luck() * q
            if u >= before:
                open_ = i + min(m - 1, int((u - before) / p))
            i += m
            continue
        total = q + p
        if luck() * (2 - total) < 1 - p:
            drawn.append(open_)
            open_ = i
        else:
            drawn.append(i)
        q, i = total - 1, i + 1
        if q <= TINY:
            open_, q = -1, 0.0
    return drawn, open_, q


def draw(planned: pd.DataFrame, held: DataFrame, seed: int = 42) -> DataFrame:
    """sample_id, cell_id, probability of the drawn records, each once. A record of several cells may be drawn for the least of them only.

    The same records and seed give the same sample, whatever partitions and batches they come in."""
    spark = held.sparkSession
    chance = {int(r.cell_id): r.n_drawn / r.n_own for r in planned.itertuples() if r.n_drawn}
    if not chance:
        return spark.createDataFrame([], "sample_id string, cell_id int, probability double")
    blocks = F.create_map(*(F.lit(int(x)) for r in planned.itertuples() for x in (r.cell_id, max(1, r.n_own // BLOCK))))
    mine = held.select("sample_id", F.col("cells")[0].cast("int").alias("cell_id")).where(F.col("cell_id").isin(*chance))
    placed = mine.withColumn("h", F.xxhash64("sample_id")).withColumn("block", F.pmod("h", F.element_at(blocks, F.col("cell_id"))).cast("int"))
    shape = "cell_id int, sample_id string, block int, state double"

    def first(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["h", "sample_id"], ignore_index=True)
        cell, block = int(group["cell_id"].iloc[0]), int(group["block"].iloc[0])
        numbers = np.random.default_rng([seed, cell, block]).random(2 * len(group) + 2)
        drawn, open_, rest = pivotal_equal(len(group), chance[cell], iter(numbers.tolist()).__next__)
        out = group.loc[[*drawn, *([open_] if open_ >= 0 else [])], ["cell_id", "sample_id", "block"]]
        return out.assign(state=[1.0] * len(drawn) + ([rest] if open_ >= 0 else []))

    settled = durable(placed.groupBy("cell_id", "block").applyInPandas(first, shape))

    def last(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "sample_id"], ignore_index=True)
        luck = np.random.default_rng([seed, int(group["cell_id"].iloc[0])]).random(len(group))
        done = group.assign(state=pivotal(group["state"].tolist(), luck))
        return done[done["state"] > 0.5]

    # at most one open record per block and cell
    closing = settled.where("state < 1").groupBy("cell_id").applyInPandas(last, shape)
    probability = F.element_at(F.create_map(*(F.lit(x) for c, p in chance.items() for x in (c, float(p)))), F.col("cell_id"))
    return settled.where("state = 1").unionByName(closing).select("sample_id", "cell_id", probability.alias("probability"))
