"""Splits that keep related records together.

Records are related by speaker and by source file, directly or through others. Rows of one record are gathered first, so that a
record stored with several speakers or files relates them too. Speakers that share a file are joined to components; only files
with more than one speaker make edges, so that the graph stays far smaller than the table. Components with the same numbers of
records of each label form a bundle. The bundles' components flow to the splits at the cost of what the splits' quotas of each
label are missed by: an exact allocation where components are few; else the cheapest augmentations, large components first, and
then cycles of up to three arcs (moves of components between splits, of any bundles) cancelled as long as that lowers the cost.
Whole numbers of components flow, given to members by the order of a hash.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.functions.text import file_key, speaker_key, tidy
from sonoplan.operators.graph import connected_components
from sonoplan.operators.skew import heavy_keys
from sonoplan.session import durable

#: Rows up to which a map of speakers or components is broadcast; beyond that it is joined by shuffle, keys with HOT of all rows over salts.
BROADCAST_ROWS, HOT, SALTS = 100_000, 0.005, 32
#: Bundles whose moves are held against all others at once, for the driver's memory; no result depends on it.
MOST_BUNDLES = 5_000
BUCKETS = 1024
#: Components of a bundle that one move takes at most; moves up to which threes of them are tried.
AT_ONCE, THREES = 4, 300


def _mapped(rows: DataFrame, mapping: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a mapping of one row per key: by broadcast where that is short, else by shuffle with hot keys over salts."""
    kept = durable(mapping)
    if kept.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(kept), key, how)
    hot = [x for x in heavy_keys(rows.select(key), [key], HOT)[0][key] if x is not None]
    is_hot = F.col(key).isin(*hot)
    salted = rows.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64("sample_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = kept.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, [key, "__salt"], how).drop("__salt")


def grouped(records: DataFrame) -> DataFrame:
    """sample_id, component, splits, label of each distinct record; splits: all that its rows name, label: the least one.

    A record without speaker and file is a group of its own; rows without sample_id are left out."""
    rows = records.where("sample_id IS NOT NULL").select(
        "sample_id", speaker_key(F.col("speaker_id")).alias("speaker"), file_key(F.col("source_file")).alias("file"), F.lower(tidy(F.col("split"))).alias("split"), F.lower(tidy(F.col("label"))).alias("label"),
    )
    several = lambda c: F.array_sort(F.collect_set(c))
    gathered = rows.groupBy("sample_id").agg(several("speaker").alias("speakers"), several("file").alias("files"), several("split").alias("splits"), F.get(several("label"), F.lit(0)).alias("label"))
    # a speaker's node stands for a record that has one, the first file's for a record of several files without one
    node = F.coalesce(F.concat(F.lit("s "), F.get("speakers", F.lit(0))), F.when(F.size("files") > 1, F.concat(F.lit("f "), F.get("files", F.lit(0)))))
    mine = durable(gathered.select("sample_id", node.alias("node"), "speakers", "files", "splits", "label"))
    of_file = mine.where("node IS NOT NULL").select(F.explode("files").alias("file"), "node").groupBy("file", "node").agg(F.lit(1).alias("one")).drop("one")
    of_file = durable(of_file)
    least = of_file.groupBy("file").agg(F.min("node").alias("owner"), F.count(F.lit(1)).alias("k"))
    edges = of_file.join(least.where("k > 1"), "file").select(F.col("node").alias("a"), F.col("owner").alias("b"))
    # the same record under several speakers
    edges = edges.unionByName(mine.where("size(speakers) > 1").select(F.explode("speakers").alias("a"), "node").select(F.concat(F.lit("s "), "a").alias("a"), F.col("node").alias("b")).distinct())
    roots = connected_components(edges).where("node <> root")
    # records without a speaker follow their file
    named = mine.where("node IS NOT NULL").select("sample_id", "node", "splits", "label")
    nameless = mine.where("node IS NULL").select("sample_id", F.get("files", F.lit(0)).alias("file"), "splits", "label")
    own = F.coalesce("owner", F.concat(F.lit("f "), "file"), F.concat(F.lit("r "), "sample_id"))
    followed = nameless.join(least.select("file", "owner"), "file", "left").select("sample_id", own.alias("node"), "splits", "label")
    both = _mapped(named.unionByName(followed), roots, "node", "left")
    return both.select("sample_id", F.coalesce("root", "node").alias("component"), "splits", "label")


def broken(rows: DataFrame) -> DataFrame:
    """sample_id of the records whose group stands in more than one of train, dev and test."""
    rows = durable(rows)
    has = lambda s: F.max(F.array_contains("splits", s).cast("int"))
    mixed = rows.groupBy("component").agg((has("train") + has("dev") + has("test")).alias("k")).where("k > 1").select("component")
    return _mapped(rows.select("sample_id", "component"), mixed, "component", "left_semi").select("sample_id")


def _exact(bundles: list[tuple[int, int, int]], quota: list[list[float]], most: int = 200_000) -> list[list[int]] | None:
    """Components of each bundle for each split that miss the quotas by the least, over all loads that the splits can have; None if these are too many to list."""
    parts = lambda n, k: [(n,)] if k == 1 else [(x, *y) for x in range(n + 1) for y in parts(n - x, k - 1)]
    states: dict[tuple, tuple] = {(0,) * (2 * len(quota)): ()}
    for a, b, n in bundles:
        if len(states) * comb(n + len(quota) - 1, len(quota) - 1) > most:
            return None
        found = {}
        for load, way in states.items():
            for p in parts(n, len(quota)):
                found.setdefault(tuple(x + m * y for x, m, y in zip(load, (m for m in p for _ in (0, 1)), (a, b) * len(quota))), (way, p))
        states = found
    flat = [x for q in quota for x in q]
    way, flow = states[min(states, key=lambda load: (sum(abs(x - q) for x, q in zip(load, flat)), load))], []
    while way:
        way, p = way
        flow.append(list(p))
    return flow[::-1]


class _Moves:
    """The moves of one to AT_ONCE components of a bundle out of a split, ordered by what they take of either label."""

    def __init__(self, sizes: np.ndarray, held: np.ndarray):
        at = [np.flatnonzero((held >= n) & (sizes.sum(axis=1) > 0)) for n in range(1, AT_ONCE + 1)]
        bundle, number = np.concatenate(at), np.repeat(np.arange(1, AT_ONCE + 1), [len(x) for x in at])
        taken = sizes[bundle] * number[:, None]
        order = np.lexsort((number, bundle, taken[:, 1], taken[:, 0]))
        self.bundle, self.number, self.taken = bundle[order], number[order], taken[order]
        self.columns, self.column = np.unique(self.taken[:, 0], return_inverse=True)
        self.span = int(self.taken[:, 1].max(initial=0)) + 2
        self.keys = self.column * self.span + self.taken[:, 1]


def _best_last(out: list[_Moves], held: np.ndarray, excess: np.ndarray, first: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """The move (bundle, from, to, number) after which the quotas are missed by the least, if the first one is made before; excess: after the first."""
    best = None
    for j, moves in enumerate(out):
        there = ~((j == first[1]) & (moves.bundle == first[0]) & (held[moves.bundle, j] < moves.number + first[3]))
        for h in range(len(out)):
            if j != h and there.any():
                rest = np.abs(np.delete(excess, [j, h], axis=0)).sum()
                cost = np.where(there, rest + np.abs(excess[j] - moves.taken).sum(axis=1) + np.abs(excess[h] + moves.taken).sum(axis=1), np.inf)
                k = int(cost.argmin())
                if best is None or cost[k] < best[0]:
                    best = float(cost[k]), (int(moves.bundle[k]), j, h, int(moves.number[k]))
    return best[1]


def _pair(sizes: np.ndarray, held: np.ndarray, excess: np.ndarray, goal: float) -> list[tuple[int, int, int, int]]:
    """The first move (by bundle, from, to, number) that some other completes to miss the quotas by no more than the goal, and the best such other; empty if there is none.

    What a second move misses grows with its distance from a rectangle, so that it is looked up among the ordered moves, column by column:
    all pairs count, though few are looked at."""
    splits = range(excess.shape[0])
    out = [_Moves(sizes, held[:, j]) for j in splits]
    ways = [(j, h) for j in splits for h in splits if j != h]
    for start in range(0, len(sizes), MOST_BUNDLES):
        block = slice(start, start + MOST_BUNDLES)
        found = None
        for j, h in ways:
            at = [start + np.flatnonzero((held[block, j] >= n) & (sizes[block].sum(axis=1) > 0)) for n in range(1, AT_ONCE + 1)]
            bundle, number = np.concatenate(at), np.repeat(np.arange(1, AT_ONCE + 1), [len(x) for x in at])
            taken = sizes[bundle] * number[:, None]
            base = np.repeat(excess[None], len(bundle), axis=0)
            base[:, j] -= taken
            base[:, h] += taken
            for u, v in ways:
                moves = out[u]
                give, get = base[:, u], base[:, v]
                rest = np.abs(np.delete(base, [u, v], axis=1)).sum(axis=(1, 2))
                slack = (goal - rest - np.abs(give + get).sum(axis=1)) / 2
                low, high = np.minimum(give, -get), np.maximum(give, -get)
                column = np.searchsorted(moves.columns, low[:, 0] - slack)
                end = np.searchsorted(moves.columns, high[:, 0] + slack, "right")
                left = np.flatnonzero(slack >= 0)
                while len(left := left[column[left] < end[left]]):
                    if found:
                        left = left[bundle[left] <= found[0]]
                    c = moves.columns[column[left]]
                    reach = slack[left] - np.maximum(0, np.maximum(low[left, 0] - c, c - high[left, 0]))
                    key = column[left] * moves.span + np.clip(np.ceil(low[left, 1] - reach), 0, moves.span - 1).astype(np.int64)
                    place = np.searchsorted(moves.keys, key)
                    hit = np.zeros(len(left), dtype=bool)
                    # of the same split's moves, those of the same components don't count
                    for k in range(AT_ONCE + 1 if u == j else 1):
                        p = np.minimum(place + k, len(moves.keys) - 1)
                        inside = (place + k < len(moves.keys)) & (moves.column[p] == column[left]) & (moves.taken[p, 1] <= high[left, 1] + reach)
                        short = (moves.bundle[p] == bundle[left]) & (held[bundle[left], j] < number[left] + moves.number[p]) if u == j else False
                        hit |= inside & ~np.asarray(short)
                    for m in left[hit]:
                        way = (int(bundle[m]), j, h, int(number[m]))
                        found = min(found, way) if found else way
                    column[left] += 1
        if found:
            i, j, h, n = found
            after = excess.copy()
            after[j] -= n * sizes[i]
            after[h] += n * sizes[i]
            return [found, _best_last(out, held, after, found)]
    return []


def _exchange(bundles: list[tuple[int, int, int]], flow: list[list[int]], quota: list[list[float]]) -> None:
    """Changes flow by pairs of moves (one to four components of a bundle from a split to another, of any two bundles and splits), and threes of them
    where moves are few, as long as they lower what is missed; done when each split is within a record of its quotas, or no pair is left."""
    sizes, held = np.array([b[:2] for b in bundles], dtype=np.int64).reshape(-1, 2), np.array(flow, dtype=np.int64).reshape(-1, len(quota))
    excess = (held.T @ sizes).astype(float) - np.array(quota)

    def make(move: tuple[int, int, int, int], sign: int = 1) -> None:
        i, j, h, n = move
        held[i, j] -= sign * n
        held[i, h] += sign * n
        excess[j] -= sign * n * sizes[i]
        excess[h] += sign * n * sizes[i]

    def three(goal: float) -> bool:
        splits = range(len(quota))
        moves = [(i, j, h, n) for i in np.flatnonzero(sizes.sum(axis=1)) for j in splits for h in splits if j != h for n in range(1, min(AT_ONCE, held[i, j]) + 1)]
        for move in moves if len(moves) <= THREES else []:
            make(move)
            if pair := _pair(sizes, held, excess, goal):
                for x in pair:
                    make(x)
                return True
            make(move, -1)
        return False

    while np.abs(excess).max() >= 1:
        goal = np.abs(excess).sum() - 1e-6
        if pair := _pair(sizes, held, excess, goal):
            for move in pair:
                make(move)
        elif not three(goal):
            break
    flow[:] = held.tolist()


def allocate(bundles: list[tuple[int, int, int]], ratios: list[float]) -> list[list[int]]:
    """Components of each bundle (first label's records, other records, components) for each split.

    Where components are few, the allocation that misses the quotas by the least. Otherwise each bundle's components are dealt to the split
    that is then missed by the least, large components first; then components are moved between two splits, and exchanged between bundles and
    splits, as long as that lowers what is missed. That is no least cost, but near it where small components are many."""
    total = [sum(b[k] * b[2] for b in bundles) for k in (0, 1)]
    quota = [[r * t for t in total] for r in ratios]
    if (best := _exact(bundles, quota)) is not None:
        return best
    load = [[0.0, 0.0] for _ in ratios]
    miss = lambda j, a, b: abs(load[j][0] + a - quota[j][0]) + abs(load[j][1] + b - quota[j][1])
    flow = [[0] * len(ratios) for _ in bundles]
    order = sorted(range(len(bundles)), key=lambda i: (-(bundles[i][0] + bundles[i][1]), bundles[i]))

    def move(i: int, j: int, n: int) -> None:
        flow[i][j] += n
        for k in (0, 1):
            load[j][k] += n * bundles[i][k]

    for i in order:
        a, b, left = bundles[i]
        while left:
            costs = [(miss(j, a, b) - miss(j, 0, 0), -min((quota[j][k] - load[j][k]) / max(1.0, quota[j][k]) for k in (0, 1) if bundles[i][k]) if a + b else 0.0, j) for j in range(len(ratios))]
            j = min(costs)[2]
            room = min(((quota[j][k] - load[j][k]) / bundles[i][k] for k in (0, 1) if bundles[i][k]), default=0)
            # in slices, so that no split takes all components of a size
            n = max(1, min(left, int(room), -(-left // 8)))
            move(i, j, n)
            left -= n
    better = True
    while better:
        better = False
        for i in reversed(order):
            a, b, _n = bundles[i]
            if a + b == 0:
                continue
            for j in range(len(ratios)):
                for h in range(len(ratios)):
                    if j == h or not flow[i][j]:
                        continue
                    n = min(flow[i][j], max(1, int(min((max((load[j][k] - quota[j][k]), (quota[h][k] - load[h][k])) / bundles[i][k] for k in (0, 1) if bundles[i][k]), default=1))))
                    for m in {n, 1}:
                        gain = miss(j, 0, 0) + miss(h, 0, 0) - miss(j, -m * a, -m * b) - miss(h, m * a, m * b)
                        if gain > 1e-9 and flow[i][j] >= m:
                            move(i, j, -m)
                            move(i, h, m)
                            better = True
    _exchange(bundles, flow, quota)
    return flow


def split_groups(rows: DataFrame, ratios: dict[str, float], first_label: str = "bonafide") -> DataFrame:
    """sample_id, component, new_split of each distinct record; all records of a component have the same new_split. rows: as grouped() gives them.

    Only bundles come to the driver. Their number grows with the records by a power of two thirds at most: as many different pairs of numbers as
    occur need components that large (565,000 bundles, 24 bytes each, at 400 million records)."""
    spark = rows.sparkSession
    names = list(ratios)
    mine = durable(rows.select("sample_id", "component", "label"))
    is_first = F.when(F.col("label") == first_label, 1).otherwise(0)
    profile = ["n_first", "n_other"]
    sized = mine.groupBy("component").agg(F.sum(is_first).alias("n_first"), F.sum(1 - is_first).alias("n_other")).withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int"))
    components = durable(sized)
    found = components.groupBy(*profile).agg(F.count(F.lit(1)).alias("k")).orderBy(*profile).toArrow()
    flows = allocate(list(zip(*(c.to_pylist() for c in found.columns))), [ratios[n] for n in names])
    ends = np.cumsum(np.array(flows, dtype=np.int64).reshape(-1, len(names)), axis=1)
    bounds = spark.createDataFrame(pa.table({c: found[c] for c in profile} | {f"end_{j}": ends[:, j] for j in range(len(names))}))
    # a component's place in its bundle: those in earlier buckets, and its place in its own bucket
    held = components.groupBy(*profile, "bucket").agg(F.count(F.lit(1)).alias("k"))
    before = held.select(*profile, "bucket", F.coalesce(F.sum("k").over(W.partitionBy(*profile).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy(*profile, "bucket").orderBy(F.xxhash64("component"), "component"))
    # the ends go to the buckets first, so that a bundle of most components doesn't meet them in one task
    placed = components.withColumn("at", place).join(before.join(bounds, profile), [*profile, "bucket"])
    at = F.col("at") + F.col("before")
    new = F.coalesce(*(F.when(at <= F.col(f"end_{j}"), n) for j, n in enumerate(names)))
    return _mapped(mine.select("sample_id", "component"), placed.select("component", new.alias("new_split")), "component").select("sample_id", "component", "new_split")
