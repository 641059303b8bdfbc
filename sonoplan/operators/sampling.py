"""Quota, balanced and budgeted samples, deterministic by hash order."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from dataclasses import dataclass
from math import isfinite

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.session import durable


def hash_order(seed: str, *parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *parts), 256)


def quota(df: DataFrame, by: list[str], key: str, k: int | Column, seed: str) -> DataFrame:
    """The first k rows of each stratum in hash order. A stratum's rows are first cut to k in each of 64 salts, so that a stratum that holds a third of the table is ranked by many tasks."""
    h = hash_order(seed, key)
    limit = F.lit(k) if isinstance(k, int) else k
    salted = df.withColumn("__h", h).withColumn("__s", F.pmod(F.xxhash64(key), F.lit(64)))
    inner = salted.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__s").orderBy("__h", key))).where(F.col("__r") <= limit)
    return inner.withColumn("__r", F.row_number().over(W.partitionBy(*by).orderBy("__h", key))).where(F.col("__r") <= limit).drop("__h", "__s", "__r")


def balanced(df: DataFrame, split: str, cell: list[str], key: str, cap: int, seed: str, minimum: int = 0) -> DataFrame:
    """As many rows of each cell of a split as its smallest cell has, at most cap; fewer than `minimum` are an error."""
    cells = df.groupBy(split, *cell).agg(F.count(F.lit(1)).alias("__n"))
    if minimum and not cells.where(F.col("__n") < minimum).isEmpty():
        raise ValueError(f"a cell has fewer than {minimum} rows")
    least = cells.groupBy(split).agg(F.least(F.min("__n"), F.lit(cap)).alias("__k"))
    return quota(df.join(F.broadcast(least), split), [split, *cell], key, F.col("__k"), seed).drop("__k")


def attack_sample(df: DataFrame, attack: str, key: str, n: int, seed: str) -> DataFrame:
    """n rows of each attack and as many genuine rows (label 0) as of all attacks together, in hash order. Fewer than that of any is an error."""
    spoof = df.where((F.col("label") == 1) & F.col(attack).isNotNull())
    held = {r[attack]: r["k"] for r in spoof.groupBy(attack).agg(F.count(F.lit(1)).alias("k")).collect()}
    humans = df.where("label = 0")
    if not held or min(held.values()) < n or humans.limit(n * len(held)).count() < n * len(held):
        raise ValueError(f"fewer than {n} rows of an attack, or than {n * len(held)} genuine ones: {held}")
    return quota(spoof, [attack], key, n, seed).unionByName(quota(humans.withColumn("__all", F.lit(1)), ["__all"], key, n * len(held), seed).drop("__all"))


def class_seconds(total_hours: float | None = None, per_class: dict[str, float] | None = None) -> dict[str, float]:
    """Seconds wanted of each class: an equal part of the total where one is named, else each class's own hours."""
    hours = {k: total_hours / 2 for k in ("bonafide", "spoof")} if total_hours is not None else dict(per_class or {"bonafide": 1.0, "spoof": 1.0})
    if set(hours) != {"bonafide", "spoof"} or any(not isfinite(h) or h <= 0 for h in hours.values()):
        raise ValueError("finite, positive hours of exactly bonafide and spoof are needed")
    return {k: h * 3600 for k, h in hours.items()}


def inverse_weights(df: DataFrame, by: str) -> DataFrame:
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(by, "n", (F.lit(1.0) / F.col("n")).alias("weight"))


def class_draws(df: DataFrame, by: str, key: str, draws: int, seed: str) -> DataFrame:
    """draw_no, key: draws with replacement, each class equally likely, by hashed uniforms.

    Each draw picks a class, then a row of it by its rank in hash order. Classes are few; ranks within a class come from its rows' hash."""
    u = lambda c: F.conv(F.substring(F.sha2(c, 256), 1, 8), 16, 10).cast("bigint")
    n_classes = df.where(F.col(by).isNotNull()).agg(F.countDistinct(by)).first()[0]
    classes = df.where(F.col(by).isNotNull()).select(by).distinct().withColumn("__c", F.row_number().over(W.orderBy(by)) - 1)
    rows = df.where(F.col(by).isNotNull()).select(by, key, u(F.concat(F.lit(f"{seed}:r:"), F.col(key).cast("string"))).alias("__u"))
    n = rows.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    # a row's rank: rows of its class in earlier sectors of the hash, and its rank in its own sector
    sectored = rows.withColumn("__b", F.floor(F.col("__u") / F.lit(1 << 20)))
    held = sectored.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__k"))
    before = held.select(by, "__b", F.coalesce(F.sum("__k").over(W.partitionBy(by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    ranked = sectored.withColumn("__in", F.row_number().over(W.partitionBy(by, "__b").orderBy("__u", key))).join(before, [by, "__b"]).withColumn("__at", F.col("__in") + F.col("__before") - 1)
    picks = df.sparkSession.range(draws).withColumnRenamed("id", "draw_no").withColumn("__x", u(F.concat(F.lit(f"{seed}:d:"), F.col("draw_no").cast("string"))))
    m = F.lit(max(1, n_classes))
    with_class = picks.withColumn("__c", F.col("__x") % m).join(F.broadcast(classes), "__c").join(F.broadcast(n), by)
    return with_class.withColumn("__at", F.floor(F.col("__x") / m) % F.col("__n")).join(ranked, [by, "__at"]).select("draw_no", by, key)


@dataclass(frozen=True)
class Budget:
    seconds: dict[str, float]
    clips_per_speaker: int = 20
    speakers: int = 500
    speakers_per_cell: int = 2
    generator_share: float = 0.60
    tolerance: float = 0.05
    seed: str = "42"

    def __post_init__(self) -> None:
        if any(not isfinite(s) or s <= 0 for s in self.seconds.values()):
            raise ValueError("seconds must be finite and positive")
        if any(isinstance(x, bool) or not isinstance(x, int) or x < least for x, least in ((self.clips_per_speaker, 0), (self.speakers, 1), (self.speakers_per_cell, 1))):
            raise ValueError("limits must be whole numbers")
        if not 0 < self.generator_share <= 1 or not 0 <= self.tolerance < 1:
            raise ValueError("a generator's share lies in 0 to 1, the tolerance below 1")


def _choose(rows: pd.DataFrame, cells: dict[tuple[str, str], float], budget: Budget) -> tuple[pd.DataFrame, int]:
    """Greedy whole-clip choice over all cells, and the most chosen speakers that one (label, language, generator) has rows of.

    Clips of speakers not chosen yet lie in one queue per (cell, generator), those of chosen speakers in one per (cell, speaker, generator),
    best hash first; each pick looks at the heads only."""
    used, clips, of_cell, gen = {k: 0.0 for k in cells}, {}, {k: set() for k in cells}, {}
    cap = budget.seconds.get("spoof", 0.0) * budget.generator_share
    columns = ["dataset", "sample_id", "label", "language", "speaker_id", "generator", "duration"]
    if budget.clips_per_speaker < 1:
        return pd.DataFrame([], columns=columns), 0
    fresh_rows: dict[tuple, list] = {}
    of_speaker: dict[str, list] = {}
    for r in rows.itertuples(index=False):
        item = (r.rank, r.duration, r.dataset, r.sample_id, r.speaker_id, (r.label, r.language, r.generator))
        fresh_rows.setdefault(item[5], []).append(item)
        of_speaker.setdefault(r.speaker_id, []).append(item)
    # last is first: what doesn't fit now never fits later (amounts only grow), nor does a chosen speaker become a new one
    for q in fresh_rows.values():
        q.sort(key=lambda x: x[:4], reverse=True)
    own: dict[tuple, list] = {}
    chosen = []
    while True:
        best = None
        for queues, new in ((fresh_rows, True), (own, False)):
            if new and len(clips) >= budget.speakers:
                continue
            for g in list(queues):
                label, lang, maker = g[:3]
                cell, q = (label, lang), queues[g]
                full = not new and clips[g[3]] >= budget.clips_per_speaker
                while q and (full or (new and q[-1][4] in clips) or used[cell] + q[-1][1] > cells[cell] + 1e-9 or (label == "spoof" and gen.get(maker, 0.0) + q[-1][1] > cap + 1e-9)):
                    q.pop()
                if not q:
                    del queues[g]
                    continue
                who = q[-1][4]
                fresh = len(of_cell[cell]) < budget.speakers_per_cell and who not in of_cell[cell]
                score = (0 if fresh else 1, used[cell] / cells[cell] if cells[cell] else 1, clips.get(who, 0), gen.get(maker, 0.0) if label == "spoof" else 0, q[-1][0])
                if best is None or score < best[0]:
                    best = (score, queues, g)
        if best is None:
            break
        rank, seconds, dataset, sample, who, (label, lang, maker) = best[1][best[2]].pop()
        if who not in clips:
            for item in sorted(of_speaker[who], key=lambda x: x[:4], reverse=True):
                if item[2:4] != (dataset, sample):
                    own.setdefault((*item[5], who), []).append(item)
        used[label, lang] += seconds
        clips[who] = clips.get(who, 0) + 1
        of_cell[label, lang].add(who)
        if label == "spoof":
            gen[maker] = gen.get(maker, 0.0) + seconds
        chosen.append((dataset, sample, label, lang, who, maker, seconds))
    met = Counter(g for who in clips for g in {item[5] for item in of_speaker[who]})
    # the last picks of a generator with too large a share of what was chosen go again
    while True:
        total = {}
        for c in chosen:
            if c[2] == "spoof":
                total[c[5]] = total.get(c[5], 0.0) + c[6]
        if not total or sum(total.values()) <= 0:
            break
        top = min(total, key=lambda k: (-total[k], str(k)))
        if total[top] <= budget.generator_share * sum(total.values()) + 1e-9:
            break
        at = max(i for i, c in enumerate(chosen) if c[2] == "spoof" and c[5] == top)
        del chosen[at]
    return pd.DataFrame(chosen, columns=columns), max(met.values(), default=0)


def _undominated(rows: pd.DataFrame, by: list[str], of: str | None, k: int) -> pd.DataFrame:
    """Rows that fewer than k others of their group (others in `of`, if named) precede in rank and don't exceed in duration; of one `of`, none may."""
    rows = rows.sort_values(["rank", "duration", "dataset", "sample_id"]).reset_index(drop=True)
    held: dict[int, tuple[list, dict]] = {}
    keep = []
    for n, (g, o, d) in enumerate(zip(rows.groupby(by, dropna=False, sort=False).ngroup(), rows[of] if of else rows.index, rows["duration"])):
        least, mine = held.setdefault(g, ([], {}))
        if (len(least) >= k and least[-1][0] <= d) or mine.get(o, d + 1) <= d:
            continue
        keep.append(n)
        if o in mine:
            del least[bisect_left(least, (mine[o], o))]
        insort(least, (d, o))
        mine[o] = d
        if len(least) > k:
            del mine[least.pop()[1]]
    return rows.iloc[keep]


def _narrowed(df: DataFrame, by: list[str], of: str | None, k: int) -> DataFrame:
    """_undominated rows of df, and perhaps some more: a group that goes through memory in parts is narrowed within each."""

    def part(batches):
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + len(b)
            if n >= 100_000:
                held = [_undominated(pd.concat(held), by, of, k)]
                n = len(held[0])
                if n > 50_000:
                    yield held[0]
                    held, n = [], 0
        if n:
            yield _undominated(pd.concat(held), by, of, k)

    # within the tasks as they are, so that no group is large after the shuffle
    return df.mapInPandas(part, df.schema).repartition(*by).sortWithinPartitions(*by).mapInPandas(part, df.schema)


def greedy_plan(eligible: DataFrame, cells: list[tuple[str, str]], budget: Budget) -> DataFrame:
    """dataset, sample_id, label, language, speaker_id, generator, duration of the chosen records.

    Speaker and generator limits couple all cells, so the last choice is one sequence. It gets all rows that it could choose:

    * Room only shrinks. So when a row is chosen, all rows of its (label, language, speaker, generator) that precede it in rank and are no
      longer have been chosen: fewer than a speaker may give.
    * Speakers not chosen yet are alike. So when a speaker's first row is chosen, all speakers with such a row in its (label, language,
      generator) have been chosen. It is tried with few of them; if as many as tried have been chosen anywhere, with more."""
    per = {c: budget.seconds[c[0]] / max(1, sum(1 for x in cells if x[0] == c[0])) for c in cells}
    columns = ["dataset", "sample_id", "label", "language", "speaker_id", "generator", "duration"]
    cell = F.concat_ws("|", "label", "language")
    rows = durable(eligible.where(cell.isin(*("|".join(c) for c in cells))).select(*columns, hash_order(budget.seed, "dataset", "sample_id").alias("rank")))
    shape = "dataset string, sample_id string, label string, language string, speaker_id string, generator string, duration double, reach int, picked boolean"

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen, reach = _choose(pdf, per, budget)
        mark = pd.DataFrame([(None,) * 6 + (0.0, reach, False)], columns=[*columns, "reach", "picked"])
        return pd.concat([chosen.assign(reach=reach, picked=True), mark]) if len(chosen) else mark

    k = min(32, budget.speakers)
    while True:
        near = _narrowed(rows, ["label", "language", "generator"], "speaker_id", max(1, k)).select("speaker_id").distinct()
        bounded = _narrowed(rows.join(near, "speaker_id", "left_semi"), ["label", "language", "speaker_id", "generator"], None, max(1, budget.clips_per_speaker))
        found = durable(bounded.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(choose, shape))
        mark = found.where("NOT picked").first()
        if k >= budget.speakers or mark is None or mark["reach"] < k:
            return found.where("picked").select(*columns)
        k = min(4 * k, budget.speakers)


def plan_report(chosen: DataFrame, cells: list[tuple[str, str]], budget: Budget) -> DataFrame:
    """label, language, target, selected, shortfall, speakers, problem of each cell."""
    per = [(a, b, budget.seconds[a] / max(1, sum(1 for x in cells if x[0] == a))) for a, b in cells]
    wanted = chosen.sparkSession.createDataFrame(per, "label string, language string, target_seconds double")
    got = chosen.groupBy("label", "language").agg(F.sum("duration").alias("s"), F.countDistinct("speaker_id").alias("k"))
    both = F.broadcast(wanted).join(got, ["label", "language"], "left").select("label", "language", "target_seconds", F.coalesce("s", F.lit(0.0)).alias("selected_seconds"), F.coalesce("k", F.lit(0)).cast("bigint").alias("speakers"))
    short = F.col("selected_seconds") < F.col("target_seconds") * (1 - budget.tolerance) - 1e-9
    return both.withColumn("shortfall_seconds", F.greatest(F.lit(0.0), F.col("target_seconds") - F.col("selected_seconds"))).withColumn("problem", F.when(short, "underfilled").when(F.col("speakers") < budget.speakers_per_cell, "too few speakers"))


def class_gap(report: DataFrame) -> DataFrame:
    """n_underfilled, gap_seconds of a plan's report: cells that miss their target, and by how much the classes' seconds differ."""
    of = lambda k: F.coalesce(F.sum(F.when(F.col("label") == k, F.col("selected_seconds"))), F.lit(0.0))
    return report.agg(F.count(F.when(F.col("problem").isNotNull(), 1)).alias("n_underfilled"), F.abs(of("bonafide") - of("spoof")).alias("gap_seconds"))


def byte_budget(units: DataFrame, shares: dict[str, float], budget: int, minimum: int = 100, refuse: bool = True) -> DataFrame:
    """split, unit, picked, estimated_bytes, usable: units of each split by coverage of the classes per byte, as long as the split's bytes last.

    units: unit, split, n_bonafide, n_spoof, estimated_bytes; a unit is a row group, so a split has few of them. Splits are independent.
    A split of shares whose units hold fewer than `minimum` records of a class is an error; with refuse=False its rows aren't usable, and
    one row without a unit stands for a split that gets none."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        split = pdf["split"].iloc[0]
        left = int(budget * shares.get(split, 0))
        pool = [r for r in pdf.itertuples(index=False) if r.n_bonafide + r.n_spoof > 0]
        have, out = [0, 0], []
        while True:
            fits = [r for r in pool if r.estimated_bytes <= left]
            if not fits:
                break
            best = max(fits, key=lambda r: ((r.n_bonafide / (have[0] + 100) + r.n_spoof / (have[1] + 100)) / max(1, r.estimated_bytes), r.unit))
            out.append((best.split, best.unit, len(out) + 1, best.estimated_bytes))
            have = [have[0] + best.n_bonafide, have[1] + best.n_spoof]
            left -= best.estimated_bytes
            pool.remove(best)
        usable = min(have) >= minimum
        if refuse and split in shares and not usable:
            raise ValueError(f"no usable {split} subset within its bytes: {have[0]} bonafide and {have[1]} spoof records, {minimum} of each wanted")
        return pd.DataFrame(out or [(split, None, 0, 0)], columns=["split", "unit", "picked", "estimated_bytes"]).assign(usable=usable)

    # a row for each split, so that one without units is judged too
    named = units.sparkSession.createDataFrame([(s, 0, 0, 0) for s in shares], "split string, n_bonafide bigint, n_spoof bigint, estimated_bytes bigint").withColumn("unit", F.lit(None).cast("string"))
    return units.unionByName(named).groupBy("split").applyInPandas(pick, "split string, unit string, picked int, estimated_bytes bigint, usable boolean")


def shard_plan(files: DataFrame, by: list[str], path: str, size: str, per: int, most: int, seed: str) -> DataFrame:
    """`per` files of each stratum in hash order; more bytes than `most` in all is an error."""
    chosen = quota(files, by, path, per, seed)
    total = chosen.agg(F.coalesce(F.sum(size), F.lit(0)).alias("s")).first()["s"]
    if total > most:
        raise ValueError(f"the plan has {total} bytes; at most {most} may be read")
    return chosen
