"""Recordings of the evaluation splits that stand, exactly or almost, in the training split.

A recording is up to three sequences of symbols: the digests of its distinct windows in order, and, alone in theirs, the
digests of its bytes and of its model window. The evaluation sequences are cut into shards; each shard becomes a compressed
full-text index: the Burrows-Wheeler transform, its occurrence lists, and every eighth place of the text. Training sequences
stream through it by backward search; the matches found are followed back until they are maximal and located by walking on to
the next kept place. The maximal matches of each pair come out as spans, whose lengths add up to what the pair shares.

Two sequences belong together if the shorter shares at least half of its symbols with the other. Then one of the shorter's
rarest n - ceil(n / 2) + 1 symbols (its anchors) is shared. Only matches that end at an anchor of either side are located, so
that a window that very many recordings hold (silence, a jingle) makes no pairs by itself. Nothing is capped by this: the
other spans of a pair so found are read off both sequences, and its number of shared symbols is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoplan.functions.text import digest_key, tidy
from sonoplan.operators.skew import heavy_keys
from sonoplan.session import durable, partitions, release

WINDOWS, AUDIO, MODEL_WINDOW = 0, 1, 2
#: Symbols of an index, about; symbols of the training sequences that one task holds against it, about; occurrences followed at a time.
SHARD_SYMBOLS, STREAM_SYMBOLS, STEP = 250_000, 1_000_000, 1_000_000
#: A symbol with this share of all symbols counts as hot; there are at most 2 / HOT of them. Their rows are spread over salts.
HOT, SALTS = 0.005, 32
#: Every so manieth place of an index's text is kept.
KEPT = 8


class FullTextIndex:
    """Compressed index over sequences of symbols: about nine bytes a symbol. Symbol 0 stands for any symbol that isn't searched for."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(int((lengths + 1).sum()), np.int64)
        body = np.ones(len(text), bool)
        body[ends] = False
        text[body] = np.concatenate(sequences) if len(sequences) else np.zeros(0, np.int64)
        self.size, self.begins = len(text), (ends - lengths).astype(np.int32)
        plain = np.where(text > 0, text, -1 - np.arange(len(text)))  # ends and gaps are unlike each other
        rows = self._suffixes(plain, int(lengths.max(initial=0)) + 1)
        codes = np.unique(plain, return_inverse=True)[1].astype(np.int32)
        self.plain = int((text == 0).sum())  # codes below this are ends and gaps
        self.last = codes[rows - 1]  # the transform: the symbol before each suffix
        # where each symbol stands in the transform; read as a whole, the row of the suffix that is shorter by one
        self.occurs = np.argsort(self.last, kind="stable").astype(np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=1))]).astype(np.int64)
        kept = np.flatnonzero(rows % KEPT == 0)
        self.kept, self.places = kept.astype(np.int32), rows[kept].astype(np.int32)

    @staticmethod
    def _suffixes(plain: np.ndarray, longest: int) -> np.ndarray:
        """Sorted suffixes, by doubling."""
        rank = np.unique(plain, return_inverse=True)[1].astype(np.int64)
        width, order = 1, np.argsort(rank, kind="stable")
        while width <= longest:
            after = np.full(len(rank), -1, np.int64)
            after[:-width] = rank[width:]
            key = rank * (len(rank) + 1) + after + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]])) if len(key) else []
            width *= 2
        return order

    def back(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """One step of backward search for a bound of a range of rows: the rows before the suffixes that begin with the symbol and go on as those below `row`."""
        low, high = self.first[code], self.first[code + 1]
        while (open_ := low < high).any():
            middle = (low + high) // 2
            less = self.occurs[np.minimum(middle, self.size - 1)] < row
            low, high = np.where(open_ & less, middle + 1, low), np.where(open_ & ~less, middle, high)
        return low

    def ranges(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the suffixes that begin with each symbol."""
        code = self.plain + symbol - 1
        return self.back(code, np.zeros(len(code), np.int64)), self.back(code, np.full(len(code), self.size))

    def follow(self, row: np.ndarray, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of the first symbol of the match that ends at the row's first symbol and at query[at], followed backward until it is maximal."""
        live, row, at = np.arange(len(row)), row.copy(), at - 1
        while len(live):
            code = self.last[row[live]].astype(np.int64)
            same = (code - self.plain + 1 == query[at[live]]) & (query[at[live]] > 0)
            live, code = live[same], code[same]
            row[live] = self.back(code, row[live])
            at[live] -= 1
        return row

    def locate(self, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence, and place in it, of the first symbol of each row's suffix."""
        out, live, row, steps = np.zeros(len(row), np.int64), np.arange(len(row)), row.copy(), 0
        while len(live):
            at = np.minimum(np.searchsorted(self.kept, row[live]), len(self.kept) - 1)
            there = self.kept[at] == row[live]
            out[live[there]] = (self.places[at[there]] - steps) % self.size
            live = live[~there]
            row[live] = self.occurs[row[live]]
            steps += 1
        owner = np.searchsorted(self.begins, out, "right") - 1
        return owner, out - self.begins[owner]


def _spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each range, and which range each is of."""
    n = high - low
    of = np.repeat(np.arange(len(low)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n), of


class Shard:
    """An index of evaluation sequences that training sequences are held against."""

    def __init__(self, rows: pd.DataFrame):
        self.ids, self.kinds, self.sizes = rows["id"].to_numpy(), rows["kind"].to_numpy(), rows["n"].to_numpy()
        flat = np.array([s or b"" for q in rows["symbols"] for s in q], dtype="S16")
        self.names, numbers = np.unique(np.concatenate([np.array([b""], "S16"), flat]), return_inverse=True)
        numbers = numbers[1:]
        lengths = rows["symbols"].map(len).to_numpy()
        self.index = FullTextIndex(np.split(numbers, np.cumsum(lengths)[:-1]))
        # rows of the index that begin with an anchor
        anchored = np.concatenate([np.asarray(a, bool) for a in rows["anchors"]]) & (numbers > 0)
        owner = np.repeat(np.arange(len(rows)), lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        is_anchor = np.zeros(self.index.size, bool)
        is_anchor[np.flatnonzero(anchored) + owner[anchored]] = True
        begun = np.arange(self.index.first[self.index.plain], self.index.size)
        sequence, at = self.index.locate(begun)
        self.anchor_rows = begun[is_anchor[self.index.begins[sequence] + at]]
        known = numbers > 0
        key = owner[known] * np.int64(len(self.names)) + numbers[known]
        order = np.argsort(key)
        self.holds, self.stands = key[order], place[known][order].astype(np.int32)

    def search(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The pairs of these training sequences, in portions of bounded size."""
        index, lengths = self.index, rows["symbols"].map(len).to_numpy()
        flat = np.array([s or b"" for q in rows["symbols"] for s in q], dtype="S16")
        number = np.minimum(np.searchsorted(self.names, flat), len(self.names) - 1)
        number = np.where(self.names[number] == flat, number, 0)
        # a gap before each sequence stops the walk back
        at = np.arange(len(flat)) + np.repeat(np.arange(1, len(rows) + 1), lengths)
        query = np.zeros(len(flat) + len(rows) + 1, np.int64)
        query[at] = number
        owner, begin = np.repeat(np.arange(len(rows)), lengths), np.cumsum(lengths) - lengths
        live = np.flatnonzero(number > 0)
        low, high = index.ranges(number[live])
        anchored = np.concatenate([np.asarray(a, bool) for a in rows["anchors"]])[live]
        # all occurrences of an own anchor; of other symbols those that are anchors over there
        low = np.where(anchored, low, np.searchsorted(self.anchor_rows, low))
        high = np.where(anchored, high, np.searchsorted(self.anchor_rows, high))
        done = np.concatenate([[0], np.cumsum(high - low)])
        first, last = np.searchsorted(owner[live], np.arange(len(rows))), np.searchsorted(owner[live], np.arange(len(rows)), "right")
        k = 0
        while k < len(rows):
            # as many whole sequences as have about STEP occurrences together
            stop = k + 1
            while stop < len(rows) and done[last[stop]] - done[first[k]] <= STEP:
                stop += 1
            mine = slice(first[k], last[stop - 1])
            row, of = _spread(low[mine], high[mine])
            if len(row):
                of = of + first[k]
                row = np.where(anchored[of], row, self.anchor_rows[np.minimum(row, len(self.anchor_rows) - 1)] if len(self.anchor_rows) else row)
                place = live[of]
                start = index.follow(row, query, at[place])
                # a match that was met at several anchors begins at one row
                match = np.unique(owner[place] * np.int64(index.size) + start)
                sequence, _ = index.locate(match % index.size)
                pair = np.unique(match // index.size * np.int64(len(self.ids)) + sequence)
                yield self._decided(rows, *np.divmod(pair, len(self.ids)), number, begin, lengths)
            k = stop

    def _decided(self, rows: pd.DataFrame, t: np.ndarray, e: np.ndarray, number: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> pd.DataFrame:
        """Spans of each pair, and the exact number of shared symbols; pairs that share too few are left out."""
        out = []
        for k in range(0, len(t), STEP // 4):
            mine_t, mine_e = t[k : k + STEP // 4], e[k : k + STEP // 4]
            place, of = _spread(begin[mine_t], (begin + lengths)[mine_t])
            key = mine_e[of] * np.int64(len(self.names)) + number[place]
            hit = np.minimum(np.searchsorted(self.holds, key), len(self.holds) - 1)
            met = np.flatnonzero((self.holds[hit] == key) & (number[place] > 0))
            of, own, other = of[met], place[met] - begin[mine_t][of[met]], self.stands[hit[met]].astype(np.int64)
            # neighbours on both sides belong to one span
            new = np.concatenate([[True], (of[1:] != of[:-1]) | (own[1:] != own[:-1] + 1) | (other[1:] != other[:-1] + 1)]) if len(of) else np.zeros(0, bool)
            heads = np.flatnonzero(new)
            size = np.diff(np.append(heads, len(of)))
            shared = np.bincount(of, minlength=len(mine_t))
            n_t, n_e = rows["n"].to_numpy()[mine_t], self.sizes[mine_e]
            fine = np.flatnonzero((shared * 2 >= np.minimum(n_t, n_e)) & (rows["id"].to_numpy()[mine_t] != self.ids[mine_e]))
            longest = np.zeros(len(mine_t), np.int64)
            np.maximum.at(longest, of[heads], size)
            number_of = np.full(len(mine_t), -1, np.int64)
            number_of[fine] = np.arange(len(fine))
            mine = number_of[of[heads]]
            edges = np.searchsorted(mine[mine >= 0], np.arange(1, len(fine)))
            spans = {c: np.split(x[mine >= 0], edges) if len(fine) else [] for c, x in (("train_at", own[heads]), ("eval_at", other[heads]), ("lengths", size))}
            out.append(pd.DataFrame({"train_id": rows["id"].to_numpy()[mine_t[fine]], "eval_id": self.ids[mine_e[fine]], "kind": self.kinds[mine_e[fine]], "shared": shared[fine], "n_train": n_t[fine], "n_eval": n_e[fine], "longest": longest[fine], **spans}))
        return pd.concat(out, ignore_index=True)


def _search_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by shard and part, evaluation before training."""
    current, ready, waiting = None, None, []
    for batch in batches:
        for shard, group in batch.groupby(["shard", "part"], sort=False):
            if shard != current:
                current, ready, waiting = shard, None, []
            is_eval = group["is_train"].to_numpy() == 0
            if is_eval.any():
                waiting.append(group[is_eval])
            if not is_eval.all():
                if ready is None and waiting:
                    ready, waiting = Shard(pd.concat(waiting, ignore_index=True)), []
                if ready is not None:
                    for found in ready.search(group[~is_eval].reset_index(drop=True)):
                        yield found.astype(_TYPES)


_FOUND = "train_id string, eval_id string, kind int, shared bigint, n_train bigint, n_eval bigint, longest bigint, train_at array<bigint>, eval_at array<bigint>, lengths array<bigint>"
_TYPES = {"kind": "int32", "shared": "int64", "n_train": "int64", "n_eval": "int64", "longest": "int64"}


def postings(records: DataFrame, windows: DataFrame) -> DataFrame:
    """id, is_train, kind, place, symbol: the distinct known symbols of each recording, once, at their first place.

    Recordings of other splits, unknown digests and windows of unknown recordings give nothing. Rows stored twice count once."""
    split = F.lower(tidy(F.col("split")))
    mine = records.where(F.col("id").isNotNull() & split.isin("train", "dev", "test")).select("id", (split == "train").cast("int").alias("is_train"), digest_key(F.col("audio_sha256")).alias("a"), digest_key(F.col("window_sha256")).alias("w"))
    # 16 bytes that tell digests of each kind apart
    symbol = lambda kind, c: F.unhex(F.md5(F.concat(F.lit(str(kind)), c)))
    alone = mine.select("id", "is_train", F.explode(F.array(F.struct(F.lit(AUDIO).alias("kind"), symbol(AUDIO, F.col("a")).alias("symbol")), F.struct(F.lit(MODEL_WINDOW).alias("kind"), symbol(MODEL_WINDOW, F.col("w")).alias("symbol")))).alias("s"))
    alone = alone.select("id", "is_train", "s.kind", F.lit(0).alias("place"), "s.symbol").where("symbol IS NOT NULL").distinct()
    digest = digest_key(F.col("window_sha256"))
    inside = windows.where("id IS NOT NULL").select("id", F.coalesce("window_index", F.lit(0)).alias("place"), symbol(WINDOWS, digest).alias("symbol")).where("symbol IS NOT NULL")
    # by id once: the distinct windows of an id are found where the join has put them
    sides = mine.groupBy("id").agg(F.collect_set("is_train").alias("sides"))
    inside = inside.join(sides, "id").select("id", F.explode("sides").alias("is_train"), "place", "symbol").groupBy("id", "is_train", "symbol").agg(F.min("place").alias("place"))
    return alone.unionByName(inside.select("id", "is_train", F.lit(WINDOWS).alias("kind"), "place", "symbol"))


def _salted_join(left: DataFrame, right: DataFrame, hot: list[bytes]) -> DataFrame:
    """Join on symbol by shuffle: rows of hot symbols on the left are spread over salts, those on the right repeated for each."""
    if not hot:
        return left.join(right, "symbol")
    is_hot = F.col("symbol").isin(*[F.lit(x) for x in hot])
    salted = left.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = right.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(spread, ["symbol", "salt"]).drop("salt")


def sequences(posts: DataFrame, hot: list[bytes]) -> DataFrame:
    """id, is_train, kind, n, symbols, anchors: one row per sequence that shares a symbol with the other side; symbols of one side only are null."""
    counted = posts.groupBy("symbol").agg(F.count(F.lit(1)).alias("df"), F.max("is_train").alias("any_train"), F.min("is_train").alias("all_train"))
    ranked = _salted_join(posts, counted.select("symbol", "df", (F.col("any_train") > F.col("all_train")).alias("both")), hot)
    one = F.struct("df", "symbol", "place", "both")
    grouped = ranked.groupBy("id", "is_train", "kind").agg(F.array_sort(F.collect_list(one)).alias("by_rarity"), F.max("both").alias("any")).where("any")
    n = F.size("by_rarity")
    marked = F.transform("by_rarity", lambda x, i: F.struct(x["place"].alias("place"), F.when(x["both"], x["symbol"]).alias("symbol"), (x["both"] & (i < n - F.ceil(n / 2) + 1)).alias("anchor")))
    placed = grouped.select("id", "is_train", "kind", n.cast("bigint").alias("n"), F.array_sort(marked).alias("s"))
    return placed.select("id", "is_train", "kind", "n", F.transform("s", lambda x: x["symbol"]).alias("symbols"), F.transform("s", lambda x: x["anchor"]).alias("anchors"))


def _flat(rows: DataFrame, *extra: str) -> DataFrame:
    zipped = rows.select(*extra, F.explode(F.arrays_zip("symbols", "anchors")).alias("z"))
    return zipped.select(*[c for c in zipped.columns if c != "z"], F.col("z.symbols").alias("symbol"), F.col("z.anchors").alias("anchor")).where("symbol IS NOT NULL")


def overlapping(records: DataFrame, windows: DataFrame) -> DataFrame:
    """train_id, eval_id, kind, shared, n_train, n_eval, longest, and the spans (train_at, eval_at, lengths): all pairs, one row per kind of sequence that they have in common.

    Places are numbers in the sequence of a recording's distinct known windows, from 0 on. Empty tables give no rows. A recording stored
    in train and in an evaluation split is no pair with itself. A shard whose training sequences are many is held against them in parts,
    each with an index of its own, so that a symbol of very many of them makes no large task."""
    spark = records.sparkSession
    posts = durable(postings(records, windows))
    heavy, total = heavy_keys(posts.select(F.hex("symbol").alias("symbol")), ["symbol"], HOT)
    hot = [bytes.fromhex(x) for x in heavy["symbol"] if x is not None]
    rows = durable(sequences(posts, hot))
    release(posts)
    shards = max(partitions(spark), -(-total // SHARD_SYMBOLS))
    own = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    evals = rows.where("is_train = 0").withColumn("shard", own)
    trains = rows.where("is_train = 1")
    places = _flat(evals, "shard").groupBy("symbol", "shard").agg(F.max("anchor").alias("there"))
    asked = _flat(trains, "id", "kind")
    # an anchor over here meets all places, other symbols only anchors over there
    wanted = _salted_join(asked.where("anchor"), places, hot).select("id", "kind", "shard").unionByName(_salted_join(asked.where("NOT anchor"), places.where("there"), hot).select("id", "kind", "shard")).distinct()
    routed = durable(trains.join(wanted, ["id", "kind"]).select(*evals.columns))
    sizes = routed.groupBy("shard").agg(F.ceil(F.sum("n") / STREAM_SYMBOLS).cast("int").alias("parts"))
    mine = routed.join(sizes, "shard").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    copies = evals.join(sizes, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["shard", "part", "is_train", "id", "kind", "n", "symbols", "anchors"]
    stream = copies.select(*columns).unionByName(mine.select(*columns)).repartition(shards, "shard", "part").sortWithinPartitions("shard", "part", "is_train")
    return stream.mapInPandas(_search_shards, _FOUND)


def overlap_pairs(records: DataFrame, windows: DataFrame) -> DataFrame:
    """id_a < id_b, same_audio, same_window, shared_windows, longest_run: one row per pair of recordings."""
    found = overlapping(records, windows)
    is_kind = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, True)), F.lit(False))
    of = lambda c: F.coalesce(F.max(F.when(F.col("kind") == WINDOWS, F.col(c))), F.lit(0)).cast("bigint")
    return found.groupBy(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).agg(is_kind(AUDIO).alias("same_audio"), is_kind(MODEL_WINDOW).alias("same_window"), of("shared").alias("shared_windows"), of("longest").alias("longest_run"))


def overlap_spans(records: DataFrame, windows: DataFrame) -> DataFrame:
    """train_id, eval_id, train_at, eval_at, length: the maximal runs of windows that each pair of recordings has in common. Pairs that share their bytes or model window only have none."""
    found = overlapping(records, windows).where(F.col("kind") == WINDOWS)
    return found.select("train_id", "eval_id", F.explode(F.arrays_zip("train_at", "eval_at", "lengths")).alias("s")).select("train_id", "eval_id", F.col("s.train_at").alias("train_at"), F.col("s.eval_at").alias("eval_at"), F.col("s.lengths").alias("length"))


def overlap_report(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """split, source, n_records, n_overlapping, n_pairs: how many recordings of each evaluation split and source also stand in train."""
    split = F.lower(tidy(F.col("split")))
    mine = records.where(split.isin("dev", "test")).select("id", split.alias("split"), "source").distinct()
    ends = pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    return mine.join(ends, "id", "left").groupBy("split", "source").agg(F.count(F.lit(1)).alias("n_records"), F.count("k").alias("n_overlapping"), F.coalesce(F.sum("k"), F.lit(0)).cast("bigint").alias("n_pairs"))
