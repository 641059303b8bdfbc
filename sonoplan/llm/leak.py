"""Passages of held-out items inside documents.

A positional inverted index of the corpus: documents are gathered into blocks, and each block has its terms, how often each
occurs, and all positions as differences in variable-length bytes. The index is written once, as a table; the corpus is read
once however many items there are. Term frequencies of the whole corpus come from the index, and rank the terms of the items.

An exact match of a window of `run` item words starts from its rarest term: that list, adjusted by the offset, is intersected
with the list of the second rarest, and what is left grows word by word to the maximal run. A proximity match asks that the
window's three rarest terms stand near the places that the phrase would give them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoplan.session import durable

_TERM = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_HIDDEN = regex.compile(r"\p{Cf}+")
_PLAIN = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
#: Characters of a block of the index, about; bytes of items that are answered together; occurrences looked at together.
BLOCK_CHARS, ITEM_BYTES, STEP = 2_000_000, 4_000_000, 2_000_000


def terms(text: str | None) -> list[str]:
    """Words of letters, marks and digits, without case, width variants and invisible characters."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(_PLAIN).decode().split()
    return _TERM.findall(_HIDDEN.sub("", unicodedata.normalize("NFKC", text).casefold()))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on, seven bits a byte, the low ones first; the high bit says that more follow."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >= 1 << 7 * k
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(5):
        some = np.flatnonzero(size > k)
        out[at[some] + k] = (values[some] >> 7 * k & 127) | np.where(size[some] > k + 1, 128, 0)
    return out.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    parts = np.frombuffer(raw, np.uint8).astype(np.int64)
    if not len(parts):
        return parts
    ends = np.flatnonzero(parts < 128)
    heads = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(parts)) - np.repeat(heads, ends - heads + 1)
    return np.add.reduceat((parts & 127) << 7 * place, heads)


def _spread(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    """low, low + 1, ... of each of the ranges of n numbers, one after another."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def index_block(texts: list[str | None], gap: int) -> tuple[list[int], np.ndarray, list[str], np.ndarray, bytes]:
    """Numbers of the texts that have words, the place of each one's first word, terms, occurrences of each, and their places.

    Texts stand `gap` places apart, so that nothing that is shorter than a gap spans two."""
    docs = [(i, w) for i, w in ((i, terms(t)) for i, t in enumerate(texts)) if w]
    sizes = np.fromiter((len(w) for _, w in docs), np.int64, len(docs))
    first = np.cumsum(sizes + gap) - sizes
    number: dict[str, int] = {}
    set_ = number.setdefault
    flat = np.fromiter((set_(w, len(number)) for _, words in docs for w in words), np.int32, int(sizes.sum()))
    places = _spread(first, sizes)[np.argsort(flat, kind="stable")]
    count = np.bincount(flat, minlength=len(number))
    steps = np.diff(places, prepend=0)
    heads = np.cumsum(count) - count
    steps[heads] = places[heads]
    return [i for i, _ in docs], first, list(number), count, pack(steps)


def index(docs: DataFrame, key: str, text: str, run: int) -> DataFrame:
    """block, keys, firsts, terms, counts, places: the positional index of the texts, one row per block. Null, empty and blank texts aren't in it. A map over the rows."""
    kind = docs.schema[key].dataType.simpleString()
    names = ["block", "keys", "firsts", "terms", "counts", "places"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            low, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars > BLOCK_CHARS or i == len(texts) - 1:
                    held, first, words, count, places = index_block(texts[low : i + 1], 2 * run)
                    mine = keys.take(pa.array([low + x for x in held], pa.int64()))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (mine, pa.array(first, pa.int64()), pa.array(words, pa.string()), pa.array(count, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists, pa.array([places], pa.binary())], names)
                    number += 1
                    low, chars = i + 1, 0

    return docs.select(key, text).mapInArrow(build, f"block bigint, keys array<{kind}>, firsts array<bigint>, terms array<string>, counts array<bigint>, places binary")


class Items:
    """The items' words as term numbers, one after another with gaps that match nothing, and the terms by rarity of each window."""

    def __init__(self, items: list[tuple[int, list[str], list[int]]], run: int):
        """items: id, words, and how often each word occurs in the corpus."""
        self.run, self.ids, number, seen = run, [], {}, []
        row, of, size = [-2] * run, [-1] * run, []
        for item, words, often in items:
            size.append(len(words))
            for w, n in zip(words, often):
                if w not in number:
                    number[w] = len(number)
                    seen.append(n)
            row += [number[w] for w in words] + [-2] * run
            of += [len(self.ids)] * len(words) + [-1] * run
            self.ids.append(item)
        self.terms, self.row, self.of, self.size = list(number), np.array(row, np.int64), np.array(of, np.int64), np.array(size, np.int64)
        views = np.lib.stride_tricks.sliding_window_view(self.of, run) if len(self.of) >= run else np.zeros((0, run), np.int64)
        self.windows = np.flatnonzero((views >= 0).all(1) & (views[:, 0] == views[:, -1]))
        # rarest, second and third term of each window; a window with a term that the corpus lacks matches nothing exactly
        grid = self.windows[:, None] + np.arange(run)
        often = np.array(seen, np.int64)[self.row[grid]] if len(grid) else np.zeros((0, run), np.int64)
        self.ranked = self.windows[:, None] + np.argsort(often, axis=1, kind="stable")[:, :3]
        whole = (often > 0).all(1)
        self.anchors = np.unique(self.ranked[whole][:, :2], axis=0) if whole.any() else np.zeros((0, 2), np.int64)

    def block(self, firsts: np.ndarray, words: list[str], counts: np.ndarray, places: bytes) -> Block:
        return Block(self, firsts, words, counts, places)


class Block:
    """A block of the index, as far as the items' terms go."""

    def __init__(self, items: Items, firsts: np.ndarray, words: list[str], counts: np.ndarray, places: bytes):
        self.items, self.firsts = items, firsts
        here = {w: i for i, w in enumerate(words)}
        local = np.fromiter((here.get(w, -1) for w in items.terms), np.int64, len(items.terms))
        steps = unpack(places)
        heads = np.cumsum(counts) - counts
        run_up = np.cumsum(steps)
        at = run_up - np.repeat(run_up[heads] - steps[heads], counts) if len(steps) else steps
        held = np.flatnonzero(local >= 0)
        self.count = np.zeros(len(items.terms), np.int64)
        self.count[held] = counts[local[held]]
        self.places = at[_spread(heads[local[held]], self.count[held])]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        # which of the items' terms stands at each place: membership in any list in one look
        self.text = np.full((int(at.max()) if len(at) else 0) + 4 * items.run, -1, np.int64)
        self.text[self.places] = np.repeat(np.arange(len(items.terms)), self.count)

    def _met(self, pairs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row number of `pairs`, place in the block, of all occurrences of the terms at pairs[:, 0], in portions."""
        lengths = self.count[self.items.row[pairs[:, 0]]]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        low = 0
        while low < len(pairs):
            high = max(low + 1, int(np.searchsorted(edges, edges[low] + STEP, "right")) - 1)
            n = lengths[low:high]
            yield np.repeat(np.arange(low, high), n), self.places[_spread(self.first[self.items.row[pairs[low:high, 0]]], n)]
            low = high

    def _grow(self, a: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
        out, live, k = np.zeros(len(a), np.int64), np.arange(len(a)), step
        while len(live):
            live = live[self.items.row[a[live] + k] == self.text[p[live] + k]]
            out[live] += 1
            k += step
        return out

    def exact(self) -> tuple[np.ndarray, ...]:
        """doc, item, covered words of the item, longest run: all pairs with a common run of at least `run` words."""
        items, found = self.items, []
        pairs = items.anchors[(self.count[items.row[items.anchors]] > 0).all(1)] if len(items.anchors) else items.anchors
        span, half = np.int64(len(self.text)), items.run // 2
        for which, p in self._met(pairs):
            a, b = pairs[which].T
            keep = np.flatnonzero(self.text[p + b - a] == items.row[b])
            a, p = a[keep], p[keep]
            # a run of this length goes on for half of it to one side at least
            keep = (self.text[p + half] == items.row[a + half]) | (self.text[p - half] == items.row[a - half])
            a, p = np.divmod(np.unique(a[keep] * span + p[keep]), span)
            back, ahead = self._grow(a, p, -1), self._grow(a, p, 1)
            keep = back + ahead + 1 >= items.run
            # a run is known by where it begins in the item and in the block
            runs, one = np.unique((a - back)[keep] * span + (p - back)[keep], return_index=True)
            start, at = np.divmod(runs, span)
            found.append(np.stack([np.searchsorted(self.firsts, at, "right") - 1, items.of[start], start, start + (back + ahead + 1)[keep][one]]))
        hits = np.concatenate(found, axis=1) if found else np.zeros((4, 0), np.int64)
        hits = hits[:, np.lexsort(hits[::-1])].T
        return self._covered(hits) if len(hits) else tuple(np.zeros(0, np.int64) for _ in range(4))

    def near(self, slack: int) -> tuple[np.ndarray, ...]:
        """doc, item, windows: windows of the item whose three rarest terms stand in the document, the second and third at most `slack` from their places as the first gives them."""
        items, found = self.items, []
        ranked = items.ranked
        alive = np.flatnonzero((self.count[items.row[ranked]] > 0).all(1)) if len(ranked) else np.zeros(0, np.int64)
        for which, p in self._met(ranked[alive]):
            window = alive[which]
            for k in (1, 2):
                a, b = ranked[window, 0], ranked[window, k]
                hit = np.zeros(len(p), bool)
                for s in range(-slack, slack + 1):
                    hit |= self.text[p + b - a + s] == items.row[b]
                window, p = window[hit], p[hit]
            found.append(np.stack([np.searchsorted(self.firsts, p, "right") - 1, items.of[ranked[window, 0]], window], 1))
        hits = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
        if not len(hits):
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        heads = np.flatnonzero(np.concatenate([[True], (hits[1:, :2] != hits[:-1, :2]).any(1)]))
        return hits[heads, 0], hits[heads, 1], np.diff(np.append(heads, len(hits)))

    @staticmethod
    def _covered(hits: np.ndarray) -> tuple[np.ndarray, ...]:
        """Union of the runs of each pair; hits are sorted by doc, item, start, end."""
        doc, item, start, end = hits.T
        pair = np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])])
        group = np.cumsum(pair) - 1
        reach = np.maximum.accumulate(end + group * (int(end.max()) + 1)) - group * (int(end.max()) + 1)
        earlier = np.concatenate([[0], reach[:-1]])
        new = np.maximum(0, end - np.where(pair, start, np.maximum(start, earlier)))
        heads = np.flatnonzero(pair)
        return doc[heads], item[heads], np.add.reduceat(new, heads), np.maximum.reduceat(end - start, heads)


def _prepared(stored: DataFrame, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """item, words, often: the items' words and how often the corpus has each."""
    kind = items.schema[item_key].dataType.simpleString()

    def split(batches):
        for b in batches:
            yield pd.DataFrame({"item": b["item"], "words": [terms(t) for t in b["text"]]})

    chosen = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    worded = chosen.mapInPandas(split, f"item {kind}, words array<string>").withColumn("copy", F.monotonically_increasing_id())
    flat = durable(worded.select("item", "copy", F.posexplode("words").alias("place", "term")))
    counted = stored.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    often = counted.join(flat.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    one = F.struct("place", "term", F.coalesce("n", F.lit(0)).alias("n"))
    return flat.join(often, "term", "left").groupBy("item", "copy").agg(F.array_sort(F.collect_list(one)).alias("w")).select("item", "w.term", "w.n")


def _answered(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int, answer, columns: str) -> DataFrame:
    """key, item and what `answer` finds of a block, for all items in chunks of bounded size, from one index."""
    spark = docs.sparkSession
    stored = durable(index(docs, key, text, run))
    ready = durable(_prepared(stored, items, item_key, item_text))
    kinds = docs.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    weight = ready.agg(F.sum(F.aggregate("term", F.lit(0), lambda a, x: a + F.length(x) + 8))).first()[0] or 0
    chunks = max(1, -(-weight // ITEM_BYTES))
    out = None
    for c in range(chunks):
        chunk = ready.where(F.pmod(F.xxhash64("item"), F.lit(chunks)) == c) if chunks > 1 else ready
        shared = spark.sparkContext.broadcast([tuple(r) for r in chunk.orderBy("item").toLocalIterator()])
        one = _search(stored, shared, run, kinds, answer, columns)
        out = one if out is None else out.unionByName(one)
    return out.withColumnsRenamed({"key": key, "item": item_key})


def _search(stored: DataFrame, shared, run: int, kinds: tuple[str, str], answer, columns: str) -> DataFrame:
    names = ["key", "item", *(c.split()[0] for c in columns.split(", "))]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(shared.value, run)
        kind = pa.int64() if kinds[1] == "bigint" else None
        for batch in batches:
            for keys, firsts, words, counts, places in zip(*(batch.column(k) for k in range(5))):
                if not len(words):
                    continue
                block = items.block(firsts.values.to_numpy(), words.values.to_pylist(), counts.values.to_numpy(), places.as_py())
                doc, item, *rest = answer(block)
                yield pa.RecordBatch.from_arrays([keys.values.take(pa.array(doc)), pa.array([items.ids[i] for i in item.tolist()], kind), *map(pa.array, rest)], names)

    return stored.select("keys", "firsts", "terms", "counts", "places").mapInArrow(search, f"key {kinds[0]}, item {kinds[1]}, {columns}")


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 8) -> DataFrame:
    """key, item_key, covered_words, item_words, longest_run of each document and item that have `run` or more consecutive words in common.

    covered_words counts words of the item inside such runs, each once. Null, empty or blank texts and items of fewer words
    match nothing; repeated documents are found each, and so are repeated items. Documents are read once and never shuffled."""

    def answer(block: Block) -> tuple[np.ndarray, ...]:
        doc, item, covered, longest = block.exact()
        return doc, item, covered, block.items.size[item], longest

    return _answered(docs, key, text, items, item_key, item_text, run, answer, "covered_words bigint, item_words bigint, longest_run bigint")


def find_near(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, run: int = 8, slack: int = 2) -> DataFrame:
    """key, item_key, near_windows, item_windows: windows of `run` words of the item that the document holds nearly, so that words put in, left out or changed don't matter.

    A window is held nearly if its three rarest terms (by occurrences in the corpus, the first of equals first) stand in the document,
    the second and third at most `slack` words from the places that the rarest gives them. Slack is below half of `run`."""

    def answer(block: Block) -> tuple[np.ndarray, ...]:
        doc, item, n = block.near(slack)
        return doc, item, n, block.items.size[item] - run + 1

    return _answered(docs, key, text, items, item_key, item_text, run, answer, "near_windows bigint, item_windows bigint")
