"""Encoding of texts by a public byte-level BPE vocabulary: speculate and verify.

Words (the pieces of the vocabulary's own pattern) are proposed as greedy longest matches. A proposal is the BPE encoding
exactly if each adjacent pair of tokens is compatible: if, while the merges run in order over the bytes of both, none joins
across their border. All adjacent pairs of a batch are tested at once; only words with a failing pair are merged exactly.
Encoded words are kept by spelling for as long as a worker lives, up to a bound; a word that isn't kept is encoded again.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary lies unless another path is given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: Unicode's White_Space.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Fixed value: the vocabulary's pattern.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Anything that may count as white space, for places where a text is safely cut.
WIDE = re.escape(SPACE + "".join(map(chr, range(0x1C, 0x20))))
KEPT, LONGEST_KEPT, BLOCK_CHARS = 300_000, 64, 4_000_000
LAST = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it prints, else the next one after 255."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b if b in prints else next(spare)): b for b in range(256)}


class Encoder:
    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        size = max(ids.values()) + 1
        self.left, self.right, self.rank = np.arange(size), np.arange(size), np.full(size, -1, np.int64)
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        keys, made = [], []
        for rank, (a, b) in enumerate(merges):
            x, y, z = ids[a], ids[b], ids[a + b]
            self.left[z], self.right[z], self.rank[z] = x, y, rank
            self.joined[x, y] = rank, z
            keys.append(x << 20 | y)
            made.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.pair_keys, self.pair_rank = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        used = {letter: ids[letter] for letter in letters} | {a + b: ids[a + b] for a, b in merges}
        self.id_of = {spell(t): i for t, i in used.items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.length = np.zeros(size, np.int64)
        for b, i in self.id_of.items():
            self.length[i] = len(b)
        self.prefixes = {b[:k] for b in self.id_of for k in range(1, len(b) + 1)}
        self.base = [self.id_of[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(WORD)
        self.rough = re.compile(f"^ | $|[{WIDE}] | [{WIDE}]")
        self.gap = re.compile(f"(?<=[^{WIDE}]) (?=[^{WIDE}])")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.long_first, self.long_later, self.long_words = [], [], []  # not kept beyond a block

    # words ------------------------------------------------------------------------------------------------------------

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        known = self.id_of.get(word)
        if known is not None:
            return [known]
        out, at, ids, prefixes = [], 0, self.id_of, self.prefixes
        while at < len(word):
            end, stop = at + 1, at + 2
            while stop <= len(word) and word[at:stop] in prefixes:
                if word[at:stop] in ids:
                    end = stop
                stop += 1
            out.append(ids[word[at:end]])
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether no merge joins them, or parts of them, before both are whole.

        Parts at the border are walked back in time, from the whole tokens on: the part made later falls into its halves. A
        merge of the two parts comes first if it ranks before the merge that absorbs the left part (equal ranks run from
        the left, so the left one wins), and not after the one that absorbs the right part."""
        fine, live = np.ones(len(a), bool), np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until, y_until = np.full(len(a), LAST), np.full(len(a), LAST)
        while len(live):
            key = x << 20 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            rank = np.where(self.pair_keys[at] == key, self.pair_rank[at], LAST)
            clash = (rank < x_until) & (rank <= y_until) & (rank < LAST)
            fine[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~clash & ((rx >= 0) | (ry >= 0))
            live, x, y, x_until, y_until, rx, ry = live[on], x[on], y[on], x_until[on], y_until[on], rx[on], ry[on]
            back = rx > ry
            x_until, y_until = np.where(back, rx, x_until), np.where(back, y_until, ry)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return fine

    def merge(self, word: bytes) -> list[int]:
        """The merges in order, the leftmost first among equals; n log n in the word's length."""
        ids = [self.base[b] for b in word]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        joined = self.joined
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := joined.get((ids[i], ids[i + 1])))]
        heap = [(rank, i, z, x, y) for rank, z, i, x, y in heap]
        heapq.heapify(heap)
        while heap:
            _, i, z, x, y = heapq.heappop(heap)
            j = after[i] if ids[i] == x else n
            if j >= n or ids[j] != y:
                continue
            ids[i], ids[j], after[i] = z, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if m := joined.get((z, ids[after[j]])):
                    heapq.heappush(heap, (m[0], i, m[1], z, ids[after[j]]))
            if (h := before[i]) >= 0 and (m := joined.get((ids[h], z))):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], z))
        return [t for t in ids if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        proposed = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(counts.sum()))
        of = np.repeat(np.arange(len(words)), counts)
        same = np.flatnonzero(of[1:] == of[:-1])
        failing = same[~self.compatible(flat[same], flat[same + 1])]
        for k in np.unique(of[failing]).tolist():
            proposed[k] = self.merge(words[k])
        return proposed

    # texts ------------------------------------------------------------------------------------------------------------

    def _chunks(self, text: str) -> list[str]:
        """The text cut at single spaces between other characters. Such a space always begins a word, so that what lies between can be encoded by itself."""
        return self.gap.split(text) if self.rough.search(text) else text.split(" ")

    def _learn(self, chunks: set[str], kept: dict[str, bytes], lead: str) -> None:
        cut = {c: self.pattern.findall(lead + c) for c in chunks}
        known = self.words
        fresh = list({w for ws in cut.values() for w in ws if w not in known})
        for w, ids in zip(fresh, self.encode_words([w.encode("utf-8", "surrogatepass") for w in fresh])):
            self.words[w] = np.array(ids, np.int32).tobytes()
        self.long_words += [w for w in fresh if len(w) > LONGEST_KEPT]
        (self.long_later if lead else self.long_first).extend(c for c in cut if len(c) > LONGEST_KEPT)
        for c, ws in cut.items():
            kept[c] = b"".join(map(self.words.__getitem__, ws))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text. Null and empty texts have no ids."""
        done: list[bytes] = [b""] * len(texts)
        open_, chars = [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            chunks = self._chunks(text)
            try:
                done[i] = self.first[chunks[0]] + b"".join(map(self.later.__getitem__, chunks[1:]))
            except KeyError:
                open_.append((i, chunks))
                chars += len(text)
            if chars > BLOCK_CHARS:
                self._finish(open_, done)
                open_, chars = [], 0
        self._finish(open_, done)
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, done), np.int64, len(done)) // 4, out=offsets[1:])
        return np.frombuffer(b"".join(done), np.int32), offsets

    def _finish(self, open_: list[tuple[int, list[str]]], done: list[bytes]) -> None:
        if not open_:
            return
        first, later = self.first, self.later
        self._learn({c[0] for _, c in open_ if c[0] not in first}, first, "")
        self._learn({c for _, cs in open_ for c in cs[1:] if c not in later}, later, " ")
        for i, chunks in open_:
            done[i] = first[chunks[0]] + b"".join(map(later.__getitem__, chunks[1:]))
        for kept, seen in ((first, self.long_first), (later, self.long_later), (self.words, self.long_words)):
            if len(kept) > KEPT:
                kept.clear()
            for c in seen:
                kept.pop(c, None)
            seen.clear()


@lru_cache(maxsize=2)
def encoder(path: str, sent: bool = False) -> Encoder:
    """One for each worker, by the file that ship() sent along or the one at the path."""
    return Encoder(SparkFiles.get(os.path.basename(path)) if sent else path)


_SENT: dict[tuple[str, str], str] = {}


def ship(spark: SparkSession, path: str) -> bool:
    """Sends the driver's vocabulary file along with the tasks, so that workers need none of their own. False where the driver has none, or has sent another of that name; then workers read the path."""
    key = spark.sparkContext.applicationId, os.path.basename(path)
    if key not in _SENT and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _SENT[key] = path
    return _SENT.get(key) == path


def encode_texts(df: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """key and ids (array of int) of each row's text, without special tokens; null and empty texts have an empty array.

    A map over the rows: nothing is shuffled, and other columns aren't read."""
    narrow = df.select(key, text)
    sent = ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, sent)
        for batch in batches:
            flat, offsets = enc.encode(batch.column(1).to_pylist())
            ids = pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
