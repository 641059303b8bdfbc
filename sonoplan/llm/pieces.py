"""Cutting of texts that have too many tokens.

The least number of pieces that can hold what is left gives equal targets; each cut snaps to the strongest boundary near its
target, or to a sentence's end farther off where that costs no piece; where no boundary is near, to the nearest one that the
limit allows, which may add a piece. Only where the limit allows
no boundary at all does a piece end between two tokens. A piece whose text alone has too many tokens is cut earlier.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from sonoplan.llm.bpe import SPACE, VOCABULARY, Encoder, encoder, ship

#: Strengths of boundaries. A cut has the strength of the strongest that ends at it; INSIDE is no place for a cut unless nothing else is left.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, NONE, INSIDE = 5, 4, 3, 2, 1, 0, -1
NAMES, END = {PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", CLAUSE: "clause", WORD: "word", NONE: "inside a word", INSIDE: "inside a letter"}, "end"
_BLANK = np.array([ord(c) for c in SPACE], np.uint32)
#: Fixed value: marks that end a sentence, with the quotes and brackets that may follow, and marks inside one.
_BOUNDS = (
    (CLAUSE, re.compile(r"[,;:،、，；：]['\")\]’”]*(?=\s|$)\s?|[、，；：]")),
    (SENTENCE, re.compile(r"[.!?…।॥؟۔]+['\")\]’”»]*(?=\s|$)|[。！？]+[”」』]*")),
    (LINE, re.compile(r"\r\n?|[\n \x0b\x0c\x85]")),
    (PARAGRAPH, re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:\r\n?|\n)\s*| \s*")),
)


@dataclass(frozen=True)
class Limits:
    """Tokens of a piece at most, tokens repeated from the piece before, and how far from its target a cut looks for the strongest boundary."""

    most: int = 1024
    overlap: int = 64
    near: int = 96


def strengths(text: str, starts: np.ndarray) -> np.ndarray:
    """The strength of a cut before each token. starts: where tokens start, in bytes of the UTF-8 text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    heads = np.flatnonzero((raw & 0xC0) != 0x80)
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.isin(letters, _BLANK)
    turns = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    chars = np.full(len(heads) + 1, NONE, np.int8)
    chars[turns] = WORD
    for strength, pattern in _BOUNDS:
        ends = np.fromiter((m.end() for m in pattern.finditer(text)), np.int64)
        chars[ends] = np.maximum(chars[ends], strength)
    # white space after a sentence or a clause may go with either side
    opens = turns[blank[turns]]
    closes = turns[~blank[turns]]
    runs = np.searchsorted(closes, opens, "right")
    opens, runs = opens[runs < len(closes)], runs[runs < len(closes)]
    after = chars[opens]
    either = (after == SENTENCE) | (after == CLAUSE)
    chars[closes[runs[either]]] = np.maximum(chars[closes[runs[either]]], after[either])
    at = np.full(len(raw) + 1, INSIDE, np.int8)
    at[heads] = chars[:-1]
    at[len(raw)] = chars[-1]
    return at[starts]


def _choose(marks: np.ndarray, low: int, high: int, target: int, least: int) -> int | None:
    """The strongest cut in low..high with at least this strength, the one nearest to the target among equals."""
    if low > high:
        return None
    part = marks[low : high + 1]
    best = int(part.max())
    if best < least:
        return None
    at = np.flatnonzero(part == best) + low
    return int(at[np.argmin(np.abs(at - target))])


def cut(enc: Encoder, text: str, ids: np.ndarray, limits: Limits, trust: bool = False) -> list[tuple[int, int, int, int, str]]:
    """First and past-last token, start and end character, and what the piece ends at. A piece of a single new token isn't cut further, whatever its text alone has.

    trust: take it that each piece's own text is within the limit; if that is found true of all, the pieces are those that come without trust."""
    most, overlap = limits.most, limits.overlap
    ends = np.cumsum(enc.length[ids])
    starts = np.concatenate([[0], ends])
    marks = strengths(text, starts)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
    char = lambda token: int(char_of[starts[token]]) if token < len(ids) else int(char_of[-1]) + 1
    total, first, last, out = len(ids), 0, 0, []
    while True:
        room = total - first
        high, tries, least = min(first + most, total), 0, max(last, first + overlap) + 1
        while True:  # until the piece's own text is within the limit
            if high == total:
                end = total
            else:
                fewest = max(2, -(-(room - overlap) // (most - overlap)))
                target = first + -(-(room + (fewest - 1) * overlap) // fewest)
                target = min(target, high)
                low = max(least, min(total - (fewest - 1) * (most - overlap), high))
                close = max(low, target - limits.near), min(high, target + limits.near)
                # the end of a sentence or more near the target, or anywhere that takes no further piece; then any boundary
                end = _choose(marks, *close, target, SENTENCE) or _choose(marks, low, high, target, SENTENCE) or _choose(marks, *close, target, WORD)
                end = end or _choose(marks, least, high, target, WORD) or _choose(marks, low, high, target, NONE) or _choose(marks, least, high, target, NONE) or high
            a, b = char(first), char(end)
            over = 0 if trust else len(enc.encode([text[a:b]])[0]) - most
            if over <= 0 or end <= least:
                break
            # a token less makes the text shorter by about a token; after some tries in longer and longer steps
            tries += 1
            high = max(end - max(over, 1 << tries // 4), least)
        out.append((first, end, a, b, END if end >= total else NAMES[int(marks[end])]))
        if end >= total:
            return out
        last, first = end, max(end - overlap, 0)


def split_oversized(df: DataFrame, key: str, text: str, path: str = VOCABULARY, limits: Limits = Limits()) -> DataFrame:
    """key, piece_no, token_start, token_end, char_start, char_end, n_tokens, boundary, piece: the pieces of each text with more than the most tokens.

    boundary is what the piece ends at: paragraph, line, sentence, clause, word, inside a word, inside a letter, or end. Pieces after the first begin with the last `overlap` tokens of the one before. Null, empty and short texts give no rows. A
    character cut by a token border at a piece's start is shown whole. A map over the rows: nothing is shuffled."""
    kind = df.schema[key].dataType.simpleString()
    sent = ship(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, sent)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            # each token is at least one byte
            long = [i for i, t in enumerate(texts) if t and len(t) * 4 > limits.most and len(t.encode("utf-8", "surrogatepass")) > limits.most]
            flat, offsets = enc.encode([texts[i] for i in long])
            ids = {i: flat[offsets[k] : offsets[k + 1]] for k, i in enumerate(long) if offsets[k + 1] - offsets[k] > limits.most}
            found = {i: cut(enc, texts[i], own, limits, True) for i, own in ids.items()}
            # the pieces' own texts, all at once; a text with one that is too long is cut again, piece by piece
            sizes = np.diff(enc.encode([texts[i][a:b] for i, pieces in found.items() for _, _, a, b, _ in pieces])[1]) if found else []
            at = 0
            for i, pieces in found.items():
                if sizes[at : (at := at + len(pieces))].max() > limits.most:
                    pieces = cut(enc, texts[i], ids[i], limits)
                a = pd.DataFrame(pieces, columns=["token_start", "token_end", "char_start", "char_end", "boundary"])
                columns = [keys.take(pa.array([i] * len(a))), pa.array(range(len(a)), pa.int32()), *(pa.array(a[c].to_numpy(), pa.int64()) for c in a.columns[:4]), pa.array((a.token_end - a.token_start).to_numpy(), pa.int64()), pa.array(a.boundary.tolist(), pa.string()), pa.array([texts[i][x:y] for x, y in zip(a.char_start, a.char_end)])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "piece_no", *a.columns[:4], "n_tokens", "boundary", "piece"])

    schema = f"key {kind}, piece_no int, token_start bigint, token_end bigint, char_start bigint, char_end bigint, n_tokens bigint, boundary string, piece string"
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
