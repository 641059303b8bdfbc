"""Typed-in values to entries of a reference list.

Each distinct value is taken apart into words. Words and names of entries become sets of counted letters. An edit changes one
of them at most, so for a name that bears k edits the Jaccard similarity must be (larger - k) / (smaller + k) at least, and of
each set only the k + 1 rarest letters can decide: a prefix-filter join on these (ordered by rarity over both sides) finds the pairs, those
that cannot reach the threshold by length or position are dropped, and the rest is verified exactly: Jaccard, then edits. The
best entry of each word is kept; a value means an entry if all its words that mean one mean the same.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sonoplan.session import durable

#: Edits that a name may bear; each number is a class of names with a prefix of its own.
MOST_EDITS = 2
#: Rows up to which a map or list is broadcast; beyond that it is joined by shuffle.
BROADCAST_VALUES = 200_000
#: Characters typed for letters.
_LOOKALIKE = str.maketrans("1@0345$", "iaoeass")
_PARTS = re.compile(r"[^\w]+|_+")
_SPELLED = re.compile(r"^\w(?:[-. ]\w){2,}$")


def plain(text: str) -> str:
    """Lower case without accents on Latin letters, width variants and invisible characters."""
    out, latin = [], False
    for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold()):
        kind = unicodedata.category(c)
        if kind == "Cf" or kind == "Mn" and latin:
            continue
        latin = c < "ɐ" if kind != "Mn" else latin
        out.append(c)
    return unicodedata.normalize("NFC", "".join(out))


def words_of(value: str) -> list[str]:
    """Words of a typed value, marks of Indic scripts included; letters spelled out one by one make one word."""
    text = plain(value).strip()
    # marks are part of words
    if _SPELLED.match(text):
        return ["".join(re.findall(r"\w", text))]
    out, word = [], []
    for c in text + " ":
        if c.isalnum() or c in "@$" or unicodedata.category(c)[0] == "M":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return [w.translate(_LOOKALIKE) if any(x.isalpha() for x in w) else w for w in out]


def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours."""
    last, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            least = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if last is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, last[j - 2] + 1)
            new.append(least)
        last, row = row, new
    return row[-1]


def allowed(name: str) -> int:
    """Edits that a name of this length bears."""
    return 0 if len(name) < 4 else 1 if len(name) < 6 else 2


def grams(word: str) -> list[str]:
    """Letters, counted, with neighbours and next neighbours."""
    seen: dict[str, int] = {}
    for k in range(len(word)):
        seen[word[k]] = seen.get(word[k], 0) + 1
    framed = f"^{word}$"
    pairs = {f"{a}{b}" for a, b in zip(framed, framed[1:])} | {f"{a}_{b}" for a, b in zip(framed, framed[2:])}
    return sorted(pairs | {f"{c}#{k}" for c, n in seen.items() for k in range(1, n + 1)})


def _value_words(batches):
    for b in batches:
        rows = [(v, w, k, len(ws)) for v in b["typed"] for ws in [words_of(v)] for k, w in enumerate(ws)]
        yield pd.DataFrame(rows, columns=["typed", "word", "place", "n_words"]).astype({"place": "int32", "n_words": "int32"})


def letters(word: str) -> list[str]:
    """The word's letters, counted: a second a is another token than the first."""
    return [f"{c}{k}" for c, n in sorted(Counter(word).items()) for k in range(1, n + 1)]


def _letter_sets(batches):
    for b in batches:
        yield pd.DataFrame({"word": b["word"], "tokens": [letters(w) for w in b["word"]], "bears": pd.array([allowed(w) for w in b["word"]], "int32")})


def _small(kept: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it is short."""
    return F.broadcast(kept) if kept.count() <= BROADCAST_VALUES else kept


def similar_words(words: DataFrame, names: DataFrame) -> DataFrame:
    """word, name, jaccard: all pairs whose sets of letters are as similar as a word within the edits that the name bears must be. Both tables have a column word of distinct words."""
    shape = "word string, tokens array<string>, bears int"
    left, right = durable(words.select("word").mapInPandas(_letter_sets, shape)), durable(names.select("word").mapInPandas(_letter_sets, shape))
    rarity = left.unionByName(right).select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    def ordered(side: DataFrame) -> DataFrame:
        ranked = side.select("word", "bears", F.explode("tokens").alias("token")).join(rarity, "token")
        return ranked.groupBy("word", "bears").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t")).select("word", "bears", F.size("t").alias("n"), F.transform("t", lambda x: x["token"]).alias("t"))

    def prefixes(side: DataFrame, tag: str) -> DataFrame:
        """The first k + 1 letters for k edits: one of them is shared by any two sets that miss at most k of the larger."""
        return side.select(F.col("word").alias(f"word_{tag}"), F.col("n").alias(f"n_{tag}"), "k", F.posexplode(F.slice("t", F.lit(1), F.col("k") + 1)).alias(f"at_{tag}", "token"))

    a = prefixes(ordered(left).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(MOST_EDITS)))), "a")
    b = prefixes(ordered(right).withColumn("k", F.col("bears")), "b")
    length = F.abs(F.col("n_a") - F.col("n_b")) <= F.col("k")
    position = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= F.greatest("n_a", "n_b") - F.col("k")
    # the first common letter of two prefixes decides; later ones would only repeat the pair
    met = a.join(_small(durable(b)), ["k", "token"]).where(length).groupBy("word_a", "word_b", "k").agg(F.min_by(F.struct("n_a", "n_b", "at_a", "at_b"), "at_a").alias("m")).select("word_a", "word_b", "k", "m.*").where(position)
    both = met.join(left.select(F.col("word").alias("word_a"), F.col("tokens").alias("tokens_a")), "word_a").join(_small(right.select(F.col("word").alias("word_b"), F.col("tokens").alias("tokens_b"))), "word_b")
    jaccard = F.size(F.array_intersect("tokens_a", "tokens_b")) / F.size(F.array_union("tokens_a", "tokens_b"))
    least = (F.greatest("n_a", "n_b") - F.col("k")) / (F.least("n_a", "n_b") + F.col("k"))
    return both.select(F.col("word_a").alias("word"), F.col("word_b").alias("name"), jaccard.alias("jaccard"), least.alias("least")).where("jaccard >= least - 1e-9").drop("least")


def _verified(batches):
    """Pairs within the edits that the name bears, with the Jaccard similarity of their grams, which tells places apart too."""
    for b in batches:
        pairs = list(zip(b["word"], b["name"]))
        apart = [edits(w, n) for w, n in pairs]
        alike = [len(x & y) / len(x | y) for w, n in pairs for x, y in [(set(grams(w)), set(grams(n)))]]
        fine = [d <= allowed(n) for d, (_, n) in zip(apart, pairs)]
        yield b.assign(apart=pd.array(apart, "int32"), jaccard=pd.array(alike, "float64"))[fine]


def meanings(values: DataFrame, entries: DataFrame, code: str, codes: list[str], name: str, others: str) -> DataFrame:
    """typed, code: what each distinct value means, `none` where it means no entry or different ones.

    entries: the list, with its key, further codes, a name and an array of other names. A code counts where it stands alone,
    with a two-letter region, or beside a name. Ties between entries mean none of them."""
    named = entries.select(F.col(code).alias("code"), F.explode(F.array_compact(F.concat(F.array(F.col(name)), F.coalesce(F.col(others), F.array().cast("array<string>"))))).alias("typed"))

    def forms(batches):
        for b in batches:
            yield pd.DataFrame([(c, w) for c, v in zip(b["code"], b["typed"]) for w in ["".join(words_of(v))] if w], columns=["code", "word"])

    names = durable(named.mapInPandas(forms, "code string, word string").distinct())
    parted = durable(values.select("typed").mapInPandas(_value_words, "typed string, word string, place int, n_words int"))
    vocabulary = parted.select("word").distinct()
    pairs = similar_words(vocabulary, names.select("word").distinct())
    checked = pairs.mapInPandas(_verified, "word string, name string, jaccard double, apart int").join(names.withColumnRenamed("word", "name"), "name")
    best = checked.groupBy("word", "code").agg(F.min(F.struct(F.col("apart"), (-F.col("jaccard")).alias("j"))).alias("score"))
    first = best.withColumn("r", F.rank().over(W.partitionBy("word").orderBy("score"))).where("r = 1").groupBy("word").agg(F.min("code").alias("name_code"), F.count(F.lit(1)).alias("ties")).where("ties = 1").drop("ties")
    short = entries.select(F.col(code).alias("short_code"), F.explode(F.array_distinct(F.array_compact(F.array(*(F.lower(F.col(c)) for c in [code, *codes]))))).alias("word")).dropDuplicates(["word"])
    known = parted.join(first, "word", "left").join(short, "word", "left")
    of_value = known.groupBy("typed", "n_words").agg(
        F.array_sort(F.collect_set("name_code")).alias("by_name"), F.array_sort(F.collect_set(F.when(F.col("name_code").isNull(), F.col("short_code")))).alias("by_code"),
        F.max(F.when((F.col("place") == 0), F.col("short_code"))).alias("leading"), F.max(F.when(F.col("place") == 1, F.length("word"))).alias("region"), F.max(F.when(F.col("short_code").isNotNull(), F.length("word"))).alias("long"),
    )
    by_name, by_code = F.col("by_name"), F.col("by_code")
    every = F.array_union(by_name, by_code)
    alone = (F.col("n_words") == 1) | ((F.col("n_words") == 2) & (F.col("region") == 2))
    sole = F.when(F.size(by_name) == 0, F.when(alone, F.col("leading")).when((F.size(by_code) == 1) & (F.col("n_words") == 2), by_code[0]))
    paired = F.when(F.size(by_name) == 1, F.when((F.col("n_words") == 2) & (F.size(every) > 1), F.lit(None)).otherwise(by_name[0]))
    decided = of_value.select("typed", F.coalesce(sole, paired).alias("code"))
    return values.select("typed").join(decided, "typed", "left").select("typed", F.coalesce("code", F.lit("none")).alias("code"))


def canonical(rows: DataFrame, entries: DataFrame, code: str, codes: list[str], name: str, others: str) -> DataFrame:
    """rows (with a column typed) with code, the entry meant, `none` if unmatched, and exact, whether the value is the entry's very name; null stays null. Exact names are found without the join."""
    exact = _small(durable(entries.where(F.col(name).isNotNull()).select(F.col(name).alias("__name"), F.col(code).alias("__code")).dropDuplicates(["__name"])))
    open_ = rows.where("typed IS NOT NULL").select("typed").distinct().join(exact, F.col("typed") == F.col("__name"), "left_anti")
    found = _small(durable(meanings(durable(open_), entries, code, codes, name, others).select(F.col("typed").alias("__typed"), F.col("code").alias("__found"))))
    both = rows.join(exact, F.col("typed") == F.col("__name"), "left").join(found, F.col("typed") == F.col("__typed"), "left")
    return both.withColumns({"code": F.coalesce("__code", "__found"), "exact": F.when(F.col("typed").isNotNull(), F.col("__name").isNotNull())}).drop("__name", "__code", "__typed", "__found")
