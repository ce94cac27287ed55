"""Variant spellings of names typed by people.

A set-similarity join on token q-grams with a prefix filter, verified by soft weighted token similarity.  The two names that are
held against each other stand in one row (a candidate pair), so the join is co-located: the prefixes, in the order of all q-grams by their frequency in all names, meet
within the row, and no shuffle brings names together, however many rows a phone number has.  What is shuffled is counts: of tokens, and from these of q-grams.
Tables that go to all tasks have a fixed size: the frequencies of tokens are kept in slots by hash, and of q-grams the most frequent ones; those that aren't listed come
first in the order, as the rarest.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.llm.merkle import field_letters
from kithline.llm.names import SHORT, Weights, compare, formal, tokens
from kithline.operators.skew import cut_lineage

#: A token that stands in at least this share of the names is frequent; a name has few tokens, so there are some 10,000 of them at most.  They are what a misspelt
#: token may be a misspelling of.
FREQUENT = 1e-4
#: Least number of names for a frequent token.
SUPPORT = 8
#: Slots for the frequencies of tokens, and most q-grams whose place in the order is told.
SLOTS, GRAMS = 1 << 18, 100_000


def token_words(*fields: str) -> Column:
    """Distinct tokens as names.tokens makes them, as a column: the same rule within the JVM, for counting."""
    text = F.lower(F.concat_ws(" ", *fields))
    text = F.regexp_replace(F.regexp_replace(text, r"'", ""), r"[&+]", " and ")
    return F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != ""))


class Shares:
    """Share of the names that have a token, for all tokens: exact but for tokens that share a slot, which are seen as frequent as both together."""

    def __init__(self, counts: np.ndarray, names: int):
        self.shares, self.least, self.known = counts / max(1, names), 1 / max(1, names), {}

    def __getitem__(self, t: str) -> float:
        if t not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[t] = max(self.least, float(self.shares[xxhash.xxh64_intdigest(t.encode(), 42) % len(self.shares)]))
        return self.known[t]


def frequencies(names: DataFrame, first: str, last: str) -> tuple[dict[str, float], Shares, dict[str, int]]:
    """(share of the distinct names that have it, for each frequent token; shares of all tokens; place of each q-gram in the order, the rarest first)."""
    distinct = names.select(F.lower(first).alias("f"), F.lower(last).alias("l")).distinct()
    words = F.array_append(token_words("f", "l"), F.lit(""))  # the empty word counts the names
    count = cut_lineage(distinct.select(F.explode(words).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("k")))
    n = next((r.k for r in count.where("t = ''").collect()), 1)
    tokens_ = count.where("t <> ''")
    heavy = {r.t: r.k / n for r in tokens_.where((F.col("k") >= FREQUENT * n) & (F.col("k") >= SUPPORT)).collect()}
    slots = np.zeros(SLOTS)
    for s, k in tokens_.groupBy(F.pmod(F.xxhash64("t"), F.lit(SLOTS)).alias("s")).agg(F.sum("k").alias("k")).collect():
        slots[s] = k
    marked = F.concat(F.lit("^"), "t", F.lit("$"))
    gram = tokens_.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("t") + 1), lambda i: F.substring(marked, i, F.lit(2)))).alias("g"), "k")
    common = gram.groupBy("g").agg(F.sum("k").alias("k")).orderBy(F.desc("k"), "g").limit(GRAMS).collect()
    return heavy, Shares(slots, n), {r.g: len(common) - i for i, r in enumerate(common)}


def grams(words: Sequence[str], q: int = 2) -> set[str]:
    return {p[i : i + q] for w in words for p in (f"^{w}$",) for i in range(len(p) - q + 1)}


def spelled(word: str) -> Sequence[str]:
    """The words whose q-grams stand for a token: what a nickname or an abbreviation is short for, else itself."""
    return sorted(formal(word)) or (SHORT.get(word, word),)


class Codes(dict):
    """For each token the numbers of its q-grams, which ascend in the order: those that aren't listed are negative, and no two q-grams have one."""

    def __init__(self, order: Mapping[str, int]):
        super().__init__()
        self.order = order

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        get = self.order.get
        self[word] = out = tuple([get(x) or -1 - int.from_bytes(x.encode("utf-32-le")) for x in grams(spelled(word))])
        return out


class Name:
    """A name's tokens and, made when they're first needed, the set of their q-grams (as numbers) and that set's prefix: the rarest members, of which
    similar sets share one."""

    __slots__ = ("words", "codes", "least", "grams", "prefix")

    def __init__(self, words: Sequence[str], codes: Codes, least: float):
        self.words, self.codes, self.least, self.grams = words, codes, least, None

    def fill(self) -> None:
        self.grams = {c for w in self.words for c in self.codes[w]}
        order = sorted(self.grams)
        self.prefix = set(order[: len(order) - ceil(self.least * len(order)) + 1])

    def near(self, other: Name) -> bool:
        """Whether the Jaccard similarity of the q-grams is at least `least`."""
        if self.grams is None:
            self.fill()
        if other.grams is None:
            other.fill()
        if self.prefix.isdisjoint(other.prefix):
            return False
        both = len(self.grams & other.grams)
        return both >= self.least * (len(self.grams) + len(other.grams) - both)


def link_variants(
    rows: DataFrame, *, key: str, left: tuple[str, str, str | None], right: tuple[str, str, str | None], least_grams: float = 0.2, least_similarity: float = 0.6, variants_only: bool = True
) -> DataFrame:
    """key, similarity: the rows whose two names mean the same person or organisation.

    left, right: columns of first, last and (or None) middle name.  least_grams: Jaccard similarity of the q-gram sets below which names are
    not held against each other.  least_similarity: see names.compare.  variants_only: leave out rows whose first names and last names
    have the same letters and digits.

    A row in which a side has no letters links nothing.  Repeated rows are all returned.  Long names are compared whole.
    """
    sides = rows.select(F.col(left[0]).alias("f"), F.col(left[1]).alias("l")).unionByName(rows.select(F.col(right[0]).alias("f"), F.col(right[1]).alias("l")))
    shared = rows.sparkSession.sparkContext.broadcast(frequencies(sides, "f", "l"))
    text = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    picked = rows.select(F.col(key).alias("k"), *[text(c).alias(f"{n}{i}") for i, side in ((1, left), (2, right)) for n, c in zip("flm", side)])
    if variants_only:
        picked = picked.where(~(field_letters("f1").eqNullSafe(field_letters("f2")) & field_letters("l1").eqNullSafe(field_letters("l2"))))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, shares, order = shared.value
        weights, codes = Weights(heavy, FREQUENT, shares=shares), Codes(order)
        name = lru_cache(maxsize=50_000)(lambda f, l: Name(tokens(f, l), codes, least_grams))
        middle = lru_cache(maxsize=50_000)(lambda m: tuple(tokens(m)))
        for x in batches:
            keys, found = x.column("k"), []
            for i, (f1, l1, m1, f2, l2, m2) in enumerate(zip(*[x.column(c).to_pylist() for c in ("f1", "l1", "m1", "f2", "l2", "m2")])):
                a, b = name(f1, l1), name(f2, l2)
                if a.near(b) and (s := compare(a.words, b.words, weights, middle(m1), middle(m2))) >= least_similarity:
                    found.append((i, s))
            yield pa.record_batch([keys.take(pa.array([i for i, _ in found], pa.int64())), pa.array([s for _, s in found], pa.float64())], names=[key, "similarity"])

    return picked.mapInArrow(verify, f"`{key}` {rows.schema[key].dataType.simpleString()}, similarity double")
