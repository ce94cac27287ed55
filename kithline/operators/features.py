"""Feature columns of candidate pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.functions import distance as D
from kithline.functions.batch import similarities
from kithline.functions.text import clean_pieces, count_pieces, full_name

#: Column pairs that are compared, and the name of the group of piece features for each.
COLUMN_PAIRS = (
    ("first_name1", "first_name2", "f1_f2"), ("last_name1", "last_name2", "l1_l2"), ("middle_name1", "middle_name2", "m1_m2"),
    ("full_name1", "full_name2", "fn1_fn2"), ("first_name1", "last_name2", "f1_l2"), ("first_name2", "last_name1", "f2_l1"),
)
PIECES = ("name_count1", "name_count2", "f_initial_match", "strdist", "detect", "exact_match")


def _compared(df: DataFrame, column_pairs: Sequence[tuple[str, str, str | None]], options: Sequence[str], pieces: bool) -> DataFrame:
    """df with the similarities of the column pairs and, with `pieces`, the piece features of their groups, from at most one Arrow crossing.

    Within a batch each distinct pair of texts is compared once, whatever columns it stands in, and so is each distinct pair of tokens.
    """
    slow = [m for m in options if m in D.BATCHED]
    names = list(dict.fromkeys(c for a, b, _ in column_pairs for c in (a, b)))
    at = {c: i for i, c in enumerate(names)}
    duos, width = [(at[a], at[b]) for a, b, _ in column_pairs], len(names)
    fields = [(f"s{i}_{m}", "double") for i in range(len(duos)) for m in slow]
    if pieces:
        fields += [(f"p{i}_{n}", t) for i in range(len(duos)) for n, t in (("f_initial_match", "long"), ("strdist", "double"), ("detect", "long"), ("exact_match", "long"))]

    def compute(*cols: pd.Series) -> pd.DataFrame:
        texts = [c.where(c.notna(), None).tolist() for c in cols]
        out: dict[str, object] = {}
        if slow:
            need: dict[tuple[str, str], int] = {}
            places = [[need.setdefault(xy, len(need)) if None not in xy else -1 for xy in zip(texts[a], texts[b])] for a, b in duos]
            got = similarities([x for x, _ in need], [y for _, y in need], slow)
            for m in slow:
                values = np.append(got[m], np.nan)  # place -1
                for i, p in enumerate(places):
                    out[f"s{i}_{m}"] = pd.array(np.where(np.isnan(v := values[p]), 0.0, v), dtype="Float64")
                    out[f"s{i}_{m}"][np.isnan(v)] = pd.NA
        if pieces:
            clean = texts[width:]
            todo = {xy for a, b in duos for xy in zip(clean[a], clean[b]) if any(x is not None and " " in x for x in xy)}
            words = sorted({(p, q) for x, y in todo if x and y for p in x.split(" ") if p for q in y.split(" ") if q})
            alike = dict(zip(words, similarities([p for p, _ in words], [q for _, q in words], ["osa"])["osa"].tolist())) if words else {}
            known = {xy: _pieces(*xy, alike) for xy in todo}
            for i, (a, b) in enumerate(duos):
                rows = [known.get(xy, (None,) * 4) for xy in zip(clean[a], clean[b])]
                for n, (f, t) in enumerate((("f_initial_match", "Int64"), ("strdist", "Float64"), ("detect", "Int64"), ("exact_match", "Int64"))):
                    out[f"p{i}_{f}"] = pd.array([r[n] for r in rows], dtype=t)
        return pd.DataFrame(out)

    def cleaned(c: str) -> Column:
        return clean_pieces(f"`{c}`")

    if fields:
        udf = F.pandas_udf(compute, ", ".join(f"{n} {t}" for n, t in fields))
        df_ = df.withColumn("_compared", udf(*[F.col(f"`{c}`") for c in names], *([cleaned(c) for c in names] if pieces else [])))
    else:
        df_ = df
    out = []
    for i, (a, b, _) in enumerate(column_pairs):
        for m in options:
            value = F.col("_compared")[f"s{i}_{m}"] if m in slow else D.distance(m, f"`{a}`", f"`{b}`")
            out.append(value.alias(f"{a}_{b}_{'soundex_cat' if m == 'soundex' else m + '_pct'}"))
    for i, (a, b, g) in enumerate(column_pairs if pieces else ()):
        own = lambda n, i=i: F.col("_compared")[f"p{i}_{n}"]
        values = {"name_count1": count_pieces(cleaned(a)), "name_count2": count_pieces(cleaned(b)), "f_initial_match": own("f_initial_match"), "strdist": 1 - own("strdist"), "detect": own("detect"), "exact_match": own("exact_match")}
        out += [values[p].alias(f"{g}_{p}") for p in PIECES]
    return df_.select(*[f"`{c}`" for c in df.columns], *out)


def name_stringdist(df: DataFrame, c1: str, c2: str, options: Sequence[str] = D.METHODS) -> DataFrame:
    """df with {c1}_{c2}_{method}_pct for each method, and {c1}_{c2}_soundex_cat.

    All of them in one projection with at most one Arrow crossing.  Null in either column gives null; so do two empty texts, except by jw (0).
    """
    return stringdist_matrix(df, [(c1, c2)], options)


def stringdist_matrix(df: DataFrame, column_pairs: Sequence[tuple[str, str]], options: Sequence[str] = D.METHODS) -> DataFrame:
    """name_stringdist of several column pairs at once, with one Arrow crossing for all."""
    unknown = set(options) - set(D.METHODS)
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return _compared(df, [(a, b, None) for a, b, *_ in column_pairs], options, False)


def _pieces(a: str | None, b: str | None, alike: dict[tuple[str, str], float]) -> tuple:
    """(initial matches, mean distance, containments, equal) of the token pairs that survive; see name_pieces."""
    left, right = (a or "").split(" "), (b or "").split(" ")
    pairs = [(x, y, 1 - alike[x, y]) for x in left if x for y in right if y]
    for side in (0, 1):  # nearest partners of each token text of one side, then of the other, ties kept
        least: dict[str, float] = {}
        for p in pairs:
            least[p[side]] = min(p[2], least.get(p[side], 9.0))
        pairs = [p for p in pairs if p[2] == least[p[side]]]
    for side in (0, 1):  # of equal ones the first
        seen: set[str] = set()
        pairs = [p for p in pairs if not (p[side] in seen or seen.add(p[side]))]
    if not pairs:
        return None, None, None, None
    initial = sum(min(len(x), len(y)) < 3 and x[: min(len(x), len(y))] == y[: min(len(x), len(y))] for x, y, _ in pairs)
    detect = sum(len(x) > 3 and len(y) > 3 and (x in y or y in x) for x, y, _ in pairs)
    return initial, sum(d for *_, d in pairs) / len(pairs), detect, sum(x == y for x, y, _ in pairs)


def name_pieces(df: DataFrame, c1: str, c2: str, group: str) -> DataFrame:
    """df with the six piece features {group}_{name_count1, name_count2, f_initial_match, strdist, detect, exact_match}.

    The tokens of both names are compared in all combinations within the row; kept are the nearest partners of each token text on the left, of those the
    nearest of each on the right, and of ties the first in order of position.  Where neither name has more than one token, or no pair is left,
    the last four are null.  Nothing is shuffled: a row's tokens never leave it, and distances are computed once per batch and distinct token pair.
    """
    return _compared(df, [(c1, c2, group)], (), True)


def feature_table(pairs: DataFrame, methods: Sequence[str] = D.METHODS) -> DataFrame:
    """pairs with full names, the 54 similarity columns and the 36 piece columns."""
    out = pairs.withColumns({f"full_name{i}": full_name(f"first_name{i}", f"middle_name{i}", f"last_name{i}") for i in (1, 2)})
    return _compared(out, COLUMN_PAIRS, methods, True)
