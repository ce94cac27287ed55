"""Similarity expressions of two string columns.

What Spark has is used as it is (levenshtein, soundex, array operations); the other methods share one Arrow UDF
per column pair, which computes all of them for a batch with array programs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from kithline.functions.batch import similarities
from kithline.functions.text import col, pairwise_max, pairwise_min

#: All methods, in the order of the feature table.
METHODS = ("osa", "lv", "dl", "lcs", "qgram", "cosine", "jaccard", "jw", "soundex")
#: Methods that the Arrow UDF computes.
BATCHED = ("osa", "dl", "lcs", "qgram", "cosine", "jw", "jw_floor")
#: Categories by the number of equal positions of two Soundex codes.
SOUNDEX_CATEGORIES = ("No Match", "Weak Match", "Weak Similar Match", "Similar Match", "Strong Match")


def batched(a: Column | str, b: Column | str, methods: Sequence[str]) -> Column:
    """A struct with a similarity by each method; its fields are null where a value is null or both are empty."""
    methods = tuple(methods)

    @F.pandas_udf(", ".join(f"{m} double" for m in methods))
    def compute(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        ok = (x.notna() & y.notna()).to_numpy()
        got = similarities(x[ok].tolist(), y[ok].tolist(), methods)
        out = {m: np.full(len(x), np.nan) for m in methods}
        for m in methods:
            out[m][ok] = got[m]
        return pd.DataFrame(out).astype(object).where(lambda d: d.notna(), None)

    return compute(col(a), col(b))


def longer(a: Column | str, b: Column | str) -> Column:
    return pairwise_max(F.char_length(col(a)), F.char_length(col(b)))


def lv(a: Column | str, b: Column | str) -> Column:
    return 1 - F.try_divide(F.levenshtein(col(a), col(b)).cast("double"), longer(a, b).cast("double"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of the sets of letters."""
    x, y = F.split(col(a), ""), F.split(col(b), "")
    return F.when((F.char_length(col(a)) > 0) | (F.char_length(col(b)) > 0), F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")))


def soundex_difference(a: Column | str, b: Column | str, dialect: str = "standard") -> Column:
    """Equal positions, 0..4, of the two Soundex codes; null where a value has no code (it doesn't begin with a letter).

    dialect "sqlite": H and W separate equal codes as vowels do.
    """
    code = F.soundex if dialect == "standard" else _soundex_sqlite
    x, y = code(col(a)), code(col(b))
    equal = sum((F.substring(x, i, 1) == F.substring(y, i, 1)).cast("int") for i in range(1, 5))
    return F.when((F.char_length(x) == 4) & (F.char_length(y) == 4) & x.rlike("^[A-Z][0-9]{3}$") & y.rlike("^[A-Z][0-9]{3}$"), equal)


def _soundex_sqlite(c: Column) -> Column:
    up = F.upper(c)
    code = F.translate(up, "BFPVCGJKQSXZDTLMNRAEIOUYHW", "11112222222233455600000000")
    kept = F.regexp_replace(F.regexp_replace(F.regexp_replace(code, r"([0-9])\1+", "$1"), "^.", ""), "0", "")
    return F.when(up.rlike("^[A-Z]"), F.concat(F.substring(up, 1, 1), F.rpad(F.substring(kept, 1, 3), 3, "0")))


def soundex_category(a: Column | str, b: Column | str, dialect: str = "standard") -> Column:
    d = soundex_difference(a, b, dialect)
    out = F.when(d == 0, SOUNDEX_CATEGORIES[0])
    for i, name in enumerate(SOUNDEX_CATEGORIES[1:], 1):
        out = out.when(d == i, name)
    return out


def hamming(a: Column | str, b: Column | str) -> Column:
    """Positions that differ; null for texts of different lengths."""
    x, y = F.split(col(a), ""), F.split(col(b), "")
    n = F.aggregate(F.zip_with(x, y, lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(F.char_length(col(a)) == F.char_length(col(b)), F.when(F.char_length(col(a)) == 0, 0).otherwise(n))


def distance(method: str, a: Column | str, b: Column | str) -> Column:
    """Similarity by one of METHODS (a category for soundex), or hamming."""
    if method in BATCHED:
        return batched(a, b, [method])[method]
    return {"lv": lv, "jaccard": jaccard, "soundex": soundex_category, "hamming": hamming}[method](a, b)


def normalised_osa(a: Column | str, b: Column | str) -> Column:
    """Optimal string alignment distance divided by the longer length."""
    return 1 - distance("osa", a, b)


def detect_long(a: Column | str, b: Column | str) -> Column:
    """Whether one text contains the other, both having more than three letters; the texts are taken literally."""
    return (F.char_length(col(a)) > 3) & (F.char_length(col(b)) > 3) & (F.contains(col(a), col(b)) | F.contains(col(b), col(a)))


def first_char_match(a: Column | str, b: Column | str) -> Column:
    return F.substring(col(a), 1, 1) == F.substring(col(b), 1, 1)


def initial_match(a: Column | str, b: Column | str) -> Column:
    """Whether the shorter text has one or two letters and the other begins with it."""
    n = pairwise_min(F.char_length(col(a)), F.char_length(col(b)))
    return (n < 3) & (F.substring(col(a), F.lit(1), n) == F.substring(col(b), F.lit(1), n))
