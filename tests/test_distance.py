import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kithline.functions import distance as D
from kithline.functions.batch import similarities

ALL = ["lv", "osa", "dl", "lcs", "qgram", "cosine", "jw", "jw_floor"]
#: a, b, then lv, osa, dl, lcs, qgram, cosine, jw
GOLDEN = [
    ("johnathan", "jon", 0.3333, 0.3333, 0.3333, 0.3333, 0.3333, 0.5963, 0.7778),
    ("smith", "smyth", 0.8, 0.8, 0.8, 0.6, 0.6, 0.8, 0.8667),
    ("ca", "abc", 0.0, 0.0, 0.3333, 0.0, 0.6667, 0.8165, 0.0),
    ("martha", "marhta", 0.6667, 0.8333, 0.8333, 0.6667, 1.0, 1.0, 0.9444),
    ("ab", "xyz", 0.0, 0.0, 0.0, -0.6667, -0.6667, 0.0, 0.0),
    ("michael", "michael", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0),
]


def brute(method, a, b):
    n = max(len(a), len(b))
    if method in ("lv", "osa", "dl", "lcs"):
        d = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                if not i or not j:
                    d[i, j] = i + j
                    continue
                c = a[i - 1] != b[j - 1]
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (c if method != "lcs" else 2 * c))
                if method == "osa" and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
                if method == "dl":
                    for k in range(1, i):
                        for m in range(1, j):
                            if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]:
                                d[i, j] = min(d[i, j], d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        return 1 - d[len(a), len(b)] / n if n else math.nan
    ca, cb = Counter(a), Counter(b)
    if method == "qgram":
        return 1 - sum(abs(ca[x] - cb[x]) for x in ca | cb) / n if n else math.nan
    if method == "cosine":
        norm = math.sqrt(sum(v * v for v in ca.values()) * sum(v * v for v in cb.values()))
        return math.nan if not n else sum(ca[x] * cb[x] for x in ca) / norm if norm else 0.0
    used, hits, reach = set(), [], max(n // 2 - 1, 0)
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if j not in used and b[j] == x:
                used.add(j)
                hits.append(x)
                break
    m = len(hits)
    t = sum(x != b[j] for x, j in zip(hits, sorted(used)))
    t = t / 2 if method == "jw" else t // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3 if m else 0.0


def same(x, y):
    return (math.isnan(x) and math.isnan(y)) or abs(x - y) < 1e-9


def test_golden():
    got = similarities([g[0] for g in GOLDEN], [g[1] for g in GOLDEN], ALL)
    for i, g in enumerate(GOLDEN):
        for m, v in zip(["lv", "osa", "dl", "lcs", "qgram", "cosine", "jw"], g[2:]):
            assert abs(got[m][i] - v) < 6e-5, (m, g)


def test_random_pairs_against_brute_force():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdé😀") for _ in range(r.randint(0, 9)))
    a, b = [word() for _ in range(1500)], [word() for _ in range(1500)]
    got = similarities(a, b, ALL)
    for m in ALL:
        for i in range(len(a)):
            assert same(got[m][i], brute(m, a[i], b[i])), (m, a[i], b[i], got[m][i])


@settings(max_examples=150, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_properties(a, b):
    x, y = similarities([a], [b], ALL), similarities([b], [a], ALL)
    for m in ALL:
        assert same(x[m][0], y[m][0])
        if a == b and a:
            assert abs(x[m][0] - 1) < 1e-12
    if a or b:
        assert x["lv"][0] <= x["osa"][0] + 1e-12 <= x["dl"][0] + 2e-12
        assert -1 <= x["lcs"][0] <= 1 and -1 <= x["qgram"][0] <= 1 and -1e-9 <= x["cosine"][0] <= 1 + 1e-9


def test_columns_with_nulls_and_empty_texts(spark):
    df = spark.createDataFrame([("smith", "smyth"), (None, "jon"), ("", ""), ("", "a"), ("1abc", "abc")], "a string, b string")
    row = df.select(*[D.distance(m, "a", "b").alias(m) for m in [*D.METHODS, "hamming"]]).collect()
    assert row[0].soundex == "Strong Match" and abs(row[0].lv - 0.8) < 1e-9 and abs(row[0].jaccard - 2 / 3) < 1e-9 and row[0].hamming == 1
    assert all(v is None for v in row[1])
    assert row[2].osa is None and row[2].lv is None and row[2].jaccard is None and row[2].jw == 0.0 and row[2].hamming == 0
    assert row[3].lv == 0.0 and row[3].jaccard == 0.0 and row[3].hamming is None
    assert row[4].soundex is None


def test_soundex_dialects(spark):
    df = spark.createDataFrame([("ashcraft", "ashcroft"), ("johnathan", "jon")], "a string, b string")
    assert [r[0] for r in df.select(D.soundex_category("a", "b")).collect()] == ["Strong Match", "Weak Similar Match"]
    code = df.select(D._soundex_sqlite(F.col("a")), F.soundex("a")).first()
    assert tuple(code) == ("A226", "A261")


def test_token_predicates(spark):
    df = spark.createDataFrame([("j", "john"), ("(abc", "x(abcd"), ("ab", "abc"), (None, "a")], "a string, b string")
    rows = df.select(D.initial_match("a", "b"), D.detect_long("a", "b"), D.first_char_match("a", "b")).collect()
    assert [tuple(r) for r in rows] == [(True, False, True), (False, True, False), (True, False, True), (None, False, None)]


def test_long_texts():
    a, b = "ab" * 1500, "ba" * 1400
    got = similarities([a, "smith"], [b, "smyth"], ALL)
    assert abs(got["lv"][1] - 0.8) < 1e-9 and 0 < got["osa"][0] < 1 and got["osa"][0] <= got["dl"][0] and abs(got["qgram"][0] - (1 - 200 / 3000)) < 1e-9 and got["cosine"][0] > 0.999


def test_unknown_method():
    with pytest.raises(ValueError):
        similarities(["a"], ["b"], ["nope"])
