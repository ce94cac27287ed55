import random

import pytest

from kithline.llm import names as N
from kithline.llm import variants as V
from kithline.llm.names import Weights, compare, likeness, tokens

W = Weights({"john": 0.01, "mary": 0.01, "mark": 0.01, "smith": 0.002, "victoria": 0.01, "victor": 0.01}, 1e-4)


def score(a, b, m1="", m2=""):
    return compare(tokens(*a), tokens(*b), W, tokens(m1), tokens(m2))


@pytest.mark.parametrize("a,b,m1,m2", [
    (("peggy", "flundiville"), ("margaret", "flundivile"), "", ""), (("sloagayhow,", "irene"), ("irene", "sloagayhow"), "", ""), (("w.", "cheigason"), ("wendy", "cheigason"), "", ""),
    (("mr quentin", "baimagarth jr"), ("qeuntin", "baimagarth"), "", ""), (("hardware", "partners - jengevane"), ("jengevane", "hardware ptnrs"), "", ""), (("kather ine", "kneappooworth"), ("katherine", "kneappooworth"), "", ""),
    (("utd", "ins bros koutchouner"), ("koutchouner", "united insurance brothers"), "", ""), (("yvonne", "sleardofield"), ("irene", "sleardofield"), "irene", "yvonne"), (("vinny", "pammulin"), ("vincnet", "pammulin"), "", ""),
])
def test_same(a, b, m1, m2):
    assert score(a, b, m1, m2) >= 0.6


@pytest.mark.parametrize("a,b,m1,m2", [
    (("john", "doddaholm"), ("zelda", "doddaholm"), "", ""), (("victoria", "trapouness"), ("victor", "traoouness"), "", ""), (("mary", "doddaholm"), ("mark", "doddaholm"), "", ""), (("d", "flailfearoyd"), ("v", "flailfearoyd"), "", ""),
    (("ursula", "peameirick"), ("stella", "peameirick"), "s", ""), (("philip a", "jusseikin"), ("audrey", "jusseikin"), "", ""), (("john", ""), ("", ""), "", ""), (("-", "."), ("'", "?"), "", ""),
])
def test_different(a, b, m1, m2):
    assert score(a, b, m1, m2) < 0.6


def test_edits_against_brute_force():
    r = random.Random(4)
    from tests.test_distance import brute

    for _ in range(1500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in "ab")
        d = round((1 - brute("osa", a, b)) * max(len(a), len(b))) if a or b else 0
        assert min(N.edits(a, b, 3), 4) == min(d, 4), (a, b)
    assert likeness("a", "a") == 1.0


def test_prefix_filter_loses_nothing():
    r = random.Random(6)
    words = ["".join(r.choice("abcdef") for _ in range(r.randint(1, 8))) for _ in range(60)]
    order = {g: k for k, g in enumerate(r.sample(sorted(V.grams(words)), 20))}
    codes = V.Codes(order)
    made = [V.Name(r.sample(words, r.randint(1, 3)), codes, 0.3) for _ in range(200)]
    for x in made[:60]:
        for y in made:
            g, h = V.grams(x.words), V.grams(y.words)
            assert x.near(y) == (len(g & h) >= 0.3 * len(g | h))


def test_frequencies(spark):
    rows = [("john", "smith"), ("john", "smith"), ("mary", "smith"), ("john", None), ("", "")]
    heavy, shares, order = V.frequencies(spark.createDataFrame(rows, "f string, l string"), "f", "l")
    assert heavy == {} and shares["john"] == shares["smith"] == 0.5 and shares["mary"] == shares["nobody"] == 0.25
    assert set(order) == V.grams(["john", "mary", "smith"]) and order["^m"] > order["^j"] - 1 and order["^s"] > order["ar"]
    weights = Weights(heavy, 1e-4, shares=shares)
    assert weights.weigh("mary") > weights.weigh("john") > 0


def test_link_variants(spark):
    rows = [
        (1, "peggy", "flundiville", "margaret", "flundiville", "clash"), (1, "peggy", "flundiville", "margaret", "flundiville", "clash"), (2, "John", " Smith", "john", "smith", None), (3, "john", "brelbayell", "zelda", "brelbayell", ""),
        (4, None, None, "john", "smith", "x"), (5, None, "irene sloagayhow", "sloagayhow", "irene", "x"), (6, "", "", "", "", "x"), (7, "a" * 5000, "b", "a" * 5000, "c", "x"),
    ]
    df = spark.createDataFrame(rows, "pair_id int, f1 string, l1 string, f2 string, l2 string, similarity string")
    link = lambda d: V.link_variants(d, key="pair_id", left=("f1", "l1", None), right=("f2", "l2", None))
    assert sorted(r.pair_id for r in link(df).collect()) == [1, 1, 5]
    assert link(df.limit(0)).count() == 0


def test_one_edit_and_near_words_are_exact():
    r = random.Random(9)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(3, 6))) for _ in range(150)})
    w = Weights(dict.fromkeys(words[:80], 0.001), 1e-4)
    for x in words:
        assert all((N.edits(x, y, 1) <= 1) == (N.edits(x, y, 3) <= 1) for y in words)
        if x not in w.heavy and len(x) > 3:
            assert set(w.near(x)) == {x} | {y for y in {*w.heavy, *N.NICKNAMES, *N._FORMAL} if len(y) > 2 and y[0] == x[0] and N.edits(x, y, 3) <= 1}
        assert w.weigh(x) == w.weigh(x) == w._weigh(x)
