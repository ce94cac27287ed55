import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kithline.llm import merkle, quota, splits


def letters(x):
    return "".join(c for c in (x or "").lower() if c.isalnum()) or None


def copies_brute(rows):
    by = defaultdict(list)
    for k, e, a, b in rows:
        by[e, tuple(sorted(x for x in (letters(a), letters(b)) if x))].append(k)
    return by


@pytest.fixture()
def records():
    r = random.Random(8)
    forms = ["Ann", "a-nn", " ann ", "BOB", "bob.", None, "", "!", "Éa", "éA"]
    rows = [(i, r.choice(["x", "x", "x", "y", None]), r.choice(forms), r.choice(forms)) for i in range(400)]
    return rows + rows[:5]


@pytest.mark.parametrize("collide", [False, True])
@pytest.mark.parametrize("hot", [1_000_000, 10])
def test_copies(spark, records, monkeypatch, collide, hot):
    monkeypatch.setattr(merkle, "HOT", hot)
    monkeypatch.setattr(merkle, "SALT", 4)
    if collide:  # every record has the same digest; only the comparison of the trees tells them apart
        monkeypatch.setattr(merkle, "ordered", lambda *c: F.lit(1).cast("long"))
    df = spark.createDataFrame(records, "id int, e string, a string, b string").withColumn("_root", F.lit("clash"))
    collapsed, copies = merkle.collapse_copies(df, key="id", exact=["e"], free=["a", "b"])
    want = copies_brute(records)
    assert sorted((r.id, r.n_copies) for r in collapsed.collect()) == sorted((min(v), len(v)) for v in want.values())
    assert Counter((r.pair_id_a, r.pair_id_b) for r in copies.collect()) == Counter((min(v), k) for v in want.values() for k in v if k != min(v))


def test_copies_of_nothing(spark):
    df = spark.createDataFrame([], "id int, e string, a string")
    collapsed, copies = merkle.collapse_copies(df, key="id", exact=["e"], free=["a"])
    assert collapsed.count() == 0 and copies.count() == 0


def test_controlled_rounding():
    r = random.Random(9)
    for _ in range(60):
        rows, cols = r.randint(1, 6), r.randint(1, 9)
        t = {(i, j): r.random() * 4 for i in range(rows) for j in range(cols) if r.random() < 0.8}
        for i in range(rows):  # whole row margins
            own = [k for k in t if k[0] == i]
            s = sum(t[k] for k in own)
            for k in own:
                t[k] *= max(1, round(s)) / s
        got = quota.controlled_rounding(t)
        assert all(abs(got[k] - v) < 1 + 1e-6 for k, v in t.items())
        for i in range(rows):
            assert abs(sum(v for k, v in got.items() if k[0] == i) - sum(v for k, v in t.items() if k[0] == i)) < 1e-6
        for j in range(cols):
            assert abs(sum(v for k, v in got.items() if k[1] == j) - sum(v for k, v in t.items() if k[1] == j)) < 1 + 1e-6
    assert quota.controlled_rounding({}) == {}


def test_category_quotas():
    assert quota.category_quotas({"a": 100, "b": 100}, {"a": (0.5, 0), "b": (0.5, 0)}, 51) == {"a": 26, "b": 25}
    assert quota.category_quotas({"a": 100, "b": 3}, {"a": (0.5, 0), "b": (0.5, 0)}, 50) == {"a": 25, "b": 3}
    assert quota.category_quotas({"a": 100, "b": 100}, {"a": (0.9, 0), "b": (0.1, 20)}, 50) == {"a": 30, "b": 20}
    assert quota.category_quotas({}, {"a": (1.0, 5)}, 0) == {"a": 0}


def test_sample(spark):
    r = random.Random(10)
    rows = [(i, r.choice(["a"] * 6 + ["b"] * 3 + ["other", None]), f"s{r.randint(0, 3)}", "clash") for i in range(600)] + [(1000, "c", None, "x")]
    df = spark.createDataFrame(rows, "id int, category string, s string, _quota string")
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.4, 3), ("c", 0.1, 2), ("none", 0.0, 1)], "category string, target_share double, min_rows int")
    sample, report = quota.sample_to_targets(df, targets, key="id", stratum=F.col("s"))
    n = sum(x[1] is not None for x in rows) // 3
    got = sample.collect()
    by = {x.category: x for x in report.collect()}
    assert len({x.id for x in got}) == len(got) == round(0.9 * n) + 1 and sample.columns == df.columns
    assert abs(by["a"].drawn - n * 0.5) < 1 and by["b"].drawn == round(0.9 * n) - by["a"].drawn
    assert Counter(x.category for x in got) == {k: v.drawn for k, v in by.items() if v.drawn}
    assert not by["c"].met and by["c"].below_min and not by["none"].met and not by["a"].met and by["c"].drawn == 1
    assert abs(by["a"].off - (by["a"].drawn / len(got) - 0.5)) < 1e-9
    strata = Counter((x.category, x.s) for x in got)
    have = Counter((x[1], x[2]) for x in rows)
    for (c, s), k in strata.items():
        assert abs(k - by[c].drawn * have[c, s] / by[c].available) < 1 + 1e-6
    assert {x.id for x in quota.sample_to_targets(df.repartition(7), targets, key="id", stratum=F.col("s"))[0].collect()} == {x.id for x in got}
    # a finer stratum with more cells than one table may have: the same categories, each stratum at its share
    fine = F.concat("s", (F.col("id") % 3).cast("string"))
    parts, again = quota.sample_to_targets(df, targets, key="id", stratum=fine, max_cells=10)
    assert Counter(x.category for x in parts.collect()) == {k: v.drawn for k, v in by.items() if v.drawn} and sorted(again.collect()) == sorted(report.collect())
    many = Counter((x[1], x[2] and x[2] + str(x[0] % 3)) for x in rows)
    got_fine = Counter((x.category, x.s and x.s + str(x.id % 3)) for x in parts.collect())
    assert all(abs(k - by[c].drawn * many[c, s] / by[c].available) < 2 + 1e-6 for (c, s), k in got_fine.items())
    empty, rep = quota.sample_to_targets(df.limit(0), targets, key="id")
    assert empty.count() == 0 and rep.count() == 4


def test_splits(spark):
    r = random.Random(11)
    rows = [(i, r.choice([1] * 10 + [2] * 5 + list(range(3, 60)) + [None] * 8), r.choice(["m", "m", "n", None]), "clash") for i in range(800)]
    df = spark.createDataFrame(rows, "id int, phone int, category string, split string")
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.12), ("test", 0.18)], "split_name string, target_share double")
    assigned, report = splits.split_components(df, targets, component="phone", row_key="id", label="category", chains=3)
    got = assigned.collect()
    assert sorted(x.id for x in got) == list(range(800)) and assigned.columns == ["id", "phone", "category", "split"]
    by = defaultdict(set)
    for x in got:
        by[x.phone].add(x.split)
    assert all(len(v) == 1 for k, v in by.items() if k is not None) and len(by[None]) > 1
    for x in report.collect():
        assert abs(x.actual_share - x.target_share) < (0.01 if x.label == "all rows" else 0.03), x
    again = splits.split_components(df.repartition(5), targets, component="phone", row_key="id", label="category", chains=3)[0]
    assert {(x.id, x.split) for x in again.collect()} == {(x.id, x.split) for x in got}
    # groups of 30 units: the largest first, the others side by side, then the rest of the deviation
    dealt, report = splits.split_components(df, targets, component="phone", row_key="id", label="category", group=30)
    by = defaultdict(set)
    for x in dealt.collect():
        by[x.phone].add(x.split)
    assert all(len(v) == 1 for k, v in by.items() if k is not None)
    assert all(abs(x.actual_share - x.target_share) < (0.01 if x.label == "all rows" else 0.03) for x in report.collect())
    # as many labels as rows: none is merged with another
    many = splits.split_components(df.withColumn("category", F.col("id").cast("string")), targets, component="phone", row_key="id", label="category")[1]
    assert many.select("label").distinct().count() == 801
    none, rep = splits.split_components(df.limit(0), targets, component="phone", row_key="id", label="category", chains=1)
    assert none.count() == 0 and rep.count() == 0


def test_anneal_against_all_assignments():
    r = random.Random(3)
    for _ in range(6):
        units = [[(0, w / 100), (r.randint(1, 2), w / 100)] for w in (r.randint(1, 30) for _ in range(7))]
        goal = [[0.4, 0.2, 0.2], [0.3, 0.1, 0.2], [0.3, 0.2, 0.1]]

        def gap(at, units=units, goal=goal):
            have = [[0.0] * 3 for _ in goal]
            for u, a in zip(units, at):
                for d, x in u:
                    have[a][d] += x
            return [[h - g for h, g in zip(hs, gs)] for hs, gs in zip(have, goal)]

        total = lambda at: sum(abs(x) for g in gap(at) for x in g)
        best = min(map(total, itertools.product(range(3), repeat=7)))
        found = min(splits.anneal(units, gap([0] * 7), [0] * 7, seed, 3000) for seed in range(4))
        assert abs(found[0] - total(found[1])) < 1e-9 and found[0] <= best + 1e-9


def test_copies_of_nested_records(spark):
    kind = "id int, who struct<name:string,tags:array<string>,more:map<string,array<int>>>, seen array<struct<d:string,n:int>>"
    rows = [
        (1, ("Ann Li", ["a", "b!"], {"x": [1, 2]}), [("d1", 1), (None, 2)]), (2, ("ann-li", ["B", "A "], {"X": [2, 1]}), [("d1", 1), (None, 2)]),  # spelling and order within the loose column
        (3, ("Ann Li", ["a", "b"], {"x": [1, 2]}), [(None, 2), ("d1", 1)]),  # the exact column's order counts
        (4, ("Ann Li", ["a", "b", "b"], {"x": [1, 2]}), [("d1", 1), (None, 2)]), (5, ("Ann Li", ["a", None], {"x": [1, 2]}), [("d1", 1), (None, 2)]),
        (6, None, None), (7, None, None), (8, (None, None, None), None), (9, ("", [], {}), []),
    ]
    df = spark.createDataFrame(rows, kind)
    collapsed, copies = merkle.collapse_copies(df, key="id", exact=["seen"], free=[], loose=["who"])
    assert {(r.pair_id_a, r.pair_id_b) for r in copies.collect()} == {(1, 2), (6, 7)}
    assert {r.id: r.n_copies for r in collapsed.collect()} == {1: 2, 3: 1, 4: 1, 5: 1, 6: 2, 8: 1, 9: 1}


def test_splits_by_several_keys(spark):
    """Rows that share an author or a source, directly or through others, stay together; components against a search."""
    r = random.Random(5)
    rows = [(i, r.choice([None, *range(140)]), r.choice([None, *range(140)]), r.choice("xy")) for i in range(150)] + [(1000 + k, 500 + k, 500 + k + k % 2, "x") for k in range(0, 30)]
    df = spark.createDataFrame(rows, "id int, author int, source int, category string")
    targets = spark.createDataFrame([("train", 0.8), ("test", 0.2)], "split_name string, target_share double")
    got = {x.id: x.split for x in splits.split_components(df, targets, component=["author", "source"], row_key="id", label="category")[0].collect()}
    by, left = defaultdict(set), {x[0]: x for x in rows}
    for i, a, s, _ in rows:
        for k in (("a", a), ("s", s)):
            if k[1] is not None:
                by[k].add(i)
    while left:
        i, todo = next(iter(left)), set()
        todo = {i}
        members = set()
        while todo:
            j = todo.pop()
            members.add(j)
            _, a, s, _ = left.pop(j)
            todo |= {m for k in (("a", a), ("s", s)) for m in by.get(k, ()) if m in left}
        assert len({got[m] for m in members}) == 1
    assert set(got) == {x[0] for x in rows} and set(got.values()) == {"train", "test"}
    nodes = {x.node: x.component for x in splits.connected(df, ["author", "source"]).collect()}
    assert len(nodes) == len(by)
    assert splits.split_components(df.limit(0), targets, component=["author", "source"], row_key="id", label="category")[0].count() == 0
