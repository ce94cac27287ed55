import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kithline.functions import text
from kithline.operators import evaluate, features, pairs, prepare, reshape, sampling, skew


def test_text(spark):
    df = spark.createDataFrame([("john", None, "smith"), ("john", "", "smith"), ("ann", "b", None)], "f string, m string, l string")
    assert [r[0] for r in df.select(text.full_name("f", "m", "l")).collect()] == ["john smith", "john smith", "ann b"]
    assert df.select(text.full_name("f", "m", "l", glue_empty=True)).collect()[1][0] == "johnsmith"
    assert df.select(text.full_name("f", "m", "l", na_literal=True)).collect()[2][0] == "ann b NA"
    one = spark.createDataFrame([("a    b", "a   b", "mary-ann_o.")], "x string, y string, z string")
    r = one.select(text.delete_double_spaces("x"), text.delete_double_spaces("y"), text.clean_pieces("z"), text.count_pieces(text.clean_pieces("z")), text.tenth(F.lit(0.25)), text.tenth(F.lit(0.75)), text.parse_date(F.lit("13/45/1890"))).first()
    assert tuple(r) == ("ab", "a b", "mary ann o ", 4, 0.2, 0.8, None)


def test_pieces(spark):
    rows = [("john michael", "michael john"), ("john john paul", "paul jon john"), ("john", "jon"), ("j smith", "john smith"), (None, "a b"), ("", "x y")]
    out = features.name_pieces(spark.createDataFrame(rows, "a string, b string"), "a", "b", "g").collect()
    got = [(r.g_name_count1, r.g_name_count2, r.g_exact_match, r.g_strdist, r.g_f_initial_match, r.g_detect) for r in out]
    assert got == [(2, 2, 2, 1.0, 0, 2), (3, 3, 2, 1.0, 0, 2), (1, 1, None, None, None, None), (2, 2, 1, 0.625, 1, 1), (0, 2, None, None, None, None), (1, 2, None, None, None, None)]


def test_feature_table_has_ninety_columns(spark):
    df = spark.createDataFrame([("a", "b", "c", "a", "b", "c", "Match"), (None, None, "x", "y", None, None, None)], "first_name1 string, middle_name1 string, last_name1 string, first_name2 string, middle_name2 string, last_name2 string, category string")
    out = features.feature_table(df)
    assert len(out.columns) == 7 + 2 + 90 and out.count() == 2
    assert features.feature_table(df.limit(0)).count() == 0


def test_reshape(spark):
    assert reshape.camel_name("iPhoneListing1FirstName") == "phone_listing1_first_name"
    assert reshape.marked_name("TloSubject1NameFirstName") == "subject1_name_first_name"
    assert reshape.dotted_name("First.Name") == "first_name"
    df = spark.createDataFrame([(1, "a", None, "x", 1), (2, None, None, None, 2)], "k int, n1 string, n2 string, m1 string, s2 int")
    out = reshape.unpivot_groups(df, ["k"], {"g1": {"n": "n1", "m": "m1"}, "g2": {"n": "n2", "s": "s2"}}, "tag", ["n", "m"]).collect()
    assert [tuple(r) for r in out] == [(1, "g1", "a", "x", None)]
    with pytest.raises(ValueError):
        reshape.rename_columns(df, lambda c: "same")


def test_address_sentinel(spark):
    rows = [
        (1, "a", 1, 1, None, None), (2, "b", 1, 1, "road", None), (2, "b", 1, 2, "lane", None), (None, "c", 2, 1, None, None),
        # two subjects with one record each: both rows name both; a third with two records keeps them
        (3, "d", 1, 1, "hill", "x"), (3, "d", 2, 4, None, None), (3, "d", 4, 1, "dale", None), (3, "d", 4, 2, None, None),
        # the same record under two address tags is one record, and one row in the end
        (4, "e", 5, 1, "moor", None), (4, "e", 5, 2, "moor", None),
    ]
    out = reshape.address_sentinel(spark.createDataFrame(rows, "p int, n string, s int, t int, full string, seen string"), ["p", "n"], "s", "t", ["full", "seen"])
    none = reshape.NO_ADDRESS
    assert none == "**No Address Information Provided for this Phone Number and Name**"
    assert Counter((r.p, r.s, r.t, r.full, r.seen) for r in out.collect()) == Counter([
        (1, "tu_subject1", "tu_address1-10", none, None), (2, "tu_subject1", "tu_address1", "road", None), (2, "tu_subject1", "tu_address2", "lane", None), (None, "tu_subject2", "tu_address1-10", none, None),
        (3, "tu_subject1, 2", "tu_address1-10", none, "x"), (3, "tu_subject1, 2", "tu_address1-10", none, None), (3, "tu_subject4", "tu_address1", "dale", None), (4, "tu_subject5", "tu_address1-10", none, None),
    ])


def test_block_pairs_against_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice([1, 1, 1, 2, 3, None]), f"f{i}", r.choice([None, "m"]), f"l{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "phone_number int, first_name string, middle_name string, last_name string")
    for safe in (False, True):
        got = Counter((x.first_name1, x.first_name2) for x in pairs.block_pairs(df, df, null_safe=safe, hot_share=0.1).collect())
        assert got == Counter((a[1], b[1]) for a in rows for b in rows if (a[0] == b[0] and (a[0] is not None or safe)))
    assert pairs.block_pairs(df.limit(0), df).count() == 0
    links = {x.first_name: x.n_links for x in pairs.link_counts(df, df).collect()}
    assert links == {a[1]: sum(a[0] is not None and a[0] == b[0] for b in rows) for a in rows} and pairs.link_counts(df.limit(0), df).count() == 0


def test_hot_keys_are_carried_few_times(spark):
    """A key that holds all rows was carried once on the left and 100 times on the right."""
    df = spark.range(400).selectExpr("int(1) as phone_number", "string(id) as first_name", "'m' as middle_name", "'l' as last_name")
    a, b = pairs._celled(df, df, "phone_number", False, 0.01)
    assert a.count() + b.count() <= 400 * 2 * 5 and a.select("_cell").distinct().count() == b.select("_cell2").distinct().count() > 8
    got = pairs.block_pairs(df, df, hot_share=0.01).select("first_name1", "first_name2")
    assert got.count() == got.distinct().count() == 160_000


def test_pairs_among_shuffles_rows_once(spark, monkeypatch):
    """Each table was shuffled to make its names distinct and again for each side of each join that it was in."""
    r = random.Random(2)
    some = lambda n: [(r.choice([1, 1, 1, 2, 3, None]), f"f{r.randrange(20)}", r.choice([None, "m", ""]), f"l{r.randrange(2)}") for _ in range(n)]
    rows = [some(60), some(50), some(40)]
    tables = [spark.createDataFrame(x, "phone_number int, first_name string, middle_name string, last_name string") for x in rows]
    for which in ([(0, 1), (0, 2), (1, 2)], [(0, 0), (1, 1)], [(0, 0), (0, 1), (2, 0)]):
        for chunk, share in ((100_000, 0.1), (100_000, 0.9), (7, 0.1)):
            monkeypatch.setattr(pairs, "CHUNK", chunk)
            got = Counter(tuple(x) for x in pairs.pairs_among(tables, which, distinct=True, hot_share=share).collect())
            assert got == Counter((*x, *y[1:]) for a, b in which for x in set(rows[a]) for y in set(rows[b]) if x[0] == y[0] is not None)
    assert pairs.pairs_among([tables[0].limit(0), tables[1]], [(0, 1), (0, 0)]).count() == 0
    df = spark.range(400).selectExpr("int(1) as phone_number", "string(id) as first_name", "'m' as middle_name", "'l' as last_name")
    monkeypatch.setattr(pairs, "CHUNK", 100_000)
    cells = pairs._chunked([df], [(0, 0)], "phone_number", 0.01, 16)
    assert cells.count() <= 400 * 6 and cells.select("_cell").distinct().count() >= 16
    for which in ([(0, 0), (1, 1)], [(0, 1), (0, 2), (1, 2)]):  # the left and the right side are one exchange, also where a table is on one side only
        many = pairs.pairs_among(tables[: 1 + max(map(max, which))], which, distinct=True)
        many.collect()
        plan = many._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        assert [sum("REPARTITION_BY_NUM" in x and ("Reused" in x) == reused for x in plan.splitlines()) for reused in (False, True)] == [1, 1]


def test_masks(spark):
    df = spark.createDataFrame([(5551234567,), (5551234568,), (None,)], "p long")
    m = df.select("p", pairs.mask_key("p", "s").alias("m")).collect()
    assert m[2].m is None and all(10**9 <= r.m < 10**10 and r.m != r.p for r in m[:2]) and m[0].m != m[1].m
    mapped = pairs.mask_map([df], "p", "s")
    assert pairs.mask_collisions(mapped).count() == 0 and pairs.checked_mask_map(mapped, "p").count() == 2
    # ten digits are permuted: a dense range has no collision
    assert spark.range(9_999_950_000, 10_000_000_000).select(pairs.mask_key("id", "s").alias("m")).where("m between 1000000000 and 9999999999").distinct().count() == 50_000
    two = df.withColumn("extra", F.lit("x"))
    out = pairs.apply_mask(two, mapped.where("p = 5551234567"), "p")
    assert out.columns == two.columns and Counter(r.p is None for r in out.collect()) == Counter({True: 2, False: 1})
    for bad in ([(1, 1234567890), (2, 1234567890)], [(1234567890, 1234567890)], [(1, 12)]):
        with pytest.raises(Exception, match="proper"):
            pairs.checked_mask_map(spark.createDataFrame(bad, "p long, masked long"), "p").collect()


def test_running_sums(spark):
    r = random.Random(7)
    rows = [(i, r.randint(-3, 9)) for i in range(500)]
    df = spark.createDataFrame(r.sample(rows, 500), "i int, v int")
    total, want = 0, {}
    for i, v in reversed(rows):
        want[i] = total = total + v
    out = skew.running_sums(df, -F.col("i"), {"s": "v"})
    assert out.columns == ["i", "v", "s"] and {x.i: x.s for x in out.collect()} == want
    assert skew.running_sums(df.limit(0), F.col("i"), {"s": "v"}).count() == 0


def test_distinct_per_key_keeps_nulls_apart(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (1, None, None), (None, "a", "b"), (None, "a", "b")], "k int, a string, b string")
    out = {x.k: (x.a, x.b, x.ab) for x in skew.distinct_per_key(df, "k", {"a": ["a"], "b": ["b"], "ab": ["a", "b"]}).collect()}
    assert out == {1: (2, 2, 3), None: (1, 1, 1)}


def test_rank_and_sampling(spark):
    r = random.Random(2)
    rows = [(i, r.choice(["hot", "hot", "hot", "b", None]), r.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, g string, u double")
    got = {x.id: x.rank for x in skew.distributed_rank(df, ["g"], "u", "id", "rank", cells=8).collect()}
    by = defaultdict(list)
    for i, g, u in rows:
        by[g].append((u, i))
    assert got == {i: n for v in by.values() for n, (_, i) in enumerate(sorted(v), 1)}
    train, test = sampling.split_exact(df, key="id")
    assert train.count() == 350 and train.intersect(test).count() == 0 and test.count() == 150
    t = sampling.tier_sample(df.withColumnRenamed("u", "x").withColumn("str_dist_all", F.when(F.col("g") == "hot", 0.5).otherwise(1.0)), key="id")
    hot = sum(g == "hot" for _, g, _ in rows)
    assert t.where("keep = 1").count() == int(hot * 0.04) and t.where("keep = 1 and str_dist_all = 1").count() == 0
    assert sampling.balance(spark.createDataFrame([("m",), ("n",), ("n",), ("n",)], "c string"), "c", "m", "n").where("c = 'm'").count() == 3
    assert sampling.tier_sample(t.drop("tot", "ord", "keep", "rand").limit(0), key="id").count() == 0


def test_eager_join_and_counts_against_plain_join(spark):
    r = random.Random(3)
    a = spark.createDataFrame([(r.choice([1, 1, 1, 2, 3, None]), r.choice([1, 2, None]), r.choice("xyz")) for _ in range(200)], "k int, v int, n string")
    b = spark.createDataFrame([(r.choice([1, 1, 2, 4, None]), r.choice([5, 7])) for _ in range(80)], "k int, w int")
    got = {x.k: (x.join_rows, x.sv_joined, x.sw_joined) for x in skew.eager_join_aggregate(a, b, "k", {"sv": F.col("v")}, {"sw": F.col("w")}, "inner").collect()}
    want = {x.k: (x.n, x.v, x.w) for x in a.join(b, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect()}
    assert got == want
    left = {x.k: x.join_rows for x in skew.eager_join_aggregate(a, b, "k", {}, {}).collect()}
    assert left[3] == 0 and None not in left
    d = {x.k: (x.one, x.two) for x in skew.distinct_per_key(a, "k", {"one": ["v"], "two": ["v", "n"]}).collect()}
    assert d == {k: (len({v for kk, v, _ in a.collect() if kk == k}), len({(v, n) for kk, v, n in a.collect() if kk == k})) for k in {x.k for x in a.collect()}}
    assert {x.k for x in skew.hot_keys(a, "k", 0.3).collect()} == {1}
    assert skew.hot_keys(a.limit(0), "k", 0.3).count() == 0 and skew.eager_join_aggregate(a.limit(0), b, "k", {}, {}).count() == 0


def test_prepare(spark):
    df = spark.createDataFrame([(1.0, 5, None), (3.0, 5, "a"), (float("nan"), None, "b"), (None, 5, "c")], "x double, y int, s string")
    stats = prepare.moments(df, ["x", "y"])
    out = prepare.fill_missing(prepare.add_zscores(df, stats)).collect()
    assert [round(r.x_norm, 4) for r in out] == [-0.7071, 0.7071, 0.0, 0.0] and {r.y_norm for r in out} == {0.0} and out[0].s == "0" and out[2].x == 0.0
    assert prepare.predictors(["phone_number", "middle_name1_middle_name2_lv_pct", "m1_m2_detect", "category", "first_name1"]) == ["m1_m2_detect"]


def test_evaluate(spark):
    df = spark.createDataFrame([(0.9, "Match"), (0.9, "No Match"), (0.5, "Match"), (0.1, "No Match"), (None, "Match")], "prob double, category string")
    pts = sorted((r.fpr, r.tpr) for r in evaluate.roc_points(df, "prob", "category", origin=True).collect())
    assert pts == [(0.0, 0.0), (0.5, 0.5), (0.5, 1.0), (1.0, 1.0)]
    rows = {r.actual: r for r in evaluate.confusion(evaluate.decide(df), "category", "decision", "m").collect()}
    assert rows["Totals"].Rate == "2/4" and rows["Match"]["No Match"] == 1
    assert evaluate.best_f1_threshold(df.dropna(), "prob", "category") == 0.5
    assert evaluate.roc_points(df.limit(0), "prob", "category").count() == 0


def test_tables_need_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace as N

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        sc = N(getCheckpointDir=lambda: None, getConf=dict, master=master)
        with pytest.raises(ValueError):
            skew.cut_lineage(N(sparkSession=N(sparkContext=sc)))
