import random

import pytest
from pyspark.sql import functions as F

from kithline.operators import pairs
from kithline.plans import pipeline
from kithline.plans.model import GRIDS, NameMatcher, estimator, random_grid
from kithline.sources import feeds
from kithline.streaming.scoring import pair_stream, score_stream

SMALL = GRIDS | {"RF": {"numTrees": [5], "maxDepth": [5]}, "GBM": {"maxIter": [3], "maxDepth": [3]}, "NN": {"hidden": [(8,)]}}
COLS = "id long, first_name1 string, middle_name1 string, last_name1 string, first_name2 string, middle_name2 string, last_name2 string, category string"


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    rows = []
    for i in range(160):
        f, l = word(), word()
        if i % 2:
            rows.append((i, f, r.choice([None, "m"]), l, f[:-1] + r.choice("aeiou"), None, l, "Match"))
        else:
            rows.append((i, f, None, l, word(), r.choice([None, "k"]), r.choice([l, word()]), "No Match"))
    rows.append((900, None, None, None, "a", "", "b", None))
    return spark.createDataFrame(rows, COLS)


def test_train_score_save_and_stream(spark, labelled, tmp_path):
    m = NameMatcher.train(labelled, key="id", kinds=("GLM", "RF"), folds=2, most=1, grids=SMALL)
    assert len(m.columns) == 81 and len(m.stats) == 76 and not any(c.startswith("middle_name1") for c in m.columns)
    extra = labelled.withColumn("features", F.lit("clash")).withColumnRenamed("first_name1", "given")
    out = m.transform(extra, names={"first_name1": "given"})
    assert out.columns == [*extra.columns, "prob", "decision"] and out.count() == labelled.count()
    scored = out.where("category is not null").select("category", "decision", "id", "prob").collect()
    assert sum(r.category == r.decision for r in scored) / len(scored) > 0.9
    m.save(spark, str(tmp_path / "m"))
    again = NameMatcher.load(spark, str(tmp_path / "m"))
    for model in ("GLM", "RF", "ENS"):
        a = {r.id: r.prob for r in m.transform(extra, names={"first_name1": "given"}, model=model).collect()}
        b = {r.id: r.prob for r in again.transform(extra, names={"first_name1": "given"}, model=model).collect()}
        assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    with pytest.raises(ValueError):
        m.transform(labelled, model="XGB")
    labelled.write.parquet(str(tmp_path / "in"))
    q = score_stream(pair_stream(spark, str(tmp_path / "in"), COLS), m, str(tmp_path / "out"), str(tmp_path / "cp"), model="GLM", once=True)
    q.awaitTermination(300)
    assert spark.read.parquet(str(tmp_path / "out")).count() == labelled.count()


def test_reports(spark, labelled):
    rows = labelled.withColumn("phone_number", F.lit(5))
    m = NameMatcher.train(rows, key="id", kinds=("GBM", "NN"), folds=2, most=1, grids=SMALL)
    assert m.stacks == {"ENS": ["GBM", "NN"], "ENS2": ["GBM", "NN"]}
    out = m.reports(rows.where("category is not null"))
    assert {r.tp for r in out["confusion"].collect()} == {"GBM", "Deep Learning", "Ensemble - Best Performance of Each Algorithm"}
    roc = out["roc"].collect()
    assert {r.tp for r in roc} == {"GBM", "Deep Learning", "Ensemble - Best Performance of Each Algorithm"} and ("Deep Learning", 0.0, 0.0) in {(r.tp, r.fpr, r.tpr) for r in roc}
    assert out["predictions"].columns == ["phone_number", "full_name1", "full_name2", "category", "predict", "Match", "first_name1_first_name2_lv_pct", "last_name1_last_name2_lv_pct"]


def test_feeds_in_camel_case(spark):
    mcr = spark.createDataFrame([("1", "'5551234567", "Ann", "-", "Smith", "01/31/2017", "Bob", None, "NULL")], "iKey string, iPhone string, iPhoneListing1FirstName string, iPhoneListing1MiddleName string, iPhoneListing1LastName string, iPhoneListing1FirstSeen string, iPhoneListing2FirstName string, iPhoneListing2MiddleName string, iPhoneListing2LastName string")
    long = pipeline.long_mcr(mcr).collect()
    assert {(r.mcr_ord, str(r.first_seen)) for r in long} == {("phone_listing1", "2017-01-31"), ("phone_listing2", "None")}
    assert [tuple(r) for r in pipeline.clean_mcr(mcr).collect()] == [(5551234567, "ann", None, "smith")]
    tu = spark.createDataFrame([("5551234567", "Ann", "Smith", "1 Road", None)], "Phonenumber string, TloSubject1NameFirstName string, TloSubject1NameLastName string, TloSubject1Address1FullAddress string, TloSubject1Address2FullAddress string").withColumn("TloSubject1NameMiddleName", F.lit(None).cast("string"))
    assert [(r.tu_subject, r.tu_address, r.full_address) for r in pipeline.long_tu(tu).orderBy("tu_address").collect()] == [("1", "1", "1 Road"), ("1", "2", None)]
    assert [tuple(r) for r in pipeline.clean_tu(tu).collect()] == [(5551234567, "ann", None, "smith")]
    assert pipeline.clean_tu(tu.limit(0)).count() == 0 and pipeline.clean_mcr(mcr.limit(0)).count() == 0


def test_reviewed_file(spark, tmp_path):
    (tmp_path / "r.csv").write_text("id,first_name1,category\n1,ann,Match\n2,NA,No Match\n3,bob,\n4,eve,NA\n")
    rows = feeds.read_reviewed(spark, str(tmp_path / "r.csv"), "id int, first_name1 string, category string").collect()
    assert [tuple(r) for r in rows] == [(1, "ann", "Match"), (2, None, "No Match")]


def test_grid_and_estimators():
    assert len(random_grid("RF", 5)) == 5 and random_grid("GLM", 3) == random_grid("GLM", 3)
    with pytest.raises(ValueError):
        estimator("nope", {}, 3)


def test_feeds_and_pairs(spark, tmp_path):
    (tmp_path / "f.txt").write_text("primary_key\tprimary_phone\tmatch_code\tfirst_name\tlast_name\tmiddle_initial\n1\t(555) 123-4567\tx\tAnn\t Smith \t-\n2\tNA\tx\tBob\tNULL\tj\n1\t555.123.4567\tx\tann\tsmith\t\n")
    raw = feeds.read_text_feed(spark, str(tmp_path / "f.txt"), ["primary_key", "primary_phone", "match_code", "first_name", "last_name", "middle_initial"], sep="\t")
    assert feeds.separator(spark, str(tmp_path / "f.txt")) == "\t"
    assert feeds.read_text_feed(spark, str(tmp_path / "f.txt"), raw.columns).collect() == raw.collect()
    names = pipeline.clean_exp(raw)
    assert [tuple(r) for r in names.collect()] == [(5551234567, "ann", None, "smith")]
    a, b, c = pipeline.build_names([names, names, names], "salt")
    assert {r.phone_number for r in a.collect()} == {r.phone_number for r in b.collect()} != {5551234567}
    feeds.write_stage({"name1": a, "name2": b}, str(tmp_path / "stage"))
    assert feeds.read_table(spark, str(tmp_path / "stage/name1")).collect() == a.collect()
    made = pipeline.build_pairs(a, b, c)
    assert made.count() == 5 and set(pairs.NAME) and made.where("keep = 1").count() == 0
    feeds.write_review(made, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/no_review"), header=True).count() == 5 and spark.read.parquet(str(tmp_path / "out/pairs")).count() == 5
    feeds.write_reports({"r": made.limit(1)}, str(tmp_path / "rep"))
    assert feeds.read_table(spark, str(tmp_path / "out/pairs")).count() == 5
