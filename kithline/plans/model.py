"""Training, stacking, saving and applying match models with pyspark.ml."""

from __future__ import annotations

import math
import random
import time
from collections.abc import Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithline.functions.distance import lv
from kithline.functions.text import full_name, trim_blanks
from kithline.operators import evaluate, prepare
from kithline.operators.features import feature_table
from kithline.operators.sampling import fold
from kithline.operators.skew import cut_lineage
from kithline.sources.feeds import load_registry, save_registry

#: Search spaces of the algorithms, as far as Spark's estimators have the parameter.
GRIDS = {
    "RF": {
        "numTrees": [5, 10, 25, 50, 75, 100], "maxDepth": [10, 15, 20], "minInstancesPerNode": [5, 10, 30, 70, 100], "subsamplingRate": [0.95, 0.975, 0.99, 0.995, 1.0],
        "featureSubsetStrategy": ["sqrt", "5", "10", "15", "20", "25", "30", "35"], "maxBins": [2, 5, 10, 15, 20],
    },
    "GBM": {
        "maxIter": [5, 10, 25, 50, 100, 150, 200], "maxDepth": [5, 10, 15, 20], "minInstancesPerNode": [2, 5, 10, 15, 20], "stepSize": [0.06, 0.07, 0.08, 0.09, 0.1, 0.11, 0.12],
        "subsamplingRate": [0.95, 0.975, 0.99, 0.995, 1.0], "featureSubsetStrategy": ["0.3", "0.4", "0.5", "0.6", "0.7"], "maxBins": [32, 64, 128, 256],
    },
    "GLM": {"elasticNetParam": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]},
    "NN": {"hidden": [(32, 32, 32), (64, 64), (128, 128, 128)]},
}
GRIDS["DRF"] = GRIDS["RF"]
#: In place of a search along the path of penalties, which Spark's regression lacks, the penalty is one more dimension.
GRIDS["GLM"] |= {"regParam": [0.0, 0.0001, 0.001, 0.01, 0.1]}
#: Boosting stops when the error on held-out rows improves by less than this.
STOP_TOLERANCE = 1e-3
#: Names of the models in reports; for those marked the ROC table begins at the origin.
TITLES = {"GLM": "GLM", "GBM": "GBM", "RF": "Random Forest", "DRF": "Distributed Random Forest", "NN": "Deep Learning", "ENS": "Ensemble - Best Performance of Each Algorithm", "ENS2": "Ensemble 2"}
ROC_TITLES, FROM_ORIGIN = TITLES | {"GLM": "Binomial Regression"}, ("NN", "RF", "DRF")
LABEL, FOLD, STOP = "_label", "_fold", "_stop"


def estimator(kind: str, params: dict, width: int, seed: int = 1):
    """An estimator of a kind: RF, DRF (the same with another seed), GBM, GLM or NN."""
    common = {"featuresCol": "features", "labelCol": LABEL}
    if kind in ("RF", "DRF"):
        return RandomForestClassifier(**common, seed=seed + (kind == "DRF"), **params)
    if kind == "GBM":
        return GBTClassifier(**common, seed=seed, validationIndicatorCol=STOP, validationTol=STOP_TOLERANCE, **params)
    if kind == "GLM":
        return LogisticRegression(**common, maxIter=50, tol=1e-5, **params)
    if kind == "NN":
        p = dict(params)
        return MultilayerPerceptronClassifier(**common, seed=seed, maxIter=60, layers=[width, *p.pop("hidden", (32, 32)), 2], **p)
    raise ValueError(f"unknown model {kind!r}; one of {', '.join([*GRIDS, 'ENS'])}")


def random_grid(kind: str, most: int, seed: int = 1, grids: dict[str, dict] = GRIDS) -> list[dict]:
    """A seeded random choice of parameter maps without repetition."""
    names, values = zip(*grids[kind].items())
    every = math.prod(map(len, values))
    chosen = random.Random(seed).sample(range(every), min(most, every))
    sizes = [math.prod(map(len, values[i + 1 :])) for i in range(len(values))]
    return [{n: v[k // size % len(v)] for n, v, size in zip(names, values, sizes)} for k in chosen]


def prepare_rows(features: DataFrame, cols: Sequence[str], stats: dict) -> tuple[DataFrame, list[str]]:
    """Filled rows with a vector of the predictors and their normalised copies; soundex categories count as 0..4 by their strength."""
    from kithline.functions.distance import SOUNDEX_CATEGORIES as order

    cats = [c for c in cols if c.endswith("_soundex_cat")]
    filled = prepare.add_zscores(features, stats)
    for c in cats:
        strength = F.lit(0)
        for i, name in enumerate(order, 1):
            strength = F.when(F.col(c) == name, i).otherwise(strength)
        filled = filled.withColumn(f"{c}_n", strength)
    names = [*[f"{c}_n" if c in cats else c for c in cols], *[f"{c}_norm" for c in stats]]
    filled = prepare.fill_missing(filled)
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(filled), names


def _prob(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def search(rows: DataFrame, kind: str, width: int, *, folds: int = 5, most: int = 500, budget_s: float = 1800, seed: int = 1, grids: dict[str, dict] = GRIDS) -> tuple[dict, float, DataFrame]:
    """(best parameters, their cross-validated error, out-of-fold probabilities as _row, prob) among randomly chosen ones.

    At most `most` parameter maps are tried, and none is begun after budget_s seconds; at least one is.  The folds of a map are fitted side by side.
    """
    accuracy = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    began, best = time.time(), None

    def one(params: dict, k: int) -> tuple[float, DataFrame]:
        scored = estimator(kind, params, width, seed).fit(rows.where(F.col(FOLD) != k)).transform(rows.where(F.col(FOLD) == k))
        return 1 - accuracy.evaluate(scored), _prob(scored, "prob").select("_row", "prob")

    with ThreadPool(folds) as pool:
        for params in random_grid(kind, most, seed, grids):
            if best and time.time() - began > budget_s:
                break
            done = pool.map(inheritable_thread_target(lambda k, params=params: one(params, k)), range(folds))
            error = sum(e for e, _ in done) / folds
            if best is None or error < best[1]:
                best = (params, error, reduce(DataFrame.unionByName, [held for _, held in done]))
    return best


class NameMatcher:
    """Scores pairs of names: prob, the probability of a match, and decision.

    models: fitted base models; metas: stacking models over the probabilities of the base models in `stacks` (ENS, of all; ENS2, of boosting and the network).
    The normalisation is part of the matcher, so that scoring sees what training saw.
    """

    def __init__(self, models: dict, metas: dict, columns: list[str], stats: dict, stacks: dict[str, list[str]]):
        self.models, self.metas, self.columns, self.stats, self.stacks = models, metas, columns, stats, stacks

    @classmethod
    def train(
        cls, labelled: DataFrame, *, key: str, kinds: Sequence[str] = ("RF", "GBM", "DRF", "NN", "GLM"), stacks: dict[str, Sequence[str]] | None = None, folds: int = 5, most: int = 500, budget_s: float = 1800,
        rows_per_task: int = 20_000, seed: int = 1, grids: dict[str, dict] = GRIDS,
    ) -> NameMatcher:
        """labelled: pairs with category Match or No Match (other rows are left out) and a unique key, whose hash gives the folds.

        most, budget_s: how many parameter maps are tried for each kind, and for how long (see search).  rows_per_task: each iteration of a fit is a
        job, so rows are trained in as few tasks as that gives.  grids: the search space of each kind.
        """
        stacks = {n: list(k) for n, k in (stacks or {"ENS": kinds} | ({"ENS2": ("GBM", "NN")} if {"GBM", "NN"} <= set(kinds) else {})).items()}
        rows = labelled.where(F.col("category").isin("Match", "No Match")).withColumn("_row", F.col(key))
        features = feature_table(rows)
        numeric = {n for n, t in features.dtypes if t in ("double", "float", "int", "bigint")}
        made = [c for c in features.columns if c not in rows.columns]
        cols = [c for c in prepare.predictors(made) if c in numeric or c.endswith("_soundex_cat")]
        features = features.select("_row", "category", *cols).persist()
        stats = prepare.moments(features, [c for c in cols if c in numeric])
        data, names = prepare_rows(features, cols, stats)
        stop = F.pmod(F.xxhash64(F.lit("stop"), "_row"), F.lit(5)) == 0
        data = data.select("_row", F.when(F.col("category") == "Match", 1.0).otherwise(0.0).alias(LABEL), fold(F.xxhash64("_row"), folds).alias(FOLD), stop.alias(STOP), "features").persist()
        data = data.coalesce(max(1, data.count() // rows_per_task))
        models, held = {}, data.select("_row", LABEL)
        stacked = {k for s in stacks.values() for k in s}
        for kind in kinds:
            params, _, out = search(data, kind, len(names), folds=folds, most=most, budget_s=budget_s, seed=seed, grids=grids)
            models[kind] = estimator(kind, params, len(names), seed).fit(data)
            if kind in stacked:
                held = held.join(out.withColumnRenamed("prob", f"p_{kind}"), "_row")
        held = held.persist()
        metas = {n: LogisticRegression(featuresCol="stacked", labelCol=LABEL).fit(VectorAssembler(inputCols=[f"p_{k}" for k in s], outputCol="stacked").transform(held)) for n, s in stacks.items()}
        for df in (held, data, features):
            df.unpersist()
        return cls(models, metas, cols, stats, stacks)

    def score(self, pairs: DataFrame, models: Sequence[str], names: dict[str, str] | None = None) -> DataFrame:
        """_in (the row of pairs as it was) and p_{model} for each of the models and those that they are stacked on; features are made once."""
        for model in models:
            if model not in self.models and model not in self.metas:
                raise ValueError(f"unknown model {model!r}; one of {', '.join([*self.models, *self.metas])}")
        six = [f"{p}_name{i}" for p in ("first", "middle", "last") for i in (1, 2)]
        clean = {c: trim_blanks(F.lower(F.col(f"`{(names or {}).get(c, c)}`").cast("string"))) for c in six}
        boxed = pairs.select(F.struct(*[f"`{c}`" for c in pairs.columns]).alias("_in"), *[v.alias(c) for c, v in clean.items()])
        out, _ = prepare_rows(feature_table(boxed), self.columns, self.stats)
        out = out.select("_in", "features")
        for k in dict.fromkeys(b for m in models for b in self.stacks.get(m, [m])):
            out = _prob(self.models[k].transform(out), f"p_{k}")
        for m in (m for m in models if m in self.metas):
            vector = VectorAssembler(inputCols=[f"p_{k}" for k in self.stacks[m]], outputCol="stacked")
            out = _prob(self.metas[m].transform(vector.transform(out)), f"p_{m}").drop("stacked")
        return out.drop("features")

    def transform(self, pairs: DataFrame, *, model: str = "ENS", threshold: float = 0.5, names: dict[str, str] | None = None) -> DataFrame:
        """pairs with prob and decision, other columns as they were.

        names: which columns hold first_name1 .. last_name2 (default: those of that name).  The six are compared trimmed and in lower case.
        """
        out = self.score(pairs, [model], names)
        return evaluate.decide(out.select(*[F.col("_in")[c].alias(c) for c in pairs.columns], F.col(f"p_{model}").alias("prob")), threshold=threshold)

    def reports(self, test: DataFrame, label: str = "category") -> dict[str, DataFrame]:
        """Of labelled pairs: roc (fpr, tpr, tp) and confusion (at each model's threshold of the highest F1) of all models but the second ensemble,
        predictions (of the second ensemble, or the first if there's no other) with eight columns, and the example lists from these."""
        kinds = [m for m in TITLES if m in self.models or m in self.metas]
        scored = cut_lineage(self.score(test, kinds).select(*[F.col("_in")[c].alias(c) for c in test.columns], *[f"p_{m}" for m in kinds]))
        told = [m for m in kinds if m != "ENS2"]
        roc = reduce(DataFrame.unionByName, [evaluate.roc_points(scored, f"p_{m}", label, name=ROC_TITLES[m], origin=m in FROM_ORIGIN) for m in told])
        tables = []
        for m in told:
            least = evaluate.best_f1_threshold(scored, f"p_{m}", label)
            at = scored.withColumn("_d", F.when(F.col(f"p_{m}") >= least, "Match").otherwise("No Match"))
            tables.append(evaluate.confusion(at, label, "_d", TITLES[m]))
        last = "ENS2" if "ENS2" in kinds else "ENS"
        full = {f"full_name{i}": full_name(*[F.lower(f"{p}_name{i}") for p in ("first", "middle", "last")]) for i in (1, 2)}
        like = {f"{c}1_{c}2_lv_pct": lv(F.lower(f"{c}1"), F.lower(f"{c}2")) for c in ("first_name", "last_name")}
        decided = evaluate.decide(scored.withColumns(full | like), f"p_{last}").select("phone_number", *full, label, F.col("decision").alias("predict"), F.col(f"p_{last}").alias("Match"), *like)
        lists = evaluate.example_lists(decided, "Match", *like)
        return {"roc": roc, "confusion": reduce(DataFrame.unionByName, tables), "predictions": decided} | {f"list_{n}": t for n, t in lists.items()}

    def save(self, spark: SparkSession, path: str) -> None:
        """Every model under the path, and a registry with the normalisation."""
        every = {**self.models, **self.metas}
        for k, m in every.items():
            PipelineModel([m]).write().overwrite().save(f"{path}/{k}")
        save_registry(spark, path, {"models": {k: f"{path}/{k}" for k in every}, "columns": self.columns, "stats": self.stats, "stacks": self.stacks})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> NameMatcher:
        r = load_registry(spark, path)
        models = {k: PipelineModel.load(p).stages[0] for k, p in r["models"].items()}
        metas = {k: models.pop(k) for k in r["stacks"]}
        return cls(models, metas, r["columns"], {c: tuple(v) for c, v in r["stats"].items()}, r["stacks"])
