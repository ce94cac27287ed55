"""Measures of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithline.operators.skew import running_sums


def decide(df: DataFrame, prob: str = "prob", threshold: float = 0.5) -> DataFrame:
    """df with decision: Match above the threshold, No Match at or below it; null for a null probability."""
    return df.withColumn("decision", F.when(F.col(prob) > threshold, "Match").when(F.col(prob).isNotNull(), "No Match"))


def _by_threshold(df: DataFrame, prob: str, label: str, positive: str) -> DataFrame:
    """p, pos, neg, tp_, fp_: rows of each distinct probability, and of all at or above it.  The running sums pass over ranges of probabilities in parallel."""
    rows = df.where(F.col(prob).isNotNull() & F.col(label).isNotNull())
    by = rows.groupBy(F.col(prob).alias("p")).agg(F.sum((F.col(label) == positive).cast("long")).alias("pos"), F.sum((F.col(label) != positive).cast("long")).alias("neg"))
    return running_sums(by, -F.col("p"), {"tp_": "pos", "fp_": "neg"})


def roc_points(df: DataFrame, prob: str, label: str, positive: str = "Match", name: str | None = None, origin: bool = False) -> DataFrame:
    """fpr, tpr (and tp, the name of the model): one point for each distinct probability as threshold.

    A rate without rows to refer to is null.  origin: with the point (0, 0).
    """
    run = _by_threshold(df, prob, label, positive)
    total = run.agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    out = run.join(F.broadcast(total), F.lit(True)).select(F.try_divide(F.col("fp_").cast("double"), F.col("all_neg")).alias("fpr"), F.try_divide(F.col("tp_").cast("double"), F.col("all_pos")).alias("tpr"))
    if origin:
        out = out.unionByName(df.sparkSession.createDataFrame([(0.0, 0.0)], "fpr double, tpr double"))
    return out.withColumn("tp", F.lit(name)) if name else out


def best_f1_threshold(df: DataFrame, prob: str, label: str, positive: str = "Match") -> float:
    """The probability at or above which a decision for the positive class has the highest F1; the largest of equal ones."""
    run = _by_threshold(df, prob, label, positive)
    f1 = run.join(F.broadcast(run.agg(F.sum("pos").alias("all_pos"))), F.lit(True)).select("p", F.try_divide(2 * F.col("tp_").cast("double"), F.col("tp_") + F.col("fp_") + F.col("all_pos")).alias("f1"))
    row = f1.orderBy(F.desc("f1"), F.desc("p")).first()
    return row.p if row else 0.5


def confusion(df: DataFrame, label: str, predicted: str, name: str) -> DataFrame:
    """tp (name of the model), actual, Match, No Match, Error, Rate: counts of decisions by actual class, and of all rows."""
    hit = lambda v: F.sum((F.col(predicted) == v).cast("long"))
    rows = df.where(F.col(label).isNotNull() & F.col(predicted).isNotNull())
    each = rows.groupBy(F.col(label).alias("actual")).agg(hit("Match").alias("m"), hit("No Match").alias("o"), F.sum((F.col(label) != F.col(predicted)).cast("long")).alias("w"), F.count(F.lit(1)).alias("n"))
    # the totals are made from the classes' counts, so the rows are scored once
    total = each.agg(*[F.sum(c).alias(c) for c in "mown"]).where("n is not null").select(F.lit("Totals").alias("actual"), *"mown")
    every = each.select("actual", *"mown").unionByName(total)
    return every.select(F.lit(name).alias("tp"), "actual", F.col("m").alias("Match"), F.col("o").alias("No Match"), F.try_divide(F.col("w").cast("double"), F.col("n")).alias("Error"), F.concat(F.col("w").cast("string"), F.lit("/"), F.col("n").cast("string")).alias("Rate"))


def example_lists(df: DataFrame, prob: str, first: str, last: str) -> dict[str, DataFrame]:
    """Where a model and plain edit similarity of first and last names disagree.

    rejected: improbable although both names are alike; accepted: probable although neither is much alike; renamed: probable with like
    last names and unlike first names.
    """
    p, a, b = F.col(prob), F.col(first), F.col(last)
    return {
        "rejected": df.where((p < 0.50) & (a > 0.50) & (b > 0.50)),
        "accepted": df.where((p > 0.95) & (a < 0.80) & (b < 0.80)),
        "renamed": df.where((p > 0.95) & (a < 0.80) & (b >= 0.90)),
    }
