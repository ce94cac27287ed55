"""Review samples, balancing, splits and folds.  Draws depend on a row's key and a seed, never on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.operators.skew import distributed_rank, unit_hash

#: Edge cases that are reviewed in any case: inclusive bounds of each similarity.
EDGE_BOXES = (
    {"str_dist_all": (0.30, 0.60), "str_dist2": (0.80, 0.95), "str_dist1": (0.40, 0.60)},
    {"str_dist_all": (0.70, 0.85), "str_dist2": (0.70, 0.95), "str_dist1": (0.60, 0.85)},
    {"str_dist_all": (0.60, 0.70), "str_dist2": (0.70, 0.85), "str_dist1": (0.50, 0.75)},
)


def tier_sample(pairs: DataFrame, *, key: str, tier: str = "str_dist_all", rate: float = 0.04, draw: Column | None = None, seed: int = 7) -> DataFrame:
    """pairs with tot (rows of the tier), ord (random position in it) and keep (1 for the first rate of it, rounded down).

    Pairs of tier 1 are never kept; those without a tier are a tier of their own.  draw: a column in [0, 1) in place of the hash of the key.  Positions come from a
    distributed ranking, as a tier may hold a large part of all rows.
    """
    pairs = pairs.drop("tot", "ord", "keep", "rand")
    drawn = pairs.withColumn("rand", draw if draw is not None else unit_hash(key, seed))
    ranked = distributed_rank(drawn, [tier], "rand", key, "ord")
    tot = pairs.groupBy(F.col(tier).alias("_t")).agg(F.count(F.lit(1)).alias("tot"))
    out = ranked.join(F.broadcast(tot), F.col(tier).eqNullSafe(F.col("_t"))).drop("_t")  # tiers are tenths
    return out.withColumn("keep", F.when(F.coalesce(F.col(tier) != 1, F.lit(True)) & (F.col("ord") <= F.floor(F.col("tot") * rate + 1e-9)), 1).otherwise(0))


def add_edge_cases(sampled: DataFrame, boxes=EDGE_BOXES) -> DataFrame:
    """Rows within one of the boxes are kept, too."""
    inside = F.lit(False)
    for box in boxes:
        here = F.lit(True)
        for c, (lo, hi) in box.items():
            here = here & F.col(c).between(lo, hi)
        inside = inside | here
    return sampled.withColumn("keep", F.when((F.col("keep") == 0) & inside, 1).otherwise(F.col("keep")))


def balance(rows: DataFrame, label: str, minority: str, majority: str, ratio: float = 0.45) -> DataFrame:
    """Every row of the minority class k times, for the least k with k * minority / (2 * majority) >= ratio; other rows once."""
    n = {r[label]: r.n for r in rows.where(F.col(label).isin(minority, majority)).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    few, many = n.get(minority, 0), n.get(majority, 0)
    k = max(1, -(-int(2 * ratio * many * 1000) // (few * 1000))) if few else 1
    return rows.withColumn("_k", F.explode(F.when(F.col(label) == minority, F.sequence(F.lit(1), F.lit(k))).otherwise(F.array(F.lit(1))))).drop("_k")


def split_exact(rows: DataFrame, *, key: str, share: float = 0.7, draw: Column | None = None, seed: int = 3) -> tuple[DataFrame, DataFrame]:
    """(train, test): exactly round(share * n) rows, those with the smallest draws, and the others."""
    n = round(rows.count() * share)
    ranked = distributed_rank(rows.withColumn("_u", draw if draw is not None else unit_hash(key, seed)).withColumn("_all", F.lit(0)), ["_all"], "_u", key, "_rank").drop("_u", "_all")
    return ranked.where(F.col("_rank") <= n).drop("_rank"), ranked.where(F.col("_rank") > n).drop("_rank")


def fold(key: Column | str, folds: int = 5) -> Column:
    """Modulo assignment to folds 0..folds-1."""
    return F.pmod(F.col(key) if isinstance(key, str) else key, F.lit(folds)).cast("int")
