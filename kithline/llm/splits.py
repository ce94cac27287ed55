"""Splits that keep related records together, by component swap search.

Components (all rows of one key, or a single row without one) are aggregated to label counts; each is a unit of the search, whatever their
number.  From the hashed assignment, annealing chains move and exchange whole units.  Units are dealt out to groups of bounded size that are annealed in
parallel, each group removing its part of the deviation; groups that are few have several chains, of which the best is kept.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.operators.skew import cut_lineage

#: Units of one annealing chain, about; chains that run side by side where groups are few; proposals for each unit.
GROUP, CHAINS, PROPOSALS = 20_000, 8, 12
#: A component with at least this share of the rows is assigned through a broadcast table, which has 1 / HOT entries at most.
HOT = 1 / 1000
Unit = Sequence[tuple[int, float]]


def anneal(units: Sequence[Unit], gap: list[list[float]], start: Sequence[int], seed: int, steps: int) -> tuple[float, list[int]]:
    """(deviation, split of each unit) after moves and exchanges of whole units.

    units: (dimension, weight) pairs; gap: for each split and dimension what it has too much, under the assignment `start`.  The deviation is the sum of the
    absolute gaps.
    """
    rng = random.Random(seed)
    gap, at, k, n = [list(g) for g in gap], list(start), len(gap), len(units)
    now = sum(abs(x) for g in gap for x in g)
    best, best_at, moved = now, list(at), []  # moved: units whose split may differ from best_at
    if not n or k < 2:
        return best, best_at
    heat, cool = 0.02, (1e-7 / 0.02) ** (1 / max(1, steps))
    for _ in range(steps):
        heat *= cool
        u = rng.randrange(n)
        a = at[u]
        if rng.random() < 0.5 or n < 2:
            v, b = -1, rng.randrange(k)
            change = units[u]
        else:
            v = rng.randrange(n)
            b = at[v]
            net = dict(units[u])
            for d, x in units[v]:
                net[d] = net.get(d, 0.0) - x
            change = net.items()
        if a == b:
            continue
        ga, gb = gap[a], gap[b]
        more = 0.0
        for d, x in change:
            p, q = ga[d], gb[d]
            more += abs(p - x) - abs(p) + abs(q + x) - abs(q)
        if more <= 0 or rng.random() < math.exp(-more / heat):
            for d, x in change:
                ga[d] -= x
                gb[d] += x
            at[u] = b
            moved.append(u)
            if v >= 0:
                at[v] = a
                moved.append(v)
            now += more
            if now < best - 1e-12:
                best = now
                for w in moved:
                    best_at[w] = at[w]
                moved = []
    return best, best_at


def connected(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """node, component: for each value of the keys, as linked_value has it, the least value that rows link it with, directly or through others.

    Values are linked by the rows that have both; each distinct link counts once, so a value that a third of the rows have costs no more than its partners.
    Every round takes the least label among neighbours (with partial aggregation) and then the label of that label, so chains halve.
    """
    values = F.array_compact(F.array(*[linked_value(i, c) for i, c in enumerate(keys)]))
    pairs = rows.select(values.alias("v")).where("size(v) > 0").select(F.col("v")[0].alias("a"), F.explode("v").alias("b")).distinct()
    edges = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut_lineage(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")))
    while True:
        near = edges.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        far = label.select(F.col("node").alias("near"), F.col("component").alias("far"))
        new = label.join(near, "node").join(far, "near").select("node", F.least("component", "near", "far").alias("new"), "component")
        new = cut_lineage(new)
        if new.where("new <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", F.col("new").alias("component"))


def linked_value(i: int, c: str) -> Column:
    """A key's value as a node; null for null."""
    return F.when(F.col(c).isNotNull(), F.xxhash64(F.lit("value"), F.lit(i), F.col(c).cast("string")))


def _chain(gap: list[list[float]], total: int, seed: tuple[int, int], proposals: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One annealing chain over the units of a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_u")
        units = [[(0, n / total), *[(p["d"], p["x"]) for p in parts]] for n, parts in zip(pdf["n"], pdf["parts"])]
        deviation, at = anneal(units, gap, pdf["at"].tolist(), hash((*seed, int(pdf["chain"].iloc[0]))), proposals * len(units) + 2000)
        return pdf[["g", "chain", "_u"]].assign(deviation=deviation, at=at)

    return run


def split_components(
    rows: DataFrame, targets: DataFrame, *, component: str | Sequence[str], row_key: str, label: str, seed: int = 5, chains: int = CHAINS, proposals: int = PROPOSALS, group: int = GROUP
) -> tuple[DataFrame, DataFrame]:
    """(assigned, report): every row with a column `split`, and the shares reached.

    All rows of one value of `component` get the same split; rows without one stand alone.  Of several columns, rows that share a value of any of them, directly or
    through other rows, are one component.  targets: split_name, target_share (in
    proportion).  report: label ("all rows" for the first), split, n_rows, actual_share, target_share.

    What is minimised is the sum over splits of |share of rows - target| plus, weighted by the square root of its size, the same sum for each label; null labels
    are a label.  The table of splits by labels goes through the driver, units don't.  First the largest units, as many as one chain takes, remove what they can of
    the deviation; then all others in groups by hash, each its part; then as many small ones as one chain takes remove what the groups left.

    The rows are aggregated once, with partial aggregation, so a hot component costs nothing, and joined once with the units that moved; rows of
    components above a share of HOT are not shuffled for it.  An empty table gives empty results; a component key that is an empty string is a component; a
    column `split` of the rows is replaced.
    """
    spark = rows.sparkSession
    wanted = [(r.split_name, float(r.target_share)) for r in targets.orderBy("split_name").limit(1001).collect()]
    if not wanted or len(wanted) > 1000 or sum(w for _, w in wanted) <= 0:
        raise ValueError("targets need 1 to 1000 splits with positive shares")
    share = [w / sum(w for _, w in wanted) for _, w in wanted]
    k = len(share)
    given = rows
    if not isinstance(component, str):
        # a row's component is that of any of its values
        of = connected(rows, component).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
        node = F.coalesce(*[linked_value(i, c) for i, c in enumerate(component)])
        boxed = rows.select(F.struct(*[f"`{c}`" for c in rows.columns]).alias("_all"), node.alias("_first"))
        rows = boxed.join(of, F.col("_first") == F.col("_node"), "left").select("_all.*", "_component")
        component = "_component"
    lone, text = F.col(component).isNull(), F.col(component).cast("string")
    unit = F.when(lone, F.xxhash64(F.lit(seed), F.lit("row"), F.col(row_key))).otherwise(F.xxhash64(F.lit(seed), F.lit("component"), text))
    # the hashed assignment: a unit's hash picks a split with the target's probability
    draw, upto = F.pmod(F.xxhash64(F.lit("split"), F.col("_u")), F.lit(1 << 40)) / F.lit(float(1 << 40)), 0.0
    first = F.lit(k - 1)
    for i in reversed(range(k - 1)):
        upto = sum(share[: i + 1])
        first = F.when(draw < upto, i).otherwise(first)
    sized = cut_lineage(rows.select(unit.alias("_u"), F.col(label).cast("string").alias("_l")).groupBy("_u", "_l").agg(F.count(F.lit(1)).alias("n")))
    sums = sized.groupBy("_l").agg(F.sum("n").alias("n")).orderBy("_l").collect()
    total, root = max(1, sum(r.n for r in sums)), sum(math.sqrt(r.n) for r in sums) or 1.0
    # a label's dimension, and the weight that a row has in it; dimension 0 is all rows
    dims = spark.createDataFrame([(r._l, i, math.sqrt(r.n) / root / r.n) for i, r in enumerate(sums, 1)], "_l string, d int, w double")
    goal = [[s, *[s * math.sqrt(r.n) / root for r in sums]] for s in share]
    parts = sized.join(dims, sized["_l"].eqNullSafe(dims["_l"])).select("_u", "n", F.struct("d", (F.col("n") * F.col("w")).alias("x")).alias("part"))
    units = parts.groupBy("_u").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("part")).alias("parts")).withColumn("start", first).withColumn("at", F.col("start"))
    units = cut_lineage(units)
    # sizes by powers of two: the largest units that fit into one chain
    by_size, large, count = {r.b: r.c for r in units.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c")).collect()}, None, 0
    every = sum(by_size.values())
    for b in sorted(by_size, reverse=True):
        count += by_size[b]
        if count > group:
            break
        large = b
    groups = -(-every // group)
    big = F.col("n") >= (1 << large) if large is not None else F.lit(False)
    spread = F.pmod(F.xxhash64(F.lit("group"), "_u"), F.lit(max(1, groups)))
    # which units take part, their group, the number of groups; all at once if they fit into one chain
    if groups <= 1:
        rounds = [(F.lit(True), F.lit(0), 1)]
    else:
        some = F.pmod(F.xxhash64(F.lit("some"), "_u"), F.lit(1 << 20)) < int((1 << 20) * group / every)
        rounds = [(big, F.lit(0), 1), (~big, spread, groups), (~big & some, F.lit(0), 1)]
    for r, (chosen, place, many) in enumerate(rounds if every else []):
        have = [[0.0] * len(goal[0]) for _ in share]
        for x in units.groupBy("at").agg(F.sum("n").alias("n")).collect():
            have[x["at"]][0] = x.n / total
        for x in units.select("at", F.inline("parts")).groupBy("at", "d").agg(F.sum("x").alias("x")).collect():
            have[x["at"]][x.d] = x.x
        gap = [[(h - g) / many for h, g in zip(hs, gs)] for hs, gs in zip(have, goal)]
        if sum(abs(x) for g in gap for x in g) < 1e-9:
            break
        copies = max(1, chains // many)

        dealt = units.where(chosen).withColumn("g", place.cast("int")).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(copies * many, "g", "chain")
        done = cut_lineage(dealt.groupBy("g", "chain").applyInPandas(_chain(gap, total, (seed, r), proposals), "g int, chain int, _u long, deviation double, at int"))
        best = done.groupBy("g").agg(F.min(F.struct("deviation", "chain")).alias("b")).select("g", F.col("b.chain").alias("chain"))
        new = done.join(best, ["g", "chain"]).select("_u", F.col("at").alias("new"))
        units = cut_lineage(units.join(new, "_u", "left").withColumn("at", F.coalesce("new", "at")).drop("new"))
    moved = units.where("at <> start")
    is_hot = F.col("n") >= max(2.0, total * HOT)
    hot, cold = moved.where(is_hot).select(F.col("_u").alias("_uh"), F.col("at").alias("_h")), moved.where(~is_hot).select(F.col("_u").alias("_uc"), F.col("at").alias("_c"))
    kept = [f"`{c}`" for c in given.columns if c.lower() != "split"]
    boxed = rows.select(F.struct(*kept).alias("_row"), unit.alias("_u"), F.xxhash64(F.lit("spread"), F.col(row_key)).alias("_s"))
    every_hot = F.broadcast(units.where(is_hot).select(F.col("_u").alias("_ua"), F.lit(True).alias("_is")))
    out = boxed.join(every_hot, F.col("_u") == F.col("_ua"), "left").join(F.broadcast(hot), F.col("_u") == F.col("_uh"), "left")
    out = out.withColumn("_k", F.when(F.col("_is"), F.col("_s")).otherwise(F.col("_u"))).join(cold, F.col("_k") == F.col("_uc"), "left")
    number = F.when(F.col("_is"), F.coalesce("_h", first)).otherwise(F.coalesce("_c", first))
    names = F.array(*[F.lit(n) for n, _ in wanted])
    assigned = out.select("_row.*", F.element_at(names, number + 1).alias("split"))
    by = assigned.groupBy(F.coalesce(F.col(label).cast("string"), F.lit("no label")).alias("label"), "split").agg(F.count(F.lit(1)).alias("n_rows"))
    by = by.unionByName(assigned.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("label", F.lit("all rows")))
    of = by.groupBy("label").agg(F.sum("n_rows").alias("_n"))
    aims = F.array(*[F.struct(F.lit(n).alias("split"), F.lit(float(s)).alias("target_share")) for (n, _), s in zip(wanted, share)])
    table = of.select("label", "_n", F.inline(aims)).join(by, ["label", "split"], "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    return assigned, table.select("label", "split", "n_rows", (F.col("n_rows") / F.col("_n")).alias("actual_share"), "target_share")
