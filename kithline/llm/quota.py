"""Sampling to target category proportions by controlled rounding.

The quotas form a two-way table, category by stratum.  Its fractional cells become integers by a maximum flow with
lower bounds, which keeps the category margins exactly and each stratum margin at its floor or ceiling; then each cell gives
exactly its quota of rows, those with the smallest random keys.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithline.operators.skew import cut_lineage, distributed_rank, unit_hash


class Flow:
    """Maximum flow by shortest augmenting paths in level graphs, on small integer networks."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            level, queue = {s: 0}, deque([s])
            while queue:
                x = queue.popleft()
                for e in self.out[x]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[x] + 1
                        queue.append(self.to[e])
            if t not in level:
                return total
            at = [0] * len(self.out)
            while True:  # one path after the other, without recursion
                path, x = [], s
                while x != t:
                    while at[x] < len(self.out[x]):
                        e = self.out[x][at[x]]
                        if self.room[e] and level.get(self.to[e]) == level[x] + 1:
                            break
                        at[x] += 1
                    else:
                        if x == s:
                            break
                        x = self.to[path.pop() ^ 1]
                        at[x] += 1
                        continue
                    path.append(e)
                    x = self.to[e]
                if x != t:
                    break
                least = min(self.room[e] for e in path)
                for e in path:
                    self.room[e] -= least
                    self.room[e ^ 1] += least
                total += least


def controlled_rounding(cells: dict[tuple, float]) -> dict[tuple, int]:
    """Integers at the floor or ceiling of each cell of a two-way table, with both margins at the floor or ceiling of theirs.

    Such a table always exists; a margin that is an integer is kept exactly.  Keys are (row, column).
    """
    cells = dict(sorted(cells.items(), key=repr))  # of several roundings always the same
    near = lambda x: round(x) if abs(x - round(x)) < 1e-7 else x
    rows, cols = sorted({r for r, _ in cells}, key=repr), sorted({c for _, c in cells}, key=repr)
    node = {("r", r): 2 + i for i, r in enumerate(rows)} | {("c", c): 2 + len(rows) + i for i, c in enumerate(cols)}
    s, t, top, end = 0, 1, 2 + len(node), 3 + len(node)  # s, t: of the lower bounds; top, end: of the table
    flow = Flow(4 + len(node))
    excess = [0] * (4 + len(node))
    kept = {}

    def bounded(a: int, b: int, x: float) -> tuple[int, int]:
        lo, hi = math.floor(near(x)), math.ceil(near(x))
        excess[b] += lo
        excess[a] -= lo
        return flow.edge(a, b, hi - lo), lo

    for r in rows:
        bounded(top, node["r", r], sum(v for (a, _), v in cells.items() if a == r))
    for c in cols:
        bounded(node["c", c], end, sum(v for (_, b), v in cells.items() if b == c))
    for (r, c), v in cells.items():
        kept[r, c] = bounded(node["r", r], node["c", c], v)
    flow.edge(end, top, 1 << 60)
    for v, x in enumerate(excess):
        if x > 0:
            flow.edge(s, v, x)
        elif x < 0:
            flow.edge(v, t, -x)
    if flow.run(s, t) != sum(x for x in excess if x > 0):
        raise ArithmeticError("no rounding found")
    return {k: lo + flow.room[e ^ 1] for k, (e, lo) in kept.items()}


def category_quotas(have: dict[str, int], targets: dict[str, tuple[float, int]], size: int) -> dict[str, int]:
    """Whole numbers of rows to draw from each category.

    A category wants its share of `size`, or its minimum if that is more; what minimums add is taken from the others in proportion to their
    shares.  One that has fewer rows than it wants gives all of them.  What it lacks isn't made up for by others, whose shares would only move away
    from their targets, so the sample may have fewer than `size` rows.  Fractions go to the largest remainders.
    """
    raised: dict[str, int] = {}
    while True:
        free = [c for c in targets if c not in raised]
        left, weight = max(0, size - sum(raised.values())), sum(targets[c][0] for c in free)
        want = {c: left * targets[c][0] / weight if weight > 0 else 0.0 for c in free}
        more = {c: m for c in free if (m := min(targets[c][1], have.get(c, 0))) > want[c]}
        if not more:
            break
        raised |= more
    out = raised | {c: min(math.floor(v), have.get(c, 0)) for c, v in want.items()}
    whole = {c: v for c, v in want.items() if have.get(c, 0) > math.floor(v)}
    rest = round(sum(whole.values())) - sum(out[c] for c in whole)
    for c in sorted(whole, key=lambda c: (math.floor(want[c]) - want[c], c))[: max(0, rest)]:
        out[c] += 1
    return out


def _round(cells: pd.DataFrame) -> pd.DataFrame:
    """The cells of one group of strata, rounded."""
    got = controlled_rounding({(c, s): x for c, s, x in zip(cells["_c"], cells["_s"], cells["x"])})
    return pd.DataFrame([(c, s, q) for (c, s), q in got.items()], columns=["_c", "_s", "_quota"])


def sample_to_targets(
    rows: DataFrame, targets: DataFrame, *, key: str, category: str = "category", stratum: Column | None = None, fraction: float = 1 / 3, size: int | None = None, seed: int = 11, max_cells: int = 100_000
) -> tuple[DataFrame, DataFrame]:
    """(sample, report): rows drawn so that the categories have their target shares.

    stratum: a second attribute whose distribution within each category the sample keeps (default: none, one stratum).  size: rows to
    draw, by default `fraction` of the rows with a category, rounded down.  The quota table has categories x strata cells.  Up to max_cells are rounded at once, on
    the driver; of more, groups of strata are the columns of a first table, and each group's own table, whose rows sum to what the group got, is rounded in a task.  More than max_cells
    categories in targets are an error.  A row is drawn by the hash of its key and the seed: same input, same sample.

    sample: the rows with all their columns.  report: category, target_share, min_rows, available, wanted (share of size, a fraction), drawn,
    actual_share, below_min, below_share (fewer rows available than min_rows, or than the share of size), off (actual_share less the target share), met: the drawn sample has min_rows rows of the category, and its
    share is the target but for the rounding to whole rows (one row).
    Null categories and such as targets doesn't list are never drawn.  A category without rows is reported with 0.  A key that occurs twice is two rows.
    """
    names = [r[category] for r in targets.select(category).limit(max_cells + 1).collect()]
    wanted = {r[category]: (float(r.target_share), int(r.min_rows)) for r in targets.collect()} if len(names) <= max_cells else {}
    if len(wanted) < len(names):
        raise ValueError("targets need one row per category")
    # a row travels as one value, so its columns can't clash with those made here
    cellof = rows.select(F.struct(*[f"`{c}`" for c in rows.columns]).alias("_row"), F.col(key).alias("_key"), F.col(category).cast("string").alias("_category"), (stratum if stratum is not None else F.lit("all")).cast("string").alias("_stratum"))
    every = cut_lineage(cellof.where("_category is not null").groupBy("_category", "_stratum").agg(F.count(F.lit(1)).alias("n")))
    labelled = every.agg(F.sum("n")).first()[0] or 0
    every = every.where(F.col("_category").isin(list(wanted)))
    groups = -(-every.count() // max_cells)
    place = F.pmod(F.xxhash64(F.lit("strata"), "_stratum"), F.lit(max(1, groups)))
    if groups > 1:
        counts = every.groupBy("_category", place.alias("_stratum")).agg(F.sum("n").alias("n")).collect()
    else:
        counts = every.collect()
    n = size if size is not None else labelled // 3 if fraction == 1 / 3 else math.floor(labelled * fraction)
    have: dict[str, int] = {}
    for r in counts:
        have[r._category] = have.get(r._category, 0) + r.n
    quota = category_quotas({c: have.get(c, 0) for c in wanted}, wanted, n)
    table = {(r._category, r._stratum): quota[r._category] * r.n / have[r._category] for r in counts if quota.get(r._category)}
    whole = controlled_rounding(table) if table else {}
    spark = rows.sparkSession
    if groups > 1:
        total = {(r._category, r._stratum): r.n for r in counts}
        got = spark.createDataFrame([(c, g, q, total[c, g]) for (c, g), q in whole.items() if q], "_c string, _h long, _q long, _of long")
        inside = every.withColumn("_g", place).join(got, (F.col("_category") == F.col("_c")) & (F.col("_g") == F.col("_h"))).select("_g", "_c", F.col("_stratum").alias("_s"), (F.col("_q") * F.col("n") / F.col("_of")).alias("x"))
        cells = cut_lineage(inside.groupBy("_g").applyInPandas(_round, "_c string, _s string, _quota long").where("_quota > 0"))
    else:
        cells = F.broadcast(spark.createDataFrame([(c, s, q) for (c, s), q in whole.items() if q], "_c string, _s string, _quota long"))
    ranked = distributed_rank(cellof.where(F.col("_category").isin([c for c, q in quota.items() if q])).withColumn("_u", unit_hash("_key", seed)), ["_category", "_stratum"], "_u", "_key", "_rank")
    sample = ranked.join(cells, (F.col("_category") == F.col("_c")) & F.col("_stratum").eqNullSafe(F.col("_s"))).where("_rank <= _quota").select("_row.*")
    drawn = sum(quota.values())
    weight = sum(w for w, _ in wanted.values()) or 1.0

    def line(c: str, w: float, m: int) -> tuple:
        got = quota[c] / drawn if drawn else 0.0
        return (c, w, m, have.get(c, 0), w * n, quota[c], got, have.get(c, 0) < m, have.get(c, 0) < w * n, got - w / weight, quota[c] >= m and abs(quota[c] - drawn * w / weight) <= 1)

    report = spark.createDataFrame([line(c, w, m) for c, (w, m) in wanted.items()], "category string, target_share double, min_rows int, available long, wanted double, drawn long, actual_share double, below_min boolean, below_share boolean, off double, met boolean")
    return sample, report
