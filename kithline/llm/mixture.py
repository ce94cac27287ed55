"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithline.llm.tokens import token_count
from kithline.operators.skew import cut_lineage, distributed_rank, unit_hash

#: Starting points of the systematic sampling that are tried.
STARTS = 64


def budgets(capacity: dict[str, float], shares: dict[str, float], total: float) -> dict[str, float]:
    """Tokens of each source, so that `total` is spent as near the shares as the capacities allow.

    Sources that can't give their share give all they have, and the rest is split over the others in proportion to
    their shares (water filling); if no source is left that can give more, less than `total` is spent.
    """
    out: dict[str, float] = {}
    open_ = {s for s, w in shares.items() if w > 0}
    left = total
    while open_:
        weight = sum(shares[s] for s in open_)
        full = {s for s in open_ if capacity.get(s, 0) <= left * shares[s] / weight}
        if not full:
            return out | {s: left * shares[s] / weight for s in open_}
        out |= {s: capacity.get(s, 0) for s in full}
        left -= sum(capacity.get(s, 0) for s in full)
        open_ -= full
    return out


def best_total(capacity: dict[str, float], shares: dict[str, float], typical: dict[str, float], most: float) -> float:
    """The size of mixture at which the shares are expected to be nearest their targets; the larger of equal ones.

    The larger the mixture, the more sources can't give their share; the smaller it is, the more a whole document (`typical` tokens) counts.
    Candidates are the sizes at which a source runs out, up to `most`.
    """
    have = {s: w for s, w in shares.items() if w > 0 and capacity.get(s, 0) > 0}
    weight, every = sum(have.values()), sum(shares.values())

    def deviation(total: float) -> float:
        b = budgets(capacity, shares, total)
        sum_ = sum(b.values())
        return sum(abs(b.get(s, 0) / sum_ - w / every) + (min(typical[s], b[s]) / 2 / sum_ if s in have and b[s] < capacity[s] else 0) for s, w in shares.items())

    sizes = sorted({min(most, capacity[s] * weight / w) for s, w in have.items()} | {most}, reverse=True)
    return min(sizes, key=lambda t: (round(deviation(t), 6), -t)) if have and most > 0 else most


def whole_copies(size: np.ndarray, want: np.ndarray, most: np.ndarray, budget: float) -> np.ndarray:
    """Whole copies of each size (ascending) for the wanted, fractional ones, at most `most`.

    Systematic sampling along the sizes: a size gets as many copies as points k + start fall into its stretch of the running sum of `want`, so every part of
    the distribution keeps its weight to within one copy.  Of STARTS starting points the one whose tokens come nearest the budget is taken.  Then copies are
    exchanged, one size for another, or one is added or taken where that is nearer, for as long as the tokens come nearer the budget: each time the best single
    change of all.
    """
    upto = np.concatenate([[0.0], np.cumsum(want)])
    best, gap = np.zeros(len(size), dtype=np.int64), math.inf
    for k in range(STARTS):
        got = np.minimum(np.diff(np.floor(upto + (k + 0.5) / STARTS).astype(np.int64)), most)
        g = budget - float((size * got).sum())
        if abs(g) < abs(gap):
            best, gap = got, g
    while abs(gap) > 0.5:
        out, into = np.flatnonzero(best > 0), np.flatnonzero(best < most)
        taken = np.concatenate([[0], size[out]])  # 0: nothing
        given = np.concatenate([[0], size[into]])
        at = np.searchsorted(given, taken + gap)
        options = [(abs(gap - float(given[j] - taken[i])), i, j) for near in (at - 1, at) for i, j in enumerate(np.clip(near, 0, len(given) - 1))]
        left, i, j = min(options)
        if left >= abs(gap) - 1e-9:
            break
        if i:
            best[out[i - 1]] -= 1
        if j:
            best[into[j - 1]] += 1
        gap -= float(given[j] - taken[i])
    return best


def _rate(level: Column, tilt: Column, tokens: Column, scale: Column, repeats: Column) -> Column:
    """exp of the level plus the tilt times the size, at most the number of repeats."""
    x = F.least(F.greatest(level + tilt * tokens / scale, F.lit(-50.0)), F.lit(50.0))
    return F.least(F.exp(x), repeats.cast("double"))


def mix_sources(
    documents: DataFrame, targets: DataFrame, *, total_tokens: int | None = None, seed: int = 17, tokenizer: str | None = None, tolerance: float = 1e-6, rounds: int = 30, max_sources: int = 10_000, share_tolerance: float = 0.005,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """(mixture, report): documents with their numbers of copies, and target and actual shares.

    mixture: doc_id, source, n_tokens, copies (1..max_repeats); documents that aren't used have no row.
    report: one row for each target: source, target_share, max_repeats, n_documents, available_tokens, budget_tokens,
    actual_tokens, actual_share, used_documents, copies, status: "met" if actual and target share differ by at most share_tolerance; "above" or "below" if they
    differ by more, with " (exhausted)" where all documents are used max_repeats times; "no documents".

    A document's rate is exp(a_s + l_s * tokens / mean), capped at max_repeats of its source s: the rates nearest, in relative
    entropy, to using each document once under two constraints for each source, its tokens and the mean size of what is used, which keeps short documents
    from being preferred.  A document of more tokens than its source's budget can't be in the mixture and has rate 0, so the others have to make up for it in
    tokens and in the mean size; without such documents one rate for all is the solution.  Where the others can't meet both constraints, none is
    left out beforehand.  The convex dual has two unknowns per source and is solved by Newton steps; each step is one distributed aggregation over the
    (source, size) counts, which are sufficient
    because documents of one source and size share a rate.  Rates become copies by systematic sampling along the sizes and exchanges of single copies
    (see whole_copies), per source and over its distinct sizes, of which there are no more than the longest document has tokens.  Within a size, copies go to
    documents by hash.

    total_tokens: size of the mixture, by default the one at which the shares come nearest the targets (see best_total), at most
    what the listed sources have.  Targets must have one row per source
    (at most max_sources, which is checked, as they go through the driver); shares are taken in proportion.  Null and
    empty texts, and null or unlisted sources, contribute nothing.  A doc_id that occurs twice is two documents.  Extra columns are ignored.
    """
    listed = targets.select(F.col(source).alias("source"), "target_share", "max_repeats").limit(max_sources + 1).collect()
    if len(listed) > max_sources or len({r.source for r in listed}) < len(listed):
        raise ValueError("targets need one row per source, and at most max_sources")
    wanted = F.broadcast(documents.sparkSession.createDataFrame(listed, "source string, target_share double, max_repeats int"))
    # the size of the documents is the only thing that needs their text: it's computed once and written
    sized = documents.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("t")).join(wanted.select("source"), "source").where("t <> ''")
    sized = cut_lineage(sized.select("doc_id", "source", token_count("t", tokenizer).alias("n_tokens")))
    cells = cut_lineage(sized.groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")).join(wanted, "source"))
    per = {r.source: r for r in cells.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"), F.max("max_repeats").alias("rep")).collect()}
    share = {r.source: max(0.0, r.target_share or 0.0) for r in listed}
    capacity, mean = {s: float(r.tokens * max(0, r.rep)) for s, r in per.items()}, {s: r.tokens / r.docs for s, r in per.items()}
    total = total_tokens if total_tokens is not None else best_total(capacity, share, mean, float(sum(r.tokens for s, r in per.items() if share[s] > 0)))
    budget = budgets(capacity, share, float(total))
    scale = mean
    full = {s for s in per if budget.get(s, 0) >= capacity[s] * (1 - 1e-12)}
    # level and tilt; the start is the solution wherever no document is capped
    dual = {s: (100.0, 0.0) if s in full else (math.log(max(budget.get(s, 0.0), 1e-9) / r.tokens), 0.0) for s, r in per.items()}
    start, longest, unmet = dict(dual), {s: budget.get(s, 0.0) if s not in full else math.inf for s in per}, set()
    spark = documents.sparkSession

    def params() -> DataFrame:
        return F.broadcast(spark.createDataFrame([(s, *map(float, dual[s]), float(scale[s]), float(budget.get(s, 0.0)), float(longest[s])) for s in per], "source string, level double, tilt double, scale double, budget double, longest double"))

    fits = F.col("n_tokens") <= F.col("longest")
    rate = F.when(fits, _rate(F.col("level"), F.col("tilt"), F.col("n_tokens"), F.col("scale"), F.col("max_repeats"))).otherwise(0.0)
    for _ in range(rounds if per else 0):
        x, mass = F.col("n_tokens") / F.col("scale"), F.col("n") * rate
        free = F.when(fits & (rate < F.col("max_repeats")), mass).otherwise(0.0)
        sums = [F.sum(v).alias(k) for k, v in {"g0": mass, "g1": mass * x, "h00": free, "h01": free * x, "h11": free * x * x}.items()]
        unmet.clear()
        for r in cells.join(params(), "source").groupBy("source").agg(*sums).collect():
            want = budget.get(r.source, 0.0) / scale[r.source]  # of documents and of tokens in mean sizes alike
            e0, e1 = want - r.g0, want - r.g1
            if r.source in full or max(abs(e0), abs(e1)) <= tolerance * max(1.0, want):
                continue
            unmet.add(r.source)
            ridge = 1e-9 * (r.h00 + r.h11) + 1e-12
            a, b, c = r.h00 + ridge, r.h01, r.h11 + ridge
            det = a * c - b * b
            da, dt = (c * e0 - b * e1) / det, (a * e1 - b * e0) / det
            short = min(1.0, 1.5 / max(abs(da), abs(dt), 1e-12))
            dual[r.source] = (dual[r.source][0] + short * da, dual[r.source][1] + short * dt)
        if not unmet:
            break
    for s in unmet:
        dual[s], longest[s] = start[s], math.inf
    most = F.when(fits, F.col("n") * F.col("max_repeats")).otherwise(0)
    exact = cells.join(params(), "source").select("source", "n_tokens", "n", most.alias("most"), "budget", (F.col("n") * rate).alias("want")) if per else None
    if exact is None:
        mixture = sized.withColumn("copies", F.lit(0)).where("copies > 0")
    else:
        def whole(cell: pd.DataFrame) -> pd.DataFrame:
            cell = cell.sort_values("n_tokens")
            got = whole_copies(cell["n_tokens"].to_numpy(), cell["want"].to_numpy(), cell["most"].to_numpy(), float(cell["budget"].iloc[0]))
            return cell[["source", "n_tokens", "n"]].assign(quota=got)

        quota = cut_lineage(exact.groupBy("source").applyInPandas(whole, "source string, n_tokens long, n long, quota long"))
        quota = quota.select("source", "n_tokens", F.floor(F.col("quota") / F.col("n")).cast("int").alias("base"), (F.col("quota") % F.col("n")).alias("extra"))
        ranked = distributed_rank(sized.withColumn("_u", unit_hash("doc_id", seed)), ["source", "n_tokens"], "_u", "doc_id", "_r")
        copies = F.col("base") + F.when(F.col("_r") <= F.col("extra"), 1).otherwise(0)
        mixture = ranked.join(quota, ["source", "n_tokens"]).select("doc_id", "source", "n_tokens", copies.cast("int").alias("copies")).where("copies > 0")
    used = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.count(F.lit(1)).alias("used_documents"), F.sum("copies").alias("copies"))
    had = spark.createDataFrame([(s, r.docs, r.tokens, float(budget.get(s, 0.0)), s in full) for s, r in per.items()], "source string, n_documents long, available_tokens long, budget_tokens double, full boolean")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    all_ = F.sum("actual_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    weight = sum(share.values()) or 1.0
    report = wanted.join(had, "source", "left").join(used, "source", "left").select(
        "source", "target_share", "max_repeats", zero("n_documents"), zero("available_tokens"), F.coalesce("budget_tokens", F.lit(0.0)).alias("budget_tokens"), zero("actual_tokens"), zero("used_documents"), zero("copies"), F.coalesce("full", F.lit(False)).alias("full"),
    ).withColumn("actual_share", F.coalesce(F.try_divide(F.col("actual_tokens").cast("double"), all_), F.lit(0.0)))
    off = F.col("actual_share") - F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)) / weight
    side = F.when(F.abs(off) <= share_tolerance, "met").otherwise(F.concat(F.when(off > 0, "above").otherwise("below"), F.when(F.col("full"), " (exhausted)").otherwise("")))
    return mixture, report.withColumn("status", F.when(F.col("n_documents") == 0, "no documents").otherwise(side)).drop("full")
