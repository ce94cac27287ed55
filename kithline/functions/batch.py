"""String distances of whole batches at once.

Strings are rows of a matrix of code points; the dynamic programs run over one dimension only, as the dependency within a row is
a running minimum.  A batch of n pairs of length L takes L steps on n x L arrays instead of n x L x L scalar steps.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Pairs per step, sorted by length so that little of a matrix is padding, and cells of all their matrices; one long pair may have more.
BATCH, CELLS = 2048, 4_000_000


def encode(texts: Sequence[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths); positions after a text's end hold `pad`."""
    n = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    out = np.full((len(texts), max(1, int(n.max(initial=0)))), pad, dtype=np.int32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.int32)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = flat
    return out, n


def _edit(a, la, b, lb, swaps: str) -> np.ndarray:
    """Edit distances; swaps: "" (Levenshtein), "adjacent" (optimal string alignment) or "any" (Damerau-Levenshtein)."""
    n, wide = b.shape
    j = np.arange(wide + 1)
    rows = [np.tile(j.astype(np.int32), (n, 1))]
    who, out = np.arange(n), lb.copy()
    seen = np.zeros((n, wide), dtype=np.int64)  # last row whose letter is b's
    for i in range(1, a.shape[1] + 1):
        same = a[:, i - 1, None] == b
        up, t = rows[-1], np.empty((n, wide + 1), dtype=np.int32)
        t[:, 0] = i
        np.minimum(up[:, 1:] + 1, up[:, :-1] + ~same, out=t[:, 1:])
        if swaps == "adjacent" and i > 1:
            ok = (a[:, i - 1, None] == b[:, :-1]) & (a[:, i - 2, None] == b[:, 1:])
            np.minimum(t[:, 2:], np.where(ok, rows[-2][:, :-2] + 1, t[:, 2:]), out=t[:, 2:])
        elif swaps == "any":
            at = np.maximum.accumulate(np.where(same, j[1:], 0), axis=1)
            before = np.concatenate([np.zeros((n, 1), dtype=at.dtype), at[:, :-1]], axis=1)  # last column whose letter is a's
            p, q = np.nonzero((before > 0) & (seen > 0))
            for k in np.unique(seen[p, q]):  # the rows that are swapped with
                m = seen[p, q] == k
                x, y = p[m], q[m]
                cost = rows[k - 1][x, before[x, y] - 1] + (i - k - 1) + 1 + (y + 1 - before[x, y] - 1)
                t[x, y + 1] = np.minimum(t[x, y + 1], cost)
            seen = np.where(same, i, seen)
        row = np.minimum.accumulate(t - j, axis=1) + j
        rows.append(row.astype(np.int32))
        if swaps != "any":
            del rows[:-2]
        done = la == i
        out[done] = row[who[done], lb[done]]
    return out


def _lcs(a, la, b, lb) -> np.ndarray:
    """Length of the longest common subsequence."""
    n, wide = b.shape
    row, out, who = np.zeros((n, wide + 1), dtype=np.int32), np.zeros(n, dtype=np.int64), np.arange(n)
    for i in range(1, a.shape[1] + 1):
        t = row.copy()
        np.maximum(t[:, 1:], row[:, :-1] + (a[:, i - 1, None] == b), out=t[:, 1:])
        row = np.maximum.accumulate(t, axis=1)
        done = la == i
        out[done] = row[who[done], lb[done]]
    return out


def _jaro(a, la, b, lb, halves: bool) -> np.ndarray:
    """Jaro similarity; halves: an odd number of displaced letters counts as so many halves, else the half is dropped."""
    n, reach = len(a), np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used, hit = np.zeros(b.shape, dtype=bool), np.zeros(a.shape, dtype=bool)
    j, who = np.arange(b.shape[1])[None, :], np.arange(n)
    for i in range(a.shape[1]):
        ok = (a[:, i, None] == b) & ~used & (j >= i - reach[:, None]) & (j <= i + reach[:, None])
        first, has = ok.argmax(axis=1), ok.any(axis=1)
        used[who[has], first[has]] = True
        hit[has, i] = True
    m = hit.sum(axis=1)
    wide = min(a.shape[1], b.shape[1])
    in_a = np.take_along_axis(a, np.argsort(~hit, axis=1, kind="stable"), axis=1)[:, :wide]
    in_b = np.take_along_axis(b, np.argsort(~used, axis=1, kind="stable"), axis=1)[:, :wide]
    moved = ((in_a != in_b) & (np.arange(wide)[None, :] < m[:, None])).sum(axis=1)
    t = moved / 2 if halves else moved // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(m > 0, (m / la + m / lb + (m - t) / m) / 3, 0.0)


def _letters(a, la, b, lb) -> tuple[np.ndarray, np.ndarray]:
    """(distance of the letter counts, cosine of the letter counts)."""
    if a.size * (a.shape[1] + b.shape[1]) > 4 * CELLS:
        dist, cos = np.zeros(len(a)), np.zeros(len(a))
        for k in range(len(a)):
            x, y = (dict(zip(*np.unique(t[k, :n], return_counts=True))) for t, n in ((a, la[k]), (b, lb[k])))
            dist[k] = sum(abs(int(x.get(c, 0)) - int(y.get(c, 0))) for c in {*x, *y})
            norm = (sum(int(v) ** 2 for v in x.values()) * sum(int(v) ** 2 for v in y.values())) ** 0.5
            cos[k] = sum(int(v) * int(y.get(c, 0)) for c, v in x.items()) / norm if norm else 0.0
        return dist, cos
    both = np.concatenate([a, b], axis=1)
    real = np.concatenate([np.arange(a.shape[1])[None, :] < la[:, None], np.arange(b.shape[1])[None, :] < lb[:, None]], axis=1)
    ca = (both[:, :, None] == a[:, None, :]).sum(axis=2)
    cb = (both[:, :, None] == b[:, None, :]).sum(axis=2)
    share = np.where(real, 1.0 / np.maximum(ca + cb, 1), 0.0)  # each distinct letter counts once in all
    norm = np.sqrt((ca * ca * share).sum(axis=1) * (cb * cb * share).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(norm > 0, (ca * cb * share).sum(axis=1) / norm, 0.0)
    return np.rint((np.abs(ca - cb) * share).sum(axis=1)), cosine


def similarities(left: Sequence[str], right: Sequence[str], methods: Sequence[str]) -> dict[str, np.ndarray]:
    """Similarity of each pair by each method: lv, osa, dl, lcs, qgram (1 - distance / longer length), cosine, jw (plain Jaro),
    jw_floor.  NaN for two empty strings, but 0 by jw."""
    out = {m: np.full(len(left), np.nan) for m in methods}
    longest = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right)), dtype=np.int64, count=len(left))
    order = np.argsort(longest, kind="stable")
    end = 0
    while (start := end) < len(order):
        end = min(start + BATCH, len(order))
        while end - start > 1 and (end - start) * int(longest[order[end - 1]] + 1) ** 2 > CELLS:
            end = start + (end - start) // 2
        at = order[start:end]
        a, la = encode([left[k] for k in at], -1)
        b, lb = encode([right[k] for k in at], -2)
        longer = np.maximum(la, lb).astype(float)
        longer[longer == 0] = np.nan
        counts = _letters(a, la, b, lb) if {"qgram", "cosine"} & set(methods) else None
        for m in methods:
            if m in ("lv", "osa", "dl"):
                v = 1 - _edit(a, la, b, lb, {"lv": "", "osa": "adjacent", "dl": "any"}[m]) / longer
            elif m == "lcs":
                v = 1 - (la + lb - 2 * _lcs(a, la, b, lb)) / longer
            elif m == "qgram":
                v = 1 - counts[0] / longer
            elif m == "cosine":
                v = np.where(np.isnan(longer), np.nan, counts[1])
            elif m in ("jw", "jw_floor"):
                v = _jaro(a, la, b, lb, m == "jw")
            else:
                raise ValueError(f"unknown method {m}")
            out[m][at] = v
    return out
