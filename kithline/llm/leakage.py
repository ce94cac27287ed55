"""Evaluation texts leaking into training text.

The items are cut into overlapping chunks and put into an inverted index: for each term the list of the blocks of chunks that have it, with its largest
BM25 impact in the block, and below that the chunks with theirs.  Every page is a query of block-max WAND.  Of its terms, ordered by the largest impact of their
lists, those before the pivot can't reach any threshold together, so only blocks in lists from the pivot on are visited; of these the ones are skipped whose
block maxima, at first with list maxima for the terms before the pivot and then with theirs, stay below the thresholds of their chunks; the chunks of what is left are scored
exactly.  Items whose chunk reaches its threshold are verified word by word on the page.

Words are compared by a skeleton in which letters that scanners confuse are one letter, and a match is confirmed
letter by letter with the direction of the misreading.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a scanner makes of a printed letter (lower case).
MISREAD = {
    "a": "ao0", "b": "b8", "c": "ceo0", "e": "eco0", "f": "fs", "g": "gq", "h": "hb", "i": "il1", "l": "l1i", "n": "nu",
    "o": "o0", "r": "rvy", "s": "sf5", "t": "tfs", "u": "un", "v": "vy", "é": "é6",
}
MISREAD_PAIRS = {"d": "[ceo0][l1i]", "m": "[rvy][nu]", "w": "[vy][vy]", "ü": "[il1][il1]", "ß": "[sf5][sf5]"}
#: Letters that MISREAD connects share a skeleton letter; letters read as two are written as two.
SKELETON = {c: k for k, cs in {"o": "ecoa0", "r": "rvy", "n": "nu", "i": "il1", "f": "tfs5", "b": "hb8", "g": "gq", "6": "é6"}.items() for c in cs}
SKELETON |= {"m": "rn", "w": "rr", "d": "oi", "ü": "ii", "ß": "ff"}


class _Letters(dict):
    """For str.translate: drops what is neither letter, digit nor white space, and replaces some letters."""

    def __init__(self, replaced: dict[str, str]):
        super().__init__(str.maketrans(replaced))

    def __missing__(self, k: int) -> int | None:
        c = chr(k)
        self[k] = v = k if c.isalnum() or c.isspace() else None
        return v


LETTERS, FOLD = _Letters({}), _Letters(SKELETON)
#: Power of the log frequency ratio in that test; rare words decide.
POWER = 2
SEGMENT = re.compile(r"[\n\r\f\v]|[ \t]{2,}")


def letters(text: str) -> str:
    return text.lower().translate(LETTERS)


def segments(clean: str) -> list[list[str]]:
    """Runs of words that stand together: a line, or a column's part of a line set off by wide blanks."""
    return [w for x in SEGMENT.split(clean) if (w := x.split())]


_same: dict[tuple[str, str], bool] = {}
_patterns: dict[str, re.Pattern] = {}


def same_word(printed: str, read: str) -> bool:
    """Whether a scanner may have read `printed` as `read`."""
    if printed == read:
        return True
    if (k := (printed, read)) not in _same:
        if len(_same) > 200_000:
            _same.clear()
        if printed not in _patterns:
            _patterns[printed] = re.compile("".join(f"(?:{re.escape(c)}|{MISREAD_PAIRS[c]})" if c in MISREAD_PAIRS else f"[{MISREAD[c]}]" if c in MISREAD else re.escape(c) for c in printed))
        _same[k] = _patterns[printed].fullmatch(read) is not None
    return _same[k]


class Item:
    """The words of a test item, ready for verification, and those of its question."""

    def __init__(self, text: str, question: str | None = None):
        self.question = {w.translate(FOLD) for w in letters(question or "").split() if len(w) >= 4}
        self.raw = letters(text).split()
        self.words = [w.translate(FOLD) for w in self.raw]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.initial: dict[str, list[int]] = defaultdict(list)
        self.weights: np.ndarray = np.ones(len(self.words))
        for p, w in enumerate(self.words):
            self.at[w].append(p)
            self.initial[w[:1]].append(p)

    def prepare(self, weights: np.ndarray, vocabulary: dict[str, int], run: int) -> None:
        self.weights, self.numbers = weights, np.array([vocabulary[w] for w in self.words], dtype=np.int64)
        all_ = np.cumsum(np.concatenate([[0.0], weights]))
        self.runs = all_[run:] - all_[:-run]

    def best_share(self, present: np.ndarray, run: int) -> float:
        """Largest share, by weight, of the words of any `run` consecutive ones that are among those present, a flag for each word of the vocabulary."""
        got = np.zeros(len(self.weights) + 1)
        np.cumsum(self.weights * present[self.numbers], out=got[1:])
        return float(((got[run:] - got[:-run]) / self.runs).max())

    def longest_run(self, raw: list[list[str]], folded: list[list[str]], reach: int) -> int:
        """Most consecutive words of the item that the page has in order.

        A run leaves a segment only at its end and goes on only at the start of a segment at most `reach`
        segments on; a word may be broken there.
        """
        top, open_, broken = 0, {}, {}  # next position -> (run, segment); rest of a word -> {its position: (run, segment)}
        at, initial, words = self.at, self.initial, self.words
        for s, (rs, fs) in enumerate(zip(raw, folded)):
            run: dict[int, int] = {}
            last = len(fs) - 1
            for t, f in enumerate(fs):
                now: dict[int, int] = {}
                for p in at.get(f, ()):
                    if same_word(self.raw[p], rs[t]):
                        n = run.get(p, 0)
                        if t == 0 and p in open_ and s - open_[p][1] <= reach:
                            n = max(n, open_[p][0])
                        now[p + 1] = n + 1
                if t == 0 and f in broken:
                    for p, (n, k) in broken[f].items():
                        if s - k <= reach:
                            now[p + 1] = max(now.get(p + 1, 0), n + 1)
                if t == last:
                    for p in initial.get(f[:1], ()):
                        if len(words[p]) > len(f) and words[p].startswith(f):
                            n = run.get(p, 0)
                            if t == 0 and p in open_ and s - open_[p][1] <= reach:
                                n = max(n, open_[p][0])
                            rest = broken.setdefault(words[p][len(f) :], {})
                            if p not in rest or n >= rest[p][0] or s - rest[p][1] > reach:
                                rest[p] = (n, s)
                run = now
                if now:
                    top = max(top, max(now.values()))
            for p, n in run.items():
                if p not in open_ or n >= open_[p][0] or s - open_[p][1] > reach:
                    open_[p] = (n, s)
        return top


class Index:
    """BM25 inverted index of item chunks in blocks with maxima; its size is in proportion to the words of the items.

    A chunk has `run + stride` words, one starting every `stride` words, so each run of `run` words lies in one chunk.  A
    chunk's threshold is `keep` times the least score that a run of that length in it can have.
    """

    def __init__(self, ids: list[int], texts: list[str], run: int, stride: int, keep: float, block: int, questions: list[str | None] | None = None, k1: float = 1.2, b: float = 0.75):
        self.ids, self.texts, self.run, self.block = ids, list(zip(texts, questions or [None] * len(texts))), run, block
        words = [letters(t).translate(FOLD).split() for t in texts]
        chunks = [(i, x[s : s + run + stride]) for i, x in enumerate(words) for s in range(0, max(1, len(x) - run + 1), stride) if len(x) >= run]
        bags = [Counter([*w, *zip(w, w[1:])]) for _, w in chunks]
        df = Counter(t for bag in bags for t in bag)
        n, mean = max(1, len(bags)), sum(map(len, bags)) / max(1, len(bags))
        impact = lambda t, bag: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * len(bag) / mean))
        # alike chunks stand in one block, which keeps the bounds tight
        order = sorted(range(len(bags)), key=lambda c: [(-df[t], t) for t in sorted((t for t in bags[c] if isinstance(t, tuple)), key=lambda t: (-df[t], t))[:3]])
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, ws in chunks for w in ws}))}
        self.size = len(self.vocabulary)
        pairs = sorted({(self.vocabulary[a], self.vocabulary[z]) for bag in bags for t in bag if isinstance(t, tuple) for a, z in [t]})
        self.pairs = np.array([a * self.size + z for a, z in pairs], dtype=np.int64)
        self.weights = np.array([np.log1p(len(bags) / (1 + df[w])) ** POWER for w in self.vocabulary])
        self.rests: dict[str, dict[str, str]] = defaultdict(dict)  # first part of a word -> {its rest: the word}
        for w in self.vocabulary:
            for k in range(1, len(w)):
                self.rests[w[:k]][w[k:]] = w
        row = {p: self.size + k for k, p in enumerate(pairs)}
        key = lambda t: self.vocabulary[t] if isinstance(t, str) else row[self.vocabulary[t[0]], self.vocabulary[t[1]]]
        blocks = self.blocks = -(-len(order) // block)
        term, place, value = [], [], []
        need, self.owner = np.full(max(1, blocks) * block, np.inf, dtype=np.float32), np.full(max(1, blocks) * block, -1, dtype=np.int64)
        for at, c in enumerate(order):
            i, w = chunks[c]
            score = {t: impact(t, bags[c]) for t in bags[c]}
            term += [key(t) for t in score]
            place += [at] * len(score)
            value += score.values()
            need[at] = keep * min(sum(score[t] for t in {*w[s : s + run], *zip(w[s : s + run], w[s + 1 : s + run])}) for s in range(len(w) - run + 1))
            self.owner[at] = i
        # postings in order of term and chunk, and their blocks
        term, place = np.array(term, dtype=np.int64), np.array(place, dtype=np.int64)
        sort = np.lexsort((place, term))
        self.place, self.impact = place[sort].astype(np.int32), np.array(value, dtype=np.float32)[sort]
        code = term[sort] * max(1, blocks) + self.place // block
        self.code, first = np.unique(code, return_index=True)  # an entry for each term and block
        self.entry = np.append(first, len(code))
        self.most = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0, dtype=np.float32)
        terms = self.size + len(pairs)
        self.list = np.searchsorted(self.code, np.arange(terms + 1) * max(1, blocks))
        self.in_block = (self.code % max(1, blocks)).astype(np.int32)
        self.top = np.zeros(terms, dtype=np.float32)
        np.maximum.at(self.top, self.code // max(1, blocks), self.most)
        self.need, self.least = need, need.reshape(-1, block).min(axis=1)
        self.floor = float(self.least.min()) if blocks else np.inf
        self.mark = np.zeros(terms + 1, dtype=bool)
        self.visited = self.scored = 0  # blocks, of all pages so far
        self.known: dict[int, Item] = {}

    def item(self, i: int) -> Item:
        """An item ready for verification; those of late are kept."""
        if i not in self.known:
            if len(self.known) >= 2_000:
                self.known.clear()
            x = self.known[i] = Item(*self.texts[i])
            x.prepare(self.weights[[self.vocabulary[w] for w in x.words]], self.vocabulary, self.run)
        return self.known[i]

    def rejoined(self, folded: list[list[str]], reach: int) -> list[tuple[str | None, str, str | None]]:
        """Words of which a first part ends a segment and the rest begins one at most `reach` segments on, each between its neighbours."""
        heads: dict[str, list[int]] = defaultdict(list)
        for k, x in enumerate(folded):
            heads[x[0]].append(k)
        out = {}
        for k, x in enumerate(folded):
            rests = self.rests.get(x[-1])
            for r in rests.keys() & heads.keys() if rests else ():
                for y in heads[r]:
                    if 0 < y - k <= reach:
                        out[x[-2] if len(x) > 1 else None, rests[r], folded[y][1] if len(folded[y]) > 1 else None] = True
        return list(out)

    def terms(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the distinct terms of a page; words are numbers of the vocabulary or -1."""
        a, z = words[:-1], words[1:]
        two = (a * self.size + z)[(a >= 0) & (z >= 0) & ~ends[:-1]]
        at = np.searchsorted(self.pairs, two)
        at[at == len(self.pairs)] = 0
        hit = at[self.pairs[at] == two] + self.size if len(self.pairs) else at[:0]
        self.mark[words[words >= 0]] = True
        self.mark[hit] = True
        rows = np.flatnonzero(self.mark)
        self.mark[rows] = False
        return rows

    def candidates(self, rows: np.ndarray) -> set[int]:
        """Items with a chunk that reaches its threshold."""
        rows = rows[np.argsort(self.top[rows], kind="stable")]
        upto = np.cumsum(self.top[rows], dtype=np.float64)
        pivot = int(np.searchsorted(upto, self.floor))
        if pivot >= len(rows):
            return set()
        before, rest = rows[:pivot], float(upto[pivot - 1]) if pivot else 0.0
        at = _ranges(self.list[rows[pivot:]], self.list[rows[pivot:] + 1])
        bound = np.bincount(self.in_block[at], weights=self.most[at], minlength=self.blocks)
        visited = np.flatnonzero((bound > 0) & (bound + rest >= self.least))
        self.visited += len(visited)
        if not len(visited):
            return set()
        # the terms before the pivot, in the blocks that are left: by search if these are few, else by their lists
        number = np.full(self.blocks, -1, dtype=np.int64)
        number[visited] = np.arange(len(visited))
        lengths = self.list[before + 1] - self.list[before]
        if len(before) * len(visited) * 16 < int(lengths.sum()):
            want = (before[:, None] * self.blocks + visited[None, :]).ravel()
            hit = np.minimum(np.searchsorted(self.code, want), len(self.code) - 1)
            hit = hit[self.code[hit] == want]
        else:
            hit = _ranges(self.list[before], self.list[before + 1])
            hit = hit[number[self.in_block[hit]] >= 0]
        full = bound[visited] + np.bincount(number[self.in_block[hit]], weights=self.most[hit], minlength=len(visited))
        chosen = np.flatnonzero(full >= self.least[visited])
        self.scored += len(chosen)
        if not len(chosen):
            return set()
        number[:] = -1
        number[visited[chosen]] = np.arange(len(chosen))
        entries = np.concatenate([at, hit])
        entries = entries[number[self.in_block[entries]] >= 0]
        posts = _ranges(self.entry[entries], self.entry[entries + 1])
        slot = number[self.place[posts] // self.block] * self.block + self.place[posts] % self.block
        scores = np.bincount(slot, weights=self.impact[posts], minlength=len(chosen) * self.block)
        chunk = (visited[chosen][:, None] * self.block + np.arange(self.block)[None, :]).ravel()
        return set(self.owner[chunk[scores >= self.need[chunk] - 1e-4]].tolist())


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    size = end - begin
    return np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum())) if len(size) else np.zeros(0, dtype=np.int64)


def leaked(index: Index, text: str, run: int, reach: int, share: float) -> list[tuple[int, int, float | None]]:
    """(number of the item, words of its longest run, share of its question's words) of each item of which the text has a run."""
    folded = segments(text.lower().translate(FOLD))
    n = sum(map(len, folded))
    if n < run:
        return []
    get = index.vocabulary.get
    words = np.array([get(w, -1) for s in folded for w in s], dtype=np.int64)
    ends = np.zeros(n, dtype=bool)
    ends[np.cumsum([len(s) for s in folded]) - 1] = True
    broken = index.rejoined(folded, reach)
    words = np.append(words, np.array([get(w, -1) for x in broken for w in x], dtype=np.int64))
    ends = np.append(ends, np.array([False, False, True] * len(broken), dtype=bool))
    # the whole page is one passage: what stands between the parts of a run may be longer than any shorter one
    hits = index.candidates(index.terms(words, ends))
    if not hits:
        return []
    raw, best = None, {}
    present = np.zeros(index.size, dtype=bool)
    present[words[words >= 0]] = True
    for i in hits:
        if index.item(i).best_share(present, run) >= share:
            raw = raw or segments(letters(text))
            best[i] = index.item(i).longest_run(raw, folded, reach)
    found = [(i, k) for i, k in sorted(best.items()) if k >= run]
    every = {w for x in folded for w in x} if any(index.item(i).question for i, _ in found) else set()
    return [(i, k, len(q & every) / len(q) if (q := index.item(i).question) else None) for i, k in found]


def find_leaks(
    documents: DataFrame, items: DataFrame, *, run: int = 15, stride: int = 4, keep: float = 0.8, share: float = 0.9, block: int = 8, reach: int = 60, least_question: float = 0.0, pass_chars: int = 8_000_000,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", question: str = "question",
) -> DataFrame:
    """item_id, doc_id, n_words, question_share: each page that has `run` or more consecutive words of an item, the longest run, and the share
    of the words of four or more letters of the item's question that the page has, too (null without a question).

    The documents are read in place and never shuffled: the index goes to them.  Its size is in proportion to the items' text, about 50 bytes a
    character; items of more than pass_chars characters (some 30,000 items) are split by a hash of their id, and each part is one pass over the documents.  least_question: an item with
    a question is only reported where the page has that share of the question's words, too.  keep: the part of the score of a run that damage must leave (see Index).  share: the part of the weight of a
    run's words that the page must have somewhere before the words are compared in order.  reach: lines of other columns that may come between.

    Null or empty texts leak nothing; items under `run` words can't leak; items of equal text are all reported; an
    item id that occurs twice with different texts gives one row with the longest run.
    """
    spark = documents.sparkSession
    asked = F.col(question) if question in items.columns else F.lit(None)
    held = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t"), asked.cast("string").alias("q")).where("i is not null and t is not null")
    total = held.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, -(-total // pass_chars))
    pages = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where("t is not null and t <> ''")
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, doc_id {documents.schema[doc_id].dataType.simpleString()}, n_words int, question_share double"
    out = None
    for s in range(shards):
        part = held.where(F.pmod(F.xxhash64("i"), F.lit(shards)) == s).orderBy("i").collect()
        index = spark.sparkContext.broadcast(Index([r[0] for r in part], [r[1] for r in part], run, stride, keep, block, [r[2] for r in part]))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            x = index.value
            for b in batches:
                hits = [(x.ids[i], d, k, q) for d, t in zip(b["doc_id"], b["t"]) for i, k, q in leaked(x, t, run, reach, share)]
                yield pd.DataFrame(hits, columns=["item_id", "doc_id", "n_words", "question_share"])

        found = pages.mapInPandas(search, schema)
        out = found if out is None else out.unionByName(found)
    if least_question > 0:
        out = out.where(F.coalesce(F.col("question_share") >= least_question, F.lit(True)))
    return out.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"), F.max("question_share").alias("question_share"))


def leak_report(leaks: DataFrame) -> DataFrame:
    """One row per affected page: doc_id, items (in order), longest_run, and for how many of them half of the question stands there, too."""
    asked = F.when(F.col("question_share") >= 0.5, 1).otherwise(0)
    return leaks.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max("n_words").alias("longest_run"), F.sum(asked).alias("questions_present"))
