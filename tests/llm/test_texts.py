import random

import numpy as np
import pytest

from kithline.llm import chunking, leakage, mixture, tokens

ITEM = "Skaters were out in numbers at Gilwickxford on Thursday, the ice being 6 inches thick. At the close Mr. Breanneaton, in a few heavy words, proposed the health of the farmer."
WORDS = ITEM.split()


def leaks(spark, docs, items=((1, ITEM, None),), **kw):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(docs)], "doc_id int, text string, item_id string")
    return {(r.item_id, r.doc_id): r.n_words for r in leakage.find_leaks(d, spark.createDataFrame(list(items), "item_id int, text string, question string"), **kw).collect()}


def test_leaks(spark):
    two = "\n".join(f"{a:<40}{b}" for a, b in zip(["Skaters were out in numbers at", "Gilwickx¬", "ford on Thursday, the ice being", "6 inches thick. At the close Mr."], ["A clerk was charged at Fenaby", "with removing timber from the", "grain store, as had been", "feared. FOR SALE, 32 pigs."]))
    mixed = "\n".join(x for pair in zip(["skatcrs vvere 0ut in nurnbers", "at Gilwickxforcl on Thurfday", "the ice being 6 inohes thick", "At the close Mr Breanneaton"], ["A COW FOR SALE", "APPLY AT ONCE", "TO THE OWNER", "OF FENABY FARM"]) for x in pair)
    docs = [
        "Before. " + " ".join(WORDS[:15]) + " Then something else.", "Before. " + " ".join(WORDS[:14]) + " Then something else.", ITEM.replace("Gilwickxford", "Torderquay").replace("Breanneaton", "Miller"), two, mixed, None, "", "   \n", ITEM.upper() * 3, " ".join(WORDS[::-1]), ITEM, ITEM,
    ]
    got = leaks(spark, docs)
    assert {d for _, d in got} == {0, 3, 4, 8, 10, 11} and got[1, 0] == 15 and got[1, 10] == len(WORDS)


def test_leaks_in_shards_and_odd_items(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("bdgklmprstvz") + r.choice("aeiou") for _ in range(3)) for _ in range(300)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(30)) for _ in range(40)]
    docs = [" ".join(r.choice(vocabulary) for _ in range(200)) for _ in range(60)]
    for k in range(0, 60, 3):  # every third has a passage
        w = texts[k % 40].split()
        docs[k] += "\n" + " ".join(w[5 : 5 + (16 if k % 2 else 12)]) + "\n" + docs[k][:100]
    items = [*((i, t, None) for i, t in enumerate(texts)), (90, None, None), (91, "", "q"), (92, "too short", None), (3, texts[4], None)]
    one, many = leaks(spark, docs, items), leaks(spark, docs, items, pass_chars=1000)
    brute = set()
    for i, t, _ in items:
        w = (t or "").lower().split()
        for k, d in enumerate(docs):
            if any(" ".join(w[s : s + 15]) in d for s in range(len(w) - 14)):
                brute.add((i, k))
    assert set(one) == set(many) == brute and brute
    assert leaks(spark, docs[:3], [(90, None, None)]) == {}


def test_leaks_around_a_long_advert():
    """Fifteen words with some 160 words of other columns' lines in their middle."""
    words = [f"{a}{b}" for a in ("mar", "kel", "dov", "tin", "sul") for b in ("gat", "por", "zin", "hub")]
    index = leakage.Index([1, 2], [" ".join(words), " ".join(w[::-1] for w in words)], 15, 4, 0.8, 8)
    advert = [" ".join(f"x{r}y{c}" for c in range(8)) for r in range(20)]
    for cut in (4, 8, 11):
        page = "\n".join(["other news of the day", " ".join(words[2 : 2 + cut]), *advert, " ".join(words[2 + cut : 17]), "and more"])
        assert [(i, k) for i, k, _ in leakage.leaked(index, page, run=15, reach=60, share=0.9)] == [(0, 15)], cut


def test_leaks_with_a_rare_word_broken_before_an_advert():
    """The rest of the word stands twelve lines on; no other item has it, which makes it worth more than what may be missing."""
    common = "the of and to in that was for with his had from they were been this".split()
    texts = [" ".join(["breanneaton" if (k, j) == (0, 7) else w for j, w in enumerate(random.Random(k).sample(common, 15))]) for k in range(60)]
    words = texts[0].split()
    index = leakage.Index(list(range(60)), texts, 15, 4, 0.8, 8)
    for lines, want in ((12, 15), (70, None)):
        page = "\n".join([" ".join(words[:7]) + " breanne", *[f"x{r}y z{r}y" for r in range(lines)], "aton " + " ".join(words[8:])])
        got = {i: k for i, k, _ in leakage.leaked(index, page, run=15, reach=60, share=0.9)}
        assert got.get(0) == want, (lines, got)


def test_leak_report(spark):
    d = spark.createDataFrame([(1, ITEM + " where did the skaters meet"), (2, "x")], "doc_id int, text string")
    i = spark.createDataFrame([(7, ITEM, "where did the skaters meet"), (8, ITEM, None)], "item_id int, text string, question string")
    r = leakage.leak_report(leakage.find_leaks(d, i)).collect()
    assert [(x.doc_id, x.items, x.questions_present) for x in r] == [(1, [7, 8], 1)]


def test_range_max():
    v = np.random.default_rng(1).integers(0, 99, 133)
    t = chunking.RangeMax(v)
    assert all(t.query(a, b) == v[a : b + 1].max() for a in range(0, 133, 3) for b in range(a, 133))


@pytest.mark.parametrize("text", [
    "One sentence here. Another one there.\n\n" * 40, "word " * 500, "x" * 3000, "日本語テキスト。" * 120, "😀" * 400, "a list\nof lines\nwithout sentences\n" * 60, "Mixed é text—with ‘signs’ and\tTabs.\n  An indent. " * 50, "\n" * 900,
])
def test_pieces(text):
    enc = tokens.encoding(tokens.default_path())
    cuts = chunking.split_text(text, 96, 12, enc)
    n = len(enc.encode_ordinary(text))
    assert cuts[0][0] == 0 and cuts[-1][1] == n and cuts[0][2] == 0 and cuts[-1][3] == len(text)
    for k, (f, e, c, z, _) in enumerate(cuts):
        assert 0 < e - f <= 96 and c < z and len(enc.encode_ordinary(text[c:z])) <= 96
        if k:
            assert 12 <= cuts[k - 1][1] - f <= 15 and f > cuts[k - 1][0] and c <= cuts[k - 1][3]


def test_pieces_cut_where_it_is_best():
    enc = tokens.encoding(tokens.default_path())
    text = "\n\n".join("The bench met again on Monday. It was a long day for all." for _ in range(30))
    assert {k for *_, k in chunking.split_text(text, 64, 8, enc)[:-1]} == {"paragraph"}


def test_split_documents(spark):
    docs = spark.createDataFrame([(1, "a b c. " * 400, "en", 1), (2, "short", "en", 2), (3, None, "de", 3), (4, "", None, 4), (5, "Ein Satz. " * 300, None, 5), (6, "x y. " * 300, "zz", 6)], "doc_id int, text string, lang string, piece_no int")
    limits = spark.createDataFrame([("en", 100, 10), ("de", 50, 5)], "lang string, max_tokens int, overlap_tokens int")
    rows = chunking.split_documents(docs, limits).collect()
    assert {r.doc_id for r in rows} == {1, 5, 6} and all(r.n_tokens <= 100 for r in rows)
    for d in (1, 5, 6):
        own = sorted((r for r in rows if r.doc_id == d), key=lambda r: r.piece_no)
        assert [r.piece_no for r in own] == list(range(len(own))) and own[0].overlap_tokens == 0 and all(r.overlap_tokens >= 10 for r in own[1:])
    assert chunking.split_documents(docs.limit(0), limits).count() == 0
    with pytest.raises(ValueError):
        chunking.split_documents(docs, limits.where("lang = 'de'"))


def test_budgets():
    b = mixture.budgets({"a": 10, "b": 1000, "c": 1000}, {"a": 0.5, "b": 0.25, "c": 0.25, "none": 0.0}, 100)
    assert b == {"a": 10, "b": 45, "c": 45}
    assert mixture.budgets({}, {"a": 1.0}, 100) == {"a": 0}
    assert abs(mixture.best_total({"a": 1000, "b": 10_000}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 9000) - 2000) < 1e-6
    assert mixture.best_total({"a": 3, "b": 10_000}, {"a": 0.01, "b": 0.99}, {"a": 3, "b": 50}, 9000) > 1000
    assert mixture.best_total({}, {"a": 1.0}, {}, 0.0) == 0


def test_mixture(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["big"] * 10 + ["small", "unlisted", None]), " ".join(r.choice(["one", "two", "three"]) for _ in range(r.choice([3, 10, 50, 200])))) for i in range(900)]
    rows += [(2000, "big", ""), (2001, "big", None), (0, "big", "a repeated id")]
    docs = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumnRenamed("nothing", "x")
    targets = spark.createDataFrame([("big", 0.6, 2), ("small", 0.3, 3), ("tiny", 0.1, 4)], "source string, target_share double, max_repeats int")
    mix, report = mixture.mix_sources(docs, targets)
    rep, got = {x.source: x for x in report.collect()}, mix.collect()
    assert rep["tiny"].status == "no documents" and rep["tiny"].actual_share == 0
    assert all(1 <= x.copies <= {"big": 2, "small": 3}[x.source] for x in got)
    for s in ("big", "small"):
        tokens_ = sum(x.copies * x.n_tokens for x in got if x.source == s)
        assert tokens_ == rep[s].actual_tokens and abs(tokens_ - rep[s].budget_tokens) <= 10
    assert abs(sum(x.actual_share for x in rep.values()) - 1) < 1e-9
    if rep["small"].status == "met":
        assert abs(rep["small"].actual_share / rep["big"].actual_share - 0.5) < 0.02
    none, nothing = mixture.mix_sources(docs.limit(0), targets)
    assert none.count() == 0 and {x.status for x in nothing.collect()} == {"no documents"}


def test_mixture_is_balanced_without_documents_beyond_the_budget(spark):
    """The mean size of the source is kept though its longest document can't be used; the rates were never changed by Newton steps before, and the mean was 21."""
    sizes = [10] * 400 + [30] * 400 + [2500]
    docs = spark.createDataFrame([(k, "a", " ".join(["one"] * n)) for k, n in enumerate(sizes)], "doc_id int, source string, text string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixture.mix_sources(docs, targets, total_tokens=2000)[0].collect()
    assert abs(sum(x.n_tokens * x.copies for x in got) - 2000) <= 10 and max(x.n_tokens for x in got) <= 30
    assert abs(sum(x.n_tokens for x in got) / len(got) - sum(sizes) / len(sizes)) < 0.7
    # where nothing else could make up for it
    alone = mixture.mix_sources(docs.where("doc_id >= 799"), targets, total_tokens=2000)[0].collect()
    assert {x.n_tokens for x in alone} == {2500}


def test_index_walk_finds_all_above_threshold_and_skips():
    """Against the scores of all chunks, for pages with and without parts of items; most blocks are never scored."""
    import random

    import numpy as np

    r = random.Random(8)
    vocabulary = ["".join(r.choice("bdfgklmnprstvz") for _ in range(r.randint(2, 7))) for _ in range(900)]
    often = [1 / (k + 3) for k in range(900)]
    texts = [" ".join(r.choices(vocabulary, often, k=r.randint(5, 90))) for _ in range(150)]
    index = leakage.Index(list(range(150)), texts, 15, 4, 0.8, 8)
    total = 0
    for n in range(80):
        words = r.choices(vocabulary, often, k=r.randint(0, 200))
        if n % 2:
            part = texts[r.randrange(150)].split()
            words[50:50] = part[: r.randint(8, 30)]
        folded = [w.translate(leakage.FOLD) for w in words]
        numbers = np.array([index.vocabulary.get(w, -1) for w in folded], dtype=np.int64)
        rows = index.terms(numbers, np.zeros(len(numbers), dtype=bool)) if len(numbers) else np.zeros(0, dtype=np.int64)
        scores = np.zeros(len(index.owner))
        for e in np.flatnonzero(np.isin(index.code // max(1, index.blocks), rows)):
            for q in range(index.entry[e], index.entry[e + 1]):
                scores[index.place[q]] += index.impact[q]
        assert index.candidates(rows) == set(index.owner[scores >= index.need - 1e-4].tolist())
        total += index.blocks
    assert index.scored < total / 10 and index.visited < 0.8 * total
    assert leakage.Index([], [], 15, 4, 0.8, 8).candidates(np.zeros(0, dtype=np.int64)) == set()


def test_question_as_a_condition(spark):
    text = " ".join(f"word{chr(97 + k)}" for k in range(20))
    pages = spark.createDataFrame([(1, text), (2, text + " where stands lighthouse")], "doc_id int, text string")
    items = spark.createDataFrame([(7, text, "Where stands the lighthouse"), (8, text, None)], "item_id int, text string, question string")
    got = leakage.find_leaks(pages, items, least_question=0.6).collect()
    assert {(r.item_id, r.doc_id) for r in got} == {(7, 2), (8, 1), (8, 2)}
