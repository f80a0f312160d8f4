"""Similarity join, repeated passages, decontamination and components against brute force."""

import random

import numpy as np
import pytest

from rivulet.llm import decontaminate, jaccard, sentence_spans
from rivulet.llm.components import components

from .helpers import DOC, SF, awkward, documents, empty, prose, rows


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def naive_groups(texts):
    sets = [shingle_set(t) for t in texts]
    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * 5 >= len(sets[i] | sets[j]) * 4:
                links[i].add(j)
                links[j].add(i)
    group = list(range(len(texts)))
    for i in range(len(texts)):
        todo, seen = [i], {i}
        while todo:
            for y in links[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        group[i] = min(seen)
    return group, [len(x) for x in links]


def edited(text, n, seed):
    r = random.Random(seed)
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


def near_corpus():
    base = [prose(k, 120) for k in range(6)]
    texts = [*base, *base[:2], *[edited(base[0], 1, s) for s in range(30)], *[edited(base[1], k % 5, 90 + k) for k in range(25)]]
    chain = base[5]
    for s in range(6):  # neighbours are similar, the ends are not
        chain = edited(chain, 2, 500 + s)
        texts.append(chain)
    return texts + ["", None, "one two", "one two", "One  two", "one two three four five"] + [prose(50 + k, 60) for k in range(40)]


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)  # groups are cut into many blocks
    texts = near_corpus()
    group, links = naive_groups(texts)
    got = {r.doc_id: r for r in jaccard.near_duplicates(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].class_id, got[i].n_links) == (group[i], links[i]), i
    kept = sorted(r.doc_id for r in jaccard.keep_one(documents(spark, texts)).collect())
    assert kept == sorted(set(group))


def test_join_of_the_test_table_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = sorted((r.doc_id, r.text) for r in docs.collect())
    group, links = naive_groups([t for _, t in table])
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    for k, (i, _) in enumerate(table):
        assert (got[i].class_id, got[i].n_links) == (table[group[k]][0], links[k])


def test_join_of_awkward_rows(spark):
    odd = awkward(spark)
    assert jaccard.near_duplicates(odd).count() == odd.count()
    out = jaccard.keep_one(odd)
    assert out.columns == odd.columns and out.where("_doc = '_doc' and low = 'low'").count() == out.count() == odd.count() - 1
    assert jaccard.near_duplicates(empty(spark)).collect() == []


def test_posterior_bounds_equal_an_integral():
    for n, least in jaccard.needed(1e-6).items():
        x = np.linspace(0, 1, 200_001)
        for m in (least - 1, least):
            if m < 0:
                continue
            density = x**m * (1 - x)**(n - m)
            reach = density[x >= 0.8].sum() / density.sum()
            assert (reach >= 1e-6) == (m >= least)


def test_pruning_keeps_similar_pairs():
    r = np.random.RandomState(1)
    sets, pairs = [], []
    for _ in range(300):
        a = r.randint(0, 2**62, 400).astype(np.uint64)
        b = a.copy()
        b[:44] = r.randint(0, 2**62, 44)  # similarity 0.8
        pairs.append((len(sets), len(sets) + 1))
        sets += [np.unique(a), np.unique(b)]
    low = jaccard.signatures(sets)
    i, j = map(np.array, zip(*pairs))
    kept, _ = jaccard.survivors(low, low, i, j)
    assert len(kept) == len(pairs)
    far, _ = jaccard.survivors(low, low, i[:-1], j[1:])
    assert not len(far)


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(1000, x) for x in range(1001, 1100)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {x.row: x.label for x in components(spark.createDataFrame(edges, "row long, other long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "row long, other long")).collect() == []


# --- repeated passages

def test_a_planted_passage_is_removed_from_all_but_the_first(spark):
    passage = prose(1000, 60)
    texts = [prose(k, 150) for k in range(12)]
    for k in (3, 5, 9):
        w = texts[k].split()
        texts[k] = " ".join(w[:40 + k]) + " " + passage + " " + " ".join(w[40 + k:])
    got = {r.doc_id: r for r in sentence_spans.repeats(documents(spark, texts)).collect()}
    assert sorted(got) == [5, 9]
    for k in (5, 9):
        assert got[k].sources == [3] and got[k].n_words_removed >= 35
        assert all(texts[k][s.start:s.end].strip() in passage for s in got[k].spans)
        gone = "".join(texts[k][s.start:s.end] for s in got[k].spans)
        assert len(got[k].text) + len(gone) == len(texts[k])


@pytest.mark.parametrize("size", [51, 60])
def test_passages_without_stops_share_a_run_wherever_they_stand(size):
    words = sentence_spans.Words()
    for k in range(300):
        passage = " ".join(w.strip(".").lower() for w in prose(k, size).split())
        texts = [" ".join([prose(10_000 + 2 * k + d, 40 + k % 17 + 5 * d).rstrip("."), passage, prose(20_000 + 2 * k + d, 40)]) for d in (0, 1)]
        found = [set(sentence_spans.Runs([t], words).hash.tolist()) for t in texts]
        assert found[0] & found[1], (size, k)


def test_equal_words_make_equal_runs_and_others_do_not():
    r = random.Random(8)
    texts = [" ".join(r.choice(["a", "b", "c.", "d\n", "-"]) for _ in range(r.randint(0, 120))) for _ in range(200)]
    runs, words = sentence_spans.Runs(texts, sentence_spans.Words()), {}
    for o, h, a, b in zip(runs.owner.tolist(), runs.hash.tolist(), runs.first.tolist(), runs.last.tolist()):
        key = " ".join(x for x in (w.strip(".-") for w in texts[o].split()[a:b + 1]) if x)
        assert len(key.split()) >= 20 and words.setdefault(h, key) == key
    assert len(set(words.values())) == len(words) > 100


def test_a_passage_without_spaces_is_removed(spark):
    r = random.Random(6)
    line = lambda n: "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(n))
    passage = line(60)
    texts = [line(70) + passage + line(50), line(90), line(33) + passage + line(80) + "。"]
    got = {r.doc_id: r for r in sentence_spans.repeats(documents(spark, texts)).collect()}
    assert sorted(got) == [2] and got[2].sources == [0] and got[2].n_words_removed >= 60 - 2 * (sentence_spans.GAP - 1)
    assert all(texts[2][s.start:s.end] in passage for s in got[2].spans)


def naive_repeats(table):
    """Covered tokens of each document by comparing the words of runs, not hashes."""
    words, firsts, runs = sentence_spans.Words(), {}, []
    for i, t in sorted(table.items()):
        found = sentence_spans.Runs([t], words)
        tokens = t.split()
        for a, b in zip(found.first.tolist(), found.last.tolist()):
            key = " ".join(x for x in (sentence_spans.EDGES.sub("", w).lower() for w in tokens[a:b + 1]) if x)
            runs.append((key, i, a, b))
            firsts[key] = min(firsts.get(key, (i, a)), (i, a))
    gone = {}
    for key, i, a, b in runs:
        if firsts[key] != (i, a):
            gone.setdefault(i, set()).update(range(a, b + 1))
    return gone


def test_repeats_of_the_test_table_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = naive_repeats({r.doc_id: r.text for r in docs.collect()})
    got = {r.doc_id: r.n_words_removed for r in sentence_spans.repeats(docs).collect()}
    assert got == {i: len(x) for i, x in want.items()}


def test_repeats_of_awkward_rows(spark):
    odd = awkward(spark)
    assert {r.doc_id for r in sentence_spans.repeats(odd).collect()} <= {4}
    assert sentence_spans.repeats(empty(spark)).collect() == []


# --- decontamination

QUESTION = ("A train leaves Boston at 9 and travels 340 km in 5 hours while another one leaves Denver at 7 with 120 passengers. "
            "How many km does the first train travel in each hour, and how long would it need for 340 km at half the speed?")


def test_leaks_verbatim_and_reparameterised(spark):
    other = QUESTION.replace("340", "510").replace("Boston", "Lisbon").replace(" 9 ", " 8 ")
    mixed = QUESTION.replace("travels 340 km", "travels 777 km")  # 340 would stand for two values
    texts = [prose(1, 90) + " " + QUESTION + " " + prose(2, 50), "x " + other, prose(3, 200), QUESTION.upper()]
    items = spark.createDataFrame([(7, QUESTION), (8, prose(99, 40)), (9, None), (10, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(documents(spark, texts), items).collect()}
    assert set(got) - {(3, 7)} == {(0, 7), (1, 7)}
    assert got[0, 7].kind == "verbatim" and got[1, 7].kind == "reparameterised"
    lone = decontaminate.leaks(documents(spark, [mixed]), items).collect()
    assert all(r.coverage < 1 for r in lone)
    left = decontaminate.without_leaks(documents(spark, texts), items)
    assert 2 in {r.doc_id for r in left.collect()} and not {0, 1} & {r.doc_id for r in left.collect()}


def test_one_changed_mention_leaves_the_verbatim_run(spark):
    items = spark.createDataFrame([(7, QUESTION)], "item_id long, text string")
    texts = [QUESTION.replace("travels 340 km", "travels 777 km"), QUESTION.replace("for 340 km", "for 777 km"),
             " ".join(QUESTION.split()[23:35]), " ".join(QUESTION.split()[23:36]), "x " + QUESTION.replace("340", "510").replace("Boston", "Lisbon")]
    got = {r.doc_id: r for r in decontaminate.leaks(documents(spark, texts), items).collect()}
    assert sorted(got) == [0, 1, 3, 4] and got[1].kind == "verbatim" and got[4].kind == "reparameterised" and got[4].coverage == 1
    assert all(0.5 < got[k].coverage < 1 for k in (0, 1))


def test_conflicting_windows_leave_the_larger_part():
    pair = lambda t, o: {"kind": 1, "theirs": t, "ours": o}
    window = lambda k, t, o: {"ipos": k, "size": 8, "counts": True, "pairs": [pair(t, o)]}
    windows = [window(k, "3", "9") for k in range(4)] + [window(k, "3", "8") for k in (9, 10)]
    assert decontaminate.judge(windows) == {"at": [0, 1, 2, 3], "same": False, "run": 0}
    plain = [window(k, "3", "3") for k in range(20, 26)]
    assert decontaminate.judge(windows + plain) == {"at": [20, 21, 22, 23, 24, 25], "same": True, "run": 13}


def test_short_low_literal_and_renamed_items_are_found(spark):
    apples = "Alice has 3 apples. Bob has 5 apples. How many apples do they have together?"
    bench = [(0, "What colour is the sky?"), (1, "12 + 7 = 19"), (2, "Anna Bert Carl Dora Emil Fritz Gerda Hans Ida Jens"), (3, apples),
             (4, "What did McDonald sell J. Smith for three dollars in the old town?"), (5, QUESTION), (6, "4 5 6 7 8 9 10 11 12 13")]
    around = lambda t: prose(1, 60) + " " + t + " " + prose(2, 60)
    texts = [around(bench[0][1]), around(bench[1][1]), around(bench[2][1]), around(apples.replace("Alice", "Carol").replace("Bob", "Dave")),
             around("What did Miller sell K. Jones for seven dollars in the old town?"), " ".join(QUESTION.split()[:13]), around(bench[6][1]),
             around("13 + 7 = 20"), around("Xaver Bruno Carla Doris Erika Fanny Gisela Heinz Ilse Jan"), prose(3, 200), around(apples)]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in decontaminate.leaks(documents(spark, texts), items).collect()}
    same, other = "verbatim", "reparameterised"
    assert got == {(0, 0): same, (1, 1): same, (2, 2): same, (3, 3): other, (4, 4): other, (5, 5): same, (6, 6): same, (10, 3): same}


def test_planted_items_are_found_and_nothing_else(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = {r.doc_id: " ".join(r.text.split()) for r in docs.collect()}
    bench = {r.item_id: " ".join(r.text.split()) for r in items.collect()}
    want = {(i, j) for i, t in texts.items() for j, b in bench.items() if b in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()}
    assert want <= got and {i for i, _ in got} == {i for i, _ in want}


def test_window_hashes_depend_on_the_template_only():
    words = decontaminate.Words()
    one = decontaminate.Templates([QUESTION, "", "a 5 b"], words)
    at, hashes = one.windows()
    assert len(set(hashes.tolist())) == len(hashes) and set(one.owner[at].tolist()) <= {0, 2}
    again = decontaminate.Templates(["Before that. " + QUESTION.replace("340", "12")], words)
    assert set(hashes[one.owner[at] == 0].tolist()) <= set(again.windows()[1].tolist())


def test_decontamination_of_awkward_rows(spark):
    odd = awkward(spark)
    items = spark.createDataFrame([(1, prose(2, 90)), (1, prose(2, 90)), (None, "x y")], "item_id long, text string")
    got = {r.doc_id for r in decontaminate.leaks(odd, items).collect()}
    assert got == {5}
    out = decontaminate.without_leaks(odd, items)
    assert out.columns == odd.columns and out.count() == odd.count() - 2
    assert decontaminate.leaks(empty(spark), items).collect() == []
    assert decontaminate.leaks(odd, items.limit(0)).collect() == []


@pytest.mark.parametrize("share", [3])
def test_a_third_of_all_rows_in_one_group(spark, share):
    base = prose(5000, 40)
    texts = [base if k % share == 0 else prose(k, 40) for k in range(900)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows(texts), DOC)).where("n_links = 299").count()
    assert got == 300
