"""Language-model scores against counts in dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from rivulet.llm import ngram_filter as nf
from rivulet.sources.tables import read_table

from .helpers import SF, awkward, documents, empty, prose


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "</s>"]


def is_held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def naive(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score), and the model score, for each row."""
    single, pairs = Counter(), Counter()
    for i, t in rows:
        if not is_held(i):
            ts = tokens(t)
            single.update(ts)
            pairs.update(zip(["<s>", *ts], ts))
    n, v = sum(single.values()), len(single)
    whole = n + 0.5 * (v + 1)
    history = Counter(single)
    history["<s>"] = sum(not is_held(i) for i, _ in rows)

    def value(c):
        return nf.VALUES[nf.level_of(np.array([c]))[0]] if c else 0.0

    out = []
    for i, t in rows:
        ts, base, score = tokens(t), 0.0, 0.0
        for h, w in zip(["<s>", *ts], ts):
            base += math.log10((single[w] + 0.5) / whole)
            p = (value(single[w]) + 0.5) / whole
            if history[h]:
                p = (min(value(pairs[h, w]), value(single[w])) + nf.PRIOR * p) / (value(history[h]) + nf.PRIOR)
            score += math.log10(p)
        out.append(((i, is_held(i), len(ts), sum(single[w] > 0 for w in ts), n, base), score))
    return out


def compared(df, rows, tolerance):
    got = sorted(((tuple(r)[:6], r.score) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    want = sorted(naive(rows), key=str)
    assert len(got) == len(want)
    for (g, score), (w, wanted) in zip(got, want):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        # A pair that the filter lets through by chance makes a text more probable, by a few orders at most.
        assert score == pytest.approx(wanted, rel=tolerance, abs=5)


def test_levels_are_exact_for_small_counts_and_near_for_large_ones():
    counts = np.arange(1, 5000)
    values = nf.VALUES[nf.level_of(counts)]
    assert values[:3].tolist() == [1, 2, 3] and (np.abs(values / counts - 1) <= 0.34).all() and (np.diff(values) >= 0).all()


def test_the_filter_never_reads_too_low_and_rarely_too_high():
    r = np.random.default_rng(1)
    keys, counts = nf.summed(r.integers(0, 2**64, 20_000, np.uint64), np.minimum(r.zipf(1.5, 20_000), 10**6))
    at = nf.segment_of(keys, 5)
    parts = [(i, *nf.segment(keys[at == i], counts[at == i])) for i in range(4)]
    table = nf.joined(parts, 5)
    read, true, there = table.levels(keys), nf.level_of(counts), at < 4
    assert (read[~there] == 0).all() and (read[there] >= true[there]).all() and (read[there] > true[there]).mean() < 0.02
    unseen = r.integers(0, 2**64, 20_000, np.uint64)
    assert (table.levels(unseen) > 0).mean() < 0.02
    assert sum(len(p[1]) for p in parts) < 1.01 * true[there].sum() * nf.ROOM / 8


def test_scores_of_the_test_table(spark):
    docs = read_table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    compared(nf.report(docs), rows, 0.02)


def test_both_ways_and_any_bounds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(nf, "FETCHED", 3000)  # the filter is sent in many pieces
    docs = documents(spark, [prose(i, 60 + i, 40 + 5 * i) for i in range(60)] + [None, "", "A a A", "é É"] + ["Same text again."] * 9)
    wanted = sorted(map(tuple, nf.report(docs, segment_bytes=4000).collect()), key=str)
    for options in ({"sent_bytes": 0}, {"sent_bytes": 0, "head": 3}, {"head": 0}):
        got = sorted(map(tuple, nf.report(docs.repartition(3), segment_bytes=4000, **options).collect()), key=str)
        for g, w in zip(got, wanted, strict=True):
            assert g == tuple(pytest.approx(x, rel=1e-12) if isinstance(x, float) else x for x in w)


@pytest.mark.parametrize("order", [1, 3])
def test_other_orders_run_and_longer_histories_fit_better(spark, order):
    docs = documents(spark, ["the cat sat on the mat today"] * 40 + ["on mat the today cat the sat"])
    scores = {r.doc_id: r.score for r in nf.report(docs, order=order).collect()}
    assert (scores[0] > scores[40] + 1) == (order == 3)


def test_awkward_tables(spark):
    rows = awkward(spark)
    compared(nf.report(rows), [(r["doc_id"], r["text"]) for r in rows.collect()], 0.02)
    assert nf.report(empty(spark)).collect() == []
    # One row that is held out: nothing to learn from.
    held = next(i for i in range(100) if is_held(i))
    row = nf.report(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score == 0


def test_real_order_is_more_probable_than_shuffled_words(spark):
    texts = [prose(3, 400, 60) for _ in range(30)]
    shuffled = texts[0].split()
    random.Random(1).shuffle(shuffled)
    docs = documents(spark, [*texts, " ".join(shuffled)])
    scores = {r.doc_id: (r.score, r.base_score) for r in nf.report(docs).collect()}
    assert scores[0][0] > scores[30][0] + 100 and scores[0][1] == pytest.approx(scores[30][1])


def test_texts_are_dealt_in_turns_whose_tables_go(spark, monkeypatch):
    """The n-grams of all texts were on disk at once, and stayed."""
    from pathlib import Path

    from rivulet.session import ensure_checkpoint_dir

    docs = documents(spark, [prose(i, 60 + i, 40 + 5 * i) for i in range(40)] + [None, "", " A  a A ", "\x0bé É\x1c"]).repartition(3)
    wanted = sorted(map(tuple, nf.report(docs, segment_bytes=20_000).collect()), key=str)
    monkeypatch.setattr(nf, "DEALT", 4_000)
    at = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(at.glob("settled-*"))
    got = sorted(map(tuple, nf.report(docs, segment_bytes=20_000, sent_bytes=0).collect()), key=str)
    for g, w in zip(got, wanted, strict=True):
        assert g == tuple(pytest.approx(x, rel=1e-12) if isinstance(x, float) else x for x in w)
    held = [spark.read.parquet(str(p)).columns for p in at.glob("settled-*") if p not in before]
    assert not any("keys" in c for c in held) and sum("tail" in c for c in held) > 1


def test_words_are_those_of_bytes():
    import pyarrow as pa

    texts = ["", None, " ", "a", "  A b\tc\n", "é Ä\x0b\x0cq\r\x1cz  y\u00a0Z\u2003X", *(prose(i, 50, 9) for i in range(600))]
    for limit in (1, 7, 1000):
        out, at = [], 0
        for first, rows, held in nf.split(pa.array(texts), limit):
            assert first == at and rows == sum(len(t.sizes) for t in held)
            at += rows
            assert rows == 1 or sum(int(t.sizes.sum()) for t in held) <= limit
            for t in held:
                out += [w.tolist() for w in np.split(np.array([x.encode() for x in t.words.to_pylist()], dtype=object), np.cumsum(t.sizes)[:-1])]
        assert at == len(texts) and out == [(t or "").encode().lower().split() for t in texts]
