"""Periodic runs against brute force."""

import hashlib
import random
import re
import time
import zlib

import pytest

from rivulet.llm import word_runs

from .helpers import awkward, documents, empty, prose


def naive_runs(words):
    """Every maximal stretch of each period, kept if no smaller period fits it."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            part = words[start:start + length]
            if length >= max(6, 4 * q) and not any(all(part[k] == part[k - p] for k in range(p, length)) for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def naive_collapse(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def naive_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = naive_runs(words)
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(naive_collapse(words, runs)))


def random_words(r):
    """Words of a small alphabet, with repeated stretches of repeated stretches."""
    kind = r.randrange(4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randint(0, 60))]
    if kind == 1:
        return list("abc"[: r.randint(1, 3)] * r.randint(1, 30))
    out = []
    for _ in range(r.randint(1, 4)):
        root = [r.choice("abcd") for _ in range(r.randint(1, 7))]
        if kind == 3:
            root = root * r.randint(1, 5) + [r.choice("abx")]
        out += root * r.randint(1, 7) + root[: r.randint(0, len(root))] + [r.choice("abcdx")] * r.randint(0, 2)
    return out


def test_runs_equal_brute_force_alone_and_side_by_side():
    r = random.Random(11)
    texts = [random_words(r) for _ in range(3000)]
    wanted = [naive_runs(t) for t in texts]
    assert sum(map(len, wanted)) > 3000
    for i in range(0, len(texts), 50):
        assert word_runs.find([[w.encode() for w in t] for t in texts[i:i + 50]]) == wanted[i:i + 50]
    for t, w in zip(texts[:300], wanted):
        assert word_runs.find([[x.encode() for x in t]]) == [w]
        assert word_runs.collapse([x.encode() for x in t], w).decode() == naive_collapse(t, w)


@pytest.mark.parametrize("root", [1, 2, 7, 5000, 49_999])
def test_a_long_periodic_text_takes_few_steps(root):
    words = [f"w{i}".encode() for i in range(root)]
    text = (words * (400_000 // root + 1))[:400_000]
    began = time.time()
    assert word_runs.find([text]) == [[(0, 400_000, root)]]
    assert time.time() - began < 20


def test_report_equals_brute_force_on_every_case(spark):
    texts = [prose(i, 70) for i in range(40)] + [" ".join(random_words(random.Random(i))) for i in range(160)]
    texts += [None, "", " \n", "a\x1cb a\x1cb", "a\xa0b " * 8, "x " * 5, "x " * 6, ("é ü " * 9).strip()]
    docs = documents(spark, texts)
    got = {r["doc_id"]: tuple(r)[1:] for r in word_runs.report(docs.repartition(5)).collect()}
    assert got == {i: naive_row(i, t) for i, t in enumerate(texts)}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 10


def test_report_of_awkward_and_empty_tables(spark):
    rows = awkward(spark)
    got = sorted((tuple(r) for r in word_runs.report(rows).collect()), key=str)
    # The brute force takes too long for the text of 60,000 words; that one repeats 997 words, which is one run.
    want = [(d["doc_id"], *naive_row(d["doc_id"], d["text"])) for d in rows.collect() if d["doc_id"] != 4]
    assert [g for g in got if g[0] != 4] == sorted(want, key=str)
    assert [g[:6] for g in got if g[0] == 4] == [(4, 1, 0, 60_000, 997, 1000 * 60_000 // 997)]
    assert word_runs.report(empty(spark)).collect() == []
    kept = word_runs.scan(rows.withColumn("repeats", rows.kept))
    assert kept.columns == [*rows.columns, "repeats"] and kept.count() == rows.count()


def test_scan_returns_runs_and_the_collapsed_text(spark):
    row = word_runs.scan(documents(spark, ["well " + "go on " * 4 + "now"])).first()
    assert [tuple(r) for r in row.repeats.runs] == [(1, 8, 2)] and row.repeats.collapsed == "well go on now"
