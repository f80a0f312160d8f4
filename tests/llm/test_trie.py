"""The conversation trie against brute force."""

import hashlib
import random
import zlib

import pytest

from rivulet.llm import turn_trie
from rivulet.session import settle
from rivulet.sources.tables import read_table

from .helpers import SF

TURNS = "conv_id long, turn long, role string, text string"


def by_conv(rows):
    """Turns of each conversation in order; rows of one number in the order of their ids do not occur here."""
    out = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def reopen(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def naive_nodes(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)

    def below(key):
        leaves, saved = (0 if key in children else 1), (len(nodes[key]) - 1) * (len(key[-1][1]) if key else 0)
        for k in children.get(key, []):
            more = below(k)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(convs[c]) == len(key)))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children.get(key, [])), *below(key),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def collected(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def made(seed):
    """Copies, shared openings of many lengths, conversations that open others, single turns, one long conversation."""
    r = random.Random(seed)
    said = [f"text {i}" * (i % 3) for i in range(12)]
    rows = []
    for c in range(60):
        if c % 3 == 0:
            turns = ["hot", "hot", "same"]
        elif c % 3 == 1:
            turns = [f"t{k}" for k in range(r.randint(1, 9))]
        else:
            turns = [r.choice(said) for _ in range(r.randint(1, 6))]
        rows += [(c * 7 - 70, None if k == 0 and c % 5 == 0 else k, r.choice(["user", None]) if c % 4 == 0 else "user", t or None) for k, t in enumerate(turns)]
    return rows + [(900, k, "user", f"t{k}" if k < 5 else "on and on") for k in range(150)]


@pytest.mark.parametrize("container", [2, 40, 100_000])
def test_nodes_equal_brute_force_for_any_container(spark, container):
    rows = made(container)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), TURNS)
    assert collected(turn_trie.trie(df, container)) == naive_nodes(by_conv(rows))


def test_report_of_the_test_table_and_of_turnless_conversations(spark):
    df = read_table(spark, SF, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    rows += [(c, 0, "user", "alone") for c in range(5001, 5030)]
    df = spark.createDataFrame(rows, TURNS)
    wanted = reopen(by_conv(rows))
    assert any(not t for t in wanted.values())
    assert collected(turn_trie.report(df)) == naive_nodes(wanted)
    turns, sizes = turn_trie.reopened(settle(turn_trie.number_turns(df)))
    assert collected(turn_trie.nodes(turns, sizes, 30)) == naive_nodes(wanted)


def test_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, None, "", ""), (2, 0, "user", None),
            (3, 1, "user", "x" * 100_000)]
    names = ["conv", "pos", "a", "b", "size", "head", "key", "n", "d", "ka"]
    df = spark.createDataFrame([(*r, *names) for r in rows], TURNS + "".join(f", `{n}` string" for n in names))
    assert collected(turn_trie.trie(df, 2)) == naive_nodes(by_conv(rows))
    tied = spark.createDataFrame([(c, 0, "user", t) for c in (1, 2) for t in (("x", "y") if c == 1 else ("y", "x"))], TURNS)
    assert turn_trie.trie(tied).where("n_convs = 2").count() == 3


def test_an_empty_table_has_no_nodes(spark):
    assert turn_trie.report(spark.createDataFrame([], TURNS)).collect() == []


def test_a_container_is_swept_in_order():
    found = turn_trie.swept([([1, 2], [10, 20], 7), ([1], [10], 9), ([1, 2], [10, 20], 8), ([3], [5], 6)], 4)
    assert [(n.depth, n.conv, n.convs, n.children, n.leaves, n.saved, n.ends) for n in found] == [
        (5, 7, 3, 1, 1, 40, [9]), (6, 7, 2, 0, 1, 20, [7, 8]), (5, 6, 1, 0, 1, 0, [6])]
