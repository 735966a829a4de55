"""The prefix-tree join against brute force: single trees, chunks of hot groups, odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from dossierlake.llm import prefix_tree

from .test_dedup_decontam import brute, corpus, words


def components_of(links, nodes):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in nodes}


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_tree_finds_all_links(percent):
    rng = random.Random(percent)
    sets, sizes = [], []
    for _ in range(12):
        base = rng.sample(range(400), rng.randint(1, 60))
        for _ in range(rng.randint(1, 8)):
            s = set(base) - set(rng.sample(base, rng.randint(0, len(base) // 4)))
            sets.append(np.array(sorted(s | set(rng.sample(range(400), rng.randint(0, 4)))), np.int64))
            sizes.append(len(sets[-1]) + rng.choice([0, 0, 1, 5]))  # shingles that no other set has
    sizes = np.array(sizes)
    tree = prefix_tree.PrefixTree(sets, sizes, percent)
    assert sum(t >= 0 for t in tree.terminal) == len(sets) and len(tree.depth) <= 2 * len(sets) + 1
    held = np.zeros(400, bool)
    got, want = set(), set()
    for own, i in enumerate(tree.order):
        got |= {frozenset((i, tree.order[j])) for j in tree.links(sets[i], sizes[i], held, np.arange(len(sets)), own)}
    for a in range(len(sets)):
        for b in range(a):
            both = len(set(sets[a]) & set(sets[b]))
            if 100 * both >= percent * (sizes[a] + sizes[b] - both):
                want.add(frozenset((a, b)))
    assert got == want and not held.any()


@pytest.mark.parametrize("chunk", [256, 7])
def test_components_equal_brute_force(spark, chunk):
    rows = corpus(3)
    rng = random.Random(chunk)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, id string").repartition(3)
    got = prefix_tree.jaccard_components(df, percent=80, chunk=chunk)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 80)


@pytest.mark.parametrize("changes", [[3, 4, 5], [7, 8, 9]])
def test_hot_group_in_chunks(spark, changes):
    """Near copies of one text at and below the threshold: chunks hold few of a group, links cross them."""
    rng = random.Random(len(changes) + changes[0])
    base, rows = words(rng, 260), []
    for i in range(300):
        w = base[:]
        for at in rng.sample(range(len(w)), rng.choice(changes)):
            w[at] = rng.choice("abc") * 6
        rows.append((i * 7, " ".join(w)))
    rows += [(5000 + i, " ".join(base[40:100] + words(rng, 80))) for i in range(80)]  # a common passage
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in prefix_tree.jaccard_components(df, chunk=20).collect()}
    assert got == {i: c for i, _, c in brute(rows, 80)}


def test_odd_rows(spark):
    long = " ".join(words(random.Random(2), 400_000))
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One two"), (5, "one  TWO"), (None, "one two"), (6, "one two three"), (9, "a b c d e f"), (9, "a b c d e f"), (9, "other words stand here now"), (8, "other words stand here now"), (20, long), (21, long + " end")]
    got = prefix_tree.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute(rows, 80)
    assert prefix_tree.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
