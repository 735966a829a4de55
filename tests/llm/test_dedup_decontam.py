"""Near duplicates, components and decontamination against brute force; nulls, empty and repeated rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import common, decontaminate, near_dup
from dossierlake.llm.common import components, merged

LETTERS = "abcdefghijklmnop"


def words(rng, n):
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(rows[a][0]), find(rows[b][0])))
                root[y] = x
    return Counter((i, len(s), None if i is None else find(i) if s else i) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed):
    """A hot group of near copies of one text, whose members differ in few or several words; others alone."""
    rng = random.Random(seed)
    rows, base = [], words(rng, 150)
    for i in range(60):
        w = base[:]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = "".join(words(rng, 1)) + "x"
        rows.append((i, " ".join(w)))
    long = words(rng, 900)
    for i in range(60, 70):
        w = long[:]
        for _ in range(rng.choice([0, 3, 9, 14])):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(words(rng, rng.randint(1, 80)))) for i in range(70, 90)]
    return rows + [(100, None), (101, ""), (102, " \n\t"), (103, "Solo word"), (104, "solo WORD"), (105, rows[0][1]), (105, rows[0][1]), (None, rows[1][1]), (None, None)]


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (2, 80)])
def test_near_duplicates(spark, seed, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "extra", 7) for i, t in rows], "doc_id long, text string, kept string, n int").repartition(3)
    got = near_dup.near_duplicates(df, percent=percent).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, percent)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def unlike_copies(seed, n, size, edits):
    """Copies of one text that differ from it in several words and from each other in more; the text itself isn't there."""
    rng = random.Random(seed)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(size)], []
    for i in range(n):
        w = base[:]
        for _ in range(rng.choice(edits)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    return rows


def brute_components(rows, percent):
    ids = {}
    held = np.zeros((len(rows), len(rows) * len(rows[0][1].split())), np.float32)
    for i, (_, text) in enumerate(rows):
        held[i, [ids.setdefault(s, len(ids)) for s in shingles(text)]] = 1
    held = held[:, : len(ids)]
    size, both = held.sum(1), held @ held.T
    link, low = 100 * both >= percent * (size[:, None] + size - both), np.arange(len(rows))
    while True:
        now = np.array([low[x].min() for x in link])
        if (now == low).all():
            return low.tolist(), link
        low = now


@pytest.mark.parametrize(("seed", "n", "size", "edits", "percent"), [(1, 250, 150, [2, 3, 4, 5, 6], 85), (2, 150, 700, [4, 6, 8, 10], 85)])
def test_a_list_of_unlike_nodes(spark, seed, n, size, edits, percent):
    """One inverted list holds all nodes, and its central node links few of them; sets of whole and of sketched texts."""
    rows = unlike_copies(seed, n, size, edits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, percent=percent, pair_up_to=3, few=3).collect()}
    want, _ = brute_components(rows, percent)
    assert [got[i] for i in range(n)] == want and 2 < len(set(want)) < n


def test_recall_of_sketches(spark):
    """Links between sets of more than 512 shingles at and above the threshold: lists and estimate lose none of them."""
    rng, rows = random.Random(9), []
    for i in range(150):
        base = words(rng, 800)
        other = base[:]
        for j in rng.sample(range(0, 800, 6), 12 + i % 3):  # similarities about 0.85
            other[j] = "changed"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()}
    sets = [shingles(t) for _, t in rows]
    linked = {i for i in range(0, 300, 2) if 100 * len(sets[i] & sets[i + 1]) >= 85 * len(sets[i] | sets[i + 1])}
    assert 40 < len(linked) < 150 and {i for i in range(0, 300, 2) if got[i + 1] == i} == linked


def test_no_rows(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merged(spark):
    comps = components(spark.createDataFrame([(1, 2), (3, 4), (5, 6)], "a long, b long"))
    got = {r["node"]: r["component"] for r in merged(comps, spark.createDataFrame([(4, 6), (9, 8), (2, 1)], "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 3, 8: 8, 9: 8}


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def similarity(doc, item):
    """The best weighted similarity of any window, by the definition."""
    w, v = doc.lower().split(), item.lower().split()
    if not w or not v:
        return 0.0
    k = min(5, len(v))
    grams = lambda x: Counter(tuple(x[i : i + k]) for i in range(len(x) - k + 1))
    target, best = grams(v), 0.0
    for s in range(max(1, len(w) - len(v) + 1)):
        g = grams(w[s : s + len(v)])
        both = sum((g & target).values())
        total = sum(g.values()) + sum(target.values()) - both
        best = max(best, both / total if total else 0)
    return best


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, n))) for i, n in enumerate([3, 12, 20, 20, 35, 50, 1])] + [(50, None), (51, " ")]
    items[6] = (6, "uniqueword")
    docs = []
    for i in range(70):
        w = words(rng, rng.randint(0, 120))
        for _ in range(rng.choice([0, 1, 2])):
            passage = items[rng.randrange(7)][1].split()
            for _ in range(rng.choice([0, 0, 1, 2]) if len(passage) > 2 else 0):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["changed"], ["two", "more"]])
            at = rng.randint(0, len(w))
            w[at:at] = passage
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, " ".join(items[5][1].split()[:47])), (0, docs[0][1])]
    want = {(i, j) for i, t in docs for j, x in items if t and x and similarity(t, x) >= 0.8}
    df = spark.createDataFrame([(i, t, "n") for i, t in docs], "doc_id long, text string, item string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.matches(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    exact = {(i, j): similarity(t, x) for i, t in docs for j, x in items if (i, j) in want}
    assert all(abs(exact[r["doc_id"], r["item_id"]] - r["similarity"]) < 1e-9 for r in got)
    left = decontaminate.decontaminate(df, bench)
    assert left.columns == df.columns and {r["doc_id"] for r in left.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_recall_of_fingerprints(spark):
    """Passages of 60 items with one to four changed words, in documents of other words: the Hamming blocks find all that reach the threshold."""
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, rng.choice([30, 60, 61, 90, 120])))) for i in range(60)]
    docs = []
    for i in range(200):
        w, passage = words(rng, rng.randint(0, 60)), items[rng.randrange(60)][1].split()
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], ["changed"], ["two", "more"]])
        at = rng.randint(0, len(w))
        docs.append((i, " ".join(w[:at] + passage + w[at:]), "x", "y"))
    want = {(i, j) for i, t, _, _ in docs for j, x in items if set(t.split()) & set(x.split()) and similarity(t, x) >= 0.8}
    df = spark.createDataFrame(docs, "doc_id long, text string, contaminated string, similarity string").repartition(3)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 80 and got == want
    left = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == df.columns and left.count() == 200 - len({i for i, _ in want})


def test_empty_benchmark(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.matches(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontaminate.matches(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_hamming_blocks_alone(spark):
    """Fingerprints of given pairs, without the count of shingles before them: all that reach 0.8 are met, also where a shingle's counts are large; others are not."""
    rng = random.Random(21)
    items = {i: words(rng, 60) for i in range(120)}
    for i in range(0, 120, 10):  # one shingle many times
        at = rng.randint(0, 30)
        items[i][at : at + 25] = ["ha"] * 25
    wins = {}
    for k in range(400):
        w = list(items[k % 120])
        for _ in range(rng.choice([0, 1, 1, 1])):
            w[rng.randrange(60)] = rng.choice(["changed", "ha"])
        wins[k] = w
    rows = [(i, 60, 5, " ".join(w)) for i, w in items.items()]
    hashes = F.expr(decontaminate._shingles("w", "0", "(n - width + 1)", 5))
    df = lambda r: spark.createDataFrame(r, "item long, n int, width int, text string").withColumn("w", F.split("text", " ")).withColumn("y", hashes).withColumn("fi", F.expr(decontaminate._fingerprint("y")))
    prints = df([(k, 60, 5, " ".join(w)) for k, w in wins.items()]).select("item", "n", "width", F.col("fi").alias("f"))
    near = decontaminate.near_items(prints.select("n", "width", "f"), df(rows).withColumn("m", F.size("y"))).select("f", F.col("item").alias("met"))
    got = {(r["item"], r["met"]) for r in prints.join(near, "f").collect()}
    like = {(k, i): similarity(" ".join(w), " ".join(x)) for k, w in wins.items() for i, x in items.items() if k % 120 == i or (k % 10 == 0 and i % 10 == 0)}
    want = {p for p, s in like.items() if s >= 0.8}
    assert len(want) > 300 and sum(like[p] < 0.85 for p in want) > 30
    assert want <= got and all(like.get(p, 0) > 0.5 for p in got)


def test_fingerprint_by_definition(spark):
    """Bits by counting occurrences one by one, below and above the size up to which lanes of a long count."""
    rng = random.Random(3)
    for n in (1, 2, 8, 333, 17_000):
        h = [rng.getrandbits(64) - 2**63 for _ in range(n)]
        got = spark.createDataFrame([(h,)], "x array<long>").select(F.expr(decontaminate._fingerprint("x"))).first()[0]
        assert len(got) == 4
        u = [v % 2**64 for v in h]
        assert got[0] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in u) > n)


def test_texts_without_windows_do_not_move(spark, tmp_path, monkeypatch):
    """With more windows than may be broadcast, the texts that are shuffled are those that have one, and the rows are the same."""
    rng = random.Random(21)
    items = [(i, " ".join(words(rng, 30))) for i in range(4)]
    rows = [(i, " ".join([*words(rng, 20), *([items[i % 4][1]] if i % 10 == 0 else []), *words(rng, 20)])) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/texts")
    docs, bench = spark.read.parquet(f"{tmp_path}/texts"), spark.createDataFrame(items, "item_id long, text string")
    want, plans, marked = sorted(map(tuple, decontaminate.matches(docs, bench).collect())), {}, []

    def scratch(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        out = common.scratch(df, name)
        if name == "marked":
            marked.append(out.count())
        return out

    monkeypatch.setattr(common, "BROADCAST_ROWS", 8)
    monkeypatch.setattr(decontaminate, "scratch", scratch)
    assert sorted(map(tuple, decontaminate.matches(docs, bench).collect())) == want and len(want) == 20
    assert sum(marked) == 20 and len(marked) == 3
    # the shuffled join reads the marked texts, not the documents
    assert "text#" in plans["marked"][0] and all(p.count("Relation [doc_id") == 0 for p in plans["held"])


def test_pipelines_stage_moves_no_text_without_windows(spark, tmp_path, monkeypatch):
    """The pipeline's stage keeps the same rows where more windows are found than may be broadcast, and its join of windows and texts reads only texts that have some."""
    import corpus_pipeline

    rng, sf = random.Random(22), str(tmp_path)
    items = [(i, " ".join(words(rng, 25))) for i in range(3)]
    rows = [(i, " ".join([*words(rng, 15), *([items[i % 3][1]] if i % 8 == 0 else [])]), "x") for i in range(120)] + [(None, items[0][1], "y"), (0, "else", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, plans = spark.read.parquet(f"{sf}/documents.parquet"), []
    monkeypatch.setattr(common, "BROADCAST_ROWS", 4)
    monkeypatch.setattr(decontaminate, "scratch", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "held" else None, common.scratch(df, name))[1])
    left = corpus_pipeline.decontamination(spark, docs, sf)
    # by the definition here id 0 is contaminated, and so are all rows that have it
    assert sorted(map(tuple, left.collect())) == sorted(r for r in rows if r[0] is not None and r[0] % 8)
    assert len(plans) == 1 and "lang#" not in plans[0] and "Relation [doc_id" not in plans[0]


def test_contaminated_long_and_repeated_rows(spark):
    """A text of over 1 MB with one passage in it; a repeated document gives one row an item, and goes with all its copies."""
    rng = random.Random(8)
    item = " ".join(words(rng, 40))
    body = [f"w{rng.randrange(10**6)}" for _ in range(160_000)]
    long = " ".join([*body[:90_000], item, *body[90_000:]])
    docs = spark.createDataFrame([(1, long), (2, item), (2, item), (3, " ".join(body)), (4, "else"), (4, "else")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert len(long) > 1_000_000
    got = sorted((r["doc_id"], r["similarity"], r["start_word"]) for r in decontaminate.matches(docs, bench).collect())
    assert got == [(1, 1.0, 90_000), (2, 1.0, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [3, 4, 4]


def test_lists_of_edits_and_blocks(spark, monkeypatch):
    """A bounded rest is settled in one round, block by block; a larger one by lists of edits. Both find the components of brute force."""
    rows = unlike_copies(3, 250, 150, [2, 3, 4, 5, 6])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = brute_components(rows, 85)
    members, keep = [], near_dup.scratch

    def scratch(table, name):
        out = keep(table, name)
        if name == "members":
            members.append(out.count())
        return out

    monkeypatch.setattr(near_dup, "scratch", scratch)
    monkeypatch.setattr(near_dup, "BLOCK", 32, raising=False)
    made = []
    for how in ({}, {"most": 20}):
        members.clear()
        got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df, percent=85, pair_up_to=3, few=3, **how).collect()}
        assert [got[i] for i in range(250)] == want
        made.append(sum(members[1:]))  # the first are those of the inverted lists
        if not how:
            assert len(members) == 3, members  # no further round
    assert made[0] < made[1]


def test_shared_counts():
    rng = np.random.default_rng(5)
    x, y = ([np.unique(rng.integers(0, 12000, rng.integers(0, 6000))).astype(np.uint64) for _ in range(9)] for _ in range(2))
    assert near_dup._shared_counts(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert near_dup._shared_counts(x[:1], [np.zeros(0, np.uint64)]).tolist() == [[0]]


def test_shuffle_files_go(spark):
    """Once a scratch table is written, Spark holds no shuffle of it any more, and the session's own setting is as before."""
    table, kept = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), spark.conf.get(common.SHUFFLES_GO, None)
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    assert common.scratch(table, "seven").count() == 7
    assert common.counted(table, "seven")[1] == 7
    assert tracker.shuffleStatuses().size() <= before + 1  # of count(), which is no scratch table
    assert spark.conf.get(common.SHUFFLES_GO, None) == kept
