"""MaxScore, sharding and URL rules against brute force."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dossierlake.llm import maxscore, sharding, url_filter
from dossierlake.llm.queries import URL_RULES


@pytest.mark.parametrize("setting", [{"SHARD_LEAST": 40, "BLOCK_QUERIES": 3}, {"GROUP_VALUES": 300}])
def test_maxscore(spark, monkeypatch, setting):
    for name, value in setting.items():
        monkeypatch.setattr(maxscore, name, value)
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 380)]  # one very common vector: many ties
    rows += [(900, None), (None, [1.0] * 8), (901, []), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] + [1.0] * 7), (904, [float("inf")] + [1.0] * 7), (7, rows[7][1]), (905, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    v = maxscore.quantised(df)
    sound = [(r["id"], r["v"]) for r in v.collect()]
    assert len(sound) == 382
    got = defaultdict(list)
    for r in maxscore.top_k(v, v.filter(F.col("id") % 20 == 0), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["id"], r["score"]))
    for q, x in sound:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in sound if i != q)[:10]
            assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]


def test_maxscore_few_rows(spark):
    df = spark.createDataFrame([(1, [1, 2]), (2, [3, 4]), (3, [5])], "id long, v array<long>")
    got = maxscore.top_k(df, df, 10).collect()
    assert {(r["query_id"], r["id"], r["score"]) for r in got} == {(1, 2, 11), (2, 1, 11)}
    assert maxscore.top_k(df.limit(0), df.limit(0), 10).count() == 0
    clash = df.selectExpr("*", "'old' as score", "'old' as rank", "'old' as shard", "'old' as dim")
    assert sorted(map(tuple, maxscore.top_k(clash, clash, 10).collect())) == sorted(map(tuple, got))


def test_shards(spark):
    rng = random.Random(4)
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"copy {i // 6}") for i in range(300)] + [(5000 + i, "".join(rng.choice("abcé") for _ in range(rng.randint(0, 9))) + str(i)) for i in range(290)]
    rows += [(7, None), (None, ""), (None, None), (8, "same"), (8, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.balanced_shards(df.withColumn("shard", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(16)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shards_of = defaultdict(set)
    for r in got:
        if r["doc_id"] is not None and 1000 <= r["doc_id"] < 1300:
            shards_of[(r["doc_id"] - 1000) // 6].add(r["shard"])
    assert sum(len(s) == 1 for s in shards_of.values()) >= 30  # most of fifty groups lie in one shard
    assert sharding.balanced_shards(df.limit(0)).count() == 0
    # another layout of the same rows gives the same shards; long texts are one row as any other
    named = df.filter("doc_id is not null").union(spark.createDataFrame([(9999, "long " * 400_000)], df.schema))
    one, two = (sorted(map(tuple, sharding.balanced_shards(x).drop("grown_shard").collect())) for x in (named.repartition(2), named.repartition(7, "text")))
    assert one == two


def test_propagation_saves_links(spark):
    """With no round most groups of equal texts are cut between shards; the rounds leave few of them cut."""
    df = spark.createDataFrame([(i, f"text {i // 4}") for i in range(1200)], "doc_id long, text string").repartition(4)
    cuts = []
    for rounds in (0, 6):
        shards = defaultdict(set)
        for r in sharding.balanced_shards(df, rounds=rounds).collect():
            shards[r["doc_id"] // 4].add(r["shard"])
        cuts.append(sum(len(s) - 1 for s in shards.values()))
    assert cuts[0] > 250 and cuts[1] < 80


def judge(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for i, c in enumerate(rest + "/"):
            if c in "/?#":
                host, path = rest[:i], rest[i:]
                break
        for c in "?#":
            path = path.split(c)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), v, r) for v, r in URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, max(fits)[2], max(fits)[1]) if fits else (host, path, None, "allow")


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.COM/en/1?x=/en/", "https://a.example.com/en", "http://www.example.com/en/a", "http://x.www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net/es", "http://com", "http://com/", "http://b.com?x", "http://c.com#/en/", "://x.net/fr/a", "http://é.net/es/", "http://example.com/en/://a.net/es/", "http://example.com./en/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id int, url string, host string")
    urls += ["http://a.net/es/" + "x/" * 100_000, "http://a.net/es/1"]
    df = spark.createDataFrame([(i, u, "old", "old") for i, u in enumerate(urls)], "page_id int, url string, host string, found string")
    assert url_filter.judge_urls(df.limit(0), URL_RULES).count() == 0 and {r["verdict"] for r in url_filter.judge_urls(df, [], default="block").collect()} == {"block"}
    assert url_filter.judge_urls(df, URL_RULES).columns == ["page_id", "url", "found", "host", "path", "rule", "verdict"]
    for most in (100, 2):  # also in passes
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, URL_RULES, max_rules=most).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}


def test_trie_tails_and_ties():
    t = url_filter.Trie([("allow", "a.com/en"), ("block", "a.com/en"), ("allow", "a.com/english/b"), ("block", "com")])
    assert t.best("a.com", "/en/x")[3:] == ("block", "a.com/en")
    assert t.best("a.com", "/english/bcd")[4] == "a.com/english/b"
    assert t.best("a.com", "/x")[4] == "com" and t.best("b.org", "/") is None


def test_texts_of_more_than_a_bin_are_dealt_out(spark, monkeypatch):
    """A text with a seventieth of the rows is below a quarter of a shard, and above a bin."""
    monkeypatch.setattr(sharding, "BIN_ROWS", 10)
    seen, write = {}, sharding.scratch

    def spy(df, name):
        seen[name] = write(df, name)
        return seen[name]

    monkeypatch.setattr(sharding, "scratch", spy)
    rows = [(i, "hot") if i < 95 else (i, f"text {i}") for i in range(6400)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    most = seen["bins"].filter("alone <> 0").agg({"n": "max"}).first()[0]
    assert most <= 20 and seen["bins"].agg({"n": "sum"}).first()[0] == 6400
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 6400 and all(sorted(v) == list(range(400)) for v in by.values()) and len(by) == 16
