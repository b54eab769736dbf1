import random
import re

import numpy as np
import pytest

from weftgraph.llm import common
from weftgraph.llm import near_dedup as nd
from weftgraph.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, percent):
    """component of each row (id, text), by all pairs."""
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(k)] = min(least.get(top(k), doc_id), doc_id)
    return [(i, len(sets[k]), least.get(top(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    shared = " ".join(rng.choices(words, k=60))
    rows = []
    while len(rows) < n:
        base = rng.choices(words, k=rng.choice([3, 8, 80, 200]))
        if rng.random() < 0.3:
            base = shared.split() + base
        for _ in range(rng.choice([1, 1, 1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words).upper()
            rows.append((len(rows), rng.choice([" ", "\n", "\t "]).join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [85, 80])
def test_components_as_by_all_pairs(spark, percent):
    rows = corpus(250) + [(9001, None), (9002, ""), (9003, " \n"), (None, "w1 w2 w3 w4 w5 w6"), (9004, "w1 w2 w3 w4 w5 w6")]
    rows += [(9004, "w1 w2 w3 w4 w5 w6"), (9005, "one"), (9006, "ONE"), (9007, "é" * 20000)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, percent), key=key)
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("most_hot, block", [(10_000, 400), (3, 400), (10_000, 12)])
def test_large_groups_are_cut_into_blocks(spark, monkeypatch, most_hot, block):
    """In blocks, and with blocks so small that groups have more of them than bands, band by band."""
    from weftgraph.llm import common

    monkeypatch.setattr(nd, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(common, "MOST_HOT", most_hot)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rows = corpus(120, seed=5) + [(k, "one text that many share") for k in range(500, 520)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 80))


@pytest.mark.parametrize("block", [300, 40])
def test_centres_alone_may_not_connect_a_group(spark, monkeypatch, block):
    """Near copies in a chain: each is like the next one and unlike those further on, in blocks of a few texts."""
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", block)
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k : 6 * k + 110])) for k in range(40)] + [(100 + k, " ".join(words[:100] + [f"x{k}"] * 3 + words[103:110])) for k in range(20)]
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 85))


def test_parts_are_connected_by_their_best_pairs():
    rng = np.random.RandomState(5)
    base = rng.randint(0, 2**62, 100, dtype=np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.randint(0, 2**62, k, dtype=np.int64).astype(np.uint64)])) for k in (0, 2, 4, 90, 95)]
    sigs = [nd.signature(x).astype(np.uint8) for x in sets]
    links = nd.verify([1, 2, 3, 4, 5], [0] * 5, sets, sigs, 80)
    assert len(links) == 2 and {x for pair in links for x in pair} == {1, 2, 3}
    assert nd.verify([1, 1, 1, 4, 5], [0] * 5, sets, sigs, 80) == []
    assert set(nd.verify([1, 2, 3, 4, 5], [0, 0, 1, 1, 1], sets, sigs, 80)) == {(2, 3), (1, 3)}  # never (1, 2)


A, B = "a b c d e f", "q r s t u v w"


@pytest.mark.parametrize("rows", [
    [(3, B), (9, A), (9, B)], [(9, A), (9, B)], [(9, A), (9, B), (12, A + " g h i j k l m n o"), (4, B)], [(None, A), (None, A), (None, B), (None, None)], [(None, A), (7, A)], [(5, A)] * 4,
])
def test_rows_that_share_an_id(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = nd.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, 80), key=key)
    kept = [(r.doc_id, r.text) for r in nd.keep_firsts(df).collect()]
    texts = sorted({t for _, t in rows if t})
    assert sorted(t for _, t in kept if t) == texts and len([t for _, t in kept if t is None]) == len([t for _, t in rows if t is None])
    assert all(i == min([j for j, u in rows if u == t and j is not None], default=None) for i, t in kept if t)


def test_one_of_each_group_stays(spark):
    rows = [(3, A, "x", 1), (3, A, "x", 1), (5, A.upper(), "y", 2), (None, A, "z", 3), (6, None, "q", 4), (6, None, "q", 4), (7, "other words", "kept", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark string, worded int")
    out = nd.keep_firsts(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.mark, r.worded) for r in out.collect()) == [(3, "x", 1), (6, "q", 4), (6, "q", 4), (7, "kept", 5)]
    assert nd.keep_firsts(df.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.RandomState(1)
    for share in (0.2, 0.5, 0.85):
        found = []
        for _ in range(40):
            n = 400
            both = int(2 * n * share / (1 + share))
            pool = rng.randint(0, 2**63, 2 * n, dtype=np.int64).astype(np.uint64)
            a, b = pool[:n], np.concatenate((pool[:both], pool[n : 2 * n - both]))
            found.append((nd.signature(a) == nd.signature(b)).mean())
        assert abs(np.mean(found) - share) < 0.02 and np.std(found) < 0.05


@pytest.mark.parametrize("hot", [500, 3])
def test_components_of_chains_and_stars(spark, monkeypatch, hot):
    from weftgraph.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", least)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (500, 499)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 500: 499}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark):
    from weftgraph.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.queries()["op1_near_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 85))


def test_no_table_is_broadcast_for_the_size_of_its_files(spark, monkeypatch):
    """Read back, tables of many millions of rows (each set's 32 bands above all) pass for small ones."""
    plans, cut = {}, nd.cut

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(nd, "cut", seen)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    rows = corpus(120)
    found = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85)
    assert sorted(tuple(r)[:3] for r in found.collect()) == sorted(brute(rows, 85))
    for name in ("star", "members", "sets"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name], name


def test_the_pipelines_stage_broadcasts_no_bands(spark, monkeypatch):
    plans, cut = {}, nd.cut

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return cut(df, name)

    monkeypatch.setattr(nd, "cut", seen)
    rows = corpus(60)
    kept = nd.keep_firsts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, least in brute(rows, 80) if i == least)
    assert "SortMergeJoin" in plans["star"] and "BroadcastHashJoin" not in plans["star"]


@pytest.mark.parametrize(("least", "broadcasts"), [(1, 2), (10_000, 0)])
def test_rows_of_many_keys_meet_by_a_shuffle(spark, monkeypatch, least, broadcasts):
    """Classes of all documents, read back, pass for a table small enough for a broadcast."""
    monkeypatch.setattr(common, "MOST_HOT", 4)
    monkeypatch.setattr(common, "HOT_ROWS", least)
    left = spark.range(60).selectExpr("if(id < 50, id % 10, 99) AS k", "id AS v")
    right = common.cut(spark.range(10).selectExpr("id AS k", "concat('c', id) AS name", "if(id = 0, 30L, 5L) AS times"), "right")
    found = common.join_hot(left, right, "k", "times")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == broadcasts  # of hot keys alone
    assert sorted((r.v, r.name) for r in found.collect()) == [(v, f"c{v % 10}" if v < 50 else None) for v in range(60)]
