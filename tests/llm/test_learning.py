import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import licences, mixing, quality, queries, simhash, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t", "one", "a\x0bb\x0cc", "é # x | y\n\né # x | y\n", "a b c a b c a b c", "\n".join(["same line here"] * 5), "x " * 3000, "\x85 no space ", "日本 語\n日本 語 日本 語"]


def texts(spark, name="documents"):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}


# ---- quality ----------------------------------------------------------------------------------------------


def plain_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if runs[tuple(words[k : k + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_statistics(spark):
    rng = random.Random(2)
    found = ODD + ["".join(rng.choices(["a", "b", "# ", "\n", " ", "é", "|", "\t", "\x1c", "a b c "], k=rng.randint(0, 80))) for _ in range(300)]
    for text in found:
        assert tuple(quality.statistics_of(memoryview((text or "").encode()))[:5]) == plain_statistics(text), text
    df = spark.createDataFrame([(k, t, 0.5, "mine") for k, t in enumerate(found)], "doc_id long, text string, p_quality double, kept string")
    got = quality.judge_quality(df).collect()
    assert len(got) == len(found)
    for r in got:
        n, chars, symbols, lines, repeats = plain_statistics(found[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
        assert r.base_failed == (n < 50 or 100 * repeats > 50 * n)
        assert r.kept == (not r.base_failed and r.p_quality >= 0.5)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.judge_quality(df.limit(0)).count() == quality.keep_good(df.limit(0)).count() == 0


def test_accuracies_are_estimated():
    rng = np.random.RandomState(0)
    truth = rng.rand(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.99])
    votes = np.where(rng.rand(20_000, 5) < right, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.rand(20_000, 5) < 0.3] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, good, bad, share = quality.estimate(patterns, counts.astype(float), rounds=500)
    assert abs(share - 0.8) < 0.03 and np.abs(good - right).max() < 0.04 and np.abs(bad - right).max() < 0.06


def test_verdicts_are_the_posteriors_of_the_model(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    judged = quality.judge_quality(df).cache()
    rows = judged.select("p_quality", *(v.alias(k) for k, v in quality.rules().items())).collect()
    patterns = Counter(tuple(r)[1:] for r in rows)
    posterior = dict(zip(sorted(patterns), quality.estimate(np.array(sorted(patterns)), np.array([patterns[p] for p in sorted(patterns)], float))[0]))
    assert all(r.p_quality == pytest.approx(posterior[tuple(r)[1:]], abs=1e-6) for r in rows)
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == sorted(r.doc_id for r in judged.filter("kept").collect())


def test_labels_agree_with_the_verdict(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.queries()["op4_quality_rules"](spark, sf).join(labels, "doc_id").filter("NOT base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


# ---- toxicity ---------------------------------------------------------------------------------------------


def toxic_corpus(n=1200, seed=4):
    rng = random.Random(seed)
    words, bad = [f"w{k}" for k in range(400)], ["nasty", "vile", "rotten"]
    rows, labels = [], []
    for k in range(n):
        text = rng.choices(words, k=rng.randint(5, 120))
        toxic = rng.random() < 0.15
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(bad).upper() + ",")
        rows.append((k, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((k, int(toxic)))
    return rows, labels, {k for k, t in rows if re.search("(?i)nasty|vile|rotten", t)}


def test_toxic_documents_are_found(spark):
    rows, labels, toxic = toxic_corpus()
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "nasty words")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, labels[0], (None, 1), (77777, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r.score for r in toxicity.score(docs.withColumn("score", toxicity.F.lit("mine")), model).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    clean = [got[k] for k, _ in rows if k not in toxic]
    assert np.mean([got[k] >= 0.3 for k in toxic]) > 0.95 and np.mean([s >= 0.3 for s in clean]) < 0.05
    assert got[9000] == got[9001] < 0.3
    again = toxicity.train(docs.repartition(7), marks)
    assert np.array_equal(model.words, again.words) and np.allclose(model.weights, again.weights)


def test_held_out_labels_are_not_seen(spark):
    rows, labels, _ = toxic_corpus(400)
    import zlib

    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flipped = [(k, t if zlib.crc32(str(k).encode()) % 4 != 2 else 1 - t) for k, t in labels]
    one = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    two = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert np.array_equal(one.words, two.words) and np.array_equal(one.weights, two.weights)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.train(docs, none) is None and toxicity.train(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None
    assert toxicity.score(docs, None).first().score == 0.0


def test_slope_is_that_of_the_risk():
    """Against differences of the risk as the definition has it, where its clean part is positive and where it isn't."""
    rng = np.random.RandomState(2)
    for shift in (-2.0, 3.0):
        positive = np.arange(30) < 8
        z = rng.randn(30) + np.where(positive, shift, -shift)
        both_signs = lambda x: np.log1p(np.exp(-x)), lambda x: np.log1p(np.exp(x))

        def parts(z):
            as_toxic, as_clean = (f(z) for f in both_signs)
            return 0.4 * as_toxic[positive].mean(), as_clean[~positive].mean() - 0.4 * as_clean[positive].mean()

        risk = (lambda z: -parts(z)[1]) if parts(z)[1] < 0 else lambda z: sum(parts(z))
        want = [(risk(z + h) - risk(z - h)) / 2e-6 for h in 1e-6 * np.eye(30)]
        assert np.allclose(toxicity.risk_slope(z, positive, 0.4), want, atol=1e-7)
        assert (parts(z)[1] < 0) == (shift > 0)


def test_samples_have_the_size_they_are_said_to_have(spark, monkeypatch):
    assert all(toxicity.share(20_000, n) * n > 20_000 for n in (10**5, 10**9, 10**11, 10**14)) and toxicity.share(5, 0) == toxicity.share(5, 3) == 1
    seen = []
    fit = toxicity.fit_nnpu
    monkeypatch.setattr(toxicity, "fit_nnpu", lambda rows, cols, positive, *a, **b: (seen.append(positive), fit(rows, cols, positive, *a, **b))[1])
    rows = [(None, f"word w{k % 50} x{k}") for k in range(3000)] + [(None, "same row")] * 3000 + [(1, f"nasty one two v{k}") for k in range(500)] + [(k, f"vile nasty u{k}") for k in range(3, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1)] + [(k, 1) for k in range(3, 60)] + [(k, 0) for k in range(100, 400)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks, positives=20, unlabelled=100)
    assert [(int(p.sum()), int((~p).sum())) for p in seen] == [(20, 100)]
    assert model.score(memoryview(b"nasty vile")) > model.score(memoryview(b"word w3"))


def test_toxicity_query(spark):
    import zlib

    got = {r.doc_id: r for r in queries.queries()["op2_toxicity"](spark, SF).collect()}
    whole = texts(spark)
    assert got.keys() == whole.keys()
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    words = {int(w): x for w, x in zip(model.words, model.weights)}
    for i, text in whole.items():
        odds = model.bias + sum(words.get(int(h), 0.0) for h in set(toxicity.letter_words(memoryview(text.encode())).tolist()))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9) and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)


def test_other_columns_are_carried(spark):
    rows = [(1, "a nasty text", 0.5, "x", [1]), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic double, row string, words array<int>")
    model = toxicity.Model(np.array([5], np.uint64), np.array([1.0]), 0.0)
    out = toxicity.scored(df, model).select("row.*")
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(rows)


# ---- mixing -----------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == [300 * 5 / 8, 300 * 2 / 8, 300 / 8]
    assert mixing.targets([10, 500, 500]) == [30.0, (1010 - 30) * 2 / 3, (1010 - 30) / 3]
    assert mixing.targets([]) == [] and mixing.targets([0, 5]) == [0.0, 5.0]


def test_permutations_go_through_all_indices():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 5):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(500), np.full(500, 500), np.full(500, key)) for key in (1, 2))
    assert (a == b).mean() < 0.05


def test_shards_meet_their_quotas():
    drawn = list(mixing.shard_counts([1000, 10, 0, 333], 100, 3))
    assert sum(drawn).tolist() == [1000, 10, 0, 333] and all(d.sum() == 100 for d in drawn[:-1]) and all((d >= 0).all() for d in drawn)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 300, 2000])), rng.choice(["b", "a", "a", "a", None, "é"]), "x") for k in range(300)]
    rows += [(3, "again and again", "a", "x")] * 3 + [(None, None, "solo", "x"), (901, "tiny text", "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.taken_words(df).collect()
    assert len(got) == len(rows)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.taken_words(df.repartition(5)).collect()), key=repr)
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    for _, text, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip([sizes[n] for n in names], mixing.targets([sizes[n] for n in names])))
    assert {k: round(v, 6) for k, v in target.items()} == {k: round(v, 6) for k, v in want.items()}
    assert all(abs(taken[k] - target[k]) <= 0.02 * target[k] + 2 * mixing.BLOCK_WORDS for k in target)
    mixed = mixing.mixed_documents(df.withColumnsRenamed({"size": "_first"}).withColumn("taken", mixing.F.lit(1)))
    assert mixed.columns == ["doc_id", "text", "source", "_first", "taken"]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert {sizes[s]: words[s] for s in names if sizes[s]} == {k: v for k, v in taken.items() if k}
    assert mixing.taken_words(df.limit(0)).count() == mixing.mixed_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("stretch, copies", [(4000, 10_000), (7, 2)])
def test_mix_as_replayed_by_hand(spark, monkeypatch, stretch, copies):
    """Blocks, permuted slots and their join, over again in plain Python from the order of the layout."""
    monkeypatch.setattr(mixing, "STRETCH_ROWS", stretch)
    monkeypatch.setattr(mixing, "COPIES", copies)
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.choice([0, 2, 9, 40, 700])), rng.choice("abbbb")) for k in range(150)] + [(3, "again and again", "a")] * 5 + [(None, "no id", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.size, r.taken) for r in mixing.taken_words(df).collect())
    laid = [r.asDict() for r in mixing.plan(df).laid.collect()]
    sources = sorted({r["src"] for r in laid}, key=lambda s: (s == "n", s))
    words = {s: sum(r["size"] * r["copies"] for r in laid if r["src"] == s) for s in sources}
    taken = Counter()
    for k, (src, target) in enumerate(zip(sources, mixing.targets([words[s] for s in sources]))):
        mine = sorted((r for r in laid if r["src"] == src and r["size"]), key=lambda r: r["at"])
        line = [(r["doc_id"], r["h"], c) for r in mine for c in range(r["copies"]) for _ in range(r["size"])]
        assert len(line) == words[src] and [r["at"] for r in mine] == [sum(r["size"] * r["copies"] for r in mine[:n]) for n in range(len(mine))]
        blocks = [line[f : f + mixing.BLOCK_WORDS] for f in range(0, len(line), mixing.BLOCK_WORDS)]
        n = len(blocks)
        for slot in range(min(round(target * n / words[src]), 3 * n) if n else 0):
            at = mixing.permuted(np.array([slot % n]), np.array([n]), np.array([k * 1_000_003 + slot // n * 7919 + 7]))[0]
            taken.update(blocks[at])
    want = Counter((r["doc_id"], r["size"], taken[r["doc_id"], r["h"], c]) for r in laid for c in range(r["copies"]))
    assert got == want


@pytest.mark.parametrize("batch", [1 << 16, 3])
def test_shards_drawn_in_groups(spark, monkeypatch, batch):
    monkeypatch.setattr(mixing, "BATCH_SLOTS", batch)
    quotas, blocks = [5000, 70, 0, 933], [1700, 70, 0, 400]
    got = mixing._shards(spark, quotas, blocks, 10, 3).collect()
    assert len({r.shard for r in got}) == 601 and set(Counter(r.shard for r in got).values()) <= {10, 3}
    for k, (quota, n) in enumerate(zip(quotas, blocks)):
        mine = sorted((r.slot, r["pass"], r.block) for r in got if r.k == k)
        assert [x[0] for x in mine] == list(range(quota))
        for turn in range(quota // n if n else 0):
            assert sorted(x[2] for x in mine if x[1] == turn) == list(range(n))


# ---- fingerprints -----------------------------------------------------------------------------------------


def test_fingerprints_of_edited_texts(spark):
    docs = sorted(texts(spark).items(), reverse=True)
    got = {r.doc_id: r for r in queries.queries()["op9_fingerprints"](spark, SF).collect()}
    import hashlib

    assert len(got) == len(docs)
    for k, (i, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        part = len(text) // 3
        edited = text[: len(text) - part] + after[:part]
        own, other, third = (simhash.fingerprint(t.encode()) for t in (text, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(edited.encode()).hexdigest(), own.hex(), other.hex())
        assert (r.near_edited, r.near_next) == (simhash.likeness(own, other), simhash.likeness(own, third))
    assert np.median([r.near_edited for r in got.values()]) > 0.7 > 0.6 > np.median([r.near_next for r in got.values()])


def test_fingerprints_as_by_a_plain_simhash():
    """Signed votes of each term's own 128 bits, one term at a time."""
    def plain(text):
        hashes = [simhash.word_hashes(w.encode()) for w in WORD.findall(text)]
        runs = [hashes[k : k + 3] for k in range(max(1, len(hashes) - 2))] if hashes else []
        times = Counter(int(simhash.shingle_hashes(np.concatenate(r), len(r))[0]) for r in runs)
        votes = [0.0] * 128
        for term, n in times.items():
            bits = "".join(f"{b:08b}" for j in range(2) for b in int(simhash.mix64(np.array([(term + j * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]).to_bytes(8, "little"))
            for k, bit in enumerate(bits):
                votes[k] += round(256 * (1 + math.log(n))) * (1 if bit == "1" else -1)
        return int("".join("1" if v > 0 else "0" for v in votes), 2).to_bytes(16, "big")

    rng = random.Random(3)
    for text in ["", "one", "one two", " a b c a b c a b c", "é ü\nß"] + [" ".join(rng.choices(["a", "b", "ccc", "dé"], k=rng.randint(3, 90))) for _ in range(40)]:
        assert simhash.fingerprint(text.encode()) == plain(text), text


def test_hashes_do_not_depend_on_stretches(monkeypatch):
    from weftgraph.llm import common

    text = ("short words " * 30 + "x" * 5000 + " é" * 50 + " " + "y" * 64 + " end").encode()
    whole = common.word_hashes(text)
    small = {w: int(common.word_hashes(w)[0]) for w in set(text.split())}
    assert [small[w] for w in text.split()] == whole.tolist() and len(set(small.values())) == len(small)
    monkeypatch.setattr(common, "STRETCH", 64)
    again = common.word_hashes(text)
    assert [int(common.word_hashes(w)[0]) for w in text.split()] == again.tolist()
    assert all(a == b for a, b, w in zip(whole.tolist(), again.tolist(), text.split()) if len(w) <= 64) and len(set(again.tolist())) == len(small)


def in_order(spark, rows):
    h = dict(spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", simhash.F.xxhash64("text")).collect())
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1] or ""], r[1] is not None))


@pytest.mark.parametrize("heavy", [9, None])
def test_ids_of_very_many_rows_are_cut_by_hash(spark, monkeypatch, heavy):
    """Also where null ids, or one id, hold most rows; equal texts under one id stay together."""
    monkeypatch.setattr(simhash, "STRETCH_BYTES", 200)
    rows = [(heavy, f"heavy text {k}") for k in range(300)] + [(heavy, "again")] * 5 + [(k, f"light {k}") for k in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    schema = simhash.T._parse_datatype_string("doc_id long, own string, next string")
    got = simhash.with_next(df, lambda i, t, n: (i, t, n), schema)
    order = in_order(spark, rows)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)), key=repr)
    cuts = simhash._stretches(df.withColumn("h", simhash.F.xxhash64("text")))
    assert len(cuts) > 15 and (len(cuts.nulls) > 10 if heavy is None else (cuts.ids == 9).sum() > 10)


def test_order_is_the_same_however_it_is_cut(spark, monkeypatch):
    rows = [(k, f"text {k} " * (k % 5)) for k in range(0, 400, 3)] + [(9, "other"), (9, None), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    schema = simhash.T._parse_datatype_string("doc_id long, own string, next string")
    whole = sorted(map(tuple, simhash.with_next(df, lambda i, t, n: (i, t, n), schema).collect()), key=repr)
    monkeypatch.setattr(simhash, "STRETCH_BYTES", 100)
    cut = sorted(map(tuple, simhash.with_next(df, lambda i, t, n: (i, t, n), schema).collect()), key=repr)
    order = in_order(spark, rows)
    plain = [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]
    assert whole == cut == sorted(plain, key=repr)
    assert simhash.with_next(df.limit(0), lambda i, t, n: (i, t, n), schema).count() == 0


def test_radius_search_finds_all(spark):
    rng = random.Random(9)
    prints = []
    for k in range(150):
        bits = rng.getrandbits(128) if not prints or rng.random() < 0.3 else int(rng.choice(prints), 16)
        for _ in range(rng.randint(0, 5)):
            bits ^= 1 << rng.randrange(128)
        prints.append(f"{bits:032x}")
    df = spark.createDataFrame([*enumerate(prints), (None, prints[0]), (500, None)], "doc_id long, fingerprint string")
    classes, links = simhash.within_radius(df, 3)
    of = {r.doc_id: r.class_id for r in classes.collect()}
    assert of == {k: prints.index(p) for k, p in enumerate(prints)}
    got = {(r.a, r.b): r.distance for r in links.collect()}
    reps = sorted(set(of.values()))
    want = {(a, b): d for a in reps for b in reps if a < b and (d := (int(prints[a], 16) ^ int(prints[b], 16)).bit_count()) <= 3}
    assert got == want


def test_large_buckets_are_split(spark):
    rng = random.Random(4)
    base = rng.getrandbits(128)
    prints = sorted({f"{base ^ (1 << rng.randrange(128)) ^ (1 << rng.randrange(128)):032x}" for _ in range(90)}) + [f"{rng.getrandbits(128):032x}" for _ in range(30)]
    df = spark.createDataFrame([*enumerate(prints), (900, prints[0]), (None, prints[0])], "doc_id long, fingerprint string")
    near = {(a, b): d for b in range(len(prints)) for a in range(b) if (d := (int(prints[a], 16) ^ int(prints[b], 16)).bit_count()) <= 3}
    for most in (7, 2000):
        assert sorted(map(tuple, simhash.within_radius(df, 3, most=most)[1].collect())) == sorted((*k, d) for k, d in near.items())
        got = {(r.doc_id, r.class_id, r.n_links) for r in simhash.with_links(df, 3, most=most).collect()}
        n = Counter(k for pair in near for k in pair)
        assert got == {(k, k, n[k]) for k in range(len(prints))} | {(900, 0, n[0]), (None, None, None)}


def test_query_searches_within_the_radius(spark):
    got = queries.queries()["op9_fingerprints"](spark, SF).collect()
    first = {}
    for r in sorted(got, key=lambda r: r.doc_id):
        first.setdefault(r.fingerprint, r.doc_id)
    n = {p: sum(0 < (int(p, 16) ^ int(q, 16)).bit_count() <= simhash.RADIUS for q in first) for p in first}
    assert all((r.class_id, r.n_links) == (first[r.fingerprint], n[r.fingerprint]) for r in got)


# ---- licences ---------------------------------------------------------------------------------------------


def test_notices_and_inheritance(spark):
    rows = [
        ("/a/LICENSE", "Released under the MIT License."), ("/a/x.py", "some code\nthat says nothing"), ("/a/b/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 40),
        ("/a/b/c/z.py", None), ("/a/d/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), ("/a/d/e/q", "words"), ("/f/g", "All rights reserved."), ("/f/h", "the public version of this work"),
        (None, "Licensed under CC BY-NC 4.0."), ("/top", ""), ("/a/x.py", "some code\nthat says nothing"),
    ]
    df = spark.createDataFrame([(p, t, "mine") for p, t in rows], "path string, text string, licence string")
    got = [(r.path, r.own_licence, r.licence, r.inherited_from) for r in licences.scan(df).collect()]
    assert sorted(got, key=repr) == sorted([
        ("/a/LICENSE", "MIT", "MIT", None), ("/a/x.py", None, "MIT", "/a"), ("/a/x.py", None, "MIT", "/a"), ("/a/b/y.py", "Apache-2.0", "Apache-2.0", None), ("/a/b/c/z.py", None, "MIT", "/a"),
        ("/a/d/COPYING.txt", "GPL-3.0", "GPL-3.0", None), ("/a/d/e/q", None, "GPL-3.0", "/a/d"), ("/f/g", "proprietary", "proprietary", None), ("/f/h", None, "proprietary", "/f"),
        (None, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), ("/top", None, None, None),
    ], key=repr)
    assert licences.scan(df.limit(0)).count() == 0


def test_telling_tokens_lose_no_passage(spark):
    """Lines are scored only if they hold a telling token: scoring every line must give the same."""
    all_texts = texts(spark)
    files = spark.createDataFrame([(t,) for t in all_texts.values()], "text string")
    matcher = licences.Matcher(*licences.frequencies(files))
    df = Counter(t for text in all_texts.values() for t in set(licences.tokens(text.encode())))
    assert all(df[t] == n for t, n in licences.frequencies(files)[0].items())
    rng = random.Random(6)
    vocabulary = sorted({t for vs in matcher.templates for t in vs[1]})
    lines = [rng.choices(vocabulary, k=rng.randint(1, 8)) for _ in range(3000)] + [list(v) for _, v in matcher.templates]
    for line in lines:
        cosine, k = matcher.best(line)
        got = matcher.scan(b" ".join(line))
        assert got[:2] == ((matcher.templates[k][0], cosine) if cosine >= matcher.like else (None, 0.0))


def test_query_finds_every_notice(spark):
    got = {r.doc_id: r for r in queries.queries()["op8_licences"](spark, SF).collect()}
    notice = re.compile(r"Licensed under CC BY-NC 4.0|licensed under the GNU General Public License, version 3|Licensed under the Apache License, Version 2.0|Released under the MIT License|All rights reserved")
    assert {i for i, t in texts(spark).items() if notice.search(t)} == {i for i, r in got.items() if r.own_licence}


def test_notices_amid_other_words(spark):
    """In mid-line, in one-line documents, and wrapped over lines."""
    other = " ".join(f"word{k}" for k in range(90))
    texts = [
        ("Copyright 2020 Example Corp. All rights reserved.", "proprietary"), ("This article is licensed under CC BY-NC 4.0 by its author.", "CC-BY-NC-4.0"),
        (f"{other} Released under the MIT License. {other}", "MIT"), (f"{other} Licensed under the Apache License, Version 2.0 {other}", "Apache-2.0"),
        ("x = 1\n# This work is licensed under the\n# GNU General Public\n# License, version 3 and so on\ny = 2", "GPL-3.0"),
        (f"{other} all the rights of men {other}", None), (other, None),
    ]
    df = spark.createDataFrame([(f"/{k}/f", t) for k, (t, _) in enumerate(texts)], "path string, text string")
    got = {r.path: (r.own_licence, r.similarity) for r in licences.scan(df).collect()}
    assert got == {f"/{k}/f": (name, 1.0 if name else 0.0) for k, (_, name) in enumerate(texts)}


def test_all_licences_of_a_file(spark):
    other = "some words between them"
    texts = {
        f"Released under the MIT License. {other} Licensed under the Apache License, Version 2.0": ["Apache-2.0", "MIT"], "Licensed under CC BY-NC 4.0": ["CC-BY-NC-4.0"], f"Licensed under CC BY 4.0 {other} All rights reserved": ["CC-BY-4.0", "proprietary"],
        " ".join(["MIT License"] * 50): ["MIT"], other: [], "": [],
    }
    df = spark.createDataFrame([(f"/{k}/f", t, "mine", 1) for k, t in enumerate(texts)] + [("/x/f", None, None, None)], "path string, text string, _dir string, folder int")
    out = licences.scan(df)
    assert out.columns == ["path", "_dir", "folder", "licences", "own_licence", "similarity", "is_licence_file", "licence", "inherited_from"]
    got = {r.path: r.licences for r in out.collect()}
    assert got == {**{f"/{k}/f": want for k, want in enumerate(texts.values())}, "/x/f": []}


def test_inheritance_over_drawn_trees(spark, monkeypatch):
    from weftgraph.llm import common

    rng = random.Random(14)
    rows = [("/" + "/".join(rng.choices("abc", k=rng.randint(0, 4)) + [f"f{k}"]), rng.choice([None, None, None, "MIT", "GPL-3.0"])) for k in range(150)] + [(None, "MIT"), (None, None), ("bare", None)]
    rows = [(p, own, own is not None and rng.random() < 0.6, "x") for p, own in rows]
    folder = lambda p: p.rpartition("/")[0] if "/" in p else p
    holders = {}
    for p, own, holds, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if holds:
            holders.setdefault(folder(p), own)
    want = []
    for p, own, holds, x in rows:
        ups = [] if p is None else [folder(p).rsplit("/", n)[0] for n in range(folder(p).count("/") + 1)]
        up = next((u for u in ups if u in holders), None)
        want.append((p, own, holds, x, own or holders.get(up), up if own is None else None))
    df = spark.createDataFrame(rows, "path string, own_licence string, is_licence_file boolean, folder string")
    for most in (10_000, 2):
        monkeypatch.setattr(common, "MOST_HOT", most)
        monkeypatch.setattr(common, "HOT_ROWS", 3)
        assert sorted(map(tuple, licences.inherit(df).collect()), key=repr) == sorted(want, key=repr)


def test_weights_are_those_of_all_files(spark):
    """Words outside the templates weigh what their frequencies make them weigh, and results don't drift with size."""
    notice = "licensed under the apache license of version 2 0"
    rows = [notice, "all rights are reserved", "Text licensed under CC BY-NC 4.0 for our project", "MIT strange license"]
    for times in (1, 30):
        all_texts = (rows + ["of for our are project see author"] * 36 + ["zu dem rest von"] * 10) * times
        df = spark.createDataFrame([(f"/{k}/f", t) for k, t in enumerate(all_texts)], "path string, text string")
        got = {r.path: (r.own_licence, r.similarity) for r in licences.scan(df).filter("own_licence IS NOT NULL").collect()}
        each = Counter(t for text in all_texts for t in set(licences.tokens(text.encode())))
        idf = lambda t: math.log((len(all_texts) + 1) / (each[t] + 1)) + 1
        vector = lambda words: {t: n * idf(t) for t, n in Counter(words).items()}
        cosine = lambda x, y: sum(w * y.get(t, 0) for t, w in x.items()) / math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values()))

        def best(text: str) -> tuple[float, str]:
            words, found = licences.tokens(text.encode()), []
            for name, templates in licences.TEMPLATES.items():
                for other in (licences.tokens(x.encode()) for x in templates):
                    parts = [words] + [words[f : f + n] for n in licences.lengths(len(other)) for f in range(len(words) - n + 1)]
                    found += [(round(cosine(vector(p), vector(other)), 9), name) for p in parts]
            return max(found, key=lambda x: x[0])

        want = {f"/{k}/f": best(t)[::-1] for k, t in enumerate(rows) if best(t)[0] >= licences.LIKE}
        assert {p: got[p] for p in got if int(p.split("/")[1]) < len(rows)} == {p: (name, pytest.approx(x, abs=2e-9)) for p, (name, x) in want.items()}
        assert want["/0/f"][0] == "Apache-2.0" and want["/1/f"][0] == "proprietary" and want["/2/f"] == ("CC-BY-NC-4.0", 1.0)
        assert len(got) == len(want) * times
