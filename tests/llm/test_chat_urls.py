import hashlib

from weftgraph.llm import chat, queries, urls

ROWS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "</turn>\n### Assistant: no"), (1, 2, "assistant", "back\\slash \\/ \\\\ \\# </turn>"),
    (2, 0, None, None), (2, 1, "weird: role\\</turn>\n### ", "#### x"), (2, 1, "User", "### "), (None, None, "assistant", "é </tur n></turn>"), (None, None, "assistant", "é </tur n></turn>"),
    (3, 5, "assistant", ""), (3, 4, "user", "x" * 50_000 + "\\" * 300), (4, 0, "@user", "a: b"), (5, 0, "assistant", "<\\/turn> #\\## "),
]


def test_every_conversation_reads_back(spark):
    df = spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, spans string")
    out = chat.format_chats(df)
    found = {r.conv_id: r for r in out.withColumn("back", chat.read_conversation(out.formatted)).collect()}
    want = {}
    for c, t, role, text in sorted(ROWS, key=lambda r: tuple((x is not None, x or "") if not isinstance(x, int) else (True, x) for x in r)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert found.keys() == want.keys()
    for c, turns in want.items():
        assert found[c].identical
        assert sorted((t.role, t.text) for t in found[c].back) == sorted(turns)
        unescaped = lambda s: s.replace("\\\\", "\0").replace("\\/", "/").replace("\\#", "#").replace("\\:", ":").replace("\0", "\\")
        assert [unescaped(found[c].formatted[s.at : s.at + s.chars]) for s in found[c].spans] == [t.text for t in found[c].back if t.role == "assistant"]
    assert found[1].formatted.startswith("### User: plain</turn>\n")
    assert chat.format_chats(df.limit(0)).count() == 0


def test_query_reads_back_what_went_in(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    hard = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    want = {}
    for c, _, role, text in sorted(rows):
        want.setdefault(c, []).append((role, text))
    got = {r.conv_id: r for r in queries.queries()["op3_chat_format"](spark, sf).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].formatted_chars > sum(len(t) for _, t in turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def plain_rule(url):
    url = url or ""
    before, mark, after = url.partition("://")
    if not mark:
        return "", "", None, None
    at = min([after.find(c) for c in "/?#" if c in after] or [len(after)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in after[:at])
    rest = after[at:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for verdict, rule in urls.RULES:
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_rules_and_verdicts(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://Ex.NET", "http://Example.NET/en/x", "http://notexample.net/en/", "ftp://a.example.com/de/?q=/x#y", "http://x.org/fr", "http://x.org/fr/a?b#c", "a://b://c/d", "http://a?x/://y", "http://ÄÖ.net/é\n/z"]
    odd += [f"http://h{k}.example.net/{l}/{k}?a={k}&b=1" for k in range(30) for l in ("en", "de")] + [f"http://h{k}.example.org/es/{k}" for k in range(10)]
    odd += ["http://a.com/" + "x/" * 20_000, odd[20], odd[20]]
    df = spark.createDataFrame([(k, u, "mine", 1.0, "a", "b", 3) for k, u in enumerate(odd)], "page_id long, url string, verdict string, label double, f_length string, k_suffix string, row int")
    assert urls.judge_urls(df).columns == ["page_id", "url", "label", "f_length", "k_suffix", "row", "host", "path", "rule", "verdict", "p_block"]
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert len(got) == len(odd)
    for k, u in enumerate(odd):
        host, path, rule, verdict = plain_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), u
        assert got[k].verdict == verdict if verdict else got[k].verdict in ("allow", "block")
    assert urls.judge_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge_urls(df.filter("url IS NULL")).collect()} == {"allow"}


def test_trees_learn_what_labels_show(spark):
    rows = [(k, f"http://s{k % 7}.{'bad' if k % 2 else 'good'}.com/{'x' * (k % 5)}/{k}") for k in range(400)]
    rules = [("block", "bad.com/x/"), ("allow", "good.com/x/"), ("block", "bad.com/xx/"), ("allow", "good.com/xx/")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("rule IS NULL").collect()
    assert len(got) > 100
    # The suffix doesn't tell them apart, lengths do: "good" is longer than "bad".
    assert sum((r.verdict == "block") == (".bad." in r.url) for r in got) / len(got) > 0.9


def test_url_query(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.queries()["op5_url_filter"](spark, sf).collect()}
    assert got.keys() == pages.keys()
    for i, url in pages.items():
        host, path, rule, verdict = plain_rule(url)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict if rule else got[i].verdict == ("block" if got[i].p_block > 0.5 else "allow")


def test_features_and_shares_as_counted_by_hand(spark):
    import math
    from collections import Counter

    url = "https://a-b.example.com/de//x1/y-2?q=1&r=&#f"
    row = urls.lexical(urls.found_in(spark.createDataFrame([(url,)], "url string"))).first()
    n, each = len(url), Counter(url)
    want = [n, 15, 11, 3, 3 / n, -sum(c / n * math.log2(c / n) for c in each.values()), 2, 3, 2, 1]
    assert [row[f] for f in urls.FEATURES[:10]] == [__import__("pytest").approx(x) for x in want] and (row.k_suffix, row.k_segment) == ("com", "de")
    seen = [(f"http://h{k}.{'net' if k % 3 else 'com'}/{'ab'[k % 2]}/{k}", float(k % 4 == 0)) for k in range(60)]
    labelled = urls.found_in(spark.createDataFrame(seen, "url string, label double")).select("url", "host", "path", "row.label")
    trees = urls.Trees(labelled)
    fold = {r.host: r.fold for r in labelled.select("host", urls.F.pmod(urls.F.xxhash64("host"), urls.F.lit(urls.FOLDS)).alias("fold")).collect()}
    base = (15 + 1) / (60 + 2)
    for r in trees.judge(labelled.withColumn("row", urls.F.lit(1))).collect():
        assert 0 <= r.p_block <= 1
    assert len(set(fold.values())) > 1 and trees.base == base


def test_accuracy_on_hosts_kept_apart(spark):
    """Labels of a fifth of all hosts are kept from the trees; rules name whole domains, so other hosts tell."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    labelled = urls.labelled_in(pages).withColumn("apart", urls.F.pmod(urls.F.xxhash64("host", urls.F.lit(5)), urls.F.lit(5)) == 0)
    trees = urls.Trees(labelled.filter("NOT apart").drop("apart"))
    rows = trees.judge(labelled.filter("apart")).collect()
    right = sum((r.verdict == "block") == (r.label == 1) for r in rows) / len(rows)
    print("accuracy on", len(rows), "urls of hosts kept apart:", right, "blocked:", sum(r.label for r in rows))
    assert right > 0.9
