import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as cp
from weftgraph.llm import toxicity
from weftgraph.llm.tokens import default_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_one_after_another(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, seen[-1], SF).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[r.asDict() for r in d.collect()] for d in seen]
    assert [n for n, _ in cp.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "bpe"]
    assert all(d.columns == columns for d in seen[:-1])
    whole = {r["doc_id"]: r for r in rows[0]}
    for before, after in zip(rows[:3], rows[1:4]):  # filters: rows stay as they are, some go
        assert 0 < len(after) <= len(before) and all(whole[r["doc_id"]] == r for r in after)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r["doc_id"] for r in rows[1]} == {i for i, r in whole.items() if model.score(memoryview((r["text"] or "").encode())) < toxicity.REJECT_AT}
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [WORD.findall(t.lower())] for k in range(max(1, len(w) - 4))}
    sets = [shingles(r["text"]) for r in rows[3]]
    assert all(100 * len(a & b) < 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    for r in rows[4]:  # parts of a document's words, in order
        source = iter(WORD.findall(whole[r["doc_id"]]["text"]))
        assert r["n_chars"] == len(r["text"]) and all(any(w == x for x in source) for w in WORD.findall(r["text"]))
    words = lambda found: sum(len(WORD.findall(r["text"])) for r in found)
    assert abs(words(rows[4]) - words(rows[3])) < 0.05 * words(rows[3])
    library = Tokenizer.from_file(default_path())
    coded = sorted((r["doc_id"], r["n_tokens"], bytes(r["ids"])) for r in rows[5])
    want = [(r["doc_id"], library.encode(r["text"], add_special_tokens=False).ids) for r in rows[4]]
    assert coded == sorted((i, len(x), np.array(x, "<u4").tobytes()) for i, x in want)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word " * 60, None, None, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        assert stage(spark, df, SF).count() <= 4


def test_run(spark):
    """The rows of run() are those of the stages one after another, and their tables but the last are gone."""
    import os

    from weftgraph.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = common.cut(stage(spark, docs, SF))
    out = cp.run(spark, SF)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    left = [n for n in os.listdir(common.shared_dir(spark).removeprefix("file://")) if "pipeline" in n]
    assert len(left) == 1 and "bpe" in left[0]


def test_a_failed_stage_leaves_nothing(spark, monkeypatch):
    import os

    import pytest

    from weftgraph.llm import common

    def fails(*_):
        raise RuntimeError("no")

    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    monkeypatch.setattr(cp, "STAGES", [cp.STAGES[4], ("fails", fails)])
    with pytest.raises(RuntimeError):
        cp.run(spark, SF)
    assert {n for n in os.listdir(common.shared_dir(spark).removeprefix("file://")) if "pipeline" in n} <= before
