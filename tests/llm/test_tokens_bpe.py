import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftgraph.llm import bpe
from weftgraph.llm.bpe import coder, decode, encode, encode_and_decode
from weftgraph.llm.tokens import TokenLengths, by_bytes, count_tokens, default_path

PATH = default_path()
ODD = ["", " ", "a", "aaaa aaaaa aaaaaaa", "I'm you'll DON'T 'S it's", "<|startoftext|>x <|ENDOFTEXT|> <|endoftext|>.", "İstanbul ΑΣ ΟΔΟΣ.", "\x1c\x1d\x85 \u200b\ufeffx\0y", "１２３ ½ ²", "日本語テキスト", "👍🏽👨‍👩‍👧", "a.b,c. d. e,, f.,", "x" * 5000 + "é" * 3000, "wort " * 4000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_words_as_the_library(library):
    rng = random.Random(3)
    alphabet = "abcdeéßñçÅŚ'’.,!?<|>endoftext 0123456789\t\n\xa0\u3000\u0301日本👍\x1c\x85İΣ"
    bpe, lengths = coder(PATH), TokenLengths(PATH)
    for text in ODD + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(1500)]:
        want = ids_of(library, text)
        got = bpe.encode(text.encode())
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert bpe.decode(got) == library.decode(want, skip_special_tokens=False)
        assert lengths([memoryview(text.encode())]) == [len(want)], text


_library = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    want = ids_of(_library, text)
    assert np.frombuffer(coder(PATH).encode(text.encode()), "<u4").tolist() == want


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(name):
    path = default_path(name)
    texts = [t for t in ODD if t] + ["  two  spaces ", "\n\n a\n", "the end"]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        want = [len(ids_of(Tokenizer.from_file(path), t)) for t in texts]
    assert TokenLengths(path)([memoryview(t.encode()) for t in texts]) == want


def test_store_of_words_may_overflow(monkeypatch, library):
    from weftgraph.llm import bpe, tokens

    monkeypatch.setattr(bpe, "KEPT_BYTES", 800)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 3)
    monkeypatch.setattr(tokens, "KEPT_BYTES", 700)
    small, lengths = bpe.PrefixBpe(PATH), tokens.TokenLengths(PATH)
    for text in ("one two three four five six seven, eight.", "one two nine", "six two one. one, two"):
        want = ids_of(library, text)
        assert np.frombuffer(small.encode(text.encode()), "<u4").tolist() == want
        assert lengths([memoryview(text.encode())]) == [len(want)]


MARKS = "、。，！？"


def test_texts_without_spaces(library):
    """They are split where it is safe, and what is kept of them is bounded by bytes."""
    from weftgraph.llm import bpe, tokens

    rng = random.Random(11)
    found = ["".join(rng.choices("日本語中文字" + MARKS + "ab1é.'、", k=900)) for _ in range(60)] + ["<|endoftext|>" + "日本、" * 200, "Ａ。's" * 100, "x" * 3000]
    coder_, lengths = bpe.PrefixBpe(PATH), TokenLengths(PATH)
    for text in found:
        want = ids_of(library, text)
        assert np.frombuffer(coder_.encode(text.encode()), "<u4").tolist() == want and lengths([memoryview(text.encode())]) == [len(want)], text
    assert sum(map(len, coder_.known)) < 2000 and all(len(k) <= tokens.LONG_PIECE for k in lengths.known)
    assert max(len(p) for p in lengths.pieces(found[0].encode())) < 900


def test_a_symbol_outside_the_vocabulary_is_an_error():
    with pytest.raises(ValueError):
        coder(PATH).encode_word("a\u2581b")


def test_pieces_of_a_sentence_model():
    import sentencepiece

    path = default_path("piece_bpe_32k.model")
    lengths, model = TokenLengths(path), sentencepiece.SentencePieceProcessor(model_file=path)
    assert lengths.boundary == "at_space"
    rng = random.Random(12)
    for _ in range(400):
        text = "".join(rng.choices(["a", "word", " ", " ", "  ", "é", "日本", "\n", "1", ".", "\u3000", "the ", "\u0301", "ﬁ"], k=rng.randint(1, 60)))
        assert lengths([memoryview(text.encode())]) == [len(model.encode(text))], text


def test_batches_by_bytes():
    texts = [memoryview(b"x" * n) for n in (3, 3, 3, 50, 1)]
    assert [[len(x) for x in run] for run in by_bytes(texts, 6)] == [[3, 3], [3], [50], [1]]


def test_frames(spark, library):
    rows = [(1, "Hello, world", 7, "x"), (1, "Hello, world", 7, "x"), (None, None, None, None), (2, "", 0, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string")
    counted = count_tokens(df, PATH).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids) for r in counted if r.ids) == [(1, 3, "x"), (1, 3, "x"), (2, 0, "y")]
    assert counted[0].asDict().keys() == {"doc_id", "ids", "n_tokens"}
    ids = encode(df, PATH)
    assert ids.columns == ["doc_id", "n_tokens", "ids"]
    back = {(r.doc_id, r.decoded) for r in decode(ids, PATH).collect()}
    assert back == {(1, "hello</w> ,</w> world</w>"), (None, ""), (2, "")}
    both = encode_and_decode(df.select("doc_id", "text"), PATH).collect()
    assert {(r.doc_id, r.decoded) for r in both} == back
    assert encode(df.limit(0), PATH).count() == count_tokens(df.limit(0), PATH).count() == 0


def test_queries_over_whole_table(spark, library):
    from weftgraph.llm import queries

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = {r.doc_id: r for r in queries.queries()["op7_token_counts"](spark, sf).collect()}
    coded = {r.doc_id: r for r in queries.queries()["op10_bpe"](spark, sf).collect()}
    assert counts.keys() == coded.keys() == texts.keys()
    import hashlib

    for i, text in texts.items():
        want = ids_of(library, text)
        assert counts[i].n_tokens == coded[i].n_tokens == len(want) and counts[i].over_limit == (len(want) > 2048)
        assert counts[i].n_bytes == len(text.encode())
        assert coded[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert coded[i].decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_pairs_in_use_are_not_judged_again(library, monkeypatch):
    made, judged = bpe.PrefixBpe(PATH), []
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 60)
    leaves = bpe.PrefixBpe.leaves
    monkeypatch.setattr(bpe.PrefixBpe, "leaves", lambda self, *pair: judged.append(pair) or leaves(self, *pair))
    assert made.encode_word("international") == ids_of(library, "international") and not judged  # one token
    made.encode_word("wortgebildet")
    own, rng = set(judged), random.Random(5)
    for _ in range(60):
        for word in ("wortgebildet", "".join(rng.choices("abcdefghij", k=9))):
            assert made.encode_word(word) == ids_of(library, word)
    assert own and len(set(judged)) > 200 and sum(pair in own for pair in judged) == len(own)
