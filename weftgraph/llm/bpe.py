"""BPE encoding and decoding by dynamic programming over prefixes.

The greedy merge order of byte-pair encoding has a useful property: for every prefix of a word the encoding ends in
one definite token, and a token may follow another exactly if merging their joined symbols would leave the border
between them untouched. So a table of last tokens is filled from left to right: an automaton over the vocabulary
gives, for each prefix, the tokens that are suffixes of it, longest first; the first one that is compatible with the
last token of what stands before it is the last token of this prefix. Following the table back from the whole word
gives the ids, in time linear in the word's length for bounded token lengths, however long the word is.

Words are encoded once for each task and kept, in two generations of KEPT_BYTES at most: when the younger is full, it
becomes the older one, whose words move up again when they are met. Words of over LONG_WORD bytes (text without spaces)
are encoded where they stand and not kept. This bounds memory and drops nothing.
Null and empty texts give no ids and decode to an empty text; equal texts get equal ids; other columns pass through
unchanged, those called as a result are replaced.
"""

from __future__ import annotations

import functools
import gc
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, texts_of, tidy
from .tokens import default_path

KEPT_BYTES, LONG_WORD = 48 << 20, 256
#: Bytes that a kept word takes beside its own and its ids', about.
_EACH = 170
#: Pairs of tokens whose verdict is kept, of about 150 bytes each, in two generations like the words.
KEPT_PAIRS = 200_000
_END = "\0"  # stands behind the last symbol of a word inside the automaton; byte-level symbols never hold it


class PrefixBpe:
    """Encoder and decoder of a word-wise BPE vocabulary file with an end-of-word suffix."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        # Normalisation and pre-tokens are the file's own: which characters are letters depends on a Unicode version.
        library = Tokenizer.from_file(path)
        self.normalise, self.pre_tokens = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.tokens = {i: t for t, i in (vocab | self.specials).items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank: dict[int, int] = {}  # by left << 32 | right
        self.halves: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault(left << 32 | right, rank)
            if both not in self.halves:
                self.halves[both], self.born[both] = (left, right), rank
        self.edges: tuple[dict, dict] = ({}, {})
        self.automaton = ahocorasick.Automaton()
        for token, i in vocab.items():
            ends = token.endswith(suffix)
            core = token[: -len(suffix)] if ends else token
            if i in self.halves and not self.leaves(*self.halves[i], self.born[i]):
                continue  # merging its own symbols gives something else: never the result of encoding
            self.automaton.add_word(core + _END * ends, (len(core), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.fitted: dict[int, bool] = {}  # the older generation
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0  # bytes in the younger generation

    def edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The symbols that stand at one edge of a token while it is merged: id, rank at which it comes, at which it goes."""
        if found := self.edges[side].get(token):
            return found
        out, gone, at = [], float("inf"), token
        while True:
            born = self.born.get(at, -1)
            out.append((at, born, gone))
            if at not in self.halves:
                break
            at, gone = self.halves[at][side], born
        self.edges[side][token] = out
        return out

    def leaves(self, left: int, right: int, before: float = float("inf")) -> bool:
        """Whether no merge ranked under `before` joins the two tokens' symbols over the border between them."""
        heads, find = self.edge(right, 0), self.rank.get
        for a, a_born, a_gone in self.edge(left, 1):
            for b, b_born, b_gone in heads:
                rank = find(a << 32 | b)
                # Equal ranks merge from the left: the left token's own merge goes first, the right one's after.
                if rank is not None and rank < before and a_born < rank < a_gone and b_born < rank <= b_gone:
                    return False
        return True

    def fit(self, pair: int) -> bool:
        """Whether the pair's right token may follow the left one."""
        if len(self.fits) >= KEPT_PAIRS:
            self.fitted, self.fits = self.fits, {}
        ok = self.fitted.get(pair)
        if ok is None:
            ok = self.leaves(pair >> 32, pair & 0xFFFFFFFF)
        self.fits[pair] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given in byte symbols."""
        n = len(word)
        whole = self.automaton.get(word + _END, None)
        if whole is not None:  # the first of the tokens that end with the word, with nothing before it
            return [whole[1]]
        last, size = [0] * (n + 1), [0] * (n + 1)
        fits = self.fits
        for end, (length, token) in self.automaton.iter(word + _END):
            at = end + 1
            if at >= n:
                if at == n:  # only a token with the suffix ends a word
                    continue
                at = n
            if size[at]:
                continue
            start = at - length
            if start:
                pair = last[start] << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    ok = self.fit(pair)
                    fits = self.fits
                if not ok:
                    continue
            last[at], size[at] = token, length
        out, at = [], n
        while at > 0:
            if not size[at]:
                raise ValueError(f"no token of the vocabulary ends at place {at} of {word[:100]!r}")
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode_text(self, text: str) -> list[int]:
        """Ids of any text: special strings, then normalisation and pre-tokens, then the table."""
        out = []
        for part in self.split_specials.split(text):
            if part in self.specials:
                out.append(self.specials[part])
                continue
            for word, _ in self.pre_tokens(self.normalise(part)):
                out += self.encode_word(word)
        return out

    def words(self, raw: bytes) -> list[bytes]:
        """Parts that can be encoded alone: white space is dropped and nothing reaches over it."""
        return (raw if b"<|" in raw else raw.lower()).split()

    def keep(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.held += len(word) + len(ids) + _EACH

    def learn(self, new: set[bytes]) -> None:
        for word in new:
            # A full stop or comma after an ASCII letter is a pre-token of its own at the end of a word.
            if len(word) > 1 and word[-1] in b".," and word[-2:-1].isalpha():
                parts = (word[:-1], word[-1:])
                for part in parts:
                    if part not in self.known:
                        self.keep(part, self.packed(part))
                self.keep(word, self.known[parts[0]] + self.known[parts[1]])
            elif word not in self.known:
                self.keep(word, self.packed(word))

    def packed(self, word: bytes) -> bytes:
        if word in self.older:
            return self.older[word]
        if word.isalpha() and word.islower():  # ASCII: one pre-token as it stands
            ids = self.encode_word(word.decode())
        else:
            ids = self.encode_text(word.decode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, raw: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        words = self.words(raw)
        new = set(words).difference(self.known)
        if not new:
            return b"".join(map(self.known.__getitem__, words))
        long = {w: self.packed(w) for w in new if len(w) > LONG_WORD}
        if self.held > KEPT_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
            new = set(words)
        if not long:
            self.learn(new)
            return b"".join(map(self.known.__getitem__, words))
        self.learn(new.difference(long))
        return b"".join(long[w] if w in long else self.known[w] for w in words)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, special ones too, with a space between; the vocabulary file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=1)
def coder(path: str) -> PrefixBpe:
    """The coder of this process, made where it isn't there."""
    made = PrefixBpe(path)
    gc.collect()
    tidy()  # what reading the file took
    return made


def _forget() -> None:
    """Frees the coder at a task's end: making another takes less than a second, and a worker that waits for another
    stage's task, of which there may be several a core, holds none of it."""
    coder.cache_clear()
    gc.collect()
    tidy()


def _mapped(df: DataFrame, column: str, path: str, outs: dict[str, T.DataType], make) -> DataFrame:
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != column and c not in outs]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, t) for c, t in outs.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            named = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            yield pa.RecordBatch.from_arrays([*(named[c] for c in rest), *make(bpe, named[column])], names=[*rest, *outs])
            del batch, named
        del bpe
        _forget()

    return df.select(*rest, column).mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with `out` in place of `text`: its ids, packed as little-endian unsigned 32-bit integers."""

    def make(bpe: PrefixBpe, column: pa.Array) -> list[pa.Array]:
        return [pa.array([bpe.encode(bytes(x)) for x in texts_of(column)], pa.binary())]

    return _mapped(df.withColumn(text, F.col(text).cast("string")), text, path, {out: T.BinaryType()}, make)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with `out` in place of `ids`: the text of the tokens. Null ids decode to an empty text."""

    def make(bpe: PrefixBpe, column: pa.Array) -> list[pa.Array]:
        return [pa.array([bpe.decode(x.as_buffer() if x.is_valid else b"") for x in column], pa.string())]

    return _mapped(df, ids, path, {out: T.StringType()}, make)


def encode_and_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """df with `ids` and `decoded` in place of `text`: encode() and decode() in one pass over the texts."""

    def make(bpe: PrefixBpe, column: pa.Array) -> list[pa.Array]:
        ids = [bpe.encode(bytes(x)) for x in texts_of(column)]
        return [pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.string())]

    return _mapped(df.withColumn(text, F.col(text).cast("string")), text, path, {"ids": T.BinaryType(), "decoded": T.StringType()}, make)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    both = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path())
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
