"""Token counts: the tokenizer library's lengths, in Arrow batches, without keeping any ids.

Batches are balanced by bytes, and texts are split at safe boundaries before they are encoded, so that a very long
text costs no more memory than a short one and a piece that comes again is encoded once for each worker. A boundary
is safe where no normalisation, special string, pre-token or merge of the tokenizer can reach over it:

* "space": the tokenizer drops white space, so the six ASCII spaces separate what it encodes;
  a long piece without them is also split after CJK punctuation before an ideograph or an ASCII letter or digit, where
  one pre-token ends, the next one begins, and nothing composes;
* "before_space": pre-tokens may start with one space but never hold one further on, so a single space between two
  other characters starts a new piece;
* "at_space": no piece of the vocabulary reaches over a space, and none but single spaces between ASCII letters and
  digits are split at, which every part gets back as its first character;
* "none": nothing is known, and whole texts go to the library.

Null and empty texts have no tokens; repeated rows are counted one by one; other columns pass through unchanged, one
called as the result is replaced.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections import ChainMap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table, texts_of

#: Bytes of the pieces whose lengths a worker keeps, in two generations of this many: when the younger is full it
#: becomes the older one, whose pieces move up again when they are met. Longer pieces than LONG_PIECE aren't kept.
#: Bounds memory only.
KEPT_BYTES, LONG_PIECE = 40 << 20, 256
#: Bytes that a kept piece takes beside its own, about.
_EACH = 130
#: Bytes of new pieces that go to the library at once.
BATCH_BYTES = 1 << 20
_BEFORE_SPACE = re.compile(rb"(?<=[^\s]) (?=[^\s])")
_AT_SPACE = re.compile(rb"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")
#: Behind an ideographic comma or full stop, or the wide comma, exclamation or question mark.
_AFTER_MARK = re.compile("(?<=[\u3001\u3002\uff0c\uff01\uff1f])(?=[\u4e00-\u9fffA-Za-z0-9])")


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TokenLengths:
    """Lengths of texts in tokens, as the library of the vocabulary file gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[bytes, int] = {}
        self.older: dict[bytes, int] = {}
        self.held = 0  # bytes in the younger generation
        self.specials: list[bytes] = []
        self.boundary, self.fold = "none", False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: map(len, model.encode(texts, num_threads=1))
            pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
            if not any("\u2581" in p.lstrip("\u2581") for p in pieces) and len(model.encode("a b")) == len(model.encode("a")) + len(model.encode("b")):
                self.boundary = "at_space"
            return
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_padding()
        model.no_truncation()
        self.library = lambda texts: map(len, model.encode_batch_fast(texts, add_special_tokens=False))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [x["content"].encode() for x in spec["added_tokens"]]
        before, normal = json.dumps(spec["pre_tokenizer"]), json.dumps(spec["normalizer"])
        if '"Removed", "invert": true' in before and "[^\\\\s\\\\p{L}\\\\p{N}]+" in before:
            self.boundary, self.fold = "space", '"Lowercase"' in normal
        elif spec["normalizer"] is None and '"ByteLevel"' in before and '"use_regex": true' in before:
            self.boundary = "before_space"

    def pieces(self, raw: bytes) -> list[bytes]:
        """The parts of a text whose lengths add up to its own."""
        if self.boundary == "none" or not raw:
            return [raw] * bool(raw)
        if self.boundary == "before_space":
            cuts = [0, *(m.start() for m in _BEFORE_SPACE.finditer(raw)), len(raw)]
            return [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        if self.boundary == "at_space":
            return _AT_SPACE.split(raw)
        # Lower-casing must not create a special string.
        if self.fold and not any(x[:2] in raw for x in self.specials):
            raw = raw.lower()
        out = raw.split()
        if max(map(len, out), default=0) > LONG_PIECE:
            out = [p for x in out for p in (self.parts(x) if len(x) > LONG_PIECE else (x,))]
        return out

    def parts(self, piece: bytes) -> list[bytes]:
        """Parts of a long piece without spaces; special strings hold no CJK punctuation, so none is cut."""
        return [p.encode() for p in _AFTER_MARK.split(piece.decode("utf-8", "replace"))]

    def learn(self, new: set[bytes]) -> None:
        """Has the library encode pieces not yet known, in batches of about equal bytes."""
        tails, todo = [], {}
        for piece in new:
            # A full stop or comma after an ASCII letter is a pre-token of its own at the end of a word.
            parts = (piece,)
            if self.boundary == "space" and len(piece) > 1 and piece[-1] in b".," and piece[-2:-1].isalpha():
                tails.append(piece)
                parts = (piece[:-1], piece[-1:])
            for part in parts:
                if part in self.older:
                    self.keep(part, self.older[part])
                elif part not in self.known:
                    todo[part] = None
        for batch in by_bytes(list(todo)):
            for part, n in zip(batch, self.library([x.decode("utf-8", "replace") for x in batch])):
                self.keep(part, n)
        for piece in tails:
            self.keep(piece, self.known[piece[:-1]] + self.known[piece[-1:]])

    def keep(self, piece: bytes, n: int) -> None:
        self.known[piece] = n
        self.held += len(piece) + _EACH

    def __call__(self, texts: list[memoryview]) -> list[int]:
        out = []
        for group in by_bytes(texts):
            split = [self.pieces(bytes(x)) for x in group]
            if self.boundary == "none":
                lengths = iter(self.library([x[0].decode("utf-8", "replace") for x in split if x]))
                out += [next(lengths) if x else 0 for x in split]
                continue
            if self.held > KEPT_BYTES:
                self.older, self.known, self.held = self.known, {}, 0
            words = set().union(*split).difference(self.known)
            long = [x for x in words if len(x) > LONG_PIECE]
            self.learn(words.difference(long))
            lengths = {}
            for batch in by_bytes(long):
                lengths.update(zip(batch, self.library([x.decode("utf-8", "replace") for x in batch])))
            of = ChainMap(lengths, self.known) if long else self.known
            out += [sum(map(of.__getitem__, x)) for x in split]
        return out


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenLengths:
    """One for each Python worker, which serves many tasks."""
    return TokenLengths(path)


def by_bytes(texts: list[memoryview], most: int = BATCH_BYTES) -> Iterator[list[memoryview]]:
    """Runs of texts of about `most` bytes together; a longer text stands alone."""
    held, size = [], 0
    for x in texts:
        if held and size + len(x) > most:
            yield held
            held, size = [], 0
        held.append(x)
        size += len(x)
    if held:
        yield held


def count_tokens(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """df with a column `out` (long) in place of `text`: how many tokens the text has."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c not in (text, out)]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.LongType())])

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            counted = pa.array(count(list(texts_of(column))), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), counted], names=[*rest, out])

    return df.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(lengths, schema)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, default_path()).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
