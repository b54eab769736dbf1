"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents are the positives; a sample of all documents, toxic ones among them, is the unlabelled set. With
the class prior p, the risk on clean documents is that on unlabelled ones less p times that of calling positives
clean. This estimate can't be negative in truth; where it becomes so while fitting, the step goes against it instead,
which keeps the classifier from fitting the positives by heart. The classifier is logistic, in numpy, on the presence
of words; the words are those most unevenly spread between the two sets.

Training reads a bounded sample: at most POSITIVES toxic and UNLABELLED other documents, those with the smallest
64-bit hashes of id and text, and FEATURES words. Rows that repeat id and text are drawn as one. Labels, language,
source and doc_id are no inputs of a score. Rows held out (crc32 of the id's text, modulo 4, is 2; a null id isn't held
out) are not trained on. Every text is scored whole; null and empty texts get the score of a text without known words;
without a toxic label, or without a document to draw as unlabelled, all scores are 0. Equal texts get equal scores; a
document with several labels is toxic if one of them says so; rows that share an id share its label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, letter_words, release, rows_with_text, small_batches, table, texts_of, tidy

POSITIVES, UNLABELLED, FEATURES = 8_000, 20_000, 2_000
#: Toxic documents that must hold a word before it can be a feature.
LEAST_SEEN = 5
#: Standard errors by which its shares among toxic and unlabelled documents must differ.
LEAST_UNEVEN = 1.5
#: What the squares of weights cost, over the number of positives. This and the two above: by cross-validation inside
#: the rows that aren't held out.
RIDGE = 0.1
PREDICT_AT, REJECT_AT = 0.3, 0.3
#: How many more rows than wanted pass the first, unsorted choice: room for the spread of a random number of rows.
_SPARE = 1.1


def share(wanted: int, n: int) -> float:
    """The share of n rows to choose at random for `wanted` of them to be there; no rounding, whatever n is."""
    return min(1.0, (_SPARE * wanted + 200) / n) if n else 1.0


def _unit(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))


def _smallest(rows: DataFrame, wanted: int) -> int:
    """The wanted-th smallest h of rows (h), or one that all are under."""
    last = rows.select("h").distinct().orderBy("h").limit(wanted).agg(F.max("h").alias("h"), F.count("*").alias("n")).first()
    return last["h"] if last["n"] == wanted else (1 << 63) - 1



@dataclass
class Model:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def score(self, raw: memoryview) -> float:
        if not len(self.words):
            return float(1 / (1 + np.exp(-self.bias)))
        found = np.unique(letter_words(raw))
        at = np.minimum(np.searchsorted(self.words, found), len(self.words) - 1)
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[at[self.words[at] == found]].sum(), -50, 50))))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def risk_slope(z: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """How the risk estimate changes with each document's log odds of being toxic.

    Where the part of it that stands for clean documents is negative, the step goes against that part instead.
    """
    n_pos, n_unl = max(1, int(positive.sum())), max(1, int((~positive).sum()))
    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    lost = np.logaddexp(0, z)  # of calling each clean: -log(1 - p)
    clean_risk = lost[~positive].sum() / n_unl - prior * lost[positive].sum() / n_pos
    of_clean = np.where(positive, -prior * p / n_pos, p / n_unl)
    return -of_clean if clean_risk < 0 else of_clean + np.where(positive, prior * (p - 1) / n_pos, 0)


def fit_nnpu(rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, n_features: int, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias. rows, cols: where a document has a feature; positive: for each document, else unlabelled."""
    weights, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, steps + 1):
        slope = risk_slope(bias + np.bincount(rows, weights[cols], minlength=len(positive)), positive, prior)
        grad = np.append(np.bincount(cols, slope[rows], minlength=n_features) + l2 * weights, slope.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return weights, bias


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, features: int = FEATURES) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, toxic), or None without toxic rows to learn from."""
    small_batches(docs.sparkSession)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("toxic") == 1).cast("long")), F.lit(0)).alias("toxic")).first()
    n_docs = docs.count()
    if not counts["toxic"] or not n_docs:
        return None
    prior = float(np.clip(counts["toxic"] / counts["n"], 1e-4, 0.9))
    toxic = known.filter((F.col("toxic") == 1) & (_unit(F.xxhash64("doc_id")) < share(positives, counts["toxic"]))).select("doc_id")
    # At most `positives` ids, hence a broadcast.
    toxic = toxic.orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives).select("doc_id", F.lit(True).alias("toxic"))
    own = docs.filter(~held_out()).select("doc_id", F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("doc_id", "text"))
    both = own.join(F.broadcast(toxic), "doc_id", "left").select("text", "h", F.coalesce("toxic", F.lit(False)).alias("toxic"), (_unit(F.col("h")) < share(unlabelled, n_docs)).alias("drawn"))
    sample = both.filter("toxic OR drawn")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(letter_words(x)).astype(np.int64).tolist() for x in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), *batch.columns[1:]], names=["words", "h", "toxic", "drawn"])

    chosen_rows = cut(sample.mapInArrow(words, "words array<bigint>, h long, toxic boolean, drawn boolean"), "toxicity")
    last_toxic, last_drawn = _smallest(chosen_rows.filter("toxic"), positives), _smallest(chosen_rows.filter("drawn"), unlabelled)
    sample = chosen_rows.withColumns({"toxic": F.col("toxic") & (F.col("h") <= last_toxic), "drawn": F.col("drawn") & (F.col("h") <= last_drawn)})
    sample = cut(sample.filter("toxic OR drawn").dropDuplicates(["h"]), "toxicity")
    release(chosen_rows)
    size = sample.agg(F.sum(F.col("toxic").cast("long")).alias("p"), F.sum(F.col("drawn").cast("long")).alias("u")).first()
    n_pos, n_unl = size["p"] or 0, size["u"] or 0
    if not n_pos or not n_unl:
        return None
    seen = sample.select(F.explode("words").alias("word"), F.col("toxic").cast("int").alias("p"), F.col("drawn").cast("int").alias("u"))
    seen = seen.groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") >= LEAST_SEEN)
    both_share = (F.col("p") + F.col("u")) / (n_pos + n_unl)
    uneven = F.abs(F.col("p") / n_pos - F.col("u") / n_unl) / F.sqrt(both_share * (1 - both_share) * (1 / n_pos + 1 / n_unl) + 1e-12)
    seen = seen.withColumn("uneven", uneven).filter(F.col("uneven") >= LEAST_UNEVEN)
    chosen = np.sort(np.array([r["word"] for r in seen.orderBy(F.desc("uneven"), "word").limit(features).select("word").collect()], np.int64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found in batch.column(0):
                found = np.asarray(found.values, np.int64)
                at = np.searchsorted(chosen, found)
                at = np.minimum(at, max(0, len(chosen) - 1))
                out.append(at[chosen[at] == found].astype("<u2").tobytes() if len(chosen) and len(found) else b"")
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), *batch.columns[1:]], names=["at", "h", "toxic", "drawn"])

    rows, cols, positive, k = [], [], [], 0
    for r in sample.mapInArrow(places, "at binary, h long, toxic boolean, drawn boolean").orderBy("h").toLocalIterator():
        at = np.frombuffer(r["at"], "<u2").astype(np.int64)
        for kind in [True] * r["toxic"] + [False] * r["drawn"]:  # a toxic document may be drawn as an unlabelled one too
            rows.append(np.full(len(at), k))
            cols.append(at)
            positive.append(kind)
            k += 1
    weights, bias = fit_nnpu(np.concatenate(rows), np.concatenate(cols), np.array(positive), len(chosen), prior, l2=2e-4 + RIDGE / n_pos)
    order = np.argsort(chosen.astype(np.uint64))
    return Model(chosen.astype(np.uint64)[order], weights[order], bias)


def score(df: DataFrame, model: Model | None, text: str = "text", out: str = "score") -> DataFrame:
    """df with `out` (0 to 1) beside its columns; a column of that name is replaced."""
    rest = df.select(*(F.col(f"`{c}`") for c in df.columns if c != out))
    return scored(rest, model, text).select("row.*", F.col("score").alias(out))


def scored(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """row (the row of df) and score for each row of df."""
    rows, texts = rows_with_text(df, text)
    if model is None:
        return rows.select("row", F.lit(0.0).alias("score"))
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([model.score(x) for x in texts_of(texts(batch))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["row", "score"])
        tidy()

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
