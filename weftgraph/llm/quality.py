"""Quality rules by weak supervision.

Each rule looks at one statistic of a whole text and votes good, bad, or abstains. How far a rule can be trusted isn't
set by hand: expectation-maximisation over the counts of all vote patterns estimates, for each rule, how often it
votes good on good texts and bad on bad ones, together with the share of good texts, and gives every pattern a
posterior probability of quality. A document stays if that is KEEP_AT or more and the base limits don't rule it out.

Votes of all documents are counted by Spark; only the counted patterns (3 to the power of the rules at most, whatever
the input) reach the driver. What is learnt, two numbers a rule, goes back as an expression on the votes. Null and empty
texts have no words and fail the base limits. Equal texts get equal verdicts; other columns pass through, those called
as a result column are replaced. Without rows there is nothing to learn and no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, release, rows_with_text, shingle_hashes, small_batches, span_hashes, table, texts_of, tidy, word_spans

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct_words", "n_same_as_last", "n_short_words", "n_lettered_words"]
GOOD, BAD, ABSTAIN = 1, 0, -1
MIN_WORDS, KEEP_AT = 50, 0.5
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _vote(share: Column, bad_above: float, good_below: float) -> Column:
    return F.when(share > bad_above, BAD).when(share <= good_below, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The rules, as votes on the statistics. Limits are those common for filtering web text."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words
    few = F.col("n_words") < 20
    return {
        "length": F.when(F.col("n_words") < MIN_WORDS, BAD).when(F.col("n_words").between(100, 100_000), GOOD).otherwise(ABSTAIN),
        "word_length": F.when((mean < 2.5) | (mean > 12), BAD).when(mean.between(3, 10), GOOD).otherwise(ABSTAIN),
        "symbols": _vote(F.col("n_symbols") / words, 0.1, 0.02),
        "same_lines": F.when(F.col("n_lines") < 5, ABSTAIN).otherwise(_vote(F.col("n_dup_lines") / lines, 0.3, 0.1)),
        "repeats": _vote(F.col("n_repeat_words") / words, 0.3, 0.1),
        "line_ends": F.when(F.col("n_lines") < 2, ABSTAIN).otherwise(_vote(1 - F.col("n_ended_lines") / lines, 0.85, 0.4)),
        "stutter": F.when(few, ABSTAIN).otherwise(_vote(F.col("n_same_as_last") / words, 0.15, 0.05)),
        "short_words": F.when(few, ABSTAIN).otherwise(_vote(1 - F.col("n_short_words") / words, 0.95, 0.85)),
        "letters": _vote(1 - F.col("n_lettered_words") / words, 0.25, 0.1),
    }


def statistics_of(raw: memoryview) -> list[int]:
    """STATISTICS of one text."""
    b = np.frombuffer(raw, np.uint8)
    start, end = word_spans(b)
    n = len(start)
    if not n:
        return [0] * len(STATISTICS)
    chars = int(np.count_nonzero((b & 0xC0) != 0x80)) - (len(b) - int((end - start).sum()))
    hashes = span_hashes(b, start, end)
    repeated = 0
    if n >= 3:
        _, which, times = np.unique(shingle_hashes(hashes, 3), return_inverse=True, return_counts=True)
        again = times[which] > 1
        if again.any():
            covered = np.zeros(n, dtype=bool)
            for k in range(3):
                covered[k : n - 2 + k] |= again
            repeated = int(covered.sum())
    breaks = np.flatnonzero(b == 10)
    begin, stop = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(b)]))
    # The last byte of the last word in each line; lines without a word don't count.
    after = np.searchsorted(start, stop)
    full = after > np.searchsorted(start, begin)
    line_hash = span_hashes(b, begin[full], stop[full])
    ended = np.isin(b[end[after[full] - 1] - 1], np.frombuffer(b".!?:;\"'\x9d", np.uint8))
    letters = np.concatenate(([0], np.cumsum(_LETTER[b])))
    length = end - start
    return [
        n, chars, int(_SYMBOL[b].sum()), len(line_hash) - len(np.unique(line_hash)), repeated, len(line_hash), int(ended.sum()),
        len(np.unique(hashes)), int((hashes[1:] == hashes[:-1]).sum()), int((length <= 3).sum()), int((letters[end] > letters[start]).sum()),
    ]


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """df with STATISTICS (long) in place of the text."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != text and c not in STATISTICS]
    schema = T.StructType([*(df.schema[c] for c in rest), *(T.StructField(c, T.LongType()) for c in STATISTICS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics_of(x) for x in texts_of(batch.column(len(rest)))], np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(rest))), *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], names=[*rest, *STATISTICS])
        tidy()

    return df.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(measure, schema)


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Posterior of quality for each vote pattern, each rule's accuracy on good and on bad texts, and the share of good ones.

    A two-class model in which rules vote independently given the class, fitted by expectation-maximisation with
    add-one smoothing. It starts from: good unless some rule votes bad. A rule is never held to be worse than chance,
    which keeps the classes from changing places.
    """
    cast = votes != ABSTAIN
    good = votes == GOOD
    posterior = np.where((votes == BAD).any(axis=1), 0.1, 0.9)
    for _ in range(rounds):
        up, down = counts * posterior, counts * (1 - posterior)
        on_good = (1 + up @ (cast & good)) / (2 + up @ cast)
        on_bad = (1 + down @ (cast & ~good)) / (2 + down @ cast)
        on_bad = np.maximum(on_bad, 1 - on_good + 1e-6)
        share = (1 + up.sum()) / (2 + counts.sum())
        log_good = np.log(share) + np.where(cast, np.where(good, np.log(on_good), np.log1p(-on_good)), 0).sum(axis=1)
        log_bad = np.log1p(-share) + np.where(cast, np.where(good, np.log1p(-np.minimum(on_bad, 1 - 1e-9)), np.log(on_bad)), 0).sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))
        if np.abs(new - posterior).max(initial=0) < 1e-9:
            posterior = new
            break
        posterior = new
    return posterior, on_good, on_bad, float(share)


@dataclass(frozen=True)
class Trust:
    """What was learnt: log odds of quality without votes, and what each rule's vote for good and for bad adds."""

    start: float
    for_good: tuple[float, ...]
    for_bad: tuple[float, ...]

    def p_quality(self) -> Column:
        odds = F.lit(self.start)
        for vote, good, bad in zip(rules().values(), self.for_good, self.for_bad):
            odds = odds + F.when(vote == GOOD, good).when(vote == BAD, bad).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def learn(counted: DataFrame) -> Trust:
    """Estimates from the votes on all rows of counted (STATISTICS)."""
    found = counted.groupBy(*(v.alias(name) for name, v in rules().items())).agg(F.count("*").alias("n")).collect()
    found = sorted(map(tuple, found))
    rows = np.array(found, np.int64).reshape(len(found), len(rules()) + 1)
    _, good, bad, share = estimate(rows[:, :-1], rows[:, -1].astype(float))
    good, bad = (np.clip(x, 1e-9, 1 - 1e-9) for x in (good, bad))
    return Trust(float(np.log(share / (1 - share))), tuple(np.log(good / (1 - bad)).tolist()), tuple(np.log((1 - good) / bad).tolist()))


def base_failed() -> Column:
    """Whether the base limits rule a text out, whatever the rules vote."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge_quality(df: DataFrame, text: str = "text") -> DataFrame:
    """df with STATISTICS, p_quality, base_failed and kept in place of the text."""
    own = [c for c in df.columns if c != text and c not in (*STATISTICS, "p_quality", "base_failed", "kept")]
    counted = cut(statistics(df.select(*own, text), text), "quality")
    judged = counted.withColumn("p_quality", learn(counted).p_quality()).withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= KEEP_AT))


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows that aren't kept. Texts are measured twice, once to count votes and once to filter, so
    that none is shuffled or written; each row is judged by its own statistics of the second time."""
    small_batches(docs.sparkSession)
    counted = cut(statistics(docs.select(F.col(text).alias("text"))), "votes")
    trust = learn(counted)
    release(counted)
    rows, texts = rows_with_text(docs, text)
    schema = T.StructType([rows.schema["row"], *(T.StructField(c, T.LongType()) for c in STATISTICS)])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([statistics_of(x) for x in texts_of(texts(batch))], np.int64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(STATISTICS)))], names=schema.names)
        tidy()

    return rows.mapInArrow(measure, schema).filter(~base_failed() & (trust.p_quality() >= KEEP_AT)).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five base statistics, base_failed, kept and p_quality for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")
