"""Mixing sources to target weights by packed blocks.

The words of each source, its documents laid end to end in an order given by a hash, are packed into blocks of a fixed
length. Output shards of a fixed number of slots draw how many slots each source gets from a multinomial over what
the sources still have to give, so that the draws of all shards add up to the targets. The k-th slot of a source takes
the block that a pseudorandom permutation of the source's block indices gives for k: the indices are gone through
whole before any block comes again, each time in another order. Slots and blocks meet in a join by index.

Sources, in order of code points with null last, weigh 5, 2, 1 and so on again. Targets share out all words by weight,
stop at `cap` times what a source has, and the excess is shared again by weight until no target is above.
Sizes are words; a null text has none, and is never taken. Repeated rows are documents of their own with equal shares
of the layout. Very long texts lie in many blocks, one row each. No column of the caller clashes with one of these.
Without rows there is no result. Everything follows from the rows and the seed, so reruns agree.

One row for each source passes through the driver; more than MOST_SOURCES are an error. Shards number MOST_SHARDS at
most and grow beyond that. They are drawn in groups: the driver draws what each group gets of each source (MOST_DRAWN
numbers at most), and each group draws its shards in a task of its own. No documents pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut, row_of, small_batches, table, texts_of, tidy, word_spans

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 128
SLOTS_PER_SHARD = 4096
MOST_SHARDS = 20_000
MOST_SOURCES, MOST_DRAWN = 1_000_000, 4_000_000
#: Documents in a stretch of the layout that is ordered by one task.
STRETCH_ROWS = 4_000
#: Slots of a shard that are taken through the permutations at once.
BATCH_SLOTS = 1 << 16
#: Copies of one row that a row stands for, when copies are listed.
COPIES = 10_000


@dataclass
class Mix:
    """laid: a row for each distinct document row with where it lies; sources: totals and targets; draws: source, block, pass."""

    laid: DataFrame
    sources: DataFrame
    draws: DataFrame


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> list[float]:
    """The target of each source, in their order."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), list(range(len(sizes)))
    while open_:
        total = sum(weight[k] for k in open_)
        full = [k for k in open_ if left * weight[k] / total > cap * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * weight[k] / total
            break
        for k in full:
            out[k] = float(cap * sizes[k])
        left -= sum(out[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of 0..n-1 takes k: a Feistel network, walked on until it lands below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        h, m, s = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            x = (right + s + np.uint64(turn * 0x9E3779B9)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29)) ^ s) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def shard_counts(quotas: list[int], slots: int, seed: int) -> Iterator[np.ndarray]:
    """For each output shard, how many of its slots each source gets; over all shards the quotas are met exactly."""
    rng = np.random.default_rng(seed)
    left = np.array(quotas, np.int64)
    while (rest := int(left.sum())) > 0:
        size = min(slots, rest)
        drawn = np.minimum(rng.multinomial(size, left / rest), left)
        while (short := size - int(drawn.sum())) > 0:  # a source had too little left: draw those slots from the others
            open_ = left - drawn
            drawn = np.minimum(drawn + rng.multinomial(short, open_ / open_.sum()), left)
        left = left - drawn
        yield drawn


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK_WORDS, slots: int = SLOTS_PER_SHARD, seed: int = 7) -> Mix:
    """Draws the mix of docs (doc_id, text, source; other columns only tell rows apart)."""
    spark = docs.sparkSession
    small_batches(spark)
    sized = docs.select(
        "doc_id",
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source").cast("string"))).alias("src"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*docs.columns).alias("h"),
    )
    rows = cut(sized.groupBy("doc_id", "src", "size", "h").agg(F.count("*").alias("copies")), "mix")
    found = rows.groupBy("src").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("rows")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(found, key=lambda r: (r["src"] == "n", r["src"]))
    sizes = [int(r["words"]) for r in found]
    wanted = targets(sizes, weights, cap)
    blocks = [-(-n // block) for n in sizes]
    quotas = [min(round(t * b / n), math.floor(cap) * b) if n else 0 for t, b, n in zip(wanted, blocks, sizes)]
    schema = "src string, k long, source_size long, target double, n_blocks long"
    sources = spark.createDataFrame([(r["src"], k, n, t, b) for k, (r, n, t, b) in enumerate(zip(found, sizes, wanted, blocks))], schema)

    # Where each row lies: the words of all earlier stretches of its source, then of earlier rows of its stretch.
    stretches = max(1, -(-sum(int(r["rows"]) for r in found) // STRETCH_ROWS))
    rows = rows.withColumn("stretch", F.pmod("h", F.lit(stretches)))
    words = F.col("size") * F.col("copies")
    totals = rows.groupBy("src", "stretch").agg(F.sum(words).alias("total"))
    before = Window.partitionBy("src").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("src", "stretch", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("src", "stretch").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn("at", F.coalesce(F.sum(words).over(within), F.lit(0))).join(totals, ["src", "stretch"])
    laid = laid.select("doc_id", "src", "size", "h", "copies", (F.col("at") + F.col("start")).alias("at"))

    draws = _shards(spark, quotas, blocks, max(slots, -(-sum(quotas) // MOST_SHARDS)), seed).join(F.broadcast(sources.select("k", "src")), "k")
    draws = draws.select("shard", "src", "pass", "block")
    return Mix(laid, sources, draws)


def _shards(spark: SparkSession, quotas: list[int], blocks: list[int], per_shard: int, seed: int) -> DataFrame:
    """shard, k (number of a source), slot (number of a draw from the source), pass, block: a row for each slot.

    blocks: how many blocks each source has. A task draws the shards of a group one after another and takes the runs of
    slots that they get of each source through the source's permutation.
    """
    n = len(quotas)
    shards = -(-sum(quotas) // per_shard)
    in_group = max(64, -(-shards * n // MOST_DRAWN))
    rows, done = [], np.zeros(n, np.int64)
    for group, drawn in enumerate(shard_counts(quotas, per_shard * in_group, seed)):
        rows.append((group, drawn.tobytes(), done.tobytes()))
        done = done + drawn
    sizes = np.array(blocks, np.int64).tobytes()  # one number a source

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.frombuffer(sizes, np.int64)
        for batch in batches:
            for group, quota, start in zip(*(c.to_pylist() for c in batch.columns)):
                at = np.frombuffer(start, np.int64)
                for i, drawn in enumerate(shard_counts(np.frombuffer(quota, np.int64), per_shard, seed * 1_000_003 + group + 1)):
                    for f in range(0, int(drawn.sum()), BATCH_SLOTS):
                        within = np.arange(f, min(f + BATCH_SLOTS, int(drawn.sum())))
                        ends = np.cumsum(drawn)
                        k = np.searchsorted(ends, within, side="right")
                        slot = at[k] + within - (ends - drawn)[k]
                        block = permuted(slot % size[k], size[k], k * 1_000_003 + slot // size[k] * 7919 + seed)
                        shard = np.full(len(k), group * in_group + i)
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, k, slot, slot // size[k], block)], names=["shard", "k", "slot", "pass", "block"])
                    at = at + drawn
        tidy()

    groups = spark.createDataFrame(rows, "group long, quota binary, start binary").repartition(max(1, min(len(rows), 200)))
    return groups.mapInArrow(draw, "shard long, k long, slot long, pass long, block long")


def segments(mix: Mix, block: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document with words (doc_id, h, copy) and block that it lies in: its words first..last there."""
    laid = mix.laid.filter("size > 0")
    end = F.col("at") + F.col("size")
    inside = F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))
    cut_up = _copies(laid).withColumn("at", F.col("at") + F.col("copy") * F.col("size")).select("doc_id", "src", "size", "h", "copy", "copies", "at", F.explode(inside).alias("block"))
    first = F.greatest(F.col("block") * block, F.col("at")) - F.col("at")
    last = F.least((F.col("block") + 1) * block, end) - F.col("at") - 1
    return cut_up.select("doc_id", "src", "size", "h", "copy", "copies", "block", first.alias("first"), last.alias("last"))


def _copies(laid: DataFrame) -> DataFrame:
    """laid with a row for each of a row's copies, numbered from 0; those of a row with very many are dealt out."""
    number = lambda first, last: F.explode(F.sequence(first, last))
    few = laid.filter(F.col("copies") <= COPIES).withColumn("copy", number(F.lit(0).cast("long"), F.col("copies") - 1))
    many = laid.filter(F.col("copies") > COPIES).withColumn("run", number(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).repartition("doc_id", "h", "run")
    many = many.withColumn("copy", number(F.col("run") * COPIES, F.least((F.col("run") + 1) * COPIES, F.col("copies")) - 1)).drop("run")
    return few.unionByName(many)


def taken_words(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    mix = plan(docs)
    counts = mix.draws.groupBy("src", "block").agg(F.count("*").alias("times"))
    met = segments(mix).join(counts, ["src", "block"], "left")
    words = F.coalesce((F.col("last") - F.col("first") + 1) * F.col("times"), F.lit(0))
    each = met.groupBy("doc_id", "src", "size", "h", "copy").agg(F.sum(words).alias("taken")).select("doc_id", "src", "size", "taken")
    wordless = _copies(mix.laid.filter("size = 0")).select("doc_id", "src", "size", F.lit(0).cast("long").alias("taken"))
    return each.unionByName(wordless).join(mix.sources, "src").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: for each document and pass a row with the words taken in that pass, in the columns of docs.

    A text keeps its own white space inside the runs of words taken; runs are joined by a new line.
    n_chars, where there is one, is counted anew.
    """
    small_batches(docs.sparkSession)
    mix = plan(docs)
    parts = segments(mix).join(mix.draws.select("src", "block", "pass"), ["src", "block"])
    runs = parts.groupBy("h", F.xxhash64("doc_id").alias("id"), "copy", "copies", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))
    runs = runs.select("h", "id", "copies", F.struct("runs.first", "runs.last").alias("taken"))
    rows = docs.select(row_of(docs), F.xxhash64(*docs.columns).alias("h"), F.xxhash64("doc_id").alias("id"))
    # A row that is there once has a run or two a pass: a hash table of these, so that texts are dealt out but not sorted.
    both = rows.join(runs.filter("copies = 1").drop("copies").hint("shuffle_hash"), ["h", "id"]).select("row", "taken")
    repeated = mix.laid.filter("copies > 1").select("h", F.xxhash64("doc_id").alias("id")).distinct()
    if not repeated.isEmpty():
        once = rows.join(repeated, ["h", "id"], "left_semi").dropDuplicates(["h", "id"])
        both = both.unionByName(once.join(runs.filter("copies > 1").drop("copies"), ["h", "id"]).select("row", "taken"))
    names = docs.columns
    text = names.index("text")

    def slice_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.column(0).flatten()
            firsts, lasts = (batch.column(1).field(k).to_pylist() for k in (0, 1))
            texts = [_slices(bytes(t), a, b) for t, a, b in zip(texts_of(out[text].cast(pa.string())), firsts, lasts)]
            out[text] = pa.array(texts, pa.string()).cast(out[text].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                out[k] = pa.array([len(t) for t in texts], pa.int64()).cast(out[k].type)
            yield pa.RecordBatch.from_arrays(out, names=names)
        tidy()

    return both.mapInArrow(slice_texts, docs.schema)


def _slices(raw: bytes, firsts: list[int], lasts: list[int]) -> str:
    start, end = word_spans(np.frombuffer(raw, np.uint8))
    runs: list[list[int]] = []
    for a, z in zip(firsts, lasts):
        if runs and runs[-1][1] == a - 1:
            runs[-1][1] = z
        else:
            runs.append([a, z])
    return b"\n".join(raw[start[a] : end[z]] for a, z in runs).decode("utf-8", "replace")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return taken_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
