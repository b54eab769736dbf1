"""Document fingerprints: SimHash, and a search that finds all fingerprints within a Hamming radius.

A text's terms are its runs of TERM_WORDS words (with fewer words, the whole sequence). Each distinct term is hashed to
BITS bits; every bit votes plus or minus the term's weight, 1 + ln(times in the text) in 256ths, so that sums are exact
on every machine; a fingerprint bit is set where the votes are positive. Equal texts have equal fingerprints; texts without words have the fingerprint of all zeros.
Likeness of two fingerprints is the share of equal bits.

within_radius() cuts fingerprints into blocks. Two that differ in `radius` bits at most agree in at least
blocks - radius whole blocks, so a table for each choice of that many blocks, keyed by them, holds every such pair in
a common bucket: the search is exact. Equal fingerprints are one class with one row, so copies make no pairs. A bucket
of over BUCKET classes is cut into parts, and every two parts meet in a unit of work of their own. A pair counts only
in the first table that holds it.

op9_fingerprints searches with RADIUS = 3 of 128 bits (a likeness of 0.977 or more), with four tables.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, join_hot, mix64, shingle_hashes, small_batches, table, texts_of, word_hashes

BITS, TERM_WORDS = 128, 3
#: Bytes of text in one stretch of the order of ids, and most stretches.
STRETCH_BYTES, MOST_STRETCHES = 8 << 20, 50_000
_ROWS = 4096
#: Bits in which fingerprints of near documents differ at most; classes in a bucket, or part of one, that meet at once.
RADIUS, BUCKET = 3, 2048
_TILE = 64


@lru_cache(maxsize=4)  # the next text of one document is the own text of the one after
def fingerprint(raw: bytes, width: int = TERM_WORDS) -> bytes:
    """BITS bits of a UTF-8 text."""
    terms, times = np.unique(shingle_hashes(word_hashes(raw), width), return_counts=True)
    votes = np.zeros(BITS, np.float64)
    for k in range(0, len(terms), _ROWS):
        part = terms[k : k + _ROWS]
        wide = np.stack([mix64(part + np.uint64(j * 0x9E3779B97F4A7C15 % (1 << 64))) for j in range(BITS // 64)], axis=1)
        bits = np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32)
        weight = np.minimum(np.rint(256 * (1 + np.log(times[k : k + _ROWS]))), 4095).astype(np.float32)  # sums stay under 2 ** 24
        votes += 2.0 * (weight @ bits) - float(weight.sum(dtype=np.float64))
    return np.packbits(votes > 0).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    return 1 - (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / BITS


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with `out` (hex string) in place of the text."""
    small_batches(df.sparkSession)

    @F.arrow_udf(T.StringType())
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(bytes(t)).hex() for t in texts_of(texts)], pa.string())

    return df.withColumn(out, prints(F.col(text).cast("string"))).drop(text)


@dataclass
class Stretches:
    """Where the stretches of an order begin: at ids, falling, and inside an id of very many rows (or null) at hashes.

    ids, hashes: of the first row of each stretch; LOWEST where it begins with its id. nulls: hashes of the first rows of
    stretches of null ids; without any, null ids end the last stretch.
    """

    ids: np.ndarray
    hashes: np.ndarray
    nulls: np.ndarray
    LOWEST = -(1 << 63)

    def __len__(self) -> int:
        return len(self.ids) + len(self.nulls)

    def of(self, ids: np.ndarray, null: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The stretch that each row lies in."""
        rising = self.ids[::-1]
        at = len(rising) - 1 - np.searchsorted(rising, ids, side="left")  # the last stretch that begins at the id or above
        for i in np.unique(self.ids[self.hashes > self.LOWEST]).tolist():
            mine = (ids == i) & ~null
            if mine.any():
                begin = np.flatnonzero(self.ids == i)
                at[mine] = begin[0] + np.searchsorted(self.hashes[begin], h[mine], side="right") - 1
        if len(self.nulls):
            return np.where(null, len(self.ids) + np.searchsorted(self.nulls, h, side="right") - 1, at)
        return np.where(null, len(self.ids) - 1, at)

    def begins(self, ids: np.ndarray, null: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Whether a row may be the first one of its stretch."""
        out = np.isin(ids, self.ids[self.hashes == self.LOWEST]) & ~null
        for i in np.unique(self.ids[self.hashes > self.LOWEST]).tolist():
            mine = (ids == i) & ~null
            out[mine] = np.isin(h[mine], self.hashes[self.ids == i])
        return np.where(null, np.isin(h, self.nulls), out)


def _stretches(docs: DataFrame) -> Stretches:
    """Stretches of about STRETCH_BYTES of docs (doc_id, text, h)."""
    size = F.octet_length("text")
    found = docs.agg(F.sum(size).alias("bytes"), F.max("doc_id").alias("top"), F.sum(F.when(F.col("doc_id").isNull(), size)).alias("null_bytes")).first()
    n = int(min(MOST_STRETCHES, max(1, (found["bytes"] or 0) // STRETCH_BYTES)))
    ids = [] if found["top"] is None else [found["top"]]
    if n > 1 and ids:
        inner = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n).alias("ids")).first()["ids"]
        ids = sorted([*ids, *inner], reverse=True)
    # An id that stands several times among the quantiles has rows for several stretches: they are cut by hash.
    parts = Counter(ids)
    many = {i: k for i, k in parts.items() if k > 2}
    null_parts = int(min(MOST_STRETCHES, (found["null_bytes"] or 0) // STRETCH_BYTES))
    starts = [(i, Stretches.LOWEST) for i in sorted(parts, reverse=True) if i not in many]
    nulls = []
    if many or null_parts > 1:
        spread = docs.sparkSession.createDataFrame([*many.items(), (None, max(1, null_parts))], "of long, parts long")
        cuts = docs.join(F.broadcast(spread), F.col("doc_id").eqNullSafe(F.col("of")))  # at most MOST_STRETCHES ids
        part = F.floor((F.col("h").cast("double") / float(1 << 63) + 1) / 2 * F.col("parts"))
        for r in cuts.groupBy("of", part.alias("part")).agg(F.min("h").alias("h")).collect():
            (nulls if r["of"] is None else starts).append(r["h"] if r["of"] is None else (r["of"], r["h"]))
    starts.sort(key=lambda x: (-x[0], x[1]))
    return Stretches(np.array([i for i, _ in starts], np.int64), np.array([h for _, h in starts], np.int64), np.array(sorted(nulls), np.int64))


def with_next(docs: DataFrame, visit, schema: T.StructType) -> DataFrame:
    """visit(doc_id, text, next text) for each row of docs (doc_id, text) in descending order of doc_id, rows with one
    id by a hash of the text, null ids last; after the last row comes the first again. visit returns a tuple of the
    schema's columns.

    The order is cut into stretches of about equal bytes, inside an id or the null ids too if they have very many rows,
    each streamed by one task. The row at which a stretch begins is also sent to the stretch before it, so no row is
    looked up elsewhere and texts are shuffled once. Only rows that repeat id and text are never parted.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    starts = _stretches(docs)
    n = max(1, len(starts))

    def arrays(ids: pa.Array, h: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.asarray(ids.fill_null(0)).astype(np.int64), np.asarray(ids.is_null()), np.asarray(h).astype(np.int64)

    @F.arrow_udf(T.IntegerType())
    def stretch_of(ids: pa.Array, h: pa.Array) -> pa.Array:
        """Twice the stretch of each row, and one more if it may be its first."""
        held = arrays(ids, h)
        return pa.array((2 * starts.of(*held) + starts.begins(*held)).astype(np.int32))

    own = docs.withColumn("_place", stretch_of("doc_id", "h") if n > 1 else F.lit(0)).withColumn("_guest", F.lit(False))
    own = own.withColumn("_at", F.floor(F.col("_place") / 2).cast("int"))
    if n > 1:
        both = F.array(F.struct(F.col("_at"), F.lit(False).alias("_guest")), F.struct(F.pmod(F.col("_at") - 1, F.lit(n)).cast("int").alias("_at"), F.lit(True).alias("_guest")))
        one = F.array(F.struct(F.col("_at"), F.lit(False).alias("_guest")))
        own = own.withColumn("_to", F.explode(F.when(F.col("_place") % 2 == 1, both).otherwise(one))).select("doc_id", "text", "h", "_to._at", "_to._guest")
    ordered = own.repartitionById(n, F.col("_at")).sortWithinPartitions("_guest", F.col("doc_id").desc_nulls_last(), "h", "text")
    names, kinds = schema.names, [to_arrow_type(f.dataType) for f in schema]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = held = None
        done = False
        for batch in batches:
            out = []
            for doc_id, text, guest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                text = text or ""
                if held is not None and not done:
                    out.append(visit(*held, text))
                if guest:
                    done = done or held is not None
                    if held is None:
                        done = True
                    continue
                if first is None:
                    first = text
                held = (doc_id, text)
            if out:
                yield packed(out)
        if held is not None and not done:
            yield packed([visit(*held, first)])

    return ordered.select("doc_id", "text", "_at", "_guest").mapInArrow(stream, schema)


def _pairs(a: np.ndarray, b: np.ndarray | None, table: int, radius: int, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a, rows of b (without b: later ones of a), and distances of the near pairs whose first table this is.

    Rows: high and low 64 bits.
    """
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    masks = [((1 << int(z - f)) - 1) << int(BITS - z) for f, z in zip(edges, edges[1:])]
    chosen = list(combinations(range(blocks), blocks - radius))[table]
    other = a if b is None else b
    for k in range(0, len(a), _TILE):
        x = a[k : k + _TILE, None, :] ^ other[None, k + 1 if b is None else 0 :, :]
        apart = np.bitwise_count(x).sum(axis=2, dtype=np.int16)
        near = apart <= radius
        if b is None:
            near &= np.arange(near.shape[1])[None, :] >= np.arange(near.shape[0])[:, None]
        for block, mask in enumerate(masks[: chosen[-1] + 1]):  # blocks before the last chosen one agree if and only if chosen
            high, low = np.uint64(mask >> 64), np.uint64(mask & (1 << 64) - 1)
            same = (x[..., 0] & high | x[..., 1] & low) == 0
            near &= same == (block in chosen)
        i, j = np.nonzero(near)
        yield i + k, j + (k + 1 if b is None else 0), apart[i, j]


def _found(ids: np.ndarray, others: np.ndarray, near: Iterator[tuple], counted: bool) -> pa.RecordBatch:
    """Near pairs, or for each id that is in one how many it is in."""
    near = list(near)
    i, j = (np.concatenate([np.zeros(0, np.int64), *(x[k] for x in near)]) for k in (0, 1))
    a, b = ids[i], others[j]
    if counted:
        held, n = np.unique(np.concatenate([a, b]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(n, pa.int64())], names=["class_id", "n"])
    distance = np.concatenate([np.zeros(0, np.int16), *(x[2] for x in near)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()), pa.array(distance)], names=["a", "b", "distance"])


def _search(classes: DataFrame, radius: int, blocks: int, counted: bool, most: int) -> DataFrame:
    """Near pairs (a, b, distance) of classes (class_id, fingerprint in hex), or counted: class_id, n for each part of them."""
    small_batches(classes.sparkSession)
    out = "class_id long, n long" if counted else "a long, b long, distance int"
    names = [f.name for f in T._parse_datatype_string(out)]
    edges = np.linspace(0, BITS, blocks + 1).astype(int)
    bits = F.concat(*[F.lpad(F.conv(F.substring("fingerprint", k * 8 + 1, 8), 16, 2), 32, "0") for k in range(BITS // 32)])
    half = lambda k: F.shiftleft(F.conv(F.substring("fingerprint", k * 16 + 1, 8), 16, 10).cast("long"), 32).bitwiseOR(F.conv(F.substring("fingerprint", k * 16 + 9, 8), 16, 10).cast("long"))

    def key(n: int, choice: tuple[int, ...]) -> Column:
        value = F.concat(*[F.substring("_bits", int(edges[k]) + 1, int(edges[k + 1] - edges[k])) for k in choice])
        return F.struct(F.lit(n).alias("t"), F.xxhash64(F.lit(n), value).alias("v"))

    choices = list(combinations(range(blocks), blocks - radius))
    keyed = classes.select("class_id", half(0).alias("high"), half(1).alias("low"), bits.alias("_bits"))
    keyed = keyed.select("class_id", "high", "low", F.explode(F.array(*[key(n, c) for n, c in enumerate(choices)])).alias("key")).select("key.t", "key.v", "class_id", "high", "low")
    rows = lambda batch: np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)])
    words = lambda x: np.ascontiguousarray(x[:, 3:5]).view(np.uint64)

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of small buckets; rows of large ones, with the part they are in, and the number of parts."""
        held, large, seen = np.zeros((0, 5), np.int64), None, 0

        def passed(part: np.ndarray, first: int, over: bool) -> pa.RecordBatch:
            of = (np.arange(len(part)) + first) // most
            ends = np.zeros(len(part), bool)
            if over:
                ends[-1] = True
            cols = [pa.array(part[:, k], pa.int64()) for k in range(5)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(of, pa.int32()), pa.array(ends), *(pa.nulls(len(part), pa.int64()) for _ in range(3))], names=schema)

        def near(part: np.ndarray) -> pa.RecordBatch:
            found = _found(part[:, 2], part[:, 2], _pairs(words(part), None, int(part[0, 0]), radius, blocks), counted)
            cols = [found.column(k).cast(pa.int64()) for k in range(len(names))] + [pa.nulls(found.num_rows, pa.int64())] * (3 - len(names))
            return pa.RecordBatch.from_arrays([*(pa.nulls(found.num_rows, pa.int64()) for _ in range(5)), pa.nulls(found.num_rows, pa.int32()), pa.nulls(found.num_rows, pa.bool_()), *cols], names=schema)

        def done(part: np.ndarray) -> Iterator[pa.RecordBatch]:
            if large is not None and len(part):
                yield passed(part, seen, True)
            elif len(part) > most:
                yield passed(part, 0, True)
            elif len(part) > 1:
                yield near(part)

        for batch in batches:
            found = rows(batch)
            held = np.concatenate([held, found])
            cuts = np.flatnonzero((np.diff(held[:, 0]) != 0) | (np.diff(held[:, 1]) != 0)) + 1
            start = 0
            for end in cuts.tolist():
                if end - start > 1 or large is not None:
                    yield from done(held[start:end])
                start, large, seen = end, None, 0
            held = held[start:]
            if len(held) > most + 1:  # one row stays back, to end the bucket with
                yield passed(held[:-1], seen, False)
                large, seen, held = True, seen + len(held) - 1, held[-1:]
        yield from done(held)

    schema = ["t", "v", "class_id", "high", "low", "part", "ends", "x", "y", "z"]
    dealt = keyed.repartition("t", "v").sortWithinPartitions("t", "v")
    first = cut(dealt.mapInArrow(buckets, "t long, v long, class_id long, high long, low long, part int, ends boolean, x long, y long, z long"), "buckets")
    small = first.filter("t IS NULL").select(*(F.col(c).alias(n) for c, n in zip("xyz", names)))
    split = first.filter("t IS NOT NULL")
    if split.isEmpty():
        return small
    parts = split.filter("ends").select("t", "v", (F.col("part") + 1).alias("_parts"))
    others = F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    units = split.join(parts, ["t", "v"]).select("t", "v", "class_id", "high", "low", "part", others.alias("_o"))
    unit = F.xxhash64("t", "v", F.least("part", "_o"), F.greatest("part", "_o"))
    units = units.select("t", "v", "class_id", "high", "low", unit.alias("unit"), "part").repartition("unit").sortWithinPartitions("unit", "part")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 7), np.int64)

        def done(part: np.ndarray) -> pa.RecordBatch:
            there = part[:, 6] == part[0, 6]
            a, b = part[there], part[~there]
            return _found(a[:, 2], b[:, 2] if len(b) else a[:, 2], _pairs(words(a), words(b) if len(b) else None, int(a[0, 0]), radius, blocks), counted)

        for batch in batches:
            held = np.concatenate([held, np.column_stack([rows(batch), batch.column(5).to_numpy(), batch.column(6).to_numpy()])])
            cuts = np.flatnonzero(np.diff(held[:, 5]) != 0) + 1
            start = 0
            for end in cuts.tolist():
                yield done(held[start:end])
                start = end
            held = held[start:]
        if len(held):
            yield done(held)

    met = units.mapInArrow(meet, out)
    return small.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(out))).unionByName(met)


def _classes(prints: DataFrame) -> DataFrame:
    return prints.filter("doc_id IS NOT NULL AND fingerprint IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("times"))


def within_radius(prints: DataFrame, radius: int, blocks: int | None = None, most: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(classes, links) of prints (doc_id, fingerprint in hex).

    classes: doc_id, class_id (smallest doc_id with that fingerprint) for each row with an id. links: a row for every
    pair of classes whose fingerprints differ in `radius` bits at most: a < b (class ids), distance.
    """
    classes = _classes(prints)
    links = _search(classes, radius, blocks or radius + 1, False, most).withColumn("distance", F.col("distance").cast("int"))
    return join_hot(prints.filter("doc_id IS NOT NULL AND fingerprint IS NOT NULL"), classes, "fingerprint", "times").select("doc_id", "class_id"), links


def with_links(docs: DataFrame, radius: int, blocks: int | None = None, most: int = BUCKET) -> DataFrame:
    """docs (doc_id, fingerprint, ...) with class_id and n_links: how many other classes lie within the radius.

    Null for rows without an id. Near pairs are counted where they are found, never listed.
    """
    docs = cut(docs, "fingerprints")
    classes = cut(_classes(docs), "classes")
    linked = _search(classes, radius, blocks or radius + 1, True, most).groupBy("class_id").agg(F.sum("n").alias("n_links"))
    known = classes.join(linked, "class_id", "left").select("fingerprint", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "times")
    out = join_hot(docs, cut(known, "known"), "fingerprint", "times")
    owned = lambda c: F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c)
    return out.select(*docs.columns, owned("class_id"), owned("n_links"))


def edited_text(text: str, following: str) -> tuple[bytes, str]:
    """The text with its last third of characters replaced by the first ones of the next text, and the hash of that."""
    part = len(text) // 3
    edited = (text[: len(text) - part] + following[:part]).encode()
    return edited, hashlib.sha256(edited).hexdigest()


def _edited(doc_id, text: str, following: str) -> tuple:
    edited, digest = edited_text(text, following)
    own, other, after = fingerprint(text.encode()), fingerprint(edited), fingerprint(following.encode())
    return doc_id, len(text), digest, own.hex(), other.hex(), likeness(own, other), likeness(own, after)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likenesses; class_id, the smallest id with that
    fingerprint, and n_links, the number of other classes within RADIUS bits."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    schema = T._parse_datatype_string("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return with_links(with_next(docs, _edited, schema), RADIUS)
