"""MinHash near-dedup with two permutations, banding and exact verification.

A document's set is that of its distinct 5-word shingles, hashed to 64 bits. Circulant MinHash: one permutation of the
universe scatters a set, and a second one, shifted circularly by one more place for each coordinate, gives the whole
signature; two permutations stand in for one per coordinate. Signatures are cut into bands; equal sets are one class.

1. Classes that share a band are joined to one class there, the band's centre (a row per member, never one per pair).
   The connected components of those edges are the coarse groups: classes of different groups share no band.
2. Each such edge is verified on the full sets. The members of a centre are dealt to units of bounded size, each with
   the centre's set, so a group of near copies of one text costs one comparison a copy, however large it is.
3. Only in coarse groups that these links leave in several parts, sets of different parts meet too, best candidates by
   signature first. What is more than a unit holds is cut into blocks by part, and every two blocks that aren't of one
   part meet. A group of more blocks than there are bands is taken band by band instead, only sets that share one
   meeting. Pairs that links found so far connect are left out: they can't change what is reachable.
4. The components of the verified links, carried over to all members of the classes, are the result.

Null and empty texts have empty sets and link with nothing. Rows with one set always link. Rows are told apart by id
and text together, so rows that share an id but not a text are judged each by its own text. Rows with a null id link
like all others; they are not kept, and their component is the smallest id that they reach, null without one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import WORD, by_shuffle, cut, join_hot, mix64, release, row_of, shingle_hashes, small_batches, table, texts_of, tidy, word_hashes
from .components import components

WIDTH = 5
COORDINATES = 256
#: Shingles of the documents in one block of a unit of work; a longer document is a block of its own.
BLOCK_SHINGLES = 100_000
#: Bits of the filter that tells which texts are needed again (1 MB on the driver, whatever the input).
FILTER_BITS = 1 << 23
#: How far under the threshold the share of equal coordinates may be for a pair to be verified: over 4 standard errors.
MARGIN = 0.1
_TILE = 512
_SHIFT = np.arange(COORDINATES, dtype=np.uint32)[:, None]


def rows_per_band(percent: int) -> int:
    """Bands of so many rows miss a pair at the threshold with a probability under 1 in 10,000."""
    return 8 if percent >= 85 else 6 if percent >= 80 else 4


def shingle_set(raw: bytes | memoryview) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes(word_hashes(raw, lower=True), WIDTH))


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit minima: the k-th is the smallest place that the second permutation, shifted by k, gives."""
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    spread = (mix64(shingles) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    for k in range(0, len(spread), _TILE):
        x = spread[k : k + _TILE][None, :] - _SHIFT
        x *= np.uint32(0x9E3779B1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA77)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE3D)
        np.minimum(least, x.min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = COORDINATES // rows
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in sig[: bands * rows].reshape(bands, rows).T:
        out = mix64(out + part)
    return out.view(np.int64)


def _mark(doc_id: str, text: str) -> Column:
    """128 bits that tell rows apart by id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))).cast("binary")))


def _sketches(docs: DataFrame, rows: int) -> DataFrame:
    """doc_id, mark, n_shingles, digest of the set, bands (empty without shingles) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands = [], [], []
            for raw in texts_of(batch.column(2)):
                found = shingle_set(raw)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bands.append(band_keys(signature(found), rows) if len(found) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "mark", "n_shingles", "digest", "bands"],
            )
        tidy()

    return docs.mapInArrow(run, "doc_id long, mark binary, n_shingles long, digest binary, bands array<bigint>")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(a) + len(b) - both)


def verify(parts: list[int], blocks: list[int], sets: list[np.ndarray], sigs: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect all parts that the similar pairs of a group's sets connect.

    parts: what earlier links have connected, the same for the members of a part. blocks: if there are several, pairs
    inside one are not looked at, as another unit does.
    """
    n = len(sets)
    sizes, part, block = np.array([len(x) for x in sets]), np.array(parts), np.array(blocks)
    inside = len(set(blocks)) < 2
    stack = np.stack(sigs)
    near: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        fit = (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i])) & (part[i + 1 :] != part[i])
        if not inside:
            fit &= block[i + 1 :] != block[i]
        at = np.flatnonzero(fit)
        equal = (stack[at + i + 1] == stack[i]).sum(axis=1)
        # A byte agrees by chance once in 256 coordinates: that only adds candidates.
        good = equal >= COORDINATES * (percent / 100 - MARGIN)
        near += zip((-equal[good]).tolist(), [i] * int(good.sum()), (at[good] + i + 1).tolist())
    near.sort()
    root: dict[int, int] = {p: p for p in parts}

    def top(p: int) -> int:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    links = []
    for _, i, j in near:
        a, b = top(parts[i]), top(parts[j])
        if a != b and similar(sets[i], sets[j], percent):
            root[max(a, b)] = min(a, b)
            links.append((parts[i], parts[j]))
    return links


def _wanted(docs: DataFrame, members: DataFrame) -> DataFrame:
    """docs (mark, text) without most rows whose mark isn't a member's, by a filter of fixed size; it never drops a member."""
    place = F.pmod(F.xxhash64("mark"), F.lit(FILTER_BITS))
    of = (F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("at"))
    maps = members.select(*of).groupBy("k").agg(F.bitmap_construct_agg("at").alias("map")).collect()
    width = 1 << 12  # bytes of a bitmap
    bits = np.zeros((FILTER_BITS // (8 * width) + 2) * width, np.uint8)
    for r in maps:
        bits[r["k"] * width : (r["k"] + 1) * width] = np.frombuffer(r["map"], np.uint8)

    @F.arrow_udf(T.BooleanType())
    def may_hold(k: pa.Array, at: pa.Array) -> pa.Array:
        k, at = np.asarray(k).astype(np.int64), np.asarray(at).astype(np.int64)
        return pa.array((bits[k * width + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return docs.filter(may_hold(F.bitmap_bucket_number(place), F.bitmap_bit_position(place)))


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """node, shingles (the whole sorted set), sig (a byte of each coordinate) for members (node, mark)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(x) for x in texts_of(batch.column(1))]
            sigs = [signature(x).astype(np.uint8).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array(sigs, pa.binary())], names=["node", "shingles", "sig"])
        tidy()

    # Rows that repeat id and text come down to one before they are shuffled.
    texts = _wanted(docs.select(_mark("doc_id", "text").alias("mark"), "text"), members).dropDuplicates(["mark"])
    return texts.join(by_shuffle(members), "mark").select("node", "text").mapInArrow(run, "node long, shingles binary, sig binary")


def _with_centres(star: DataFrame, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of each edge of star (member a, centre b) whose sets are similar."""
    loads = star.join(by_shuffle(members.select(F.col("node").alias("a"), "n")), "a")
    large = loads.groupBy("b").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("units"), F.count("*").alias("times")).filter("units > 1")
    dealt = join_hot(loads, cut(large, "large"), "b", "times").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("units", F.lit(1))).alias("salt"))
    roles = dealt.select(F.col("a").alias("node"), "b", "salt", F.lit(1).alias("role")).unionByName(dealt.select(F.col("b").alias("node"), "b", "salt", F.lit(0).alias("role")).distinct())
    units = roles.join(by_shuffle(sets), "node").select("b", "salt", "role", "node", "shingles").repartition("b", "salt").sortWithinPartitions("b", "salt", "role")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = centre = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for b, salt, role, node, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(shingles, np.uint64)
                if (b, salt) != unit:
                    unit, centre = (b, salt), None
                if not role:
                    centre = own
                elif similar(centre, own, percent):
                    found.append((node, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        tidy()

    return units.mapInArrow(check, "a long, b long")


def _several(members: DataFrame) -> DataFrame:
    """group, w (shingles) of the groups with members of several parts."""
    return members.groupBy("group").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.sum("n").alias("w")).filter("lo <> hi").select("group", "w")


def _between_parts(members: DataFrame, keyed: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links a, b between parts of members (node, group, part, n; their bands: node, key) that similar sets of one group
    connect; None if every group has one part."""
    groups = cut(_several(members), "several")
    if groups.isEmpty():
        return None
    most = BLOCK_SHINGLES * (COORDINATES // rows_per_band(percent))  # a set in blocks goes to as many units as there are
    whole = members.join(by_shuffle(groups.filter(F.col("w") <= most)), "group").withColumn("group", F.concat(F.lit("g"), F.col("group").cast("string")))
    by_band = members.join(by_shuffle(groups.filter(F.col("w") > most).select("group")), "group", "left_semi").join(by_shuffle(keyed), "node")
    by_band = by_band.select("node", F.concat(F.lit("k"), F.col("key").cast("string")).alias("group"), "part", "n")
    by_band = by_band.join(_several(by_band), "group")
    open_ = cut(whole.select("node", "group", "part", "n", "w").unionByName(by_band.select("node", "group", "part", "n", "w")), "open")
    if open_.isEmpty():
        return None
    large = F.col("w") > BLOCK_SHINGLES
    small = open_.filter(~large).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("w")).first()["w"]
    bins = max(1, -(-small // BLOCK_SHINGLES))
    # Blocks of a large group: first those that small parts share, then those of each large part.
    by_part = open_.filter(large).groupBy("group", "part").agg(F.sum("n").alias("pw"))
    shared = by_part.filter(F.col("pw") <= BLOCK_SHINGLES).groupBy("group").agg(F.ceil(F.sum("pw") / BLOCK_SHINGLES).cast("int").alias("s"))
    whole = by_part.filter(F.col("pw") > BLOCK_SHINGLES).withColumn("own", F.ceil(F.col("pw") / BLOCK_SHINGLES).cast("int"))
    order = Window.partitionBy("group").orderBy("part")
    whole = whole.join(shared, "group", "left").withColumn("s", F.coalesce("s", F.lit(0)))
    whole = whole.withColumn("hi", F.col("s") + F.sum("own").over(order)).withColumn("lo", F.col("hi") - F.col("own"))
    counts = shared.join(whole.groupBy("group").agg(F.max("hi").alias("most")), "group", "full_outer").select("group", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("most", "s").alias("blocks"))
    placed = open_.join(counts, "group", "left").join(whole.select("group", "part", "lo", "hi"), ["group", "part"], "left")
    own = F.when(F.col("lo").isNotNull(), F.col("lo") + F.pmod(F.xxhash64("node"), F.col("hi") - F.col("lo"))).otherwise(F.pmod(F.xxhash64("part"), F.col("s"))).cast("int")
    placed = placed.withColumn("i", F.when(F.col("blocks").isNotNull(), own))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.col("lo").isNull() | (j < F.col("lo")) | (j >= F.col("hi")))
    pair = lambda j: F.concat_ws(":", "group", F.least(F.col("i"), j), F.greatest(F.col("i"), j))
    units = F.when(F.col("blocks").isNotNull(), F.transform(others, pair)).otherwise(F.array(F.pmod(F.xxhash64("group"), F.lit(bins)).cast("string")))
    placed = placed.select("node", "group", "part", F.coalesce("i", F.lit(0)).alias("block"), F.explode(units).alias("unit"))
    dealt = placed.join(by_shuffle(sets), "node").select("unit", "group", "part", "block", "shingles", "sig").repartition("unit").sortWithinPartitions("unit", "group")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, ([], [], [], [])

        def done() -> pa.RecordBatch:
            links = verify(*held, percent) if len(held[0]) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for unit, group, part, i, shingles, sig in zip(*(c.to_pylist() for c in batch.columns)):
                if (unit, group) != at:
                    if at is not None:
                        yield done()
                    at, held = (unit, group), ([], [], [], [])
                for k, x in enumerate((part, i, np.frombuffer(shingles, np.uint64), np.frombuffer(sig, np.uint8))):
                    held[k].append(x)
        if at is not None:
            yield done()
        tidy()

    links = cut(dealt.mapInArrow(check, "a long, b long"), "links")
    release(open_)
    return links


def _all_of(hung: DataFrame, name: str) -> DataFrame:
    """node, `name`: what components() gives, with the smallest nodes themselves."""
    roots = hung.select(F.col("component").alias("node"), "component").distinct()
    return hung.unionByName(roots).withColumnRenamed("component", name)


def _judged(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, first (doc_id and mark of the first row of its component; null without words) for each
    row of docs (doc_id, text)."""
    sketches = cut(_sketches(docs.select("doc_id", _mark("doc_id", "text").alias("mark"), "text"), rows_per_band(percent)), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    classes = sketches.filter("n_shingles > 0").groupBy("digest").agg(first, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    # 1. coarse groups
    keyed = classes.select("node", F.explode("bands").alias("key"))
    centres = keyed.groupBy("key").agg(F.min("node").alias("centre"), F.max("node").alias("other")).filter("centre <> other").select("key", "centre")
    star = cut(keyed.join(by_shuffle(centres), "key").filter("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "star")
    groups = _all_of(components(star), "group")
    members = cut(groups.join(by_shuffle(classes.select("node", "n", F.col("first.mark").alias("mark"))), "node"), "members")

    # 2. and 3. links
    sets = cut(_sets(docs, members.select("node", "mark")), "sets")
    parts = cut(_all_of(components(cut(_with_centres(star, members, sets, percent), "links")), "part"), "parts")
    apart = members.select("node", "group", "n").join(by_shuffle(parts), "node", "left").withColumn("part", F.coalesce("part", "node"))
    more = _between_parts(apart, keyed, sets, percent)

    # 4. components
    linked = parts
    if more is not None:
        joined = _all_of(components(more), "whole").withColumnRenamed("node", "part")
        alone = joined.join(by_shuffle(parts), "part", "left_anti").select(F.col("part").alias("node"), "whole")
        linked = cut(parts.join(by_shuffle(joined), "part", "left").select("node", F.coalesce("whole", "part").alias("part")).unionByName(alone.withColumnRenamed("whole", "part")), "linked")
    of = linked.join(by_shuffle(classes.select("node", "first")), "node")
    least = of.groupBy("part").agg(F.min("first").alias("least"), F.count("*").alias("times"))
    least = join_hot(linked, cut(least, "least"), "part", "times").select("node", "least")
    known = classes.join(by_shuffle(least), "node", "left").select("digest", F.coalesce("least", "first").alias("first"), "copies")
    own = sketches.select("doc_id", "mark", "n_shingles", "digest")
    with_words = join_hot(own.filter("n_shingles > 0"), cut(known, "known"), "digest", "copies")
    wordless = own.filter("n_shingles = 0").withColumn("first", F.lit(None).cast(known.schema["first"].dataType))
    release(star, sets)
    return with_words.unionByName(wordless).drop("digest")


def _cast(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text); similarity: percent / 100 or more."""
    component = F.when(F.col("n_shingles") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    out = _judged(_cast(docs), percent).select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document; similarity 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=85)


def keep_firsts(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs without all but one row of each group of near-duplicates: that with the smallest id (null ids last), of
    several with that id and different texts one by a hash of the text, of rows that repeat id and text any one. Rows
    without words link with nothing, and all of them stay."""
    judged = _judged(_cast(docs), percent)
    firsts = cut(judged.filter("n_shingles > 0 AND mark = first.mark").groupBy("mark").agg(F.count("*").alias("times")), "firsts")
    text = F.col("text").cast("string")
    rows = docs.select(row_of(docs), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(WORD), F.lit(False)).alias("worded"))
    marked = rows.filter("worded").select("row", _mark("doc_id", "text").alias("mark"))
    # A hash table of marks, each of 16 bytes and there once, so that texts are dealt out but never sorted.
    kept = marked.join(firsts.filter("times = 1").select("mark").hint("shuffle_hash"), "mark", "left_semi").select("row.*")
    repeated = firsts.filter("times > 1").select("mark")
    if not repeated.isEmpty():
        kept = kept.unionByName(marked.join(repeated, "mark", "left_semi").dropDuplicates(["mark"]).select("row.*"))
    return kept.unionByName(rows.filter("NOT worded").select("row.*"))
