"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file.

Passages of a text are its windows of about each template's own length (a fourth more or less), wherever they begin
and across line breaks, and its lines of up to LONG tokens. A passage's vector has a weight tf * idf for each token,
with document frequencies counted over all files; a text goes to the template with the greatest cosine to any of its
passages, if that is LIKE or more. All licences of a text are listed too: passages of LIKE or more are taken from the
most similar on, each that overlaps none taken before and none that is a template word for word (other than itself or
one of the same words). Most passages are never scored: of each template the heaviest tokens are taken
until the rest alone couldn't reach LIKE, and a passage without any of them can't either.

All tokens are counted by one distributed aggregation; only the templates' own come to the driver. A passage of those
alone is scored where its text is read. One with other tokens is left open, unless even the least weight for them
leaves it short of LIKE or of a better passage; open passages meet the frequencies of their tokens by a join.

A file is a licence file if its name says so (LICENSE, COPYING, NOTICE) or if the licence passage makes up a fourth of
its words. A file with a passage of its own has that licence; another one inherits from the nearest directory upwards
that holds a licence file, of several there from the first by path. Ancestors are listed for each directory, not for
each file, and met by joins on paths.

Null and empty texts have no passage; null paths inherit nothing; repeated rows get equal results; of equally like
templates the first one counts; other columns pass through, those called as a result column are replaced, and no other
name clashes. Without rows there is no result.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, join_hot, row_of, small_batches, span_hashes, table, texts_of, tidy, word_spans

#: Notices as they stand in headers and licence files.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007"],
    "GPL-2.0": ["This program is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal"],
    "proprietary": ["All rights reserved"],
}
LIKE, LONG, FILE_SHARE = 0.75, 64, 0.25
#: Distinct tokens of files that a task holds before it passes their counts on.
HELD = 1 << 20
FILE_NAME = re.compile(r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$")
_TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+")
_OUTSIDE = np.ones(256, dtype=bool)
_OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(raw: bytes) -> list[bytes]:
    return _TOKEN.findall(raw.lower())


def _hash(token: bytes) -> int:
    b = np.frombuffer(token, np.uint8)
    return int(span_hashes(b, np.array([0]), np.array([len(b)]))[0])


def lengths(n: int) -> range:
    """Lengths of the windows that are held against a template of n tokens."""
    return range(n - n // 4, n + n // 4 + 1)


class Matcher:
    """Template vectors under given document frequencies."""

    def __init__(self, frequencies: dict[bytes, int], n_files: int, templates: dict[str, list[str]] = TEMPLATES, like: float = LIKE):
        self.like, self.n = like, n_files
        self.idf = {t: math.log((n_files + 1) / (f + 1)) + 1 for t, f in frequencies.items()}
        self.unseen = math.log(n_files + 1) + 1
        whole = [(name, tokens(text.encode())) for name in templates for text in templates[name]]
        self.templates = [(name, self.vector(found)) for name, found in whole]
        self.lengths = [lengths(len(found)) for _, found in whole]
        words = sorted({t for _, vector in self.templates for t in vector}, key=_hash)
        self.hashes = np.array([_hash(t) for t in words], np.uint64)
        self.number = {t: i for i, t in enumerate(words)}
        self.weights = [self.idf.get(t, self.unseen) for t in words]
        self.rows = [{self.number[t]: w for t, w in vector.items()} for _, vector in self.templates]
        #: Squared weights of each template by number of token; the last one is that of tokens of no template.
        self.squares = np.zeros((len(whole), len(words) + 1))
        self.telling = np.zeros((len(whole), len(words) + 1), bool)
        for k, row in enumerate(self.rows):
            rest = 1.0
            for i, weight in sorted(row.items(), key=lambda x: (-x[1], words[x[0]])):
                self.squares[k, i] = weight * weight
                self.telling[k, i] = rest >= like * like - 1e-9
                rest -= weight * weight
        self.any_telling = self.telling.any(axis=0)

    def vector(self, passage: list[bytes]) -> dict[bytes, float]:
        weights = {t: n * self.idf.get(t, self.unseen) for t, n in Counter(passage).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def likeness(self, numbers: list[int], k: int) -> tuple[float, float, int]:
        """Dot product with the k-th template, squared norm of the templates' tokens, and how many other ones there are."""
        times = Counter(numbers)
        others = times.pop(-1, 0)
        row, dot, norm = self.rows[k], 0.0, 0.0
        for i, n in times.items():
            w = n * self.weights[i]
            dot += w * row.get(i, 0.0)
            norm += w * w
        return dot, norm, others

    def cosine(self, dot: float, norm: float, others: Iterable[bytes | int], counts: dict[int, int] | None = None, each: float | None = None) -> float:
        """Of a passage with these other tokens; counts: in how many files each is, else as known or in none; each: weight of all."""
        counts = counts or {}
        weight = lambda t: math.log((self.n + 1) / (counts[t] + 1)) + 1 if t in counts else self.idf.get(t, self.unseen)
        norm += sum((n * (weight(t) if each is None else each)) ** 2 for t, n in sorted(Counter(others).items()))
        return round(dot / math.sqrt(norm), 9) if norm else 0.0

    def best(self, passage: list[bytes]) -> tuple[float, int]:
        """Cosine and number of the template most similar to a line or a window of it, of equal ones the first."""
        numbers, n = [self.number.get(t, -1) for t in passage], len(passage)
        found = [(0.0, 0)]
        for k, sizes in enumerate(self.lengths):
            for first, last in {(0, n), *((f, f + size) for size in sizes for f in range(n - size + 1))}:
                dot, norm, _ = self.likeness(numbers[first:last], k)
                found.append((self.cosine(dot, norm, [t for t in passage[first:last] if t not in self.number]), -k))
        cosine, k = max(found)
        return cosine, -k

    def passages(self, raw: bytes) -> tuple[int, list[tuple[int, int, int, float, float, tuple[int, ...]]]]:
        """Tokens of a text; number of template, first token, tokens, dot product, squared norm and hashes of other tokens
        of each passage that reaches the threshold if its other tokens are as light as can be (in all files: a weight of
        1) and that doesn't overlap a passage of words of a template alone, in its weights."""
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            return 0, []
        start, end = word_spans(b, _OUTSIDE)
        hashes = span_hashes(_LOWER[b], start, end)
        n = len(hashes)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        numbers = np.where(self.hashes[at] == hashes, at, -1)
        places = np.flatnonzero(self.any_telling[numbers])
        if not len(places):
            return n, []
        line = np.searchsorted(np.flatnonzero(b == 10), start)
        spans = np.unique(line[places])
        spans = list(zip(np.searchsorted(line, spans).tolist(), np.searchsorted(line, spans, side="right").tolist()))
        found: list[tuple] = []
        for k, sizes in enumerate(self.lengths):
            hits = places[self.telling[k, numbers[places]]]
            if not len(hits):
                continue
            total = np.concatenate([[0.0], np.cumsum(self.squares[k, numbers])])
            reach, least = sizes[-1], self.like * self.like - 1e-9
            near = hits[total[np.minimum(hits + reach, n)] - total[np.maximum(hits - reach + 1, 0)] >= least]
            tried = {(f, z) for f, z in spans if z - f <= LONG and total[z] - total[f] >= least}
            for hit in near.tolist():
                tried.update((f, f + size) for size in sizes for f in range(max(0, hit - size + 1), min(hit, n - size) + 1) if total[f + size] - total[f] >= least)
            for first, last in sorted(tried):
                dot, norm, others = self.likeness(numbers[first:last].tolist(), k)
                if dot > 0 and dot >= (self.like - 1e-9) * math.sqrt(norm + others):
                    found.append((k, first, last - first, dot, norm, tuple(sorted(hashes[first:last][numbers[first:last] < 0].tolist()))))
        same = [(f, f + size) for _, f, size, dot, norm, others in found if not others and self.cosine(dot, norm, ()) >= 1]
        covered = np.zeros(n + 1, np.int64)
        for first, last in same:
            covered[first] += 1
            covered[last] -= 1
        covered = np.concatenate([[0], np.cumsum(np.cumsum(covered) > 0)])
        exact = set(same)
        return n, [p for p in found if (p[1], p[1] + p[2]) in exact or covered[p[1] + p[2]] == covered[p[1]]]

    def decide(self, passages: Iterable[tuple], counts: dict[int, int] | None = None) -> tuple[list[str], str | None, float, int]:
        """All licences by name, and licence, cosine and tokens of the best passage; ([], None, 0, 0) without one."""
        scored = sorted((-self.cosine(dot, norm, others, counts), k, first, size) for k, first, size, dot, norm, others in passages)
        taken: list[tuple[float, int, int, int]] = []
        for x in scored:
            if -x[0] >= self.like and all(x[2] >= t[2] + t[3] or t[2] >= x[2] + x[3] for t in taken if t[2] - x[3] < x[2] < t[2] + t[3]):
                taken.append(x)
        if not taken:
            return [], None, 0.0, 0
        cosine, k, _, size = taken[0]
        return sorted({self.templates[x[1]][0] for x in taken}), self.templates[k][0], -cosine, size

    def scan(self, raw: bytes) -> tuple[str | None, float, int]:
        """Licence, cosine and tokens of the best passage of a text."""
        return self.decide(self.passages(raw)[1])[1:]


def document_frequencies(files: DataFrame) -> DataFrame:
    """k, n: in how many files each token, by its hash, occurs; k is null for the number of all files."""
    small_batches(files.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def done() -> pa.RecordBatch:
            seen, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(times.astype(np.int64))], names=["k", "n"])

        for batch in batches:
            for raw in texts_of(batch.column(0)):
                b = np.frombuffer(raw, np.uint8)
                n += 1
                if len(b):
                    held.append(np.unique(span_hashes(_LOWER[b], *word_spans(b, _OUTSIDE))))
                    size += len(held[-1])
                if size > HELD:
                    yield done()
                    held, size = [], 0
        if held:
            yield done()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["k", "n"])
        tidy()

    found = files.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "k long, n long")
    return cut(found.groupBy("k").agg(F.sum("n").alias("n")), "frequencies")


def of_templates(counted: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many of all files each token of the templates occurs, and how many files there are."""
    known = {t: int(np.uint64(_hash(t)).view(np.int64)) for texts in TEMPLATES.values() for text in texts for t in tokens(text.encode())}
    found = {r["k"]: r["n"] for r in counted.filter(F.col("k").isNull() | F.col("k").isin(sorted(known.values()))).collect()}
    return {t: found.get(k, 0) for t, k in known.items()}, found.get(None, 0)


def frequencies(files: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many of all files each token of the templates occurs, and how many files there are."""
    return of_templates(document_frequencies(files))


_FOUND = "licences array<string>, own_licence string, similarity double, _size int"


def scan(files: DataFrame) -> DataFrame:
    """files (path, text, ...) with licences (all in the text), own_licence (the best), similarity, is_licence_file, licence
    and inherited_from in place of text."""
    counted = document_frequencies(files)
    matcher = Matcher(*of_templates(counted))
    outs = ("text", "licences", "own_licence", "similarity", "is_licence_file", "licence", "inherited_from")
    rows = files.select(row_of(files.select(*(F.col(f"`{c}`") for c in files.columns if c not in outs))), F.col("text").cast("string").alias("text"))
    more = T._parse_datatype_string(_FOUND + ", _words int, _key binary, _open binary, _others array<bigint>").fields
    schema = T.StructType([rows.schema["row"], *more])
    kinds = [to_arrow_type(f.dataType) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in texts_of(batch.column(1)):
                n, found = matcher.passages(bytes(raw))
                others = sorted({t for p in found for t in p[5]})
                # Places from the first passage on, so that like passages anywhere are settled once.
                at = min((p[1] for p in found), default=0)
                packed = json.dumps(sorted((p[0], p[1] - at, *p[2:]) for p in found)).encode() if others else None
                sure = (None, None, None, None) if others else matcher.decide(found)
                rows.append((*sure, n, packed and hashlib.blake2b(packed, digest_size=16).digest(), packed, np.array(others, np.uint64).view(np.int64).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=schema.names)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for packed, known in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                counts = {r["k"] % (1 << 64): r["n"] for r in known}
                rows.append(matcher.decide(json.loads(packed), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=["_key", "licences", "own_licence", "similarity", "_size"])

    own = cut(rows.mapInArrow(run, schema), "passages")
    # Files with one text, or with like passages, share a key: each is settled once.
    open_ = own.filter("_key IS NOT NULL").groupBy("_key").agg(F.first("_open").alias("_open"), F.first("_others").alias("_others"))
    asked = open_.select("_key", F.explode("_others").alias("k"))
    wanted = counted.join(asked.select("k").distinct(), "k", "left_semi")
    known = asked.join(wanted, "k").groupBy("_key").agg(F.collect_list(F.struct("k", "n")).alias("_known"))
    settled = cut(open_.select("_key", "_open").join(known, "_key").mapInArrow(settle, "_key binary, " + _FOUND), "settled")
    sure = own.filter("_key IS NULL").select("row", "licences", "own_licence", "similarity", "_size", "_words")
    later = own.filter("_key IS NOT NULL").select("row", "_words", "_key").join(settled, "_key").select(*sure.columns)
    both = sure.unionByName(later).withColumn("path", F.col("row.path").cast("string"))
    named = F.regexp_replace(F.coalesce("path", F.lit("")), "^(?s:.*)/", "").rlike(FILE_NAME.pattern)
    kind = F.col("own_licence").isNotNull() & (named | (F.col("_size") >= FILE_SHARE * F.col("_words")))
    out = inherit(both.select("row", "path", "licences", "own_licence", "similarity", kind.alias("is_licence_file")))
    return out.select("row.*", "licences", "own_licence", "similarity", "is_licence_file", "licence", "inherited_from")


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned (path, own_licence, is_licence_file, ...) with licence and inherited_from (a directory, null if its own)."""
    rows = scanned.select(row_of(scanned), F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    holders = scanned.filter("is_licence_file AND path IS NOT NULL").groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("up")).agg(F.min_by("own_licence", "path").alias("theirs"))
    parts = F.split("folder", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    folders = cut(rows.filter("folder IS NOT NULL").groupBy("folder").agg(F.count("*").alias("times")), "folders")
    above = folders.select("folder", F.posexplode(up).alias("depth", "up"))
    # A directory near the root is above very many others, and one directory may hold very many files.
    held = holders.join(above.groupBy("up").agg(F.count("*").alias("met")), "up")
    met = join_hot(above, cut(held, "held"), "up", "met").filter("theirs IS NOT NULL")
    nearest = met.groupBy("folder").agg(F.max(F.struct("depth", "up", "theirs")).alias("source")).join(folders, "folder")
    out = join_hot(rows, cut(nearest, "nearest"), "folder", "times")
    own = F.col("row.own_licence")
    return out.select("row.*", F.coalesce(own, F.col("source.theirs")).alias("licence"), F.when(own.isNull(), F.col("source.up")).alias("inherited_from"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, own_licence, similarity, is_licence_file, licence, inherited_from for every document.

    Documents have no paths, so each stands in a tree by source and language, in folders of a thousand ids.
    """
    path = F.concat_ws("/", F.lit(""), "source", F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 1000).cast("string")), F.col("doc_id").cast("string"))
    return scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))
