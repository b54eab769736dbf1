"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

The trees learn from labelled urls: those that a rule fits, with the rule's verdict as label. Features: lengths, depth,
digit ratio, character entropy, parameter and label counts, and smoothed shares of blocked urls by host suffix and by
first path segment (statistics over all labelled urls). A labelled url's own shares leave out its fold, a FOLDS-th of
all hosts, so that no label is a feature of its own row. At most TRAINING_ROWS distinct labelled urls, those with the
smallest 64-bit hashes, are trained on; everything else covers all rows. Where no url is labelled, or all labels agree,
there is nothing to learn: all others get that label, "allow" without any.

A null url, or one without "://", has an empty host and path, fits no rule, and is judged by its features. Repeated
rows get equal verdicts. Urls may be of any length. Columns called as a result column are replaced; no other name of the
caller clashes with one of these. Without rows there is no result. Only SQL functions and JVM-side trees are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_hot, release, row_of, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): a host, and the start of a path.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: Labelled urls that the trees are trained on, at most.
TRAINING_ROWS = 50_000
TREES, DEPTH, SMOOTHING, FOLDS = 8, 3, 20.0, 5
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_digits", "f_entropy", "f_params", "f_labels", "f_hyphens", "f_secure", "f_suffix", "f_segment"]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, of equally long ones the first by name; or null."""
    found = F
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + start))
        found = found.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return found


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    n = F.greatest(F.length(text), F.lit(1))

    def part(c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)

    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s + part(c))


def lexical(pages: DataFrame) -> DataFrame:
    """pages with the features that need nothing but the url, and the keys of those that need statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    labels = F.split("host", r"\.")
    return pages.withColumns({
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length("host").cast("double"),
        "f_path_length": F.length("path").cast("double"),
        "f_depth": count(F.col("path"), "/[^/]"),
        "f_digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "f_entropy": entropy(url),
        "f_params": count(url, r"[?&][^?&#]"),
        "f_labels": F.size(labels).cast("double"),
        "f_hyphens": count(url, "-"),
        "f_secure": F.startswith(url, F.lit("https:")).cast("double"),
        "k_suffix": F.element_at(labels, -1),
        "k_segment": F.regexp_extract("path", "^/([^/]*)", 1),
    })


KEYS = {"k_suffix": "f_suffix", "k_segment": "f_segment"}


def _share(blocked: Column, n: Column, base: float) -> Column:
    return (blocked + SMOOTHING * base) / (n + SMOOTHING)


class Trees:
    """What was learnt from labelled (url, host, path, label: 1 for block): one label for all, or trees and shares."""

    def __init__(self, labelled: DataFrame, training_rows: int = TRAINING_ROWS):
        from pyspark.ml.classification import GBTClassifier
        from pyspark.ml.feature import VectorAssembler

        labelled = lexical(labelled).withColumn("h", F.xxhash64("url")).withColumn("fold", F.pmod(F.xxhash64("host"), F.lit(FOLDS)))
        labelled = cut(labelled.drop("url", "path"), "labelled")
        counted = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).first()
        n, blocked = counted["n"], counted["blocked"]
        self.only = None if n and blocked not in (0, n) else "block" if blocked else "allow"
        if self.only:
            return
        self.base = float((blocked + 1) / (n + 2))
        # Sums by key and fold, written once; rows of a fold get the sums of the others.
        self.sums = {k: cut(labelled.groupBy(k, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")), k) for k in KEYS}
        chosen = labelled.filter(F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53)) < min(1.0, (1.1 * training_rows + 200) / n)).dropDuplicates(["h"])
        train = cut(chosen.orderBy("h").limit(training_rows), "training")
        for key, out in KEYS.items():
            whole = self.sums[key].groupBy(key).agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
            own = self.sums[key].join(whole, key).select(key, "fold", _share(F.col("all_blocked") - F.col("blocked"), F.col("all_n") - F.col("n"), self.base).alias(out))
            train = train.join(own, [key, "fold"])
        self.pack = VectorAssembler(inputCols=FEATURES, outputCol="features")
        train = cut(self.pack.transform(train).select("features", "label"), "training")
        self.model = GBTClassifier(featuresCol="features", labelCol="label", predictionCol="block", maxIter=TREES, maxDepth=DEPTH, seed=11).fit(train.coalesce(8))
        self.model.setRawPredictionCol("raw").setProbabilityCol("p")
        release(train)

    def judge(self, rows: DataFrame) -> DataFrame:
        """rows (url, host, path, ...) with verdict and p_block."""
        from pyspark.ml.functions import vector_to_array

        if self.only:
            return rows.select("*", F.lit(self.only).alias("verdict"), F.lit(None).cast("double").alias("p_block"))
        names, rows = rows.columns, lexical(rows)
        for key, out in KEYS.items():
            share = self.sums[key].groupBy(key).agg(_share(F.sum("blocked"), F.sum("n"), self.base).alias(out), F.sum("n").alias("times"))
            rows = join_hot(rows, share, key, "times").withColumn(out, F.coalesce(out, F.lit(self.base)))
        judged = self.model.transform(self.pack.transform(rows))
        return judged.select(*names, F.when(F.col("block") == 1.0, "block").otherwise("allow").alias("verdict"), vector_to_array("p")[1].alias("p_block"))


def found_in(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """row (the row of pages), url, host, path, found (the rule that fits and its verdict, or null) for each row."""
    rows = pages.select(row_of(pages), F.col("url").cast("string").alias("url"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    return rows.withColumn("found", match(F.col("host"), F.col("path"), rules))


def labelled_in(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """url, host, path, label (1 for block) of the pages that a rule fits."""
    return found_in(pages.select("url"), rules).filter("found IS NOT NULL").select("url", "host", "path", (F.col("found.verdict") == "block").cast("double").alias("label"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """pages with host, path, rule, verdict and p_block (null where a rule decides or nothing was learnt)."""
    results = ("host", "path", "rule", "verdict", "p_block")
    pages = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in results))
    trees = Trees(labelled_in(pages, rules), training_rows)
    seen = found_in(pages, rules)
    ruled = seen.filter("found IS NOT NULL").select("row", "host", "path", "found.rule", "found.verdict", F.lit(None).cast("double").alias("p_block"))
    rest = trees.judge(seen.filter("found IS NULL").select("row", "url", "host", "path", F.lit(None).cast("string").alias("rule")))
    return ruled.unionByName(rest.drop("url")).select("row.*", *results)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every page."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "p_block")
