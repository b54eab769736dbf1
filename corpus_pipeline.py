"""The corpus pipeline: toxicity, quality rules, near-dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir), docs as its predecessor wrote them, and works on all of them; all but the last
return the columns of documents. Rejected documents are gone for all later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, common, mixing, near_dedup, quality, toxicity
from weftgraph.llm.tokens import default_path

#: Some stages learn from what they see, so SQL can't express them; tests hold them against plain versions.
ORACLE_SQL = None


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity classifier rejects."""
    model = toxicity.train(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.scored(docs, model).filter(F.col("score") < toxicity.REJECT_AT).select("row.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return quality.keep_good(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (similarity 0.8 or more)."""
    return near_dedup.keep_firsts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as the mix takes them: parts that aren't drawn go, parts drawn again come again."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, little-endian unsigned 32-bit integers, and how many there are."""
    out = bpe.encode(docs, default_path())
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", keep_clean),
    ("quality", keep_quality),
    ("near_dedup", keep_one_of_near),
    ("mixing", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet in the shared folder and read again.

    A stage's table is deleted once the next one is written, or when a stage fails; the last one at the driver's end.
    """
    docs, written = common.table(spark, sf_dir, "documents"), []
    try:
        for name, stage in STAGES:
            path = common.owned(spark, f"pipeline-{name}")
            written.append(path)
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            for earlier in written[:-1]:
                common.delete(spark, earlier)
            written = written[-1:]
    except BaseException:
        for path in written:
            common.delete(spark, path)
        raise
    return docs
