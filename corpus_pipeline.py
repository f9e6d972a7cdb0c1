"""The corpus pipeline: toxicity, near duplicates, repeated passages, source mix and packing, in this order.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pavescope.llm import jaccard_join, mixing, packing, substring_dedup, text, toxicity

#: Near duplicates of the corpus: five-word shingles, similarity of 0.8 or more.
SHINGLE, LEAST = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score reaches the threshold.

    Null texts are scored as empty ones, rows that repeat are scored alike and all stay or go, an empty table stays empty,
    and all columns stay, whatever their names. Whole texts go to Python in small batches, here and in training, so the
    rows are written inside.
    """
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    with text.text_batches(spark):
        model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
        return text.written(toxicity.scored(docs, model, name).where(F.col(name) < toxicity.THRESHOLD).drop(name), "pipeline-clean")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, the one with the least doc_id."""
    return jaccard_join.representatives(docs, SHINGLE, LEAST)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that stand earlier in the corpus; documents that had nothing else go."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    out = substring_dedup.substring_dedup(docs, carried=others).where("n_removed < n_words OR n_words = 0")
    changed = F.col("n_removed") > 0
    columns = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")} | {c: F.col("carried")[c] for c in others}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(columns["n_chars"])
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with each source at its target share of words."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Buckets, batches and slots of the documents left."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("passages", cut_passages), ("mix", mix_sources), ("packing", pack)]

#: The stages hold learned models, automata and hash orders: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = text.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
