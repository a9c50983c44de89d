"""A cleaning pipeline over ``documents``: each stage reads what the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import decontamination, jaccard, packing, substrings, toxicity
from lumbre.llm.queries import held_out, tokenizer_path
from lumbre.session import configure, cut_lineage, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not likely toxic, judged as ``op2_toxicity`` does."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.below(docs, model, 0.7)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that occur more than once; texts that lose nothing stay as they are."""
    columns = docs.columns
    kept = substrings.mark_repeats(docs.select(F.struct(*columns).alias("row"), "doc_id", "text"))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    count = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return kept.select(*[{"text": text, "n_chars": count}.get(c, F.col(f"row.{c}")).alias(c) for c in columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    pieces = packing.pack(docs, tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def _set_up(stage):
    """The stage with the session's settings applied, as it may be called alone."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(configure(spark), docs, sf_dir)
    return run_stage


STAGES = [(name, _set_up(stage)) for name, stage in (
    ("toxicity", without_toxic), ("near duplicates", without_near_duplicates), ("substring dedup", without_repeats), ("benchmark decontamination", without_benchmark), ("packing", packed))]

#: packing and the learnt stages have no SQL; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
