"""A corpus pipeline of five stages over the table of documents.

Each stage takes (spark, docs, sf_dir), works on every row that the stage
before it kept, and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.llm import langid
from tallymart.llm.common import cut, discard
from tallymart.llm.decontaminate import decontaminate
from tallymart.llm.line_dedup import line_dedup
from tallymart.llm.minhash import minhash_dedup
from tallymart.llm.packing import best_fit_packing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: no letters, or a score under nearly all rightly predicted ones."""
    out = langid.identify(docs, docs.where(~langid.held_out()), extra=COLUMNS)
    return out.where("accepted").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but the first; every document stays with what is left of it, which may be empty."""
    out = line_dedup(docs.select(*COLUMNS), text=True, extra=["lang", "source", "n_chars"])
    changed = F.col("n_dropped") > 0
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id."""
    gone = minhash_dedup(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate(docs, items, extra=COLUMNS).where("not contaminated").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into token sequences."""
    import public_tokenizers

    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("line_dedup", drop_lines), ("near_duplicates", near_duplicates), ("decontamination", drop_leaks), ("packing", pack)]

#: SQL cannot express trained models, near-duplicate search or packing by search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Stage results are tables beside the checkpoints, which all executors share; one that the next has read is deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
