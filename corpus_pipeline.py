"""From documents to packed windows: toxicity, repeated lines, near-duplicate documents, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return
the columns of documents. ``run`` writes each stage's result to the shared checkpoint folder and
reads it again for the next one, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.llm import jaccard, lines, packing, passages, toxicity
from hindsight.llm.common import stored, table


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` as the text now has."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the classifier learns from the labelled documents among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, tuple(docs.columns))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that have stood, within one word or one character, at an earlier place."""
    return _counted(lines.dedup_lines(docs, min_chars=lines.MIN_CHARS).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group tied by a similarity of 0.8 of five-word shingles."""
    return jaccard.one_of_each(docs, shingle=5, percent=80)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages of 50 words or more that an earlier one holds at a similarity of 0.8."""
    return _counted(passages.drop_repeats(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Trained scores, approximate search and tokenizers have no SQL form; tests hold the line stage and the kept rows of small tables to what they should be, not the whole run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
