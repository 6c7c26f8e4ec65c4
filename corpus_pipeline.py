"""From raw documents to packed training sequences: quality, line dedup, near duplicates, decontamination, packing.

For all stages: rows without a doc_id pass unjudged; repeated rows of a doc_id stay or go together; very long texts are
judged whole; empty tables give empty results; further columns, whatever their names, pass unchanged, and all stages but
the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loam.llm import decontaminate, line_dedup, minhash, packing, quality
from loam.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity is beyond their language's thresholds, and without null, empty or
    wordless texts. Null lang: judged by the thresholds of all languages. No trusted labels: all texts with words stay."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the later copies of passages of three or more lines in its text; of equal passages the one of
    the smallest (doc_id, line) stays. Null or empty text: unchanged; a text of copies alone becomes empty."""
    return line_dedup.dedup_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each class of near duplicates (five words, 0.8). Null, empty or
    wordless texts are like nothing and stay."""
    return minhash.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item, or all words of a shorter one. Null,
    empty or wordless texts stay; items without id or words are ignored."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their token ids and places in sequences (:func:`packing.pack`). Null or empty
    text: one piece of its end token. Rows without a doc_id and repeated rows: each packed."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("lines", line_stage), ("near_duplicates", near_stage), ("benchmark", benchmark_stage), ("packing", packing_stage)]
#: The quality model, the near-duplicate stage's classes and the token ids aren't SQL: tests/llm/test_pipeline.py holds
#: each stage and run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's rows are written as Parquet in the shared folder and read again, and those
    of the stage before are dropped then."""
    docs, work, last = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = work.put(f"{k}-{name}", stage(spark, docs, sf_dir))
        if last:
            work.drop(last)
        last = f"{k}-{name}"
    return docs
