"""A corpus pipeline of five stages, each by one operator of tallyline.llm.

Every stage takes all documents that the one before kept; between stages the documents are written as Parquet in the shared
folder and read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import cotraining, decontaminate, line_dedup, registry, sentencepiece_stream, simhash
from tallyline.llm.common import without, written

#: SQL has no classifier, XXH64 or SentencePiece; tests hold every stage against a plain version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as of low quality or toxic go."""
    verdict = cotraining.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, verdict.where("not keep"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    removed = F.col(out.columns[-1])
    return out.select(*[F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, a similarity of 0.8 or more) the document with the smallest doc_id stays; documents without an id all stay."""
    return simhash.first_of_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    found = decontaminate.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("n_hit > 0"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's SentencePiece ids, counted and summed, and its decoded text's digest."""
    return sentencepiece_stream.encoded_digest(docs, registry._path("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark), ("SentencePiece", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
    return docs
