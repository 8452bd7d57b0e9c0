"""The corpus pipeline: every stage works on all that the one before kept.

1. quality: documents that the classifier rejects go. It learns from ``labels`` and sees nothing but texts.
2. exact_dedup: of equal texts (white space apart) the row with the smallest doc_id stays.
3. near_duplicates: of each component of near duplicates the row with the smallest doc_id stays. Words are five to a
   shingle and the similarity is 0.8, the rule for near-duplicate stages.
4. decontamination: documents that are contaminated by ``benchmark`` go; others keep their whole text, so that a clean
   document that shares a phrase isn't cut.
5. sentencepiece: pieces of every text, decoded again.

``run`` applies the stages to ``documents``; each result is written as Parquet in the shared folder and read again as
the next stage's input, so that the lineage ends there. Rows without text are empty texts; rows without id pass the
stages that go by id. Rows that repeat an id and its text share one fate in every stage (ties go by doc_id). Long texts are
judged whole. Tables without rows are allowed: no documents give no rows, no labels reject nothing, no test items
contaminate nothing. Extra columns of documents, whatever their names, pass all stages but the last, which drops them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.common import Workspace, table
from strandlake.llm.exact_dedup import drop_copies
from strandlake.llm.fm_decontam import drop_contaminated
from strandlake.llm.jaccard_join import one_of_each
from strandlake.llm.quality import keep_good
from strandlake.llm.sentencepiece_viterbi import encode_decode

#: The vocabulary file of the last stage.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SHINGLE, SIMILAR = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.7."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, SHINGLE, SIMILAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces, pieces_crc32, round_trip, decoded_sha256)."""
    return encode_decode(docs, PIECES)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_duplicates", near), ("decontamination", decontaminate), ("sentencepiece", encode)]

#: A trained model and components of a graph can't be said in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = ws.put(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
