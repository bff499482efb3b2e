"""The corpus pipeline: stages that each call one operator of scribeframe.llm on all rows the stage before kept.

Cases, in every stage: an empty table gives an empty one; null and empty texts are texts without words, which the classifier
scores like any other, line dedup leaves as they are, near-dedup links with each other (the least id stays), decontamination
keeps, and encoding gives no ids; very long texts and lines are read whole; null languages, sources and counts are carried
along; n_chars follows the text where lines went, and stays as it was elsewhere. Rows that repeat an id: of a group of near
copies all rows with its least id stay, with the lines that line dedup left in each; rows without an id take part in no
link and stay. All stages but the last return the columns of documents, in their order; they look at doc_id and text only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scribeframe.llm import lines, quality, simhash, tiling, unigram
from scribeframe.llm.kernel import table, written
from scribeframe.llm.pieces import MODEL, load


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of ``documents`` that aren't held out."""
    return quality.kept(docs, quality.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line go; n_chars follows the text."""
    from pyspark.sql import functions as F

    found = lines.deduplicated(docs)
    return found.withColumn("n_chars", F.when(F.size("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("removed_lines")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies by SimHash, as op6 has it, the document with the least id stays; of those, documents
    go whose runs of five words have a Jaccard similarity of 0.8 or more with an earlier one's, which SimHash's budget of
    four bits rarely finds."""
    return lines.first_copies(written(simhash.first_of_each(docs), "simhash"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, their number, and the text that decoding gives back."""
    found = unigram.encode(docs.select("doc_id", "text"), unigram.Encoder(load(MODEL)))
    return found.select("doc_id", "encoded.ids", "encoded.n_pieces", "encoded.decoded")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", sentencepiece_encoding),
]

#: stages with trained models can't be written in SQL; tests hold their operators, and the near-copy stage, against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
