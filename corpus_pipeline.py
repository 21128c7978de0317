"""The corpus pipeline: documents without toxic ones and near copies, personal data masked, sources mixed, then packed.

Each stage is (name, function of (spark, docs, sf_dir)); run() applies them to the documents table in turn, each result
written as Parquet in the shared folder and read again.

All stages but the last give back rows of docs with their columns. In each of them, null and empty texts and null ids
are rows like others, texts of any length are taken whole, rows that are repeated are decided alike, further columns are
carried along whatever their names, and an empty table gives one. What that means for a stage is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quireframe.llm import pii, toxicity
from quireframe.llm.common import WRITTEN, Cut, sweep, table
from quireframe.llm.contract import tokenizer_path
from quireframe.llm.mixing import in_mixed_order
from quireframe.llm.packing import pack
from quireframe.llm.simhash import representatives


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.7, the labels being learnt from those of the documents that have one.

    Null and empty texts have the rate of labelled examples without a word; repeated rows go or stay together. A score of
    exactly 0.7 goes. Without labels of both kinds every document has the rate of the labels.
    """
    cut = Cut(spark)
    index, counted = toxicity.fit_and_count(docs, table(spark, sf_dir, "labels"), cut=cut, digests=True)
    return toxicity.clean(docs, index, counted=counted, cut=cut)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that SimHash fingerprints link: the one with the smallest doc_id, null ids last.

    Null and empty texts are one group; of rows with the same id the least fingerprint stays, of equal ones any.
    """
    return representatives(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets.

    Spans that overlap are replaced together, under the kind of the first by start, end and kind. Null texts stay null;
    n_chars is the new length.
    """
    found = Cut(spark)(pii.candidates(docs), "found")
    return pii.redact(found, pii.train(found))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order in which blocks of their sources take turns, at weights of the square root of their rows.

    Null sources are one source, null ids come first in theirs, ties are in the order of their columns' hash.
    """
    return in_mixed_order(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in windows of 1024 tokens, see pack(); null and empty texts are one piece of id 0."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a folder; what a stage has written goes once its result is there."""
    cut = Cut(spark)
    docs = table(spark, sf_dir, "documents")
    since = len(WRITTEN)
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
        sweep(spark, since, cut.paths[id(docs)])
    return docs
