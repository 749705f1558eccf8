"""Corpus pipeline: from raw documents to packed sequences.

Five stages, each one operator of plumbline.llm; each is written as Parquet and the next one
reads it. All but the last return the columns of documents.

1. quality classifier: documents it rejects go (labels come from the labels table).
2. line dedup: lines of repeated three-line windows are cut out of the texts. A text that
   loses all its lines stays as an empty one.
3. SimHash near-dedup: one document of each group of near-duplicates stays, the one of the
   smallest doc_id. Near means op8's four bits: most pairs of a five-word similarity of 0.8 to
   under 1 stay (README).
4. mixing: of each leaf of the domain-language-source tree the documents of a token prefix of
   a seeded epoch, up to the leaf's budget. One epoch, so none is repeated; BUDGET is the
   share of all tokens aimed at. A document at the border of a prefix is kept whole.
5. best-fit packing: the texts' tokens in sequences.

Nulls, ties and repeated rows: null and empty texts have no word, so the first stage rejects them. Rows
that share a doc_id are documents of their own; of fully equal rows the near-dedup keeps one, and of rows
without a doc_id all. Ties go to the smaller doc_id, then to the smaller hash of the text. Empty tables
give empty stages. Columns beyond those of documents pass through, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import line_dedup, mixing, packing, quality_classifier, queries, simhash
from plumbline.llm.common import run_folder, settle, table
from plumbline.ship import ship

BUDGET = 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_classifier.kept_documents(docs, table(spark, sf_dir, "labels"), *queries.site())


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    sizes = settle(queries.tree(docs), "sizes")
    leaves = mixing.plan(mixing.leaves_of(sizes), F.col("all_tokens") * BUDGET, queries.weights(spark), max_epochs=1)
    return mixing.chosen(docs, mixing.mixed(sizes, leaves))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("simhash near-dedup", near_duplicates),
    ("mixing", mixture),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # tokenizing and fingerprints are beyond SQL; tests/llm/test_pipeline_brute.py compares run() with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the whole of documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        found = stage(spark, docs, sf_dir)
        found.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.schema(found.schema).parquet(f"{folder}/stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
