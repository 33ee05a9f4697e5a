"""The training-corpus pipeline: stages over documents, each written and read again.

quality classifier -> MinHash near-dedup -> substring dedup -> source mixing -> BPE. Every
stage but the last returns the columns of documents. The first learns from labels; the others
see only what the stage before kept.

Defined results, in every stage: columns other than doc_id, text, source and n_chars pass through
whatever their names; an empty table gives an empty table; a very long text is read whole, and a
task holds one at a time. What each stage does with nulls, empty texts, ties and repeated rows is in
its own docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import bpe, mixing, near_dedup, quality_classifier, substring_dedup
from scriptorium.llm.words import free_name, plain
from scriptorium.session import Scratch, materialise, table

#: Words of a passage that may not repeat across documents.
PASSAGE_WORDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones.

    A null or empty text scores the share of good labels. Repeated rows are judged alike and
    rows without an id like any other; a score of exactly one half stays."""
    model = quality_classifier.learned(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs.columns, "score")
    return quality_classifier.score(docs, model, "text", name).where(F.col(name) >= 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8).

    Rows get numbers of their own, so they are not told apart by the id: of copies under one id one
    stays, different texts under one id are different documents, and rows without an id are judged like
    any other. Of a group the row with the smallest id stays (rows without an id come last), and of
    rows with one id that with the smallest digest of its text. Null, empty and blank texts are no
    copies of anything and stay."""
    own, at = plain(docs)
    rows = materialise(own.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    groups = near_dedup.near_duplicates(rows, "_row", at["text"]).select("id", "component_id")
    order = F.struct(F.col(at["doc_id"]).isNull().alias("last"), F.col(at["doc_id"]).alias("of"), F.xxhash64(at["text"]).alias("digest"), "_row")
    placed = groups.join(rows.select(F.col("_row").alias("id"), order.alias("order")), "id")
    kept = placed.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col("first._row").alias("_kept"))
    return rows.join(kept, F.col("_row") == F.col("_kept"), "left_semi").select(*own.columns).toDF(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document already has.

    Null, empty and short texts stay as they are. Earlier is by id and then by the text's digest;
    rows without an id come last. Of equal rows the first keeps its words; different texts under
    one id are different documents. A text of which nothing is left stays, empty."""
    cut = substring_dedup.dedup_columns(docs, "doc_id", "text", PASSAGE_WORDS)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cut


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own. Rows without words (null and empty texts) weigh nothing
    and are taken as far as their place in the permutation is reached. Repeated rows, and rows
    without an id, are rows like any other, each with its own number of copies."""
    return mixing.mixed_rows(docs, "doc_id", "source", "text")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text encodes as an empty
    one, repeated rows are encoded each, and a null doc_id stays null."""
    return bpe.digests(docs, "doc_id", "text")


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: Votes of neighbours and BPE have no SQL; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = kept.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        kept.drop(keep=(name.replace(" ", "-"),))  # what the stage before wrote
    return STAGES[-1][1](spark, docs, sf_dir)
