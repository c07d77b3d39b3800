"""A corpus from raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on every row it is given and returns a DataFrame; it is
written to files and read again before the next one. All stages but the last return the columns of documents;
columns beyond those of ``COLUMNS`` come out as they went in, whatever their names. Each stage is defined for nulls in
any column, empty, blank and very long texts, repeated rows and ids, and an empty table, as its operator
states; what a stage itself decides is stated below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallybook.llm import language, lines, mixing, packing, simhash
from tallybook.llm.common import staged, table
from tallybook.llm.queries import tokenizer_path

LEAST_SHARE = 0.3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def aside(docs: DataFrame) -> DataFrame:
    """The documents with their other columns under names that no operator uses."""
    return docs.toDF(*[c if c in COLUMNS else f"_other_{n}" for n, c in enumerate(docs.columns)])


def back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order and by their names."""
    return found.select(*aside(docs).columns).toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Set ``lang`` to the language found. Texts without letters go, null and empty ones among them, and those
    of which less than LEAST_SHARE of the n-grams belong to the best language, unless nothing could be
    learned. Repeated rows share their fate."""
    rows = aside(docs)
    model = language.learn(rows)
    judged = language.predict(rows, model)
    good = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    if not model.languages:
        good = language.has_letter(F.col("text"))
    return back(judged.where(good).withColumn("lang", F.col("lang_pred")), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least 10 documents share are gone from all of them. Every row stays, null text as ''."""
    return back(lines.dedup_lines(aside(docs)), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id; one without where none has an id. Texts
    without words are one group."""
    return back(simhash.one_of_each(aside(docs)), docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: none, part, once or twice. Those without words are not taken."""
    return back(mixing.mixed_documents(aside(docs)), docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their place."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


# Signatures, token ids and drawn blocks are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None
