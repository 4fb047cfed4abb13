"""A corpus pipeline of five stages; each works on what the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes as Parquet
and reads again. All but the last return the columns of ``documents``, further ones of any
name included.

Edge cases, by stage: a null or empty text and one without letters is undecided and goes in
the first stage. Line dedup counts rows of a null doc_id first, and rows of one doc_id apart
by their texts. The join goes by rows: of equal or near texts one row stays, that of the
smallest doc_id (null last), even if ids are null or repeated; rows of one id and different
texts stay both. Decontamination and encoding treat rows one by one. Very long texts pass
through every stage whole; ties are settled as each operator says; an empty table passes
through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, language_id, line_dedup, ngram_join
from lectern.llm.common import free_names, table, written

#: A prediction below this posterior is no prediction.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those whose language stays undecided."""
    lang, score = free_names(docs.columns, *language_id.NAMES)
    model = language_id.train(docs.where(~language_id.held_out(F.col("doc_id"))))
    out = language_id.identify(docs, model, names=(lang, score))
    return out.where((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated chunks of lines out of the texts; drop documents of which nothing is left."""
    names = free_names(docs.columns, *line_dedup.NAMES)
    out = line_dedup.line_dedup(docs, names=tuple(names))
    kept, changed = names[0], F.col(names[3]) > 0
    out = out.where(~F.coalesce(changed & ~F.col(kept).rlike(r"\S"), F.lit(False)))
    new = {"text": F.col(kept)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*docs.columns)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document of the smallest doc_id stays."""
    return ngram_join.keep_one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that mostly are benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and the digest columns of the texts that remain."""
    return bpe.bpe_digest(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_near_copy),
    ("benchmark decontamination", remove_benchmark),
    ("BPE encoding and decoding", encode_texts),
]

#: Language identification fits a model, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs
