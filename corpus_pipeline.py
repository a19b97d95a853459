"""From documents to training tokens: quality, near duplicates, secrets, mixing, BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunspan.llm import bpe, jaccard, mixing, quality, secrets
from sunspan.llm._arrow import stored

TOKENIZER = "word_bpe_49k.json"
LEAST_QUALITY = 0.3
ORACLE_SQL = None  # classifiers, lexing and BPE are no SQL; tests/llm compares run() with a brute-force version


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores at LEAST_QUALITY or more; it learns outside the held-out labels.

    Null and empty texts are scored as texts without words; whole texts count, whatever their length. Rows of equal
    texts get equal scores, so repeated rows stay or go together. Without labels of both kinds all scores are equal.
    Other columns pass through, whatever their names; an empty table stays empty.
    """
    model, score = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), _free(docs, "_quality")
    return quality.score(docs, model, "text", score).where(F.col(score) >= LEAST_QUALITY).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest doc_id.

    Null and empty texts and rows without a doc_id are in no group and stay. Repeated rows of one doc_id are one
    document and stay or go together. Other columns pass through; an empty table stays empty.
    """
    found = jaccard.similar_documents(docs.select("doc_id", "text"), "doc_id", "text", k=5, percent=75)
    gone = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span that the scan finds replaced by a mark, and n_chars to match.

    Null and empty texts have no spans and stay as they are, n_chars too; whole texts are scanned. Rows are treated
    one by one, repeated ones alike. Other columns pass through; an empty table stays empty.
    """
    spans = _free(docs, "_spans")
    clean = secrets.redact(secrets.find_secrets(docs, "text", spans), "text", spans)
    return clean.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which blocks of the sources interleave to their target weights.

    The order is that of the files that are written from this, and of the rows in them. A null source is a source, a
    null doc_id an id; repeated rows stay. Other columns pass through; an empty table stays empty.
    """
    return mixing.in_mix_order(mixing.mix(docs)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, mix_file, mix_row, n_tokens and ids (packed little-endian unsigned 32-bit integers).

    (mix_file, mix_row) is the order of docs: the number of a row's file and its place in it, where docs is read from
    Parquet, since files are dealt to tasks by size; otherwise 0 and the order of partitions. A null text is empty and
    has no tokens; whole texts are coded; repeated rows stay. Other columns are left out; an empty table stays empty.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        placed = docs.select(meta.getField("file_name").alias("_file"), meta.getField("row_index").alias("mix_row"), "doc_id", "lang", "source", "text")
        placed.schema  # noqa: B018  only files have these columns
    except AnalysisException:
        placed = docs.select(F.lit("").alias("_file"), F.monotonically_increasing_id().alias("mix_row"), "doc_id", "lang", "source", "text")
    file = F.coalesce(F.regexp_extract("_file", r"^part-(\d+)", 1).try_cast("int"), F.lit(0))
    coded = bpe.encode(placed.withColumn("mix_file", file).drop("_file"), "text", public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "lang", "source", "mix_file", "mix_row", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the result is in no order but has mix_file and mix_row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs
