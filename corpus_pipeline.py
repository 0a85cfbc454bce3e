"""A corpus pipeline from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's documents. All but the last return the columns doc_id, text, lang,
source and n_chars. No SQL expresses the language model or the tokenizer, so ``ORACLE_SQL`` is
None and the tests hold the rows against a plain version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldobs.llm import langid, langmodel, linededup, mixing, neardup, packing
from fieldobs.llm.common import WORD, staged, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, which becomes their ``lang``; texts far from all of them or without a letter go.

    The hash of the text deals the documents in two halves. Each half is told, and its limits are
    fitted on all its labelled documents, by the languages learned from all of the other one, so no text vouches for itself or its
    copies; only a language that one half alone has is taken from there. A label stays unless
    another language is clearly nearer.
    """
    half = F.pmod(F.xxhash64(F.lit(5), F.coalesce("text", F.lit(""))), F.lit(2))
    langs, measured = langmodel.measure(docs.select(*COLUMNS), half)
    if not langs:  # nothing is labelled: any text with a letter may be in some language
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}"))).select(*COLUMNS)
    known = langmodel.tell(langs, measured, langmodel.limits(langs, measured)).where(F.col("lang_pred") != langid.UNKNOWN)
    return known.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of three lines or more that an earlier one has; those with nothing left go."""
    cleaned = linededup.dedup_lines(docs.select(*COLUMNS))
    left = (F.col("n_removed") == 0) | F.regexp_like("text", F.lit(WORD))
    return _sized(cleaned.where(left))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 80 %)."""
    return neardup.dedup(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents each source's budget takes, once per epoch, the last one cut at the budget."""
    mixed = mixing.mix(docs, keep=("text", "lang"))
    return _sized(mixing.copies(mixed))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences: doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
