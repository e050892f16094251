"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import bpe, exact, language, minhash, mixing
from tidewell.llm.common import Sealed, materialize, release, scratch_scope
from tidewell.llm.queries import vocabulary

#: Five words to a shingle, 80 of 100 shingles shared.
SHINGLE_WORDS, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognisable language, and name the language of those that lack one.

    Dropped are texts without letters (null and empty ones too) and texts with many
    different trigrams that resemble none of the languages learned from ``docs``, as noise
    does.  A null ``lang`` becomes the predicted one; others stay.  Short texts and texts
    that repeat a few words stay, as they are no evidence.  Rows are judged one by one, so
    repeated ids and rows make no difference; extra columns are passed on.
    """
    model = language.fit(docs.select("text", "lang", F.xxhash64("doc_id", "text").alias("key")))
    sealed = Sealed(docs)
    found = language.predict(sealed.df, model, sealed.names_of("text"), {c: F.col(c) for c in sealed.columns}).where("alike")
    lang = F.coalesce(sealed["lang"], F.when(F.col("lang_pred") != "und", F.col("lang_pred")))
    return sealed.restored(found.withColumn(sealed.names_of("lang"), lang))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the smallest doc_id of equal texts; null counts as the empty text.

    Of rows that repeat both id and text one stays; a row without id stays only where no
    equal text has one.  Extra columns are passed on, whatever their names.
    """
    return exact.without_copies(docs)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates, that with the smallest doc_id.

    Texts without words are no one's duplicate.  Rows are told apart by id and text, so a
    unique text stays even under a repeated id.  Extra columns are passed on, whatever
    their names.
    """
    return minhash.without_near_copies(docs, width=SHINGLE_WORDS, percent=PERCENT)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents in the order of the mixture.

    The target weight of a source is its share of the documents, so that every stretch
    of the output holds the sources in the corpus's proportions, within a block each,
    and no document is dropped or repeated.  Files in the order of their names, read row
    by row, hold the mixture; the next stage passes that place on.
    """
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("mix_slot").sortWithinPartitions("mix_slot", "mix_row").select(*docs.columns)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with its place in the mixture.

    ``mix_file`` and ``mix_row`` are the file that a document was read from and its row
    there; ordering by both gives the mixture.  They are null if ``docs`` is no file.  A
    null text has no ids; other columns than doc_id, lang and source are not passed on.
    """
    ranks, pattern = vocabulary()
    place = {"mix_file": F.col("_metadata.file_name"), "mix_row": F.col("_metadata.row_index")}
    try:
        placed = docs.withColumns(place)
    except AnalysisException:
        placed = docs.withColumns({"mix_file": F.lit(None).cast("string"), "mix_row": F.lit(None).cast("long")})
    return bpe.tokenize(placed, ranks, pattern, keep=["doc_id", "lang", "source", *place])


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_dedup", minhash_dedup),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe),
]

#: SQL cannot express the first stage; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result but the last is written and read again.

    What a stage wrote on the way, and its predecessor's result, go once it is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch_scope(spark):
            made = stage(spark, before, sf_dir)
            docs = materialize(made, f"stage-{name}", lasting=True)
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)
