"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but
the last return the columns of documents; further columns of docs, also such that are named
like a result, are left out. An empty table gives an empty one. Texts are read whole, however
long; rows that repeat are judged alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm import minhash_forest, relative_lz, string_kernel, toxicity_grammar, vector_packing
from twinloom.llm.common import stored, training_rows

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "word_bpe_49k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter (or with null or empty text) go.

    Where no row teaches a language (all null), nothing can be judged and every document stays.
    """
    model = string_kernel.fit(docs.where(training_rows()))
    if not model.languages:
        return docs.select(*COLUMNS)
    return string_kernel.identify(docs, model).where("lang_pred <> 'und'").select(*COLUMNS)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learned from the labelled training rows, does not call toxic.

    Null and empty texts have no clause and are scored as such.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(training_rows())
    model = toxicity_grammar.fit(docs, labels)
    return toxicity_grammar.score_toxicity(docs, model).where("predicted = 0").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest doc_id.

    Rows without a doc_id stay, and so do null and empty texts, which are near nothing; rows
    that repeat a doc_id stay or go together.
    """
    kept = minhash_forest.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    return named.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows of 20 words that start earlier; untouched texts stay as they are.

    Null texts stay null and shorter ones whole; a text that is all repeated becomes empty.
    """
    cut = relative_lz.remove_repeated_text(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokenized texts with their training sequence and offset; a null or empty text is its end id."""
    import public_tokenizers

    return vector_packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", known_language),
    ("toxicity", not_toxic),
    ("near duplicates", one_of_each),
    ("repeated text", without_repeats),
    ("packing", packed),
]

# Trained models, signatures and a tokenizer are beyond SQL; the tests follow the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
