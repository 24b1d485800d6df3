"""From raw documents to packed training sequences, in stages written as Parquet one after the other.

language -> near-duplicates -> repeated passages -> personal data -> packing. Every stage takes all documents that the
one before has kept, and works on whole texts. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import language, minhash, packing, pii, repeats
from churnlens.llm.catalog import VOCABULARY
from churnlens.llm.common import read
from churnlens.session import delete_scratch, scratch_path, scratch_scope

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents whose text takes so many bits a byte more than texts of its likeliest language are in none of them.
MOST_SURPRISE = 5.0
#: Words of the near-duplicate stage's shingles; the query op9_minhash has its own number.
SHINGLE_WORDS = 5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (or text), and those in no language that was learnt. Learns from documents not held out."""
    known = docs.filter(~language.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    found = language.predict(docs, language.train(known))
    return found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("surprise") <= MOST_SURPRISE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    gone = minhash.near_duplicates(docs, k=SHINGLE_WORDS).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what a document with a smaller id has too; documents of which nothing is left go."""
    cut = repeats.cut_repeats(docs, as_is=True)
    return (cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
            .withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
            .select(*docs.columns))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind of each span in its place."""
    found = pii.find(docs, pii.train(docs.select("doc_id", "text")), redact=True)
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every kept document's tokens, laid into sequences of at most 1024."""
    return packing.pack(docs, VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's own tables go when its result is stored, and its input when it has been read: two results at most are kept."""
    docs, before = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with scratch_scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        delete_scratch(spark, before)
        before = [path]
    return docs


#: The stages learn models and pack by partition: no SQL expresses them. tests/llm/ has the brute-force versions.
ORACLE_SQL = None
