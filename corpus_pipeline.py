"""The corpus pipeline: five stages of training-data operators over ``documents``.

Every stage takes what its predecessor kept, whole; all but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.llm import bpe, jaccard, mixing, pii, toxicity
from tessaline.llm.common import materialize
from tessaline.llm.queries import TOKENIZER

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier doesn't call toxic.

    It is fitted to the rows that have labels.  Null and empty texts are judged by the
    rate of such examples, repeated rows alike, and an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs.select(*COLUMNS), labels)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: five-word shingles, similarity 0.8 or more.

    The one with the smallest id (null last), then text hash, stays, once; rows
    without words stay.
    """
    classes = materialize(jaccard.jaccard_components(docs, k=5, percent=80), "pipeline-classes")
    worded = classes.filter("node is not null")
    # The least row of each component; rows of one id may be in several components.
    least = worded.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("r"), F.count("*").alias("n"))
    least = least.select(F.col("r.doc_id").alias("_id"), F.col("r.text_hash").alias("_hash"), (F.col("n") > 1).alias("_several"))
    wordless = classes.filter("node is null").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.lit(False).alias("_several")).distinct()
    rows = docs.select(*COLUMNS).withColumn("_h", F.xxhash64("text"))
    kept = rows.join(least.unionByName(wordless), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    kept = materialize(kept.select(*COLUMNS, "_h", "_several"), "pipeline-kept")
    # Rows alike in id and text: one stays.
    once = kept.filter("_several").groupBy("doc_id", "_h").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("r"))
    once = once.select("doc_id", "r.text", "r.lang", "r.source", "r.n_chars")
    return kept.filter("not _several").select(*COLUMNS).unionByName(once)


def pseudonymize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values in texts become pseudonyms; ``n_chars`` is counted anew.

    All rows stay, repeated ones too; a null text and its ``n_chars`` are null.
    """
    return pii.pseudonymize_column(docs.select(*COLUMNS), pii.session_key(spark)).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it.

    Rows alike in all columns are one row with a number, and take copies together;
    other rows take their own, whatever id they have or share.  Rows without words
    take none, a null source is a source, and an empty table stays empty.
    """
    sized = mixing.word_sizes(docs.select(*COLUMNS), keep=COLUMNS)
    told = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    sized = sized.withColumn("_row", F.concat(*(F.hex(F.xxhash64(F.lit(seed), *told)) for seed in (1, 2))))
    taken = mixing.mix(sized.select("_row", "source", "size"), id_col="_row").groupBy(F.col("doc_id").alias("_taker")).agg(F.sum("copies").cast("int").alias("_copies"))
    alike = sized.groupBy("_row").agg(F.first(F.struct(*COLUMNS)).alias("_first"))
    joined = alike.join(taken.filter("_copies > 0"), F.col("_row") == F.col("_taker"))
    return joined.select("_first.*", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of every row's ids and of the text they decode to; a null text is empty.

    Repeated rows give repeated rows, and an empty table none.
    """
    path = public_tokenizers.path(TOKENIZER)
    return bpe.digests(bpe.encode(docs, path, decoded=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("pii", pseudonymize),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]
#: Learning, transitive grouping and tokenising aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``documents`` after all stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
