"""From raw documents to packed training sequences: quality rules, exact and near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept.

Texts that are null count as empty; they have no words and go with the first stage.  Null languages and sources are a value like any other.  A row with
a null id is judged by its text like any row; of equal texts it stays only where no other has an id.  Repeated rows are equal texts, of which one
stays.  Texts are read whole.  Columns besides those of ``documents`` are left out, whatever their names.  An empty table gives no rows.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import exact_dedup, near_dedup, packing, pii, quality
from lumbre.storage import new_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Columns that tell the rows of a table apart.
PLACE = ("_file", "_row")


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, a file-based table, without the rows at the places in ``dropped``."""
    placed = docs.select(*COLUMNS, *exact_dedup.place())
    return placed.join(dropped, [*PLACE], "left_anti").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and are no outliers of their language and source."""
    judged = quality.judged(docs.select(*COLUMNS, *exact_dedup.place()), carry=PLACE)
    return without(docs, judged.filter("not kept").select(*PLACE))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the greatest id."""
    decided = exact_dedup.deduplicate(docs)
    return without(docs, decided.filter("not kept").select(F.col("file").alias("_file"), F.col("row").alias("_row")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the smallest id.

    Texts are distinct here, so id and digest are those of one row.
    """
    dropped = near_dedup.near_duplicates(docs).filter("not kept").select(F.col("doc_id").alias("_id"), "digest")
    keyed = docs.select(*COLUMNS, near_dedup.digest_of().alias("_digest"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("digest"))
    return keyed.join(dropped, same, "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets."""
    clean = docs.select(*COLUMNS, pii.spans_masked(pii.train(docs), F.col("text")).alias("_clean")).withColumn("text", F.col("_clean.text"))
    changed = F.when(F.col("_clean.spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    encoded = packing.token_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(packing.pieces(encoded).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]

#: SQL can express neither the estimates of the first stage nor the stages after it that depend on them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
