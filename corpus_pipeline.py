"""Documents to packed training bins: language ID, toxicity, near-duplicate removal, secret redaction, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import common, language, neardup, packing, secrets, toxicity


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language: no letter, or letters in no known language.

    Learns from the documents' labels, and what no language is from the same texts with their bytes in random order.
    """
    model = language.fit(docs, reject=True)
    return docs.where(~language.rejected(F.col("text"), language.predictor(spark, model)(F.col("text")))) if model else docs.limit(0)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.where(toxicity.scorer(spark, model)(F.col("text")) < 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8): the one of smallest id.

    Rows repeated with id and text are one document. Of a group without any id, the text of smallest hash stays.
    """
    found = neardup.near_duplicates(docs)
    i, h = common.unused(docs, "_id"), common.unused(docs, "_hash")
    kept = found.where("first").select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    rows = docs.withColumn(h, F.xxhash64("text"))
    if not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id", h])
    return rows.join(kept, rows["doc_id"].eqNullSafe(kept[i]) & (rows[h] == kept[h]), "left_semi").select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secret values in the texts; keeps every document, with n_chars of the new text."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their bins."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_stage),
    ("toxicity", toxicity_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared checkpoint folder, read again, and then deleted."""
    docs = common.table(spark, sf_dir, "documents")
    common.ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:  # what the stage before has kept
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n - 1}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return docs
