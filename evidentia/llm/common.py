"""What several operators share: reading tables, cutting lineage, spreading work."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frees the shuffle files of a query when it ends; what cut() has written is read from the checkpoint.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_A_TASK, LEAST_ROWS_A_TASK, FEWEST_TASKS = 250_000, 20_000, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared folder. Only a local master, as in tests, gets a temporary one; elsewhere it is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="evidentia-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder, so that a lost executor costs no recomputation; free its shuffle files."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def deal(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt out by key: to the session's number of partitions, to more if rows need them, and merged to fewer if few do."""
    have, most, least = parts(df.sparkSession), -(-rows // ROWS_A_TASK), max(FEWEST_TASKS, -(-rows // LEAST_ROWS_A_TASK))
    if most > have:
        return df.repartition(most, key)
    return df.repartition(key).coalesce(least) if least < have else df.repartition(key)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    return name if name.lower() not in (c.lower() for c in df.columns) else f"{name}_{uuid4().hex[:12]}"


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(col).cast("string"))


def bounded_sample(df: DataFrame, klass: str, key: Column, per_class: int) -> DataFrame:
    """About per_class distinct keys of each class, drawn by a hash of the key: the same on every run and layout.

    Rows that repeat a key count once, so a key that holds most rows neither fills the sample nor keeps others out. Only the
    classes and their counts reach the driver; a class keeps all its keys if it has fewer than per_class.
    """
    name = unused(df, "_draw")
    df = df.where(F.col(klass).isNotNull()).withColumn(name, F.xxhash64(key, F.lit(77)))
    counts = df.select(klass, name).distinct().groupBy(klass).count().orderBy(F.desc("count"), klass).collect()
    if not counts:
        return df.limit(0).drop(name)
    draw = F.pmod(F.col(name), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for row in counts:
        keep = keep | ((F.col(klass) == F.lit(row[0])) & (draw < F.lit(min(1.0, per_class / row["count"]))))
    return df.where(keep).dropDuplicates([klass, name]).drop(name)
