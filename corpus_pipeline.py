"""From raw documents to packed training batches: quality, language, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streetflow.llm import buckets, chosen_path, language, pu
from streetflow.llm.common import Scratch
from streetflow.llm.queries import count_tokens

#: SQL can express neither the fitted models nor the optimal buckets.
ORACLE_SQL = None
#: Documents below this score are rejected.
QUALITY = 0.3
#: Rows that go to a Python worker at once; the session's own setting holds if it is smaller.
BATCH_ROWS = 1_000


def _bounded(spark: SparkSession) -> None:
    """Keeps the texts that a Python worker and the executor beside it hold at a time to a few megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(name))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``docs``."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _rows(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``docs`` with a number per row, so that rows of one doc_id are told apart, and that column's name.

    Written once: a number computed anew in another job need not be the same, as files may be dealt to tasks otherwise.
    """
    row = _free(docs, "_row")
    return Scratch(docs.sparkSession, label).keep(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def _without(rows: DataFrame, row: str, rejected: DataFrame, label: str) -> DataFrame:
    """``rows`` less the numbers in ``rejected``, which are written first so that their size is known, and without them."""
    gone = Scratch(rows.sparkSession, label).keep(rejected)
    return rows.join(gone, row, "left_anti").drop(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: rejects texts of low score. Null and empty texts are judged like any text, repeated rows each."""
    _bounded(spark)
    labels, score = spark.read.parquet(f"{sf_dir}/labels.parquet"), _free(docs, "_score")
    return pu.with_score(docs, pu.train(docs, labels), score).where(F.col(score) >= QUALITY).drop(score)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: rejects texts without letters, null and empty ones among them, and those whose language stays open
    after all evidence. Repeated rows are judged each; null languages and sources are no evidence."""
    _bounded(spark)
    rows, row = _rows(docs, "language-rows")
    seen = language.identify(language.with_evidence(rows, row, F.col("text"), F.col("lang"), F.col("source")))
    return _without(rows, row, seen.where(~F.col("kept")).select(F.col("id").alias(row)), "language")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: one row of each group of near-duplicates stays, that of the smallest doc_id; ties go to the first.

    Null texts and texts without a word are linked with nothing and stay; a null doc_id comes before all others.
    """
    _bounded(spark)
    rows, row = _rows(docs, "near-duplicates-rows")
    seen = chosen_path.near_duplicates(rows.select(F.struct("doc_id", F.col(row).alias("row")).alias("doc_id"), "text"))
    return _without(rows, row, seen.where(~F.col("kept")).select(F.col("doc_id.row").alias(row)), "near-duplicates")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: a bucket, batch and slot for every row, by its real tokens; null and empty texts have none."""
    _bounded(spark)
    return buckets.pack(count_tokens(docs), F.col("n_tokens"))


STAGES = [("quality", quality), ("language_id", language_id), ("near_duplicates", near_duplicates), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and reread before the next."""
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
