"""Exactly-once upserts from a stream: rewritten agent folders, published by a ledger of batch numbers.

Layout below a folder that all machines share:
  data/agent=<a>/v=<n>   an agent's whole memories as of batch n
  ledger/batch=<n>       one small file: each agent's current v after batch n

A batch rewrites the folders of the agents that it touches and then writes its ledger file, which appears whole or not at all.
Readers take the last ledger file and read the folders it names, so they see all of a batch or nothing of it; a batch that comes
again after a failure writes the same folders anew, and one whose ledger file exists changes nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lifecycle import upsert

LEDGER = "agent string, v long, batch long"
#: Tasks and files that an agent's folder is dealt to, so that no agent is one task.
SPLITS = 8


def current(spark: SparkSession, path: str) -> tuple[int, dict[str, int]]:
    """The last batch and the version of every agent's folder; -1 and none before the first."""
    try:
        rows = spark.read.schema(LEDGER).parquet(f"{path}/ledger")
        last = rows.agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return -1, {}
        raise
    if last is None:
        return -1, {}
    return last, {r["agent"]: r["v"] for r in rows.where(F.col("batch") == last).collect()}  # one row an agent


def read(spark: SparkSession, path: str, agents: list[str] | None = None) -> DataFrame | None:
    """The memories as of the last published batch (of the agents named), by partition filters alone; none before the first."""
    _, versions = current(spark, path)
    named = [f"{a}\n{v}" for a, v in versions.items() if agents is None or a in agents]
    if not versions:
        return None
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data").withColumn("agent", F.col("agent").cast("string")).where(F.concat_ws("\n", "agent", "v").isin(named)).drop("v")


def apply_batch(path: str, batch: DataFrame, number: int, fail_before_ledger: bool = False) -> None:
    """Upsert a batch (id, agent, updated_at and the memories' columns): of several rows of an id the last one stays.

    Rows without an id or agent are left out. `fail_before_ledger` is for tests: it stops where a lost driver would.
    """
    spark = batch.sparkSession
    last, versions = current(spark, path)
    if number <= last:
        return
    rows = batch.where("id IS NOT NULL AND agent IS NOT NULL").persist()
    try:
        touched = [r["agent"] for r in rows.select("agent").distinct().collect()]  # folder names
        old = read(spark, path, touched)
        base = old.select(*rows.columns) if old is not None else rows.limit(0)
        merged = upsert(base, rows, ("agent", "id")).withColumn("v", F.lit(number).cast("long"))
        dealt = merged.repartition("agent", F.pmod(F.xxhash64("id"), F.lit(SPLITS)))
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("agent", "v").parquet(f"{path}/data")
    finally:
        rows.unpersist()
    if fail_before_ledger:
        raise RuntimeError("stopped before the ledger")
    now = versions | dict.fromkeys(touched, number)
    spark.createDataFrame(list(now.items()), "agent string, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/batch={number}")


def upserts(path: str):
    """For writeStream.foreachBatch."""
    return lambda batch, number: apply_batch(path, batch, number)
