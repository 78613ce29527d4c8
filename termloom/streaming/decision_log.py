"""A growing decision log as a stream: guard as lines come, latest decision per pair kept by upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.verify import Guard, guarded
from ..sources.files import LOG


def tail(spark: SparkSession, path: str, schema=LOG, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files_at_once).json(path)


def decisions(log: DataFrame, guard: Guard = Guard(), late: str = "1 hour") -> DataFrame:
    """Guarded log lines, each replay of (pair_id, prompt_hash) once within the watermark."""
    x = log.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp())).withWatermark("timestamp", late)
    return guarded(x.dropDuplicatesWithinWatermark(["pair_id", "prompt_hash"]), "response", guard)


def hourly(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Decisions per hour and label, final once the watermark has passed."""
    x = log.withWatermark("timestamp", late)
    return x.groupBy(F.window("timestamp", "1 hour"), "decision").agg(F.count(F.lit(1)).alias("n"), F.sum("cost_usd").alias("cost"))


def keep_latest(stream: DataFrame, table: str, checkpoint: str):
    """Writes each batch's last line per pair under table/batch=<id>; a batch that runs again replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        at = F.row_number().over(W.partitionBy("pair_id").orderBy(F.desc("timestamp"), F.desc("prompt_hash")))
        batch.withColumn("_at", at).where("_at = 1").drop("_at").write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """One row per pair over all batches: that of the latest timestamp, of equal ones that of the last batch."""
    x = spark.read.parquet(table)
    at = F.row_number().over(W.partitionBy("pair_id").orderBy(F.desc("timestamp"), F.desc("batch")))
    return x.withColumn("_at", at).where("_at = 1").drop("_at")
