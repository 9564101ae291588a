"""The metrics of symbols with new bars, kept up to date batch by batch.

A batch adds its bars to a history, by batch and symbol, then computes the metrics of just the symbols that it has and overwrites
their partitions of the result; other symbols' files stay as they are. Both writes go by the batch's number and read only
batches up to it, so a batch that runs again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.metrics import symbol_metrics
from barloom.streaming.recursive import BARS


def take(batch: DataFrame, number: int, history: str, out: str) -> None:
    """One batch; of bars that repeat a symbol's day those of the latest batch count."""
    spark = batch.sparkSession
    new = batch.filter("symbol IS NOT NULL AND ts IS NOT NULL")
    new.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(f"{history}/batch={number}")
    every = spark.read.schema(f"{BARS}, batch long").parquet(history).filter(F.col("batch") <= number)
    touched = every.filter(F.col("batch") == number).select("symbol").distinct()
    bars = every.join(touched, "symbol", "left_semi")  # by partitions of the history
    columns = ("open", "high", "low", "close", "volume")
    latest = bars.groupBy("symbol", "ts").agg(F.max_by(F.struct(*columns), "batch").alias("x")).select("symbol", "ts", *(f"x.{c}" for c in columns))
    found = symbol_metrics(latest).withColumn("of", F.col("symbol"))
    found.repartition("of").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of").parquet(out)


def refreshed(spark: SparkSession, landed: str, history: str, out: str, checkpoint: str) -> None:
    """Takes the Parquet bars that have come into ``landed`` since the last call."""
    stream = spark.readStream.schema(BARS).parquet(landed)
    stream.writeStream.foreachBatch(lambda df, n: take(df, n, history, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, out: str) -> DataFrame:
    """The metrics of all symbols, as ``symbol_metrics`` has them."""
    return spark.read.parquet(out).drop("of")
