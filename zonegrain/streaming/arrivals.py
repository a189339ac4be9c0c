"""Samples that arrive over time, and the latest result of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_arrivals(spark: SparkSession, source: str, schema, score: Callable[[DataFrame], DataFrame], out: str, failed: str, checkpoint: str, glob: str | None = None) -> None:
    """Scores all files that the checkpoint hasn't seen and appends to out; a batch that fails is named in failed and the run goes on."""

    def one(df: DataFrame, batch: int) -> None:
        try:
            score(df).write.mode("overwrite").parquet(f"{out}/batch={batch}")
        except Exception as e:  # the run goes on with the samples that follow; the table tells what failed
            spark.createDataFrame([(batch, str(e)[:500])], "batch long, reason string").write.mode("append").parquet(failed)

    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    reader.parquet(source).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(results: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in results.columns if c not in keys]
    return results.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def deduplicated(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key within the watermark; rows later than that are dropped, and the batch table stays the truth."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
