"""An index that grows with a stream of passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from wikiloom.operators import dense


def stream_passages(spark: SparkSession, folder: str, schema: str = "pid long, passage string, wid long, wiki string, split string, loaded_at timestamp") -> DataFrame:
    """scope, pid, text of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder).selectExpr("wiki as scope", "pid", "passage as text", "loaded_at")


def grow(passages: DataFrame, index: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's unseen passages to the index at `index`, however late they load; a replayed batch adds nothing.

    Repeats are dropped within the batch and by the anti-join with the index, so the stream keeps no state.
    """
    rows = passages.where("text is not null and trim(text) <> ''")
    return rows.writeStream.foreachBatch(lambda df, _: dense.append(df.select("scope", "pid", "text"), index) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(passages: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Passages by wiki and window of arrival."""
    from pyspark.sql import functions as F

    return passages.withWatermark("loaded_at", late).groupBy(F.window("loaded_at", window), "scope").agg(F.count("*").alias("n"))
