"""Micro-batch sink of sightings: appends the log and keeps anomalies once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.streaming import effects


def observation_rows(sightings: DataFrame) -> DataFrame:
    """Sightings with the hash of their release text, as they are logged."""
    return sightings.withColumn("release_text_hash", F.sha1(F.coalesce("release_text", F.lit("")))).drop("release_text")


def new_anomalies(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Anomalies without an equal open one in the store; repeated ones of a batch count once."""
    keys = ["release_id", "anomaly_type", "old_value", "new_value"]
    return found.dropDuplicates(keys).join(stored.filter("status = 'open'").select(*keys), keys, "left_anti").withColumn("status", F.lit("open"))


def append_sink(sightings: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends every sighting to the Parquet log once."""
    return observation_rows(sightings).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def cycles(source: DataFrame, cycle, checkpoint: str, folder: str, seconds: int | None = 60, key: str = "event_key"):
    """Starts a query that calls cycle(rows, number) for each micro-batch, one after the other, over a ledger in folder.

    A cycle starts every so many seconds, or with None once for all that has arrived. The rows of a cycle that raises are
    written down as failed and come again with those of the next one, so none is lost and the query goes on; see effects.
    """

    def effect(rows: DataFrame, number: int) -> DataFrame:
        cycle(rows, number)
        return rows.select(key, F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))

    return effects.deliver(source, folder, checkpoint, effect, key, seconds)
