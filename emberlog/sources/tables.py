"""Events, error reports and queues from tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT, REPORT


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pushed(spark: SparkSession, rows: list[dict], reports: bool = False) -> DataFrame:
    """A table of events (or error reports) given as dicts; ``seq`` is their order."""
    schema = REPORT if reports else EVENT
    return spark.createDataFrame([{"seq": i, **r} for i, r in enumerate(rows)], schema)


def nothing(spark: SparkSession, reports: bool = False) -> DataFrame:
    """The source of a client that is off."""
    return spark.createDataFrame([], REPORT if reports else EVENT)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as input events, with k of their JSON properties."""
    e = read(spark, sf_dir, "events")
    even = F.col("user_id") % 2 == 0
    return e.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("event_"), "event_id").alias("id"),
        F.concat(F.lit("session_"), "user_id").alias("session_id"),
        F.concat(F.lit("c"), F.col("user_id") % 10).alias("component"),
        F.col("event_type").alias("action"),
        F.when(F.col("event_type") == "error", "error").otherwise("interaction").alias("kind"),
        F.when(even, "backend").otherwise("frontend").alias("channel"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"),
        F.col("props").alias("context"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "user_id",
        "value",
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error reports of the driver's error events."""
    e = events(spark, sf_dir).where("kind = 'error'")
    return e.withColumns({"boundary": F.col("component"), "error": F.struct(F.concat(F.lit("E"), F.col("k") % 3).alias("name"), F.concat(F.lit("failed for user"), F.col("user_id"), F.lit("@example.com in step "), F.col("k") % 2).alias("message"), F.lit(None).cast("string").alias("stack"))}).drop("kind", "component", "action")


def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error records with one fingerprint per component: light input for issues."""
    none = F.lit(None).cast("string")
    error = F.struct(F.col("component").alias("boundary"), F.concat(F.lit("E"), F.col("k") % 3).alias("name"), none.alias("message"), F.col("component").alias("fingerprint"), F.lit(True).alias("handled"), F.when(F.col("k") % 7 == 0, "fatal").otherwise("error").alias("severity"), none.alias("stack"), none.alias("component_stack"), F.lit(None).cast("array<string>").alias("tags"))
    return events(spark, sf_dir).where("kind = 'error'").select("seq", "kind", "timestamp", error.alias("error"))
