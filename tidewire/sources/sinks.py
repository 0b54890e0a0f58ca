"""Sinks and state tables on plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, run_id: str) -> None:
    """Append rows under a run id that the caller chose; a rerun of the same id replaces its rows."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def save_digest(issue: DataFrame, path: str, run_id: str, day: str) -> str:
    """Append a digest under the run's id, which is also its identity; saving it again replaces it."""
    append(issue.withColumn("digest_date", F.lit(day).cast("date")), path, run_id)
    return run_id


def record_feedback(spark: SparkSession, path: str, run_id: str, rows: list[tuple[str, int, str, str]], at: str) -> None:
    """Append button presses (digest, article index, user, action) as ratings; the raw action is kept."""
    some = spark.createDataFrame(rows, "digest_id string, idx int, user_id string, rating string")
    append(some.select("digest_id", F.concat(F.lit("idx:"), F.col("idx")).alias("article_url"), F.lit("").alias("source"), "user_id", "rating", F.lit(at).cast("timestamp_ntz").alias("created_at")), path, run_id)


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def upsert(spark: SparkSession, path: str, changes: DataFrame, key: str, version: str, next_path: str) -> DataFrame:
    """Write the state after `changes` to next_path; the caller then points to it.

    Rewriting into a new folder keeps readers of the old one whole and makes a retry harmless.
    """
    old = spark.read.parquet(path)
    latest(old.unionByName(changes), key, [version]).write.mode("overwrite").parquet(next_path)
    return spark.read.parquet(next_path)


def run_log(events: DataFrame) -> DataFrame:
    """Latest state of every run from its start and end records; errors cut at 500 characters."""
    return latest(events, "id", ["at"]).withColumn("error", F.substring("error", 1, 500))


SECRET_KEYS = ("api_key", "bot_token", "token", "password", "secret")  # fixed values: keys whose values are hidden


def redact(m: Column) -> Column:
    """A string map with its secrets hidden."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).isin(*SECRET_KEYS) & (v != ""), F.lit("***")).otherwise(v))


def redact_tree(value):
    """A nested configuration with its secrets hidden, whatever their depth; empty and other values stay."""
    if isinstance(value, dict):
        return {k: "***" if str(k).lower() in SECRET_KEYS and isinstance(v, str) and v else redact_tree(v) for k, v in value.items()}
    return [redact_tree(v) for v in value] if isinstance(value, list) else value


def export_json(df: DataFrame, path: str, secrets: list[str] | None = None) -> None:
    """Write rows as JSON lines; columns named like secrets, and those listed, are hidden."""
    hidden = {c for c in df.columns if c.lower() in SECRET_KEYS} | set(secrets or [])
    cols = [F.when(F.col(c).cast("string") != "", F.lit("***")).otherwise(F.col(c).cast("string")).alias(c) if c in hidden else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").json(path)
