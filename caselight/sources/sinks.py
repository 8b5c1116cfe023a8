"""Sinks over Parquet folders: rows are added once, and other content under a known key is an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(df: DataFrame, key: list[str]) -> Column:
    rest = sorted(c for c in df.columns if c not in key)
    return F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)


def intake(stored: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """incoming with status: NEW, IDEMPOTENT (stored with equal content), CONFLICT (with other content)."""
    known = stored.select(*key, content_hash(stored, key).alias("_stored"))
    joined = incoming.withColumn("_own", content_hash(incoming, key)).join(known, key, "left")
    status = F.when(F.col("_stored").isNull(), "NEW").when(F.col("_stored") == F.col("_own"), "IDEMPOTENT").otherwise("CONFLICT")
    return joined.withColumn("status", status).drop("_stored", "_own")


def append_new(stored: DataFrame, incoming: DataFrame, key: list[str], path: str) -> None:
    """Appends rows with new keys; stops if a key comes with other content."""
    judged = intake(stored, incoming.dropDuplicates(), key)
    ok = F.assert_true(F.col("status") != "CONFLICT", F.concat(F.lit("other content is stored under "), F.concat_ws("/", *key)))
    judged.withColumn("_ok", ok).where("_ok is null and status = 'NEW'").drop("_ok", "status").write.mode("append").parquet(path)


def upsert_vectors(stored: DataFrame, incoming: DataFrame, dimension: int) -> DataFrame:
    """The latest vector of each fragment; lengths, finite numbers and one model revision are required."""
    both = stored.unionByName(incoming)
    vector = F.col("embedding")
    sound = (F.size(vector) == dimension) & F.forall(vector, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    latest = both.withColumn("_ok", F.assert_true(sound, F.lit("a vector has another length or is not finite"))).where("_ok is null").drop("_ok")
    rest = [c for c in both.columns if c != "fragment_id"]
    picked = latest.groupBy("fragment_id").agg(F.max_by(F.struct(*rest), F.struct("created_at", "model_revision")).alias("row"))
    return picked.select("fragment_id", "row.*")


def report(df: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    df.write.mode("overwrite").json(path)
