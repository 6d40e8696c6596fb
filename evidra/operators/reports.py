"""Scanner and phone reports from saved JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCAN = "md5 string, sha1 string, sha256 string, scan_date string, positives int, total int, permalink string, scans map<string, struct<detected: boolean, version: string, update: string, result: string>>"
PHONE = ["status", "phone", "phone_valid", "carrier", "phone_type", "phone_region", "country", "country_code", "country_prefix", "international_number", "local_number", "e164"]


def scan_summary(rows: DataFrame, column: str = "report") -> DataFrame:
    """rows with the report's scalars, `N/A` or 0 where missing, and positives/total as score."""
    r = F.from_json(column, SCAN)
    out = rows.withColumn("r", r)
    for c in ("md5", "sha1", "sha256", "scan_date", "permalink"):
        out = out.withColumn(c, F.coalesce(F.col(f"r.{c}"), F.lit("N/A")))
    for c in ("positives", "total"):
        out = out.withColumn(c, F.coalesce(F.col(f"r.{c}"), F.lit(0)))
    return out.withColumn("score", F.concat_ws("/", F.col("positives").cast("string"), F.col("total").cast("string"))).drop("r")


def scan_engines(rows: DataFrame, key: str, column: str = "report") -> DataFrame:
    """(key, engine, detected, version, update, result): a row for each engine; empty results are `N/A`."""
    named = lambda c: F.when(F.coalesce(F.col(f"s.{c}"), F.lit("")) == "", F.lit("N/A")).otherwise(F.col(f"s.{c}"))
    return rows.select(key, F.explode(F.from_json(column, SCAN)["scans"]).alias("engine", "s")).select(key, "engine", F.coalesce("s.detected", F.lit(False)).alias("detected"), named("version").alias("version"), named("update").alias("update"), named("result").alias("result"))


def upload_receipt(rows: DataFrame, column: str = "report") -> DataFrame:
    """rows with id, sha256 and date of an upload's answer."""
    get = lambda p: F.get_json_object(column, p)
    return rows.withColumns({"id": get("$.data.id"), "sha256": get("$.data.attributes.sha256"), "date": get("$.data.attributes.date")})


def phone_report(rows: DataFrame, column: str = "report") -> DataFrame:
    """rows with the twelve fields of a phone report, `N/A` where missing; only those that succeeded."""
    out = rows.withColumns({c: F.coalesce(F.get_json_object(column, f"$.{c}"), F.lit("N/A")) for c in PHONE})
    return out.filter(F.col("status") == "success")
