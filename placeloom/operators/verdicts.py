"""Verdicts on organisations from verdicts on their provenance records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import proximity


def record_verdicts(raw: DataFrame, row_id: str, districts: DataFrame, records: str = "source_records") -> DataFrame:
    """(row_id, key, asked, found, verdict): for each provenance record of each row, the district asked for, the district
    the row lies in, and MATCH, REASSIGNED, NO_DISTRICT, OUTSIDE or NO_COORDINATES. Rows without records have one of their own.

    Where several regions hold a point the one of the smallest id counts.
    """
    inside = proximity.points_in_regions(raw, row_id, districts, "district_id", "geojson").groupBy("id").agg(F.min("region").alias("region"))
    names = districts.select(F.col("district_id").cast("long").alias("region"), F.col("district_name").alias("found"))
    where = inside.join(names, "region").select(F.col("id").alias("_id"), "found")
    placed = proximity.positioned(raw, row_id).select(F.col("id").alias("_id")).distinct().withColumn("placed", F.lit(True))
    r = raw.select(F.col(row_id).cast("long").alias("_id"), "key", F.explode_outer(T.source_records(F.col(records))).alias("r"))
    j = r.join(where, "_id", "left").join(placed, "_id", "left")
    asked = F.coalesce(F.col("r.district"), F.lit(""))
    verdict = (
        F.when(F.col("placed").isNull(), "NO_COORDINATES")
        .when(F.col("found").isNull(), "OUTSIDE")
        .when(T.is_blank(asked), "NO_DISTRICT")
        .when(T.normalize(asked) == T.normalize(F.col("found")), "MATCH")
        .otherwise("REASSIGNED")
    )
    return j.select(F.col("_id").alias(row_id), "key", asked.alias("asked"), "found", verdict.alias("verdict"))


def roll_up(verdicts: DataFrame) -> DataFrame:
    """(key, n, any_match, every_outside, verdicts): per organisation, with the distinct verdicts sorted."""
    return verdicts.groupBy("key").agg(
        F.count("*").alias("n"),
        F.bool_or(F.col("verdict") == "MATCH").alias("any_match"),
        F.bool_and(F.col("verdict") == "OUTSIDE").alias("every_outside"),
        F.array_join(F.array_sort(F.collect_set("verdict")), " | ").alias("verdicts"),
    )


def verdict_counts(rolled: DataFrame) -> DataFrame:
    """(verdicts, n): organisations by their distinct verdicts."""
    return rolled.groupBy("verdicts").agg(F.count("*").alias("organisations"))


def one_group_first(groups: Column, first: str) -> Column:
    """The distinct groups of a row; a row of the group ``first`` is of that one only."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(groups, F.lit("")), r"[|;,/\n]"), lambda x: F.trim(x)), lambda x: x != ""))
    return F.when(F.array_contains(parts, first), F.array(F.lit(first))).otherwise(parts)
