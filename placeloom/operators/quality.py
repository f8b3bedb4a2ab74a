"""Data-quality audits of raw captures and verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text as T


def hit_counts(df: DataFrame, field: str, records: str = "source_records") -> DataFrame:
    """(value, n): provenance records by one of their fields, '—' for blank."""
    r = df.select(F.explode(T.source_records(F.col(records))).alias("r"))
    return r.groupBy(F.coalesce(T.filled(F.col(f"r.{field}")), F.lit("—")).alias("value")).agg(F.count("*").alias("n"))


def top_hits(df: DataFrame, field: str, k: int = 15) -> DataFrame:
    """The ``k`` most frequent values, ties by value."""
    return hit_counts(df, field).orderBy(F.desc("n"), "value").limit(k)


def completeness(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, filled, percent): how many rows have each field, in one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.sum(F.when(~T.is_blank(F.col(f).cast("string")), 1).otherwise(0)).alias(f) for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f), F.lit(0)).alias("filled")) for f in fields])).alias("e")
    return one.select("n", each).select("e.field", "e.filled", F.floor(1000 * F.col("e.filled") / F.greatest("n", F.lit(1)) + 0.5).cast("long").alias("per_mille"))


def id_uniqueness(df: DataFrame, id_col: str = "place_id") -> DataFrame:
    """(filled, distinct_ids, repeated_ids, most): how unique the ids are."""
    per = df.select(F.trim(F.col(id_col)).alias("i")).filter("i <> ''").groupBy("i").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("filled"), F.count("*").alias("distinct_ids"), F.count_if(F.col("n") > 1).alias("repeated_ids"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n): the distribution of each column, '—' for blank."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.coalesce(T.filled(F.col(c).cast("string")), F.lit("—")).alias("value")) for c in columns])).alias("e")
    return df.select(each).groupBy("e.column_name", "e.value").agg(F.count("*").alias("n"))


def coordinate_sanity(df: DataFrame, box: tuple[float, float, float, float], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """(state, n): missing, zero, swapped, outside the box (lat0, lat1, lon0, lon1), good."""
    a, o = F.col(lat), F.col(lon)
    state = (
        F.when(a.isNull() | o.isNull(), "missing")
        .when((a == 0) | (o == 0), "zero")
        .when(a.between(36.0, 39.5) & o.between(54.5, 57.0), "swapped")
        .when(~(a.between(box[0], box[1]) & o.between(box[2], box[3])), "outside")
        .otherwise("good")
    )
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def yield_ledger(df: DataFrame, low_under: int = 15) -> DataFrame:
    """(district, query, n_rows, low): per district and query of the captures, rows of its last day and whether they are few."""
    base = df.select(T.normalize(F.coalesce("source_district", F.lit(""))).alias("district"), T.normalize(F.coalesce("source_query", F.lit(""))).alias("query"), F.to_date("captured_at").alias("day"))
    per = base.groupBy("district", "query", "day").agg(F.count("*").alias("n"))
    last = per.groupBy("district", "query").agg(F.max_by("n", "day").alias("n_rows"))
    return last.withColumn("low", F.col("n_rows") < low_under)
