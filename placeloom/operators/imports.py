"""Taking a raw export into the register: one row per organisation, the queries it stems from, and its hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import merge

TEXTS = ("source_district", "source_group", "source_category", "source_query")
NAMES = ("district", "group", "category", "query")


def _records(df: DataFrame) -> Column:
    return T.records_for(F.col("source_records"), *[F.col(c) for c in TEXTS])


def import_rows(df: DataFrame, fields: Sequence[str], seq: str) -> DataFrame:
    """(key, fields, n_rows, records, source texts, source_queries_count): one row per organisation of a file.

    The last row of a key, by ``seq``, gives all fields, blanks included. Provenance is the distinct union of all
    rows, in the order first met; its texts are joined from it, or are the row's own where it has none. The count
    is that of the records, else the row's own number, else 1. Rows without id, link and title are dropped, as are
    those without a key.
    """
    known = F.coalesce(*[T.filled(F.trim(F.col(c))) for c in ("place_id", "maps_url", "title")]).isNotNull()
    base = merge.keyed(df.filter(known)).withColumn("_r", _records(df))
    count = F.coalesce(F.nullif(F.col("source_queries_count").cast("int"), F.lit(0)), F.lit(1))
    own = [F.col(c) for c in TEXTS]
    last = base.groupBy("key").agg(F.max_by(F.struct(*fields, *[c.alias(f"_own{i}") for i, c in enumerate(own)], count.alias("_n")), F.col(seq)).alias("v"), F.count("*").alias("n_rows"))
    once = base.select("key", F.col(seq).alias("s"), F.posexplode("_r").alias("pos", "r")).groupBy("key", "r").agg(F.min(F.struct("s", "pos")).alias("at"))
    prov = once.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("records"))
    out = last.join(prov, "key", "left").withColumn("records", F.coalesce("records", F.array().cast(T.RECORDS)))
    texts = [F.coalesce(T.filled(T.unique_joined(F.col(f"records.{n}"))), F.col(f"v._own{i}"), F.lit("")).alias(TEXTS[i]) for i, n in enumerate(NAMES)]
    return out.select("key", *[F.col(f"v.{f}").alias(f) for f in fields], "n_rows", "records", *texts, F.when(F.size("records") > 0, F.size("records")).otherwise(F.col("v._n")).alias("source_queries_count"))


def import_queue(df: DataFrame, seq: str) -> DataFrame:
    """(position, district, group, category, query, status): the distinct provenance records of a file in the order first met, as finished queries.

    Positions count from 1. They come from a range sort, so the queue may be of any size.
    """
    from placeloom.operators.report import numbered_rows

    each = df.select(F.col(seq).alias("s"), F.posexplode(_records(df)).alias("pos", "r")).groupBy("r").agg(F.min(F.struct("s", "pos")).alias("at"))
    rows = numbered_rows(each.select(F.lit("queue").alias("_sheet"), "at", "r.*"), "_sheet", ["at"])
    return rows.select(F.col("no").alias("position"), *NAMES, F.lit("COMPLETED").alias("status"))


def import_hits(rows: DataFrame) -> DataFrame:
    """(organisations, hits) of imported rows."""
    return rows.agg(F.count("*").alias("organisations"), F.coalesce(F.sum("source_queries_count"), F.lit(0)).alias("hits"))
