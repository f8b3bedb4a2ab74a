"""Merging captures of one organisation into one record, in batch and incrementally."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text as T

# Detail levels by rank.
LEVEL_RANK = {"LIST": 0, "LIST_ONLY": 1, "CARD": 2}
LEVEL_NAME = {v: k for k, v in LEVEL_RANK.items()}


def level_rank(c: Column) -> Column:
    """0, 1, 2 for LIST, LIST_ONLY, CARD; -1 for anything else."""
    out = F.lit(-1)
    for name, rank in LEVEL_RANK.items():
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def keyed(df: DataFrame) -> DataFrame:
    """Rows with their stable key; rows without any identity are dropped."""
    return df.withColumn("key", T.stable_key(F.col("place_id"), F.col("phone"), F.col("title"), F.col("address"), F.col("maps_url"), F.col("phones") if "phones" in df.columns else None)).filter("key is not null")


def merge_records(df: DataFrame, fields: Sequence[str], seq: str, level: str = "detail_level", records: str | None = "source_records") -> DataFrame:
    """One row per key: of each field the first value that is not blank in order of ``seq``, the highest level,
    the number of rows, and the distinct provenance.

    Null keys are no key. Values are partly aggregated before the shuffle, so a key of any number of rows is
    one row per map task; provenance is made distinct by (key, record) first, as an organisation has few
    distinct records however often it was captured.
    """
    first = [F.min_by(F.col(f), F.when(~T.is_blank(F.col(f).cast("string")), F.col(seq))).alias(f) for f in fields]
    best = F.max(level_rank(F.col(level)))
    names = F.create_map(*[F.lit(x) for kv in LEVEL_NAME.items() for x in kv])
    base = df.filter("key is not null")
    out = base.groupBy("key").agg(*first, F.count("*").alias("n_rows"), best.alias("rank")).withColumn("detail_level", F.coalesce(names[F.col("rank")], F.lit(""))).drop("rank")
    if records is None:
        return out
    each = base.select("key", F.col(seq).alias("s"), F.posexplode(T.source_records(F.col(records))).alias("pos", "r"))
    once = each.groupBy("key", "r").agg(F.min(F.struct("s", "pos")).alias("at"))
    prov = once.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "r"))).alias("rs")).select("key", F.transform("rs", lambda x: x["r"]).alias("records"))
    joined = out.join(prov, "key", "left").withColumn("records", F.coalesce("records", F.array().cast(T.RECORDS)))
    return joined.withColumn("source_queries_count", F.size("records")).withColumn("source_district", T.unique_joined(F.transform("records", lambda r: r["district"])))


def import_dedupe(df: DataFrame, fields: Sequence[str], seq: str) -> DataFrame:
    """Within one file the last row of a key wins, blanks included."""
    last = df.filter("key is not null").groupBy("key").agg(F.max_by(F.struct(*fields), F.col(seq)).alias("v"), F.count("*").alias("n_rows"))
    return last.select("key", "v.*", "n_rows")


def union_registers(*parts: DataFrame) -> DataFrame:
    """Registers one after another, with their order kept for merging; columns that one lacks are null there."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def upsert(stored: DataFrame, incoming: DataFrame, fields: Sequence[str], seq: str) -> DataFrame:
    """Stored rows with incoming ones merged in: what is stored comes first, new keys are added."""
    both = union_registers(stored.withColumn(seq, F.lit(-1).cast("long")), incoming)
    return merge_records(both, fields, seq, records=None)


def enrich(stored: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str], protected: Sequence[str] = ()) -> DataFrame:
    """Stored rows whose fields incoming non-blank values overwrite; protected fields and unknown keys are left alone.

    Of several incoming rows of one key the last non-blank value by its text counts.
    """
    new = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(T.filled(F.col(f).cast("string"))).alias(f"new_{f}") for f in fields if f not in protected])
    joined = stored.join(new, key, "left")
    return joined.select(*[F.coalesce(F.col(f"new_{c}"), F.col(c).cast("string")).alias(c) if c in fields and c not in protected else F.col(c) for c in stored.columns])


def fill_blanks(stored: DataFrame, patch: DataFrame, key: str, fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Stored rows with only their blank fields filled from ``patch``, and the patch rows that met no stored row."""
    new = patch.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(T.filled(F.col(f).cast("string"))).alias(f"new_{f}") for f in fields])
    joined = stored.join(new, key, "left")
    out = joined.select(*[F.coalesce(T.filled(F.col(c).cast("string")), F.col(f"new_{c}")).alias(c) if c in fields else F.col(c) for c in stored.columns])
    return out, patch.join(stored.select(key), key, "left_anti")


def without_ids(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Stored rows whose id is not listed."""
    return stored.join(ids.select(key), key, "left_anti")


def totals(df: DataFrame, records: str = "source_records") -> DataFrame:
    """(organisations, hits, hits_at_least_one): hits are provenance records; the last counts rows without any as one."""
    n = F.size(T.source_records(F.col(records)))
    return df.agg(F.count("*").alias("organisations"), F.sum(n).alias("hits"), F.sum(F.greatest(n, F.lit(1))).alias("hits_at_least_one"))


def merge_queue(queue: DataFrame, incoming: DataFrame) -> DataFrame:
    """The queue with those incoming queries appended that it does not have by normalised query and district."""
    norm = lambda df: df.withColumn("q", T.normalize(F.coalesce("query_text", F.lit("")))).withColumn("d", T.normalize(F.coalesce("district", F.lit(""))))
    fresh = norm(incoming).join(norm(queue).select("q", "d"), ["q", "d"], "left_anti").drop("q", "d")
    return queue.unionByName(fresh.dropDuplicates(["query_text", "district"]), allowMissingColumns=True)


def needs_card(df: DataFrame) -> Column:
    """Whether a list row lacks rubrics, phone, site or hours."""
    return (F.col("detail_level") == "LIST") & (T.is_blank(F.col("categories")) | T.is_blank(F.col("phone")) | T.is_blank(F.col("website")) | T.is_blank(F.col("opening_hours")))


def prefer(key: str, fields: Sequence[str], *sources: DataFrame) -> DataFrame:
    """For each key of any source, its fields from the first source that has the key, with that source's number."""
    ranked = None
    for i, s in enumerate(sources):
        one = s.select(F.col(key), F.struct(F.lit(i).alias("from_source"), *fields).alias("v"))
        ranked = one if ranked is None else ranked.unionByName(one)
    return ranked.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("v", "v.from_source").alias("v")).select(key, "v.*")


def still_pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The queue of list rows that need a card: rows leave it once ``done`` has their key, so work goes on where it stopped."""
    return rows.filter(needs_card(rows)).join(done.select(key).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def with_external(own: DataFrame, external: DataFrame, key: str, origin: str) -> DataFrame:
    """Own rows and those external ones whose key they lack, with ``origin``; adding the same rows again changes nothing."""
    fresh = external.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(own.select(key), key, "left_anti")
    return own.unionByName(fresh.withColumn("origin", F.lit(origin)), allowMissingColumns=True)
