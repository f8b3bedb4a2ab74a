"""Chains, near duplicates, summaries and reports over accepted places."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import proximity


def key_counts(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows with, for each named key, how many rows share it; 0 for a blank key.

    Counted by partial aggregation and joined back, so that a key shared by very many rows is one
    row to the reducer; a window over the key would gather all its rows in one task.
    """
    out = df
    for name, key in keys.items():
        k = f"_key_{name}"
        out = out.withColumn(k, F.coalesce(key, F.lit("")))
        n = out.filter(F.col(k) != "").groupBy(k).agg(F.count("*").alias(name))
        out = out.join(n, k, "left").withColumn(name, F.coalesce(name, F.lit(0))).drop(k)
    return out


def decorate(df: DataFrame, chain_from: int = 3, phone: str = "phone", title: str = "title", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows with phone_ext, chain_size (null up to 1), chain_flag ('CHAIN' from ``chain_from`` on) and coord_duplicates (null for 0)."""
    base = df.drop("phone_ext", "chain_flag", "chain_size", "coord_duplicates")
    number = T.phone_digits(T.phone_without_extension(F.coalesce(F.col(phone), F.lit(""))))
    n = key_counts(base, {"_by_phone": number, "_by_name": T.normalize(F.col(title)), "_by_point": T.point_key(F.col(lat), F.col(lon), F.col(title))})
    size = F.greatest("_by_phone", "_by_name")
    return (
        n.withColumn("phone_ext", T.phone_extension(F.col(phone)))
        .withColumn("chain_size", F.when(size > 1, size))
        .withColumn("chain_flag", F.when(size >= chain_from, "CHAIN").otherwise(""))
        .withColumn("coord_duplicates", F.when(F.col("_by_point") > 1, F.col("_by_point") - 1))
        .drop("_by_phone", "_by_name", "_by_point")
    )


def near_duplicates(df: DataFrame, id_col: str, radius_m: float = 40.0, rubrics: str = "categories") -> DataFrame:
    """(id, other, metres): pairs of one first rubric at most ``radius_m`` apart, in both directions; metres of the smaller id."""
    pairs = proximity.near_pairs(df, id_col, radius_m)
    rubric = df.select(F.col(id_col).cast("long").alias("id"), T.first_rubric(F.col(rubrics)).alias("rubric")).filter("rubric <> ''")
    same = pairs.join(rubric.withColumnRenamed("id", "id_a"), "id_a").join(rubric.select(F.col("id").alias("id_b"), F.col("rubric").alias("rubric_b")), "id_b").filter("rubric = rubric_b")
    return same.select(F.col("id_a").alias("id"), F.col("id_b").alias("other"), "metres").unionByName(same.select(F.col("id_b").alias("id"), F.col("id_a").alias("other"), "metres"))


def nearest_duplicates(pairs: DataFrame, titles: DataFrame, k: int = 3) -> DataFrame:
    """(id, nearest): the ``k`` nearest duplicates of each row as 'title (d м)', the nearest first, ties by id."""
    named = pairs.join(titles.select(F.col("id").alias("other"), "title"), "other")
    w = Window.partitionBy("id").orderBy("metres", "other")  # a row has few neighbours within a short distance
    top = named.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" ("), F.floor(F.col("metres") + 0.5).cast("string"), F.lit(" м)"))
    return top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda s: s["t"]), "; ").alias("nearest"))


def summary(df: DataFrame, by: str, groups: str, phone: str = "phone", site: str = "website", chain_flag: str = "chain_flag", names: dict[str, str] | None = None) -> DataFrame:
    """Totals by district and over all ('ИТОГО'): rows, chains, rows with phone and with site, and for each of ``names`` (column: group) the rows of that group.

    A row of several groups counts in each.
    """
    name = F.coalesce(T.filled(F.trim(F.col(by))), F.lit("—"))
    has = lambda c: F.sum(F.when(~T.is_blank(F.trim(F.col(c))), 1).otherwise(0))
    aggs = [F.count("*").alias("total"), F.sum(F.when(F.col(chain_flag) == "CHAIN", 1).otherwise(0)).alias("chained"), has(phone).alias("with_phone"), has(site).alias("with_site")]
    parts = F.transform(F.split(F.coalesce(F.col(groups), F.lit("")), r"[|;,/\n]"), lambda x: F.trim(x))
    aggs += [F.count_if(F.array_contains(parts, g)).alias(c) for c, g in (names or {}).items()]
    per = df.groupBy(name.alias("district")).agg(*aggs)
    return per.unionByName(df.agg(*aggs).withColumn("district", F.lit("ИТОГО")))


def group_counts(df: DataFrame, groups: str) -> DataFrame:
    """(group_name, n): rows by group; a row of several groups counts in each."""
    parts = F.array_distinct(F.filter(F.transform(F.split(F.coalesce(F.col(groups), F.lit("")), r"[|;,/\n]"), lambda x: F.trim(x)), lambda x: x != ""))
    return df.select(F.explode(parts).alias("group_name")).groupBy("group_name").agg(F.count("*").alias("n"))


def chain_table(df: DataFrame, title: str = "title", district: str = "detected_district", phone: str = "phone", at_least: int = 3) -> DataFrame:
    """(name, n, districts, phone): titles that occur ``at_least`` times, their districts sorted, their commonest phone (ties: the smallest)."""
    base = df.select(T.normalize(F.col(title)).alias("name"), F.trim(F.col(district)).alias("d"), T.phone_digits(F.coalesce(F.col(phone), F.lit(""))).alias("p")).filter("name <> ''")
    n = base.groupBy("name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(T.filled(F.col("d")))), ", ").alias("districts")).filter(F.col("n") >= at_least)
    phones = base.filter("p <> ''").groupBy("name", "p").agg(F.count("*").alias("k")).groupBy("name").agg(F.min_by("p", F.struct(-F.col("k"), "p")).alias("phone"))
    return n.join(phones, "name", "left").select("name", "n", "districts", F.coalesce("phone", F.lit("")).alias("phone"))


def numbered_rows(df: DataFrame, sheet: str, order: Sequence[str]) -> DataFrame:
    """Rows numbered within each sheet in the given order.

    Sheets may be very large, so numbers come from a range sort: position in the partition plus the
    rows before it, minus the rows before the sheet.
    """
    spark = df.sparkSession
    ordered = df.orderBy(sheet, *order).withColumn("_pid", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    from placeloom.session import cut_lineage

    ordered = cut_lineage(ordered)
    sizes = ordered.groupBy("_pid").agg(F.count("*").alias("n"), F.min("_in").alias("lo")).orderBy("_pid").collect()  # a row per partition
    before, rows = 0, []
    for r in sizes:
        rows.append((r["_pid"], before, r["lo"]))
        before += r["n"]
    base = spark.createDataFrame(rows, "_pid int, _before long, _lo long")
    placed = ordered.join(F.broadcast(base), "_pid").withColumn("_at", F.col("_before") + F.col("_in") - F.col("_lo") + 1).drop("_pid", "_in", "_before", "_lo")
    first = placed.groupBy(sheet).agg(F.min("_at").alias("_first"))
    cond = placed[sheet].eqNullSafe(first[sheet])
    return placed.join(F.broadcast(first) if first.limit(10_001).count() <= 10_000 else first, cond).drop(first[sheet]).withColumn("no", F.col("_at") - F.col("_first") + 1).drop("_at", "_first")


def district_numbers(known: DataFrame, names: DataFrame) -> DataFrame:
    """(name, no): numbers already given are kept, new names get the next ones in order of name."""
    top = known.agg(F.coalesce(F.max("no"), F.lit(0))).first()[0]
    fresh = names.select("name").distinct().join(known.select("name"), "name", "left_anti")
    w = Window.orderBy("name")  # names of districts: a short list
    new = fresh.select("name", (F.lit(top) + F.row_number().over(w)).cast("int").alias("no"))
    return known.select("name", F.col("no").cast("int").alias("no")).unionByName(new)


def ordered_rows(df: DataFrame, district: str, groups: str, rubrics: str, title: str, order: list[str], id_col: str) -> DataFrame:
    """Rows with their number ``no`` in the order of a report: by district, rank of the first group, rubrics and title, nulls last, ties by id."""
    label = T.group_label(F.col(groups), order)
    first = F.get(F.split(label, " / "), F.lit(0))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in order]), first), F.lit(0)), F.lit(99))
    keys = {"_sheet": F.lit("all"), "_rank": rank} | {f"_no_{c}": F.col(c).isNull() for c in (district, rubrics, title)}
    rows = numbered_rows(df.withColumns(keys), "_sheet", [f"_no_{district}", district, "_rank", f"_no_{rubrics}", rubrics, f"_no_{title}", title, id_col])
    return rows.drop(*keys)


def rejected(df: DataFrame, reason: str, phone: str = "phone") -> DataFrame:
    """Rejected rows as they are exported: the extension split off the phone, chain columns blank, the reason beside them; an error if there is none."""
    if not df.limit(1).count():
        raise ValueError("there are no rejected rows")
    text = lambda: F.lit(None).cast("string")
    return df.withColumns({"phone_ext": T.phone_extension(F.col(phone)), phone: T.phone_without_extension(F.col(phone)), "chain_size": text(), "chain_flag": text(), "coord_duplicates": text(), "exclude_reason": F.lit(reason)})


def sheet_order(names: DataFrame, first: Sequence[str]) -> DataFrame:
    """(no, name): the sheets of a report, the given ones first in their order, then the others by name."""
    fixed = F.array(*[F.lit(n) for n in first])
    every = names.select("name").unionByName(names.sparkSession.createDataFrame([(n,) for n in first], "name string")).distinct()
    rank = F.coalesce(F.nullif(F.array_position(fixed, F.col("name")), F.lit(0)), F.lit(len(first) + 1))
    return numbered_rows(every.withColumns({"_sheet": F.lit("all"), "_rank": rank}), "_sheet", ["_rank", "name"]).select("no", "name")


def working_sheet(df: DataFrame, order: list[str], district: str = "detected_district", groups: str = "detected_category_group") -> DataFrame:
    """The columns of a sheet of accepted places: number within the district, group label, how many share the address (blank for one),
    'Да' for a chain, the first of several links."""
    rows = key_counts(decorate(df), {"_same": T.normalize(F.col("address"))})
    rows = numbered_rows(rows.withColumn("sheet", F.coalesce(T.filled(F.trim(F.col(district))), F.lit("—"))), "sheet", ["final_id"])
    return rows.select(
        "sheet",
        "no",
        "final_id",
        "title",
        T.group_label(F.col(groups), order).alias("groups"),
        F.when(F.col("_same") > 1, F.col("_same")).alias("same_address"),
        F.when(F.col("chain_flag") == "CHAIN", "Да").otherwise("").alias("chain"),
        first_link(F.col("website")).alias("link"),
    )


def first_link(c: Column) -> Column:
    """The first of several links between semicolons, '' for none."""
    return F.coalesce(F.trim(F.get(F.split(c, ";"), F.lit(0))), F.lit(""))


def plain_name(c: Column) -> Column:
    """The name of a sheet without its number."""
    return F.regexp_replace(c, r"^[0-9]+ ", "")
