"""Reconciling the register with independent sources."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import proximity


def nearest(left: DataFrame, right: DataFrame, within_m: float) -> DataFrame:
    """(id_a, id_b, metres): for each row of ``left`` the nearest row of ``right`` within a distance, ties by id.

    Both have id, lat, lon. Cells are bands of latitude as high as the distance, cut into columns that are as
    wide at the band's own latitude; a row looks into the columns of three bands that its disc reaches, so
    no pair is missed at any latitude.
    """
    size = within_m / proximity.METRES_PER_DEGREE * 1.0001
    band = lambda c: F.floor(F.col(c) / size)
    wide = F.lit(size) / F.greatest(F.lit(1e-6), F.cos(F.radians(F.col("y") * size)))
    b = right.filter("lat is not null and lon is not null").select(F.col("id").alias("id_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), band("lat").alias("y"))
    b = b.withColumn("x", F.floor(F.col("lon_b") / wide))
    a = left.filter("lat is not null and lon is not null").select(F.col("id").alias("id_a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: band("lat") + d)).alias("y"))
    reach = F.least(F.lit(360.0), F.lit(size) / F.greatest(F.lit(1e-6), F.cos(F.radians("lat_a"))))
    a = a.withColumn("x", F.explode(F.sequence(F.floor((F.col("lon_a") - reach) / wide), F.floor((F.col("lon_a") + reach) / wide))))
    m = T.metres(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    near = a.join(b, ["y", "x"]).select("id_a", "id_b", m.alias("metres")).filter(F.col("metres") <= within_m)
    return near.groupBy("id_a").agg(F.min_by(F.struct("id_b", "metres"), F.struct("metres", "id_b")).alias("m")).select("id_a", "m.id_b", "m.metres")


def latest_active(df: DataFrame, key: str, status: str, active: str, at: str) -> DataFrame:
    """Of each key its last row, by ``at``, among those of one status; null keys are none."""
    rows = df.filter((F.col(status) == active) & F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in df.columns if c != key]), F.col(at)).alias("v")).select(key, "v.*")


def alike_names(left: DataFrame, right: DataFrame, at_least: float, *same: str) -> DataFrame:
    """(ka, kb, score) of distinct names, numbered k, whose stems overlap at least so much and that agree in the columns ``same``.

    Of the smaller name of such a pair, one of its rarest stems must be shared, as many as it may lack and one
    more; so only those are looked up, and a stem that very many names have is met by names of such stems only.
    """
    both = left.select("stems").unionByName(right.select("stems"))
    seen = both.select(F.explode("stems").alias("s")).groupBy("s").agg(F.count("*").alias("seen"))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        each = df.select(F.col("k").alias(f"k{side}"), *same, F.size("stems").alias(f"n{side}"), F.explode("stems").alias("s")).join(seen, "s")
        rare = F.array_sort(F.collect_list(F.struct("seen", "s")))  # the stems of one name
        lead = F.greatest(F.lit(1), F.col(f"n{side}") - F.ceil(F.col(f"n{side}") * at_least - 1e-9) + 1).cast("int")
        return each.groupBy(f"k{side}", *same, f"n{side}").agg(rare.alias("rs")).select(f"k{side}", *same, f"n{side}", F.posexplode(F.transform("rs", lambda r: r["s"])).alias("i", "s"), lead.alias("lead"))

    a, b = keyed(left, "a"), keyed(right, "b")
    firsts = lambda df: df.filter("i < lead").drop("i", "lead")
    every = lambda df: df.drop("i", "lead")
    pairs = firsts(a).join(every(b), [*same, "s"]).filter("na <= nb").select("ka", "kb").unionByName(every(a).join(firsts(b), [*same, "s"]).filter("nb < na").select("ka", "kb")).distinct()
    stems = lambda df, side: df.select(F.col("k").alias(f"k{side}"), F.col("stems").alias(f"stems_{side}"))
    scored = pairs.join(stems(left, "a"), "ka").join(stems(right, "b"), "kb").select("ka", "kb", T.overlap(F.col("stems_a"), F.col("stems_b")).alias("score"))
    return scored.filter(F.col("score") >= at_least)


def best_names(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(id_a, id_b, score): for each row of ``left`` the row of ``right`` whose name stems overlap most, ties by id.

    Both have id and stems, sorted. Rows of equal stems have equal answers, so only distinct names are
    compared: a chain is one name on either side however many branches it has. The score is the overlap
    coefficient.
    """
    key = F.array_join("stems", " ")
    names = left.select(key.alias("k"), "stems").filter(F.size("stems") > 0).distinct()
    kinds = right.filter(F.size("stems") > 0).groupBy(key.alias("k"), "stems").agg(F.min("id").alias("id_b"))
    scored = alike_names(names, kinds, at_least).join(kinds.select(F.col("k").alias("kb"), "id_b"), "kb")
    best = scored.groupBy("ka").agg(F.min_by(F.struct("id_b", "score"), F.struct(-F.col("score"), "id_b")).alias("m"))
    return left.select(F.col("id").alias("id_a"), key.alias("ka")).join(best, "ka").select("id_a", "m.id_b", "m.score")


def geocode(rows: DataFrame, index: DataFrame) -> DataFrame:
    """(id, lat, lon, precision): position of street and house, else of the street's only position.

    ``rows`` has id, street, house; ``index`` street, house, lat, lon, pos (the last entry of a house counts).
    """
    house = index.groupBy("street", "house").agg(F.max_by(F.struct("lat", "lon"), "pos").alias("h"))
    street = index.groupBy("street").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), (F.max("lat") - F.min("lat")).alias("span"), (F.max("lon") - F.min("lon")).alias("span_x"))
    lone = street.filter("span < 1e-9 and span_x < 1e-9").select("street", F.struct("lat", "lon").alias("s"))
    found = rows.join(house, ["street", "house"], "left").join(lone, "street", "left")
    at = F.coalesce("h", "s")
    return found.select("id", at["lat"].alias("lat"), at["lon"].alias("lon"), F.when(F.col("h").isNotNull(), "HOUSE").when(F.col("s").isNotNull(), "STREET").otherwise("NONE").alias("precision"))


def same_phone_siblings(df: DataFrame, id_col: str, phone: str, title: str) -> DataFrame:
    """(id, siblings): how many other titles share a row's phone.

    Titles are made distinct by phone first; only their number goes back to the rows, so a hotline
    of very many rows is no group in memory.
    """
    base = df.select(F.col(id_col).alias("id"), T.phone_digits(F.coalesce(F.col(phone), F.lit(""))).alias("p"), T.normalize(F.coalesce(F.col(title), F.lit(""))).alias("t")).filter("p <> ''")
    n = base.select("p", "t").distinct().groupBy("p").agg((F.count("*") - 1).alias("siblings"))
    return base.join(n, "p").select("id", "siblings")


def match_status(score, exists: float = 0.6, check: float = 0.4):
    """EXISTS, CHECK or ABSENT by the best score."""
    return F.when(score >= exists, "EXISTS").when(score >= check, "CHECK").otherwise("ABSENT")


def only_candidate(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value of each key whose rows agree on one."""
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo = hi").select(key, F.col("lo").alias(value))


def greedy_entities(df: DataFrame, block: str, order: Sequence[str], stems: str = "stems", at_least: float = 0.6) -> DataFrame:
    """(id, entity): rows attached, in order, to the first earlier entity of their block that resembles them, else new ones.

    The result depends on the order by definition, so a block is one sequence. Rows of a block are
    streamed, not gathered: only its entities are kept, indexed by stem.
    """
    schema = "id bigint, entity bigint"

    def run(frames):
        held, entities, index = None, [], {}
        for pdf in frames:
            out = []
            for rid, b, s in zip(pdf["id"], pdf["b"], pdf["stems"]):
                if b != held:
                    held, entities, index = b, [], {}
                own, at = set(s), None
                for k in sorted({k for x in own for k in index.get(x, ())}):
                    other = entities[k][1]
                    if len(own & other) / max(1, min(len(own), len(other))) >= at_least:
                        at = k
                        break
                if at is None:
                    at = len(entities)
                    entities.append((rid, own))
                    for x in own:
                        index.setdefault(x, []).append(at)
                out.append((rid, entities[at][0]))
            yield pd.DataFrame(out, columns=["id", "entity"])

    slim = df.select("id", F.coalesce(F.col(block), F.lit("")).alias("b"), F.col(stems).alias("stems"), *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)])
    return slim.repartition("b").sortWithinPartitions("b", *[f"o{i}" for i in range(len(order))]).select("id", "b", "stems").mapInPandas(run, schema)


def exists_similar(left: DataFrame, right: DataFrame, at_least: float) -> DataFrame:
    """(id): rows of ``left`` for which ``right`` has a name of the same place whose stems overlap at least so much.

    Both have id, stems and place ('' for none). Names of equal stems and place are one, so a chain is compared once.
    """
    key = F.concat_ws("\x1f", "place", F.array_join("stems", " "))
    kinds = lambda df: df.filter(F.size("stems") > 0).select(key.alias("k"), "stems", "place").distinct()
    good = alike_names(kinds(left), kinds(right), at_least, "place").select("ka").distinct()
    return left.withColumn("ka", key).join(good, "ka", "left_semi").select("id")
