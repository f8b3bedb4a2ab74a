"""Queries of the operators of this folder."""

from __future__ import annotations

from placeloom.llm import addresses, encoding, formatdups, matching, mixing, splitting, survivor


def _t(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def queries():
    return {
        "p1_found": lambda s, d: addresses.same_building(_t(s, d, "address_records")),
        "p1_classes": lambda s, d: addresses.building_classes(_t(s, d, "address_records")),
        "p3_found": lambda s, d: matched(s, d).select("final_id", "osm_id"),
        "p3_scored": lambda s, d: matched(s, d),
        "p5_found": lambda s, d: formatdups.format_duplicates(_t(s, d, "raw_places")).selectExpr("first_id as first_raw_id", "row_id as raw_id"),
        "p5_counts": lambda s, d: formatdups.format_counts(_t(s, d, "raw_places")).withColumnRenamed("first_id", "first_raw_id"),
        "p6_found": lambda s, d: survivor.trusted_survivors(_t(s, d, "raw_places")),
        "p6_fused": lambda s, d: fused(s, d),
        "p8_ids": lambda s, d: encoding.encode_texts(_t(s, d, "documents"), "doc_id", "text"),
        "p9_mix": lambda s, d: mixing.mix_sources(_t(s, d, "documents"), _t(s, d, "mix_targets")),
        "p9_shares": lambda s, d: mixing.mix_shares(mixing.mix_sources(_t(s, d, "documents"), _t(s, d, "mix_targets")), _t(s, d, "mix_targets")),
        "p10_pieces": lambda s, d: splitting.split_oversized(_t(s, d, "documents"), _t(s, d, "size_limits")),
    }


def fused(spark, folder):
    """Fusion of the captures of each place; what made a capture appear (its category of search) is the source."""
    from pyspark.sql import functions as F

    claims = survivor.claims_of(_t(spark, folder, "raw_places"), source=F.col("source_category"))
    return survivor.fuse_claims(claims).withColumnRenamed("object", "place_id")


def matched(spark, folder):
    """Accepted places and mapped objects that are the same firm, with the confidence of each pair."""
    pairs = matching.match_places(matching.register_side(_t(spark, folder, "final_filtered")), matching.mapped_side(_t(spark, folder, "osm_places")))
    return pairs.selectExpr("id_a as final_id", "id_b as osm_id", "confidence")
