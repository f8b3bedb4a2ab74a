"""The register as tables in a shared folder, with the operations that its users call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.operators import merge

#: Stores, and those that are emptied with each, as they are made from it.
STORES = {"raw": ("final", "rejected"), "final": (), "rejected": ()}


class Register:
    """Captures (raw), accepted and rejected places by key. A put writes a new version of a store beside the last and names it only when it is complete."""

    def __init__(self, spark: SparkSession, folder: str, fields: Sequence[str]):
        self.spark, self.folder, self.fields = spark, folder.rstrip("/"), tuple(fields)

    def _versions(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/versions")
        except AnalysisException:
            return None

    def _version(self, store: str) -> int:
        seen = self._versions()
        top = seen.filter(F.col("store") == store).agg(F.max("version")).first()[0] if seen is not None else None
        return -1 if top is None else int(top)

    def table(self, store: str) -> DataFrame | None:
        """The last version of a store, None where nothing was put."""
        v = self._version(store)
        return None if v < 0 else self.spark.read.parquet(f"{self.folder}/{store}/v{v}")

    def _write(self, store: str, df: DataFrame) -> None:
        v = self._version(store) + 1
        df.write.mode("overwrite").parquet(f"{self.folder}/{store}/v{v}")
        self.spark.createDataFrame([(store, v)], "store string, version long").write.mode("append").parquet(f"{self.folder}/versions")

    def put_raw(self, rows: DataFrame, seq: str) -> None:
        """Merge captures: of each field the first value that is not blank, what is stored before what comes. Rows without a key are dropped."""
        keyed = merge.keyed(rows).select("key", F.col(seq).alias("seq"), "place_id", "detail_level", *[F.col(f).cast("string").alias(f) for f in self.fields], F.lit(1).cast("long").alias("hits"))
        stored = self.table("raw")
        both = keyed.withColumn("put", F.lit(1)) if stored is None else stored.withColumn("put", F.lit(0)).unionByName(keyed.withColumn("put", F.lit(1)))
        order = F.struct("put", "seq")
        first = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", order)).alias(c)
        rank = F.max(F.struct(merge.level_rank(F.col("detail_level")).alias("r"), F.col("detail_level").alias("l")))["l"].alias("detail_level")
        self._write("raw", both.groupBy("key").agg(F.min("seq").alias("seq"), first("place_id"), rank, *[first(f) for f in self.fields], F.sum("hits").alias("hits")))

    def put(self, store: str, rows: DataFrame) -> None:
        """Put rows by key in the stores of accepted or rejected places; a row replaces the stored one."""
        if store not in ("final", "rejected"):
            raise ValueError(f"no such store: {store}")
        stored = self.table(store)
        fresh = rows.filter("key is not null").dropDuplicates(["key"])
        self._write(store, fresh if stored is None else fresh.unionByName(stored.join(fresh.select("key"), "key", "left_anti"), allowMissingColumns=True))

    def get(self, place_ids: DataFrame) -> DataFrame:
        """The captures of the listed place ids; ids that are not stored give nothing."""
        return self.table("raw").join(place_ids.select("place_id").distinct(), "place_id", "left_semi")

    def page(self, store: str, offset: int, limit: int) -> DataFrame:
        """A page of a store in the order of keys."""
        return self.table(store).orderBy("key").offset(offset).limit(limit)

    def stats(self) -> DataFrame:
        """(store, n_rows, hits, pending): rows of each store; of captures also their hits and how many still need a card."""
        out = None
        for s in STORES:
            t = self.table(s)
            hits, pending = (F.coalesce(F.sum("hits"), F.lit(0)), F.count_if(merge.needs_card(t))) if s == "raw" and t is not None else (F.lit(0).cast("long"), F.lit(0).cast("long"))
            one = self.spark.createDataFrame([(s, 0, 0, 0)], "store string, n_rows long, hits long, pending long") if t is None else t.agg(F.count("*").alias("n_rows"), hits.alias("hits"), pending.alias("pending")).select(F.lit(s).alias("store"), "n_rows", "hits", "pending")
            out = one if out is None else out.unionByName(one)
        return out

    def clear(self, *stores: str) -> None:
        """Empty stores; clearing captures also empties what is made from them."""
        for s in dict.fromkeys(x for name in stores for x in (name, *STORES[name])):
            if (t := self.table(s)) is not None:
                self._write(s, t.limit(0))
