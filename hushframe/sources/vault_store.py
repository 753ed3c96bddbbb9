"""The vault on disk: generations are appended, nothing that was written is written again.

Entries and seen marks are two tables bucketed by scope, kind and value, so that neither minting
nor lookup shuffles what is stored. A generation counts once its row stands in the manifest, which
is written last: a mint that fails leaves the vault as it was, and the next attempt finds the
numbers it had given and gives them again to the same values.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialized
from ..operators.vault import newly_minted

KEY = ("scope", "kind", "value")
ENTRIES = "scope string, handle string, kind string, value string, n bigint, gen bigint"
SEEN = "scope string, kind string, value string, gen bigint"
MANIFEST = "gen bigint, minted bigint, seen bigint"


class VaultStore:
    """A vault under ``path``; ``buckets`` holds for its life and should be no fewer than a session's shuffle partitions, else Spark deals the stored side anew."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._name = f"vault_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        where = self.path.replace("\\", "\\\\").replace("'", "\\'")
        for table, columns in (("entries", ENTRIES), ("seen", SEEN)):
            # The catalogue of a session may not know the tables yet; files carry their bucket in their name.
            spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name}_{table} ({columns}) USING parquet CLUSTERED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS LOCATION '{where}/{table}'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name}_manifest ({MANIFEST}) USING parquet LOCATION '{where}/manifest'")

    def _table(self, name: str) -> DataFrame:
        self.spark.catalog.refreshTable(f"{self._name}_{name}")
        return self.spark.table(f"{self._name}_{name}")

    def generations(self) -> DataFrame:
        """``gen, minted, seen`` of every generation that was completed."""
        return self._table("manifest").groupBy("gen").agg(F.max("minted").alias("minted"), F.max("seen").alias("seen"))

    def _done(self) -> list[int]:
        """Completed generations; one number for each mint."""
        return sorted(r["gen"] for r in self.generations().collect())

    def vault(self) -> DataFrame:
        """``scope, handle, kind, value, n, seen_gen`` as of the last completed generation."""
        done = self._done()
        entries = self._table("entries").where(F.col("gen").isin(done))
        marks = self._table("seen").where(F.col("gen").isin(done)).groupBy(*KEY).agg(F.max("gen").alias("_seen"))
        met = entries.join(marks.hint("merge"), list(KEY), "left")
        return met.select("scope", "handle", "kind", "value", "n", F.greatest("gen", F.coalesce("_seen", F.col("gen"))).alias("seen_gen"))

    def mint(self, found: DataFrame, scope: str, order: list[str], gen: int, tag: str = "") -> None:
        """Gives numbers to values that have none and marks what ``found`` saw as seen in ``gen``; done twice, it changes nothing more.

        Numbers of attempts that were not completed count too, so that none is given twice.
        """
        known = self._table("entries")
        found = materialized(found.select(scope, "kind", "text", *dict.fromkeys(order)))
        minted, seen = newly_minted(found, known, scope, order, gen, tag)
        before = self._table("seen").where(F.col("gen") == gen).select(*KEY)
        # What comes from the stored tables is worked out before these are written to.
        minted = materialized(minted.select("scope", "handle", "kind", "value", "n", F.col("seen_gen").alias("gen")))
        marks = materialized(seen.join(before.hint("merge"), list(KEY), "left_anti").select(*KEY, F.lit(gen).cast("long").alias("gen")))
        for rows, table in ((minted, "entries"), (marks, "seen")):
            rows.repartition(self.buckets, *KEY).write.insertInto(f"{self._name}_{table}")
        self._complete(gen)

    def _complete(self, gen: int) -> None:
        counts = [self._table(t).where(F.col("gen") == gen).count() for t in ("entries", "seen")]
        self.spark.createDataFrame([(gen, *counts)], MANIFEST).coalesce(1).write.insertInto(f"{self._name}_manifest")
