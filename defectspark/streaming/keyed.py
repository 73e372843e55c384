"""A keyed table in hash buckets, with a manifest per version: an upsert rewrites the buckets it touches.

Layout below the table's folder: ``data/version=<n>/bucket=<b>`` holds what version ``n`` wrote, and
``manifest/version=<n>`` says for every bucket which version wrote it last. A manifest is written
after its data, so readers see whole versions only, and a version that is written again after a
failure replaces itself. Data that neither the newest manifest nor the one before it names is removed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectspark.sources.versions import drop_versions, latest_version, version_folder


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        """``buckets`` must stay the same for a table; give it as many as its rows need tasks."""
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def manifest(self, below: int | None = None) -> tuple[int, dict[int, int]] | None:
        """The newest whole version (before ``below``) and the version that wrote each of its buckets."""
        version = latest_version(self.spark, self.path, "manifest", below)
        if version is None:
            return None
        rows = self.spark.read.schema("bucket int, version long").parquet(version_folder(self.path, "manifest", version)).collect()
        return version, {r.bucket: r.version for r in rows}

    def _paths(self, places: dict[int, int]) -> list[str]:
        return [f"{version_folder(self.path, 'data', v)}/bucket={b}" for b, v in sorted(places.items())]

    def read(self) -> DataFrame | None:
        """All rows of the newest version; none before the first."""
        newest = self.manifest()
        return self.spark.read.parquet(*self._paths(newest[1])) if newest and newest[1] else None

    def merge(self, rows: DataFrame, order: Sequence[str], version: int) -> list[int]:
        """Write ``version`` from the newest earlier one and return the buckets it wrote.

        Per key the row with the largest ``order`` stays, stored or new, so a late row replaces
        nothing; of equal ones the new one stays.
        """
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        before = self.manifest(below=version)
        places = before[1] if before else {}
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]
        if touched:
            paths = self._paths({b: places[b] for b in touched if b in places})
            both = rows.withColumn("__new", F.lit(True))
            if paths:
                stored = rows.sparkSession.read.schema(rows.schema).parquet(*paths)
                both = stored.withColumn("__new", F.lit(False)).unionByName(both)
            rest = [c for c in rows.columns if c not in self.keys]
            newest = both.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "__new")).alias("__row"))
            newest = newest.select(*self.keys, "__row.*").select(*rows.columns, bucket.alias("bucket"))
            newest.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(version_folder(self.path, "data", version))
        current = places | {b: version for b in touched}
        named = self.spark.createDataFrame(sorted(current.items()), "bucket int, version long")
        named.coalesce(1).write.mode("overwrite").parquet(version_folder(self.path, "manifest", version))
        drop_versions(self.spark, self.path, "data", set(current.values()) | set(places.values()))
        drop_versions(self.spark, self.path, "manifest", {version} | ({before[0]} if before else set()))
        return touched

    def upsert(self, rows: DataFrame, order: Sequence[str]) -> list[int]:
        """``merge`` as the next version."""
        newest = self.manifest()
        return self.merge(rows, order, newest[0] + 1 if newest else 0)
