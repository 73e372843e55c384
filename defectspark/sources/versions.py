"""Numbered version folders on any Hadoop file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence through the Hadoop file system, so any mounted store works."""
    system, target = _place(spark, path)
    return system.exists(target)


def version_folder(path: str, kind: str, version: int) -> str:
    return f"{path.rstrip('/')}/{kind}/version={version:010d}"


def versions(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the version folders below ``path/kind``, whole or not."""
    system, folder = _place(spark, f"{path.rstrip('/')}/{kind}")
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def latest_version(spark: SparkSession, path: str, kind: str, below: int | None = None) -> int | None:
    """The newest version (before ``below``) whose writer has finished."""
    for version in reversed(versions(spark, path, kind)):
        if (below is None or version < below) and path_exists(spark, f"{version_folder(path, kind, version)}/_SUCCESS"):
            return version
    return None


def drop_versions(spark: SparkSession, path: str, kind: str, kept: set[int]) -> None:
    """Remove versions older than the newest kept one that are not kept."""
    for version in versions(spark, path, kind):
        if version not in kept and version < max(kept, default=0):
            system, folder = _place(spark, version_folder(path, kind, version))
            system.delete(folder, True)
