"""Sinks on Parquet snapshots.

A table is a folder of snapshots ``v=<n>``; a change writes the next snapshot
and readers take the newest complete one, so a failed job leaves the old state.
Tables partitioned by what a change covers overwrite those partitions instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def working_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder for results of a job, below the shared ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to a working folder and read again: it is computed once, and
    what follows doesn't repeat its plan or lose it with an executor."""
    path = working_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class SnapshotTable:
    """Keyed table with upsert, delete-range-then-append and append."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[2:]) for p in done if p.getName().startswith("v="))

    def exists(self) -> bool:
        return bool(self._versions())

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v={self._versions()[-1]}")

    def _write(self, df: DataFrame) -> None:
        versions = self._versions()
        df.write.mode("overwrite").parquet(f"{self.folder}/v={versions[-1] + 1 if versions else 0}")

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those with equal keys; keys must be unique in ``rows``."""
        old = self.read().join(rows.select(keys), keys, "left_anti") if self.exists() else None
        self._write(rows if old is None else old.unionByName(rows, allowMissingColumns=True))

    def replace_range(self, rows: DataFrame, day: str, keys: list[str]) -> None:
        """Old rows with the keys of the new ones, from their first to their
        last day, go; the new ones are added."""
        if not self.exists():
            return self._write(rows)
        span = rows.agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
        listed = rows.select(keys).distinct().withColumn("__hit", F.lit(True))
        old = self.read().join(F.broadcast(span)).join(listed, keys, "left")  # span is one row
        inside = F.col(day).between(F.col("__a"), F.col("__b")) & F.coalesce("__hit", F.lit(False))
        return self._write(old.filter(~F.coalesce(inside, F.lit(False))).drop("__a", "__b", "__hit").unionByName(rows, allowMissingColumns=True))

    def delete(self, condition: Column) -> None:
        self._write(self.read().filter(~F.coalesce(condition, F.lit(False))))


class PartitionedTable:
    """Keyed table in parts, of which a change rewrites those that it touches.

    ``part`` tells a row's part; in ``upsert`` it must follow from the keys, and in
    ``replace_range`` rise with the day. A change writes the new state of its parts to
    a folder of its own, then the next snapshot of a small table that says where each
    part lies; readers go by its newest complete one, so a failed job leaves the old
    state. One writer at a time; the parts' names fit the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, part: Column):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.part = F.concat(F.lit("p"), F.coalesce(part.cast("string"), F.lit("")))  # never taken for a number or day
        self.parts = SnapshotTable(spark, f"{self.folder}/parts")

    def _lie(self) -> dict[str, str]:
        return {r["part"]: r["folder"] for r in self.parts.read().collect()} if self.parts.exists() else {}

    def _read(self, lie: dict[str, str]) -> DataFrame:
        out = None
        for folder in sorted(set(lie.values())):
            mine = [p for p, f in lie.items() if f == folder]
            rows = self.spark.read.parquet(folder)
            rows = rows.filter(F.col("__part").isin(mine)).drop("__part")  # pruned by folder
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def read(self) -> DataFrame:
        return self._read(self._lie())

    def _write(self, rows: DataFrame, lie: dict[str, str], touched: set[str]) -> None:
        folder = f"{self.folder}/data-{uuid.uuid4().hex}"
        rows.withColumn("__part", self.part).hint("rebalance", "__part").write.partitionBy("__part").parquet(folder)
        now = {**lie, **dict.fromkeys(touched, folder)}  # a part that lost all its rows reads as empty
        self.parts._write(self.spark.createDataFrame(sorted(now.items()), "part string, folder string").coalesce(1))

    def _touched(self, rows: DataFrame) -> set[str]:
        return {r["p"] for r in rows.select(self.part.alias("p")).distinct().collect()}

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those with equal keys; keys must be unique in ``rows``."""
        lie, touched = self._lie(), self._touched(rows)
        old = {p: f for p, f in lie.items() if p in touched}
        kept = self._read(old).join(rows.select(keys), keys, "left_anti") if old else None
        self._write(rows if kept is None else kept.unionByName(rows, allowMissingColumns=True), lie, touched)

    def replace_range(self, rows: DataFrame, day: str, keys: list[str]) -> None:
        """Old rows with the keys of the new ones, from their first to their last
        day, go; the new ones are added."""
        lie, made = self._lie(), self._touched(rows)
        if not made:
            return
        touched = made | {p for p in lie if min(made) <= p <= max(made)}
        old = {p: f for p, f in lie.items() if p in touched}
        if old:
            span = rows.agg(F.min(day).alias("__a"), F.max(day).alias("__b"))
            listed = rows.select(keys).distinct().withColumn("__hit", F.lit(True))
            kept = self._read(old).join(F.broadcast(span)).join(listed, keys, "left")  # span is one row
            inside = F.col(day).between(F.col("__a"), F.col("__b")) & F.coalesce("__hit", F.lit(False))
            rows = kept.filter(~F.coalesce(inside, F.lit(False))).drop("__a", "__b", "__hit").unionByName(rows, allowMissingColumns=True)
        self._write(rows, lie, touched)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def history(df: DataFrame, path: str, stamp: str, column: str = "updated") -> None:
    """The same rows once more, under the time of this run."""
    append(df.withColumn(column, F.lit(stamp).cast("timestamp")), path, [column])


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the partitions that occur in ``df`` and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
