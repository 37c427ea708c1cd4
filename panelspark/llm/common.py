"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship_package

#: Rows in one Arrow batch. Texts are long, so a batch stays at a few MB.
BATCH_ROWS = 256
#: With this setting a query's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which all executors share.

    Only a single-process local session may run without that setting; it then
    gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = _own_dirs.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries inside remove their shuffle files when they end, unless the user has
    decided on that; else those wait for a garbage collection of the driver, and a job
    of many steps holds them all. The setting is as before afterwards."""
    free = spark.conf.get(CLEANUP, None) is None
    if free:
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if free:
            spark.conf.unset(CLEANUP)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage like ``checkpoint()``, but compressed and by column;
    losing an executor afterwards costs nothing. The shuffles' files go at once.
    """
    path = shared_dir(df.sparkSession, label)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare_python(spark: SparkSession) -> None:
    """Ship the package to the workers and bound the session's Arrow batches,
    unless the user has bounded them already."""
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":  # the default
        spark.conf.set(name, str(BATCH_ROWS))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict], list[tuple]]],
    columns: list[str],
    schema: str,
) -> DataFrame:
    """Arrow map: ``make()`` runs once a task; what it returns maps a row of
    ``columns`` (as a dict) to output tuples in the order of ``schema``.

    Rows stream in batches of ``BATCH_ROWS``, so a task holds one batch only.
    """
    spark = df.sparkSession
    prepare_python(spark)
    fields = arrow_schema(spark, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            out = [row for r in batch.to_pylist() for row in f(r)]
            yield to_batch(out, fields)

    return df.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def to_batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def ddl(df: DataFrame) -> str:
    """The schema of ``df`` as DDL, for operators that pass all columns on."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class TwoGenerations(dict):
    """A cache of at most ``2 * limit`` entries: when the young half is full it
    becomes the old half, and what is used again moves back."""

    def __init__(self, compute: Callable, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value
