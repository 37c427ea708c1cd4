"""Long (key, field, value) tables to wide ones and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_wide(df: DataFrame, keys: list[str], fields: list[str], field: str = "field", value: str = "value", fill: float | None = None) -> DataFrame:
    """One column per listed field. The list is explicit, so the schema is
    fixed and no job runs to find it; absent fields become null columns."""
    out = df.groupBy(*keys).pivot(field, fields).agg(F.first(value, ignorenulls=True))
    return out if fill is None else out.fillna(fill, subset=fields)


def to_long(df: DataFrame, keys: list[str], fields: list[str], field: str = "field", value: str = "value") -> DataFrame:
    """One row per value that isn't null."""
    return df.unpivot(keys, fields, field, value).filter(F.col(value).isNotNull())


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, if no key repeats."""
    if not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"rows repeat for {keys}")
    return df


def explode_list(df: DataFrame, column: str, name: str) -> DataFrame:
    """A row per element of a list column."""
    return df.withColumn(name, F.explode(column)).drop(column)


def explode_map(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row per entry of a map column."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(column).alias(key, value))


def map_columns(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Entries of a map column as columns of their own."""
    return df.select("*", *[F.col(column)[k].alias(k) for k in keys]).drop(column)


def to_map(key: str, value: str | Column) -> Column:
    """Aggregate: {key: value} of a group."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value) if isinstance(value, str) else value))))


def concat_lists(column: str) -> Column:
    """Aggregate: the lists of a group joined to one."""
    return F.flatten(F.collect_list(column))


def stack_pairs(df: DataFrame, keys: list[str], fields: list[str], left: str, right: str) -> DataFrame:
    """Columns <field>_<left> and <field>_<right> to rows (field, left, right)."""
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_{left}").alias(left), F.col(f"{f}_{right}").alias(right)) for f in fields]))
    return df.select(*keys, rows.alias("r")).select(*keys, "r.*")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns missing in one are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def beside(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Columns of two frames side by side by key (full outer)."""
    return a.join(b, keys, "full")
