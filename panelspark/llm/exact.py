"""Exact dedup against a persistent digest index; DataFrame functions only.

The index is a folder with one row per digest, bucketed and sorted by the
digest. An increment of documents is reduced to one row per digest first
(map-side combine, so a group of equal texts never meets in one task), then
sort-merge anti-joined with the index and appended to it. Bucketing spares the
index its shuffle. Any session opens an index by its path: a small table beside
the digests states its form, and the digests are registered before anything is
written, so an index that exists is never overwritten. One writer at a time.

Whole tables are loaded in increments of falling ids, so that the document
which the index holds for a text, the first that came, is the one with the
largest id; the anti-join with what came before decides who stays.

Labelling rows joins ids and digests with their group. Groups above
``1 / HEAVY`` of all rows number at most ``HEAVY`` and are broadcast; all other
groups are small enough for a sort-merge join without skew.

Edge cases: null text counts as empty (all empty texts are one group); a null
document id sorts below all others and stays only if its group has no other;
repeated rows (same id and text) are a tie, of which exactly one row is kept;
an empty table gives an empty result; other columns are passed on, whatever
their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, materialize, shared_dir, table

#: Digests of a bucket (some 100 MB) when an index is created.
BUCKET_ROWS = 2_000_000
HEAVY = 1000
#: Increments of a first load, and ids that are looked at to part it evenly.
INCREMENTS, PIVOTS = 2, 31


def digest(text_col: str = "text") -> Column:
    """SHA-256 (lowercase hex) of the text in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, row), written to the shared folder; ``row`` tells repeated
    rows apart."""
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), digest(text_col).alias("digest"))
    return materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "digests")


def group_by_digest(rows: DataFrame) -> DataFrame:
    """(id, digest, row) -> one row per digest: keep_id, keep_row, ties, group_size.

    ``ties`` counts the rows that carry the id which stays, ``keep_row`` is one
    of them. Both steps combine on the map side.
    """
    by_id = rows.groupBy("digest", "id").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    best = F.max(F.struct("id", "n", "row"))
    return by_id.groupBy("digest").agg(
        best["id"].alias("keep_id"), best["row"].alias("keep_row"), best["n"].alias("ties"), F.sum("n").alias("group_size")
    )


class DigestIndex:
    """A digest index in a folder of the shared storage: ``about`` holds its
    form, ``digests`` the bucketed, sorted rows (digest, keep_id)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = (path or shared_dir(spark, "digest-index")).rstrip("/")
        self.name = f"digest_index_{hashlib.md5(self.path.encode()).hexdigest()}"
        try:
            about = spark.read.parquet(f"{self.path}/about").first()
        except AnalysisException:  # nothing there yet
            about = None
        self.exists = about is not None
        if about:
            self.buckets = about["buckets"]
            self._register(about["id_type"])

    def _register(self, id_type: str) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> None:
        """Takes the table out of the session's catalogue; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index doesn't hold (sort-merge anti-join)."""
        if not self.exists:
            return groups
        return groups.hint("merge").join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, fresh: DataFrame) -> None:
        """Append groups that the index doesn't hold."""
        if not self.exists:
            # with fewer buckets than shuffle partitions a join would shuffle the index as well
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.buckets = self.buckets or max(least, -(-fresh.count() // BUCKET_ROWS))
            id_type = fresh.schema["keep_id"].dataType.simpleString()
            about = self.spark.range(1).select(F.lit(self.buckets).alias("buckets"), F.lit(id_type).alias("id_type"))
            about.coalesce(1).write.parquet(f"{self.path}/about")  # fails if another index is there
            self._register(id_type)
            self.exists = True
        rows = fresh.select("digest", "keep_id").repartition(self.buckets, "digest")  # one file a bucket
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)

    def append(self, groups: DataFrame) -> DataFrame:
        """The groups (digest, keep_id, ...) that are new to the index, which
        holds them from now on. They are written to the shared folder before the
        index changes, so reading the result again gives the same rows."""
        fresh = materialize(self.fresh(groups), "fresh-digests")
        self._write(fresh)
        return fresh


def new_documents(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents of an increment that are new to ``index``, one per text
    (the largest id); their digests are appended to the index."""
    return keep_one(docs, index.append(group_by_digest(digests(docs, id_col, text_col))), id_col, text_col)


def increments(rows: DataFrame, parts: int = INCREMENTS) -> list[DataFrame]:
    """``rows`` parted by falling id, null ids last, at ids picked by hash."""
    ids = rows.filter("id IS NOT NULL").select("id").orderBy(F.xxhash64("id"), "id").limit(PIVOTS)
    ids = sorted(r["id"] for r in ids.collect())  # at most PIVOTS rows
    pivots = sorted({ids[len(ids) * i // parts] for i in range(1, parts)}, reverse=True) if ids else []
    out, below = [], F.lit(True)
    for p in pivots:
        out.append(rows.filter(below & (F.col("id") >= F.lit(p))))
        below = F.col("id") < F.lit(p)
    return [*out, rows.filter(below | F.col("id").isNull())]


def load(rows: DataFrame, index: DigestIndex, parts: int = INCREMENTS) -> DataFrame:
    """Append (id, digest, row) to ``index`` in increments of falling id; returns
    the groups that were new to it, ``group_size`` counting all increments."""
    each = [materialize(group_by_digest(x), "digest-groups") for x in increments(rows, parts)]
    fresh = [index.append(x) for x in each]
    sizes = reduce(DataFrame.unionByName, each).groupBy("digest").agg(F.sum("group_size").alias("group_size"))
    fresh = reduce(DataFrame.unionByName, fresh).drop("group_size")
    return materialize(fresh.join(sizes.hint("merge"), "digest"), "digest-groups")


def exact_groups(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept,
    text_sha256; ``index``, empty before, holds all texts afterwards.

    Only ids and digests are joined; the texts are read once.
    """
    rows = digests(docs, id_col, text_col)
    groups = load(rows, index)
    limit = max(rows.count() // HEAVY, 1)
    heavy = F.broadcast(groups.filter(F.col("group_size") > limit))  # at most HEAVY rows
    rest = groups.filter(F.col("group_size") <= limit)
    spread = rows.join(heavy.select("digest"), "digest", "left_anti").hint("merge").join(rest.hint("merge"), "digest")
    return rows.join(heavy, "digest").unionByName(spread).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; groups not listed in
    ``groups`` don't stay. The texts are shuffled once, by id and digest."""
    d, keep, of = (free_name(docs, x) for x in ("__digest", "__keep", "__of"))
    names = [F.col(f"`{c}`") for c in docs.columns]

    def those(ties: Column) -> DataFrame:
        picked = groups.filter(ties).select(F.col("keep_id").alias(keep), F.col("digest").alias(of)).hint("merge")
        same = F.col(f"`{id_col}`").eqNullSafe(F.col(keep)) & (F.col(d) == F.col(of))
        return docs.withColumn(d, digest(text_col)).hint("merge").join(picked, same, "left_semi")

    once, tied = those(F.col("ties") == 1).select(names), F.col("ties") > 1
    if groups.filter(tied).isEmpty():
        return once
    return once.unionByName(those(tied).dropDuplicates([id_col, d]).select(names))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of equal texts (the largest id), by way of a
    new digest index."""
    index = DigestIndex(docs.sparkSession)
    groups = load(digests(docs, id_col, text_col), index)
    index.close()
    return keep_one(docs, groups, id_col, text_col)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark)
    out = exact_groups(table(spark, sf_dir, "documents"), index)
    index.close()
    return out


OP10_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
