"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, label), label being the least node that
    is reachable; only nodes with a link appear.

    A round passes each label to the neighbours (map-side minimum) and then
    replaces it by its own label, which halves the way to the root. A node
    with many links is only ever one side of an inner join, so Spark can split
    it. Rounds are written to the shared folder; the driver sees one count.
    """
    both = edges.filter("a <> b").select("a", "b")
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = materialize(labels, "labels")
    while True:
        heard = (
            both.join(labels, both.a == labels.node)
            .groupBy(F.col("b").alias("node"))
            .agg(F.min("label").alias("heard"))
        )
        nearer = labels.join(heard, "node").select(
            "node", F.least("label", "heard").alias("label"), F.col("label").alias("was")
        )
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = nearer.join(root, "label").select("node", F.least("label", "up").alias("label"), "was")
        now = materialize(jumped, "labels")
        if now.filter("label <> was").isEmpty():
            return now.select("node", "label")
        labels = now.select("node", "label")
