"""Connected components of links between rows, by repeated aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage


def connected_components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): for every node of ``links`` the smallest node it can reach.

    Each round gives a node the smallest root among its neighbours, then replaces roots by
    their own roots, so long chains halve. Rounds are written to the shared folder. Links
    are only joined with nodes, so a node with many links is many small rows.
    """
    both = links.select(F.col(left).alias("node"), F.col(right).alias("other")).union(
        links.select(F.col(right).alias("node"), F.col(left).alias("other"))
    )
    both = stage(both.distinct(), "links")
    roots = stage(
        both.groupBy("node").agg(F.min("other").alias("root"))
        .select("node", F.least("node", "root").alias("root")),
        "roots",
    )
    while True:
        known = roots.select(F.col("node").alias("other"), F.col("root").alias("seen"))
        near = both.join(known, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        lower = roots.join(near, "node").select(
            "node", "root", F.least("root", "seen").alias("next")
        )
        jump = lower.select(F.col("node").alias("next"), F.col("next").alias("after"))
        lower = stage(
            lower.join(jump, "next", "left").select(
                "node", F.coalesce("after", "next").alias("root"),
                (F.coalesce("after", "next") != F.col("root")).alias("moved"),
            ),
            "roots",
        )
        roots = lower.drop("moved")
        if not lower.filter("moved").limit(1).count():
            return roots
