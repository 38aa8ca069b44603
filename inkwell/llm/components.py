"""Connected components of an edge table, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import common


def connected_components(edges: DataFrame, folder: str) -> DataFrame:
    """edges: a long, b long. A row (node, label) for each node; label is the smallest node of its component.

    Each round hooks a node to the least of its neighbours, follows the hooks to their roots by doubling, and puts roots
    in the place of nodes; edges within one root go. What is left has at most half of the nodes, so a dense group is one
    root after a round and a chain of n edges takes about log n rounds. Rounds are written to the folder; no edge or
    label comes to the driver.
    """
    ends = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    pairs = common.materialized(edges.where("a <> b").select(*ends).distinct(), f"{folder}/edges-0")
    found, k = None, 0
    while True:
        k += 1
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        labels, j = common.materialized(labels, f"{folder}/labels-{k}-0"), 0
        while True:
            j += 1
            up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jumped = labels.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") < F.col("label")).alias("moved"))
            jumped = common.materialized(jumped, f"{folder}/labels-{k}-{j}")
            labels = jumped.select("node", "label")
            if not jumped.where("moved").limit(1).count():
                break
        if found is None:
            found = labels
        else:
            roots = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
            found = found.join(roots, "label", "left").select("node", F.coalesce("root", "label").alias("label"))
            found = common.materialized(found, f"{folder}/found-{k}")
        one = pairs.join(labels.select(F.col("node").alias("a"), F.col("label").alias("root_a")), "a")
        two = one.join(labels.select(F.col("node").alias("b"), F.col("label").alias("root_b")), "b").where("root_a <> root_b")
        pairs = common.materialized(two.select(F.greatest("root_a", "root_b").alias("a"), F.least("root_a", "root_b").alias("b")).distinct(), f"{folder}/edges-{k}")
        if not pairs.limit(1).count():
            return found
