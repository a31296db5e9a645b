"""Connected components: of arrays in one task, and of an edge table over all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the edges (a[i], b[i])."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def forest(edges: DataFrame) -> DataFrame:
    """Fewer edges(a, b) with the same components: those of one node meet in one task, and each batch becomes stars.

    Where every node of a group comes with many of the group's smaller nodes, most stars have the group's smallest node
    in their middle, and what is left after removing equal edges is about one edge a node.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            names, number = np.unique(ends, return_inverse=True)
            low = names[roots(len(names), number[: len(batch)], number[len(batch) :])]
            other = low != names
            yield pa.RecordBatch.from_arrays([pa.array(names[other]), pa.array(low[other])], ["a", "b"])

    return edges.repartition("a").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b), root the smallest node reachable.

    Labels spread to neighbours and then jump to their label's label, so chains shorten by doubling. Each round is a
    stored table; only whether any label changed comes to the driver. Hubs are joined to one row a node, which
    skew-join handling can split.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        moved = labels.join(near, "node").select("node", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("then"))
        low = F.least("next", "then")
        after = stored(moved.join(jump, "next").select("node", low.alias("root"), (low != F.col("root")).alias("changed")), "labels")
        labels = after.select("node", "root")
        if not after.where("changed").limit(1).count():
            return labels

