"""Connected components by minimum labels and pointer jumping.

Labels live in tables in the shared folder; no link or label comes to the
driver but for the count of changes. A vertex that takes part in many links is
reduced by map-side minima before each shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, release


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of links (a, b) and the least vertex of each one's component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while len(left):
        low = label.copy()
        np.minimum.at(low, left, label[right])
        np.minimum.at(low, right, label[left])
        np.minimum.at(low, label[left], label[right])
        np.minimum.at(low, label[right], label[left])
        while True:
            jumped = low[low]
            if (jumped == low).all():
                break
            low = jumped
        if (low == label).all():
            break
        label = low
    return names, names[label]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links -> a star for each component among the links of a batch."""
    for batch in batches:
        v, low = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
        far = v != low
        yield pa.RecordBatch.from_arrays([pa.array(v[far], pa.int64()), pa.array(low[far], pa.int64())], ["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """Links (a, b: long) -> v, label: each linked vertex, the least it reaches.

    Vertices without links don't appear. An empty table gives an empty table.
    """
    edges = materialize(links.select("a", "b").mapInArrow(_contract, "a long, b long"), "links")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")), "labels")
    while True:
        # each label hears of the least label beside any of its vertices
        low = labels.select(F.col("v").alias("a"), F.col("label").alias("la"))
        high = labels.select(F.col("v").alias("b"), F.col("label").alias("lb"))
        met = edges.join(low, "a").join(high, "b").where("la <> lb")
        if met.limit(1).count() == 0:
            return labels
        hooks = met.select(F.greatest("la", "lb").alias("label"), F.least("la", "lb").alias("to")).groupBy("label").agg(F.min("to").alias("to"))
        hooks = materialize(hooks, "hooks")
        # roots that hook on roots that hook: jump until only roots are left
        while True:
            on = hooks.select(F.col("label").alias("to"), F.col("to").alias("_next"))
            further = hooks.join(on, "to", "left").select("label", F.coalesce("_next", "to").alias("to"), F.col("_next").isNotNull().alias("_moved"))
            further = materialize(further, "hooks")
            moved = further.where("_moved").limit(1).count()
            release(hooks)
            hooks = further.drop("_moved")
            hooks._titleforge_path = further._titleforge_path
            if not moved:
                break
        new = materialize(labels.join(hooks, "label", "left").select("v", F.coalesce("to", "label").alias("label")), "labels")
        release(labels)
        release(hooks)
        labels = new
