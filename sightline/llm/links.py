"""Connected components of links between texts or vectors.

Every node hooks to its least neighbour, chains are shortened by pointer jumping, and the links are
renamed to the roots until none is left.  Grouped minima are combined map-side; every join reads two
written tables, one of which has a row per node, so adaptive execution can split a hub's rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import by_value
from sightline.session import reliable_checkpoint


def _roots(parents: DataFrame) -> DataFrame:
    """Shorten ``(node, parent)`` until every parent is a root."""
    while True:
        above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
        moved = reliable_checkpoint(
            parents.join(above, "parent")
            .select("node", F.col("_up").alias("parent"), (F.col("_up") != F.col("parent")).alias("moved"))
        )
        parents = moved.select("node", "parent")
        if not moved.where("moved").limit(1).count():
            return parents


def linked_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the BIGINT links ``(u, v)``; the root is its least node."""
    links = reliable_checkpoint(
        links.where(F.col("u") != F.col("v"))
        .select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.*").distinct()
    )
    labels = None
    while labels is None or links.limit(1).count():
        parents = links.groupBy("u").agg(F.min("v").alias("v")).select(
            F.col("u").alias("node"), F.least("u", "v").alias("parent")
        )
        parents = _roots(reliable_checkpoint(parents))
        if labels is None:
            labels = parents.withColumnRenamed("parent", "root")
        else:
            over = parents.select(F.col("node").alias("root"), F.col("parent").alias("_up"))
            labels = reliable_checkpoint(
                labels.join(over, "root", "left").select("node", F.coalesce("_up", "root").alias("root"))
            )
        for end in ("u", "v"):
            named = parents.select(F.col("node").alias(end), F.col("parent").alias("_to"))
            links = links.join(named, end).select(*[F.col("_to" if c == end else c).alias(c) for c in ("u", "v")])
            links = links.where(F.col("u") != F.col("v")).distinct() if end == "v" else reliable_checkpoint(links)
        links = reliable_checkpoint(links)
    return labels


def spanning_forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Those pairs of rows that join parts not joined before: fewer than ``n``, and they link what all do."""
    parent = np.arange(n)
    out = []
    for left, right in pairs:
        apart = parent[left] != parent[right]
        joined = False
        for a, b in zip(left[apart].tolist(), right[apart].tolist(), strict=True):
            ra, rb = a, b
            while parent[ra] != ra:
                ra = parent[ra]
            while parent[rb] != rb:
                rb = parent[rb]
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                out.append((a, b))
                joined = True
        while joined:
            up = parent[parent]
            joined = bool((up != parent).any())
            parent = up
    return out


by_value(__name__)
