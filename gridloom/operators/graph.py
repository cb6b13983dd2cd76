"""Connected components and greedy suppression over tables of edges.

Both first do what they can inside partitions, then go in rounds over the whole table, and end in
one task as soon as the edges left are few enough for it; results never depend on where that is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.common import checkpoint

#: Edges worked off at once inside a partition, and edges that one task may end with (32 MB).
LOCAL_EDGES, FINISH_EDGES = 1_000_000, 2_000_000


def _schema(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*columns).schema)


def _batched(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += len(b)
        if size >= rows:
            yield pd.concat(held, ignore_index=True)
            held, size = [], 0
    if size:
        yield pd.concat(held, ignore_index=True)


def _least(keys: list[str], rows: int):
    """Edges (keys, u, v) as a star for each connected group: every node u with the least node v of its group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for e in _batched(batches, rows):
            both = pd.concat([e[[*keys, c]].rename(columns={c: "id"}) for c in ("u", "v")], ignore_index=True)
            groups = both.groupby([*keys, "id"], sort=True)
            code = groups.ngroup().to_numpy()
            nodes = both.iloc[np.unique(code, return_index=True)[1]].reset_index(drop=True)
            a, b = code[: len(e)], code[len(e) :]
            own = np.arange(len(nodes))
            while len(a):
                low = np.minimum(own[a], own[b])
                np.minimum.at(own, own[a], low)
                np.minimum.at(own, own[b], low)
                while ((jump := own[own]) != own).any():
                    own = jump
                apart = own[a] != own[b]
                a, b = a[apart], b[apart]
            far = own != np.arange(len(own))
            yield nodes[far].rename(columns={"id": "u"}).assign(v=nodes.id.to_numpy()[own[far]])

    return run


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60, keys: list[str] = []) -> DataFrame:
    """keys, id, component: the least id that each node is connected to.

    ``nodes``: keys, id; ``edges``: keys, a, b (either order, repeats allowed, null ends ignored).
    ``keys`` (as raster_id) belong to the identity of a node; edges stay within them.  Partitions
    shrink their edges to stars first.  What is then too much for one task goes through rounds of
    large-star and small-star (Kiveris et al., 2014), which shrink paths exponentially; each
    round's edges are checkpointed.  Only a count and a checksum reach the driver.
    """
    fields = [*keys, "u", "v"]
    both = edges.where("a is not null and b is not null and a <> b").select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    schema = _schema(both, fields)
    current = checkpoint(both.mapInPandas(_least(keys, LOCAL_EDGES), schema).distinct())
    previous, at = None, [*keys, "u"]
    for _ in range(max_rounds):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*fields).cast("decimal(38,0)"))).first()
        if state[0] <= FINISH_EDGES:
            current = current.coalesce(1).mapInPandas(_least(keys, FINISH_EDGES), schema)
            break
        if previous == state:
            break
        previous = state
        turned = current.unionByName(current.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        least = turned.groupBy(*at).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: neighbours above a node go to its minimum
        large = turned.join(least, at).where("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and itself, go to its minimum
        low = large.groupBy(*at).agg(F.min("v").alias("m"))
        j = large.join(low, at)
        current = checkpoint(j.where("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(*at, F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError("components did not settle")
    named = [*keys, "id"]
    return nodes.select(*named).distinct().join(current.groupBy(*keys, F.col("u").alias("id")).agg(F.min("v").alias("m")), named, "left").select(*named, F.coalesce("m", "id").alias("component"))


def _losers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of edges (winner, loser) that are all there: the nodes that a surviving winner removes."""
    for e in _batched(batches, 1 << 62):
        code, ids = pd.factorize(np.concatenate([e.winner.to_numpy(), e.loser.to_numpy()]))
        a, b = code[: len(e)], code[len(e) :]
        lost = np.zeros(len(ids), bool)
        while len(a):
            beaten = np.zeros(len(ids), bool)
            beaten[b] = True
            free = ~beaten[a]  # winners that nobody undecided beats
            lost[b[free]] = True
            left = ~free & ~lost[a] & ~lost[b]
            a, b = a[left], b[left]
        yield pd.DataFrame({"id": ids[lost]})


def survivors(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """The rows of ``nodes`` (id) that greedy suppression leaves.

    ``edges``: winner, loser (ids; no cycles, as winners come first in some order): a loser goes if
    one of its winners survives.  In each round nodes without an undecided winner survive and
    remove their losers; edges of decided nodes are dropped.  Chains of any length are followed.
    """
    left = checkpoint(edges.select("winner", "loser").distinct())
    lost = None
    for _ in range(max_rounds):
        if left.count() <= FINISH_EDGES:
            last = left.coalesce(1).mapInPandas(_losers, _schema(nodes, ["id"]))
            lost = last if lost is None else lost.unionByName(last)
            break
        free = left.join(left.select(F.col("loser").alias("winner")).distinct(), "winner", "left_anti")
        new = checkpoint(free.select(F.col("loser").alias("id")).distinct())
        lost = new if lost is None else lost.unionByName(new)
        undecided = left.join(free.select("winner").distinct(), "winner", "left_anti")
        for end in ("winner", "loser"):
            undecided = undecided.join(new.select(F.col("id").alias(end)), end, "left_anti")
        left = checkpoint(undecided.select("winner", "loser"))
    else:
        raise RuntimeError("suppression did not settle")
    return nodes.join(lost.distinct(), "id", "left_anti")
