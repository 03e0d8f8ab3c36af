"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class first. Every tree splits the classes by random directions at
the median, again and again; what lies near a split goes to both sides (spill). Dense
groups are not cut: they stay in one leaf, of any size. Vectors are compared within leaves, and links at or above the cosine are kept: a link counts in
the first leaf that its two vectors share, so links are counted without listing them, and
each leaf sends on no more than one row per vector, to the least member that it is joined
to in this leaf. Leaves with many rows are cut into blocks, and pairs of blocks are
compared apart, so no task holds a whole leaf.

The trees are fitted on at most ``sample_rows`` classes, those with the least hash; all
classes are indexed. Vectors of different dimension are never linked.

Defined cases: vectors that are null, zero, or hold null or non-finite components have no
link and are their own component, as are those of a dimension of one row; repeated rows are
vectors of their own, all linked; a null vec_id stays null and no smaller than any other;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinledger.llm.graph import components
from twinledger.llm.scratch import without, written
from twinledger.llm.vectors import sampled, unit, usable

#: Width of a cut's band, in standard deviations of how far two vectors at the cosine lie apart along a random direction.
_MARGIN = 1.6
#: Directions tried for a node, places of each (shares of the rows), and the share of pairs left that ends the search.
_TRIES, _PLACES, _GOOD = 8, (0.5, 0.4, 0.6, 0.3, 0.7, 0.2, 0.8, 0.1, 0.9), 0.8
_TILE, _HELD = 512, 1024


class Tree:
    """Random splits of unit vectors; leaves are numbered from ``first``.

    Both sides of a cut get the rows within ``spill`` of it, as a share, or within ``margin``
    (over the root of the dimension), as a distance: what links at the cosine asked for then
    mostly stays together, however dense it lies. A cut through a dense group sends much of
    it both ways; another direction or place is taken then, and a node that no cut tried
    leaves with fewer pairs to compare than it has is a leaf.
    """

    def __init__(self, sample: np.ndarray, least: int, spill: float, margin: float, rng: np.random.Generator, first: int):
        self.first, self.leaves = first, 0
        self.least, self.spill, self.margin, self.rng = least, spill, margin / np.sqrt(max(1, sample.shape[1])), rng
        self.root = self._grow(sample, np.ones(len(sample), bool))

    def _cut(self, along: np.ndarray, at: float) -> tuple[float, float, float, float]:
        """Pairs that a cut at a share of the rows leaves, as a share, and the low end, place and high end of its band."""
        low, cut, high = np.quantile(along, [max(0.0, at - self.spill), at, min(1.0, at + self.spill)])
        low, high = min(low, cut - self.margin / 2), max(high, cut + self.margin / 2)
        return (along <= high).mean() ** 2 + (along >= low).mean() ** 2, low, cut, high

    def _split(self, sample: np.ndarray):
        best = (1.0, None, None)
        for attempt in range(_TRIES):
            direction = self.rng.standard_normal(sample.shape[1])
            direction /= np.linalg.norm(direction)
            along = sample @ direction
            for at in _PLACES if attempt else (0.5,):
                found = self._cut(along, at)
                if found[0] < best[0]:
                    best = (found[0], direction, found[1:])
            if best[0] < _GOOD:
                break
        return best[1:]

    def _grow(self, sample: np.ndarray, own: np.ndarray):
        """``sample`` holds the rows that this node gets, ``own`` tells those that no cut has sent both ways."""
        if own.sum() >= 2 * self.least:
            direction, band = self._split(sample)
            if direction is not None:
                low, cut, high = band
                along = sample @ direction
                below, left, right = along <= cut, along <= high, along >= low
                # Rows of one heap can't be split: the node is a leaf then.
                if (along[own] < cut).any() and (along[own] > cut).any():
                    return (direction, low, high, self._grow(sample[left], (own & below)[left]),
                            self._grow(sample[right], (own & ~below)[right]))
        self.leaves += 1
        return self.first + self.leaves - 1

    def leaves_of(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each leaf with the rows that it gets."""
        stack = [(self.root, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(node, int):
                yield node, rows
            elif len(rows):
                direction, low, high, left, right = node
                along = vectors[rows] @ direction
                stack += [(left, rows[along <= high]), (right, rows[along >= low])]


def forest(
    samples: dict[int, np.ndarray], trees: int, least: int, spill: float, least_cosine: float, seed: int,
) -> dict[int, list[Tree]]:
    """Trees per dimension."""
    margin = _MARGIN * np.sqrt(max(0.0, 2 - 2 * least_cosine))
    made, first = {}, 0
    for size, sample in sorted(samples.items()):
        made[size] = []
        for t in range(trees):
            made[size].append(Tree(unit(sample), least, spill, margin, np.random.default_rng([seed, size, t]), first))
            first += made[size][-1].leaves
    return made


def _held(members: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """One column per leaf: 1 where a row is in it."""
    spot = np.minimum(np.searchsorted(leaves, members), len(leaves) - 1)
    row, place = np.nonzero(leaves[spot] == members)
    out = np.zeros((len(members), len(leaves)), np.float32)
    out[row, spot[row, place]] = 1
    return out


def _near(vectors: np.ndarray, left: np.ndarray, right: np.ndarray, least_cosine: float) -> np.ndarray:
    """Which rows of ``left`` and ``right`` are linked; in single precision where that tells."""
    low = vectors.astype(np.float32)
    near = np.zeros((len(left), len(right)), bool)
    for at in range(0, len(left), _TILE):
        rows = left[at:at + _TILE]
        close = low[rows] @ low[right].T
        near[at:at + _TILE] = close >= least_cosine + 1e-4
        i, j = np.nonzero(np.abs(close - least_cosine) <= 2e-4)
        for s in range(0, len(i), 100_000):
            p, q = i[s:s + 100_000], j[s:s + 100_000]
            near[at + p, q] = np.einsum("nd,nd->n", vectors[rows[p]], vectors[right[q]]) >= least_cosine
    near &= left[:, None] != right[None, :]
    return near


def compare_leaf(leaf: int, a: int, b: int, cid: np.ndarray, weight: np.ndarray, block: np.ndarray, vectors: np.ndarray,
                 members: np.ndarray, least_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the weight of links that count here, and the least row of its part of the links.

    ``members`` has each row's leaves, padded with -1. A link of two rows that share a leaf
    below ``leaf`` counts there.
    """
    links, label = np.zeros(len(cid), np.int64), np.arange(len(cid))
    left, right = np.flatnonzero(block == a), np.flatnonzero(block == b)
    near = _near(vectors, left, right, least_cosine)
    rows, columns = near.any(axis=1), near.any(axis=0)
    left, right, near = left[rows], right[columns], near[rows][:, columns]
    earlier = np.where(members < leaf, members, -1)
    shared = np.intersect1d(earlier[left], earlier[right])
    shared = shared[shared >= 0]
    for at in range(0, len(left), _TILE):
        mine = left[at:at + _TILE]
        first = near[at:at + _TILE].copy()
        for s in range(0, len(shared), _HELD):
            few = shared[s:s + _HELD]
            first &= _held(earlier[mine], few) @ _held(earlier[right], few).T == 0
        counted = first.astype(np.float64)
        links[mine] += (counted @ weight[right]).astype(np.int64)
        if a != b:
            links[right] += (weight[mine] @ counted).astype(np.int64)
    # Parts: from each row on to all that it reaches, every row taken once.
    across, free, open_ = np.ascontiguousarray(near.T), np.ones(len(left), bool), np.ones(len(right), bool)
    for seed in range(len(left)):
        if free[seed]:
            front, part = np.array([seed]), []
            free[seed] = False
            while len(front):
                found = np.flatnonzero(near[front].any(axis=0) & open_)
                open_[found] = False
                part += [left[front], right[found]]
                front = np.flatnonzero(across[found].any(axis=0) & free)
                free[front] = False
            part = np.concatenate(part)
            label[part] = np.minimum(label[part], part.min())
    return links, label


def near_duplicates(
    table: DataFrame, least_cosine: float = 0.95, trees: int = 8, leaf_rows: int = 250, spill: float = 0.1,
    sample_rows: int = 20_000, block_rows: int = 4096, seed: int = 11,
) -> DataFrame:
    """``table`` (vec_id, embedding and more) with n_links, component_id and kept."""
    table = without(table, "n_links", "component_id", "kept", "_class", "_links", "_component")
    spark = table.sparkSession
    good = table.filter(usable(F.col("embedding")))
    classes = good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight")).select(
        F.xxhash64("embedding").alias("cid"), "vec_id", "weight", F.col("embedding").cast("array<double>").alias("vector"))
    classes = written(classes, "vector-classes")
    total = classes.count()
    samples = sampled(classes, "vector", sample_rows)
    held = sum(map(len, samples.values()))
    model = spark.sparkContext.broadcast(
        forest(samples, trees, max(4, round(leaf_rows * held / max(total, 1))), spill, least_cosine, seed))

    def assign(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            leaves: list[list[int]] = [[] for _ in vectors]
            ready: list[bytes] = [b""] * len(vectors)
            for size in {len(v) for v in vectors}:
                rows = np.array([i for i, v in enumerate(vectors) if len(v) == size])
                matrix = unit(np.array([vectors[i] for i in rows], np.float64))
                for i, vector in zip(rows, matrix):
                    ready[i] = vector.tobytes()
                if size not in model.value:
                    for i in rows:  # dimensions that the sample lacks: one leaf each
                        leaves[i].append(-size)
                for tree in model.value.get(size, ()):
                    for leaf, inside in tree.leaves_of(matrix):
                        for i in rows[inside]:
                            leaves[i].append(leaf)
            yield pa.RecordBatch.from_arrays(
                [batch.column("cid"), batch.column("weight"), pa.array(ready, pa.binary()), pa.array(leaves, pa.list_(pa.int32()))],
                ["cid", "weight", "vector", "leaves"])

    assigned = written(classes.select("cid", "weight", "vector").mapInArrow(
        assign, "cid long, weight long, vector binary, leaves array<int>"), "vector-leaves")
    exploded = assigned.withColumn("leaf", F.explode("leaves"))
    sizes = written(exploded.groupBy("leaf").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks")), "vector-blocks")
    own = F.pmod(F.xxhash64("cid", "leaf"), F.col("blocks")).cast("int")
    dealt = exploded.join(sizes, "leaf").withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "leaf", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
        "cid", "weight", "block", "vector", "leaves")

    def compare(key, pdf: pd.DataFrame) -> pd.DataFrame:
        leaf, a, b = (int(k) for k in key)
        pdf = pdf.sort_values("cid", ignore_index=True)
        width = max(map(len, pdf["leaves"]))
        members = np.full((len(pdf), width), -1)
        for i, leaves in enumerate(pdf["leaves"]):
            members[i, :len(leaves)] = leaves
        vectors = np.stack([np.frombuffer(v, np.float64) for v in pdf["vector"]])
        cid = pdf["cid"].to_numpy()
        links, label = compare_leaf(leaf, a, b, cid, pdf["weight"].to_numpy(), pdf["block"].to_numpy(), vectors, members, least_cosine)
        tied = label != np.arange(len(label))
        keep = tied | (links > 0)
        return pd.DataFrame({"cid": cid[keep], "links": links[keep], "least": cid[label[keep]]})

    found = written(dealt.groupBy("leaf", "a", "b").applyInPandas(compare, "cid long, links long, least long"), "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("_links"))
    parts = components(found.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    named = classes.select("cid", "vec_id", "weight").join(parts, F.col("cid") == F.col("node"), "left").withColumn(
        "part", F.coalesce("component", "cid"))
    names = named.groupBy("part").agg(F.min("vec_id").alias("_component"))
    result = named.join(names, "part").join(links, "cid", "left").select(
        F.col("cid").alias("_class"), "_component", (F.coalesce("_links", F.lit(0)) + F.col("weight") - 1).alias("_links"))
    hashed = F.when(usable(F.col("embedding")), F.xxhash64("embedding"))
    component = F.coalesce("_component", "vec_id")
    return table.withColumn("_key", hashed).join(result, F.col("_key") == F.col("_class"), "left").select(
        *table.columns, F.coalesce("_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
