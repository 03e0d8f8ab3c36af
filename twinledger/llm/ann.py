"""Nearest neighbours by largest inner product: inverted lists scanned dimension by dimension.

Rows go to the list of their nearest centroid; a query probes the lists of its nearest
centroids, until these hold a share ``probe_share`` of all rows and ``least_rows`` rows (the
default share suits vectors without clusters, where no smaller one finds 0.9 of the
neighbours; clustered ones need less). Within a list
the vectors are rotated by a random orthogonal matrix and read in blocks of columns. After
each block the distance so far, scaled to all dimensions, estimates the whole one; where a
test at ``epsilon`` says that it exceeds what the query's k-th best so far allows, the
candidate is abandoned. Those that are left get their inner product on the original
vectors in double precision.

Rows are placed with one column more, the root of M * M - |x| * |x|, where M is the largest
length in the table, and queries at length M with a zero there: the nearest are then those
of the largest inner product, whatever the lengths.

Centroids are fitted on at most ``sample_rows`` rows, those with the least hash; all rows
are indexed. Lists are cut into blocks of rows, and the queries of a list into blocks of
queries, so no task holds a whole list. Vectors of different dimension are not compared.

Defined cases: null, zero and non-finite vectors and rows without vec_id take no part;
equal scores go to the smaller vec_id; rows with the query's own vec_id are not its
candidates; repeated rows count once. Several vectors under one vec_id are one query,
answered by the neighbours of all of them, and one neighbour, by its best score. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinledger.llm.scratch import written
from twinledger.llm.vectors import sampled, usable


def centroids(sample: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centres, 1)[:, 0]
        sums, held = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def nearest(vectors: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = []
    for at in range(0, len(vectors), 1024):
        far = (centres * centres).sum(axis=1) - 2 * vectors[at:at + 1024] @ centres.T
        out.append(np.argsort(far, axis=1, kind="stable")[:, :k])
    return np.concatenate(out) if out else np.zeros((0, k), int)


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Rows with a last column that makes all of them as long as the longest."""
    rest = np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0)
    return np.concatenate([vectors, np.sqrt(rest)[:, None]], axis=1)


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([seed, size]).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _best(asks: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best ids, by query, best first; ties to the smaller id."""
    order = np.lexsort((-scores, ids, asks))
    again = (asks[order][1:] == asks[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    order = order[np.concatenate([[True], ~again])[:len(order)]]
    order = order[np.lexsort((ids[order], -scores[order], asks[order]))]
    head = np.searchsorted(asks[order], asks[order], "left")
    return order[np.arange(len(order)) - head < k]


def scan(queries: np.ndarray, owns: np.ndarray, rows: np.ndarray, ids: np.ndarray, turn: np.ndarray,
         k: int, step: int, epsilon: float, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows for each query: the query's place, the row's id and the score.

    A first block of rows is compared whole and gives each query its bound; of the others, the
    columns are read block by block, and a candidate is dropped as soon as its distance so far
    rules it out. Rows that no query wants any more are not read further.
    """
    size = rows.shape[1]
    turned, turned_queries = rows @ turn, queries @ turn
    squares, lengths = (rows * rows).sum(axis=1), (queries * queries).sum(axis=1)
    asks, found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = np.full(len(queries), -np.inf)
    for at in range(0, len(rows), block):
        part = np.arange(at, min(at + block, len(rows)))
        alive = ids[part][None, :] != owns[:, None]
        if at == 0 and len(part) > k and len(np.unique(ids[part])) == len(part):
            whole = np.where(alive, queries @ rows[part].T, -np.inf)
            alive &= whole >= np.partition(whole, len(part) - k, axis=1)[:, [len(part) - k]] - 1e-9
        elif np.isfinite(bound).any():
            room = lengths[:, None] + squares[part][None, :] - 2 * bound[:, None]
            far = np.zeros(alive.shape)
            for d in range(0, size, step):
                a, b = turned_queries[:, d:d + step], turned[part, d:d + step]
                far += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
                seen = min(d + step, size)
                slack = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < size else 1.0
                alive &= far * (size / seen) <= np.maximum(room, 0) * slack + 1e-9 * (1 + lengths[:, None] + squares[part][None, :])
                wanted = alive.any(axis=0)
                if not wanted.all():
                    part, alive, far, room = part[wanted], alive[:, wanted], far[:, wanted], room[:, wanted]
        ask, row = np.nonzero(alive)
        row = part[row]
        asks, found = np.concatenate([asks, ask]), np.concatenate([found, ids[row]])
        scores = np.concatenate([scores, (rows[row] * queries[ask]).sum(axis=1)])
        keep = _best(asks, scores, found, k)
        asks, found, scores = asks[keep], found[keep], scores[keep]
        full = np.flatnonzero(np.bincount(asks, minlength=len(queries)) == k)
        bound[full] = scores[np.searchsorted(asks, full, "right") - 1]
    return asks, found, scores


def search(
    table: DataFrame, is_query: Column, k: int = 20, probe_share: float = 0.65, least_rows: int = 2000, sample_rows: int = 20_000,
    step: int = 16, epsilon: float = 2.1, block_rows: int = 8192, block_queries: int = 2048, seed: int = 23,
) -> DataFrame:
    """Per query of ``table`` (vec_id, embedding) and neighbour found: query_id, rank, vec_id, score."""
    spark = table.sparkSession
    good = table.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    samples = sampled(good, "vector", sample_rows)
    square = F.aggregate("vector", F.lit(0.0), lambda held, x: held + x * x)
    of_size = good.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.sqrt(F.max(square)).alias("longest")).collect()
    total, longest = sum(r["n"] for r in of_size), {r["size"]: r["longest"] for r in of_size}
    lists = int(min(1024, max(1, round(total ** 0.5 / 2))))
    rng = np.random.default_rng(seed)
    model = {d: centroids(lengthened(s, longest[d]), lists, rng) for d, s in sorted(samples.items())}
    shared = spark.sparkContext.broadcast(model)

    def batch_vectors(batch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        vectors = batch.column("vector").to_pylist()
        for size in sorted({len(v) for v in vectors}):
            rows = np.array([i for i, v in enumerate(vectors) if len(v) == size])
            yield size, rows, np.array([vectors[i] for i in rows], np.float64)

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, matrix in batch_vectors(batch):
                centres = shared.value.get(size)
                where = nearest(lengthened(matrix, longest[size]), centres, 1)[:, 0] if centres is not None else np.zeros(len(rows), int)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), size, np.int32)),
                     pa.array(where.astype(np.int32)), pa.array([v.tobytes() for v in matrix], pa.binary()),
                     batch.column("asks").take(pa.array(rows))], ["vec_id", "size", "list", "vector", "asks"])

    placed = written(good.mapInArrow(place, "vec_id long, size int, list int, vector binary, asks boolean"), "ann-lists")
    counted = placed.groupBy("size", "list").agg(F.count("*").alias("n")).collect()  # one row per list
    held: dict[int, np.ndarray] = {}
    for r in counted:
        held.setdefault(r["size"], np.zeros(len(model.get(r["size"], [0])), np.int64))[r["list"]] = r["n"]
    held_shared = spark.sparkContext.broadcast(held)

    def probe(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(batch.column("size").to_pylist())
            vectors = batch.column("vector").to_pylist()
            for size in sorted(set(sizes.tolist())):
                rows = np.flatnonzero(sizes == size)
                centres = shared.value.get(size)
                held = held_shared.value[size]
                if centres is None:
                    near = np.zeros((len(rows), 1), int)
                else:
                    asked = np.stack([np.frombuffer(vectors[i], np.float64) for i in rows])
                    asked = asked * (longest[size] / np.sqrt((asked * asked).sum(axis=1, keepdims=True)))
                    near = nearest(np.pad(asked, ((0, 0), (0, 1))), centres, len(centres))
                sums = np.cumsum(held[near], axis=1)
                wanted = 1 + (sums < max(least_rows, probe_share * held.sum())).sum(axis=1)
                pairs = [(i, c) for i, found, w in zip(rows, near, wanted) for c in found[:w]]
                take = pa.array([i for i, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).take(take) for n in ("vec_id", "size", "vector")] + [pa.array([c for _, c in pairs], pa.int32())],
                    ["vec_id", "size", "vector", "list"])

    asked = placed.filter("asks").select("vec_id", "size", "vector").distinct().mapInArrow(
        probe, "vec_id long, size int, vector binary, list int")
    asked = written(asked, "ann-probes")
    row_blocks = placed.groupBy("size", "list").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("row_blocks"))
    query_blocks = asked.groupBy("size", "list").agg(F.ceil(F.count("*") / block_queries).cast("int").alias("query_blocks"))
    blocks = written(row_blocks.join(query_blocks, ["size", "list"]), "ann-blocks")

    def dealt(side: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        block = F.pmod(F.xxhash64("vec_id", "vector"), F.col(own)).cast("int")
        return side.join(blocks, ["size", "list"]).select(
            "size", "list", block.alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other),
            F.lit(asks).alias("asks"), "vec_id", "vector").select("size", "list", "row_blocks", "query_blocks", "asks", "vec_id", "vector")

    groups = dealt(placed, "row_blocks", "query_blocks", False).union(dealt(asked, "query_blocks", "row_blocks", True))

    def look(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id")
        asks = pdf["asks"].to_numpy()
        matrix = np.stack([np.frombuffer(v, np.float64) for v in pdf["vector"]])
        ids, rows, queries = pdf["vec_id"].to_numpy()[~asks], matrix[~asks], matrix[asks]
        turn, owns = rotation(matrix.shape[1], seed), pdf["vec_id"].to_numpy()[asks]
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        for at in range(0, len(queries), 128):
            ask, found, scores = scan(queries[at:at + 128], owns[at:at + 128], rows, ids, turn, k, step, epsilon)
            out.append(pd.DataFrame({"query_id": owns[at:at + 128][ask], "vec_id": found, "score": scores}))
        return pd.concat(out)

    found = groups.groupBy("size", "list", "row_blocks", "query_blocks").applyInPandas(look, "query_id long, vec_id long, score double")
    best = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
