"""Approximate nearest neighbours by learned partitions.

For every vector length that has rows for several parts, a bounded sample (`SAMPLE` rows by a
hash of vec_id) gets a neighbour graph; the graph is cut into balanced parts by label
propagation under a size limit; a small network learns to tell a vector's part. Every row of
the table is indexed in its most probable part. A query goes to its most probable parts, as
many as the sample needs for a recall of `WANTED`, and all their rows are reranked by exact
distances. Parts are searched in blocks, so a part with a third of all rows is many tasks.
Vectors of a length with few rows are one part by themselves, searched whole.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without vec_id. Vectors are compared with those of their own length. Ties go to the
smaller vec_id; rows of the query's own vec_id are no candidates. A query reaches further
parts until they hold more than k rows. A repeated query row is answered again, in full. Very
long vectors make blocks of as many rows as short ones. Columns other than vec_id and the
vector are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lorewell.llm.shared import map_batches, parts_for, table, written
from lorewell.llm.vectors import (
    BLOCK, QUERY_BLOCK, block_pairs, blocks, numbered_queries, unpacked, usable_vectors,
)

K = 10
SAMPLE = 8_192
ROWS_PER_PART = 256
MOST_PARTS = 256
NEIGHBOURS = 10
WANTED = 0.98
HIDDEN = 128
EPOCHS = 40
SLACK = 1.1


def neighbour_graph(x: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
    """Numbers of each row's k nearest rows."""
    k = min(k, len(x) - 1)
    norms = (x * x).sum(1)
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        far = norms[None, :] - 2 * x[i : i + 1024] @ x.T
        far[np.arange(len(far)), np.arange(i, i + len(far))] = np.inf
        out[i : i + 1024] = np.argpartition(far, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of every row: halves along main axes first, then label propagation with a size limit."""
    part = np.zeros(len(x), np.int64)
    todo = [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, count = todo.pop()
        if count == 1 or len(rows) < 2:
            part[rows] = first
            continue
        own = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        left = count // 2
        order = rows[np.argsort(own @ axis, kind="stable")]
        cut = len(rows) * left // count
        todo += [(order[:cut], first, left), (order[cut:], first + left, count - left)]
    limit = math.ceil(SLACK * len(x) / parts)
    sizes = np.bincount(part, minlength=parts)
    both = [list(a) for a in graph.tolist()]
    for i, near in enumerate(graph.tolist()):
        for j in near:
            both[j].append(i)
    random = np.random.default_rng(0)
    for _ in range(rounds):
        moved = 0
        for i in random.permutation(len(x)).tolist():
            votes = Counter(part[both[i]].tolist())
            here = int(part[i])
            best = max(votes, key=lambda p: (votes[p] if p == here or sizes[p] < limit else -1, p == here, -p))
            if best != here and votes[best] > votes[here] and sizes[best] < limit:
                sizes[here], sizes[best], part[i] = sizes[here] - 1, sizes[best] + 1, best
                moved += 1
        if moved < len(x) // 200:
            break
    return part


@dataclass
class Router:
    """A network with one hidden layer; log-probabilities of parts, and how many to visit."""

    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def scores(self, x: np.ndarray) -> np.ndarray:
        hidden = np.maximum(((x - self.mean) * self.scale) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2


def fit_router(x: np.ndarray, parts: int) -> Router:
    """Graph, parts and network from a sample; probes from the sample's own neighbours."""
    random = np.random.default_rng(1)
    width = x.shape[1]
    mean = x.mean(0)
    scale = 1 / max(1e-30, float((x - mean).std()))
    router = Router(
        mean, scale, random.normal(0, math.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts), 1,
    )
    graph = neighbour_graph(x)
    label = balanced_parts(x, graph, parts)
    weights = [router.w1, router.b1, router.w2, router.b2]
    moment = [np.zeros_like(w) for w in weights]
    square = [np.zeros_like(w) for w in weights]
    z = (x - mean) * scale
    step = 0
    for epoch in range(EPOCHS):
        for rows in np.array_split(random.permutation(len(x)), max(1, len(x) // 256)):
            hidden = np.maximum(z[rows] @ router.w1 + router.b1, 0)
            out = hidden @ router.w2 + router.b2
            out = np.exp(out - out.max(1, keepdims=True))
            out /= out.sum(1, keepdims=True)
            # The target is the part of the row and of its neighbours.
            goal = np.zeros_like(out)
            goal[np.arange(len(rows)), label[rows]] += 0.5
            np.add.at(goal, (np.arange(len(rows))[:, None], label[graph[rows]]), 0.5 / graph.shape[1])
            error = (out - goal) / len(rows)
            back = (error @ router.w2.T) * (hidden > 0)
            slopes = [z[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
            step += 1
            rate = 3e-3 * (1 - epoch / EPOCHS)
            for w, m, s, g in zip(weights, moment, square, slopes):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    order = np.argsort(-router.scores(x), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None, :], axis=1)
    home = order[:, 0]
    rank = np.take_along_axis(place, home[graph], axis=1)  # visits until a neighbour's part
    for probes in range(1, parts + 1):
        if (rank < probes).mean() >= WANTED:
            break
    router.probes = probes
    return router


@dataclass
class Lengths:
    """Routers by vector length, and the number of each one's first part.

    A length without a router is one part, numbered below 0 by the length.
    """

    routers: dict[int, tuple[int, Router]]

    def homes(self, vectors: list[list[float]]) -> np.ndarray:
        """The most probable part of every vector."""
        out = np.array([-len(v) for v in vectors])
        for width, (first, router) in self.routers.items():
            own = np.flatnonzero(out == -width)
            if len(own):
                out[own] = first + router.scores(np.array([vectors[i] for i in own])).argmax(1)
        return out


def _routed(lengths: Lengths, counts: dict[int, int], k: int):
    """(part, vec_id, vec) for every part a query visits."""
    held = {
        width: np.array([counts.get(first + i, 0) for i in range(len(router.b2))])
        for width, (first, router) in lengths.routers.items()
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for name, vector in zip(*(c.to_pylist() for c in batch.columns)):
                width = len(vector)
                if width not in lengths.routers:
                    yield -width, name, vector
                    continue
                first, router = lengths.routers[width]
                order = np.argsort(-router.scores(np.array([vector]))[0])
                reach = np.cumsum(held[width][order])
                probes = max(router.probes, int(np.searchsorted(reach, k + 1)) + 1)
                for part in order[:probes].tolist():
                    yield first + part, name, vector

    return run


def _homes(lengths: Lengths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            names, vectors = (c.to_pylist() for c in batch.columns)
            if names:
                yield from zip(lengths.homes(vectors).tolist(), names, vectors)

    return run


def _rerank(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids, values = unpacked(row["ids"], row["data"], row["width"], "<f8")
                q_ids, queries = unpacked(row["q_ids"], row["q_data"], row["width"], "<f8")
                q_ids = q_ids.reshape(-1, 2)  # number of the query row, its vec_id
                norms = (values * values).sum(1)
                for first in range(0, len(q_ids), 128):
                    part = queries[first : first + 128]
                    rough = norms[None, :] - 2 * part @ values.T
                    for (number, name), query, far in zip(q_ids[first : first + 128].tolist(), part, rough):
                        far[ids == name] = np.inf
                        kth = np.partition(far, min(k, len(far)) - 1)[min(k, len(far)) - 1]
                        room = 1e-9 * (float(norms.max()) + float(query @ query))
                        rows = np.flatnonzero((far <= kth + room) & (ids != name))
                        exact = np.sqrt(((values[rows] - query) ** 2).sum(1))
                        for j in np.lexsort((ids[rows], exact))[:k].tolist():
                            yield number, name, int(ids[rows[j]]), float(exact[j])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance); tables of vec_id and vec, written."""
    n = rows.count()
    lengths = _learn(rows)
    homes = map_batches(rows.select("vec_id", "vec"), _homes(lengths), "part int, vec_id bigint, vec array<double>")
    spread = homes.repartitionByRange(parts_for(rows, n, BLOCK), "part", F.xxhash64("vec_id", "vec"))
    index = written(blocks(spread.sortWithinPartitions("part"), "<f8", BLOCK), "index")
    # one row per part, at most MOST_PARTS for each length with a router
    counts = dict(index.filter("part >= 0").groupBy("part").agg(F.sum("rows")).collect())
    # repeated query rows are told apart by a number
    named = F.array(F.monotonically_increasing_id(), "vec_id").alias("vec_id")
    asked = written(queries.select(named, "vec"), "asked")
    routed = map_batches(asked, _routed(lengths, counts, k), "part int, vec_id array<bigint>, vec array<double>")
    most = max((router.probes for _, router in lengths.routers.values()), default=1)
    ranged = routed.repartitionByRange(parts_for(rows, asked.count() * most, QUERY_BLOCK), "part", "vec_id")
    asking = written(numbered_queries(ranged.sortWithinPartitions("part"), "<f8"), "queries")
    found = map_batches(
        block_pairs(index, asking, 4 * max(1, len(counts))), _rerank(k),
        "q_row bigint, query_id bigint, vec_id bigint, score double",
    )
    best = W.partitionBy("q_row").orderBy("score", "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _learn(rows: DataFrame) -> Lengths:
    """A router for each vector length that has rows for two parts and more."""
    width = F.size("vec")
    common = rows.groupBy(width.alias("width")).agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * ROWS_PER_PART)
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    routers: dict[int, tuple[int, Router]] = {}
    first = 0
    for size, n in sorted(tuple(x) for x in common.collect()):  # one row per length
        share = min(1 << 30, math.ceil(1.2 * SAMPLE / n * (1 << 30)))
        drawn = rows.filter((width == size) & (draw < share)).orderBy(draw, "vec_id").limit(SAMPLE).collect()
        sample = np.array([x.vec for x in drawn], np.float64).reshape(-1, size)
        parts = min(MOST_PARTS, round(n / ROWS_PER_PART), len(sample) // 16)
        if parts > 1:
            routers[size] = (first, fit_router(sample, parts))
            first += parts
    return Lengths(routers)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(usable_vectors(table(spark, sf_dir, "embeddings"), zero=False), "vectors")
    return nearest(rows, rows.filter(F.pmod("vec_id", F.lit(100)) == 0))
