"""Exact top-k by inner product: vertical layout, dimension blocks, and bounds on the mass that is still to come.

Candidates lie in blocks, one array a dimension. For a block of queries the partial products grow dimension block by dimension
block; by Cauchy-Schwarz what is left of a product is at most the product of both remaining norms, so candidates that cannot
reach a query's current k-th score are compacted away before the next dimension block is read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import stored

#: Dimensions that are added up between two prunings, and candidates scanned at once.
DIMENSIONS, CANDIDATES = 16, 4096
#: Queries that meet a block of candidates at once (8 MB of products), bytes of queries that are broadcast together, and blocks of
#: queries in one plan; what more blocks find is stored first.
TOGETHER, QUERY_BYTES, PLANNED = 256, 32 << 20, 4
#: Sums of products below this are exact in float64.
EXACT = float(1 << 52)


def quantised(embedding, scale: int = 1024):
    """floor(scale * x) of every component as double; null where the vector takes no part."""
    fine = F.transform(embedding, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    usable = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(F.coalesce(usable, F.lit(False)), fine)


class Best:
    """For each query the k best (score, id) so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int):
        self.ids, self.k = ids, k
        # Dimensions with most of the queries' mass first: bounds tighten sooner.
        self.order = np.argsort(-(matrix**2).sum(axis=0), kind="stable")
        self.matrix = matrix[:, self.order]
        self.left = self._left(self.matrix.T)
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in ids]

    @staticmethod
    def _left(vertical: np.ndarray) -> np.ndarray:
        """Norms of what follows each dimension block, one row a block; rounded up a little."""
        squares = np.cumsum((vertical**2)[::-1], axis=0)[::-1]
        rows = [squares[d] if d < len(squares) else np.zeros(vertical.shape[1]) for d in range(DIMENSIONS, len(vertical) + DIMENSIONS, DIMENSIONS)]
        return np.sqrt(np.array(rows).reshape(len(rows), vertical.shape[1])) * (1 + 1e-9)

    def scan(self, ids: np.ndarray, vertical: np.ndarray) -> None:
        """vertical: dimensions x candidates."""
        vertical = np.ascontiguousarray(vertical[self.order])
        left = self._left(vertical)
        exact = float(np.abs(self.matrix).max(initial=0)) * float(np.abs(vertical).max(initial=0)) * max(1, len(vertical)) < EXACT
        first = None
        for q, (own, weights) in enumerate(zip(self.ids, self.matrix, strict=True)):
            if exact and q % TOGETHER == 0:
                first = self.matrix[q : q + TOGETHER, :DIMENSIONS] @ vertical[:DIMENSIONS]
            if not exact:
                self._keep(q, *self._plainly(q, own, ids, vertical))
                continue
            scores, names = self.found[q]
            least = scores[-1] if len(scores) == self.k else -np.inf
            total, alive = first[q % TOGETHER], np.flatnonzero(ids != own)
            total = total[alive]
            for block, start in enumerate(range(DIMENSIONS, len(vertical) + DIMENSIONS, DIMENSIONS)):
                reach = total + left[block, alive] * self.left[block, q]
                stays = reach >= least
                if not stays.all():
                    total, alive = total[stays], alive[stays]
                if start < len(vertical) and len(alive):
                    part = vertical[start : start + DIMENSIONS]
                    total = total + weights[start : start + DIMENSIONS] @ (part if len(alive) == len(ids) else part[:, alive])
            self._keep(q, total, ids[alive])

    def _plainly(self, q: int, own, ids: np.ndarray, vertical: np.ndarray):
        """Integers beyond float64: Python's own, held within the range of a long."""
        weights = [int(x) for x in self.matrix[q]]
        rows = [i for i in range(len(ids)) if ids[i] != own]
        scores = [max(-(1 << 63), min((1 << 63) - 1, sum(w * int(x) for w, x in zip(weights, vertical[:, i], strict=True)))) for i in rows]
        return np.array(scores, object), ids[rows]

    def _keep(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(scores):
            return
        known, names = self.found[q]
        if len(scores) > 8 * self.k and scores.dtype != object:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[scores >= least], scores[scores >= least]
        scores, ids = np.concatenate((known, scores)), np.concatenate((names, ids))
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k] if scores.dtype == object else np.lexsort((ids, -scores))[: self.k]
        self.found[q] = scores[order], ids[order]

    def rows(self) -> pa.RecordBatch:
        query = np.repeat(self.ids, [len(s) for s, _ in self.found])
        scores = [int(x) for s, _ in self.found for x in s]
        names = [int(x) for _, n in self.found for x in n]
        return pa.record_batch({"query_id": pa.array(query.astype(np.int64)), "vec_id": pa.array(names, pa.int64()), "score": pa.array(scores, pa.int64())})


def _matrix(column) -> np.ndarray:
    """Rows of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k candidates with the highest integer inner product.

    Components become floor(scale * x). Vectors that are null, or hold null or non-finite components, take no part. Ties go to
    the smaller vec_id. A query meets every row of its own length but those with its own vec_id; repeated rows count each;
    rows with a null vec_id take no part; a repeated query id counts once. Fewer than k candidates are all returned; other
    columns are not read. Scores outside a long are held at its ends.
    Queries are taken in blocks of about `query_bytes`, which are all that the driver and a broadcast hold: each block passes
    over all candidates, each task sends on k rows a query at most, and beyond some blocks results are stored as they come.
    """
    session = vectors.sparkSession
    usable = lambda df: df.select("vec_id", quantised(F.col("embedding"), scale).alias("v")).where("vec_id is not null and v is not null")
    asked = stored(usable(queries).dropDuplicates(["vec_id"]), "queries")
    size = asked.agg(F.sum(F.size("v").cast("long") * 8 + 8)).first()[0] or 0
    n_blocks = max(1, -(-size // query_bytes))
    candidates, parts = usable(vectors), []
    if n_blocks > 1:
        candidates = stored(candidates, "vectors")
    for block in range(n_blocks):
        part, shared = _against(candidates, session, asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block), k)
        if n_blocks > PLANNED:
            part = stored(_ranked(part, k), "found")
            shared.destroy()
        parts.append(part)
    return _ranked(reduce(DataFrame.unionByName, parts), k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    ordered = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)


def _against(candidates: DataFrame, session, block: DataFrame, k: int):
    """query_id, vec_id, score of each task's best, and the broadcast of the block's queries: by length, ids and a matrix."""
    table = block.toArrow().combine_chunks()
    column, held = table.column("v").combine_chunks(), {}
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        held[int(size)] = (table.column("vec_id").to_numpy()[rows], _matrix(column.take(pa.array(rows))).reshape(len(rows), int(size)))
    shared = session.sparkContext.broadcast(held)

    def search(batches):
        best = {size: Best(ids, matrix, k) for size, (ids, matrix) in shared.value.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(start, CANDIDATES)
                ids, vectors = part.column("vec_id").to_numpy(), part.column("v")
                sizes = vectors.value_lengths().to_numpy()
                for size in np.unique(sizes):
                    if int(size) in best:
                        rows = np.flatnonzero(sizes == size)
                        same = vectors if len(rows) == len(sizes) else vectors.take(pa.array(rows))
                        best[int(size)].scan(ids[rows], _matrix(same).reshape(len(rows), int(size)).T)
        for found in best.values():
            yield found.rows()

    return candidates.mapInArrow(search, "query_id long, vec_id long, score long"), shared
