"""Exact top-k inner products by columnar branch and bound.

Vectors become integers ``floor(scale * x)`` and are stored in blocks with one row per dimension
(vertical layout).  A block meets a pack of queries: partial scores are accumulated a few
dimensions at a time, most energetic dimensions of the block first; the rest of a score is at most
the product of the remaining masses (Euclidean norms over the dimensions still to come), so every
candidate has a lower and an upper bound; candidates whose upper bound is below the k-th best
lower bound, or below the k-th best exact score already met by the task, leave, and the arrays of
the survivors are compacted before the next dimensions are read.  What survives all dimensions
has its exact score.  Each (block, pack) gives at most k rows a query, and a ranked merge follows.

The query set is stated by the caller and met with all rows in blocks: every part of the rows gets
all packs, and a pair of block and query whose product of norms is below the query's k-th best score so far is
skipped.  Blocks and packs have bounded sizes, so memory does not depend on
the table.

Edge cases: vectors that are null or hold null or non-finite components, and rows with a null id,
take no part; rows that share an id count once (the smallest vector, compared as an array); a
query never meets its own id; vectors of another length than the query's take no part for it;
fewer than k candidates give all of them; equal scores rank by the smaller id.  Scores are exact
while sums stay below 2**53.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``vec_id, v array<long>`` of the rows that take part."""
    x = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    ok = x.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(~F.coalesce(bad, F.lit(True)))
    return ok.select("vec_id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _pack(rows: DataFrame, most: int, parts: int) -> DataFrame:
    """Blocks ``part, dim, ids, m`` of consecutive rows of a partition; ``m`` holds one row a dimension."""

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() % parts
        held: dict[int, list] = {}

        def out(dim: int):
            ids, cols = zip(*held.pop(dim))
            m = np.concatenate(cols).astype("<i8") if dim else np.zeros((len(ids), 0), "<i8")
            return {"part": [part], "dim": [dim], "ids": [np.concatenate(ids).astype("<i8").tobytes()], "m": [np.ascontiguousarray(m.T).tobytes()]}

        sizes: dict[int, int] = {}
        last = None
        for b in batches:
            ids, vectors = b["vec_id"].to_numpy(), b["v"].to_pylist()
            fresh = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])  # repeated ids stand together
            last = ids[-1]
            by: dict[int, list[int]] = {}
            for i in np.flatnonzero(fresh):
                by.setdefault(len(vectors[i]), []).append(int(i))
            for dim, at in by.items():
                held.setdefault(dim, []).append((ids[at], np.array([vectors[i] for i in at], np.int64).reshape(len(at), dim)))
                sizes[dim] = sizes.get(dim, 0) + len(at)
                if sizes[dim] >= most:
                    yield out(dim)
                    sizes[dim] = 0
        for dim in list(held):
            yield out(dim)

    return common.in_arrow(rows, run, "part int, dim int, ids binary, m binary")


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int, step: int, floor: dict[int, int]) -> list[tuple[int, int, int]]:
    """The best k of a block ``x (dims, n)`` for each query ``q (dims, queries)``: (query, id, score)."""
    dims, n = x.shape
    order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    xf, qf = x[order].astype(np.float64), q[order].astype(np.float64)
    cuts = list(range(0, dims, step)) + [dims]
    # Remaining mass from each cut on, of candidates and queries.
    rest_x = [np.sqrt((xf[c:] ** 2).sum(axis=0)) for c in cuts]
    rest_q = [np.sqrt((qf[c:] ** 2).sum(axis=0)) for c in cuts]
    first = qf[: cuts[min(1, len(cuts) - 1)]].T @ xf[: cuts[min(1, len(cuts) - 1)]]
    out, most = [], rest_x[0].max(initial=0.0)
    for j, query in enumerate(query_ids.tolist()):
        if (bound := most * rest_q[0][j]) + 1e-9 * bound + 1e-6 < floor.get(query, -np.inf):
            continue
        at = np.flatnonzero(ids != query)
        score = first[j][at]
        for c in range(1, len(cuts)):
            slack = rest_x[c][at] * rest_q[c][j]
            slack += 1e-9 * slack + 1e-6
            bar = floor.get(query, -np.inf)
            if len(at) > k:
                low = score - slack
                bar = max(bar, np.partition(low, len(low) - k)[len(low) - k])
            stay = np.flatnonzero(score + slack >= bar)
            at, score = at[stay], score[stay]
            if c + 1 < len(cuts):
                part = slice(cuts[c], cuts[c + 1])
                score = score + qf[part, j] @ xf[part][:, at]
        best = np.lexsort((ids[at], -score))[:k]
        if len(best) == k:
            floor[query] = max(floor.get(query, -(2**62)), int(score[best[-1]]))
        out.extend((query, int(ids[at[i]]), int(score[i])) for i in best)
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, step: int = 8, pack: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for every row where ``queries`` holds (over ``vec_id``)."""
    spark = common.tune(vectors.sparkSession)
    parts = common.partitions(spark)
    rows = integers(vectors, id_col, vector_col, scale)
    total = vectors.count()
    block = max(1024, min(32768, total // (2 * parts)))
    dealt = rows.repartition(parts, "vec_id").sortWithinPartitions("vec_id", "v")
    blocks = common.stage(_pack(dealt, block, parts), "blocks")
    asked = rows.where(queries)
    # As few packs as hold the queries: every block is met by each.
    few = max(1, min(parts, -(-asked.count() // pack)))
    packs = common.stage(_pack(asked.repartition(few, "vec_id").sortWithinPartitions("vec_id", "v"), pack, parts), "packs")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    # Never broadcast: a copy of all packs for every part would go through the driver.
    dealt_packs = packs.select(every, "dim", F.col("ids").alias("qids"), F.col("m").alias("qm")).hint("shuffle_merge")
    met = blocks.join(dealt_packs, ["part", "dim"])

    def run(batches):
        floor: dict[int, int] = {}
        for b in batches:
            for i in range(len(b["dim"])):
                dim = b["dim"][i].as_py()
                ids, qids = (np.frombuffer(b[c][i].as_py(), "<i8") for c in ("ids", "qids"))
                x, q = (np.frombuffer(b[c][i].as_py(), "<i8").reshape(dim, len(w)) for c, w in (("m", ids), ("qm", qids)))
                got = search_block(ids, x, qids, q, k, step, floor)
                yield {"query_id": [g[0] for g in got], "vec_id": [g[1] for g in got], "score": [g[2] for g in got]}

    found = common.in_arrow(met.select("dim", "ids", "m", "qids", "qm"), run, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
