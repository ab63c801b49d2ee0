"""Exact nearest neighbours of a stated set of queries: all pairs, as products of blocks.

A pair costs a step of a matrix product and a comparison. Which of a block's vectors are the nearest is told by
cosines rounded to six places, as doubles added up in the order of the components give them: the product's own order matters for
those next to a half only, and these are computed again.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLACES = 1_000_000
#: Queries that are multiplied at once, and with how many vectors: few at first, until each query has ``k``.
ROWS, FIRST, STEP = 512, 256, 4096
#: Squared lengths of vectors whose cosines a product of unit vectors gives to many more than six places.
LEAST, MOST = 1e-200, 1e200


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _described(rows: DataFrame, vector: str) -> DataFrame:
    """With kind and length: empty vectors (null, or with a null) have no cosine with any; plain ones go into products, odd ones do not."""
    v, square = F.col(vector), _dot(F.col(vector), F.col(vector))
    kind = F.when(square.isNull(), "empty").when((square >= LEAST) & (square <= MOST), "plain").otherwise("odd")
    return rows.withColumns({"kind": kind, "length": F.size(v)})


def nearest(queries: DataFrame, known: DataFrame, k: int, query_block: int, vector_block: int) -> DataFrame:
    """(vec_id, n_id, label, s, rank): the ``k`` of ``known`` (n_id, label, v) with the highest cosine to each of ``queries`` (vec_id, q), ties by n_id; never itself.

    Both are dealt into blocks by the hash of their ids, and each block of one meets each of the other in a task. Without a cosine (a null in either vector, other
    lengths) a vector comes after those with one.
    """
    asked = _described(queries.where(F.col("vec_id").isNotNull()), "q")
    known = _described(known.where(F.col("n_id").isNotNull()), "v")
    counts = asked.select(F.lit(True).alias("asks"), "kind", "length").unionByName(known.select(F.lit(False).alias("asks"), "kind", "length"))
    counts = counts.groupBy("asks", "kind", "length").agg(F.count(F.lit(1)).alias("n"))
    plain = F.col("kind") == "plain"
    length = counts.where(~F.col("asks") & plain).agg(F.max_by("length", F.struct("n", "length")).alias("length")).first()["length"]
    usual = plain & F.col("length").eqNullSafe(F.lit(length))
    empty = F.col("kind") == "empty"
    n_of = lambda asks, what: F.coalesce(F.sum(F.when((F.col("asks") == asks) & what, F.col("n"))), F.lit(0))
    n = counts.agg(*[n_of(a, w).alias(f"{name}_{side}") for side, a in (("asked", True), ("known", False)) for name, w in (("usual", usual), ("empty", empty), ("all", F.lit(True)))]).first()

    parts = [_by_blocks(asked.where(usual), known.where(usual), k, -(-n["usual_asked"] // query_block) or 1, -(-n["usual_known"] // vector_block) or 1)]
    # what is in no product is compared pair by pair; of vectors without a cosine the first by id are enough
    cosine = F.round(_dot(F.col("q"), F.col("v")) / F.sqrt(_dot(F.col("q"), F.col("q")) * _dot(F.col("v"), F.col("v"))), 6).cast("double").alias("s")
    none = F.lit(None).cast("double").alias("s")
    first = lambda rows: rows.join(F.broadcast(rows.select("n_id").distinct().orderBy("n_id").limit(k + 1)), "n_id", "left_semi")
    pairs = lambda a, b, s: a.join(b, F.col("n_id") != F.col("vec_id")).select("vec_id", "n_id", "label", s)
    if n["empty_known"]:
        parts.append(pairs(asked.where(~empty), F.broadcast(first(known.where(empty))), none))
    if n["empty_asked"]:
        parts.append(pairs(asked.where(empty), F.broadcast(first(known)), none))
    if n["all_known"] > n["usual_known"] + n["empty_known"]:
        parts.append(pairs(asked.where(~empty), known.where(~empty & ~usual), cosine))
    if n["all_asked"] > n["usual_asked"] + n["empty_asked"]:
        parts.append(pairs(asked.where(~empty & ~usual), known.where(usual), cosine))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.desc("s"), "n_id"))).where(F.col("rank") <= k)


def _by_blocks(asked: DataFrame, known: DataFrame, k: int, query_blocks: int, vector_blocks: int) -> DataFrame:
    deal = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("vec_id", "q", deal("vec_id", query_blocks, 1).alias("a"), all_of(vector_blocks).alias("b"))
    right = known.select("n_id", "label", "v", deal("n_id", vector_blocks, 2).alias("b"), all_of(query_blocks).alias("a"))
    kinds = dict(asked.dtypes) | dict(known.dtypes)
    schema = f"vec_id {kinds['vec_id']}, n_id {kinds['n_id']}, label {kinds['label']}, s double"

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        return block_nearest(q, v, k)

    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(best, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(rows), -1)


def _rounded(s: np.ndarray, pairs, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines in millionths, half away from zero; ``pairs`` are the rows of ``q`` and ``v``."""
    t = s * PLACES
    found = np.floor(t + 0.5)
    for at in np.nonzero(np.abs(t - np.floor(t) - 0.5) < 1e-6)[0]:
        a, b = q[pairs[0][at]].tolist(), v[pairs[1][at]].tolist()
        dots = []
        for x, y in ((a, b), (a, a), (b, b)):
            total = 0.0
            for i, j in zip(x, y, strict=True):
                total += i * j
            dots.append(total)
        found[at] = int(Decimal(repr(dots[0] / math.sqrt(dots[1] * dots[2]))).quantize(Decimal("0.000001"), ROUND_HALF_UP) * PLACES)
    return found


def block_nearest(asked: pa.Table, known: pa.Table, k: int) -> pa.Table:
    """(vec_id, n_id, label, s): the ``k`` nearest of ``known`` (n_id, label, v) to each of ``asked`` (vec_id, q), ties by n_id."""
    known = known.take(pc.sort_indices(known["n_id"]))
    n, m = len(asked), len(known)
    score, place = np.full((n, k), -np.inf), np.full((n, k), -1)
    if n and m:
        q, v = _matrix(asked["q"]), _matrix(known["v"])
        unit_q, unit_v = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) for x in (q, v))
        ids = known["n_id"].combine_chunks()
        ids = ids.dictionary_encode()
        itself, code = pc.fill_null(pc.index_in(asked["vec_id"].combine_chunks(), value_set=ids.dictionary), -1).to_numpy(zero_copy_only=False), ids.indices.to_numpy()
        for low in range(0, n, ROWS):
            rows = slice(low, min(n, low + ROWS))
            at = 0
            while at < m:
                end = min(m, at + (FIRST if at == 0 else STEP))
                s = unit_q[rows] @ unit_v[at:end].T
                # ids ascend: a later vector has to be nearer than the last that is kept
                i, j = np.nonzero(s > ((score[rows, -1] + 0.5) / PLACES - 1e-11)[:, None])
                other = itself[rows][i] != code[at + j]
                i, j = i[other], j[other]
                if len(i):
                    _keep(score[rows], place[rows], i, _rounded(s[i, j], (low + i, at + j), q, v), at + j)
                at = end
    i, j = np.nonzero(place >= 0)
    chosen = known.select(["n_id", "label"]).take(pa.array(place[i, j]))
    return pa.table({"vec_id": asked["vec_id"].take(pa.array(i)), "n_id": chosen["n_id"], "label": chosen["label"], "s": pa.array(score[i, j] / PLACES)})


def _keep(score: np.ndarray, place: np.ndarray, rows: np.ndarray, new: np.ndarray, at: np.ndarray) -> None:
    """Put new scores of rows among the best of these, highest first, ties by place."""
    k = score.shape[1]
    had = np.unique(rows)
    row = np.concatenate([np.repeat(had, k), rows])
    value, where = np.concatenate([score[had].ravel(), new]), np.concatenate([place[had].ravel(), at])
    order = np.lexsort((where, -value, row))
    row, value, where = row[order], value[order], where[order]
    starts = np.searchsorted(row, had)
    take = starts[:, None] + np.arange(k)
    score[had], place[had] = value[take], where[take]
