"""Exact top-k inner-product search by pivot-table elimination.

Integer vectors x are lifted by one component to the largest norm M and queries q by a
zero, which turns the inner product s into a distance: d**2 = |q|**2 + M**2 - 2 s.  A
pivot table holds, for every vector, its distances to PIVOTS pivots and its nearest
pivot, which is its cell; it is computed once and written.  The largest
|d(q, p) - d(x, p)| bounds d(q, x) from below and so s from above.  Each query starts
with the k-th best score among the vectors stored beside it; groups of a cell whose
ranges of distances cannot beat that score never get the query.  In the others the
candidates are scored in bound order, portion by portion, until no bound that is left reaches
the k-th best; the others are never multiplied.  Pivots are far apart: each is the farthest from those
before it in a sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidewell.llm.shared import durable, table

PIVOTS = 64
#: Bytes of vectors that a group holds, and of queries that a block holds: what meets in a task.
GROUP_BYTES, BLOCK_BYTES = 1 << 26, 1 << 25
#: Vectors or queries in a packed row, and vectors compared at a time.
PACK_ROWS = 2048
#: Groups whose ranges meet a block of queries in one task.
SLOT_GROUPS = 16
#: Candidates of the highest bounds that are scored first; each further portion is twice as large.
STEP = 256
#: Vectors, for each pivot, of the sample that the pivots are chosen from.
SAMPLE = 16
#: Bounds of a long, at which scores end.
LONG = (-(1 << 63), (1 << 63) - 1)

_GROUP = ["dim", "cell", "salt"]
_PACK = "dim int, cell int, salt int, kind string, n long, ids binary, codes binary, far binary, least binary, low binary, high binary"


def integer_codes(vector: Column) -> Column:
    """floor(256 * x) of each component, or null for a vector that takes no part."""
    x = F.transform(vector, lambda v: v.cast("double") * 256.0)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    # floor() of a double gives a long, which the largest doubles exceed
    whole = lambda v: F.when(F.abs(v) < 2.0**52, F.floor(v).cast("double")).otherwise(v)
    return F.when(vector.isNotNull() & ~bad, F.transform(x, whole))


def exact_scores(x: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Inner products of integer rows x with integer rows q, (q, x); ``top`` bounds the square of any norm.

    Doubles hold every product and sum below 2**53, longs below 2**63; beyond, Python's
    integers are used and scores end at the bounds of a long.
    """
    if top < 2.0**52:
        return q @ x.T
    if top < 2.0**61:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = [np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x)]
    return np.clip(whole[0] @ whole[1].T if x.shape[1] else np.zeros((len(q), len(x)), object), *LONG).astype(np.int64)


def to_pivots(x: np.ndarray, pivots: np.ndarray, top: float, lift: bool) -> np.ndarray:
    """Distances of rows to the lifted pivots; queries are lifted by zero."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = (x * x).sum(axis=1)
        full = np.column_stack([x, np.sqrt(np.maximum(top - square, 0.0)) if lift else np.zeros(len(x))])
        own = np.full(len(x), top) if lift else square
        return np.sqrt(np.maximum(own[:, None] + top - 2 * full @ pivots.T, 0.0)).astype(np.float32)


def upper_bound(gap: np.ndarray, square: np.ndarray, top: float) -> np.ndarray:
    """Highest score at a distance of at least ``gap``; the slack covers the rounding of distances."""
    with np.errstate(over="ignore", invalid="ignore"):
        safe = np.maximum(gap - 4e-6 * math.sqrt(top), 0.0)
        bound = (square + top - safe * safe) / 2 + 1e-9 * top
    return np.where(np.isfinite(bound), bound, np.inf)


class Best:
    """The k best (score, smallest id first) of each query of a block so far."""

    def __init__(self, ids: np.ndarray, least: np.ndarray, k: int):
        self.own, self.k, self.least = ids, k, least.copy()
        self.ids, self.scores = [np.zeros(0, np.int64)] * len(ids), [np.zeros(0, np.int64)] * len(ids)
        self.scored = 0

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        self.scored += len(ids)
        keep = (ids != self.own[i]) & (scores >= self.least[i])
        if keep.any():
            ids, scores = np.append(self.ids[i], ids[keep]), np.append(self.scores[i], scores[keep].astype(np.int64))
            if len(ids) > self.k:
                order = np.lexsort((ids, ~scores))[: self.k]
                ids, scores = ids[order], scores[order]
            self.ids[i], self.scores[i] = ids, scores
            if len(ids) == self.k:
                least = float(scores.min())
                self.least[i] = max(self.least[i], least if abs(least) < 2.0**53 else np.nextafter(least, -np.inf))


def search(best: Best, q: tuple[np.ndarray, np.ndarray], x: tuple[np.ndarray, np.ndarray, np.ndarray], top: float) -> None:
    """Meet queries (codes, distances) with vectors (ids, codes, distances); both lists are of one length."""
    (codes, far), (ids, vectors, x_far) = q, x
    square = (codes * codes).sum(axis=1)
    for lo in range(0, len(codes), 64):
        part = slice(lo, lo + 64)
        gap = np.zeros((len(codes[part]), len(ids)), np.float32)
        for j in range(far.shape[1]):
            np.maximum(gap, np.abs(far[part, j, None] - x_far[None, :, j]), out=gap)
        bound = upper_bound(gap.astype(float), square[part, None], top)
        alive = bound >= best.least[part, None]
        if not alive.any():
            continue
        for i in np.flatnonzero(alive.any(axis=1)).tolist():
            rest = np.flatnonzero(alive[i])
            rest, done, size = rest[np.argsort(-bound[i, rest], kind="stable")], 0, STEP
            while done < len(rest) and bound[i, rest[done]] >= best.least[lo + i]:
                some = rest[done : done + size]
                best.add(lo + i, ids[some], exact_scores(vectors[some], codes[lo + i : lo + i + 1], top)[0])
                done, size = done + len(some), 2 * size


def far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of x, each the farthest from those before it (the first row first)."""
    picked, away = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(x)):
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def _matrix(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64 if kind == "<f8" else np.float32)


def _pivot_table(coded: DataFrame, pivots: dict[int, np.ndarray], cells: int, top: float) -> DataFrame:
    """vec_id, dim, cell (nearest of the first ``cells`` pivots), codes and distances of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            dims = np.array([len(c) for c in codes], np.int64)
            for d in np.unique(dims).tolist():
                own = np.flatnonzero(dims == d)
                x = np.array([codes[i] for i in own], np.float64).reshape(len(own), d)
                far = to_pivots(x, pivots[d], top, True) if d in pivots else np.zeros((len(own), 0), np.float32)
                cell = far[:, :cells].argmin(axis=1) if far.shape[1] else np.zeros(len(own), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own], pa.int64()), pa.array(np.full(len(own), d), pa.int32()), pa.array(cell, pa.int32()), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in far], pa.binary())],
                    ["vec_id", "dim", "cell", "codes", "far"],
                )

    return durable(coded.select("vec_id", "codes").mapInArrow(run, "vec_id long, dim int, cell int, codes binary, far binary"), "topk-pivots")


def _pack(pivots: dict[int, np.ndarray], top: float, every: int, k: int):
    """Packed rows of a group: its vectors with their ranges of distances, and its queries with their first k-th best."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        dim, cell, salt = (int(pdf[c].iloc[0]) for c in _GROUP)
        pdf = pdf.sort_values("vec_id", kind="stable")
        rows = []
        for lo in range(0, len(pdf), PACK_ROWS):
            some = pdf.iloc[lo : lo + PACK_ROWS]
            ids, n = some["vec_id"].to_numpy(np.int64), len(some)
            codes, far = _matrix(b"".join(some["codes"]), n, "<f8"), _matrix(b"".join(some["far"]), n, "<f4")
            rows.append((dim, cell, salt, "vectors", n, ids.tobytes(), codes.tobytes(), far.tobytes(), b"", far.min(axis=0).tobytes(), far.max(axis=0).tobytes()))
            ask = np.flatnonzero(ids % every == 0)
            if len(ask):
                best = Best(ids[ask], np.full(len(ask), -np.inf), k)
                scores = exact_scores(codes, codes[ask], top)
                for i in range(len(ask)):
                    best.add(i, ids, scores[i])
                away = to_pivots(codes[ask], pivots[dim], top, False) if dim in pivots else np.zeros((len(ask), 0), np.float32)
                rows.append((dim, cell, salt, "queries", len(ask), ids[ask].tobytes(), codes[ask].tobytes(), away.tobytes(), best.least.tobytes(), b"", b""))
        return pd.DataFrame(rows, columns=["dim", "cell", "salt", "kind", "n", "ids", "codes", "far", "least", "low", "high"])

    return pack


def _sent(queries: DataFrame, groups: DataFrame, top: float) -> DataFrame:
    """Queries for each group of their length that may hold a better score; the others stay where they are."""
    own = "dim int, cell int, salt int, block int, n long, ids binary, codes binary, far binary, least binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for dim, cell, salt, low, high, block, n, ids, codes, far, least in zip(*[c.to_pylist() for c in batch.columns]):
                c, f, t = _matrix(codes, n, "<f8"), _matrix(far, n, "<f4"), np.frombuffer(least, np.float64)
                low, high = np.frombuffer(low, np.float32), np.frombuffer(high, np.float32)
                gap = np.maximum(np.maximum(low - f, f - high), 0).max(axis=1, initial=0.0) if f.shape[1] else np.zeros(n)
                go = np.flatnonzero(upper_bound(gap.astype(float), (c * c).sum(axis=1), top) >= t)
                if len(go):
                    rows.append((dim, cell, salt, block, len(go), np.frombuffer(ids, np.int64)[go].tobytes(), c[go].tobytes(), f[go].tobytes(), t[go].tobytes()))
            kinds = [pa.int32()] * 4 + [pa.int64()] + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [*_GROUP, "block", "n", "ids", "codes", "far", "least"])

    joined = groups.join(queries.drop("cell", "salt", "kind", "low", "high"), ["dim", "slot", "block"])
    return joined.select(*_GROUP, "low", "high", "block", "n", "ids", "codes", "far", "least").mapInArrow(run, own)


def _ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Range of the distances to each pivot over a group."""
    low, high = (np.stack([np.frombuffer(b, np.float32) for b in pdf[c]]) for c in ("low", "high"))
    return pd.DataFrame([(*(int(pdf[c].iloc[0]) for c in _GROUP), low.min(axis=0).tobytes(), high.max(axis=0).tobytes())], columns=[*_GROUP, "low", "high"])


def exact_top_k(vectors: DataFrame, vector: str = "embedding", k: int = 5, every: int = 50, n_pivots: int = PIVOTS, group_bytes: int = GROUP_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k highest integer inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows of
    another vec_id; ties go to the smaller vec_id.  Vectors that are null or hold null
    or non-finite components (also of 256 times their value), and rows without a vec_id,
    take no part; vectors are compared with those of their own length, an empty one has
    the score 0 with others.  A row repeated with id and vector counts once; of several
    vectors with one vec_id each is a row, and a query row's own vec_id is no candidate.
    Scores are exact at any size; beyond a long they count as its bounds.  Other columns
    do not matter.  An empty table gives no rows.

    A group of a cell holds about ``group_bytes`` of vectors, a block about ``block_bytes``
    of queries; a task holds one of each.  Vectors are copied once for each block, queries
    once for each group that may beat their k-th best: as a fixed share of the rows asks,
    the work grows with their square, the copies with the square divided by both sizes.
    """
    coded = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integer_codes(F.col(vector)).alias("codes")).filter("vec_id is not null and codes is not null")
    coded = durable(coded.distinct(), "topk-codes")
    norm = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x * x)
    rows, top, asked = coded.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("vec_id") % every == 0, F.size("codes") * 8 + 4 * n_pivots)), F.lit(0))).first()
    pivots: dict[int, np.ndarray] = {}
    picked = [np.array(r[0], float) for r in coded.orderBy(F.xxhash64("vec_id"), "vec_id", "codes").select("codes").limit(SAMPLE * n_pivots).collect()] if math.isfinite(top) else []
    for d in {len(p) for p in picked}:
        x = np.stack([p for p in picked if len(p) == d])
        pivots[d] = far_apart(np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0.0))]), n_pivots)
    points = _pivot_table(coded, pivots, max(1, rows // PACK_ROWS), top)
    rows_of = F.greatest(F.lit(PACK_ROWS), F.lit(group_bytes) / (F.col("dim") * 8 + 4 * n_pivots))
    salts = points.groupBy("dim", "cell").agg(F.count("*").alias("_n")).select("dim", "cell", F.ceil(F.col("_n") / rows_of).cast("int").alias("_salts"))
    salted = points.join(salts, ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("_salts")).cast("int")).drop("_salts")
    packs = durable(salted.groupBy(*_GROUP).applyInPandas(_pack(pivots, top, every, k), _PACK), "topk-packs")
    held = packs.filter("kind = 'vectors'")
    groups = held.select(*_GROUP, "low", "high").groupBy(*_GROUP).applyInPandas(_ranges, "dim int, cell int, salt int, low binary, high binary")
    blocks, every_of = max(1, -(-asked // block_bytes)), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    slots = max(1, -(-(salts.agg(F.sum("_salts")).first()[0] or 0) // SLOT_GROUPS))
    queries = packs.filter("kind = 'queries'").withColumn("block", F.pmod(F.xxhash64(*_GROUP, "ids"), F.lit(blocks)).cast("int")).withColumn("slot", every_of(slots))
    sent = _sent(queries, groups.withColumn("slot", F.pmod(F.xxhash64(*_GROUP), F.lit(slots)).cast("int")).withColumn("block", every_of(blocks)), top)

    def meet(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            ids = np.concatenate([np.frombuffer(b, np.int64) for b in q["ids"]])
            codes, far = (np.concatenate([_matrix(b, n, t) for b, n in zip(q[c], q["n"])]) for c, t in (("codes", "<f8"), ("far", "<f4")))
            best = Best(ids, np.concatenate([np.frombuffer(b, np.float64) for b in q["least"]]), k)
            for n, own, c, f in zip(x["n"], x["ids"], x["codes"], x["far"]):
                search(best, (codes, far), (np.frombuffer(own, np.int64), _matrix(c, n, "<f8"), _matrix(f, n, "<f4")), top)
            out = [(int(ids[i]), int(a), int(s)) for i in range(len(ids)) for a, s in zip(best.ids[i], best.scores[i])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    by = [*_GROUP, "block"]
    copies = held.withColumn("block", every_of(blocks)).select(*by, "n", "ids", "codes", "far")
    found = sent.groupBy(*by).cogroup(copies.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.c, x.c), lambda t: t[1] * t[2])) AS BIGINT) AS score
      FROM v q JOIN v x ON x.vec_id <> q.vec_id AND len(x.c) = len(q.c) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
