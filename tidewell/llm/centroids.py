"""Exact k-means in integers over dictionary-encoded vectors.

Vectors are packed where they lie.  A pack cuts the components into blocks and encodes
each block losslessly: a dictionary of its distinct subvectors and one code a vector.
In a round each dictionary entry's squared distance to every centroid is computed once,
and a vector's distance is the sum of the partial distances that its codes name.  The
sums of the clusters come from the same dictionaries: entries times how often each
cluster has their code.  Only those sums leave a pack, so vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import durable, table
from tidewell.llm.topk import integer_codes

CENTROIDS, ROUNDS, DIM = 40, 5, 64
#: Vectors in a pack: codes of two bytes name every entry of its dictionaries.
PACK_ROWS = 1 << 14
#: Up to this size of components squared distances fit a long.
SAFE = 1 << 26
#: Bits of the pieces in which sums are added up, so that sums of any size stay exact.
LIMB = 32
#: The largest long, at which distances and their sums end.
MOST = (1 << 63) - 1


def dictionaries(x: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(first component, distinct subvectors, code of each row) of the blocks that cost least.

    Blocks are one component wide or a power of two: two neighbours become one where that saves
    work (entry components plus one sum a row) and at most every second row has an entry of its own.
    """
    n, width = x.shape

    def leaf(j: int) -> tuple[int, list]:
        entries, codes = np.unique(x[:, j], return_inverse=True)
        return len(entries) + n, [(j, entries[:, None], codes.reshape(-1))]

    nodes = [leaf(j) for j in range(width)]
    while len(nodes) > 1:
        merged = []
        for (a, left), (b, right) in zip(nodes[::2], nodes[1::2]):
            best = (a + b, left + right)
            if len(left) == len(right) == 1:
                (lo, e, c), (_, f, d) = left[0], right[0]
                both, first, codes = np.unique(c * len(f) + d, return_index=True, return_inverse=True)
                cost = len(both) * (e.shape[1] + f.shape[1]) + n
                if 2 * len(both) <= n and cost < best[0]:
                    best = (cost, [(lo, np.hstack([e[c[first]], f[d[first]]]), codes.reshape(-1))])
            merged.append(best)
        nodes = merged + nodes[len(nodes) - len(nodes) % 2 :]
    return [block for _, blocks in nodes for block in blocks]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of n vectors: their ids, and first components, widths, entries and codes of the blocks."""

    def pack(ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        blocks = dictionaries(x)
        head = np.array([(lo, *e.shape) for lo, e, _ in blocks], np.int32)
        entries, codes = (b"".join(part) for part in zip(*[(np.ascontiguousarray(e).tobytes(), c.astype(np.uint16).tobytes()) for _, e, c in blocks]))
        return pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int32()), *[pa.array([b], pa.binary()) for b in (ids.tobytes(), head.tobytes(), entries, codes)]], ["n", "ids", "head", "entries", "codes"])

    ids, rows = [], []
    for batch in batches:
        if batch.num_rows:
            ids.append(batch.column(0).to_numpy())
            rows.append(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        while sum(map(len, ids)) >= PACK_ROWS:
            i, x = np.concatenate(ids), np.concatenate(rows)
            yield pack(i[:PACK_ROWS], x[:PACK_ROWS])
            ids, rows = [i[PACK_ROWS:]], [x[PACK_ROWS:]]
    if sum(map(len, ids)):
        yield pack(np.concatenate(ids), np.concatenate(rows))


def _blocks(head: bytes, entries: bytes, codes: bytes, n: int, safe: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    values, names = np.frombuffer(entries, np.float64), np.frombuffer(codes, np.uint16)
    for lo, count, width in np.frombuffer(head, np.int32).reshape(-1, 3).tolist():
        e, values = values[: count * width].reshape(count, width), values[count * width :]
        yield lo, e.astype(np.int64) if safe else np.array([[int(v) for v in r] for r in e], object), names[:n]
        names = names[n:]


def _assigned(row: tuple, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
    """Nearest centroid (the smallest of equal ones) and squared distance of a pack's vectors, and its blocks."""
    n, head, entries, codes = row
    values = np.frombuffer(entries, np.float64)
    safe = max(float(np.abs(values).max()), float(np.abs(centroids).max())) < SAFE
    c = centroids.astype(np.int64) if safe else centroids
    blocks = list(_blocks(head, entries, codes, n, safe))
    total = np.zeros((n, len(c)), np.int64 if safe else object)
    for lo, e, names in blocks:
        partial = np.zeros((len(e), len(c)), total.dtype)
        for j in range(e.shape[1]):
            off = e[:, j, None] - c[None, :, lo + j]
            partial += off * off
        total += partial[names]
    nearest = total.argmin(axis=1) if safe else np.array([min(range(len(c)), key=lambda k: r[k]) for r in total], np.int64)
    return nearest, total[np.arange(n), nearest], blocks


def _cluster_sums(packs: DataFrame, centroids: np.ndarray) -> dict[tuple[int, int], int]:
    """Exact sum of each (cluster, component), and the count as component -1: a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, head, entries, codes in zip(*[c.to_pylist() for c in batch.columns]):
                nearest, _, blocks = _assigned((n, head, entries, codes), centroids)
                out = [(k, -1, 0, int(v)) for k, v in enumerate(np.bincount(nearest)) if v]
                for lo, e, names in blocks:
                    often = np.bincount(nearest * len(e) + names, minlength=len(centroids) * len(e)).reshape(-1, len(e))
                    sums = often @ e if e.dtype == np.int64 else often.astype(object) @ e
                    for k, j in zip(*np.nonzero(often.any(axis=1)[:, None] & np.ones(e.shape[1], bool))):
                        rest, limb = int(sums[k, j]), 0
                        while rest not in (0, -1):
                            out.append((k, lo + j, limb, rest & ((1 << LIMB) - 1)))
                            rest, limb = rest >> LIMB, limb + 1
                        if rest:
                            out.append((k, lo + j, limb, rest))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32()] * 3 + [pa.int64()])], ["cluster", "at", "limb", "v"])

    rows = packs.select("n", "head", "entries", "codes").mapInArrow(run, "cluster int, at int, limb int, v long").groupBy("cluster", "at", "limb").agg(F.sum("v").alias("v")).collect()
    sums: dict[tuple[int, int], int] = {}
    for r in rows:
        key = (r["cluster"], r["at"])
        sums[key] = sums.get(key, 0) + (r["v"] << (LIMB * r["limb"]))
    return sums


def cluster(vectors: DataFrame, vector: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, seed: str = "2") -> DataFrame:
    """Exact integer k-means: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector.

    A vector is kept if it has exactly ``dim`` components, none null or non-finite (also 256 times
    as large), and a vec_id; each component counts as floor(256 * x).  The first centroids are the
    ``k`` kept vectors of the smallest sha256 of "seed:vec_id" (of equal ones by their components;
    fewer vectors give fewer centroids).  In each of ``rounds`` rounds every vector goes to the
    nearest centroid, of equal ones to the smallest number, and non-empty centroids become the
    floor of their vectors' mean.  Repeated rows are vectors each and get a row each.  All sums are
    exact at any size; distances and their sums beyond a long count as the largest long.  Other
    columns do not matter; no kept vector gives no rows.  The driver holds the centroids and one
    sum for each of their components, nothing of the vectors.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integer_codes(F.col(vector)).alias("codes")).filter((F.size("codes") == dim) & F.col("vec_id").isNotNull() & F.col("codes").isNotNull())
    first = kept.select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "codes").orderBy("h", "codes").limit(k).collect()
    if not first:
        return kept.select("vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256")).limit(0)
    centroids = np.array([[int(v) for v in r["codes"]] for r in first], object)
    packs = durable(kept.mapInArrow(_packed, "n int, ids binary, head binary, entries binary, codes binary"), "centroid-packs")
    for _ in range(rounds):
        sums = _cluster_sums(packs, centroids)
        centroids = np.array([[sums.get((i, j), 0) // sums[i, -1] for j in range(dim)] if (i, -1) in sums else list(c) for i, c in enumerate(centroids)], object)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, ids, *row in zip(*[c.to_pylist() for c in batch.columns]):
                nearest, far, _ = _assigned((n, *row), centroids)
                far = far if far.dtype == np.int64 else np.array([min(int(v), MOST) for v in far], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(nearest.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    out = durable(packs.select("n", "ids", "head", "entries", "codes").mapInArrow(last, "vec_id long, cluster int, distance long"), "centroid-clusters")
    capped = lambda c: F.least(c, F.lit(MOST)).cast("long")
    each = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("_sum"))
    total = each.agg(capped(F.sum("_sum")).alias("inertia"))
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(str(v) for v in c).encode()).hexdigest()) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    facts = each.select("cluster", capped(F.col("_sum")).alias("cluster_inertia")).crossJoin(F.broadcast(total)).join(F.broadcast(named), "cluster")
    # one row for each of at most k clusters
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Each round is an assignment a and the centroids c that follow from it."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    steps = [
        """v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda y: CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        "c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS k, x FROM (SELECT sha256('2:' || vec_id) AS h, x FROM v ORDER BY h LIMIT 40))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT vec_id, x, k, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS r FROM (SELECT v.vec_id, v.x, c.k, CAST({far} AS BIGINT) AS d FROM v, c{i} c)) WHERE r = 1)")
        if i < ROUNDS:
            steps.append(f"""m{i} AS (SELECT k, list(m ORDER BY i) AS x FROM (SELECT k, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (SELECT k, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n
 FROM (SELECT k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY k, i)) GROUP BY k)""")
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON c.k = m.k)")
    return f"""WITH {', '.join(steps)} SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.k = c.k"""


SQL = _sql()
