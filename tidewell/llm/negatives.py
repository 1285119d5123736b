"""Hard negatives by segment summaries.

A vector is cut into segments, and for each the mean and the deviation are stored.  The
inner product of two segments lies within the product of their deviations around the
product of their means (times the length), so the sums over the segments bound a score
from both sides.  Merging neighbours gives coarser summaries: candidates are bounded
with one segment first and with finer ones only while they may still count; what is left
is scored exactly in the order of the upper bounds until none that is left reaches the
scores that are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.shared import durable, table
from tidewell.llm.topk import exact_scores, integer_codes

POSITIVES, NEGATIVES = 5, 3
#: A negative scores between these shares of the positive, in percent.
LOW, HIGH = 50, 95
#: Components in a segment of the finest summaries, at least; a level has a quarter of the segments of the next.
SEGMENT, STEP = 4, 4
#: Bytes of vectors in a group and of anchors in a block: what meets in a task.
GROUP_BYTES, BLOCK_BYTES = 1 << 23, 1 << 25
#: Vectors in a packed row.
PACK_ROWS = 2048
#: Candidates that are scored first; each further portion is twice as large.
FIRST = 64

_PACK = "dim int, grp int, n int, ids binary, at binary, labels binary, codes binary, means binary, deviations binary, wanted binary"


def _edges(dim: int, segments: int) -> np.ndarray:
    return np.arange(segments + 1) * dim // segments


def finest(dim: int) -> int:
    """Segments of the finest summaries: a power of STEP, none shorter than SEGMENT (or one)."""
    n = 1
    while n * STEP * SEGMENT <= dim:
        n *= STEP
    return n


def summaries(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the finest segments of each row; both times the root of the length."""
    n, dim = x.shape
    means, deviations = np.zeros((n, finest(dim))), np.zeros((n, finest(dim)))
    edges = _edges(dim, finest(dim))
    with np.errstate(over="ignore", invalid="ignore"):
        for s, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                mean = x[:, a:b].mean(axis=1)
                means[:, s], deviations[:, s] = mean * np.sqrt(b - a), np.sqrt(((x[:, a:b] - mean[:, None]) ** 2).sum(axis=1))
    return means, deviations


def levels(means: np.ndarray, deviations: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Summaries from one segment to the finest ones, each merged from the level below."""
    out, m, d = [(means, deviations)], means, deviations
    with np.errstate(over="ignore", invalid="ignore"):
        while m.shape[1] > 1:
            length = np.diff(_edges(dim, m.shape[1])).reshape(-1, STEP)
            total, parts = length.sum(axis=1), m.reshape(len(m), -1, STEP)
            mean = (parts * np.sqrt(length)).sum(axis=2) / total
            apart = ((parts / np.sqrt(length) - mean[:, :, None]) ** 2 * length).sum(axis=2)
            d = np.sqrt((d * d).reshape(len(d), -1, STEP).sum(axis=2) + apart)
            m = mean * np.sqrt(total)
            out.append((m, d))
    return out[::-1]


class Rows:
    """Vectors of one length with their summaries at every level."""

    def __init__(self, pdf: pd.DataFrame):
        of = lambda c, t: np.concatenate([np.frombuffer(b, t) for b in pdf[c]])
        n, self.dim = int(pdf["n"].sum()), int(pdf["dim"].iloc[0])
        self.ids, self.at, self.labels = of("ids", np.int64), of("at", np.int64), of("labels", np.int64)
        self.codes = of("codes", np.float64).reshape(n, self.dim)
        m, d = (of(c, np.float32).astype(float).reshape(n, -1) for c in ("means", "deviations"))
        self.levels = levels(m, d, self.dim)
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((self.codes * self.codes).sum(axis=1))
        self.wanted = of("wanted", np.int64).reshape(n, -1) if len(pdf["wanted"].iloc[0]) else None


def refine(rows: Rows, idx: np.ndarray, asks: Rows, i: int, windows: list[tuple[float, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidates whose bounds meet a window [low, high] at every level, and their upper bounds, in falling order.

    Candidates that surely lie inside a window raise its low end to the k-th highest of their lower bounds.
    """
    bound, low, most = np.full(len(idx), np.inf), [lo for lo, _ in windows], max(hi for _, hi in windows)
    for (m, d), (a, b) in zip(rows.levels, asks.levels):
        if not len(idx):
            break
        with np.errstate(over="ignore", invalid="ignore"):
            middle, spread = m[idx] @ a[i], d[idx] @ b[i] + 2e-6 * asks.norms[i] * rows.norms[idx] + 1e-9
            upper, lower = middle + spread, middle - spread
        upper, lower = np.where(np.isnan(upper), np.inf, upper), np.where(np.isnan(lower), -np.inf, lower)
        for w, (lo, hi) in enumerate(windows):
            sure = lower[(upper <= hi) & (lower >= lo)]
            if len(sure) >= k:
                low[w] = max(low[w], np.partition(sure, len(sure) - k)[len(sure) - k])
        keep = (upper >= min(low)) & (lower <= most)
        idx, bound = idx[keep], np.minimum(upper, bound)[keep]
    order = np.argsort(-bound, kind="stable")
    return idx[order], bound[order]


def best_first(rows: Rows, idx: np.ndarray, bound: np.ndarray, asks: Rows, i: int, windows: list[tuple[int, int]], k: int, top: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """For each window [low, high] of scores its k best (row, score), ties to the smaller id; and how many were scored."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
    need, done, size = [float(lo) for lo, _ in windows], 0, FIRST
    while done < len(idx) and bound[done] >= min(need):
        part = idx[done : done + size]
        scores = exact_scores(rows.codes[part], asks.codes[i : i + 1], top)[0].astype(np.int64)
        for w, (lo, hi) in enumerate(windows):
            fit = (scores >= lo) & (scores <= hi)
            if fit.any():
                at, s = np.append(found[w][0], part[fit]), np.append(found[w][1], scores[fit])
                order = np.lexsort((rows.ids[at], ~s))[:k]
                found[w] = at[order], s[order]
                if len(order) == k:
                    need[w] = max(need[w], float(s[order[-1]]) * (1 - 1e-15 if s[order[-1]] > 0 else 1 + 1e-15))
        done, size = done + len(part), size * 2
    return found, done


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    dim, grp = int(pdf["dim"].iloc[0]), int(pdf["grp"].iloc[0])
    out = []
    for lo in range(0, len(pdf), PACK_ROWS):
        some = pdf.iloc[lo : lo + PACK_ROWS]
        x = np.array([np.asarray(c, float) for c in some["codes"]], float).reshape(len(some), dim)
        m, d = summaries(x)
        wanted = np.array(some["wanted"].tolist(), np.int64).tobytes() if "wanted" in some else b""
        with np.errstate(over="ignore"):
            out.append((dim, grp, len(some), *[some[c].to_numpy(np.int64).tobytes() for c in ("vec_id", "at", "label")], x.tobytes(), m.astype(np.float32).tobytes(), d.astype(np.float32).tobytes(), wanted))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _PACK.split(", ")])


def _met(anchors: DataFrame, vectors: DataFrame, groups: int, blocks: int, meet, schema: str) -> DataFrame:
    """Every block of anchors with every group of vectors of its length, one such pair a task."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = ["dim", "grp", "block"]
    left = anchors.withColumnRenamed("grp", "block").withColumn("grp", every(groups)).groupBy(*by)
    return left.cogroup(vectors.withColumn("block", every(blocks)).groupBy(*by)).applyInPandas(meet, schema)


def positives_of(rows: Rows, asks: Rows, k: int, top: float) -> Iterator[tuple]:
    """The k best rows of each anchor's own label: (anchor, its mark, row, score)."""
    order = np.argsort(rows.labels, kind="stable")
    names = rows.labels[order]
    for i in range(len(asks.ids)):
        own = order[np.searchsorted(names, asks.labels[i]) : np.searchsorted(names, asks.labels[i], "right")]
        own = own[rows.ids[own] != asks.ids[i]]
        idx, bound = refine(rows, own, asks, i, [(-np.inf, np.inf)], k)
        (found, scores), = best_first(rows, idx, bound, asks, i, [(-(1 << 63), (1 << 63) - 1)], k, top)[0]
        yield from ((int(asks.ids[i]), int(asks.at[i]), int(rows.ids[j]), int(s)) for j, s in zip(found, scores))


def score_window(positive: int) -> tuple[int, int]:
    """Scores s with LOW * positive <= 100 * s <= HIGH * positive; none where the first is above the second."""
    return -((-LOW * positive) // 100), (HIGH * positive) // 100


def negatives_of(rows: Rows, asks: Rows, k: int, top: float) -> Iterator[tuple]:
    """The k best rows of other labels in the window of each different score that an anchor wants."""
    for i in range(len(asks.ids)):
        scores = [int(p) for p in dict.fromkeys(asks.wanted[i].tolist())]
        wanted = [(p, w) for p, w in ((p, score_window(p)) for p in scores) if w[0] <= w[1]]
        if not wanted:
            continue
        other = np.flatnonzero((rows.labels != asks.labels[i]) & (rows.ids != asks.ids[i]))
        idx, bound = refine(rows, other, asks, i, [(float(lo), float(hi)) for _, (lo, hi) in wanted], k)
        found, _ = best_first(rows, idx, bound, asks, i, [w for _, w in wanted], k, top)
        for (p, _), (at, s) in zip(wanted, found):
            yield from ((int(asks.ids[i]), int(asks.at[i]), p, int(rows.ids[j]), int(v)) for j, v in zip(at, s))


def hard_negatives(vectors: DataFrame, vector: str = "embedding", label: str = "label", every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, group_bytes: int = GROUP_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score by integer inner products.

    Anchors are the rows whose vec_id is divisible by ``every``.  Their positives are the
    ``positives`` best other rows of the same label; for each of these the ``negatives`` best rows
    of another label count whose score lies between LOW and HIGH percent of the positive's; ties go
    to the smaller vec_id.  Components count as floor(256 * x).  Rows without vec_id or label, and
    vectors null, holding null or non-finite components (also 256 times as large), take no part;
    vectors meet those of their own length.  Rows repeated with id, label and vector are one; of
    several different rows with one vec_id each is a row of its own, and none is a candidate of
    another.  Scores beyond a long count as its bounds.  Other columns do not matter; an empty
    table gives no rows.

    A task holds a group of vectors (``group_bytes``) and a block of anchors (``block_bytes``).
    Anchors are copied once for each group, vectors once for each block: as a fixed share of the
    rows asks, work grows with the square of the rows, copies with the square over both sizes.
    Labels do not deal the rows out, so a label that most rows have makes no group larger.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), integer_codes(F.col(vector)).alias("codes"))
    rows = durable(rows.filter("vec_id is not null and label is not null and codes is not null").distinct().withColumns({"at": F.xxhash64("vec_id", "label", "codes"), "dim": F.size("codes")}), "negatives-rows")
    norm = F.aggregate("codes", F.lit(0.0), lambda a, x: a + x * x)
    size = F.col("dim") * 8 + 64
    asked = F.col("vec_id") % every == 0
    top, held, ask = rows.agg(F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(asked, size)), F.lit(0))).first()
    groups, blocks = max(1, -(-held // group_bytes)), max(1, -(-ask // block_bytes))
    dealt = lambda df, n: df.withColumn("grp", F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")).groupBy("dim", "grp").applyInPandas(_pack, _PACK)
    packs = durable(dealt(rows, groups), "negatives-packs")
    anchors = rows.filter(asked)

    def first(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = list(positives_of(Rows(x), Rows(q), positives, top)) if len(q) and len(x) else []
        return pd.DataFrame(out, columns=["anchor_id", "at", "positive_id", "positive_score"]).astype("int64")

    def second(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = list(negatives_of(Rows(x), Rows(q), negatives, top)) if len(q) and len(x) else []
        return pd.DataFrame(out, columns=["anchor_id", "at", "positive_score", "negative_id", "negative_score"]).astype("int64")

    near = _met(dealt(anchors, blocks), packs, groups, blocks, first, "anchor_id long, at long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id", "at").orderBy(F.col("positive_score").desc(), "positive_id")
    near = durable(near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives).drop("_n"), "negatives-positives")
    # at most ``positives`` scores for each anchor, made up to that number by repeating the first
    scores = near.groupBy("anchor_id", "at").agg(F.sort_array(F.collect_list("positive_score")).alias("_s"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda j: F.coalesce(F.get("_s", j), F.get("_s", F.lit(0))))
    asking = anchors.join(scores.select(F.col("anchor_id").alias("vec_id"), "at", padded.alias("wanted")), ["vec_id", "at"])
    far = _met(dealt(asking, blocks), packs, groups, blocks, second, "anchor_id long, at long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "at", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return near.join(far, ["anchor_id", "at", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are shifted where vec_id is divisible by 7."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives(rows.select("vec_id", "embedding", moved.alias("label")))


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT q.vec_id AS a, x.vec_id AS b, q.l = x.l AS same, CAST(list_sum(list_transform(list_zip(q.c, x.c), lambda t: t[1] * t[2])) AS BIGINT) AS s
      FROM v q JOIN v x ON x.vec_id <> q.vec_id AND len(x.c) = len(q.c) WHERE q.vec_id % 50 = 0),
p AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.a, p.b AS positive, p.s AS ps, n.b, n.s, row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS r
      FROM p JOIN s n ON p.a = n.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT a AS anchor_id, positive AS positive_id, CAST(r AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM n WHERE r <= 3
"""
