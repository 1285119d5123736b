"""Near-dedup with SetSketch registers.

Each register holds the exponentially spaced, truncated minimum of an exponential
variable over the shingles of a text.  Equal sets have equal registers, registers of
parts merge by their maximum, and two registers are equal with about the Jaccard
similarity of the sets: bands of equal registers find candidates, the registers of a
pair estimate its similarity by maximum likelihood, and full shingle sets verify it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.shared import BYTE_CODES, durable, mix64, prefix_hash, slices, table, window_hash, word_bounds

REGISTERS = 128
#: Registers in a band: at similarity 0.8, 32 bands of 4 miss a pair once in 20 million.
BAND = 4
#: Base and rate of the register scale.
SCALE, RATE = 1.001, 20.0
#: Members of a bucket that meet another such part of it in one task.
BUCKET_PART = 512
#: Buckets of more than one in so many of all members meet their leader in a broadcast; there are fewer of them than this.
HEAVY = 1000
#: A candidate goes on if its estimate is at most so far below the threshold (over five deviations).
SLACK = 0.2

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_STEPS = mix64(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the k-word shingles of each row of an Arrow string column."""
    for _, data, offsets in slices(column):
        start, end, row = word_bounds(~_BLANK[data], offsets)
        word = window_hash(prefix_hash(BYTE_CODES[_LOWER[data]]), start, end)
        counts = np.bincount(row, minlength=len(offsets) - 1)
        first = np.cumsum(counts) - counts
        full = np.zeros(max(0, len(word) - k + 1), np.uint64)
        for j in range(k if len(full) else 0):
            full += word[j : j + len(full)] * _STEPS[j]
        full = mix64(full)
        for n, at in zip(counts.tolist(), first.tolist()):
            if n >= k:
                yield np.unique(full[at : at + n - k + 1])
            elif n:
                short = (word[at : at + n] * _STEPS[:n]).sum(dtype=np.uint64) 
                yield mix64(np.array([short], np.uint64) + np.array([n], np.uint64) * _STEPS[-1:])
            else:
                yield np.zeros(0, np.uint64)


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """SetSketch registers of each set, (sets, m) of 16 bits.

    A shingle's points form a Poisson process; each point falls on a random register, so
    that every register gets an independent exponential variable of every shingle.  Points
    beyond the largest minimum so far change nothing, which ends the process early.
    """
    least = np.full(len(sets) * m, np.inf)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    x = np.zeros(len(h))
    rounds = 0
    while len(h):
        h = mix64(h + np.uint64(0x9E3779B97F4A7C15))
        x = x - np.log1p(-((h >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / (RATE * m)
        np.minimum.at(least, row * m + (h & np.uint64(m - 1)).astype(np.int64), x)
        rounds += 1
        if rounds < 8 or rounds % 8 == 0:
            alive = x < least.reshape(-1, m).max(axis=1)[row]
            h, x, row = h[alive], x[alive], row[alive]
    with np.errstate(over="ignore", divide="ignore"):
        value = np.where(np.isinf(least), 0, np.clip(np.floor(1 - np.log(least) / np.log(SCALE)), 0, 65535))
    return value.reshape(-1, m).astype("<u2")


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs of register rows, given the set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u / v, v / u)
    best, value = np.full(len(a), -np.inf), np.zeros(len(a))
    p = lambda x: -np.log1p(-x * (SCALE - 1) / SCALE) / np.log(SCALE)
    for t in np.linspace(0, 1, 101):
        j = t * top
        up, down = p(np.maximum(u - v * j, 0)), p(np.maximum(v - u * j, 0))
        same = np.maximum(1 - up - down, 1e-12)
        score = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + equal * np.log(same)
        better = score > best
        best, value = np.where(better, score, best), np.where(better, j, value)
    return value


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hash of the text, set size, 128-bit key of the set and its registers."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, regs, held = [], [], [], []

            def flush() -> None:
                regs.extend(r.tobytes() for r in registers(held))
                held.clear()

            for s in shingle_sets(batch.column(2), k):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                held.append(s)
                if len(held) >= 512:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], ["doc_id", "t", "n_shingles", "node", "registers"])

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("t"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, t long, n_shingles long, node binary, registers binary")


def _similar(n: DataFrame, percent: int) -> DataFrame:
    return n.filter(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes allow the threshold and whose estimate comes near it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                regs = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (4, 5)]
                likely = estimate(*regs, batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float))
                keep = pa.array(likely >= percent / 100 - SLACK)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    of = lambda s: classes.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    sized = _similar(pairs.join(of("a"), "a").join(of("b"), "b"), percent)
    return sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a binary, b binary")


def _texts(nodes: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The text of one document of each class."""
    wanted = classes.join(nodes, "node", "left_semi").select("node", F.col("one.doc_id").alias("_d"), F.col("one.t").alias("_t"))
    source = docs.select("doc_id", F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("node", "text")
    return durable(texts.dropDuplicates(["node"]), "neardup-texts")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold."""
    pairs = durable(pairs, "neardup-pairs")
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k))
            keep = pa.array([_linked(x, y, percent) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return durable(pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary"), "neardup-links")


def _likely(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Likely pairs of different components among the rows of one task, and their estimates.

    A pair counts in the first band only whose registers it shares, so that no other bucket
    repeats it; where two parts of a bucket meet, only pairs across them count.
    """
    regs = np.frombuffer(b"".join(pdf["registers"]), "<u2").reshape(len(pdf), -1)
    size, root = pdf["n_shingles"].to_numpy().astype(float), pd.factorize(pdf["root"])[0]
    part, band = pdf["part"].to_numpy(), pdf["key"].iloc[0][-1]
    across = pdf["lo"].iloc[0] != pdf["hi"].iloc[0]
    left, right = [], []
    for i in range(len(pdf) - 1):
        fit = (root[i + 1 :] != root[i]) & (100 * np.minimum(size[i + 1 :], size[i]) >= percent * np.maximum(size[i + 1 :], size[i]))
        if across:
            fit &= part[i + 1 :] != part[i]
        other = np.flatnonzero(fit) + i + 1
        if len(other):
            same = regs[other] == regs[i]
            first = same.reshape(len(other), -1, BAND).all(axis=2).argmax(axis=1) == band
            other = other[first & (same.mean(axis=1) >= percent / 100 - SLACK - 0.1)]
            left.append(np.full(len(other), i))
            right.append(other)
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    value = np.concatenate([np.zeros(0), *[estimate(regs[left[at : at + 4096]], regs[right[at : at + 4096]], size[left[at : at + 4096]], size[right[at : at + 4096]]) for at in range(0, len(left), 4096)]])
    keep = value >= percent / 100 - SLACK
    return left[keep], right[keep], value[keep]


def _of_keys(members: DataFrame, keys: DataFrame, least: float, how: str = "inner") -> DataFrame:
    """Members with what ``keys`` has for their bucket; ``keys`` has its size n, too.

    Fewer than HEAVY buckets hold more than ``least`` = one in HEAVY of all members: these are
    broadcast, so that no task gets all members of a hot bucket; the rest meet in a shuffle.
    """
    heavy, light = F.broadcast(keys.filter(F.col("n") > least).drop("n")), keys.filter(F.col("n") <= least).drop("n")
    return members.filter(F.col("n") > least).join(heavy, "key", how).unionByName(members.filter(F.col("n") <= least).join(light, "key", how))


def _left_over(members: DataFrame, links: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components in buckets that the leaders did not connect.

    A large bucket is cut into parts by hash, and each pair of parts meets in a task of its
    own.  First the registers tell which classes have a likely partner in another component;
    only these meet again with their texts.  There pairs are verified by falling estimate,
    those whose components have met by then are skipped, and only links come out: never
    more than there are classes.
    """
    least = members.count() / HEAVY
    crowded = members.filter("n > 2").select("key", "node", "n").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = crowded.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.first("n").alias("n")).filter("x <> y").select("key", "n")
    rows = (
        _of_keys(crowded, apart, least, "left_semi")
        .join(classes.select("node", "n_shingles", "registers"), "node")
        .withColumn("parts", F.ceil(F.col("n") / BUCKET_PART).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "node", "root", "n_shingles", "registers")
    )
    columns = "key binary, lo int, hi int, part int, node binary, root binary, n_shingles long, registers binary"

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, _ = _likely(pdf, percent)
        return pdf.iloc[np.union1d(left, right)]

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, value = _likely(pdf, percent)
        sets, node = list(shingle_sets(pa.array(pdf["text"], pa.string()), k)), pdf["node"].to_numpy()
        parent = list(range(len(pdf)))
        root = pd.factorize(pdf["root"])[0].tolist()

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for at in np.argsort(-value, kind="stable"):
            i, j = int(left[at]), int(right[at])
            x, y = find(root[i]), find(root[j])
            if x != y and _linked(sets[i], sets[j], percent):
                parent[y] = x
                out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    likely = durable(rows.groupBy("key", "lo", "hi").applyInPandas(meet, columns), "neardup-likely")
    texts = _texts(likely.select("node").distinct(), docs, classes)
    return durable(likely.join(texts, "node").groupBy("key", "lo", "hi").applyInPandas(verify, "a binary, b binary"), "neardup-links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by the Jaccard similarity of their k-word shingles.

    A-Z are lower-cased, words end at ASCII blanks, and a set holds the distinct shingles of
    the whole text (of fewer than k words, the sequence as one).  Documents with
    100 * intersection >= percent * union are linked, and links chain.  Returns doc_id,
    n_shingles, component_id (smallest doc_id of the group) and kept (doc_id = component_id)
    for each input row.  Texts without words, or null, are linked with nothing; a null
    doc_id counts as the largest, is never the name of a group that has another, and is kept
    only where its group has no other name.  Repeated rows are one document and get the same
    answer.  Texts of any length are taken whole, other columns do not matter, an empty table gives
    no rows.  Equal sets are one class: copies cost one row each, and only classes are paired.
    In each bucket all classes are first verified against the one that meets most others, which
    connects a group of any size in linear work; what stays unconnected meets in bounded parts.
    """
    sketches = durable(sketch(docs, k), "neardup-sketches")
    classes = sketches.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("one"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = durable(classes, "neardup-classes")
    keys = F.array(*[F.concat(F.substring("registers", 2 * BAND * i + 1, 2 * BAND), F.lit(bytes([i]))) for i in range(REGISTERS // BAND)])
    bands = classes.select(F.explode(keys).alias("key"), "node")
    several = bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = durable(bands.join(several, "key"), "neardup-members")
    # the class that meets most others leads its buckets: an original rather than one of its variants
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = members.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node")).alias("leader"), F.first("n").alias("n")).select("key", F.col("leader.node").alias("leader"), "n")
    first = _of_keys(members, leaders, members.count() / HEAVY).filter("node <> leader").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    links = _verified(_plausible(first, classes, percent), docs, classes, k, percent)
    links = links.unionByName(_left_over(members, links, docs, classes, k, percent))
    rooted = classes.select("node", "least").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(rooted.join(names, "root").select(F.col("node").alias("_node"), "component_id"), "neardup-named")
    out = sketches.select("doc_id", "n_shingles", "node").join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)
