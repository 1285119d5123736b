"""Exact n-gram Jaccard join by filters under several global orders.

Whatever order all shingles are put in, two sets of the wanted similarity share a shingle
among the first ones of both: few enough that the other shingles cannot make up for it.
Three orders are used.  Under the order of the shingles' hashes a slightly longer prefix must hold
several shingles that other texts have in theirs; texts without them are left out at
once.  Among the others the order from rare to frequent shingles makes buckets of texts
that share a prefix shingle.  A pair of a bucket is a candidate only if its prefixes under the
rising and the falling order of hashes share one, too.  Candidates are verified on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.components import components
from tidewell.llm.neardup import shingle_sets
from tidewell.llm.shared import durable, mix64, table

K, PERCENT = 5, 80
#: Shingles of all texts whose third (the prefixes) meets in one task, about.
PART_ROWS = 1 << 23
#: Bytes of the hashes of shingles and of classes that the first filter sends.
TOKEN, NAME = 6, 5
#: Members of a bucket that meet another such part of it in one task.
BUCKET_PART = 512
#: Keys of more than one in so many of all rows are broadcast; there are fewer of them than this.
HEAVY = 1000
#: Shingles compared at a time when two parts meet.
CHUNK = 4096


def spare(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Shingles that a set of n may have beyond those of a partner: n less the least overlap."""
    return n * (100 - percent) // 100


def _hash_prefix(n: int, percent: int) -> tuple[int, int]:
    """Length of the prefix under the order of hashes, and how many of its shingles a partner's prefix shares.

    The j least common shingles lie in both prefixes if each is longer than what its set may have
    beyond the common ones by j; a partner has at least percent/100 of n shingles.
    """
    return spare(n, percent) + 1 + n // 10, 1 + -(-n * percent // 100) // 10


def _key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, hash of the text, set size and 128-bit key of the set."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), _key(s)) for s in shingle_sets(batch.column(2), k)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["doc_id", "t", "n_shingles", "node"])

    return docs.select("doc_id", F.xxhash64(_text(docs)).alias("t"), _text(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, t long, n_shingles long, node binary")


def _bytes(x: np.ndarray, n: int) -> bytes:
    """The low n bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def _numbers(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(-1, n)
    return out.reshape(-1).view("<u8")


def _name(node: Column) -> Column:
    """The first NAME bytes of a key as a number, low byte first; 1 for 0."""
    bytes_of = [F.conv(F.hex(F.substring(node, i + 1, 1)), 16, 10).cast("long") * (1 << 8 * i) for i in range(NAME)]
    return F.greatest(reduce(lambda a, b: a + b, bytes_of), F.lit(1).cast("long"))


def _shared_counts(docs: DataFrame, parts: int, k: int, percent: int) -> DataFrame:
    """How many prefix shingles of each class (by NAME bytes of its key) other classes have in their prefixes.

    Classes of a batch count once; a shingle that several of them share counts there, and leaves the
    batch once and without a class: so no common shingle brings more entries to a task than there are
    batches.  Shingles and classes travel as a few bytes of their hashes; equal ones, and a class that lies
    in several batches, can only raise counts, which keeps more classes, never fewer.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads: dict[int, np.ndarray] = {}
            for s in shingle_sets(batch.column(0), k):
                if len(s):
                    # a name of 0 marks shingles that have been counted
                    heads[max(1, int.from_bytes(_key(s)[:NAME], "little"))] = np.unique(s[: _hash_prefix(len(s), percent)[0]] >> np.uint64(64 - 8 * TOKEN))
            if not heads:
                continue
            names = np.repeat(np.fromiter(heads, np.uint64), [len(h) for h in heads.values()])
            tokens = np.concatenate(list(heads.values()))
            order = np.argsort(tokens, kind="stable")
            tokens, names = tokens[order], names[order]
            first = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            times = np.diff(first, append=len(tokens))
            own, here = np.unique(names[np.repeat(times > 1, times)], return_counts=True)
            tokens, names = tokens[first], np.where(times > 1, np.uint64(0), names[first])
            part = (mix64(tokens) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = [(i, _bytes(tokens[order[a:b]], TOKEN), _bytes(names[order[a:b]], NAME), b"", b"") for i, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
            if len(own):
                out.append((int(own[0] % np.uint64(parts)), b"", b"", _bytes(own, NAME), here.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int32()] + [pa.binary()] * 4)], ["part", "tokens", "names", "own", "here"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        both = np.unique(np.stack([_numbers(b"".join(pdf["tokens"]), TOKEN), _numbers(b"".join(pdf["names"]), NAME)], axis=1), axis=0)
        same = both[1:, 0] == both[:-1, 0]
        met = both[np.append(same, False) | np.append(False, same), 1] if len(both) else np.zeros(0, np.uint64)
        met, here = met[met != 0], np.frombuffer(b"".join(pdf["here"]), "<u4")
        own, at = np.unique(np.append(met, _numbers(b"".join(pdf["own"]), NAME)), return_inverse=True)
        n = np.bincount(at.reshape(-1), np.append(np.ones(len(met)), here), len(own))
        return pd.DataFrame({"name": own.astype(np.int64), "n": n.astype(np.int64)})

    rows = docs.select(_text(docs).alias("text")).mapInArrow(spread, "part int, tokens binary, names binary, own binary, here binary")
    return rows.groupBy("part").applyInPandas(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("shared"))


def _texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node, n_shingles and the text of one document of each class."""
    wanted = classes.select("node", "n_shingles", F.col("one.doc_id").alias("_d"), F.col("one.t").alias("_t"))
    source = docs.select("doc_id", _text(docs).alias("text")).withColumn("t", F.xxhash64("text"))
    texts = source.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_t"))).select("node", "n_shingles", "text")
    return durable(texts.dropDuplicates(["node"]), "jaccard-texts")


def _of_keys(rows: DataFrame, keys: DataFrame, least: float, how: str = "inner") -> DataFrame:
    """Rows with what ``keys`` (key, n, …) has for their key; keys of more than ``least`` rows, fewer than HEAVY, are broadcast."""
    heavy, light = keys.filter(F.col("n") > least), keys.filter(F.col("n") <= least)
    common = F.broadcast(heavy.select("key"))
    return rows.join(F.broadcast(heavy), "key", how).unionByName(rows.join(common, "key", "left_anti").join(light, "key", how))


def _orders(texts: DataFrame, k: int, percent: int) -> DataFrame:
    """node, n_shingles, its shared prefix shingles under the order from rare to frequent, the place of the first of them, and its prefixes up and down the hashes.

    Shingles of one text only come first in that order and make no bucket; they shorten the rest of the prefix.
    """

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            node = batch.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
            yield pa.RecordBatch.from_arrays([node, pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64))], ["node", "key"])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), k))
            # four bytes of a hash do for a filter: equal ones keep more pairs, never fewer
            short = lambda s: (s >> np.uint64(16)).astype(np.uint32).tobytes()
            cut = [spare(len(s), percent) + 1 for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([short(s[:c]) for s, c in zip(sets, cut)], pa.binary()), pa.array([short(s[-c:]) for s, c in zip(sets, cut)], pa.binary())], ["node", "up", "down"])

    each = durable(texts.select("node", "text").mapInArrow(tokens, "node binary, key long"), "jaccard-tokens")
    often = durable(each.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "jaccard-often")
    met = _of_keys(each, often, each.count() / HEAVY).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("met"))
    first = met.join(texts.select("node", "n_shingles"), "node")
    # of the prefix, what the unshared shingles leave: spare + 1 - (n_shingles - shared)
    own = F.col("n_shingles") - F.size("met")
    left = F.floor(F.col("n_shingles") * (100 - percent) / 100) + 1 - own
    rare = first.filter(left > 0).select("node", "n_shingles", F.transform(F.slice("met", F.lit(1), left.cast("int")), lambda x: x["key"]).alias("rare"), own.alias("own"))
    return durable(rare.join(texts.select("node", "text").mapInArrow(ends, "node binary, up binary, down binary"), "node"), "jaccard-orders")


def _reach(n: str, other: str, percent: int) -> Column:
    """How long the prefix of a set of ``n`` is in a pair: n less the least overlap of both sizes, plus 1."""
    return F.col(n) - F.ceil((F.col(n) + F.col(other)) * percent / (100 + percent)) + 1


def _of_sizes(n: str, other: str, percent: int) -> Column:
    return F.least(n, other) * 100 >= F.greatest(n, other) * percent


def _candidates(pairs: DataFrame, orders: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a shingle of their prefixes under the other orders, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, u, v, x, y in zip(*[batch.column(i).to_pylist() for i in range(2, 8)]):
                up, down = ([np.frombuffer(raw, np.uint32) for raw in two] for two in ((u, v), (x, y)))
                keep.append(len(np.intersect1d(up[0][:n], up[1][:m])) > 0 and len(np.intersect1d(down[0][-n:], down[1][-m:])) > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    of = lambda s: orders.select(F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n_shingles", "up", "down")])
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    reach = [_reach("n_shingles_a", "n_shingles_b", percent).alias("m_a"), _reach("n_shingles_b", "n_shingles_a", percent).alias("m_b")]
    return durable(both.select("a", "b", *reach, "up_a", "up_b", "down_a", "down_b").mapInArrow(run, "a binary, b binary"), "jaccard-candidates")


def _met(one: DataFrame, two: DataFrame, more: Column, percent: int) -> DataFrame:
    """Pairs of a bucket whose sizes and whose places of the bucket's shingle allow the wanted similarity."""
    fit = (F.col("x.key") == F.col("y.key")) & more & _of_sizes("x.size", "y.size", percent) & (F.col("x.place") <= _reach("x.size", "y.size", percent)) & (F.col("y.place") <= _reach("y.size", "x.size", percent))
    return one.alias("x").join(two.alias("y"), fit).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(shingle_sets(batch.column(2), k), shingle_sets(batch.column(3), k))
            keep = pa.array([_linked(x, y, percent) for x, y in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    of = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    return durable(pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary"), "jaccard-links")


def _overlap(raw: list[bytes], kind: type = np.uint32) -> np.ndarray:
    """How many values each pair of rows shares."""
    each = [np.frombuffer(b, kind) for b in raw]
    _, at = np.unique(np.concatenate(each), return_inverse=True)
    row = np.repeat(np.arange(len(each)), [len(e) for e in each])
    out = np.zeros((len(each), len(each)), np.float32)
    for lo in range(0, int(at.max(initial=-1)) + 1, CHUNK):
        own = (at >= lo) & (at < lo + CHUNK)
        m = np.zeros((len(each), CHUNK), np.float32)
        m[row[own], at[own] - lo] = 1
        out += m @ m.T
    return out


def _likely(pdf: pd.DataFrame, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs of different components among the rows of a task, those of the most common prefix shingles first."""
    size, root, odd, place = pdf["size"].to_numpy(), pd.factorize(pdf["root"])[0], pdf["side"].to_numpy(), pdf["place"].to_numpy()
    fit = (root[:, None] != root[None, :]) & (100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :]))
    # the bucket's shingle lies in the prefixes that sets of both sizes need
    overlap = -(-(size[:, None] + size[None, :]) * percent // (100 + percent))
    fit &= (place[:, None] <= size[:, None] - overlap + 1) & (place[None, :] <= size[None, :] - overlap + 1)
    if pdf["lo"].iloc[0] != pdf["hi"].iloc[0]:
        fit &= odd[:, None] != odd[None, :]
    fit = np.triu(fit, 1)
    if not fit.any():
        return (np.zeros(0, np.int64),) * 3
    up = _overlap(pdf["up"].tolist())
    fit &= up > 0
    if fit.any():
        down = _overlap(pdf["down"].tolist())
        fit &= down > 0
        up += down
    left, right = np.nonzero(fit)
    order = np.argsort(-up[left, right], kind="stable")
    return left[order], right[order], up[left, right][order]


def _left_over(members: DataFrame, found: DataFrame, orders: DataFrame, texts: DataFrame, least: float, k: int, percent: int) -> DataFrame:
    """Links between the components ``found`` in buckets that the leaders did not connect.

    In such a bucket the members outside its largest component are odd; pairs of the largest
    component are never looked at.  In buckets of up to BUCKET_PART members each odd one meets those of other
    components.  In larger ones parts of odd members meet the parts of all others and each other, one
    pair of parts a task: first the filters tell which classes have a candidate in another
    component, and only these meet again with their texts.  There candidates are verified, those
    whose components have met by then are skipped, and only links come out.
    """

    rooted = durable(members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-rooted")
    by_root = rooted.groupBy("key", "root").agg(F.count("*").alias("m"), F.first("n").alias("n"))
    apart = by_root.groupBy("key").agg(F.max(F.struct("m", "root")).alias("main"), F.first("n").alias("n")).filter(F.col("main.m") < F.col("n"))
    apart = durable(apart.select("key", "n", F.col("main.root").alias("main"), F.col("main.m").alias("m")), "jaccard-apart")
    rows = rooted.drop("n")
    few = durable(rows.join(apart.filter(F.col("n") <= BUCKET_PART), "key").withColumn("odd", F.col("root") != F.col("main")), "jaccard-few")
    pairs = _met(few.filter("odd"), few, (F.col("x.root") != F.col("y.root")) & (~F.col("y.odd") | (F.col("x.node") < F.col("y.node"))), percent)
    more = _verified(_candidates(pairs, orders, percent), texts, k, percent)
    crowded = apart.filter(F.col("n") > BUCKET_PART)
    if crowded.isEmpty():
        return more
    of = lambda n: F.ceil(n / BUCKET_PART).cast("int")
    rows = _of_keys(rows, crowded, least).withColumns({"odd": F.col("root") != F.col("main"), "odds": of(F.col("n") - F.col("m")), "mains": of(F.col("m"))})
    # odd parts are numbered from 0, those of the largest component after them
    own = F.when(F.col("odd"), F.pmod(F.xxhash64("node"), F.col("odds"))).otherwise(F.col("odds") + F.pmod(F.xxhash64("node"), F.col("mains"))).cast("int")
    others = F.when(F.col("odd"), F.sequence(F.lit(0), F.col("odds") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("odds") - 1))
    rows = rows.withColumn("side", own).withColumn("other", F.explode(others)).select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node", "root", "size", "place")
    met = rows.join(orders.select("node", "up", "down"), "node")
    columns = "key long, lo int, hi int, side int, node binary, root binary, size long, place long, up binary, down binary"

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, _ = _likely(pdf, percent)
        return pdf.iloc[np.union1d(left, right)][[c.split()[0] for c in columns.split(", ")]]

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right, _ = _likely(pdf, percent)
        sets, node = list(shingle_sets(pa.array(pdf["text"], pa.string()), k)), pdf["node"].to_numpy()
        root = pd.factorize(pdf["root"])[0].tolist()
        parent = list(range(len(pdf)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for i, j in zip(left.tolist(), right.tolist()):
            x, y = find(root[i]), find(root[j])
            if x != y and _linked(sets[i], sets[j], percent):
                parent[y] = x
                out.append((node[i], node[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    likely = durable(met.groupBy("key", "lo", "hi").applyInPandas(meet, columns), "jaccard-likely")
    return more.unionByName(durable(likely.join(texts.select("node", "text"), "node").groupBy("key", "lo", "hi").applyInPandas(verify, "a binary, b binary"), "jaccard-links"))


def jaccard_groups(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Documents grouped by the links of an exact Jaccard join on their k-word shingles.

    A-Z are lower-cased, words end at ASCII blanks, and a set holds the distinct shingles of the
    whole text (of fewer than k words, the sequence as one).  Documents with
    100 * intersection >= percent * union are linked, and links chain.  Returns doc_id,
    n_shingles and component_id (smallest doc_id of the group) for each input row.  Texts
    without words, or null, are linked with nothing; a null doc_id counts as the largest and
    names only a group that has no other.  Repeated rows get the same answer.  Texts of any
    length are taken whole, other columns do not matter, an empty table gives no rows.
    Shingles are 64-bit hashes.

    No similar pair is missed: each filter keeps all of them.  Equal sets are one class, and only
    classes are paired.  Each bucket's classes are first verified against the one that meets most
    others, which connects a group of any size in linear work; only members that this leaves
    outside the largest component of their bucket meet its others, in bounded parts.
    """
    sets = durable(_sets(docs, k), "jaccard-sets")
    classes = sets.filter("n_shingles > 0").groupBy("node").agg(F.min(F.struct("doc_id", "t")).alias("one"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"))
    classes = durable(classes, "jaccard-classes")
    total = classes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    shared = _shared_counts(docs, max(1, -(-total // PART_ROWS)), k, percent)
    need = 1 + F.floor(F.ceil(F.col("n_shingles") * percent / 100) / 10)
    alive = classes.withColumn("name", _name(F.col("node"))).join(shared, "name").filter(F.col("shared") >= need)
    texts = _texts(docs, alive)
    orders = _orders(texts, k, percent)
    bands = orders.select("node", F.col("n_shingles").alias("size"), "own", F.posexplode("rare").alias("_i", "key")).withColumn("place", F.col("own") + F.col("_i") + 1).drop("own", "_i")
    often = durable(bands.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "jaccard-keys")
    members = durable(_of_keys(bands, often, bands.count() / HEAVY), "jaccard-members")
    # the class that meets most others leads its buckets: an original rather than one of its variants
    reach = members.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = members.join(reach, "node").groupBy("key").agg(F.max(F.struct("met", "node", "size", "place")).alias("leader"), F.first("n").alias("n")).select("key", "leader", "n")
    least = members.count() / HEAVY
    led = _of_keys(members.drop("n"), leaders, least).withColumns({"_size": F.col("leader.size"), "_place": F.col("leader.place"), "_node": F.col("leader.node")}).filter(F.col("node") != F.col("_node"))
    led = led.filter(_of_sizes("size", "_size", percent) & (F.col("place") <= _reach("size", "_size", percent)) & (F.col("_place") <= _reach("_size", "size", percent)))
    pairs = led.select(F.least("_node", "node").alias("a"), F.greatest("_node", "node").alias("b")).distinct()
    links = _verified(_candidates(pairs, orders, percent), texts, k, percent)
    found = durable(components(links), "jaccard-found")
    more = _left_over(members, found, orders, texts, least, k, percent)
    if not more.isEmpty():
        root = lambda s: found.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}"))
        apart = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        joined = components(apart).select(F.col("node").alias("_a"), F.col("root").alias("_b"))
        # classes of a joined component, and its former root or single class itself
        found = found.join(joined, F.col("root") == F.col("_a"), "left").select("node", F.coalesce("_b", "root").alias("root")).unionByName(joined.select(F.col("_a").alias("node"), F.col("_b").alias("root")))
    rooted = classes.select("node", "least").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = durable(rooted.join(names, "root").select(F.col("node").alias("_node"), "component_id"), "jaccard-named")
    out = sets.select("doc_id", "n_shingles", "node").join(named, F.col("node") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = d.doc_id), d.doc_id)) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
