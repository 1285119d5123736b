"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

The texts lie in blocks.  Each start p of a ``length``-byte string has an anchor, the
position of the least 8-byte hash among the WINDOW positions from p on; equal strings
have their anchors at the same place, so both hold the same core of bytes from the anchor
on.  Starts with one anchor form a segment.  First, segments whose core hash occurs once
are ruled out.  Then segments of equal context (all bytes that their strings cover) are
settled at once.  What is left, segments that share a core but not the context (around
edits and at the ends of passages), is sorted: each task sorts the suffixes at its
anchors into a run, cuts it at common splitters and front-codes it; a reducer merges the
runs with a loser tree that knows each suffix's common prefix with the last winner
and never compares those bytes again.  The common prefixes to the right of the anchors
and common suffixes to their left tell which starts repeat.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import BYTE_CODES, durable, mix64, new_folder, prefix_hash, table, window_hash

LENGTH = 400
#: Positions among which a start finds its anchor; a power of two.
WINDOW = 64
BLOCK_BYTES = 1 << 21
#: Anchors whose hashes one task compares, about.
BUCKET_ANCHORS = 1 << 19
#: Suffixes that one task merges, about.
MERGE_ROWS = 1 << 15
#: Contexts of one core that may meet in a task; of more, each start is settled on its own.
HOT_CONTEXTS = 4096
#: Blocks that a core may lie in for its contexts to meet in a task; of a core in more, contexts are dealt by their own hash.
CROWDED_BLOCKS = 512
#: Segments from which splitters are drawn, at most.
SPLITTER_ROWS = 2048
SECOND_CODES = mix64(BYTE_CODES + np.uint64(77))

_KEY = np.dtype([("core", "<u8"), ("x", "<u8"), ("y", "<u8"), ("lo", "<u4"), ("n", "<u2"), ("d", "<u2"), ("several", "u1"), ("crowded", "u1")])
_LOCAL = np.dtype([("lo", "<u4"), ("n", "<u2"), ("key", "<u4")])
_VERDICT = np.dtype([("lo", "<u4"), ("n", "<u2"), ("d", "<u2"), ("hot", "u1"), ("alone", "u1")])
_ITEM = np.dtype([("lcp", "<u2"), ("tail", "<u2"), ("d", "<u2"), ("n", "<u2"), ("lo", "<u4"), ("block", "<u2"), ("alone", "u1")])
_PARTS = "kind string, block long, part int, data binary, more binary"


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last start of each segment of a block."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    gram = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).tobytes(), strides=(1,))
    low = np.uint64(0xFFFFFFFF)
    key = gram * np.uint64(0x9E3779B97F4A7C15)
    key &= ~low
    key |= low - np.arange(len(key), dtype=np.uint64)
    step = 1
    while step < WINDOW:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    at = (low - (key[:n] & low)).astype(np.int64)
    change = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(np.diff(offsets) >= length)
    change[offsets[long]] += 1
    change[offsets[long + 1] - length + 1] -= 1
    valid = np.cumsum(change[:n]) > 0
    same = np.zeros(n + 1, bool)
    same[1:n] = valid[1:] & valid[:-1] & (at[1:] == at[:-1])
    lo, hi = np.flatnonzero(valid & ~same[:n]), np.flatnonzero(valid & ~same[1:])
    return at[lo], lo, hi


def _pack(docs: DataFrame) -> DataFrame:
    """Blocks of whole texts: block, ids, lens and the compressed bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, serial, ids, texts, size = zstandard.ZstdCompressor(level=1), 0, [], [], 0
        first = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([first + serial], pa.int64()), pa.array([ids], pa.list_(of)), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([press.compress(b"".join(texts))], pa.binary())],
                ["block", "ids", "lens", "data"],
            )

        for batch in batches:
            of = batch.schema.field(0).type
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = (text.as_py() or "").encode()
                if texts and size + len(text) > BLOCK_BYTES:
                    yield block()
                    serial, ids, texts, size = serial + 1, [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
        if texts:
            yield block()

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, f"block long, ids array<{kind}>, lens array<long>, data binary")


def _open(data: bytes, lens: list[int]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(offsets[-1]))), np.uint8), offsets


def _rows(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_PART_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    return _rows(rows, ["kind", "block", "part", "data", "more"], _PART_TYPES)


def _core_hashes(blocks: DataFrame, length: int, buckets: int) -> DataFrame:
    """Each block's core hashes by bucket: those it holds once, and those it holds several times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lens, packed in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                data, offsets = _open(packed, lens)
                at, _, _ = segments(data, offsets, length)
                core, n = np.unique(window_hash(prefix_hash(BYTE_CODES[data]), at, at + length - WINDOW + 1), return_counts=True)
                part = core % np.uint64(buckets)
                order = np.argsort(part, kind="stable")
                held, cuts = np.unique(part[order], return_index=True)
                rows = []
                for b, own in zip(held.tolist(), np.split(order, cuts[1:])):
                    rows.append(("core", block, b, core[own][n[own] == 1].tobytes(), core[own][n[own] > 1].tobytes()))
                yield _parts(rows)

    return blocks.select("block", "lens", "data").mapInArrow(run, _PARTS)


def _repeated_cores(crowded: int):
    """The cores of a bucket that occur more than once: kind crowd if in over ``crowded`` blocks, else core."""

    def repeated(pdf: pd.DataFrame) -> pd.DataFrame:
        once = [np.frombuffer(x, "<u8") for x in pdf["data"]]
        more = [np.frombuffer(x, "<u8") for x in pdf["more"]]
        core, n = np.unique(np.concatenate(once + more), return_counts=True)
        several = np.isin(core, np.concatenate(more))
        out = []
        for kind, which in (("core", ((n > 1) | several) & (n <= crowded)), ("crowd", n > crowded)):
            found = [np.concatenate([x[np.isin(x, core[which], assume_unique=True)] for x in (a, b)]).tobytes() for a, b in zip(once, more)]
            out.append(pd.DataFrame({"kind": kind, "block": pdf["block"], "part": 0, "data": found, "more": b""}))
        out = pd.concat(out)
        return out[out["data"].str.len() > 0]

    return repeated


def _with_parts(blocks: DataFrame, parts: DataFrame, how: str = "inner") -> DataFrame:
    """Blocks with all that was found for them; only the parts are shuffled, as blocks are bucketed."""
    found = parts.groupBy("block").agg(F.collect_list(F.struct("kind", "data")).alias("found"))
    return blocks.join(found, "block", how)


def _by_key(block: int, tag: str, buckets: int, core, x, y, lo, n, d, crowded) -> list[tuple]:
    """Local rows (which key each segment has) and one row of distinct keys for each bucket.

    Keys of a core meet in its bucket, those of a crowded core in the bucket of their context.
    """
    order = np.lexsort((y, x, core))
    new = np.ones(len(order), bool)
    new[1:] = (core[order][1:] != core[order][:-1]) | (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    key = np.zeros(len(order), np.int64)
    key[order] = np.cumsum(new) - 1
    count = np.bincount(key)
    first = order[new]
    local = np.zeros(len(order), _LOCAL)
    local["lo"], local["n"], local["key"] = lo, n, lo[first][key]
    keys = np.zeros(len(first), _KEY)
    for name, values in (("core", core), ("x", x), ("y", y), ("lo", lo), ("n", n), ("d", d), ("crowded", crowded)):
        keys[name] = values[first]
    keys["several"] = count > 1
    part = np.where(keys["crowded"] > 0, mix64(keys["x"]), keys["core"]) % np.uint64(buckets)
    rows = [(f"local{tag}", block, -1, local.tobytes(), b"")]
    order = np.argsort(part, kind="stable")
    held, cuts = np.unique(part[order], return_index=True)
    for b, own in zip(held.tolist(), np.split(order, cuts[1:])):
        rows.append((f"key{tag}", block, b, keys[own].tobytes(), b""))
    return rows


def _contexts(joined: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lens, packed, found in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                data, offsets = _open(packed, lens)
                at, lo, hi = segments(data, offsets, length)
                h = prefix_hash(BYTE_CODES[data])
                core = window_hash(h, at, at + length - WINDOW + 1)
                known = {kind: np.frombuffer(b"".join(f["data"] for f in found if f["kind"] == kind), "<u8") for kind in ("core", "crowd")}
                crowded = np.isin(core, known["crowd"])
                keep = crowded | np.isin(core, known["core"])
                at, lo, hi, core, crowded = at[keep], lo[keep], hi[keep], core[keep], crowded[keep]
                if len(at):
                    x = window_hash(h, lo, hi + length)
                    y = window_hash(prefix_hash(SECOND_CODES[data]), lo, hi + length)
                    yield _parts(_by_key(block, "", buckets, core, x, y, lo, hi - lo + 1, at - lo, crowded))

    return joined.select("block", "lens", "data", "found").mapInArrow(run, _PARTS)


def _judge(hot: int, tag: str):
    """Of the keys of a bucket: those that occur more than once, and those that share only the core.

    Other contexts of a crowded core lie in other buckets: each may share the core, and is hot.
    """

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(x, _KEY) for x in pdf["data"]]
        key, of = np.concatenate(each), np.repeat(np.arange(len(each)), [len(e) for e in each])
        order = np.lexsort((of, key["y"], key["x"], key["core"]))
        key, of = key[order], of[order]
        new_core = np.ones(len(key), bool)
        new_core[1:] = key["core"][1:] != key["core"][:-1]
        new = new_core.copy()
        new[1:] |= (key["x"][1:] != key["x"][:-1]) | (key["y"][1:] != key["y"][:-1])
        group, core = np.cumsum(new) - 1, np.cumsum(new_core) - 1
        many = (np.bincount(group) > 1) | (np.bincount(group, key["several"]) > 0)
        contexts = np.bincount(core, new)
        rows = []
        settled = many[group]
        heavy = (contexts[core] > hot) | (key["crowded"] > 0)
        open_ = new & ((contexts[core] > 1) | heavy)
        verdict = np.zeros(len(key), _VERDICT)
        for name in ("lo", "n", "d"):
            verdict[name] = key[name]
        verdict["hot"], verdict["alone"] = heavy, ~settled
        for kind, which in ((f"settled{tag}", settled), ("open", open_ if not tag else open_ & False)):
            picked = np.flatnonzero(which)
            picked = picked[np.argsort(of[picked], kind="stable")]
            for i in np.unique(of[picked]):
                own = picked[of[picked] == i]
                rows.append((kind, int(pdf["block"].iloc[i]), int(heavy[own].sum()), (key["lo"][own] if tag or kind == "settled" else verdict[own]).tobytes(), b""))
        return pd.DataFrame(rows, columns=["kind", "block", "part", "data", "more"])

    return judge


def _dense(found: list[dict]) -> np.ndarray:
    return np.concatenate([np.frombuffer(f["data"], _VERDICT) for f in found])


def _common(a: bytes, b: bytes, lo: int) -> int:
    """Length of the common prefix of a and b, of which lo bytes are known."""
    hi = min(len(a), len(b))
    if a[lo:hi] == b[lo:hi]:
        return hi
    step = 8
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
        step *= 2
    hi = min(hi, lo + step)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _runs(joined: DataFrame, length: int, splitters: list[bytes], buckets: int) -> DataFrame:
    """Sorted, front-coded suffix runs cut at the splitters; starts of hot cores by their own keys."""
    core_bytes = length - WINDOW + 1

    def code(items: list[tuple[bytes, bytes, int, int, int, int, int]], owners: list[int]) -> Iterator[pa.RecordBatch]:
        items.sort()
        rows, lo = [], 0
        while lo < len(items):
            part = bisect_right(splitters, items[lo][0][:core_bytes])
            hi = lo
            coded, tails, lefts, last = np.zeros(len(items) - lo, _ITEM), [], [], b""
            while hi < len(items) and (part == len(splitters) or items[hi][0][:core_bytes] < splitters[part]):
                right, left, d, n, start, own, alone = items[hi]
                known = _common(last, right, 0)
                coded[hi - lo] = (known, len(right) - known, d, n, start, own, alone)
                tails.append(right[known:])
                lefts.append(left)
                last, hi = right, hi + 1
            rows.append(("run", -1, part, coded[: hi - lo].tobytes(), np.array(owners, "<i8").tobytes() + np.array([len(owners), sum(map(len, tails))], "<i8").tobytes() + b"".join(tails) + b"".join(lefts)))
            lo = hi
        if rows:
            yield _parts(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: list = []
        owners: list[int] = []
        for batch in batches:
            for block, lens, packed, found in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                data, _ = _open(packed, lens)
                raw, seg = data.tobytes(), _dense(found)
                for lo, n, d, hot, alone in seg[seg["hot"] == 0].tolist():
                    items.append((raw[lo + d : lo + n - 1 + length], raw[lo : lo + d][::-1], d, n, lo, len(owners), alone))
                owners.append(block)
                if len(items) > 50_000 or len(owners) > 60_000:
                    yield from code(items, owners)
                    items, owners = [], []
                seg = seg[seg["hot"] == 1]
                if len(seg):
                    total = int(seg["n"].sum())
                    start = np.repeat(seg["lo"].astype(np.int64) - np.concatenate([[0], np.cumsum(seg["n"].astype(np.int64))[:-1]]), seg["n"]) + np.arange(total)
                    x = window_hash(prefix_hash(BYTE_CODES[data]), start, start + length)
                    y = window_hash(prefix_hash(SECOND_CODES[data]), start, start + length)
                    yield _parts(_by_key(block, "_hot", buckets, x, x, y, start, np.ones(total, np.int64), np.zeros(total, np.int64), np.zeros(total, bool)))
        yield from code(items, owners)

    return joined.select("block", "lens", "data", "found").mapInArrow(run, _PARTS)


class Run:
    """A front-coded run: gives its suffixes one by one."""

    def __init__(self, items: bytes, more: bytes):
        self.items = np.frombuffer(items, _ITEM)
        at = len(more) - int(self.items["tail"].sum(dtype=np.int64)) - int(self.items["d"].sum(dtype=np.int64)) - 16
        self.owners = np.frombuffer(more[:at], "<i8")
        at += 16
        self.tails = more[at : at + int(self.items["tail"].sum(dtype=np.int64))]
        self.lefts = more[at + len(self.tails) :]
        self.fields = self.items.tolist()
        self.at = self.tail_at = self.left_at = 0
        self.text = b""

    def next(self) -> tuple[bytes, int] | None:
        """The next suffix and its common prefix with the one before."""
        if self.at == len(self.fields):
            return None
        lcp, tail, d = self.fields[self.at][:3]
        self.text = self.text[:lcp] + self.tails[self.tail_at : self.tail_at + tail]
        self.left = self.lefts[self.left_at : self.left_at + d]
        self.tail_at, self.left_at, self.at = self.tail_at + tail, self.left_at + d, self.at + 1
        return self.text, lcp


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int]]:
    """(run, common prefix with the suffix before) in sorted order, by an LCP loser tree.

    Every suffix in the tree knows its common prefix with the last winner: the longer one
    is smaller, and only on equality are bytes compared, from that point on.
    """
    k = 1
    while k < len(runs):
        k *= 2
    text: list[bytes | None] = [None] * k
    known = [0] * k
    for i, r in enumerate(runs):
        got = r.next()
        if got:
            text[i] = got[0]

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        both = _common(x, y, known[a])
        if both == len(x) or (both < len(y) and x[both] < y[both]):
            known[b] = both
            return a, b
        known[a] = both
        return b, a

    losers = [0] * k
    winners = [0] * (2 * k)
    for i in range(k):
        winners[k + i] = i
    for node in range(k - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1] if k > 1 else 0
    while text[winner] is not None:
        yield winner, known[winner]
        got = runs[winner].next()
        text[winner], known[winner] = got if got else (None, 0)
        node = (k + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def repeated_offsets(lcp: list[int], lefts: list[bytes], spans: list[tuple[int, int]], length: int) -> list[set[int]]:
    """For suffixes of one core, in sorted order: at which offsets i to the left a repeat starts.

    lcp[j] is the common prefix of j and j - 1; a string i bytes left of the anchor repeats if
    another suffix shares i bytes to the left and length - i to the right.
    """
    m = len(lefts)
    out: list[set[int]] = [set() for _ in range(m)]
    if m <= 24:
        for a in range(m):
            right = length * 2
            for b in range(a + 1, m):
                right = min(right, lcp[b])
                left = _common(lefts[a], lefts[b], 0)
                if left + right >= length:
                    for j in (a, b):
                        out[j].update(range(max(spans[j][0], length - right), min(spans[j][1], left) + 1))
        return out
    width = max(map(len, lefts))
    chars = np.full((m, width), 256, np.int64)
    for j, left in enumerate(lefts):
        chars[j, : len(left)] = np.frombuffer(left, np.uint8)
    low, high = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    right = np.array(lcp)
    same = np.zeros(m, np.int64)
    for i in range(width + 1):
        if i:
            same = np.unique(same * 257 + chars[:, i - 1], return_inverse=True)[1]
        valid = np.flatnonzero((low <= i) & (i <= high))
        key = same[valid] * m + np.cumsum(right < length - i)[valid]
        _, at, n = np.unique(key, return_inverse=True, return_counts=True)
        for j in valid[n[at] > 1].tolist():
            out[j].add(i)
    return out


def _merge(length: int):
    core_bytes = length - WINDOW + 1

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        runs = [Run(d, m) for d, m in zip(pdf["data"], pdf["more"])]
        found: dict[int, list[int]] = {}
        lcp: list[int] = []
        lefts: list[bytes] = []
        fields: list[tuple] = []

        def settle() -> None:
            if len(fields) > 1:
                spans = [(f[1] - f[2] + 1, f[1]) for f in fields]
                for (block, d, _, lo, alone), offsets in zip(fields, repeated_offsets(lcp, lefts, spans, length)):
                    if alone:
                        found.setdefault(block, []).extend(lo + d - i for i in offsets)
            lcp.clear()
            lefts.clear()
            fields.clear()

        for i, known in merge_runs(runs):
            if known < core_bytes:
                settle()
            r = runs[i]
            _, _, d, n, lo, own, alone = r.fields[r.at - 1]
            lcp.append(known)
            lefts.append(r.left)
            fields.append((int(r.owners[own]), d, n, lo, alone))
        settle()
        rows = [("start", block, 0, np.array(sorted(p), "<u4").tobytes(), b"") for block, p in found.items() if p]
        return pd.DataFrame(rows, columns=["kind", "block", "part", "data", "more"])

    return merge


def _cover(joined: DataFrame, length: int) -> DataFrame:
    """doc_id, text length, removed spans and what stays of each document."""
    kind = joined.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.field(0).type.value_type
            for own, lens, packed, found in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                data, offsets = _open(packed, lens)
                change = np.zeros(len(data) + 1, np.int32)
                by: dict[str, list[bytes]] = {}
                for f in found or []:
                    by.setdefault(f["kind"], []).append(f["data"])
                for tag in ("", "_hot"):
                    local = np.frombuffer(b"".join(by.get(f"local{tag}", [])), _LOCAL)
                    settled = np.frombuffer(b"".join(by.get(f"settled{tag}", [])), "<u4")
                    local = local[np.isin(local["key"], settled)]
                    np.add.at(change, local["lo"].astype(np.int64), 1)
                    np.add.at(change, local["lo"].astype(np.int64) + local["n"] - 1 + length, -1)
                start = np.frombuffer(b"".join(by.get("start", [])), "<u4").astype(np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + length, -1)
                gone = np.cumsum(change[:-1]) > 0
                spans, kept = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    cut = gone[a:b]
                    edges = np.flatnonzero(np.diff(cut, prepend=False, append=False))
                    spans.append([{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
                    kept.append((data[a:b][~cut] if len(edges) else data[a:b]).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own, of), pa.array(lens, pa.int64()), pa.array([n - len(k) for n, k in zip(lens, kept)], pa.int64()), pa.array([len(x) for x in spans], pa.int64()),
                        pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
                )

    return joined.select("ids", "lens", "data", "found").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start: long, end: long>>")


def _splitters(opened: DataFrame, blocks: DataFrame, length: int, parts: int) -> list[bytes]:
    """Splitters from a bounded sample of open segments, of a few blocks chosen by hash."""
    if parts < 2:
        return []
    some = opened.select("block").distinct().orderBy(F.xxhash64("block"), "block").limit(64)
    each = SPLITTER_ROWS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, lens, packed, found in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                raw, seg = _open(packed, lens)[0].tobytes(), _dense(found)
                seg = seg[seg["hot"] == 0]
                picked = seg[np.argsort(mix64(seg["lo"].astype(np.uint64)))[:each]]
                yield pa.RecordBatch.from_arrays([pa.array([raw[lo + d : lo + d + length - WINDOW + 1] for lo, _, d, _, _ in picked.tolist()], pa.binary())], ["key"])

    sample = _with_parts(blocks, opened.join(some, "block", "left_semi")).select("block", "lens", "data", "found").mapInArrow(run, "key binary")
    keys = sorted(r[0] for r in sample.collect())
    return sorted({keys[len(keys) * i // parts] for i in range(1, parts)}) if keys else []


def repeated_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT_CONTEXTS, crowded: int = CROWDED_BLOCKS) -> DataFrame:
    """What stays of each text when every byte goes that a repeated string covers.

    A byte goes if it lies in a string of ``length`` UTF-8 bytes that also starts anywhere
    else, in the same text or another; overlaps count, matches never cross texts.  Returns
    doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes
    that stay, joined; a cut can fall inside a character) and spans (the removed runs in
    bytes, end exclusive) for each input row.  Null text is empty, repeated rows are copies of each other, texts shorter than
    ``length`` lose nothing, a null doc_id is returned as such; an empty table gives no rows.
    Texts of any length are taken whole, as a block of their own if need be; other columns
    do not matter.
    Settled segments and starts of hot cores rest on 128-bit hashes of their bytes.  No task
    gets all contexts of a core that lies in over ``crowded`` blocks; its starts are settled
    one by one, each where all strings of its hash meet.
    """
    if length < 2 * WINDOW:
        raise ValueError(f"length must be at least {2 * WINDOW}")
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-total // (BUCKET_ANCHORS * WINDOW // 2)))
    name = f"tidewell_blocks_{uuid.uuid4().hex}"
    _pack(docs).write.bucketBy(int(min(50_000, max(8, total // (16 * BLOCK_BYTES)))), "block").option("path", new_folder(spark, "substring-blocks")).saveAsTable(name)
    blocks = spark.table(name)
    # a bucket holds one blob of each block: tasks that meet to hold few of them
    parts = _core_hashes(blocks, length, buckets)
    cores = parts.groupBy("part").applyInPandas(_repeated_cores(crowded), _PARTS)
    contexts = durable(_contexts(_with_parts(blocks, cores), length, buckets), "substring-contexts")
    verdicts = durable(contexts.filter("kind = 'key'").groupBy("part").applyInPandas(_judge(hot, ""), _PARTS), "substring-verdicts")
    opened = verdicts.filter("kind = 'open'")
    rows = opened.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0] // _VERDICT.itemsize
    splitters = _splitters(opened, blocks, length, -(-rows // MERGE_ROWS))
    runs = durable(_runs(_with_parts(blocks, opened), length, splitters, buckets), "substring-runs")
    starts = runs.filter("kind = 'run'").groupBy("part").applyInPandas(_merge(length), _PARTS)
    hot_ones = runs.filter("kind = 'key_hot'").groupBy("part").applyInPandas(_judge(hot, "_hot"), _PARTS)
    found = contexts.filter("kind = 'local'").unionByName(verdicts.filter("kind = 'settled'")).unionByName(starts).unionByName(runs.filter("kind = 'local_hot'")).unionByName(hot_ones)
    out = _cover(_with_parts(blocks, found, "left"), length)
    # the plan reads the files in the shared folder; the catalog need not keep their name
    spark.sql(f"DROP TABLE {name}")
    return out


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and digest, then the text that stays (parts of cut characters as U+FFFD) and start:end of each removed run."""
    text = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    spans = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("spans")
    return repeated_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", text, spans)
