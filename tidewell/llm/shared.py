"""Small helpers that several training-data operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tidewell.functions.folders import new_folder, shared_dir  # noqa: F401

#: A word is a maximal run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: lineage ends there."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores in front of those that a taken one equals in any case."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Base of the rolling hash; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept between calls."""
    if len(_powers.get("up", ())) < max(n, 1):
        size = max(n, 1 << 16)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers["up"], _powers["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of codes[i:j] * BASE**k; window hashes follow from it."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def window_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Position-free 64-bit hash of each window [start, end)."""
    return mix64((h[end] - h[start]) * powers(len(h))[1][start])


def slices(column, most: int = 1 << 20):
    """Cut a string column (Arrow) into runs of whole rows of about ``most`` bytes.

    Yields (first row, bytes, offsets of the rows in them); null rows are empty.
    """
    import pyarrow as pa

    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word: maximal runs of true bytes that stay in one row."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    here = np.zeros(n + 1, bool)
    here[:n] = inside
    start = np.flatnonzero(here & (~before | edge))
    end = np.flatnonzero(before & (~here | edge))
    return start, end, np.searchsorted(offsets, start, "right") - 1
