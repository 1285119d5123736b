"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of e edits is split into e + 1 pieces: whatever the
edits hit, one piece stays whole.  An Aho-Corasick automaton finds the exact piece
hits in a text; Myers' bit-parallel distance verifies the item around each hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import durable, table

#: Edits allowed: this share of an item's characters.
ERROR_RATE = 0.05
#: Characters of items that one pass over the documents matches; a larger benchmark takes more passes.
PASS_CHARS = 4_000_000


def normalize(text: str | None) -> str:
    """Lower case, every run of blanks as one space."""
    return " ".join((text or "").lower().split())


def error_budget(item: str, rate: float = ERROR_RATE) -> int:
    return int(len(item) * rate)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length that make up the item, with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def best_distance(item: str, masks: dict[str, int], window: str) -> int:
    """Least edit distance between the item and any substring of the window (Myers)."""
    n = len(item)
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score, best = full, 0, n, n
    for c in window:
        eq = masks.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        hp = down | (~(x | up) & full)
        hn = up & x
        if hp & last:
            score += 1
        elif hn & last:
            score -= 1
            if score < best:
                best = score
        hp = (hp << 1) & full
        hn = (hn << 1) & full
        up = hn | (~((eq | down) | hp) & full)
        down = hp & (eq | down)
    return best


def _masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds items (id, normalized text) in normalized texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = ERROR_RATE):
        self.items, self.rate, self.automaton = items, rate, None

    def _build(self) -> None:
        import ahocorasick

        self.budgets = [error_budget(text, self.rate) for _, text in self.items]
        self.masks = [_masks(text) for _, text in self.items]
        uses: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for at, piece in pieces(text, self.budgets[k]):
                uses.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, of in uses.items():
            self.automaton.add_word(piece, (len(piece), of))
        self.automaton.make_automaton()

    def __getstate__(self) -> dict:
        return {"items": self.items, "rate": self.rate, "automaton": None}

    def find(self, text: str) -> dict[int, int]:
        """Index of each item that occurs -> its least distance."""
        if not self.items:
            return {}
        if self.automaton is None:
            self._build()
        found: dict[int, int] = {}
        tried: dict[int, int] = {}
        for end, (width, uses) in self.automaton.iter(text):
            for k, at in uses:
                start, budget = end + 1 - width - at, self.budgets[k]
                if found.get(k) == 0 or tried.get(k) == start:
                    continue
                tried[k] = start
                item = self.items[k][1]
                if text.startswith(item, max(0, start)):
                    found[k] = 0
                    continue
                d = best_distance(item, self.masks[k], text[max(0, start - budget) : start + len(item) + budget])
                if d <= budget and d < found.get(k, budget + 1):
                    found[k] = d
        return found


def _matches(docs: DataFrame, matcher: Matcher) -> DataFrame:
    ids = [i for i, _ in matcher.items]
    doc, item = docs.schema["doc_id"].dataType.simpleString(), "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items, distances = [], [], []
            for i, text in enumerate(batch.column(1)):
                for k, d in sorted(matcher.find(normalize(text.as_py())).items()):
                    rows.append(i)
                    items.append(ids[k])
                    distances.append(d)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(distances, pa.int64())], ["doc_id", "item_id", "distance"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {doc}, item_id {item}, distance long")


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(doc_id, item_id, distance) of every benchmark item that a document holds.

    Both sides are normalized; an item of n characters may differ by floor(rate * n)
    edits, and its least distance is returned.  Null or blank items and texts match
    nothing.  Repeated documents are answered each; items of equal text each match,
    repeated item rows count once.  Texts of any length are searched whole; other columns
    do not matter; an empty table on either side gives no rows.  The benchmark is held in
    bounded portions of about ``pass_chars`` characters, one pass over the documents for
    each portion; of several portions each is written to the shared folder before the next
    is read, so neither the driver nor a task ever holds two.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-total // pass_chars))
    out = None
    for i in range(passes):
        portion = [(r[0], text) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).collect() if (text := normalize(r[1]))]
        part = _matches(docs, Matcher(sorted(portion, key=str), rate))
        part = durable(part, "leaks") if passes > 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
