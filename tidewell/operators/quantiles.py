"""Exact quantiles of whole tables without a task that holds a whole column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: One in so many rows is the error of a sketch.
ACCURACY = 10_000
#: Values that lie inside a bracket are gathered where no more than so many are expected.
GATHER = 200_000
#: Tables of up to so many values are gathered whole.
SMALL = 20_000


class _Search:
    """A bracket [lo, hi] of values around the ranks of one quantile, with the rank of its first value."""

    def __init__(self, column: Column, p: float, n: int, lo: float, hi: float, least: float, most: float, share: float):
        place = p * max(n - 1, 0)
        self.column, self.ranks, self.weight = column, sorted({math.floor(place), math.ceil(place)}), place - math.floor(place)
        self.lo, self.hi, self.least, self.most, self.inside = lo, hi, least, most, share * n
        self.found: dict[int, float] = {}
        self.shares: list[float] = []

    def wanted(self, i: int, accuracy: int) -> list[Column]:
        c, within = self.column, (self.column > self.lo) & (self.column < self.hi)
        counts = [F.count_if(c < self.lo).alias(f"b{i}"), F.count_if(c == self.lo).alias(f"l{i}"), F.count_if(c == self.hi).alias(f"h{i}"), F.count_if(within).alias(f"m{i}")]
        if self.inside <= GATHER:
            return [*counts, F.collect_list(F.when(within, c)).alias(f"v{i}")]
        self.shares = [k / 100 for k in range(101)]
        return [*counts, F.percentile_approx(F.when(within, c), F.array(*[F.lit(s) for s in self.shares]), accuracy).alias(f"v{i}")]

    def learn(self, row: Row, i: int) -> None:
        below, low, high, within = (row[f"{k}{i}"] for k in "blhm")
        values = row[f"v{i}"] or []
        ordered = sorted(values) if self.inside <= GATHER else None
        for r in self.ranks:
            at = r - below
            if 0 <= at < low:
                self.found[r] = self.lo
            elif low <= at < low + within and ordered is not None:
                self.found[r] = ordered[at - low]
            elif low + within <= at < low + within + (high if self.hi > self.lo else 0):
                self.found[r] = self.hi
        missing = [r - below for r in self.ranks if r not in self.found]
        if not missing:
            return
        if missing[0] < 0:
            self.lo, self.hi, self.inside = self.least, self.lo, below
        elif missing[-1] >= low + within:
            self.lo, self.hi, self.inside = self.hi, self.most, row["_n"] - below - low - within
        else:
            # a hundredth of the values inside, and the steps beside it for the sketch's error
            share = [(m - low) / max(within, 1) for m in missing]
            first, last = max(0, math.floor(share[0] * 100) - 1), min(100, math.ceil(share[-1] * 100) + 1)
            self.lo, self.hi, self.inside = values[first], values[last], within * (last - first) / 100

    def value(self) -> float:
        a, b = self.found[self.ranks[0]], self.found[self.ranks[-1]]
        return a if a == b else (1 - self.weight) * a + self.weight * b


def quantiles_and(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], more: list[Column], accuracy: int = ACCURACY) -> tuple[dict[str, list[float | None]], Row]:
    """Linearly interpolated quantiles of each column over all rows, as ``percentile`` gives them (None for no
    values), and the aggregates ``more`` of the first pass.

    The first pass takes counts, extremes and mergeable sketches, which bracket each quantile.  The
    second counts the values below the bracket and gathers those inside it, about 8 in
    ``accuracy`` of all.  Where more than GATHER are expected there, it is narrowed to
    about a thirtieth by a sketch of its own, in one pass for all columns, as often as it takes.
    """
    columns = {name: c.cast("double") for name, (c, _) in wanted.items()}
    spread = 4 / accuracy
    shares = {name: sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-spread, spread)}) for name, (_, probs) in wanted.items()}
    first = df.agg(*more, *[x for i, (name, c) in enumerate(columns.items()) for x in (F.count(c).alias(f"n{i}"), F.min(c).alias(f"least{i}"), F.max(c).alias(f"most{i}"), F.percentile_approx(c, F.array(*[F.lit(s) for s in shares[name]]), accuracy).alias(f"cut{i}"))]).first()
    searches: list[tuple[str, int, _Search | None]] = []
    for i, (name, c) in enumerate(columns.items()):
        n = first[f"n{i}"]
        for p in wanted[name][1]:
            if not n:
                searches.append((name, n, None))
                continue
            cut = dict(zip(shares[name], first[f"cut{i}"]))
            whole = n <= SMALL
            lo, hi = (first[f"least{i}"], first[f"most{i}"]) if whole else (cut[min(1.0, max(0.0, p - spread))], cut[min(1.0, max(0.0, p + spread))])
            searches.append((name, n, _Search(c, p, n, lo, hi, first[f"least{i}"], first[f"most{i}"], 1.0 if whole else 3 * spread)))
    open_ones = [(n, s) for _, n, s in searches if s]
    while open_ones:
        row = df.agg(*[x for i, (_, s) in enumerate(open_ones) for x in s.wanted(i, accuracy)]).first()
        for i, (n, s) in enumerate(open_ones):
            s.learn(Row(**row.asDict(), _n=n), i)
        open_ones = [(n, s) for n, s in open_ones if len(s.found) < len(s.ranks)]
    out: dict[str, list[float | None]] = {name: [] for name in wanted}
    for name, _, s in searches:
        out[name].append(s.value() if s else None)
    return out, first


def exact_quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """Quantiles of each column over all rows (``quantiles_and`` without other aggregates)."""
    return quantiles_and(df, wanted, [], accuracy)[0]
