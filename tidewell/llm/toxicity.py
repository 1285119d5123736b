"""Toxicity: a convolutional text classifier trained in numpy.

Words are hashed to embeddings; filters of several widths slide over them, the maximum
over the text of each filter is pooled, and a logistic layer gives the score.  Its
threshold is calibrated for each language on held-back training rows, with the
language inferred from the text; scores are shifted so that each threshold lies at 0.5.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.storagelevel import StorageLevel

from tidewell.llm.language import LanguageModel, fit_languages, fold
from tidewell.llm.shared import BYTE_CODES, durable, mix64, prefix_hash, slices, table, window_hash, word_bounds

BUCKETS = 1 << 14
DIM = 12
FILTERS = 12
WIDTHS = (1, 2, 3)
#: Bytes of the word prefixes that have slots of their own.
PREFIXES = (4, 7)
#: Labelled texts and their words that the classifier is fitted on, of each label, about; the bounds of the sample.
PER_LABEL, WORDS_PER_LABEL = 2500, 3_000_000
#: Training steps, however many texts there are, and texts in a step.
STEPS, BATCH = 3750, 8
#: Labelled texts, and words of them, that one task of a fit on all texts trains on, about.
SHARD_TEXTS, SHARD_WORDS = 8192, 4_000_000
#: Times that all shards train side by side, each once over its texts, after the first has trained alone.
ROUNDS = 2
#: A parameter travels as a whole number of these, so that sums do not depend on order.
UNIT = 2.0**-32
#: Scores of held-back texts are counted in bins of this width.
BIN = 1 / 256
#: Spread of the first embeddings; small, so that words seldom seen do not win a maximum.
FIRST = 0.01

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def word_slots(column) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """For each portion of rows: the slots of its distinct words, and each row's words as indexes into them.

    Words are runs of letters, A-Z lower-cased; a word has a slot for itself and one for each
    of its prefixes of PREFIXES bytes, so that inflected and compound forms share weight.
    """
    for _, data, offsets in slices(column):
        start, end, row = word_bounds(_LETTER[data], offsets)
        h = prefix_hash(BYTE_CODES[_LOWER[data]])
        _, first, which = np.unique(window_hash(h, start, end), return_index=True, return_inverse=True)
        start, end = start[first], end[first]
        parts = [window_hash(h, start, end), *[window_hash(h, start, np.minimum(end, start + n)) + np.uint64(n) for n in PREFIXES]]
        slots = np.stack([(mix64(p) >> np.uint64(50)).astype(np.int32) for p in parts], axis=1)
        cuts = np.searchsorted(row, np.arange(len(offsets))).tolist()
        yield slots, [which[a:b] for a, b in zip(cuts, cuts[1:])]


@dataclass
class TextCNN:
    """Embeddings, filters (width, dim, filter) and the logistic layer."""

    embed: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    weight: np.ndarray
    base: float
    thresholds: dict[int, float] = field(default_factory=dict)

    @classmethod
    def fresh(cls, seed: int = 7) -> TextCNN:
        r = np.random.default_rng(seed)
        filters = [r.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)) for w in WIDTHS]
        return cls(r.normal(0, FIRST, (BUCKETS, DIM)), filters, np.zeros(len(WIDTHS) * FILTERS), r.normal(0, 0.1, len(WIDTHS) * FILTERS), 0.0)

    def project(self, slots: np.ndarray) -> list[list[np.ndarray]]:
        """Product of each word with each filter position: scoring then only gathers and adds."""
        x = self.embed[slots].sum(axis=1)
        return [[x @ f[j] for j in range(len(f))] for f in self.filters]

    def pooled(self, products: list[list[np.ndarray]], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over the text, and where it lies (-1: the text is too short)."""
        top, at = np.zeros(len(self.bias)), np.full(len(self.bias), -1)
        for k, w in enumerate(WIDTHS):
            n = len(words) - w + 1
            if n > 0:
                out = products[k][0][words[:n]]
                for j in range(1, w):
                    out += products[k][j][words[j : j + n]]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                where = out.argmax(axis=0)
                top[own], at[own] = out[where, np.arange(FILTERS)], where
        return np.maximum(top + self.bias, 0), at

    def logit(self, products: list[list[np.ndarray]], words: np.ndarray) -> float:
        return float(self.pooled(products, words)[0] @ self.weight + self.base)

    def step(self, texts: list[np.ndarray], labels: np.ndarray, rate: float, sums: dict[str, np.ndarray]) -> None:
        """One Adagrad step on a few texts, given the slots of their words."""
        slots, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        x = self.embed[slots].sum(axis=1)
        top, at = np.zeros((len(texts), len(self.bias))), np.full((len(texts), len(self.bias)), -1)
        for k, w in enumerate(WIDTHS):
            starts = np.flatnonzero(row[: len(x) - w + 1] == row[w - 1 :]) if len(x) >= w else np.zeros(0, np.int64)
            if len(starts):
                out, of = sum((x @ self.filters[k][j])[starts + j] for j in range(w)), row[starts]
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                best = np.maximum.reduceat(out, cuts, axis=0)
                i, f = np.nonzero(out == np.repeat(best, np.diff(cuts, append=len(of)), axis=0))
                first = np.unique(of[i] * FILTERS + f, return_index=True)[1]
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                top[of[cuts], own], at[of[cuts], own] = best, starts[i[first]].reshape(-1, FILTERS)
        hidden = np.maximum(top + self.bias, 0)
        off = 1 / (1 + np.exp(-np.clip(hidden @ self.weight + self.base, -30, 30))) - labels
        back = off[:, None] * self.weight * (hidden > 0) * (at >= 0)
        g_filters, seen, g_seen = [np.zeros_like(f) for f in self.filters], [], []
        for k, w in enumerate(WIDTHS):
            b, f = np.nonzero(back[:, k * FILTERS : (k + 1) * FILTERS])
            g = back[b, k * FILTERS + f][:, None]
            for j in range(w):
                word = at[b, k * FILTERS + f] + j
                np.add.at(g_filters[k][j].T, f, g * x[word])
                seen.append(slots[word])
                g_seen.append(g * self.filters[k][j].T[f])

        def move(name: str, array: np.ndarray, grad: np.ndarray) -> None:
            total = sums.setdefault(name, np.full(array.shape, 1e-2))
            total += grad * grad
            array -= rate * grad / np.sqrt(total)

        move("weight", self.weight, off @ hidden + 1e-4 * self.weight)
        move("bias", self.bias, back.sum(axis=0))
        self.base -= rate * 0.1 * off.sum()
        for k in range(len(WIDTHS)):
            move(f"filter{k}", self.filters[k], g_filters[k])
        rows, to = np.unique(np.concatenate(seen), return_inverse=True)
        grad = np.zeros((len(rows), DIM))
        np.add.at(grad, to.reshape(-1, 1 + len(PREFIXES)), np.concatenate(g_seen)[:, None, :])
        total = sums.setdefault("embed", np.full(self.embed.shape, 1e-2))
        total[rows] += grad * grad
        self.embed[rows] -= rate * grad / np.sqrt(total[rows])


def fit(texts: list[np.ndarray], labels: np.ndarray, languages: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> TextCNN:
    """Train on four fifths of the rows; calibrate each language's threshold on the rest.

    The steps are as many for few texts as for many, so few are seen more often.
    ``weights`` says how many labelled rows each row of the sample stands for.
    """
    net, r, sums = TextCNN.fresh(), np.random.default_rng(11), {}
    order = r.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    _train(net, texts, labels, train, r, steps, 0.1, sums)
    z = np.array([net.logit(net.project(t), np.arange(len(t))) for t in texts]) if len(texts) else np.zeros(0)
    net.thresholds = {-1: _threshold(z[held], labels[held], weights[held])}
    for lang in np.unique(languages):
        own = held[languages[held] == lang]
        if labels[own].sum() >= 10:
            net.thresholds[int(lang)] = _threshold(z[own], labels[own], weights[own])
    return net


def _train(net: TextCNN, texts: list[np.ndarray], labels: np.ndarray, train: np.ndarray, r: np.random.Generator, steps: int, rate: float, sums: dict[str, np.ndarray]) -> None:
    """Steps on the texts ``train``, each seen once before one is seen again, at a rate that falls to two fifths."""
    turn, done = train[:0], 0
    while len(train) and done < steps:
        turn = turn if len(turn) else r.permutation(train)
        some, turn = turn[:BATCH], turn[BATCH:]
        net.step([texts[i] for i in some], labels[some], rate / (1 + 1.5 * done / steps), sums)
        done += 1


def _threshold(z: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """The cut of the highest F1, amid the gap to the next score below."""
    if not len(z) or not labels.any():
        return 0.0
    order = np.argsort(-z, kind="stable")
    hit, said = np.cumsum((labels * weights)[order]), np.cumsum(weights[order])
    f1 = 2 * hit / (said + (labels * weights).sum())
    i = int(np.argmax(f1))
    return float((z[order[i]] + z[order[min(i + 1, len(z) - 1)]]) / 2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, speech: LanguageModel, per_label: int = PER_LABEL, words_per_label: int = WORDS_PER_LABEL) -> TextCNN:
    """Fit on a bounded sample of the labelled texts; null labels and null ids teach nothing.

    A label above 0 is toxic.  The sample holds about ``per_label`` texts of each label, in the
    order of their hashes as many as have ``words_per_label`` words together, and one at least;
    texts are whole.  Texts are drawn by their own hash: copies of a text, and label rows however
    often repeated, count once.  No labels give a model
    that scores every text alike.
    """
    known = labels.select(F.col("doc_id").alias("_d"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).filter("_d is not null and toxic is not null").distinct()
    hashed = docs.select("doc_id", F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("h"))
    found = durable(hashed.join(known, F.col("doc_id") == F.col("_d")).select("toxic", "h").distinct(), "toxicity-labels")
    counts = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    chance = F.pmod(F.xxhash64(F.lit("draw"), "h"), F.lit(1 << 20)) / float(1 << 20)
    limit = F.lit(0.0)
    for value, n in sorted(counts.items()):
        limit = F.when(F.col("toxic") == value, F.lit(per_label / n)).otherwise(limit)
    sample = found.filter(chance < limit)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(2).fill_null("")
            spoken = [speech.best(t) if speech.languages else -1 for t in text.to_pylist()]
            each = [slots[w].astype("<i4") for slots, rows in word_slots(text) for w in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spoken, pa.int32()), pa.array([len(x) for x in each], pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], ["toxic", "h", "spoken", "words", "slots"])

    # the sample has a bounded number of short rows, so it may be broadcast
    texts = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).join(F.broadcast(sample), "h")
    texts = texts.groupBy("toxic", "h").agg(F.min("text").alias("text"))
    drawn = durable(texts.mapInArrow(tokens, "toxic int, h long, spoken int, words long, slots binary"), "toxicity-sample")
    order = Window.partitionBy("toxic").orderBy("h")
    fits = drawn.select("toxic", "h", (F.sum("words").over(order) - F.col("words")).alias("_before"), F.row_number().over(order).alias("_i"))
    fits = fits.filter((F.col("_before") + 1 <= words_per_label) & (F.col("_i") <= 2 * per_label)).select("toxic", "h")
    rows = drawn.join(fits, ["toxic", "h"], "left_semi").collect()
    rows.sort(key=lambda r: (r["toxic"], r["h"]))
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    stands = np.array([counts[label] / (toxic == label).sum() for label in toxic.tolist()])
    return fit([np.frombuffer(r["slots"], np.int32).reshape(-1, 1 + len(PREFIXES)) for r in rows], toxic, np.array([r["spoken"] for r in rows], np.int64), stands)


def _parts(net: TextCNN, sums: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The arrays of a net and of its squared gradients, embeddings aside."""
    own = {f"filter{k}": f for k, f in enumerate(net.filters)} | {"weight": net.weight, "bias": net.bias}
    return [*own.values(), *[sums.setdefault(name, np.full(a.shape, 1e-2)) for name, a in own.items()]]


def pack(net: TextCNN, sums: dict[str, np.ndarray]) -> np.ndarray:
    """A net and its squared gradients as rows of 2 * DIM: one for each slot, then those of all other parameters."""
    slots = np.concatenate([net.embed, sums.setdefault("embed", np.full(net.embed.shape, 1e-2))], axis=1)
    rest = np.concatenate([*[a.ravel() for a in _parts(net, sums)], [net.base]])
    return np.concatenate([slots, np.pad(rest, (0, -len(rest) % (2 * DIM))).reshape(-1, 2 * DIM)])


def unpack(rows: np.ndarray) -> tuple[TextCNN, dict[str, np.ndarray]]:
    net, sums, rest, at = TextCNN.fresh(), {"embed": rows[:BUCKETS, DIM:].copy()}, rows[BUCKETS:].ravel(), 0
    net.embed = rows[:BUCKETS, :DIM].copy()
    for a in _parts(net, sums):
        a[...] = rest[at : at + a.size].reshape(a.shape)
        at += a.size
    net.base = float(rest[at])
    return net, sums


def _words(slots: bytes) -> np.ndarray:
    return np.frombuffer(slots, "<u2").astype(np.int32).reshape(-1, 1 + len(PREFIXES))


def shards(docs: DataFrame, labels: DataFrame, speech: LanguageModel, texts: int = SHARD_TEXTS, words: int = SHARD_WORDS) -> tuple[DataFrame, int]:
    """All labelled texts, each once for each of its labels, and the number of shards that they are dealt over by their hashes.

    toxic, h, slots, held (a fifth is kept back for the thresholds), spoken (of those held back)
    and shard.  Null labels and null ids teach nothing; a label above 0 is toxic.
    """
    known = labels.select(F.col("doc_id").alias("_d"), (F.col("toxic").cast("int") > 0).cast("int").alias("toxic")).filter("_d is not null and toxic is not null").distinct()
    whole = F.coalesce(docs["text"].cast("string"), F.lit(""))
    hashed = docs.select("doc_id", F.xxhash64(whole).alias("h"), F.length(whole).alias("chars"))
    found = durable(hashed.join(known, F.col("doc_id") == F.col("_d")).groupBy("toxic", "h").agg(F.min("chars").alias("chars")), "toxicity-labels")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).first()
    n = max(1, -(-size["n"] // texts), -(-size["chars"] // (6 * words)))
    # a bit for each hash, a byte a text in all: most texts without a label need neither be tokenised nor shuffled
    bits = np.zeros(max(1, size["n"] // 8), np.uint64)
    at = F.pmod("h", F.lit(64 * len(bits)))
    marked = found.groupBy(F.floor(at / 64).alias("i")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod(h, {64 * len(bits)}) % 64 as int)))").alias("b")).toArrow()
    bits[marked["i"].to_numpy()] = marked["b"].to_numpy().view(np.uint64)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy()
            pos = h % (64 * len(bits))
            may = np.flatnonzero(bits[pos // 64] >> (pos % 64).astype(np.uint64) & np.uint64(1))
            batch = batch.take(pa.array(may[np.unique(h[may], return_index=True)[1]]))
            spoken = [speech.best(t.as_py()) if held.as_py() and speech.languages else -1 for held, t in zip(batch.column(1), batch.column(2))]
            each = [slots[w].astype("<u2").tobytes() for slots, rows in word_slots(batch.column(2)) for w in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(spoken, pa.int32()), pa.array(each, pa.binary())], ["h", "held", "spoken", "slots"])

    held = F.pmod(F.xxhash64(F.lit("held"), "h"), F.lit(5)) == 0
    rows = docs.select(F.xxhash64(whole).alias("h"), whole.alias("text")).select("h", held.alias("held"), "text").mapInArrow(tokens, "h long, held boolean, spoken int, slots binary")
    rows = rows.join(found.select("toxic", "h"), "h").groupBy("toxic", "h").agg(F.min(F.struct("slots", "held", "spoken")).alias("_")).select("toxic", "h", "_.*")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "h"), F.lit(n)).cast("int"))
    return rows.repartition(n, "shard").sortWithinPartitions("shard", "h", "toxic"), n


def _round(rows: DataFrame, state: np.ndarray, steps: int, rate: float, seed: int) -> np.ndarray:
    """Every shard trains from ``state``, ``steps`` steps and at least once over its texts; the mean of what came out.

    Rows of a shard lie in one partition, one after the other, as ``shards`` leaves them.
    A row of the state is the mean over the shards that moved it, so a word that few shards have is
    not held where it was by the others.
    """
    columns = [f"v{i}" for i in range(2 * DIM)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = ((s, _words(x), t) for b in batches for s, x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        for shard, group in itertools.groupby(each, lambda x: x[0]):
            _, texts, toxic = zip(*group)
            net, sums = unpack(state)
            _train(net, texts, np.array(toxic, np.int64), np.arange(len(texts)), np.random.default_rng([seed, shard]), max(steps, -(-len(texts) // BATCH)), rate, sums)
            after = pack(net, sums)
            moved = np.flatnonzero((after != state).any(axis=1))
            values = np.rint(after[moved] / UNIT).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(moved, pa.int32()), *[pa.array(values[:, i]) for i in range(2 * DIM)]], ["slot", *columns])

    moved = rows.select("shard", "slots", "toxic").mapInArrow(run, f"slot int, {', '.join(f'{c} long' for c in columns)}")
    # sums of whole numbers; decimals, as there may be many shards
    means = moved.groupBy("slot").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("decimal(20,0)")).cast("double").alias(c) for c in columns]).toArrow()
    state = state.copy()
    state[means["slot"].to_numpy()] = np.stack([means[c].to_numpy() for c in columns], axis=1) / means["n"].to_numpy()[:, None] * UNIT
    return state


def fit_on_all(docs: DataFrame, labels: DataFrame, speech: LanguageModel, texts: int = SHARD_TEXTS, words: int = SHARD_WORDS, steps: int = STEPS, rounds: int = ROUNDS) -> TextCNN:
    """Fit on every labelled text, in Spark's tasks; the thresholds come from every text held back.

    One shard trains alone first, as many steps for few texts as for many, so that the others start
    from filters that mean the same; then all shards train side by side and their nets are averaged,
    ``rounds`` times.  The driver holds one net at a time.  No labels give a model that scores every
    text alike.
    """
    rows, n = shards(docs, labels, speech, texts, words)
    rows = rows.persist(StorageLevel.DISK_ONLY)
    train, state = rows.filter("not held"), pack(TextCNN.fresh(), {})
    state = _round(train.filter("shard = 0"), state, steps, 0.1, 11)
    for i in range(rounds if n > 1 else 0):
        state = _round(train, state, 0, 0.04 / (1 + i), 12 + i)
    net, _ = unpack(state)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [net.logit(net.project(w), np.arange(len(w))) for w in map(_words, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.rint(np.clip(z, -30, 30) / BIN).astype(np.int64), pa.int64())], ["toxic", "spoken", "bin"])

    bins = rows.filter("held").select("toxic", "spoken", "slots").mapInArrow(judged, "toxic int, spoken int, bin long").groupBy("spoken", "bin").agg(F.sum("toxic").alias("hit"), F.count("*").alias("n")).collect()
    rows.unpersist()
    net.thresholds = {-1: _cut(bins)} | {lang: _cut(own) for lang in sorted({r["spoken"] for r in bins}) for own in [[r for r in bins if r["spoken"] == lang]] if sum(r["hit"] for r in own) >= 10}
    return net


def _cut(bins: list) -> float:
    """The threshold of counted scores; bins of several languages are added up."""
    counts: dict[int, np.ndarray] = {}
    for r in bins:
        counts[r["bin"]] = counts.get(r["bin"], 0) + np.array([r["hit"], r["n"]], float)
    at = sorted(counts)
    hit, n = np.array([counts[b] for b in at]).reshape(-1, 2).T
    return _threshold(np.array(at, float) * BIN, hit / n, n)


def score(docs: DataFrame, net: TextCNN, speech: LanguageModel) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text, however long.

    Null text scores as an empty one; repeated rows are scored each; other columns do not
    matter; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).fill_null("")
            cut = [net.thresholds.get(speech.best(t.as_py()) if speech.languages else -1, net.thresholds[-1]) for t in text]
            z = [net.logit(products, w) for slots, rows in word_slots(text) for products in [net.project(slots)] for w in rows]
            z = np.array(z, float) - np.array(cut, float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, f"doc_id {kind}, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    teaching = fold(F.col("doc_id"), 5) != 0
    speech = fit_languages(docs.filter(teaching), per_language=500)
    net = fit_on_all(docs.filter(teaching), labels.filter(teaching), speech)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    return score(docs, net, speech).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
