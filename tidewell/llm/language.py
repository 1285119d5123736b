"""Language ID by multilingual mixture inference.

Each language has a distribution over hashed byte trigrams.  Expectation-maximisation
estimates the language proportions of a document from the likelihoods of its trigrams;
the set of languages is the one of the highest penalised likelihood.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.shared import free_names, table

SLOTS = 1 << 15
#: Distinct texts of each language that the model is fitted on, about; the bound of the sample.
PER_LANGUAGE = 1500
#: Price of one more language, in units of log(trigrams); neighbouring trigrams are not independent.
PENALTY = 3.0
UNKNOWN = "und"


def trigram_counts(text: str) -> np.ndarray:
    """How often each hashed trigram of the lower-cased text occurs."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    code = (raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(17), minlength=SLOTS)


@dataclass
class LanguageModel:
    """Trigram probabilities: ``grams[slot, language]``."""

    languages: list[str]
    grams: np.ndarray

    def best(self, text: str) -> int:
        """Index of the single most likely language."""
        counts = trigram_counts(text)
        used = np.flatnonzero(counts)
        return int(np.argmax(counts[used] @ np.log(self.grams[used])))

    def infer(self, text: str) -> tuple[str, float]:
        """The main language and its proportion."""
        if not self.languages or not any(c.isalpha() for c in text):
            return UNKNOWN, 0.0
        counts = trigram_counts(text)
        used = np.flatnonzero(counts)
        weight, likely = counts[used].astype(np.float64), self.grams[used]
        total = weight.sum()
        every = np.arange(len(self.languages))
        share = self._expect(weight, likely, np.full(len(every), 1 / len(every)))
        order = np.argsort(-share, kind="stable")
        best, chosen, value = -np.inf, order[:1], np.ones(1)
        for k in every[: int(np.count_nonzero(share > 0.01)) or 1] + 1:
            some = order[:k]
            part = np.ones(1) if k == 1 else self._expect(weight, likely[:, some], share[some] / share[some].sum())
            score = weight @ np.log(likely[:, some] @ part) - PENALTY * k * np.log(total + 1)
            if score <= best:
                break
            best, chosen, value = score, some, part
        top = int(np.argmax(value))
        return self.languages[chosen[top]], float(min(1.0, max(0.0, value[top])))

    @staticmethod
    def _expect(weight: np.ndarray, likely: np.ndarray, share: np.ndarray, rounds: int = 12) -> np.ndarray:
        total = weight.sum()
        for _ in range(rounds):
            new = share * ((weight / (likely @ share)) @ likely) / total
            moved = np.abs(new - share).max()
            share = new
            if moved < 1e-3:
                break
        return share


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo ``parts``; null for a null doc_id."""
    return F.crc32(doc_id.cast("string")) % parts


def sampled(rows: DataFrame, by: str, most: int) -> DataFrame:
    """About ``most`` distinct texts of each value of ``by`` at most: ``by`` and text, each once.

    A text is drawn by its hash, with a chance from the number of distinct texts (estimated to
    a few per cent, without a shuffle), so copies of a text are drawn together and count once.
    The counts have one row for each language, far less than the model, which the driver holds
    as well: so they may be broadcast, and no text is shuffled before the sample is taken.
    """
    hashed = rows.select(F.col(by).alias("_by"), "text", F.xxhash64("text").alias("_h"))
    counts = hashed.groupBy(F.col("_by").alias("_of")).agg(F.approx_count_distinct("_h", 0.02).alias("_n"))
    drawn = hashed.join(F.broadcast(counts), F.col("_by") == F.col("_of")).filter(F.pmod(F.xxhash64("_h"), F.lit(1 << 20)) / float(1 << 20) < most / F.col("_n"))
    return drawn.groupBy("_by", "_h").agg(F.min("text").alias("text")).select(F.col("_by").alias(by), "text")


def fit_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit on whole texts of a bounded sample of the distinct texts of rows with text and lang.

    Rows with a null text or lang teach nothing; a text repeated in a language counts once.
    Tasks count trigrams text by text, however long, and Spark adds up the counts; the driver
    gets one row of at most SLOTS counts for each language.  No rows give a model without
    languages.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = totals.setdefault(lang, np.zeros(SLOTS, np.int64))
                own += trigram_counts(text.as_py())
        for lang, own in totals.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used], pa.int64())], ["lang", "slot", "n"])

    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    slots = sampled(rows, "lang", per_language).select("lang", "text").mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = sorted(slots.groupBy("lang").agg(F.collect_list(F.struct("slot", "n")).alias("grams")).collect(), key=lambda r: r["lang"])
    grams = np.full((SLOTS, len(found)), 0.05)
    for i, r in enumerate(found):
        used = np.array(r["grams"], np.int64).reshape(-1, 2)
        grams[used[:, 0], i] += used[:, 1]
    return LanguageModel([r["lang"] for r in found], grams / grams.sum(axis=0))


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of each row with lang_pred and score, from the whole text.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or where
    the model knows no language.  Repeated rows are answered each; a text of any length is
    judged whole.  ``names`` are the two new columns' own; a kept column of such a name is an
    error, one that is not kept does not matter.
    """
    if {n.lower() for n in names} & {c.lower() for c in keep}:
        raise ValueError(f"kept columns clash with {names}: give other names")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.infer(x.as_py() or "") for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(keep))], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*keep, *names],
            )

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").cast("string").alias(free_names([*keep, *names], "whole_text")[0]))
    return rows.mapInArrow(run, f"{schema + ', ' if keep else ''}`{names[0]}` string, `{names[1]}` double")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    model = fit_languages(docs.filter(fold(F.col("doc_id"), 3) != 1))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
