"""Toxicity: a linear classifier on character n-grams, scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import fold, table
from strandline.llm.labelled import sample
from strandline.llm.ngrams import counted, steps

#: Characters of an n-gram, and bits of its hash. Of the n-grams that take part one in 40 meets another by the hash, at 100,000 of them.
LENGTHS, BITS = (3, 4, 5, 6), 22
#: Labelled rows of a class that the classifier is fit on at most, and n-grams that take part: those whose log-count ratios are most standard errors from none, however few that is.
PER_CLASS, FEATURES = 4000, 20_000
FOLDS, HELD, CUT = 3, 1, 0.7


def plain(text: str) -> str:
    """What n-grams are taken of: lower case, white space as one space, a space at both ends."""
    return f" {' '.join(text.lower().split())} "


def _document_counts(rows: DataFrame) -> DataFrame:
    """(feature, label, n): labelled documents of each class that have the n-gram; a row for each task, class and n-gram."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            label = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in steps(batch.column(1)):
                owner, value, _ = counted([plain(t) for t in texts], LENGTHS, BITS)
                for k in (0, 1):
                    total[k] += np.bincount(value[label[first + owner] == k], minlength=1 << BITS)
        k, value = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(value, pa.int32()), pa.array(k, pa.int32()), pa.array(total[k, value], pa.int64())], names=["feature", "label", "n"])

    return rows.select("label", "text").mapInArrow(task, "feature int, label int, n long")


def fit(features: np.ndarray, lengths: np.ndarray, places: np.ndarray, values: np.ndarray, y: np.ndarray, penalty: float = 0.02, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Weights on the scaled features, by accelerated gradient steps; ``places`` are each document's features, of which it has ``lengths``.

    They lessen the logistic loss, in which both classes weigh one half, plus penalty / features * half the squared weights.
    """
    owner = np.repeat(np.arange(len(lengths)), lengths)
    scale = features[places] * values
    n = max(1, len(lengths))
    balance = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, b = np.zeros(len(features)), 0.0
    look, look_b, momentum = w, b, 1.0
    norm = np.bincount(owner, scale**2, minlength=n)
    step = 4 / (float((balance * (norm + 1)).sum()) * 2 + penalty)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, scale * look[places], minlength=n) + look_b, -30, 30)))
        off = balance * (p - y)
        new = look - step * (np.bincount(places, scale * off[owner], minlength=len(features)) + penalty / max(1, len(features)) * look)
        new_b = look_b - step * off.sum()
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look, look_b = new + (momentum - 1) / after * (new - w), new_b + (momentum - 1) / after * (new_b - b)
        w, b, momentum = new, new_b, after
    return w, b


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(n-grams, weight of each, intercept): fit on at most 2 * PER_CLASS labelled rows outside the held-out fold."""
    rows = sample(docs, labels, "toxic", FOLDS, HELD, PER_CLASS).persist()
    sizes = np.zeros(2)
    for r in rows.groupBy("label").count().collect():
        sizes[r["label"]] = r["count"]
    # log-count ratios of documents with the n-gram, one added to each count
    wide = _document_counts(rows).groupBy("feature").agg(*[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    ratio = F.log((F.col("n1") + 1) / float(sizes[1] + 2)) - F.log((F.col("n0") + 1) / float(sizes[0] + 2))
    evidence = F.abs(ratio) / F.sqrt(1 / (F.col("n0") + 1) + 1 / (F.col("n1") + 1))
    best = wide.select("feature", ratio.alias("ratio"), evidence.alias("by")).orderBy(F.col("by").desc(), F.xxhash64("feature")).limit(FEATURES).toPandas().sort_values("feature")
    grams, scaled = best["feature"].to_numpy(np.int64), best["ratio"].to_numpy(float)
    chosen = np.zeros(1 << BITS, bool)
    chosen[grams] = True

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in steps(batch.column(1)):
                owner, value, count = counted([plain(t) for t in texts], LENGTHS, BITS, chosen)
                ends = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)), pa.int32())
                places, values = np.searchsorted(grams, value).astype(np.int32), np.log1p(count).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(texts)], *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in (places, values)]], names=["label", "places", "values"])

    found = rows.select("label", "text").mapInArrow(present, "label int, places array<int>, values array<float>").toArrow()
    rows.unpersist()
    y, places, values = (found.column(c).combine_chunks() for c in ("label", "places", "values"))
    weight, intercept = fit(scaled, np.diff(places.offsets.to_numpy()), places.flatten().to_numpy(), values.flatten().to_numpy(), y.to_numpy().astype(float))
    return grams, weight * scaled, float(intercept)


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A text's score depends on the whole text alone, so copies get the same; a null or
    empty text has no n-grams and gets the intercept's score. Ids may be null or repeat.
    Without labelled rows every score is 0.5. Other columns are not read; an empty table
    gives no rows.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    grams, weights, intercept = train(named, labels)
    table_ = np.zeros(1 << BITS, np.float32)
    table_[grams] = weights
    chosen = np.zeros(1 << BITS, bool)
    chosen[grams] = True

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in steps(batch.column(1)):
                owner, value, count = counted([plain(t) for t in texts], LENGTHS, BITS, chosen)
                odds = intercept + np.bincount(owner, table_[value] * np.log1p(count), minlength=len(texts))
                p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(texts)], pa.array(p)], names=["doc_id", "score"])

    scored = named.mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
