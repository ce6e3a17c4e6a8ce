"""Bounded samples of labelled documents, and logistic regression on few columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import fold, least_drawn


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int) -> DataFrame:
    """(label, text, part): at most ``per_class`` labelled rows of each class outside the held-out fold.

    The ids of least hash are taken, so reruns agree and a class within the bound is
    taken whole. ``part`` is a second hash in [0, 1), for splits. Rows without an id, or
    with a null label, take no part; of several rows with one id the text of least hash does.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("doc_id"), folds) != held)).distinct()
    few = None
    for value in (0, 1):
        part = least_drawn(known.where(F.col("label") == value), F.xxhash64("doc_id", F.lit(label)), per_class)
        few = part if few is None else few.unionByName(part)
    # 2 * per_class rows at most: a fixed bound
    few = spark.createDataFrame([tuple(r) for r in few.collect()], "doc_id long, label int")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(1000)) / 1000
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("by"), "text")).alias("least"))
    return one.select("label", F.col("least.text").alias("text"), part.alias("part"))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on dense columns, the intercept last and free of penalty, by Newton steps; classes weigh as they occur."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    if not len(a):
        return w
    ridge = np.full(a.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ (p - y) + ridge * w
        curve = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(ridge)
        change = np.linalg.solve(curve, slope)
        w -= change * min(1.0, 5 / (np.abs(change).max() + 1e-12))
        if np.abs(change).max() < 1e-8:
            break
    return w
