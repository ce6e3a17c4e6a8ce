"""Quality by compression: the better a dictionary of good text shortens a text against one of bad text, the better the text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import fold, table
from strandline.llm.labelled import logistic, sample
from strandline.llm.ngrams import steps

#: Labelled rows of a class to learn from at most, bytes of a dictionary, and the compression level.
PER_CLASS, DICTIONARY, LEVEL = 2000, 65_536, 3
#: Share of the sample that the dictionaries are built from; the rest calibrates the score.
BUILD = 0.6
#: Bytes of the consecutive excerpts that a labelled text is cut into for training, and of the pieces where no dictionary can be trained.
EXCERPT, PIECE = 8192, 256
FOLDS, HELD, CUT = 4, 2, 0.7

_COMPRESSORS: dict[bytes, object] = {}


def dictionary(texts: list[str]) -> bytes:
    """A zstandard dictionary of the whole texts; where there are too few to train one, their own bytes, or pieces drawn by hash from all of them."""
    import xxhash
    import zstandard

    whole = [t.encode() for t in texts if t]
    raw = [t[i : i + EXCERPT] for t in whole for i in range(0, len(t), EXCERPT)]
    try:
        return zstandard.train_dictionary(DICTIONARY, raw).as_bytes()
    except (zstandard.ZstdError, ValueError):
        if len(own := b"\n".join(whole)) <= DICTIONARY:
            return own
        pieces = {t[i : i + PIECE] for t in whole for i in range(0, len(t), PIECE)}
        return b"\n".join(sorted(pieces, key=lambda x: (xxhash.xxh64_intdigest(x), x))[: DICTIONARY // (PIECE + 1)])


def _compressor(words: bytes):
    """One compressor for each dictionary and Python worker."""
    import zstandard

    if words not in _COMPRESSORS:
        data = zstandard.ZstdCompressionDict(words)
        data.precompute_compress(level=LEVEL)
        _COMPRESSORS[words] = zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)
    return _COMPRESSORS[words]


def difference(text: str, good: bytes, bad: bytes) -> float:
    """(size by the bad dictionary - size by the good one) / their sum, zero for an empty text."""
    raw = text.encode()
    if not raw:
        return 0.0
    by_good, by_bad = len(_compressor(good).compress(raw)), len(_compressor(bad).compress(raw))
    return (by_bad - by_good) / (by_bad + by_good)


def _differences(rows: DataFrame, keep: str, kind: str, good: bytes, bad: bytes) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in steps(batch.column(1)):
                found = pa.array([difference(t, good, bad) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(texts)], found], names=[keep, "difference"])

    return rows.select(keep, "text").mapInArrow(task, f"{keep} {kind}, difference double")


def train(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, np.ndarray]:
    """(good dictionary, bad dictionary, slope and intercept): learnt from at most 2 * PER_CLASS labelled rows outside the held-out fold.

    Slope and intercept come from rows that the dictionaries have not seen; without such
    rows they are zero.
    """
    rows = sample(docs, labels, "quality", FOLDS, HELD, PER_CLASS).persist()
    built = rows.where(F.col("part") < BUILD).select("label", "text").collect()
    good, bad = (dictionary(sorted(r["text"] for r in built if r["label"] == k)) for k in (1, 0))
    if not good or not bad:
        rows.unpersist()
        return good, bad, np.zeros(2)
    found = _differences(rows.where(F.col("part") >= BUILD), "label", "int", good, bad).collect()
    rows.unpersist()
    y = np.array([r["label"] for r in found], float)
    return good, bad, logistic(np.array([[r["difference"]] for r in found], float).reshape(-1, 1), y, 1e-4)


def score(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The whole text is compressed. A null or empty text has no difference and gets the
    calibration's intercept. Without labelled rows of both classes, or with none left to
    calibrate on, every score is 0.5. Copies get equal scores; ids may be null or repeat;
    other columns are not read; an empty table gives no rows.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    good, bad, (slope, intercept) = train(named, labels)
    if good and bad:
        measured = _differences(named, "doc_id", "long", good, bad)
    else:
        measured = named.select("doc_id", F.lit(0.0).alias("difference"))
    odds = F.lit(float(slope)) * F.col("difference") + F.lit(float(intercept))
    scored = measured.withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "difference")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
