"""Language identification: each document is a mixture of languages over its n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import fold, table
from strandline.llm.ngrams import counted, steps

#: Characters of an n-gram, and bits of its hash.
LENGTHS, BITS = (3, 4), 18
FOLDS, HELD = 4, 2
#: What a further language must gain for each unit of log(n-grams).
PENALTY = 1.5
#: Expectation-maximisation ends once no proportion moves by more, or after so many rounds.
SETTLED, ROUNDS = 1e-4, 500
#: Languages whose counts a task holds before it passes them on.
HELD_LANGUAGES = 32
UNKNOWN = "und"


def words(text: str) -> str:
    """Lower-case words of the text, one space around each; what is no letter ends a word. Empty without a letter."""
    text = text.lower()
    found = " ".join((text.translate(_ASCII) if text.isascii() else "".join(c if c.isalpha() else " " for c in text)).split())
    return f" {found} " if found else ""


_ASCII = {i: " " for i in range(128) if not chr(i).isalpha()}


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, feature, n): n-grams of all texts of each language. A task holds the counts of HELD_LANGUAGES languages at most."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def out():
            for lang, of in total.items():
                value = np.nonzero(of)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value, pa.int32()), pa.array(of[value])], names=["lang", "feature", "n"])
            total.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, texts in steps(batch.column(1)):
                owner, value, count = counted([words(t) for t in texts], LENGTHS, BITS)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    if langs[first + i] not in total and len(total) == HELD_LANGUAGES:
                        yield from out()
                    of = total.setdefault(langs[first + i], np.zeros(1 << BITS, np.int64))
                    of[value[ends[i] : ends[i + 1]]] += count[ends[i] : ends[i + 1]]
        yield from out()

    return docs.select("lang", "text").mapInArrow(task, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages in order, and log probabilities [n-gram, language], from all rows outside the held-out fold that name one.

    The driver gets at most 2**BITS counts a language, and every task a megabyte a language.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD))
    found = language_counts(known).toPandas()
    langs = sorted(found["lang"].unique().tolist())
    counts = np.zeros((1 << BITS, len(langs)), np.float32)
    place = {lang: i for i, lang in enumerate(langs)}
    counts[found["feature"].to_numpy(int), found["lang"].map(place).to_numpy(int)] = found["n"].to_numpy(float)
    return langs, np.log((counts + 0.5) / (counts.sum(axis=0, dtype=float) + 0.5 * (1 << BITS))).astype(np.float32)


def mixture(likely: np.ndarray, count: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [text, language] within the ``allowed`` languages by expectation-maximisation, and the log likelihood of each text.

    ``likely`` holds the likelihood of each distinct n-gram by language, over its largest.
    """
    share = allowed / allowed.sum(axis=1, keepdims=True)
    size = np.add.reduceat(count, starts)[:, None]
    for _ in range(ROUNDS):
        joint = likely * share[owner]
        total = joint.sum(axis=1, keepdims=True) + 1e-30
        before, share = share, np.add.reduceat(joint * (count[:, None] / total), starts, axis=0) / size
        if np.abs(share - before).max() <= SETTLED:
            break
    total = (likely * share[owner]).sum(axis=1) + 1e-30
    return share, np.add.reduceat(count * np.log(total), starts)


def infer(texts: list[str], logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [text, language] of the set of languages of the largest penalised likelihood, and their mean over all sets tried.

    A set's value is its log likelihood less PENALTY * languages * log(n-grams). All single
    languages are tried, then sets that grow by the order of the languages in the mixture
    of all. Sets that cannot win are left out: the log likelihood is concave, so by
    Jensen's inequality no mixture gains more over the best language than n-grams *
    log(largest mean ratio of another language's likelihoods to its own), and no set fits
    better than the mixture of all. The mean weighs each set by the exponential of its value.
    """
    n_langs = logs.shape[1]
    owner, value, count = counted(texts, LENGTHS, BITS)
    count = count.astype(float)
    out, mean = np.zeros((len(texts), n_langs)), np.zeros((len(texts), n_langs))
    has = np.bincount(owner, minlength=len(texts)) > 0
    if not has.any():
        return out, mean
    owner = (np.cumsum(has) - 1)[owner]
    n_texts = int(has.sum())
    starts = np.searchsorted(owner, np.arange(n_texts))
    scores = logs[value]
    scores -= scores.max(axis=1, keepdims=True)
    size = np.add.reduceat(count, starts)
    cost = PENALTY * np.log(size + 1)
    single = np.add.reduceat(scores * count[:, None], starts, axis=0) - cost[:, None]
    best = single.argmax(axis=1)
    worth = single[np.arange(n_texts), best]
    share = np.eye(n_langs)[best]
    top, summed = worth.copy(), np.exp(single - worth[:, None])
    weight = summed.sum(axis=1)
    ratio = np.exp(np.minimum(scores - scores[np.arange(len(owner)), best[owner]][:, None], 60))
    gain = size * np.log(np.add.reduceat(ratio * count[:, None], starts, axis=0).max(axis=1) / size)
    left = np.nonzero(gain > cost)[0]
    if len(left):
        place = np.full(n_texts, -1)
        place[left] = np.arange(len(left))
        rows = place[owner] >= 0
        likely, count, owner = np.exp(scores[rows]), count[rows], place[owner[rows]]
        starts = np.searchsorted(owner, np.arange(len(left)))
        full, most = mixture(likely, count, starts, owner, np.ones((len(left), n_langs)))
        order = np.argsort(-full, axis=1, kind="stable")
        for k in range(2, n_langs + 1):
            tried = np.nonzero(most - k * cost[left] > worth[left])[0]
            if not len(tried):
                break
            allowed = np.zeros((len(tried), n_langs))
            np.put_along_axis(allowed, order[tried, :k], 1, axis=1)
            place = np.full(len(left), -1)
            place[tried] = np.arange(len(tried))
            rows = place[owner] >= 0
            of = place[owner[rows]]
            mixed, fit = mixture(likely[rows], count[rows], np.searchsorted(of, np.arange(len(tried))), of, allowed)
            at = left[tried]
            fit = fit - k * cost[at]
            higher = np.maximum(top[at], fit)
            old, new = np.exp(top[at] - higher), np.exp(fit - higher)
            summed[at] = summed[at] * old[:, None] + mixed * new[:, None]
            weight[at], top[at] = weight[at] * old + new, higher
            better = fit > worth[at]
            share[at[better]], worth[at[better]] = mixed[better], fit[better]
    out[has], mean[has] = share, summed / weight[:, None]
    return out, mean


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score and the languages found with their proportions, of every document.

    ``lang_pred`` is the language of the largest proportion, ``und`` with score 0 where
    the text is null or has no letter, or no language is known. ``score`` is its
    proportion, averaged over the sets of languages by their posterior. Whole texts count.
    Rows with a null language teach nothing; ids may be null or repeat; other columns are
    not read; an empty table gives no rows.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.col(lang_column).alias("lang"))
    langs, logs = train(named)
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in steps(batch.column(1)):
                share, mean = infer([words(t) for t in texts], shared.value) if langs else (np.zeros((len(texts), 1)), np.zeros((len(texts), 1)))
                best = share.argmax(axis=1)
                known = share.max(axis=1) > 0
                pred = [langs[b] if k else UNKNOWN for b, k in zip(best, known)]
                score = np.where(known, np.clip(mean[np.arange(len(best)), best], 0, 1), 0.0)
                found = [",".join(f"{langs[j]}:{share[i, j]:.3f}" for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0) for i in range(len(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[first : first + len(texts)], pa.array(pred, pa.string()), pa.array(score), pa.array(found, pa.string())], names=["doc_id", "lang_pred", "score", "mixture"])

    found = named.select("doc_id", "text").mapInArrow(task, "doc_id long, lang_pred string, score double, mixture string")
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "lang_pred", "score", "mixture")


def op5_language(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
