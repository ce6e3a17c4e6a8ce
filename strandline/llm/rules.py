"""Quality rules as weak supervision: rules vote or abstain, a latent-class model weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandline.llm.common import Scratch, free_prefix, table

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
IS_SYMBOL, IS_SPACE = (np.isin(np.arange(256), list(x.encode())) for x in (SYMBOLS, SPACES))
BAD, GOOD, ABSTAIN = 0, 1, 2
#: Each rule: (name, measure, bad at or above, good at or below); a rule abstains between the two.
RULES = (
    ("symbols", "symbols_per_word", 0.10, 0.02),
    ("repeats", "repeat_share", 0.20, 0.05),
    ("duplicate_lines", "duplicate_line_share", 0.30, 0.05),
    ("capitals", "capital_share", 0.50, 0.20),
    ("exclamations", "exclamations_per_word", 0.20, 0.05),
    ("long_words", "mean_word", 14.0, 10.0),
    ("not_letters", "other_share", 0.45, 0.20),
    ("short", "shortness", 0.10, 0.04),
    ("symbol_endings", "symbol_ending_share", 0.10, 0.02),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Chance of a vote for the other class, and of an abstention, that expectation-maximisation starts from; the share of good documents.
START_WRONG, START_ABSTAIN, START_GOOD, ROUNDS = 0.004, 0.08, 0.85, 50


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words that lie in windows of ``width`` words found twice or more in the text."""
    n = len(ids)
    if n <= width:
        return 0
    window = ids[: n - width + 1].copy()
    for k in range(1, width):  # pairs of (window so far, next word), numbered again each time: exact
        window = window * np.int64(n) + ids[k : n - width + 1 + k]
        window = np.unique(window, return_inverse=True)[1].reshape(-1)
    starts = np.nonzero(np.bincount(window)[window] > 1)[0]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + width, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measures(text: str | None) -> tuple[list[int], dict[str, float]]:
    """The five counts of a text, and what the rules look at."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    lines = copies = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            copies += line in seen
            seen.add(line)
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeated_words(ids)
    flat = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(flat, minlength=256)
    marked = IS_SYMBOL[flat]
    endings = int((marked[:-1] & IS_SPACE[flat[1:]]).sum()) + int(marked[-1:].sum())
    capitals, small, multi = int(kinds[65:91].sum()), int(kinds[97:123].sum()), int(kinds[192:].sum())
    share = lambda a, b: a / b if b else 0.0
    return [n, chars, symbols, copies, repeats], {
        "symbols_per_word": share(symbols, n),
        "repeat_share": share(repeats, n),
        "duplicate_line_share": share(copies, lines),
        "capital_share": share(capitals, capitals + small),
        "exclamations_per_word": share(text.count("!"), n),
        "mean_word": share(chars, n),
        "other_share": 1 - share(capitals + small + multi, chars) if chars else 0.0,
        "shortness": share(1, n) if n else 1.0,
        "symbol_ending_share": share(endings, n),
    }


def votes(measured: dict[str, float]) -> list[int]:
    return [BAD if measured[m] >= bad else GOOD if measured[m] <= good else ABSTAIN for _, m, bad, good in RULES]


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def with_votes(docs: DataFrame, text_column: str, keep: list[str], mark: str) -> DataFrame:
    """The columns of ``keep``, the five counts and the votes as a text of one digit a rule, in columns that begin with ``mark``."""
    docs = docs.select(*keep, *([] if text_column in keep else [text_column]))
    fields = [docs.schema[c] for c in keep] + [T.StructField(mark + c, T.LongType()) for c in COUNTS] + [T.StructField(f"{mark}votes", T.StringType())]
    at = docs.columns.index(text_column)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            found = [measures(texts[i].as_py()) for i in range(batch.num_rows)]
            counts = [pa.array([c[k] for c, _ in found], pa.int64()) for k in range(len(COUNTS))]
            voted = pa.array(["".join(map(str, votes(m))) for _, m in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *counts, voted], names=[f.name for f in fields])

    return docs.mapInArrow(task, T.StructType(fields))


def fit(patterns: dict[str, int], rounds: int = ROUNDS) -> tuple[float, np.ndarray]:
    """The share of good documents and chances[class, rule, vote], by expectation-maximisation over vote patterns.

    It starts from rules that are mostly right, so class 1 stays the good one; each class
    and rule has a prior of one vote as at the start.
    """
    voted = np.array([[int(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), len(RULES))
    n = np.array(list(patterns.values()), float)
    start = np.zeros((2, len(RULES), 3))
    right = 1 - START_WRONG - START_ABSTAIN
    start[1, :, GOOD], start[1, :, BAD] = right, START_WRONG
    start[0, :, BAD], start[0, :, GOOD] = 0.3, 0.7 - START_ABSTAIN
    start[:, :, ABSTAIN] = START_ABSTAIN
    share, chances = START_GOOD, start
    for _ in range(rounds if len(n) else 0):
        good = posterior(share, chances, voted)
        weight = np.stack([n * (1 - good), n * good])
        counts = start.copy()
        for v in range(3):
            counts[:, :, v] += weight @ (voted == v)
        chances = counts / counts.sum(axis=2, keepdims=True)
        share = (weight[1].sum() + START_GOOD) / (n.sum() + 1)
    return float(share), chances


def posterior(share: float, chances: np.ndarray, voted: np.ndarray) -> np.ndarray:
    rules = np.arange(voted.shape[1])
    bad, good = (np.log(chances[k, rules, voted]).sum(axis=1) for k in (0, 1))
    odds = np.log(share) - np.log1p(-share) + good - bad
    return 1 / (1 + np.exp(-odds))


def verdict(measured: DataFrame, cut: float, mark: str) -> DataFrame:
    """Adds posterior, failed and kept. The vote patterns number at most 3 to the count of rules, whatever the input."""
    voted = F.col(f"{mark}votes")
    patterns = {r["v"]: r["n"] for r in measured.groupBy(voted.alias("v")).agg(F.count("*").alias("n")).collect()}
    share, chances = fit(dict(sorted(patterns.items())))
    odds = F.lit(float(np.log(share) - np.log1p(-share)))
    for k in range(len(RULES)):
        gain = [float(np.log(chances[1, k, v]) - np.log(chances[0, k, v])) for v in range(3)]
        vote = F.substring(voted, k + 1, 1)
        odds = odds + F.when(vote == "0", gain[0]).when(vote == "1", gain[1]).otherwise(gain[2])
    n_words = F.col(f"{mark}n_words")
    failed = (n_words < 10) | (100 * F.col(f"{mark}n_repeat_words") > 20 * n_words)
    found = measured.withColumn(f"{mark}posterior", 1 / (1 + F.exp(-odds))).withColumn(f"{mark}failed", failed)
    return found.withColumn(f"{mark}kept", ~failed & (F.col(f"{mark}posterior") >= cut))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", cut: float = 0.5) -> DataFrame:
    """Counts, base verdict, posterior and verdict of every document.

    A null text has no words, so it fails. Rules whose measure lies between their two
    limits abstain. Equal texts get equal verdicts; ids may be null or repeat; other
    columns are not read; an empty table gives no rows.
    """
    scratch, mark = Scratch(docs.sparkSession), "__"
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    measured = scratch.keep(with_votes(named, "text", ["doc_id"], mark), "votes")
    return verdict(measured, cut, mark).select("doc_id", *[F.col(f"__{c}").alias(c) for c in COUNTS], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"), F.col("__posterior").alias("posterior"), F.col("__votes").alias("votes"))


def keep_good(docs: DataFrame, text_column: str = "text", cut: float = 0.5) -> DataFrame:
    """The documents that judge() keeps, with their own columns, whatever their names.

    Null and short texts go; repeated rows share their fate; ids are not read; an empty
    table gives no rows.
    """
    scratch, mark = Scratch(docs.sparkSession), free_prefix(docs.columns)
    measured = scratch.keep(with_votes(docs, text_column, docs.columns, mark), "votes")
    return verdict(measured, cut, mark).where(F.col(f"{mark}kept")).select(*docs.columns)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
