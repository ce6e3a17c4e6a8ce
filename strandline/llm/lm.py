"""A hidden Markov language model: Baum-Welch counts from all tasks, exact likelihood by the scaled forward recursion.

States emit word classes. Each of the most frequent words is a class of its own; other
words share classes by their last bytes, and within such a class a word has probability
(c + 1) / (sum of (c' + 1) over its known words + 1), the last 1 being for a word never
seen. So log10 of a text's probability is the forward recursion over its classes, plus
log10(c + 1) of its shared words, less log10 of their classes' totals.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandline.llm.common import Scratch, fold, most_frequent, table

FOLDS, HELD = 7, 2
#: Words whose counts every task holds, and how many of them are classes of their own. Both bound what is broadcast.
FREQUENT, OWN = 120_000, 6000
#: Classes of the other words, by the crc32 of their last TAIL bytes.
TAILS, TAIL = 1024, 4
#: Training ends after ROUNDS, or once a round raises the log likelihood by less than this share.
STATES, ROUNDS, GAIN = 6, 4, 1e-3
#: Tokens of a block of training. A block's products of transitions give the state at its borders, so no move is lost there.
SEGMENT = 1024
#: Tokens that a step of a task holds, and words that a task counts before it passes them on.
STEP, FLUSH = 400_000, 300_000
#: Steps of the forward recursion whose emissions are looked up together.
WINDOW = 256
END = OWN + TAILS
CLASSES = END + 1


def tail_class(word: bytes) -> int:
    return OWN + zlib.crc32(word[-TAIL:]) % TAILS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n) of the lower-cased words of ``text``: their number in training rows and in all."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = Counter(), Counter()

        def out():
            for held, words in enumerate(found):
                n = pa.array(list(words.values()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()).cast(pa.string()), pa.array([0] * len(words), pa.int64()) if held else n, n], names=["word", "c", "n"])
                words.clear()

        for batch in batches:
            texts, held = batch.column(0), batch.column(1).to_pylist()
            for i in range(len(texts)):
                found[held[i]].update((texts[i].as_py() or "").encode().lower().split())
                if len(found[0]) + len(found[1]) > FLUSH:
                    yield from out()
        yield from out()

    return docs.select("text", "held_out").mapInArrow(task, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def class_totals(counts: DataFrame, own: set[bytes]) -> np.ndarray:
    """For each shared class the sum of (c + 1) over its known words, plus 1."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TAILS)
        for batch in batches:
            words, c = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_numpy()
            for w, n in zip(words, c):
                if w not in own:
                    total[tail_class(w) - OWN] += n + 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS, dtype=np.int32)), pa.array(total)], names=["class", "total"])

    out = np.ones(TAILS)
    for r in counts.where("c > 0").select("word", "c").mapInArrow(task, "class int, total double").groupBy("class").agg(F.sum("total").alias("total")).collect():
        out[r["class"]] += r["total"]
    return out


def encode(docs: DataFrame, frequent: dict[bytes, int], own: list[bytes], totals: np.ndarray) -> DataFrame:
    """Each document's classes as 16-bit numbers, its sums over frequent words, and its other words with their number.

    ``docs`` has the columns key, doc_id, held_out and text.
    """
    shared = docs.sparkSession.sparkContext.broadcast((frequent, own, np.log10(totals)))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, own, log_total = shared.value
        number = {w: i for i, w in enumerate(own)}
        place = {w: i for i, w in enumerate(frequent)}
        # class, base, within its class, known; the last entry stands for words that are not frequent
        kind_of, base_of = np.zeros(len(place) + 1, np.uint16), np.zeros(len(place) + 1)
        within_of, known_of = np.zeros(len(place) + 1), np.zeros(len(place) + 1, np.int64)
        for i, (w, c) in enumerate(frequent.items()):
            k, base_of[i], known_of[i] = number.get(w, -1), np.log10(c + 1), c > 0
            kind_of[i] = k if k >= 0 else tail_class(w)
            if k < 0:
                within_of[i] = base_of[i] - log_total[kind_of[i] - OWN]
        for batch in batches:
            texts = batch.column(3)
            out: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().lower().split()
                at = np.fromiter(map(place.get, words, repeat(-1)), np.int32, len(words))
                kinds, within, rare = np.append(kind_of[at], np.uint16(END)), float(within_of[at].sum()), Counter()
                for t in np.nonzero(at < 0)[0].tolist():
                    k = kinds[t] = tail_class(words[t])
                    within -= log_total[k - OWN]
                    rare[words[t]] += 1
                for column, x in zip(out, (len(words) + 1, int(known_of[at].sum()), float(base_of[at].sum()), within, kinds.tobytes(), list(rare), list(rare.values()))):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
            words_, times = pa.array(out[5], pa.list_(pa.binary())).cast(pa.list_(pa.string())), pa.array(out[6], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, t) for c, t in zip(out, types)], words_, times], names=["key", "doc_id", "held_out", "n_tokens", "n_frequent", "base", "within", "classes", "rare", "times"])

    return docs.select("key", "doc_id", "held_out", "text").mapInArrow(task, "key long, doc_id long, held_out boolean, n_tokens long, n_frequent long, base double, within double, classes binary, rare array<string>, times array<int>")


class Model:
    """start[state], move[state, state] and emit[class, state]."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, seen: np.ndarray) -> Model:
        """Sticky states whose emissions are the counts of the classes, each shaken by a fixed draw."""
        shake = np.random.default_rng(11).uniform(0.5, 1.5, (CLASSES, STATES))
        emit = (seen[:, None] + 1e-3) * shake
        move = np.full((STATES, STATES), 0.05 / max(1, STATES - 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(STATES, 1 / STATES), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    @classmethod
    def of(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, seen: np.ndarray) -> Model:
        """From counts; every class keeps a share in every state by its frequency, so nothing has probability zero."""
        smooth = (seen + 0.5) / (seen.sum() + 0.5 * CLASSES)
        emit = emit + 2.0 * CLASSES * smooth[:, None] / 100
        start, move = start + 0.1, move + 0.1
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))

    def forward(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log10 likelihood of each sequence; ``lengths`` fall. ``rows`` are the classes of all, one sequence after another.

        At step t only the sequences longer than t are left, so none is padded.
        """
        live, at, place = _by_step(lengths)
        if not len(live):
            return np.zeros(len(lengths))
        kinds, emit, move = _moved(rows, place), np.ascontiguousarray(self.emit.T), self.move.T
        scales = np.empty(len(rows))
        alpha = None
        for begin in range(0, len(live), WINDOW):
            end = min(begin + WINDOW, len(live))
            seen = emit.take(kinds[at[begin] : at[end]], axis=1)
            for t in range(begin, end):
                m, i = live[t], at[t] - at[begin]
                alpha = (move @ alpha[:, :m] if t else self.start[:, None]) * seen[:, i : i + m]
                scale = scales[at[t] : at[t + 1]]
                np.add.reduce(alpha, axis=0, out=scale)
                alpha /= scale
        return np.add.reduceat(np.log10(scales)[place], starts)

    def products(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
        """[block, state, state]: the product of move and emission over each block's tokens, up to a factor.

        The ``first`` block of a text has no move into its first token. ``lengths`` fall.
        """
        live, at, place = _by_step(lengths)
        seen = np.ascontiguousarray(self.emit.T).take(_moved(rows, place), axis=1)
        live, out = np.append(live, 0), np.empty((len(lengths), STATES, STATES))
        # [to, from, block], so that every operation runs along the blocks
        p = np.where(first, np.eye(STATES)[:, :, None], self.move.T[:, :, None])
        for t in range(len(live) - 1):
            m = live[t]
            if t:
                p = (self.move.T @ p[:, :, :m].reshape(STATES, -1)).reshape(STATES, STATES, m)
            p = p * seen[:, None, at[t] : at[t + 1]]
            p /= np.add.reduce(p, axis=(0, 1))
            if live[t + 1] < m:
                out[live[t + 1] : m] = p[:, :, live[t + 1] :].transpose(2, 1, 0)
        return out

    def borders(self, products: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each block the forward state before it and the backward state at its last token.

        ``texts`` are the numbers of blocks of the texts, whose blocks follow each other.
        """
        before, after = np.tile(self.start, (len(products), 1)), np.ones((len(products), STATES))
        at = np.cumsum(texts) - texts
        for k in range(1, int(texts.max(initial=0))):
            i = at[texts > k] + k
            left = np.einsum("ns,nst->nt", before[i - 1], products[i - 1])
            before[i] = left / left.sum(axis=1, keepdims=True)
        for k in range(int(texts.max(initial=0)) - 2, -1, -1):
            i = at[texts > k + 1] + k
            right = np.einsum("nst,nt->ns", products[i + 1], after[i + 1])
            after[i] = right / (before[i + 1] * right).sum(axis=1, keepdims=True)
        return before, after

    def counts(self, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray, first: np.ndarray | None = None, before: np.ndarray | None = None, after: np.ndarray | None = None):
        """Expected counts of starts, moves and emissions, and the log10 likelihood of all; ``lengths`` fall.

        Sequences are whole texts, or blocks with the states at their borders.
        """
        n = len(lengths)
        first = np.ones(n, bool) if first is None else first
        before = np.tile(self.start, (n, 1)) if before is None else before
        after = np.ones((n, STATES)) if after is None else after
        if not n:
            return np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), 0.0
        live, at, place = _by_step(lengths)
        kinds = _moved(rows, place)
        seen = np.ascontiguousarray(self.emit.T).take(kinds, axis=1)
        alphas, scales = np.empty_like(seen), np.empty(len(rows))
        alpha = np.where(first[:, None], before, before @ self.move).T
        for t, m in enumerate(live):
            here = slice(at[t], at[t + 1])
            alpha = (self.move.T @ alpha[:, :m] if t else alpha) * seen[:, here]
            np.add.reduce(alpha, axis=0, out=scales[here])
            alpha /= scales[here]
            alphas[:, here] = alpha
        seen /= scales
        betas = np.empty_like(seen)
        betas[:, at[lengths - 1] + np.arange(n)] = after.T
        for t in range(len(live) - 1, 0, -1):
            here = slice(at[t], at[t + 1])
            betas[:, at[t - 1] : at[t - 1] + live[t]] = self.move @ (seen[:, here] * betas[:, here])
        seen *= betas
        past = np.arange(n, len(rows)) - np.repeat(live[:-1], live[1:])
        inner = ~first
        move = self.move * (alphas[:, past] @ seen[:, n:].T + before[inner].T @ seen[:, :n][:, inner].T)
        betas *= alphas
        start = betas[:, :n][:, first].sum(axis=1)
        emit = np.stack([np.bincount(kinds, share, minlength=CLASSES) for share in betas], axis=1)
        return start, move, emit, float(np.log10(scales).sum())


def _by_step(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences of falling ``lengths``, token by token: how many are left at each step, where each step begins, and each token's place."""
    longest = int(lengths[0]) if len(lengths) else 0
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(longest), side="right")
    at = np.concatenate([[0], np.cumsum(live)])
    ends = np.cumsum(lengths)
    step = np.arange(at[-1]) - np.repeat(ends - lengths, lengths)
    return live, at, at[step] + np.repeat(np.arange(len(lengths)), lengths)


def _moved(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.empty_like(rows)
    out[place] = rows
    return out


def _stepped(column: pa.Array, doc: np.ndarray, start: np.ndarray, length: np.ndarray, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(places in ``chosen`` order, classes of all, starts, falling lengths) of the chosen blocks, in steps of about STEP tokens."""
    order = chosen[np.argsort(-length[chosen], kind="stable")]
    ends = np.cumsum(length[order])
    cut = np.searchsorted(ends // STEP, np.arange(1, (ends[-1] // STEP if len(ends) else -1) + 2))
    at = 0
    for to in [*cut.tolist(), len(order)]:
        if to > at:
            picked = order[at:to]
            rows = np.concatenate([np.frombuffer(column[int(doc[p])].as_buffer(), "<u2")[start[p] : start[p] + length[p]] for p in picked]).astype(np.int64)
            yield picked, rows, np.cumsum(length[picked]) - length[picked], length[picked]
            at = to


def _sizes(column: pa.Array) -> np.ndarray:
    return np.array([column[i].as_buffer().size // 2 for i in range(len(column))], np.int64)


def expected(column: pa.Array, model: Model):
    """The sums of ``Model.counts`` over the whole texts of a batch, block by block with the states at the borders."""
    sizes = _sizes(column)
    parts = (sizes + SEGMENT - 1) // SEGMENT
    doc = np.repeat(np.arange(len(sizes)), parts)
    turn = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start, first = turn * SEGMENT, turn == 0
    length = np.minimum(SEGMENT, sizes[doc] - start)
    before, after = np.tile(model.start, (len(doc), 1)), np.ones((len(doc), STATES))
    several = np.nonzero(parts[doc] > 1)[0]
    if len(several):
        products, place = np.empty((len(several), STATES, STATES)), np.zeros(len(doc), np.int64)
        place[several] = np.arange(len(several))
        for picked, *sequences in _stepped(column, doc, start, length, several):
            products[place[picked]] = model.products(*sequences, first[picked])
        before[several], after[several] = model.borders(products, parts[parts > 1])
    sums = None
    for picked, *sequences in _stepped(column, doc, start, length, np.arange(len(doc))):
        found = model.counts(*sequences, first[picked], before[picked], after[picked])
        sums = found if sums is None else tuple(a + b for a, b in zip(sums, found))
    return sums


def baum_welch(encoded: DataFrame, model: Model, seen: np.ndarray) -> tuple[Model, float]:
    """One round: every task sums its expected counts, Spark adds those of all tasks by class. The driver gets CLASSES rows."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        start, move, emit, total = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES)), 0.0
        for batch in batches:
            if found := expected(batch.column(0), model):
                start, move, emit, total = (x + y for x, y in zip((start, move, emit, total), found))
        # rows beyond the classes hold the moves, the starts and the likelihood
        every = np.vstack([emit, move, start, np.full((1, STATES), total)])
        used = np.nonzero(every.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *[pa.array(every[used, s]) for s in range(STATES)]], names=["row", *[f"s{s}" for s in range(STATES)]])

    states = [f"s{s}" for s in range(STATES)]
    summed = encoded.where("not held_out").select("classes").mapInArrow(task, "row int, " + ", ".join(f"{s} double" for s in states)).groupBy("row").agg(*[F.sum(s).alias(s) for s in states])
    every = np.zeros((CLASSES + STATES + 2, STATES))
    for r in summed.collect():
        every[r["row"]] = [r[s] for s in states]
    return Model.of(every[CLASSES + STATES], every[CLASSES : CLASSES + STATES], every[:CLASSES], seen), float(every[-1, 0])


def likelihood(encoded: DataFrame, model: Model) -> DataFrame:
    """(key, ..., forward): the log10 likelihood of each document's classes, exactly, over whole sequences."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            sizes = _sizes(batch.column(6))
            every = np.arange(len(sizes))
            for picked, *sequences in _stepped(batch.column(6), every, 0 * every, sizes, every):
                out[picked] = model.forward(*sequences)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out)], names=["key", "doc_id", "held_out", "n_tokens", "n_frequent", "sums", "forward"])

    picked = encoded.select("key", "doc_id", "held_out", "n_tokens", "n_frequent", F.struct("base", "within").alias("sums"), "classes")
    return picked.mapInArrow(task, "key long, doc_id long, held_out boolean, n_tokens long, n_frequent long, sums struct<base:double,within:double>, forward double")


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Base score and model score, in log10, of every document.

    A null or empty text is the end token alone. Training takes the rows outside the
    held-out fold; without any, every word is unseen. Ids may be null or repeat; other
    columns are not read; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    named = docs.select(
        F.monotonically_increasing_id().alias("key"), F.col(id_column).cast("long").alias("doc_id"), (fold(F.col(id_column), FOLDS) == HELD).alias("held_out"), F.col(text_column).alias("text")
    )
    counts = scratch.keep(word_counts(named), "counts")
    known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = named.where("not held_out").count()
    n, v = known["n"] + ends, known["v"] + (ends > 0)
    # by all rows, so that a word of the held-out texts alone is no hot key of the join below
    top = most_frequent(counts, "n", FREQUENT).toPandas()
    frequent = dict(zip([w.encode() for w in top["word"]], top["c"].tolist()))
    own = [w for w, c in sorted(frequent.items(), key=lambda x: (-x[1], x[0]))[:OWN] if c > 0]
    totals = class_totals(counts, set(own))
    encoded = scratch.keep(encode(named, frequent, own, totals), "encoded")

    seen = np.zeros(CLASSES)
    seen[: len(own)] = [frequent[w] for w in own]
    seen[OWN:END], seen[END] = totals, ends
    model, likely = Model.first(seen), None
    for _ in range(rounds if ends else 0):
        before = likely
        model, likely = baum_welch(encoded, model, seen)
        if before is not None and likely - before < GAIN * abs(before):
            break

    # words that the tasks do not hold meet their counts in a shuffle; each is rarer than those that they hold
    rare = encoded.select("key", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("key", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts.where("c > 0").select("word", "c"), "word")
    of_key = rare.groupBy("key").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_base"), F.sum("times").alias("rare_known"))
    scored = likelihood(encoded, model).join(of_key, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + zero("rare_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("sums.base") + zero("rare_base") + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        (F.col("forward") + F.col("sums.within") + zero("rare_base")).alias("score"),
    )


def op2_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
