"""Hierarchical multi-length packing of token ids into windows of 256 to 2048."""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
#: Remainders that a task holds before it packs them, and tokens in a step group.
POOL, STEP_TOKENS = 4096, 32_768

_CACHES: dict[str, "Encoder"] = {}


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit ids, remembering frequent pieces.

    A text is cut before each single space between two other characters, where the
    vocabulary's pre-tokenizer cuts too, so the ids of the pieces are the ids of the
    text. Pieces that were seen before come from a dictionary of bounded size. A text that
    holds one of the vocabulary's added tokens goes to the tokenizer whole.
    """

    #: Runs that the byte-level pre-tokenizer keeps together, for texts of Latin letters.
    RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")
    PLAIN = re.compile(r"[\x00-\x1b\x20-\x7eÀ-ÖØ-öø-ɏ]*\Z")
    TWO_SPACES = re.compile(r"\s\s")
    BETWEEN = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str, remembered: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.remembered = self.tokenizer.model, remembered
        self.pieces: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {}
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}

    def text(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        known = self.pieces
        if self.TWO_SPACES.search(text):
            parts = self.BETWEEN.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + x for x in rest]]
        try:
            return b"".join([known[x] for x in parts])
        except KeyError:
            return b"".join([known[x] if x in known else self.piece(x) for x in parts])

    def piece(self, piece: str) -> bytes:
        if self.PLAIN.match(piece):
            ids = b"".join([self.runs[x] if x in self.runs else self.run(x) for x in self.RUN.findall(piece)])
        else:
            ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(self.pieces) < self.remembered and len(piece) < 40:
            self.pieces[piece] = ids
        return ids

    def run(self, run: str) -> bytes:
        ids = array("I", [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(self.runs) < self.remembered and len(run) < 40:
            self.runs[run] = ids
        return ids


def encoder(path: str) -> Encoder:
    if path not in _CACHES:
        _CACHES[path] = Encoder(path)
    return _CACHES[path]


class Packer:
    """Packs one task's documents. Whole windows of 2048 leave at once; what remains of a
    document goes to the smallest tier that holds it. A window starts with the longest
    remainder, its gap takes the longest remainders that fit, from shorter tiers too, and
    one last piece is cut to close it."""

    def __init__(self, prefix: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.top, self.step_tokens = sorted(tiers), max(tiers), step_tokens
        self.next_sequence = self.next_group = prefix
        self.pool: list[tuple[int, int]] = []  # length, number of the open document; ascending
        self.open: dict[int, list] = {}  # number: id, bytes not in a window yet, tokens, next start, start of the bytes
        self.numbered = self.waiting = 0
        self.rows: list[list] = []

    def _piece(self, number: int, length: int, sequence: int, offset: int, tier: int) -> None:
        doc = self.open[number]
        at = doc[3]
        doc[3] += length
        self.rows.append([doc[0], at, length, zlib.crc32(memoryview(doc[1])[4 * (at - doc[4]) : 4 * (at + length - doc[4])]), doc[2], sequence, offset, tier, 0])
        if doc[3] == doc[2]:
            del self.open[number]

    def _sequence(self) -> int:
        self.next_sequence += 1
        return self.next_sequence - 1

    def add(self, doc_id, ids: bytes) -> None:
        number, n = self.numbered, len(ids) // 4
        self.numbered += 1
        self.open[number] = doc = [doc_id, ids, n, 0, 0]
        for _ in range(n // self.top):
            self._piece(number, self.top, self._sequence(), 0, self.top)
        if rest := n % self.top:
            doc[1], doc[4] = ids[4 * doc[3] :], doc[3]
            bisect.insort(self.pool, (rest, number))
            self.waiting += rest

    def pack(self, last: bool = False) -> None:
        while self.pool and (last or self.waiting >= self.top):
            longest = self.pool[-1][0]
            tier = self.tiers[bisect.bisect_left(self.tiers, longest)]
            if self.waiting < tier:  # the end of the task: what is left goes out in powers of two
                tier = 1 << (self.waiting.bit_length() - 1)
            sequence, offset = self._sequence(), 0
            while offset < tier:
                gap = tier - offset
                at = bisect.bisect_right(self.pool, (gap, self.numbered)) - 1
                if at >= 0:
                    length, number = self.pool.pop(at)
                else:
                    length, number = self.pool.pop(0)
                    bisect.insort(self.pool, (length - gap, number))
                    length = gap
                self._piece(number, length, sequence, offset, tier)
                offset += length
                self.waiting -= length

    def taken(self) -> list[list]:
        """The pieces made so far, their sequences dealt to step groups of about equal tokens."""
        sizes: dict[int, int] = {}
        for row in self.rows:
            sizes[row[5]] = sizes.get(row[5], 0) + row[2]
        groups = max(1, round(sum(sizes.values()) / self.step_tokens))
        loads = [(0, self.next_group + i) for i in range(groups)]
        self.next_group += groups
        dealt = {}
        for sequence in sorted(sizes, key=lambda s: (-sizes[s], s)):
            load, group = loads[0]
            heapq.heapreplace(loads, (load + sizes[sequence], group))
            dealt[sequence] = group
        for row in self.rows:
            row[8] = dealt[row[5]]
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", end_id: int = 1, tiers=TIERS) -> DataFrame:
    """Pieces of documents in sequences of at most ``max(tiers)`` ids.

    Each task packs its own documents, so nothing is shuffled and a task holds at most
    ``POOL`` open remainders of less than a window each. Sequence and group numbers start at the task's partition
    number times 2**32. All windows are full; the last tokens of a task, fewer than the
    next window, go to sequences whose lengths are powers of two. A null or empty text is
    the end id alone; a null id stays null; repeated rows are packed as often as they
    occur; other columns are not read; an empty table gives no rows.
    """
    names = [x.strip().split(" ")[0] for x in SCHEMA.split(",")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << 32, tiers)
        end = array("I", [end_id]).tobytes()
        types = [pa.int64()] * 7 + [pa.int32(), pa.int64()]

        def out():
            columns = list(zip(*packer.taken())) or [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                packer.add(ids[i].as_py(), encode.text(texts[i].as_py() or "") + end)
                if len(packer.pool) >= POOL:
                    packer.pack()
                if len(packer.rows) >= 20_000:
                    yield out()
        packer.pack(last=True)
        if packer.rows:
            yield out()

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(task, SCHEMA)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from strandline.llm.common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
