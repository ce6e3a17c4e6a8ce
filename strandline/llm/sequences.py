"""Token ids as Arrow files of equal-length sequences and masks, which readers map without copying.

A folder holds pairs of Arrow IPC files and a Parquet manifest that names them. Cut into
sequences of one length, the ids of a file's documents follow each other; each row of its
fixed-size-list columns ``ids`` and ``mask`` is a sequence, and only the last one is
padded, where the mask is false. The other file of a pair says where each document begins.
Batches are not compressed, so sequence i is a slice of the mapped file.
"""

from __future__ import annotations

import bisect
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandline.llm.common import Scratch, table

#: Ids of a sequence and sequences of a batch.
LENGTH, BATCH = 2048, 256
#: Runs that a task remembers at most, and characters of the longest of them.
REMEMBERED, LONGEST = 400_000, 40
MANIFEST = "part int, file string, index string, ids long, documents long, sequences long"

_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder(dict):
    """Ids of whole texts, as bytes of one type, for a vocabulary that folds case, drops white space and cuts there.

    A text of Latin letters, digits, signs and ASCII white space is cut into the runs that
    the vocabulary's own cutter makes of it, and this dictionary of bounded size remembers the ids
    of runs seen before. Any other text is cut at ASCII white space, which never lies
    within a token and which nothing reaches across; its words are treated alike, or go to
    the tokenizer whole.
    """

    PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ‐-‧‰-⁞]*\Z")
    RUN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ßà-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = "H" if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) < 1 << 16 else "I"
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        # the byte-level alphabet: printable bytes stand for themselves, the others for the letters from 256 on
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        self.letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}

    def text(self, text: str) -> bytes:
        if self.PLAIN.match(text) and not self.added.search(text):
            return b"".join(map(self.__getitem__, self.RUN.findall(text.lower())))
        return b"".join([self.word(w.decode()) for w in text.encode().split()])

    def word(self, word: str) -> bytes:
        if self.PLAIN.match(word) and not self.added.search(word):
            return b"".join(map(self.__getitem__, self.RUN.findall(word.lower())))
        return array(self.type, self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = array(self.type, [t.id for t in self.model.tokenize(run.encode().decode("latin-1").translate(self.letters))]).tobytes()
        if len(self) < REMEMBERED and len(run) <= LONGEST:
            self[run] = ids
        return ids


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def schema_of(kind: str, length: int) -> pa.Schema:
    ids = pa.uint16() if kind == "H" else pa.uint32()
    return pa.schema([pa.field("ids", pa.list_(ids, length)), pa.field("mask", pa.list_(pa.bool_(), length))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceWriter:
    """Writes one pair of files; a task holds one batch of sequences at a time."""

    def __init__(self, folder: str, name: str, kind: str, length: int = LENGTH):
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        self.schema, self.type, self.length = schema_of(kind, length), np.dtype(kind), length
        self.file, self.index = f"ids-{name}.arrow", f"documents-{name}.arrow"
        self.sinks = [system.open_output_stream(f"{root}/{x}") for x in (self.file, self.index)]
        self.out, self.documents_out = pa.ipc.new_file(self.sinks[0], self.schema), pa.ipc.new_file(self.sinks[1], INDEX)
        self.waiting, self.held, self.rows = [], 0, []
        self.ids = self.documents = self.sequences = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        own = np.frombuffer(ids, self.type)
        self.rows.append((doc_id, self.ids, len(own)))
        self.ids += len(own)
        self.documents += 1
        self.waiting.append(own)
        self.held += len(own)
        if self.held >= BATCH * self.length:
            self._write(self.held // self.length)
        if len(self.rows) >= 50_000:
            self._list()

    def _write(self, sequences: int) -> None:
        everything = np.concatenate([*self.waiting, np.zeros(0, self.type)])
        for at in range(0, sequences, BATCH):
            n = min(BATCH, sequences - at)
            values = everything[at * self.length : (at + n) * self.length]
            mask = np.ones(n * self.length, bool)
            if len(values) < len(mask):
                mask[len(values) :] = False
                values = np.concatenate([values, np.zeros(len(mask) - len(values), self.type)])
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, mask)]
            self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.sequences += sequences
        rest = everything[sequences * self.length :]
        self.waiting, self.held = [rest], len(rest)

    def _list(self) -> None:
        if self.rows:
            self.documents_out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*self.rows)], schema=INDEX))
        self.rows = []

    def close(self) -> tuple[str, str, int, int, int]:
        if self.held:
            self._write(-(-self.held // self.length))
        self._list()
        for x in (self.out, self.documents_out, *self.sinks):
            x.close()
        return self.file, self.index, self.ids, self.documents, self.sequences


def _opened(folder: str, name: str):
    """An Arrow IPC reader, of the mapped file where the folder is a mounted one."""
    system, root = fs.FileSystem.from_uri(folder)
    if isinstance(system, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(f"{root}/{name}"))
    return pa.ipc.open_file(system.open_input_file(f"{root}/{name}"))


class SequenceFile:
    """Random access to one file's sequences: views of the mapped file, of which nothing is copied."""

    def __init__(self, folder: str, name: str):
        self.reader = _opened(folder, name)
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = [self._view(k) for k in range(self.reader.num_record_batches)]
        self.firsts = np.cumsum([0, *(len(ids) for ids, _ in self.batches)]).tolist()

    def _view(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        ids, mask = (c.flatten() for c in self.reader.get_batch(k).columns)
        return ids.to_numpy(zero_copy_only=True).reshape(-1, self.length), mask

    def __len__(self) -> int:
        return self.firsts[-1]

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence ``i``; the mask has a bit for each id."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        k = bisect.bisect_right(self.firsts, i) - 1
        ids, mask = self.batches[k]
        return ids[i - self.firsts[k]], mask.slice((i - self.firsts[k]) * self.length, self.length)

    def slices(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from place ``start`` on, as views that follow each other; only ids whose mask is true lie there."""
        while n > 0:
            k = bisect.bisect_right(self.firsts, start // self.length) - 1
            at = start - self.firsts[k] * self.length
            part = self.batches[k][0].reshape(-1)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> None:
    """Writes the documents' ids in ascending order of the id, each text followed by ``end_id``.

    Rows are dealt out by ranges of (id, hash of the text), so rows of one id, or without
    one, may lie in several files. A null id comes last; rows of one id go by a hash of
    their texts; repeated rows are written as often as they occur. A null or empty text
    is the end id alone. Other columns are not read. An empty table gives a manifest
    without files. A task that is run again writes new files; the manifest names those
    of the attempt that counted, and is written last.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.xxhash64(text_column).alias("by"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), "by", "row"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, out = encoder(tokenizer), None
        end = array(encode.type, [end_id]).tobytes()
        part = TaskContext.get().partitionId()
        for batch in batches:
            for i in range(batch.num_rows):
                out = out or SequenceWriter(folder, f"{part:06d}-{uuid.uuid4().hex}", encode.type, length)
                out.add(batch.column(0)[i].as_py(), encode.text(batch.column(1)[i].as_py()) + end)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "file", "index", "ids", "documents", "sequences"), (part, *out.close())))], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("index", pa.string()), ("ids", pa.int64()), ("documents", pa.int64()), ("sequences", pa.int64())]))

    sorted_ = named.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    sorted_.mapInArrow(task, MANIFEST).write.parquet(f"{folder}/manifest")


def _files(spark: SparkSession, folder: str, counted: str) -> DataFrame:
    """(folder, file, index, before): the files with the sum of ``counted`` over all files before, each in a task of its own.

    The driver holds a row for each file, as Spark does for the files of any table.
    """
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("part").collect()
    before, rows = 0, []
    for r in found:
        rows.append((folder, r["file"], r["index"], before))
        before += r[counted]
    files = spark.createDataFrame(rows, "folder string, file string, index string, before long")
    return files.repartition(len(rows)) if rows else files


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone.

    ``start`` counts the ids of all documents before; the checksum is of the ids as
    little-endian unsigned 32-bit integers.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                file = SequenceFile(r["folder"], r["file"])
                index = _opened(r["folder"], r["index"])
                for k in range(index.num_record_batches):
                    own = index.get_batch(k)
                    sums = []
                    for start, n in zip(own.column(1).to_pylist(), own.column(2).to_pylist()):
                        crc = 0
                        for ids in file.slices(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    starts = pa.array(own.column(1).to_numpy() + r["before"])
                    yield pa.RecordBatch.from_arrays([own.column(0), starts, own.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _files(spark, folder, "ids").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """sequence (its number over all files, from 0), ids and mask of every sequence."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                reader, at = _opened(r["folder"], r["file"]), r["before"]
                for k in range(reader.num_record_batches):
                    own = reader.get_batch(k)
                    columns = [pa.array(np.arange(at, at + own.num_rows)), own.column(0).cast(pa.list_(pa.int32())), own.column(1).cast(pa.list_(pa.bool_()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["sequence", "ids", "mask"])
                    at += own.num_rows

    return _files(spark, folder, "sequences").mapInArrow(task, "sequence long, ids array<int>, mask array<boolean>")


def op11_sequences(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = Scratch(spark).folder("sequences")
    write_sequences(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return read_documents(spark, folder)
