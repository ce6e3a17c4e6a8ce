"""Sequence files against the tokenizer library and a plain concatenation."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandline.llm import sequences
from strandline.llm.common import Scratch
from tests.oracle import DATA

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids string, row string, folder int"
LONG = " ".join(f"w{i * 7919 % 1013}" for i in range(60_000))
TEXTS = [
    (5, "Hello  World, it's fine"), (2, None), (9, ""), (3, " \n\t "), (7, "ÉCOLE é ΟΔΟΣ 漢字漢字 😀 a b c\x1cd\x0be"), (1, LONG), (4, "x" * 5000),
    (6, "<|endoftext|> in a word<|startoftext|>s <|endoftext"), (8, "I'LL don't 12345 ### …"), (None, "no id"), (None, "none either"), (5, "same id, other text"), (5, "Hello  World, it's fine"),
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "clash", "clash", 0) for i, t in TEXTS], SCHEMA).repartition(3)


def written(spark, docs, **settings):
    folder = Scratch(spark).folder("test")
    sequences.write_sequences(docs, folder, PATH, 2, **settings)
    return folder


def test_documents_come_back_as_the_library_encodes_them(spark, docs, tokenizer):
    got = sorted(tuple(r) for r in sequences.read_documents(spark, written(spark, docs, length=64)).collect() if r["doc_id"] is not None)
    sums = lambda t: (len(ids := [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert sorted((i, n, s) for i, _, n, s in got) == sorted((i, *sums(t)) for i, t in TEXTS if i is not None)
    starts = sorted((start, n, i) for i, start, n, _ in got)
    assert [i for _, _, i in starts] == sorted(i for i, _ in TEXTS if i is not None)
    assert all(a + n == b for (a, n, _), (b, _, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_rows_do_not_depend_on_how_the_table_is_split(spark, docs):
    once, again = ({tuple(r) for r in sequences.read_documents(spark, written(spark, docs.repartition(n), length=32)).collect()} for n in (1, 7))
    assert once == again and len(once) >= len(TEXTS) - 1


def test_sequences_are_views_and_masks_mark_the_padding(spark, docs, tokenizer):
    folder = written(spark, docs.where("doc_id = 1 or doc_id = 9"), length=128)
    files = sequences._files(spark, folder, "sequences").collect()
    want = [*tokenizer.encode(LONG, add_special_tokens=False).ids, 2, 2]
    flat, total = [], 0
    for r in sorted(files, key=lambda r: r["before"]):
        file = sequences.SequenceFile(folder, r["file"])
        for i in range(len(file)):
            ids, mask = file[i]
            assert len(ids) == len(mask) == 128 and not ids.flags.owndata and not ids.flags.writeable
            bits = mask.to_numpy(zero_copy_only=False)
            assert bits.all() or i == len(file) - 1
            flat += ids[bits].tolist()
        with pytest.raises(IndexError):
            file[len(file)]
        total += len(file)
    assert flat == want
    rows = sequences.read_sequences(spark, folder).orderBy("sequence").collect()
    assert [r["sequence"] for r in rows] == list(range(total))
    assert [t for r in rows for t, m in zip(r["ids"], r["mask"]) if m] == want


def test_empty_table(spark, docs):
    folder = written(spark, docs.where("false"))
    assert sequences.read_documents(spark, folder).count() == 0 and sequences.read_sequences(spark, folder).count() == 0


def test_query_equals_the_library_on_whole_texts(spark, tokenizer):
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    want, at = [], 0
    for i, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in sequences.op11_sequences(spark, DATA).collect()) == want
