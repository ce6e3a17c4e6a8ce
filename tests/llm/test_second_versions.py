"""The labelled operators, ties and bounds against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from strandline.llm import common, language, mixing, quality, toxicity
from tests.oracle import DATA


@pytest.fixture(scope="module")
def tables(spark):
    return [spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels")]


def grams(text, lengths, bits):
    """{hash: count} of the n-grams of code points, one by one."""
    out = {}
    for n in lengths:
        for i in range(len(text) - n + 1):
            h = 0
            for c in text[i : i + n]:
                h = (h * 0x01000193 + ord(c) + 1) % 2**32
            h = ((h ^ h >> 15) * 0x2C1B3C6D + n * 0x9E3779B1) % 2**32 >> 32 - bits
            out[h] = out.get(h, 0) + 1
    return out


def test_toxicity_equals_a_plain_sum_and_plain_ratios(spark, tables, monkeypatch):
    docs, labels = tables
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    short = docs.withColumn("text", F.substring("text", 1, 400)).withColumn("label", F.lit("x")).withColumn("part", F.lit(1)).withColumn("features", F.lit(2))
    found, weight, intercept = toxicity.train(short, labels)
    known = [(r["doc_id"], r["toxic"]) for r in labels.collect() if r["toxic"] is not None]
    import zlib

    known = [(i, y) for i, y in known if zlib.crc32(str(i).encode()) % 3 != 1]
    sets = [(set(grams(toxicity.plain(texts[i][:400]), toxicity.LENGTHS, toxicity.BITS)), y) for i, y in known if i in texts]
    n = [sum(y == k for _, y in sets) for k in (0, 1)]
    counts = {}
    for own, y in sets:
        for g in own:
            counts.setdefault(g, [0, 0])[y] += 1
    ratio = {g: math.log((c[1] + 1) / (n[1] + 2)) - math.log((c[0] + 1) / (n[0] + 2)) for g, c in counts.items()}
    by = sorted((-abs(ratio[g]) / math.sqrt(1 / (c[0] + 1) + 1 / (c[1] + 1)) for g, c in counts.items()))
    assert len(found) == min(len(counts), toxicity.FEATURES) and set(found.tolist()) <= set(counts)
    worst = max(-abs(ratio[g]) / math.sqrt(1 / (counts[g][0] + 1) + 1 / (counts[g][1] + 1)) for g in found.tolist())
    assert worst == pytest.approx(by[len(found) - 1])
    weights = dict(zip(found.tolist(), weight.tolist()))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(short, labels).collect()}
    assert len(set(got.values())) > 50
    for i in list(texts)[:60]:
        odds = intercept + sum(weights.get(g, 0.0) * math.log1p(c) for g, c in grams(toxicity.plain(texts[i][:400]), toxicity.LENGTHS, toxicity.BITS).items())
        assert got[i] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, odds)))), abs=1e-5)


def test_quality_equals_plain_sizes(spark, tables):
    docs, labels = tables
    clashing = docs.withColumn("difference", F.lit("x")).withColumn("label", F.lit("y")).withColumn("part", F.lit(0))
    good, bad, (slope, intercept) = quality.train(docs, labels)
    got = {r["doc_id"]: (r["score"], r["difference"]) for r in quality.score(clashing, labels).collect()}
    size = lambda words, raw: len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_checksum=False, write_dict_id=False).compress(raw))
    for r in docs.limit(60).collect():
        raw = (r["text"] or "").encode()
        b, g = (size(bad, raw), size(good, raw)) if raw else (1, 1)
        assert got[r["doc_id"]][1] == pytest.approx((b - g) / (b + g), abs=0.02)
        assert got[r["doc_id"]][0] == pytest.approx(1 / (1 + math.exp(-(slope * got[r["doc_id"]][1] + intercept))))


def test_languages_equal_a_search_of_every_set():
    """Likelihoods by hand: all sets of three languages, each by long expectation-maximisation."""
    rng = random.Random(2)
    texts = ["".join(rng.choice(part) for _ in range(n)) for part, n in (("abcd", 60), ("wxyz", 80), ("abcdwxyz", 120), ("mnop", 50), ("abcdmnopwxyz", 200))]
    logs = np.full((1 << language.BITS, 3), -12.0, np.float32)
    for k, part in enumerate(("abcd", "wxyz", "mnop")):
        for n in language.LENGTHS:
            for own in itertools.product(part, repeat=n):
                logs[list(grams("".join(own), (n,), language.BITS)), k] = -n * math.log(4)
    share, mean = language.infer(texts, logs)
    for t, got in zip(texts, share):
        own = grams(t, language.LENGTHS, language.BITS)
        likely, count = np.exp(logs[list(own)].astype(float)), np.array(list(own.values()), float)
        best = None
        for size in (1, 2, 3):
            for chosen in itertools.combinations(range(3), size):
                p = np.zeros(3)
                p[list(chosen)] = 1 / size
                for _ in range(3000):
                    joint = likely * p
                    p = (joint / joint.sum(axis=1, keepdims=True) * count[:, None]).sum(axis=0) / count.sum()
                value = (count * np.log((likely * p).sum(axis=1))).sum() - language.PENALTY * size * math.log(count.sum() + 1)
                if best is None or value > best[0] + 1e-9:
                    best = (value, p)
        assert np.allclose(got, best[1], atol=5e-3)
    assert np.allclose(mean.sum(axis=1), 1)


def test_bounds_are_filled_where_counts_tie(spark):
    counts = spark.createDataFrame([(f"w{i}", 5 if i < 10 else 2) for i in range(300)], "word string, n long")
    once, again = ({r["word"] for r in common.most_frequent(counts.repartition(k), "n", 100).collect()} for k in (1, 5))
    assert once == again and len(once) == 100 and {f"w{i}" for i in range(10)} <= once
    assert common.most_frequent(counts, "n", 300).count() == 300 and common.most_frequent(counts.where("false"), "n", 3).count() == 0


def test_mix_of_one_id_does_not_depend_on_how_the_table_is_split(spark):
    rows = [(7 if i % 2 else None, f"text {'word ' * (i % 17)}{i if i % 2 else 'same'}", "a") for i in range(400)] + [(1000 + i, "two words", "b") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    once, again = (sorted(map(str, mixing.mix(docs.repartition(n), ["doc_id", "text"]).collect())) for n in (2, 7))
    assert once == again
