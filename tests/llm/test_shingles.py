"""The last round of near-duplicates against every pair."""

import random
from collections import Counter

import numpy as np

from strandline.llm import shingles as sh
from strandline.llm.common import Scratch


def corpus(n=160):
    """Texts that share long passages without being similar, and near copies of some."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(40)] for _ in range(4)]
    texts = [[word() for _ in range(rng.randrange(5, 60))] + rng.choice(passages) + [word() for _ in range(rng.randrange(0, 40))] for _ in range(n)]
    for i in range(0, n // 2, 3):
        copy = list(texts[i])
        copy[rng.randrange(len(copy))] = "edit"
        texts.append(copy)
    return [" ".join(t) for t in texts]


def test_reordered_prefixes_lose_no_similar_pair_and_propose_few(spark):
    texts = corpus()
    sets = [sh.shingles(t) for t in texts]
    similar = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sh.similar(sets[a], sets[b])}
    lists = spark.createDataFrame([(1, i) for i in range(len(texts))], "shingle long, row long")
    whole = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    ordered = sh._by_frequency(lists, whole, Scratch(spark))
    for r in ordered.groupBy("row", "size").agg({"place": "max"}).collect():
        assert r["size"] == len(sets[r["row"]]) and r["max(place)"] <= r["size"] - (4 * r["size"] + 4) // 5 + 1
    n = ordered.groupBy("shingle").count().withColumnRenamed("count", "n")
    dealt = ordered.join(n, "shingle").withColumn("label", ordered["row"])
    proposed = {(r["a"], r["b"]) for r in sh._all_pairs(dealt).collect()}
    assert similar and similar <= proposed
    assert len(proposed) < len(similar) + 0.02 * len(texts) ** 2


def test_places_of_plain_prefixes_lose_no_similar_pair(spark):
    texts = corpus(80)
    sets = [sh.shingles(t) for t in texts]
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rows = [(int(s), i, len(own), k + 1, i) for i, own in enumerate(sets) for k, s in enumerate(sh.prefix(own, *none).view(np.int64))]
    lists = spark.createDataFrame(rows, "shingle long, row long, size int, place int, label long")
    n = lists.groupBy("shingle").count().withColumnRenamed("count", "n")
    proposed = {(r["a"], r["b"]) for r in sh._all_pairs(lists.join(n, "shingle")).collect()}
    assert {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if sh.similar(sets[a], sets[b])} <= proposed


def test_shingles_travel_in_chunks_and_parts(spark, monkeypatch):
    """Many chunks and parts, some shingles put last uncounted: no similar pair is lost, numbers are exact, and no row is sent for a single shingle."""
    monkeypatch.setattr(sh, "CHUNK", 1500)
    monkeypatch.setattr(sh, "DEALT", 30)
    texts = corpus() + ["", "two words"]
    sets = [sh.shingles(t) for t in texts]
    held = Counter(s for own in sets for s in own.tolist())
    often = np.array(sorted(s for s, n in held.items() if n > 20), np.uint64)
    counts = np.array([held[s] for s in often.tolist()], np.int64)
    lists = spark.createDataFrame([(1, i) for i in range(len(texts))], "shingle long, row long")
    ordered = sh._by_frequency(lists, spark.createDataFrame(list(enumerate(texts)), "row long, text string"), Scratch(spark), often, counts)
    got = {(r["row"], r["place"]): r["shingle"] for r in ordered.collect()}
    for row, own in enumerate(sets):
        last = dict(zip(often.tolist(), counts.tolist()))
        order = sorted(own.tolist(), key=lambda s: (last.get(s, 0), 0 if s in last else held[s], s))
        names = [s - (1 << 64) * (s >> 63) if s in last else s >> 32 for s in order]
        wanted = {(row, k + 1): n for k, (s, n) in enumerate(zip(order, names)) if held[s] > 1 and k < len(own) - (4 * len(own) + 4) // 5 + 1}
        assert {at: s for at, s in got.items() if at[0] == row} == wanted
    n = ordered.groupBy("shingle").count().withColumnRenamed("count", "n")
    proposed = {(r["a"], r["b"]) for r in sh._all_pairs(ordered.join(n, "shingle").withColumn("label", ordered["row"])).collect()}
    assert {(a, b) for a in range(160) for b in range(a + 1, len(sets)) if len(sets[b]) and sh.similar(sets[a], sets[b])} <= proposed
    sent = sh._dealt(list(range(len(sets))), sets, often, counts, 5)
    assert sent.num_rows == 6 and sum(n for part, n in zip(sent.column(0).to_pylist(), sent.column(2).to_pylist()) if part >= 0) == sum(len(own) - len(np.intersect1d(own, often)) for own in sets)


def test_a_large_group_of_near_copies_is_compared_with_its_centre(spark, monkeypatch):
    """Copies of one text, many of them too different to be similar to each other: pairs grow with the copies, not with their square."""
    rng, proposed = random.Random(8), []
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(150), 1 + i % 5):
            copy[at] = word()
        texts.append(" ".join(copy))
    confirmed = sh._confirmed
    monkeypatch.setattr(sh, "_confirmed", lambda pairs, *rest: proposed.append(pairs.count()) or confirmed(pairs, *rest))
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"] for r in sh.keep_first(docs).collect()}
    sets, root = [sh.shingles(t) for t in reversed(texts)], list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a in range(len(sets)):
        for b in range(a):
            if sh.similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {600 + i for i in range(len(sets)) if find(i) == i} and len(got) > 100
    assert sum(proposed) < 5 * len(texts)


def test_further_links_join_the_labels_of_what_they_connect(spark, monkeypatch):
    """A large component gets new links: labels are those of all links together, and only new links go through the rounds."""
    rng, seen = random.Random(3), []
    first = [(0, i) for i in range(1, 700)] + [(1000 + i, 1001 + i) for i in range(0, 40, 2)]
    further = [(690 + k, 1000 + 2 * k) for k in range(5)] + [(2000, 1030), (3000, 3001), (3001, 2999)] + [(4000, 1038 + k) for k in (0, 1)]
    frame = lambda rows: spark.createDataFrame(rng.sample(rows, len(rows)), "bits long, other long")
    roots, scratch = sh.roots, Scratch(spark)
    want = {(r["bits"], r["root"]) for r in roots(frame(first + further), Scratch(spark)).collect()}
    labels = roots(frame(first), scratch)
    monkeypatch.setattr(sh, "roots", lambda edges, scratch: seen.append(edges.count()) or roots(edges, scratch))
    got = sh._relabelled(labels, frame(further), scratch, "joined").collect()
    assert {(r["bits"], r["root"]) for r in got} == want and len(got) == len(want)
    assert seen[0] <= len(further)
