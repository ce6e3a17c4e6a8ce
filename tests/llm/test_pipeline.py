"""The pipeline's near-duplicate stage and run() against brute force."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandline.llm import mixing, pii, rules, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("na", "ro", "tik", "s", "mel")]


def plain_set(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_first(rows):
    """The ids of those that stay, by all pairs."""
    rows = sorted(rows)
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def texts(seed=3):
    """Texts with edited copies of similarity about 0.6 to 1, a long shared passage, and short and blank ones."""
    rng = random.Random(seed)
    passage = " ".join(rng.choices(WORDS, k=60))
    found = [None, "", "  ", "one", "One", "one two", "a b c d e", "a b c d e f"]
    for k in range(40):
        words = rng.choices(WORDS, k=rng.choice((30, 80, 200, 500)))
        words[10:10] = passage.split() if k % 3 == 0 else []
        for edits in (0.0, 0.0, 0.004, 0.01, 0.02, 0.03, 0.04, 0.06):
            found.append(" ".join(rng.choice(WORDS) if rng.random() < edits else w for w in words))
    return found


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def test_near_dedup_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    want = plain_first(rows)
    sets = [plain_set(t) for _, t in rows]
    band = [jaccard(a, b) for i, a in enumerate(sets) for b in sets[:i] if 0.8 <= jaccard(a, b) < 0.95]
    assert len(band) > 50  # pairs that a difference of 4 bits mostly loses
    got = corpus_pipeline.near_duplicates(spark, frame(spark, rows), None)
    assert {r["doc_id"] for r in got.collect()} == want and got.count() == len(want)
    assert corpus_pipeline.near_duplicates(spark, frame(spark, rows).where("false"), None).count() == 0


def test_sketches_rule_out_no_similar_pair():
    sets = [shingles.shingles(t) for t in texts(4)]
    kept = [(shingles.perhaps_similar(shingles.sketch(a), len(a), shingles.sketch(b), len(b)), shingles.similar(a, b)) for i, a in enumerate(sets) for b in sets[:i]]
    assert all(perhaps or not similar for perhaps, similar in kept)
    assert sum(perhaps for perhaps, _ in kept) < 2 * sum(similar for _, similar in kept)


def test_near_dedup_of_a_large_group(spark, monkeypatch):
    """A chain of copies, of which neighbours are similar and the ends are not, in cells of a few documents."""
    monkeypatch.setattr(shingles, "CELL", 8)
    rng = random.Random(5)
    words, rows = rng.choices(WORDS, k=200), []
    for i in range(60):
        rows.append((i, " ".join(words)))
        words[rng.randrange(200)] = rng.choice(WORDS)
    rows += [(100 + i, " ".join(rng.choices(WORDS, k=50))) for i in range(20)]
    got = {r["doc_id"] for r in shingles.keep_first(frame(spark, rows)).collect()}
    assert got == plain_first(rows) and len(got) == 21


def test_run_equals_brute_force(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"{t} mail x{i}@example.org" if t and i % 5 == 0 else t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts(9))], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    good = {r["doc_id"]: r["text"] for r in rules.keep_good(docs).collect()}
    first = plain_first(good.items())
    assert len(first) < len(good)
    kept = docs.where(docs.doc_id.isin(list(first)))
    clean = pii.redact(kept).withColumn("n_chars", pii.F.char_length("text").cast("long")).select(*docs.columns)
    mixed = [(r["doc_id"], r["text"]) for r in mixing.mixed_documents(clean).collect()]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter({i: n for i, n in Counter(i for i, _ in mixed).items()})
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in mixed}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for r in pieces:
        own = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and zlib.crc32(own) == r["ids_crc32"]
        tokens[r["doc_id"]] += r["length"]
    assert {i: n * len(ids[i]) for i, n in want.items()} == dict(tokens)
