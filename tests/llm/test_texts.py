"""The text operators on hand-made tables, against plain Python versions."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer

from strandline.llm import common, language, lm, mixing, packing, pii, quality, rules, shingles, simhash, toxicity
from strandline.llm.common import Scratch
from strandline.llm.queries import queries
from tests.oracle import DATA, of_spark

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, bits string"
PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank every single morning"
TEXTS = [
    None, "", " \n\t ", "one", SENTENCE, SENTENCE, SENTENCE + " again", "Ünïcödé wörter 漢字 😀 x y 'll don't 12345 a  b",
    "mail bob.x@example.org or 10.0.0.1, card 4111 1111 1111 1111, call +49 (30) 123-4567 now", "line\n" * 30, "a b c d e " * 400, "### $$$ %% " * 20,
    " ".join(f"w{i % 97}" for i in range(30_000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i == 3 else "s" + str(i % 3), None, "clash", "clash") for i, t in enumerate(TEXTS)]
    rows += [(4, SENTENCE, "en", "s1", 1, "x", "y"), (None, "no id at all here", "en", "s1", 1, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(13)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_mix_meets_its_targets(spark, docs):
    found = mixing.mix(docs, ["doc_id", "text"]).collect()
    assert len(found) == docs.count()
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs, ["doc_id", "text"]).collect()))
    for r in found:
        assert r["size"] == len(words(r["text"])) and r["taken"] in (0, r["size"], 2 * r["size"])
    assert sum({r["target"] for r in found}) == pytest.approx(1.5 * sum(r["size"] for r in found), rel=1e-6) or any(r["target"] == 2 * r["source_size"] for r in found)
    assert set(mixing.mixed_documents(docs).columns) == set(docs.columns)


def test_mix_of_an_empty_table(docs):
    assert mixing.mix(docs.where("false"), ["doc_id"]).count() == 0


def plain_fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    n = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    prints = [plain_fingerprint(t) for _, t in rows]
    comps = plain_components(prints)
    want = sorted(((i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, comps)), key=repr)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_links_of_random_fingerprints_lose_none(spark):
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for b in base[:30]:
        for _ in range(4):
            base.append(b ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)))
    base = sorted(set(base))
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in base]
    stored = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "doc_id long, bits long")
    got = {r["bits"]: r["first"] for r in simhash.components(stored, Scratch(spark)).collect()}
    assert [got[s] for s in signed] == plain_components(base)
    # two blocks, for very many fingerprints, connect the same
    for blocks in (3, 2):
        label = {r["bits"]: r["root"] for r in simhash.roots(simhash.links(stored, Scratch(spark), blocks), Scratch(spark)).collect()}
        groups = {}
        for s in signed:
            groups.setdefault(label.get(s, s), []).append(got[s])
        assert len(groups) == len(set(got.values())) and all(len(set(g)) == 1 for g in groups.values())


def test_every_pair_within_reach_meets_at_an_anchor():
    rng = np.random.default_rng(4)
    for number, blocks in simhash.BLOCKS.items():
        slack = simhash.THRESHOLD // number
        for _, width in blocks:
            one = rng.integers(0, 1 << width, 500)
            other = one.copy()
            for _ in range(slack):
                other ^= 1 << rng.integers(0, width, 500)
            home, reach = simhash.anchors(one, width, slack)[:, 0], simhash.anchors(other, width, slack)
            assert (home[:, None] == reach).any(axis=1).all()


def test_hot_keys_lose_and_repeat_no_row(spark, monkeypatch):
    monkeypatch.setattr(common, "PART", 8)
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(600)], "key long, row long")
    names = spark.createDataFrame([(i, f"n{i}") for i in range(0, 600, 2)], "key long, name string")
    for how in ("inner", "left", "left_anti"):
        assert of_spark(common.spread_join(rows, names, "key", ["row"], 600, how)) == of_spark(rows.join(names, "key", how))


def plain_base(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            x = int(c) * (1 + k % 2)
            total += x - 9 if x > 9 else x
        return total % 10 == 0

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m.group())]


def check_pii(rows):
    for r in rows:
        base = plain_base(r["text"])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), r["doc_id"]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == n for k, *_ in base) for n in ("email", "ip", "card", "phone")]
        assert set(listed.split(",")) - {""} <= set(r["spans"].split(","))


def test_pii_equals_plain_expressions(spark, docs):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(t for t in TEXTS)] + [(50, "1.2.3.4.5.6.7.8 a@b a@b.c@d.e x..y@q-r.s.t +1 2 +12345678"), (51, "999.1.1.1 0000 0000 0000 0000 DE89 3704 0044 0532 0130 00 iban DE89370400440532013000 ssn 123-45-6789")], "doc_id long, text string")
    check_pii(pii.report(texts).join(texts, "doc_id").collect())
    assert any("iban" in r["spans"] and "ssn" in r["spans"] for r in pii.report(texts).where("doc_id = 51").collect())
    clean = {r["doc_id"]: r["text"] for r in pii.redact(texts).collect()}
    assert clean[0] is None and "[EMAIL]" in clean[8] and "4111" not in clean[8] and clean[4] == SENTENCE


CASES = [
    ("ES91 2100 0418 4502 0005 1332 BIC CAIXESBBXXX", "iban", ["ES91 2100 0418 4502 0005 1332"]),
    ("pay AT61 1904 3002 3457 3201 SWIFT or PL61 1090 1014 0000 0712 1981 2874 NOW", "iban", ["AT61 1904 3002 3457 3201", "PL61 1090 1014 0000 0712 1981 2874"]),
    ("ES91 2100 0418 4502 0005 1332 GB82 WEST 1234 5698 7654 32 DE89370400440532013000 OK", "iban", ["ES91 2100 0418 4502 0005 1332", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000"]),
    ("ref AB12 CD34 EF56 ES91 2100 0418 4502 0005 1332 BIC", "iban", ["ES91 2100 0418 4502 0005 1332"]),
    ("ES92 2100 0418 4502 0005 1332 BIC", "iban", []),
    ("SSN: 123-45-6789, 234-56-7890", "ssn", ["123-45-6789", "234-56-7890"]),
    ("123-45-6789 is her ssn", "ssn", ["123-45-6789"]),
    ("123-45-6789 " + "x" * 40 + " ssn", "ssn", []),
    ("ssn " + "x" * 40 + " 123-45-6789", "ssn", []),
    ("hotel 555-123-4567 in a fax", "local_phone", ["555-123-4567"]),
    ("hotel 555-123-4567 in a faxing scalling hotel", "local_phone", []),
    ("x " * 5000 + "ssn 123-45-6789 " * 200, "ssn", ["123-45-6789"] * 200),
    ("call 555-123-4567 or 555-123-4568, 555-123-4569", "local_phone", ["555-123-4567", "555-123-4568", "555-123-4569"]),
]


def test_pii_spans_beside_others(spark):
    cases = [("é漢😀 " + text, kind, spans) for text, kind, spans in CASES]
    docs = spark.createDataFrame([(i, text) for i, (text, *_) in enumerate(cases)], "doc_id long, text string")
    found, clean = ({r["doc_id"]: r for r in f(docs).collect()} for f in (pii.find, pii.redact))
    for i, (text, kind, spans) in enumerate(cases):
        assert [text[s["start"] : s["end"]] for s in found[i][f"pii_{kind}"]] == spans, text[:80]
        assert not any(s in clean[i]["text"] for s in spans)


def test_redaction_of_long_texts_and_overlaps(spark):
    """Against a plain cut by the spans found, over chunk and block borders."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(6):
        parts = ["é" * int(rng.integers(1, 3000)) if rng.random() < 0.1 else str(rng.choice(["mail a.b@c.de", "10.0.0.1", "4111 1111 1111 1111 10.0.0.2", "+49 30 1234567", "word", "😀", "1.2.3.4.5@x.y"])) for _ in range(500)]
        rows.append((i, " ".join(parts)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.redact(texts).collect()}
    for r in pii.find(texts).collect():
        spans = sorted((s["start"], s["end"], s["kind"]) for k in pii.KINDS for s in r[f"pii_{k.name}"])
        out, at = "", 0
        for start, end, kind in spans:
            if start >= at:
                out += r["text"][at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        assert len(spans) > 200 and clean[r["doc_id"]] == out + r["text"][at:]
    check_pii(pii.report(texts).join(texts, "doc_id").collect())


def test_stages_keep_columns_of_any_name_and_take_empty_tables(spark):
    names = ["__votes", "__row", "__spans", "__n_words", "__bits", "__set", "__m_email", "__pii_email", "__slice", "__key", "__plan_edge", "mix_size", "__times", "pii", "size", "ROW", "label", "n"]
    rows = [(i, t, "en", "s", 1, *[f"{n}{i}" for n in names]) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for stage in (rules.keep_good, shingles.keep_first, pii.redact, mixing.mixed_documents):
        found = stage(docs)
        assert found.columns == docs.columns
        own = {r[0]: tuple(r)[5:] for r in rows} and {r[0]: tuple(r[5:]) for r in rows}
        got = found.collect()
        assert got and all(tuple(r)[5:] == own[r["doc_id"]] for r in got)
        empty = stage(docs.where("false"))
        assert empty.columns == docs.columns and empty.count() == 0
    for operator in (lm.score, language.identify, lambda d: packing.pack(d, PATH), pii.report, rules.judge, simhash.near_duplicates):
        assert operator(docs).count() >= len(rows) and operator(docs.where("false")).count() == 0


def test_pii_on_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    check_pii(pii.report(docs).join(docs, "doc_id").collect())


def check_pieces(found, texts):
    """Every id of every row lies in one piece; sequences are gapless, at most 2048 long and mostly full."""
    ids = {i: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == ids.keys()
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            own = np.array(ids[i][r["start"] : r["start"] + r["length"]], "<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids[i]) and zlib.crc32(own) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids[i])
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded == 0


def test_packing_round_trip(spark, docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH).collect(), rows)
    assert packing.pack(docs, PATH).where("doc_id is null").agg({"length": "sum"}).first()[0] > 0
    assert packing.pack(docs.where("false"), PATH).count() == 0


def test_packing_takes_added_tokens(spark):
    marker = "<|endoftext|>"
    rows = list(enumerate(["end of page " + marker + " next", marker, marker * 3, "a" + marker + "  b\n" + marker, "<|endoftext |>", " <|endoftext|", SENTENCE + marker]))
    assert TOKENIZER.encode(rows[1][1], add_special_tokens=False).ids == [50256]
    check_pieces(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect(), rows)


def test_packing_of_the_small_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    check_pieces(packing.pack(docs, PATH).collect(), [tuple(r) for r in docs.collect()])


def plain_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def test_quality_rules_equal_plain_counts(spark, docs):
    for source in (docs.where("doc_id is not null").dropDuplicates(["doc_id"]), spark.read.parquet(f"{DATA}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in source.collect()}
        found = rules.judge(source).collect()
        assert len(found) == len(texts)
        for r in found:
            want = plain_counts(texts[r["doc_id"]])
            assert [r[c] for c in rules.COUNTS] == want
            assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    assert rules.judge(docs.where("false")).count() == 0
    assert rules.keep_good(docs).columns == docs.columns


def test_posterior_equals_a_plain_model(spark, docs):
    """Expectation-maximisation over the documents one by one, in plain Python."""
    found = rules.judge(spark.read.parquet(f"{DATA}/documents.parquet")).select("votes", "posterior", "base_failed", "kept").collect()
    votes = [[int(c) for c in r["votes"]] for r in found]
    right = 1 - rules.START_WRONG - rules.START_ABSTAIN
    start = {1: [rules.START_WRONG, right, rules.START_ABSTAIN], 0: [0.3, 0.7 - rules.START_ABSTAIN, rules.START_ABSTAIN]}
    chances = {k: [list(start[k]) for _ in rules.RULES] for k in (0, 1)}
    share = rules.START_GOOD

    def good(vote):
        a, b = share, 1 - share
        for k, v in enumerate(vote):
            a, b = a * chances[1][k][v], b * chances[0][k][v]
        return a / (a + b)

    for _ in range(rules.ROUNDS):
        posterior = [good(v) for v in votes]
        counts = {k: [list(start[k]) for _ in rules.RULES] for k in (0, 1)}
        for vote, p in zip(votes, posterior):
            for k, v in enumerate(vote):
                counts[1][k][v] += p
                counts[0][k][v] += 1 - p
        chances = {k: [[x / sum(c) for x in c] for c in counts[k]] for k in (0, 1)}
        share = (sum(posterior) + rules.START_GOOD) / (len(votes) + 1)
    for r, vote in zip(found, votes):
        assert r["posterior"] == pytest.approx(good(vote), rel=1e-6, abs=1e-12)
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)


def test_rules_learn_who_is_right():
    share, chances = rules.fit({"1" * 9: 800, "0" * 5 + "1" * 4: 200})
    good = rules.posterior(share, chances, np.array([[1] * 9, [0] * 5 + [1] * 4]))
    assert good[0] > 0.9 and good[1] < 0.5


def test_lm_base_and_a_distribution_over_short_texts(spark, docs):
    found = {r["doc_id"]: r for r in lm.score(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    train = Counter()
    for i, t in enumerate(TEXTS):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            train.update([*words(lower(t)), None])
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(TEXTS):
        own = [*words(lower(t)), None]
        r = found[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and r["train_tokens"] == n
        assert r["n_tokens"] == len(own) and r["n_known"] == sum(train[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (n * 1.0 + v + 1)) for w in own), rel=1e-9) or r["base_score"] == pytest.approx(sum(np.log10((train[w] + 1) / (n + 1 * (v + 1))) for w in own), rel=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_forward_recursion_equals_the_sum_over_paths():
    rng = np.random.default_rng(1)
    model = lm.Model(rng.dirichlet(np.ones(lm.STATES)), rng.dirichlet(np.ones(lm.STATES), lm.STATES), rng.dirichlet(np.ones(lm.CLASSES), lm.STATES).T)
    rows = np.array([5, 9, 2])
    total = 0.0
    for a in range(lm.STATES):
        for b in range(lm.STATES):
            for c in range(lm.STATES):
                total += model.start[a] * model.emit[5, a] * model.move[a, b] * model.emit[9, b] * model.move[b, c] * model.emit[2, c]
    assert model.forward(rows, np.array([0]), np.array([3]))[0] == pytest.approx(np.log10(total))
    start, move, emit, likely = model.counts(rows, np.array([0]), np.array([3]))
    assert start.sum() == pytest.approx(1) and move.sum() == pytest.approx(2) and emit.sum() == pytest.approx(3) and likely == pytest.approx(np.log10(total))


def test_training_by_blocks_equals_whole_texts(monkeypatch):
    """Expected counts of texts cut into blocks against a plain forward-backward over whole texts."""
    monkeypatch.setattr(lm, "SEGMENT", 7)
    monkeypatch.setattr(lm, "STEP", 40)
    rng = np.random.default_rng(3)
    model = lm.Model(rng.dirichlet(np.ones(lm.STATES)), rng.dirichlet(np.ones(lm.STATES), lm.STATES), rng.dirichlet(np.ones(lm.CLASSES), lm.STATES).T)
    texts = [rng.integers(0, lm.CLASSES, n) for n in (1, 7, 8, 50, 3, 14, 29, 6)]
    start, move, emit, total = np.zeros(lm.STATES), np.zeros((lm.STATES, lm.STATES)), np.zeros((lm.CLASSES, lm.STATES)), 0.0
    for x in texts:
        alpha, beta = np.zeros((len(x), lm.STATES)), np.ones((len(x), lm.STATES))
        for t, c in enumerate(x):
            alpha[t] = (alpha[t - 1] @ model.move if t else model.start) * model.emit[c]
        for t in range(len(x) - 2, -1, -1):
            beta[t] = model.move @ (model.emit[x[t + 1]] * beta[t + 1])
        likely = alpha[-1].sum()
        start += alpha[0] * beta[0] / likely
        total += np.log10(likely)
        for t, c in enumerate(x):
            emit[c] += alpha[t] * beta[t] / likely
            if t:
                move += model.move * np.outer(alpha[t - 1], model.emit[c] * beta[t]) / likely
    found = lm.expected(pa.array([x.astype("<u2").tobytes() for x in texts], pa.binary()), model)
    for got, want in zip(found, (start, move, emit, total)):
        assert got == pytest.approx(want, rel=1e-8, abs=1e-12)


def test_lm_score_equals_a_plain_model(spark, docs, monkeypatch):
    """The whole score against plain dictionaries: classes, two rounds of training, the likelihood, words of shared classes. Few words are held by the tasks, the rest meets in the join."""
    monkeypatch.setattr(lm, "FREQUENT", 20)
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    found = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows), rounds=2).collect()}
    train = Counter(w for i, t in rows if not held(i) for w in words(lower(t)))
    every = Counter(w for _, t in rows for w in words(lower(t)))
    # counts as ``most_frequent`` documents them: told apart to one part in 64 of an octave
    step = lambda c: int(np.floor(np.log2(c) * 64))
    frequent = set()
    for n in sorted({step(c) for c in every.values()}, reverse=True):
        more = {w for w, c in every.items() if step(c) == n}
        if len(frequent) + len(more) > 20:
            # the bound is filled by a draw among the words of the step at its end
            tied = spark.createDataFrame([(w, train[w]) for w in more], "word string, c long").select("word", lm.F.xxhash64("word", "c", lm.F.lit(11)).alias("draw")).collect()
            frequent |= {r["word"] for r in sorted(tied, key=lambda r: r["draw"])[: 20 - len(frequent)]}
            break
        frequent |= more
    own = sorted((w.encode() for w in frequent if train[w]), key=lambda w: (-train[w.decode()], w))
    kind = {w: own.index(w.encode()) if w.encode() in own else lm.tail_class(w.encode()) for w in every}
    totals = np.ones(lm.TAILS)
    for w, c in train.items():
        if kind[w] >= lm.OWN:
            totals[kind[w] - lm.OWN] += c + 1
    seen = np.zeros(lm.CLASSES)
    seen[: len(own)] = [train[w.decode()] for w in own]
    seen[lm.OWN : lm.END], seen[lm.END] = totals, sum(not held(i) for i, _ in rows)
    model, texts = lm.Model.first(seen), {i: np.array([*[kind[w] for w in words(lower(t))], lm.END]) for i, t in rows}
    for _ in range(2):
        sums = [sum(x) for x in zip(*[model.counts(x, np.array([0]), np.array([len(x)])) for i, x in texts.items() if not held(i)])]
        model = lm.Model.of(*sums[:3], seen)
    for i, t in rows:
        shared = [w for w in words(lower(t)) if kind[w] >= lm.OWN]
        want = model.forward(texts[i], np.array([0]), np.array([len(texts[i])]))[0] + sum(np.log10(train[w] + 1) - np.log10(totals[kind[w] - lm.OWN]) for w in shared)
        assert found[i]["score"] == pytest.approx(want, rel=1e-7), i


def test_lm_of_no_rows_and_of_no_training_rows(docs):
    assert lm.score(docs.where("false")).count() == 0
    held = lm.score(docs.where(lm.fold(lm.F.col("doc_id"), 7) == 2)).collect()
    assert held and all(r["n_known"] == 0 and r["train_tokens"] == 0 and np.isfinite(r["score"]) for r in held)


@pytest.mark.parametrize("score", [toxicity.score, quality.score])
def test_classifiers_define_every_case(docs, labels, score):
    found = score(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert {r["score"] for r in score(docs, labels.where("false")).collect()} == {0.5}
    assert score(docs.where("false"), labels).count() == 0


def test_dictionaries_learn_from_whole_texts():
    rng = np.random.default_rng(2)
    words = lambda n: " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 6)) for _ in range(n))
    assert b"pasted tail of junk" in quality.dictionary([words(2000) + " pasted tail of junk" * 40 for _ in range(60)])
    assert b"pasted tail of junk" in quality.dictionary([words(20_000) + " pasted tail of junk" * 4000])


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    y = np.asarray(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


@pytest.mark.parametrize("name, label, least", [("op3_toxicity", "toxic", 0.8), ("op8_quality", "quality", 0.8)])
def test_held_out_accuracy(spark, name, label, least):
    folder = DATA.replace("0.001", "0.01")
    found = queries()[name](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where(f"{label} is not null").collect()
    assert auc([r[label] for r in found], [r["score"] for r in found]) >= least


def test_language_of_held_out_documents(spark, docs):
    folder = DATA.replace("0.001", "0.01")
    found = queries()["op5_language"](spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").where("lang is not null and n_chars > 40").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) >= 0.95
    mine = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert mine[0] == mine[1] == mine[2] == mine[11] == "und"
    assert language.identify(docs.where("false")).count() == 0
