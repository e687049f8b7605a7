"""Operators against brute force on small tables, and the awkward cases."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessaline.llm import bpe, chat, components, jaccard, mixing, mtree, pii, quality, sharding, substring_dedup, toxicity
from tessaline.llm.queries import QUERIES, TOKENIZER
from tessaline.llm.textkernel import prefix_sums, range_hash

from .helpers import AWKWARD, SCHEMA, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KEY = b"test key"


def near_copies(seed=3, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    docs = []
    for i in range(n):
        if docs and rng.random() < 0.6:
            w = list(rng.choice(docs)[1].split())
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        docs.append((i, " ".join(w)))
    return docs


def shingles(text, k):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def test_pii_on_a_percent_encoded_megabyte():
    began = time.perf_counter()
    text = "%20" * 350_000
    assert pii.replace_text(text, KEY) == (text, [])
    new, spans = pii.replace_text(text + " anna@example.org", KEY)
    assert len(spans) == 1 and new[: len(text)] == text
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_components(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard, "HOT_COUNT", 6)
    docs = near_copies() + [(900, None), (901, ""), (902, "one two"), (903, "One  two")]
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), k, percent).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("percent", [80, 85, 99, 100])
def test_linked_sets_are_in_the_same_or_the_next_size_class(spark, percent):
    from pyspark.sql import functions as F

    got = {r["n"]: r["c"] for r in spark.range(1, 3001).select(F.col("id").alias("n")).withColumn("c", jaccard._size_class(F.col("n"), percent)).collect()}
    for n, c in got.items():
        most = min(3000, 100 * n // percent)  # the largest set that one of n can link with
        assert all(0 <= got[m] - c <= 1 for m in range(n, most + 1))


def test_connected_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(25)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def sentences(text):
    """Sentences of a text as lists of lower-case words with their ends, by the module's rules said anew."""
    found, now = [], []
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    for i, (start, end) in enumerate(words):
        word = re.sub("[A-Z]", lambda m: m[0].lower(), text[start:end])
        now.append((word, start))
        bare = word[0] + word[1:].rstrip("\"')]")
        last = i + 1 == len(words) or "\n" in text[end : words[i + 1][0]]
        if last or bare[-1] in ".!?" or word == "|":
            found += [now] if len(now) <= substring_dedup.LONG_SENTENCE else run_on(now)
            now = []
    return found


def run_on(sentence):
    parts, now = [], []
    for word, start in sentence:
        raw = np.frombuffer(word.encode(), np.uint8)
        (h,) = range_hash(raw, prefix_sums(raw), np.array([0]), np.array([len(raw)]))
        now.append((word, start))
        if int(h) & substring_dedup.CUT_MASK == 0:
            parts.append(now)
            now = []
    return parts + [now] if now else parts


def deduped(rows):
    """(id, text, removed sentences) of every row, by trying every run."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    cut, seen, texts = collections.defaultdict(set), {}, {i: sentences(rows[i][1] or "") for i in range(len(rows))}
    for i in order:
        for a in range(len(texts[i])):
            for b in range(a + substring_dedup.MIN_SENTENCES, len(texts[i]) + 1):
                run = tuple(w for s in texts[i][a:b] for w, _ in s)
                if len(run) >= substring_dedup.MIN_WORDS:
                    if seen.setdefault(run, (i, a)) != (i, a):
                        cut[i] |= set(range(a, b))
                    break
    out = []
    for i, (doc_id, text) in enumerate(rows):
        if cut[i]:
            begins = [0, *(s[0][1] for s in texts[i][1:]), len(text)]
            text = "".join(text[begins[j] : begins[j + 1]] for j in range(len(texts[i])) if j not in cut[i])
        out.append((doc_id, text, len(texts[i]), len(cut[i]), sum(len(texts[i][j]) for j in cut[i])))
    return out


def prose(rng, n, end=0.15):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) + (rng.choice([".", "!", '."', "?)"]) if rng.random() < end else "") for _ in range(n))


@pytest.mark.parametrize("limit", [substring_dedup.FILTER_MAX_BYTES, 0])
def test_substring_dedup_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(substring_dedup, "FILTER_MAX_BYTES", limit)
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (70, 55, 120, 31)] + [prose(rng, 200, end=0), "the " * 90, "Item | " * 60]
    rows = []
    for i in range(80):
        parts = [prose(rng, rng.choice([5, 30, 60])) for _ in range(rng.randint(0, 3))] + rng.sample(passages, rng.choice([0, 1, 1, 2]))
        rng.shuffle(parts)
        rows.append((rng.choice([i, i, 7, None]), rng.choice([" ", "\n", "  \n "]).join(parts).title() if i % 9 == 0 else " ".join(parts)))
    rows += [(100, None), (101, ""), (102, " \n"), rows[0], rows[0], (None, rows[1][1]), (None, rows[1][1]), (103, passages[0]), (103, passages[1] + "\n" + prose(rng, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, substring_dedup.dedup(df).collect()), key=key)
    want = sorted(deduped(rows), key=key)
    assert got == want and sum(r[3] > 0 for r in want) > 20


def test_substring_dedup_keeps_first_places_where_ids_repeat(spark):
    rng = random.Random(3)
    p, a, b = (prose(rng, 80) for _ in range(3))
    rows = [(1, p), (5, p + "\n" + a), (5, b + "\n" + prose(rng, 40)), (7, prose(rng, 40) + "\n" + b), (None, a), (None, a)]
    left = " ".join(r["text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect())
    for passage in (p, a, b):
        inner = " ".join(passage.split()[5:-5])
        assert left.count(inner) == 1


def test_substring_dedup_finds_passages_that_begin_and_end_within_long_sentences(spark):
    rng = random.Random(4)
    said = lambda n, length: " ".join(prose(rng, 1, end=0) + ("." if (i + 1) % length == 0 else "") for i in range(n))
    passages = [said(51, length) for length in (13, 17, 24, 35, 60) for _ in range(20)]
    rows = [(2 * i + k, " ".join([said(33, 19), p, said(37, 23)])) for i, p in enumerate(passages) for k in (0, 1)]
    rows += [(1000 + i, said(120, 21)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    cut = {r["doc_id"]: r["removed_words"] for r in substring_dedup.dedup(df, passage=50).collect() if r["n_removed"]}
    assert len(cut) >= 0.95 * len(passages) and all(i % 2 and i < 1000 and cut[i] <= 51 for i in cut)
    assert len([1 for r in substring_dedup.dedup(df).collect() if r["n_removed"]]) < 0.7 * len(passages)  # by sentences of 40 words
    with pytest.raises(ValueError):
        substring_dedup.dedup(df, passage=substring_dedup.MIN_WORDS)


def test_substring_dedup_of_passages_by_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    passages = [prose(rng, n, end=0.04) for n in (51, 60, 80)]
    rows = [(i, " ".join([prose(rng, 30, end=0.05), rng.choice(passages), prose(rng, 30, end=0.05)])) for i in range(40)]
    got = sorted(map(tuple, substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), passage=50).collect()))
    monkeypatch.setattr(substring_dedup, "LONG_SENTENCE", substring_dedup.longest_sentence(50))
    assert got == sorted(deduped(rows)) and sum(r[3] > 0 for r in got) > 30


def best(q, vectors, own, k=5):
    scores = sorted((-int(np.dot(q, v)), i) for j, (i, v) in enumerate(vectors) if j != own and len(v) == len(q))
    return [(-s, i) for s, i in scores[:k]]


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_ROWS", 40)
    monkeypatch.setattr(mtree, "PAGE", 4)
    monkeypatch.setattr(mtree, "QUERY_ROWS", 3)
    monkeypatch.setattr(mtree, "ROOT_BYTES", 400)  # several rounds of routing
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 8)).astype(np.float32) * 0.3
    x[100:180] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(400)] + [(1000, None), (1001, [1.0, None] + [0.0] * 6), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8), (None, [0.0] * 8), (1050, [0.5])]
    rows += [(50, [float(v) for v in x[51]]), (50, [float(v) for v in x[50]]), (7, [float(v) for v in x[7]]), (1100, []), (1101, []), (1150, [0.25, 0.5]), (1151, [1.0, 1.0])]
    usable = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = sorted((i, rank, j, s) for at, (i, q) in enumerate(usable) if i % 50 == 0 for rank, (s, j) in enumerate(best(q, usable, at), 1))
    got = sorted(map(tuple, mtree.top_k(mtree.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)), F.col("vec_id") % 50 == 0).collect()))
    assert got == want and not any(r[0] == 1050 for r in got)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert mtree.top_k(mtree.quantized(none), F.col("vec_id") % 50 == 0).collect() == []


def test_long_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=4) * 10.0 ** rng.integers(0, 7)]) for i in range(120)]
    usable = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v in rows]
    want = sorted((i, rank, j, s) for at, (i, q) in enumerate(usable) if i % 50 == 0 for rank, (s, j) in enumerate(best(q, usable, at), 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, mtree.top_k(mtree.quantized(df), F.col("vec_id") % 50 == 0).collect())) == want
    huge = spark.createDataFrame([(1, [1e9, 1.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="vector 1 is too long"):
        mtree.top_k(mtree.quantized(huge), F.col("vec_id") % 50 == 0).collect()


def test_mtree_skips_exactly():
    rng = np.random.default_rng(1)
    low = rng.integers(-40, 40, (5000, 3))
    centres = rng.normal(size=(30, 32))
    close = np.floor(256 * (centres[rng.integers(0, 30, 5000)] + 0.1 * rng.normal(size=(5000, 32)))).astype(np.int64)
    for x, most in ((low, 0.2), (close, 0.2)):
        ids = np.arange(5000)
        tree = mtree.MTree.from_bytes(mtree.MTree(ids, ids, x).to_bytes())
        for i in range(0, 200, 10):
            want = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
            assert tree.search(x[i], i, 5) == [(-a, b) for a, b in want]
            assert tree.search(x[i], i, 5, floor=-want[2][0]) == [(-a, b) for a, b in want if a <= want[2][0]]
        # Members and routing vectors to which a distance was computed, of all members.
        assert (tree.members + tree.routed) / 40 < most * 5000


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        seen = [pii.feistel(v, size, KEY, b"t") for v in range(size)]
        assert sorted(seen) == list(range(size)) and all(pii.feistel(s, size, KEY, b"t", back=True) == v for v, s in enumerate(seen))


def test_pii_round_trip_and_formats(spark):
    values = {"email": "Ann.B7@Mail.example.COM", "ip": "10.20.30.40", "card": "4111 1111 1111 1111", "phone": "+1 (212) 555-0123", "ssn": "123-45-6789", "date": "1999-12-31", "iban": "DE89370400440532013000", "secret": "0f" * 20}
    for kind, v in values.items():
        new = pii.KINDS[kind](v, KEY)
        assert new != v and re.sub("[a-z0-9A-Z]+", "", new) == re.sub("[a-z0-9A-Z]+", "", v)
        assert pii.KINDS[kind](new, KEY, back=True) == v
    clean = "Call 12 of 2024.1, version 2.0. and 4111111111111112 or 300.1.1.1; 2023-02-30 stays"
    text = f"Mail {values['email']} or {values['ip']}, card 4111111111111111, token = \"{values['secret']}\"."
    rows = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame([(1, text), (2, clean), (3, None), (4, "")], "doc_id long, text string"), KEY).collect()}
    assert rows[2]["text"] == clean and rows[3]["text"] is None and rows[4]["n_pii"] == 0
    assert rows[1]["n_pii"] == 4 and all(v not in rows[1]["text"] for v in (values["email"], values["ip"], values["secret"], "4111111111111111"))


def test_pii_in_digits_of_other_scripts(spark):
    zeros = {"arabic": 0x660, "persian": 0x6F0, "devanagari": 0x966, "fullwidth": 0xFF10, "mathematical": 0x1D7CE}
    values = ["+1 (212) 555-0123", "123-45-6789", "4111 1111 1111 1111", "1999-12-31", "10.20.30.40", "DE89370400440532013000", "ann.b7@mail.example.com"]
    rows, plain = [], pii.replace_text("; ".join(values) + " in 2024", KEY)[0]
    for n, zero in enumerate(zeros.values()):
        write = lambda text, zero=zero: "".join(chr(zero + int(c)) if c in "0123456789" else c for c in text)
        rows.append((n, write("; ".join(values) + " in 2024"), write(plain)))
        rows.append((100 + n, "x@y " + write("123-45-6789") + " in 2024", "x@y " + write(pii.KINDS["ssn"]("123-45-6789", KEY)) + " in 2024"))
    got = {r["doc_id"]: r for r in pii.pseudonymize(spark.createDataFrame([r[:2] for r in rows] + [(999, "² ½ ٣ 12 ٤٥")], "doc_id long, text string"), KEY).collect()}
    for n, text, want in rows:
        assert got[n]["text"] == want and got[n]["n_pii"] == (len(values) if n < 100 else 1)
        assert pii.replace_text(want, KEY, back=True)[0] == text
    assert got[999]["n_pii"] == 0


def test_pii_key_comes_from_the_session(spark):
    spark.conf.set(pii.KEY_SETTING, "0a" * 16)
    try:
        assert pii.session_key(spark) == bytes([10] * 16)
        spark.conf.unset(pii.KEY_SETTING)
        assert len(pii.session_key(spark)) == 32 and pii.session_key(spark) == pii.session_key(spark)
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_pii_beside_other_groups():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    kept = {"card": (card, "4111111111111111", "4111-1111-1111-1111", "3782 822463 10005"), "iban": (iban, "BE68539007547034", "NO93 8601 1117 947")}
    around = {
        "card": ("{} 123", "{} 12/25", "7 {}", "99 99 {}", "{} 1234 5678 9012", "2023-02-30 {}", "000-12-3456 {}", "{} {}"),
        "iban": ("{} EUR", "{} PAID", "{} PAID BY ME 12 EUR", "EU12 {}", "{} {}", "SWIFT AB12 {} NOW"),
    }
    for kind, values in kept.items():
        for value in values:
            new = pii.KINDS[kind](value, KEY)
            for frame in around[kind]:
                text, spans = pii.replace_text(frame.format(value, value), KEY)
                assert value not in text, (frame, value)
                assert all(k == kind for *_, k in spans)
                assert text == frame.format(new, new) or kind == "card" and value.count(" ") + value.count("-") != 3, (frame, text)
    # No chance hit leaves a part of a usual card, and a stretch without a valid window stays.
    rng = random.Random(5)
    for _ in range(300):
        lead = " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(1, 4)))
        assert pii.KINDS["card"](card, KEY) in pii.replace_text(f"{lead} {card}", KEY)[0]
    assert pii.replace_text("1 4111 1111 1111 111 BE68 5390 0754 7035 EUR", KEY)[1] == []
    many = " ".join(str(rng.randint(0, 9)) for _ in range(3000))
    text, spans = pii.replace_text(many, KEY)
    assert len(text) == len(many) and all(k == "card" for *_, k in spans)


def test_quality_counts(spark):
    got = [tuple(r[c] for c in quality.COUNTS) for r in quality.features(awkward(spark).coalesce(1)).collect()]
    want = []
    for _, t, *_ in AWKWARD:
        t = t or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
        want.append((len(w), sum(map(len, w)), sum(t.count(c) for c in quality.SYMBOLS), dup, len(covered)))
    assert got == want
    verdicts = quality.judge(awkward(spark))
    assert verdicts.count() == len(AWKWARD) and verdicts.filter("kept and base_failed").count() == 0
    assert quality.judge(empty(spark)).count() == 0


def test_hosts_are_shrunk(spark):
    rows = [("bad", True)] * 95 + [("bad", False)] * 5 + [("good", False)] * 100 + [("tiny", True)]
    judge = lambda rows: {r["host"]: r for r in quality.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    got = judge(rows)
    assert not got["bad"]["host_kept"] and got["good"]["host_kept"] and got["tiny"]["host_kept"] and got["tiny"]["host_rate"] < 1
    # Twenty hosts that fail about alike are kept, one that fails three times as often isn't, whatever its share of the rows.
    many = [(f"h{i}", j < 8 + i % 5) for i in range(20) for j in range(100)]
    assert all(r["host_kept"] for r in judge(many).values())
    for n in (100, 3000):
        got = judge(many + [("worse", j % 10 < 4) for j in range(n)])
        assert [h for h, r in got.items() if not r["host_kept"]] == ["worse"]
    assert judge([("one", True)] * 50)["one"]["host_kept"] and judge([(None, True)] * 80 + [("b", False)] * 90)[None]["host_kept"] is False


def test_toxicity(spark):
    rng = random.Random(4)
    bad, good = ["vileword", "nastyterm", "grimname"], ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        docs.append((i, " ".join(rng.choice(good) for _ in range(40)) + (" " + " ".join(rng.choice(bad) for _ in range(3)) if toxic else "")))
        labels.append((i, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "vileword")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(5, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, known)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(len(r["evidence"]) == toxicity.NEIGHBOURS for i, r in got.items() if i not in (None, 1000, 1001))
    bins = toxicity.reliability(toxicity.score(df, model), known).collect()
    assert sum(r["n"] for r in bins) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in labels) and all(abs(r["mean_score"] - r["toxic_rate"]) < 0.15 for r in bins)
    assert all(got[i]["predicted"] == y for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1000]["score"] == got[1001]["score"] < 0.5
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(df, none).collect()} == {0.5}


def test_toxicity_without_marking_words(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    fit_ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    common = [word() for _ in range(30)]
    text = {i: " ".join([rng.choice(common) for _ in range(10)] + [word() for _ in range(20)]) for i in fit_ids}
    # Every example's own words are in no other one; copies of examples find them.
    toxic = {i: int(i % 8 == 0) for i in fit_ids}
    docs = [(i, x) for i, x in text.items()] + [(1000 + i, x) for i, x in text.items()]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.fit(df, spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int"))).collect()}
    for i in fit_ids:
        assert got[1000 + i]["predicted"] == toxic[i]
        assert got[1000 + i]["evidence"][0]["example_id"] == i and abs(got[1000 + i]["evidence"][0]["cosine"] - 1) < 1e-6
    # Most examples may be toxic: words mark either side.
    for share in (4, 6, 9):
        kind = {i: int(i % 10 < share) for i in range(300)}
        docs = [(i, " ".join([rng.choice(common) for _ in range(20)] + ["vileword" if y else "kindword"] * (i % 3 + 1))) for i, y in kind.items()]
        df = spark.createDataFrame(docs, "doc_id long, text string")
        labels = spark.createDataFrame(list(kind.items()), "doc_id long, toxic int")
        assert {r["doc_id"]: r["predicted"] for r in toxicity.score(df, toxicity.fit(df, labels)).collect()} == kind


def test_block_max_search_is_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    rng = np.random.default_rng(2)
    n, t = 500, 60
    pairs = np.unique(rng.integers(0, n, 3000) * t + (rng.integers(0, t, 3000) * rng.random(3000)).astype(np.int64))
    example, term, tf = pairs // t, pairs % t, rng.integers(1, 4, len(pairs))
    terms, weight = np.sort(rng.integers(1, 2**62, t).astype(np.uint64)), rng.random(t) ** 3 * 20 + 0.1
    m = toxicity.Model(terms, weight, np.arange(n), np.zeros(n, np.int64), example, term, tf, 0.1, 0.1).prepare()
    assert 0 < len(m.dense) < t
    vectors = np.zeros((n, t))
    vectors[example, term] = (1 + np.log(tf)) * weight[term]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)[:, None]
    rows, q_terms = np.divmod(np.unique(rng.integers(0, 40, 200) * t + rng.integers(0, t, 200)), t)
    f = rng.integers(1, 4, len(rows))
    q = np.zeros((41, t))
    q[rows, q_terms] = (1 + np.log(f)) * weight[q_terms]
    q /= np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None]
    for row, near in enumerate(m.nearest(rows, q_terms, f, 41)):
        cosines = np.round(vectors @ q[row], toxicity.DECIMALS)[m.ids]
        want = sorted((-c, i) for i, c in enumerate(cosines) if c > 0)[: toxicity.NEIGHBOURS]
        assert near == [(-c, i) for c, i in want]


def test_block_max_search_of_common_words_only():
    # Every word is in every example, so that no list is read.
    example, term = np.repeat(np.arange(200), 3), np.tile(np.arange(3), 200)
    tf = np.random.default_rng(5).integers(1, 9, 600)
    m = toxicity.Model(np.arange(1, 4).astype(np.uint64), np.array([1.0, 2.0, 0.5]), np.arange(200), np.zeros(200, np.int64), example, term, tf, 0.1, 0.1).prepare()
    assert len(m.dense) == 3
    vectors = ((1 + np.log(tf)) * np.array([1.0, 2.0, 0.5])[term]).reshape(200, 3)
    vectors /= np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    q = np.array([1.0, 2.0, 0.0]) * (1 + np.log([1, 4, 1]))
    cosines = np.round(vectors @ (q / np.sqrt((q**2).sum())), toxicity.DECIMALS)[m.ids]
    assert m.nearest(np.array([0, 0]), np.array([0, 1]), np.array([1, 4]), 1)[0] == [(-c, i) for c, i in sorted((-c, i) for i, c in enumerate(cosines))[: toxicity.NEIGHBOURS]]


@pytest.mark.parametrize("columns", [0, 1 << 20])
def test_votes_by_brute_force(spark, monkeypatch, columns):
    """Scores and evidence from all cosines of a small corpus, with and without columns of their own for common words."""
    monkeypatch.setattr(toxicity, "COLUMN_BYTES", columns)
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    rng = random.Random(12)
    docs = [(i, " ".join("".join(rng.choice("abcde") for _ in range(rng.choice([1, 2, 4]))) for _ in range(rng.randint(0, 12)))) for i in range(120)]
    labels = {i: rng.randint(0, 1) for i in range(120) if zlib.crc32(str(i).encode()) % 5}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.fit(df, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    counts = {i: collections.Counter(t.split()) for i, t in docs}
    fitted = {i: counts[i] for i in labels}
    n, p = len(fitted), sum(labels.values()) / len(fitted)
    seen = collections.Counter(w for c in fitted.values() for w in c)
    marked = collections.Counter(w for i, c in fitted.items() if labels[i] for w in c)
    weight = {w: (np.log((1 + n) / (1 + c)) + 1) * (toxicity.LEAST_WEIGHT + (marked[w] - c * p) ** 2 / (c * p * (1 - p))) for w, c in seen.items()}

    def vector(c):
        v = {w: (1 + np.log(k)) * weight[w] for w, k in c.items() if w in weight}
        length = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / length for w, x in v.items()}

    vectors = {i: vector(c) for i, c in fitted.items() if c}
    empties = [labels[i] for i, c in fitted.items() if not c]
    for r in toxicity.score(df, model).collect():
        v = vector(counts[r["doc_id"]])
        cosines = {i: sum(x * u.get(w, 0.0) for w, x in v.items()) for i, u in vectors.items()}
        best = sorted((c for c in cosines.values() if c > 1e-9), reverse=True)[: toxicity.NEIGHBOURS]
        near = [(e["cosine"], e["example_id"]) for e in r["evidence"]]
        assert np.allclose([c for c, _ in near], best) and all(abs(cosines[i] - c) < 1e-6 for c, i in near)
        votes = [1 / (toxicity.NEAR + max(0.0, 1 - c)) for c, _ in near]
        want = (p + sum(w * labels[i] for w, (_, i) in zip(votes, near))) / (1 + sum(votes)) if near else (sum(empties) + p) / (len(empties) + 1)
        assert abs(r["score"] - want) < 1e-6


def test_toxicity_sample_fits_its_bounds(spark, monkeypatch):
    """A huge labelled text is left out, not what is drawn after it; the index keeps its bytes."""
    docs = [(i, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}{chr(97 + i % 26)}" for k in range(5000 if i == 1 else 20)) + (" vile" if i % 2 else " kind")) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    fitted = {i for i in range(60) if zlib.crc32(str(i).encode()) % 5}
    assert 1 in fitted
    for name, value in (("SAMPLE_TERMS", 1500), ("INDEX_BYTES", 45_000)):
        with monkeypatch.context() as m:
            m.setattr(toxicity, name, value)
            model = toxicity.fit(df, labels)
        assert set(model.ids.tolist()) == fitted - {1}
        assert model.n_bytes <= 1.1 * 45_000
        assert all(r["predicted"] == r["doc_id"] % 2 for r in toxicity.score(df, model).collect())


def test_toxicity_fit_by_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdéfg") for _ in range(3))
    docs = [(i, " ".join(word().title() for _ in range(rng.randint(0, 30)))) for i in range(150)] + [(3, "aaa bbb"), (200, None)]
    labels = [(i, rng.randint(0, 1)) for i in range(0, 150, 2)] + [(4, 1), (200, 0), (999, 1)]
    model = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int"))
    toxic = {}
    for i, y in labels:
        toxic[i] = max(y, toxic.get(i, 0))
    texts = {i: re.findall("[^ ]+", (t or "").lower()) for i, t in docs if i in toxic and zlib.crc32(str(i).encode()) % 5}
    n, p = len(texts), sum(toxic[i] for i in texts) / len(texts)
    seen = collections.Counter(w for t in texts.values() for w in set(t))
    marked = collections.Counter(w for i, t in texts.items() if toxic[i] for w in set(t))
    weight = {w: (np.log((1 + n) / (1 + c)) + 1) * (toxicity.LEAST_WEIGHT + (marked[w] - c * p) ** 2 / (c * p * (1 - p))) for w, c in seen.items()}
    assert len(model.terms) == len(seen) and sorted(model.ids.tolist()) == sorted(i for i, t in texts.items() if t)
    assert np.allclose(np.sort(model.weight), sorted(weight.values())) and model.base_rate == p


def test_minimax_cuts():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [rng.choice([0, 1, rng.randint(0, 20)]) for _ in range(rng.randint(1, 12))]
        k = rng.randint(1, 5)

        def smallest(i, left):
            if left == 0:
                return 0 if i == len(sizes) else 10**9
            return min(max(sum(sizes[i:j]), smallest(j, left - 1)) for j in range(i, len(sizes) + 1))

        capacity, ends = sharding.minimax_capacity(sizes, k), sharding.balanced_cuts(sizes, k)
        assert capacity == smallest(0, k) and len(ends) == k and ends[-1] == len(sizes) and ends == sorted(ends)
        assert all(sum(sizes[a:b]) <= capacity for a, b in zip([0, *ends], ends))


def test_units_are_divided_until_no_cut_can_fall_inside():
    rng = random.Random(1)
    top = sharding.HASH_BITS
    for _ in range(300):
        n, shards = rng.randint(1, 50), rng.randint(1, 6)
        groups = sorted((rng.getrandbits(8) << (top - 8) if rng.random() < 0.5 else rng.getrandbits(top), rng.choice([1, 5, rng.randint(1, 100)])) for _ in range(n))
        groups = sorted(dict(groups).items())

        def sized(ranges):
            sums = {}
            for start, bits, more in ranges:
                for h, s in groups:
                    if start <= h < start + (1 << (top - bits)):
                        key = (h >> (top - min(top, bits + more))) << (top - min(top, bits + more)), min(top, bits + more)
                        sums.setdefault(key, []).append(s)
            return [sharding.Unit(start, bits, sum(s), len(s) == 1) for (start, bits), s in sums.items()]

        units = sorted(sized([(0, 0, 3)]))
        while found := sharding.undecided(units, shards):
            divided = sized([(units[i].start, units[i].bits, 2) for i in found])
            units = sorted([u for i, u in enumerate(units) if i not in found] + divided)
        assert sharding.minimax_capacity([u.bytes for u in units], shards) == sharding.minimax_capacity([s for _, s in groups], shards)


def test_shards_are_the_smallest_for_whole_groups(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BIN_BITS", 4)
    monkeypatch.setattr(sharding, "DIVIDED_UNITS", 32)
    monkeypatch.setattr(sharding, "REPEATS", 50)
    rng = random.Random(5)
    docs = [(i, f"{i % 170} " + "x" * rng.randint(0, 60)) for i in range(400)] + [(None, "same")] * 120 + [(7, "same")] * 3 + [(None, None), (None, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hashes = {r["text"]: r["h"] % (1 << 64) for r in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    size = collections.Counter()
    for _, t in docs:
        size[hashes[t or ""]] += len(t or "") + 8
    ordered = [size[h] for h in sorted(size)]
    ends = sharding.balanced_cuts(ordered, 6)
    want = [sum(ordered[a:b]) for a, b in zip([0, *ends], ends)]
    rows = sharding.shard_by_bytes(df, 6).collect()
    got = collections.Counter()
    for r in rows:
        got[r["shard"]] += r["size"]
    assert [got[i] for i in range(6)] == want and len(rows) == len(docs)
    for shard in range(6):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sum(r["doc_id"] is None for r in rows) == 122


def test_sharding(spark):
    docs = spark.createDataFrame([(i, f"text {i % 700} " + "x" * (i % 13)) for i in range(2000)] + [(None, None), (1, None), (1, "")], "doc_id long, text string")
    rows = sharding.shard_by_bytes(docs, 8).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert len(rows) == 2003 and all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in by.values())
    shard_of = collections.defaultdict(set)
    for r in rows:
        shard_of[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    sums = [sum(r["size"] for r in s) for s in by.values()]
    assert len(by) == 8 and max(sums) < 1.2 * sum(sums) / 8
    assert sharding.shard_by_bytes(awkward(spark), 4).count() == len(AWKWARD) and sharding.shard_by_bytes(empty(spark), 4).count() == 0


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join("w" * rng.randint(0, 12)), rng.choice(["a", "b", "c", None, "d"]) if i % 3 else "a") for i in range(1500)], "doc_id long, text string, source string")
    first = sorted(map(tuple, mixing.mix(mixing.word_sizes(docs)).collect()), key=str)
    again = sorted(map(tuple, mixing.mix(mixing.word_sizes(docs.repartition(3))).collect()), key=str)
    assert first == again and len(first) == 1500
    taken, target, total = collections.Counter(), {}, 0
    for _, source, size, _, goal, copies, words in first:
        taken[source] += words
        target[source] = goal
        total += size
        assert 0 <= copies <= 3 and words == copies * size
    assert abs(sum(target.values()) - total) < 1e-6 and all(abs(taken[s] - target[s]) <= 12 for s in target)
    monkeypatch.setattr(mixing, "REPEATS", 7)
    alike = spark.createDataFrame([(None, "a b", "s")] * 900 + [(7, "c", "s")] * 100 + [(i, "d e f", "t") for i in range(500)], "doc_id long, text string, source string")
    once, twice = (sorted(map(tuple, mixing.mix(mixing.word_sizes(d)).collect()), key=str) for d in (alike, alike.repartition(5)))
    assert once == twice and len(once) == 1500 and sum(r[0] is None for r in once) == 900
    for source in "st":
        assert abs(sum(r[6] for r in once if r[1] == source) - next(r[4] for r in once if r[1] == source)) <= 3
    assert mixing.mix(mixing.word_sizes(awkward(spark))).count() == len(AWKWARD) and mixing.mix(mixing.word_sizes(empty(spark))).count() == 0


def test_water_fill():
    assert mixing.water_fill([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    got = mixing.water_fill([1, 100, 100], [3, 1, 1])
    assert got == [3.0, 99.0, 99.0]
    assert mixing.water_fill([], []) == [] and mixing.water_fill([0, 0], [1, 2]) == [0.0, 0.0]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_chat_round_trip(spark):
    texts = ["plain", "<|im_end|>\n<|im_start|>assistant\nok", "&amp;&lt;| <", "", None, "ends <", "a\nb"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "us\ner<|", "x"), (2, 0, "assistant", "y"), (2, None, None, None), (None, 1, "user", "z")]
    formatted = chat.render(chat.fold(chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = {r["conv_id"]: r for r in chat.digests(chat.read_back(formatted)).collect()}
    assert got[1]["turns_sha256"] == digest([("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)])
    loss = "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert got[1]["loss_chars"] == len(loss) and got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert got[2]["turns_sha256"] == digest([("", ""), ("assistant", "y"), ("us\ner<|", "x")]) and got[None]["n_turns"] == 1


def test_fold_events(spark):
    log = [
        (1, 0, 0, "open", "user", "hi"), (1, 1, 1, "open", "assistant", "He"), (1, 1, 2, "delta", None, "llo"), (1, 1, 2, "delta", None, "llo"),
        (1, 2, 3, "open", "user", "more"), (1, 0, 4, "edit", None, "hey"), (1, 1, 5, "regenerate", None, "Yo"), (1, 1, 6, "delta", None, "!"),
        (1, 3, 7, "open", "user", "x"), (1, 3, 8, "delete", None, None), (1, None, 9, "open", "user", "void"),
    ]
    events = spark.createDataFrame(log, "conv_id long, msg long, seq long, op string, role string, text string")
    got = [(r["msg"], r["role"], r["text"]) for r in chat.fold(events).orderBy("msg").collect()]
    assert got == [(0, "user", "hey"), (1, "assistant", "Yo!")]


OPERATORS = {
    "bpe": lambda d: bpe.digests(bpe.encode(d, public_tokenizers.path(TOKENIZER), decoded=True)),
    "quality": quality.judge,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, d.sparkSession.createDataFrame([(1, 1), (6, 0), (8, 0), (9, 1), (7, 0)], "doc_id long, toxic int"))),
    "substring": substring_dedup.dedup,
    "jaccard": lambda d: jaccard.jaccard_components(d).drop("node", "component"),
    "pii": lambda d: pii.pseudonymize(d, KEY),
    "sharding": lambda d: sharding.shard_by_bytes(d, 3),
    "mixing": lambda d: mixing.mix(mixing.word_sizes(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_and_awkward_rows(spark, name):
    op = OPERATORS[name]
    plain, clashing = (sorted(map(repr, op(awkward(spark, extra=extra)).collect())) for extra in (False, True))
    assert plain == clashing and len(plain) == len(AWKWARD)
    assert op(empty(spark)).count() == 0
    gone = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    assert op(gone).count() == 3


def test_clashing_columns_of_logs_and_vectors(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b" * 700), (2, 0, "assistant", "c"), (2, 0, "assistant", "c"), (3, 0, "assistant", None)]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = log
    for name in ("msg", "seq", "op", "k", "block", "at", "loss", "formatted", "col"):
        more = more.withColumn(name, F.lit("clash"))
    done = [sorted(map(tuple, chat.digests(chat.read_back(chat.render(chat.fold(chat.conversation_events(d))))).collect())) for d in (log, more)]
    assert done[0] == done[1] and [r[1] for r in done[0]] == [2, 2, 1]
    assert chat.render(chat.fold(chat.conversation_events(log.limit(0)))).count() == 0
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(0, 200, 10)], "vec_id long, embedding array<double>")
    more = vectors
    for name in ("v", "dims", "tree", "row", "score", "rank", "floor", "stored", "route"):
        more = more.withColumn(name, F.lit("clash"))
    found = [sorted(map(tuple, mtree.top_k(mtree.quantized(d), F.col("vec_id") % 50 == 0).collect())) for d in (vectors, more)]
    assert found[0] == found[1] and len(found[0]) == 20


def test_a_log_of_finished_turns_has_all_kinds_of_events(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "x" * (chat.DELTA_CHARS + 1)), (1, 2, "assistant", "")]
    log = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("seq").collect()
    assert [r["op"] for r in log] == ["open", "edit", "regenerate", "delta", "delta", "regenerate"]


def test_queries_have_the_contracts_columns(spark):
    columns = {
        "op1_bpe": ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), "op4_toxicity": ("doc_id", "held_out", "score", "predicted"),
        "op9_sharding": ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"), "op10_mixing": ("doc_id", "size", "source_size", "target", "taken"),
    }
    for name, wanted in columns.items():
        assert set(wanted) <= set(QUERIES[name](spark, "/root/testdata/sf0.001").columns)
