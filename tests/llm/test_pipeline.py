"""Every stage of the pipeline, on what its predecessor kept, against a plain version."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tessaline.llm import mixing, pii, toxicity
from tessaline.llm.common import materialize
from tessaline.llm.queries import TOKENIZER
from tessaline.llm.textkernel import chunks

from .helpers import SCHEMA, awkward, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """Rows before and after each stage, and the folder of the tables."""
    sf_dir = str(tmp_path_factory.mktemp("tables"))
    odd = awkward(spark, extra=False).withColumn("doc_id", F.col("doc_id") + 10_000_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*corpus_pipeline.COLUMNS).unionByName(odd)
    docs.write.parquet(f"{sf_dir}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf_dir}/labels.parquet")
    seen, docs = {}, spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, sf_dir), f"test-{name}")
        seen[name] = [tuple(r) for r in docs.collect()], [tuple(r) for r in after.collect()], after.columns
        docs = after
    return seen, sf_dir


def test_toxicity_stage(spark, passed):
    before, after, columns = passed[0]["toxicity"]
    assert tuple(columns) == corpus_pipeline.COLUMNS
    docs = spark.createDataFrame(before, SCHEMA)
    model = toxicity.fit(docs, spark.read.parquet(f"{passed[1]}/labels.parquet"))
    dense = np.zeros((len(model.ids), len(model.terms)))
    for t in range(len(model.terms)):
        at = slice(model.post_start[t], model.post_start[t + 1])
        dense[model.post_example[at], t] = model.post_value[at]
    kept = []
    model.prepare()
    for row in before:
        (c,) = chunks(pa.array([(row[1] or "").lower()]))
        _, terms, tf = model.counts(c)
        score = model.empty_rate
        if len(terms):
            q = np.zeros(len(model.terms))
            q[terms] = (1 + np.log(tf)) * model.weight[terms]
            cosines = dense @ (q / np.linalg.norm(q))
            near = sorted((-round(x, toxicity.DECIMALS), i) for i, x in enumerate(cosines) if x > 0)[: toxicity.NEIGHBOURS]
            weights = [1 / (toxicity.NEAR + max(0.0, 1 + x)) for x, _ in near]
            votes = sum(w * model.labels[i] for w, (_, i) in zip(weights, near))
            score = (toxicity.PRIOR_VOTES * model.base_rate + votes) / (toxicity.PRIOR_VOTES + sum(weights))
        if score < 0.5:
            kept.append(row)
    assert Counter(after) == Counter(kept)


def test_near_duplicate_stage(passed):
    before, after, _ = passed[0]["ngram_jaccard"]
    sets = []
    for row in before:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), row[1] or "")
        w = WORD.findall(text)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(before)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[find(i)] = find(j)
    members = defaultdict(list)
    for i, row in enumerate(before):
        members[find(i)].append(row)
    kept = []
    for rows in members.values():
        known = [r for r in rows if r[0] is not None]
        kept += [r for r in rows if r[0] is None]
        if known:
            kept.append(min(known, key=lambda r: r[0]))
    assert Counter(after) == Counter(kept)
    assert len(kept) < len(before)


def test_near_duplicates_by_row(spark):
    a, b, c = ("a1 a2 a3 a4 a5 a6 a7", "b1 b2 b3 b4 b5 b6 b7", "c1 c2 c3 c4 c5 c6 c7")
    rows = [(1, a), (2, a), (2, b), (3, c), (3, "d e f g h i"), (None, c), (None, "n o p q r s"), (None, "N o p q r s"), (4, ""), (4, ""), (4, "x y"), (4, "x y")]
    docs = spark.createDataFrame([(i, t, "en", f"s{n}", 1) for n, (i, t) in enumerate(rows)], SCHEMA)
    after = Counter((r[0], r[1].lower()) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert after == Counter([(1, a), (2, b), (3, c), (3, "d e f g h i"), (None, "n o p q r s"), (4, ""), (4, ""), (4, "x y")])


def test_pii_stage(spark, passed):
    before, after, _ = passed[0]["pii"]
    expected = []
    for doc_id, text, lang, source, _ in before:
        new = None if text is None else pii.replace_text(text, pii.session_key(spark))[0]
        expected.append((doc_id, new, lang, source, None if new is None else len(new)))
    assert Counter(after) == Counter(expected)
    assert Counter(r[1] for r in after) != Counter(r[1] for r in before)


def test_mixing_stage(passed):
    before, after, _ = passed[0]["mixing"]
    words = lambda row: len(WORD.findall(row[1] or ""))
    sizes, largest, taken = Counter(), Counter(), Counter()
    for row in before:
        sizes[row[3]] += words(row)
        largest[row[3]] = max(largest[row[3]], words(row))
    for row in after:
        taken[row[3]] += words(row)
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([sizes[s] for s in sources], [1 + i % 3 for i in range(len(sources))])
    for s, target in zip(sources, targets):
        assert abs(taken[s] - target) <= largest[s]
    counts, had = Counter(after), Counter(before)
    assert set(counts) <= set(had)
    assert all(n <= 3 * had[row] for row, n in counts.items())


def test_mixing_gives_rows_of_one_id_their_own_copies(spark):
    rows = [(None, f"w{i} b c", "en", "s", 7) for i in range(300)] + [(7, "x " * (1 + i % 5), "en", "t", 9) for i in range(300)] + [(i, "d e f g", "en", "u", 7) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    after = [tuple(r) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    words = lambda r: len(WORD.findall(r[1]))
    sizes = [sum(words(r) for r in rows if r[3] == s) for s in "stu"]
    for s, target in zip("stu", mixing.water_fill(sizes, [1, 2, 3])):
        assert abs(sum(words(r) for r in after if r[3] == s) - target) <= 5
    counts, had = Counter(after), Counter(rows)
    assert set(counts) <= set(had) and all(n <= 3 * had[r] for r, n in counts.items())


def test_bpe_stage(passed):
    before, after, columns = passed[0]["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    library.no_truncation()
    library.no_padding()
    digest = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for row in before:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        expected.append((row[0], len(ids), digest(np.array(ids, "<u4").tobytes()), digest(text.encode())))
    assert columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(after) == Counter(expected)


def test_run_applies_all_stages(spark, passed):
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, passed[1]).collect()) == Counter(passed[0]["bpe"][1])


def test_empty_tables(spark, tmp_path):
    empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
