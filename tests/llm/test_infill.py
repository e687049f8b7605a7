"""Fill-in-middle against a plain version, and its oracle."""

import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from tessaline.llm import infill
from tessaline.llm.oracles import ORACLES
from tessaline.llm.queries import QUERIES

from .helpers import awkward, empty


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def check(df):
    filled = infill.fill_in_middle(df)
    rows = filled.select("*", infill.restore(F.col("output"), F.col("form")).alias("restored")).collect()
    assert len(rows) == df.count()
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_version(r["doc_id"], r["text"])
        assert r["restored"] == r["text"]
    return rows


def test_against_a_plain_version(spark):
    rng = random.Random(3)
    pieces = ["a", "é", "中", "\U0001f600", "é", "\n", "\x1e", "\x1f", "\x1fd", "\x1fe", "<", "<P", "S>", "$1", "\\", "\x00", " ", "\r\n", "<M", "d", "e"]
    docs = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    docs += [(1000 + i, "<S>" * (i % 2) + "<P" * (i % 3) + "<<S") for i in range(30)] + [(7, docs[7][1])] * 3 + [(None, "no id"), (None, None)]
    rows = check(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}


def test_awkward_empty_and_long_texts(spark):
    check(awkward(spark))
    assert check(empty(spark)) == []
    check(spark.createDataFrame([(i, "été \U0001f600" * 300_000) for i in range(6)], "doc_id long, text string"))


def test_query_against_its_oracle(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet'")
    want = con.execute(ORACLES["op12_fill_in_middle"]).fetchall()
    names = [d[0] for d in con.description]
    got = [tuple(r) for r in QUERIES["op12_fill_in_middle"](spark, path).select(*names).collect()]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) > 100
