"""Queries against their SQL in DuckDB."""

import duckdb
import pytest

from tessaline.llm.queries import ORACLES, QUERIES

from .helpers import awkward

TABLES = ("documents", "conversations", "embeddings")
CONVERSATIONS = [
    (1, 0, "user", "a & b <| c"), (1, 1, "assistant", None), (1, 1, "assistant", "x &amp; y &lt;| \n"), (2, 0, None, "ß\U0001f600"),
    (None, None, "assistant", "<|im_end|>\n"), (3, 0, "assistant", "one"), (3, 1, "user\n", ""), (3, 2, "assistant", "two"),
]
VECTORS = [
    (0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [1.0, 1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [0.3, 0.4]),
    (7, [9.0, 9.0, 9.0]), (50, [-0.001, 0.7]), (100, []), (None, [1.0, 1.0]), (6, [0.3, 0.4]),
]


def same(spark, name, sf_dir):
    got = QUERIES[name](spark, sf_dir)
    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for t in TABLES:
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{'/*.parquet' if sf_dir[:5] != '/root' else ''}')")
        asked = con.execute(ORACLES[name])
        columns = [c[0] for c in asked.description]
        rows = asked.fetchall()
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))
    assert rows


@pytest.mark.parametrize("name", ORACLES)
def test_on_the_synthetic_tables(spark, name):
    same(spark, name, "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ORACLES)
def test_on_awkward_tables(spark, name, tmp_path):
    sf_dir = str(tmp_path)
    awkward(spark).write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").write.parquet(f"{sf_dir}/conversations.parquet")
    spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").write.parquet(f"{sf_dir}/embeddings.parquet")
    same(spark, name, sf_dir)
