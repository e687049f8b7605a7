"""Analyses read by byte ranges, against the reader of whole ones and against json."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessaline.sources import analysis, snapshot


def graph(n, seed=1, name=lambda k: f"f{k}.h"):
    random.seed(seed)
    includes = [sorted(random.sample(range(n), random.choice([0, 0, 1, 3]) if n > 3 else 0)) for _ in range(n)]
    back = [[a for a in range(n) if b in includes[a]] for b in range(n)]
    return {
        "revision": 'r"\\,[', "date": "2024-05-01, noon", "files": [name(k) for k in range(n)], "roots": list(range(0, n, 3)), "includes": includes, "included_by": back,
        "sizes": [k * 7 for k in range(n)], "tsizes": [None if k == 1 else k for k in range(n)], "asizes": list(range(n)), "esizes": [[a * 10 + b for b in bs] for a, bs in enumerate(includes)], "prevalence": list(range(n)),
    }


def odd_name(k):
    return [f"a/{k}.h", f'q"{k},x]', f"back\\{k}\\", f"é,{k},,", f'","{k}', f"{{{k}:[,"][k % 6]


def expected(data):
    for key, got in data.items():
        if not isinstance(got, list):
            yield key, None, None, got
            continue
        yield key, None, None, None
        for i, x in enumerate(got):
            if isinstance(x, list):
                yield key, i, None, None
                yield from ((key, i, j, str(y)) for j, y in enumerate(x))
            else:
                yield key, i, None, None if x is None else str(x)


def walk(pieces, keys=snapshot.KEYS):
    place, out = snapshot.Place(), []
    for piece in pieces:
        out += [(k, i, j, None if v is None else v.decode()) for k, i, j, v in snapshot.values(place, piece, keys)]
        place = snapshot.moved(place, snapshot.effects(piece), "x")
    snapshot.ended(place, "x")
    return out


@pytest.mark.parametrize("spaces", [None, 1])
def test_any_cut_at_commas_gives_the_values_of_json(spaces):
    for n in (0, 1, 7):
        data = graph(n, name=odd_name) | {"more": {"deep": [{"files": [1, [2]]}], "k,e": [1]}}
        text = ("data = " + json.dumps(data, ensure_ascii=False, indent=spaces)).encode()
        tokens = text.split(b",")
        want = sorted(expected({k: v for k, v in data.items() if k != "more"}), key=str)
        for seed in range(30):
            random.seed(seed)
            cuts = sorted(random.sample(range(1, len(tokens)), min(seed, len(tokens) - 1)))
            pieces = [b",".join(tokens[a:b]) for a, b in zip([0, *cuts], [*cuts, len(tokens)])]
            pieces = pieces[:1] + [b"," + p for p in pieces[1:]]
            assert sorted(walk(pieces), key=str) == want


def test_effects_combine_in_any_grouping():
    text = json.dumps(graph(9, name=odd_name), ensure_ascii=False).encode()
    pieces = [b"," + t for t in text.split(b",")]
    for seed in range(20):
        random.seed(seed)
        a, b = sorted(random.sample(range(1, len(pieces)), 2))
        parts = [b"".join(p) for p in (pieces[:a], pieces[a:b], pieces[b:])]
        x, y, z = map(snapshot.effects, parts)
        left, right = snapshot.combine(snapshot.combine(x, y), z), snapshot.combine(x, snapshot.combine(y, z))
        assert left == right
        assert left[0] == snapshot.effects(b"".join(parts))[0]


def written(tmp_path, name, data):
    folder = tmp_path / name
    folder.mkdir()
    for k, d in enumerate(data):
        (folder / f"{k}.js").write_text("data = " + (d if isinstance(d, str) else json.dumps(d, ensure_ascii=False)), encoding="utf-8")
    return str(folder)


def test_ranges_of_one_file_give_what_whole_files_give(spark, tmp_path):
    path = written(tmp_path, "some", [graph(400, 2, odd_name), graph(60, 3), graph(0)])
    whole = analysis.read_analysis(spark, path)
    for split in (1 << 10, 1 << 20):
        elements = snapshot.read_elements(spark, path, split_bytes=split)
        for ours, theirs in ((snapshot.files_of(elements), analysis.files_of(whole)), (snapshot.edges_of(elements), analysis.edges_of(whole))):
            assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))
        assert {tuple(r["problems"]) for r in snapshot.load_problems(elements).collect()} == {()}
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "1024")
    assert session.read.option("lineSep", ",").text(path).select(F.spark_partition_id()).distinct().count() > 5


def test_problems_are_those_of_whole_files(spark, tmp_path):
    broken = []
    for key, change in (
        ("files", lambda v: v[:-1] + v[:1]), ("roots", lambda v: v + v[:1]), ("sizes", lambda v: v[:-1]), ("roots", lambda v: [*v, 99]), ("esizes", lambda v: [[*x, 1] for x in v]),
        ("included_by", lambda v: v[::-1]), ("includes", lambda v: [[*v[0], -1], *v[1:]]), ("prevalence", lambda v: v), ("asizes", lambda v: []),
    ):
        data = graph(20, 5)
        broken.append(data | {key: change(data[key])})
    path = written(tmp_path, "broken", broken)
    ours = snapshot.load_problems(snapshot.read_elements(spark, path, split_bytes=256))
    theirs = analysis.load_problems(analysis.read_analysis(spark, path)).select("url", "problems")
    assert sorted(map(str, ours.collect())) == sorted(map(str, theirs.collect()))


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_broken_files_are_errors(spark, tmp_path, split):
    good = json.dumps(graph(30))
    for k, text in enumerate([good[:-1], good[:-30], good[: len(good) // 2], "}" + good, "[1, 2]"]):
        with pytest.raises(Exception, match="no analysis in|too early"):
            snapshot.read_elements(spark, written(tmp_path, f"b{k}", [text]), split_bytes=split)


def test_written_snapshots_are_read_back(spark, tmp_path):
    for n in (0, 1, 50):
        whole = analysis.read_analysis(spark, written(tmp_path, f"w{n}", [graph(n, 4, odd_name)]))
        files, edges = analysis.files_of(whole), analysis.edges_of(whole)
        snapshot.write_snapshot(files, edges, str(tmp_path / f"out{n}"), 'r"\\,[', "2024-05-01, noon")
        (again,) = analysis.read_analysis(spark, str(tmp_path / f"out{n}")).drop("url").collect()
        assert [again] == whole.drop("url").collect()
        elements = snapshot.read_elements(spark, str(tmp_path / f"out{n}"), split_bytes=128)
        assert sorted(map(str, snapshot.edges_of(elements).drop("url").collect())) == sorted(map(str, edges.drop("url").collect()))


def test_the_driver_gets_no_texts_of_ranges(spark, tmp_path, monkeypatch):
    got, loads = [], snapshot.pickle.loads
    monkeypatch.setattr(snapshot.pickle, "loads", lambda told: got.append(len(told)) or loads(told))
    n = 20_000
    data = graph(0) | {k: [[]] * n if k in ("includes", "included_by", "esizes") else list(range(n)) for k in snapshot.BY_FILE} | {"files": [f"f{k}" for k in range(n)]}
    path = written(tmp_path, "long", [data])
    elements = snapshot.read_elements(spark, path, split_bytes=1 << 16)
    assert snapshot.files_of(elements).count() == n
    assert 5 < len(got) and max(got) < 1000
