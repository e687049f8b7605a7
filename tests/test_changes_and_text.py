import io
import json
import random
import re

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessaline.operators import filters, metrics, text, trends
from tessaline.sources import analysis, sinks
from tessaline.storage import numbered


def changes(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pos long, change_type string, line int, includer string, header string, extra array<string>")


def test_thresholds_and_types(spark):
    c = changes(spark, [("add", 1, "a.cc", "x.h", []), ("add", 2, "a.cc", "y.h", ["5"]), ("add", 3, "a.cc", "z.h", ["5", "q"]), ("odd", 4, "a.cc", "y.h", ["50"]), ("add", 5, "a.cc", "<__in>", ["50"])])
    assert [r["header"] for r in filters.filter_changes(c, threshold=10.0).collect()] == ["z.h"]
    assert sorted(r["header"] for r in filters.filter_changes(c).collect()) == ["x.h", "y.h", "z.h"]


def test_mapping_cancels_asymmetrically(spark):
    m = spark.createDataFrame([("k1", "c", 0), ("k2", "c", 1)], "src string, canonical string, ord int")
    c = changes(spark, [("add", 1, "a.cc", "k1", []), ("remove", 2, "a.cc", "c", []), ("add", 3, "b.cc", "k2", []), ("remove", 4, "b.cc", "c", []), ("add", 5, "d.cc", "k1", [])])
    got = {(r["change_type"], r["includer"], r["header"]) for r in filters.filter_changes(c, mappings=m).collect()}
    assert got == {("remove", "a.cc", "c"), ("add", "d.cc", "c")}


def test_mojom_variants_cancel_before_the_type_filter(spark):
    c = changes(spark, [("add", 1, "a.cc", "p.mojom-forward.h", []), ("remove", 2, "a.cc", "p.mojom.h", []), ("remove", 3, "b.cc", "p.mojom.h", [])])
    got = filters.filter_changes(c, cleanup_mojom=True, change_type="remove").collect()
    assert [(r["includer"], r["header"]) for r in got] == [("b.cc", "p.mojom.h")]


def test_resolve_includes(spark):
    files = spark.createDataFrame([("third_party/libc++/src/include/vector",), ("d/x.h",), ("inc/y.h",), ("out/D/gen/z.h",)], "file string")
    asked = spark.createDataFrame([("d/a.cc", "<vector>"), ("d/a.cc", "x.h"), ("e/a.cc", "x.h"), ("d/a.cc", "y.h"), ("d/a.cc", "z.h"), ("d/a.cc", "<none>")], "includer string, include string")
    got = {(r["includer"], r["include"]): r["resolved"] for r in filters.resolve_includes(asked, files, ["inc"], "out/D/gen/", "build/linux/s/", "p").collect()}
    assert got[("d/a.cc", "<vector>")] == "third_party/libc++/src/include/vector" and got[("d/a.cc", "x.h")] == "d/x.h" and got[("e/a.cc", "x.h")] == "x.h"
    assert got[("d/a.cc", "y.h")] == "inc/y.h" and got[("d/a.cc", "z.h")] == "out/D/gen/z.h" and got[("d/a.cc", "<none>")] == "none"


def test_analysis_source(spark, tmp_path):
    raw = {
        "revision": "r", "date": "2024-05-01 03:04:05 UTC", "files": ["a.cc", "out/D/gen/b.h", "build/linux/s/usr/include/x86/sys/t.h"], "roots": [0], "includes": [[1, 2], [2], []],
        "included_by": [[], [0], [0, 1]], "sizes": [1, 2, 3], "tsizes": [6, 5, 3], "asizes": [1, 2, 3], "esizes": [[5, 3], [3], []], "prevalence": [1, 1, 1],
    }
    (tmp_path / "a.js").write_text("data = " + json.dumps(raw))
    (tmp_path / "a.html").write_text("<html><script>\nvar x</script><script>\ndata = " + json.dumps(raw) + "\n</script></html>")
    a = analysis.read_analysis(spark, str(tmp_path / "a.js"))
    assert [(r["src"], r["dst"], r["esize"]) for r in analysis.edges_of(a).orderBy("src_id", "pos").collect()] == [("a.cc", "out/D/gen/b.h", 5), ("a.cc", raw["files"][2], 3), ("out/D/gen/b.h", raw["files"][2], 3)]
    assert [(r["file"], r["is_root"]) for r in analysis.files_of(a).orderBy("file_id").collect()][0] == ("a.cc", True)
    p = analysis.prefixes_of(analysis.files_of(a)).first()
    assert (p["gen_prefix"], p["sysroot"], p["sysroot_platform"]) == ("out/D/gen/", "build/linux/s/", "x86")
    assert analysis.read_analysis(spark, str(tmp_path / "a.html"), html=True).first()["revision"] == "r"
    (tmp_path / "bad.js").write_text("nothing here")
    with pytest.raises(Exception, match="no analysis"):
        analysis.read_analysis(spark, str(tmp_path / "bad.js")).collect()


def test_edge_lists_and_changes(spark, tmp_path):
    (tmp_path / "skips.csv").write_text("# note\na,b\n\na,b\nc,*\n")
    assert sorted(tuple(r) for r in analysis.read_edge_lists(spark, [str(tmp_path / "skips.csv")]).collect()) == [("a", "b"), ("c", "*")]
    (tmp_path / "changes.csv").write_text('add,1,a.cc,"x,y.h"\nremove,2,b.cc,z.h,3.5\n')
    rows = analysis.read_changes(spark, str(tmp_path / "changes.csv")).orderBy("pos").collect()
    assert [(r["change_type"], r["line"], r["header"], r["extra"]) for r in rows] == [("add", 1, "x,y.h", []), ("remove", 2, "z.h", ["3.5"])]


def test_sources_are_read_edited_and_written(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.cc").write_text('#include "x.h"\nint a;\n')
    c = spark.createDataFrame([(0, "remove", 0, "d/a.cc", "x.h"), (1, "other", 0, "d/a.cc", "z"), (2, "add", 1, "d/a.cc", "y.h")], "pos long, change_type string, line int, includer string, header string")
    texts = text.apply_changes(analysis.read_sources(spark, str(tmp_path), ["d/a.cc"]), text.first_changes(c, 1))
    named = lambda rows: [r["file"] for r in rows.collect()]
    assert named(sinks.save_sources(texts, str(tmp_path))) == ["d/a.cc"] and "x.h" in (tmp_path / "d" / "a.cc").read_text()
    assert named(sinks.save_sources(texts, str(tmp_path), dry_run=False)) == ["d/a.cc"]
    assert (tmp_path / "d" / "a.cc").read_text() == "int a;\n"
    both = texts.select("file", F.lit("new").alias("text")).unionByName(spark.createDataFrame([("d/none.cc", "x")], "file string, text string"))
    with pytest.raises(Exception, match="none.cc"):
        sinks.save_sources(both, str(tmp_path), dry_run=False)
    assert [f.name for f in (tmp_path / "d").iterdir()] == ["a.cc"] and (tmp_path / "d" / "a.cc").read_text() == "int a;\n"
    sinks.write_csv(spark.createDataFrame([("a,b", None)], "x string, y int").coalesce(1), str(tmp_path / "out"))
    assert [f.read_bytes() for f in (tmp_path / "out").glob("part-*")] == [b'"a,b",\r\n']


def test_load_checks(spark):
    good = ("g", "r", "d", ["a", "b", "c"], [0], [[1, 2], [2], []], [[], [0], [1, 0]], [1] * 3, [1] * 3, [1] * 3, [[4, 5], [6], []], [1] * 3)
    at = ("url", "revision", "date", "files", "roots", "includes", "included_by", "sizes", "tsizes", "asizes", "esizes", "prevalence")
    changed = lambda url, **k: tuple(k.get(n, v) if n != "url" else url for n, v in zip(at, good))
    rows = [good, changed("names", files=["a", "b", "a"]), changed("roots", roots=[0, 0]), changed("pairs", included_by=[[], [0], [0, 0]]), changed("short", sizes=[1]), changed("none", tsizes=None), changed("far", roots=[3])]
    df = spark.createDataFrame(rows, "url string, " + analysis.ANALYSIS)
    got = {r["url"]: r["problems"] for r in analysis.load_problems(df).collect()}
    assert got == {
        "g": [], "names": ["file names repeat"], "roots": ["roots repeat"], "pairs": ["included_by doesn't agree with includes"], "short": ["lists differ in length"],
        "none": ["lists differ in length"], "far": ["numbers name no file"],
    }
    assert analysis.checked(df.filter("url = 'g'")).count() == 1
    for url in got.keys() - {"g"}:
        with pytest.raises(Exception, match=f"analysis {url}: "):
            analysis.checked(df.filter(F.col("url") == url)).collect()
    seen = Observation("load")
    assert [r["url"] for r in analysis.checked(df, seen).collect()] == ["g"] and seen.get == {"analyses": 7, "broken": 6}


def test_missing_prefixes_are_errors(spark):
    files = spark.createDataFrame([("u", 0, "a.cc")], "url string, file_id int, file string")
    with pytest.raises(Exception, match="no generated files"):
        analysis.prefixes_of(files).collect()


def test_config_merge(spark, tmp_path):
    (tmp_path / "inner.json").write_text(json.dumps({"includeDirs": ["inc"], "ignores": {"skip": ["s.cc"], "add": {"headers": ["h.h"], "edges": [["a.cc", "b.h"]]}}}))
    (tmp_path / "c.json").write_text(json.dumps({"dependencies": {"v8": "inner.json"}, "headerMappings": {"k": "c"}}))
    configs = analysis.merged_configs(analysis.read_configs(spark, str(tmp_path / "c.json")))
    assert analysis.include_dirs(configs) == ["v8"] and [tuple(r) for r in analysis.header_mappings(configs).collect()] == [("k", "c", 0)]
    assert {tuple(r) for r in analysis.ignore_rules(configs).collect()} == {("skip", "filename", "v8/s.cc", None), ("add", "header", None, "h.h"), ("add", "header", None, "v8/h.h"), ("add", "edge", "v8/a.cc", "b.h")}
    with pytest.raises(Exception, match="none.json"):
        analysis.read_configs(spark, str(tmp_path / "none.json")).collect()
    (tmp_path / "c.json").write_text(json.dumps({"includeDirs": ["x"], "dependencies": {"b": {"ignores": {"remove": {"filenames": ["f"]}}}, "a": "inner.json"}}))
    configs = analysis.merged_configs(analysis.read_configs(spark, str(tmp_path / "c.json")))
    assert analysis.include_dirs(configs) == ["x", "b", "a"] and ("remove", "filename", "b/f", None) in {tuple(r) for r in analysis.ignore_rules(configs).collect()}
    (tmp_path / "c.json").write_text("{}")
    configs = analysis.merged_configs(analysis.read_configs(spark, str(tmp_path / "c.json")))
    assert analysis.include_dirs(configs) == [] and analysis.ignore_rules(configs).collect() == []


DIFF = """diff --git a/f.cc b/f.cc
--- a/f.cc
+++ b/f.cc
@@ -1,3 +1,4 @@ top
 one
+#include "x.h"
-two
+added
 three
@@ -20,2 +21,3 @@
 ten
+other
diff --git a/g.cc b/g.cc
--- a/g.cc
+++ b/g.cc
@@ -1 +1,2 @@
+#include <y.h>
 z"""


def test_patch_for_header(spark):
    rows = text.lines(spark.createDataFrame([(1, DIFF)], "id long, text string"), "id", "text")
    assert sorted((r["file"], r["header"]) for r in text.added_includes(rows).collect()) == [("f.cc", "x.h"), ("g.cc", "y.h")]
    patch = text.patch_for_header(rows, "x.h").first()["patch"]
    assert patch == 'diff --git a/f.cc b/f.cc\n--- a/f.cc\n+++ b/f.cc\n@@ -1,3 +1,4 @@ top\n one\n+#include "x.h"\n two\n three'


@pytest.mark.parametrize("part_lines", [1, 2, 5, 1 << 16])
def test_parts_of_long_diffs_and_logs(spark, monkeypatch, part_lines):
    monkeypatch.setattr(text, "PART_LINES", part_lines)
    rng = random.Random(part_lines)
    texts = []
    for k in range(12):
        texts.append((k, "\n".join(rng.choice(["diff --git a/x b/y%d" % rng.randint(0, 9), "diff --git broken", "@@ -1 +1 @@", "+a", "b.cc:1:2: error: bad", " | ^~", "^"]) for _ in range(rng.randint(1, 25)))))
    rows = text.lines(spark.createDataFrame(texts, "id long, text string"), "id", "text").filter("pos % 7 <> 3")
    got = {(r["id"], r["pos"]): (r["file_no"], r["hunk_no"], r["file"]) for r in text.diff_sections(rows).collect()}
    carets = {(r["id"], r["pos"]): r["_caret"] for r in text._second_next(rows).collect()}
    for i, told in texts:
        kept = [(pos, line) for pos, line in enumerate(told.split("\n")) if pos % 7 != 3]
        file_no = hunk_no = 0
        name = None
        for k, (pos, line) in enumerate(kept):
            if line.startswith("diff --git"):
                file_no, hunk_no = file_no + 1, 0
                name = line.split(" b/")[1] if " b/" in line else name
            hunk_no += line.startswith("@@")
            assert got.pop((i, pos)) == (file_no, hunk_no, name)
            assert carets.pop((i, pos)) == (kept[k + 2][1] if k + 2 < len(kept) else None)
    assert not got and not carets


def test_a_hunk_without_numbers_goes(spark):
    diff = DIFF.replace("@@ -1,3 +1,4 @@ top", "@@ odd @@") + '\n@@ -9,1 +9,2 @@\n+#include "x.h"\n q'
    rows = text.lines(spark.createDataFrame([(1, diff)], "id long, text string"), "id", "text")
    assert text.patch_for_header(rows, "x.h").first()["patch"].split("\n")[-3:] == ["@@ -9,1 +9,2 @@", '+#include "x.h"', " q"]


def test_compile_errors(spark):
    log = "../../src/a/b.cc:12:5: error: no type 'X'\n  12 |   X y;\n     |   ^~~\n/w/src/a/b.cc:13:1: warning: hm\n../c.cc(7,2): error: bad"
    rows = text.compile_errors(text.lines(spark.createDataFrame([(1, log), (2, log)], "id long, text string"), "id", "text"))
    first = text.first_errors(rows).orderBy("pos").collect()
    assert [(r["file"], r["line_no"], r["range_start"], r["range_end"]) for r in first] == [("src/a/b.cc", 12, 2, 5), ("c.cc", 7, None, None)]
    assert text.annotations(rows).count() == 2


def test_failed_builds_and_diagnostics(spark):
    tag = lambda v: [{"key": "parent_buildbucket_id", "value": v}] if v else []
    results = spark.createDataFrame([("1", "FAILURE", tag(None)), ("2", "FAILURE", tag("1")), ("3", "SUCCESS", tag(None))], "id string, status string, tags array<struct<key:string,value:string>>")
    assert [r["id"] for r in text.failed_builds(results).collect()] == ["2"]
    d = spark.createDataFrame([("a.cc", "unused-includes", 3, '#include "x.h"'), ("a.cc", "missing-includes", 1, "#include <y>\n"), ("a.cc", "missing-includes", 1, "#include <y>\n")], "file string, code string, line int, text string")
    assert sorted((r["change_type"], r["header"]) for r in text.diagnostics_to_changes(d).collect()) == [("add", "<y>"), ("remove", "x.h")]


def test_apply_changes(spark):
    src = spark.createDataFrame([("a.cc", '#include "x.h"\nint a;\n#include <v>\n'), ("b.cc", "int b;\n")], "file string, text string")
    c = spark.createDataFrame([(0, "remove", 0, "a.cc", "x.h"), (1, "add", 1, "a.cc", "y.h"), (2, "add", 2, "a.cc", "<v>"), (3, "remove", 1, "a.cc", "zzz")], "pos long, change_type string, line int, includer string, header string")
    got = {r["file"]: r["text"] for r in text.apply_changes(src, c).collect()}
    assert got == {"a.cc": '#include "y.h"\nint a;\n#include <v>\n', "b.cc": "int b;\n"}


def edited_plainly(source, edits):
    """The text after edits one at a time, on lines that remember their place in the source."""
    parts = source.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    rows = [(i, x + "\n") for i, x in enumerate(parts[:-1])] + ([(len(parts) - 1, parts[-1])] if parts[-1] else [])
    for _, kind, at, header in sorted(edits, key=lambda e: (e[2], e[0])):
        line = f"#include {header}" if header.startswith("<") else f'#include "{header}"'
        if kind == "remove":
            for k, (i, told) in enumerate(rows):
                m = re.match(r"#include ([\"<](.*)[\">])", told.strip())
                if i == at and m and m[1].strip('"') == header:
                    del rows[k]
                    break
        elif kind == "add" and all(told.strip() != line for _, told in rows):
            rows.append((at - 0.5, line + "\n"))
            rows.sort(key=lambda r: r[0])
    return "".join(told for _, told in rows)


def test_apply_changes_by_plain_edits(spark):
    rng = random.Random(9)
    lines = ['#include "a.h"', "  #include <v>  ", '#include "b/a.h" // x', "int x;\f", "", '#include "a.h"', "\x0b#include <w>", "\u2028y"]
    sources, changes = [], []
    for f in range(60):
        texts = [rng.choice(lines) for _ in range(rng.randint(1, 7))]
        sources.append((f"f{f}.cc", "".join(x + rng.choice(["\n", "\n", "\r\n", "\r"]) for x in texts[:-1]) + texts[-1] + rng.choice(["", "\n"])))
        whole = edited_plainly(sources[-1][1], [])
        n = whole.count("\n") + (whole[-1:] not in ("", "\n"))
        for pos in range(rng.randint(0, 6)):
            kind = rng.choice(["add", "add", "remove", "other"] if n else ["add", "other"])
            changes.append((pos, kind, rng.randrange(n + 2) if kind == "add" or n == 0 else rng.randrange(n), f"f{f}.cc", rng.choice(["a.h", "<v>", "b/a.h", "new.h", "<w>"])))
    schema = "pos long, change_type string, line int, includer string, header string"
    got = {r["file"]: r["text"] for r in text.apply_changes(spark.createDataFrame(sources, "file string, text string"), spark.createDataFrame(changes, schema)).collect()}
    for file, source in sources:
        own = [(c[0], c[1], c[2], c[4]) for c in changes if c[3] == file]
        assert got[file] == (edited_plainly(source, own) if any(c[1] != "other" for c in own) else source), (source, own)
    beyond = spark.createDataFrame([(0, "remove", 99, "f1.cc", "a.h")], schema)
    with pytest.raises(Exception, match="no line 99 in f1.cc"):
        text.apply_changes(spark.createDataFrame(sources, "file string, text string"), beyond).collect()


def test_sources_of_nested_names(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, told in (("b.h", "outer"), ("a b/b.h", "inner"), ("a b/c+d%20.h", "odd")):
        (tmp_path / name).write_text(told)
    got = sorted(tuple(r) for r in analysis.read_sources(spark, str(tmp_path), ["b.h", "a b/b.h", "a b/c+d%20.h", "b.h"]).collect())
    assert got == [("a b/b.h", "inner"), ("a b/c+d%20.h", "odd"), ("b.h", "outer")]


def test_percent_is_exact(spark):
    values = [0.125, 2.675, 0.005, 0.015, 1.005, -0.125, -0.001, -0.0, 0.0, 1e9 + 0.125, 123456789.375, 33.333333, 99.995, 0.995, 1 / 3] + [i / 8 for i in range(200)] + [random.Random(2).uniform(-1000, 1000) for _ in range(300)]
    rows = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", sinks.percent(F.col("x")).alias("p")).collect()
    assert all(r["p"] == f"{r['x']:.2f}" for r in rows)


def test_numbering_by_ranges(spark):
    rows = [(i % 7, (i * 37) % 101, i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "a int, b int, c int").repartition(5), ["a", "b", "c"], "pos").collect()
    assert [(r["a"], r["b"], r["c"]) for r in sorted(got, key=lambda r: r["pos"])] == sorted(rows) and sorted(r["pos"] for r in got) == list(range(1, 501))
    assert numbered(spark.createDataFrame([], "a int"), ["a"], "pos").collect() == []


def test_trends(spark):
    index = spark.createDataFrame([("2024-01-30 00:00:00",), ("2024-01-29 12:00:00",), ("2024-01-20 00:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("snapshot"))
    got = [(r["days"], r["age"]) for r in trends.nearest_older(index, "2024-01-30 01:00:00", [0, 3, 7]).orderBy("days").collect()]
    assert got == [(0, 0), (3, 10)]


def test_metrics_and_sinks(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "c", 3)], "src string, dst string, esize long")
    got = {(r["src"], r["dst"]): r["centrality"] for r in metrics.centrality(e, 3).collect()}
    assert got == {("a", "b"): 0.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    out = io.StringIO()
    sinks.write_csv_stream(spark.createDataFrame([("a,b", 1.5, None)], "x string, y double, z string"), out)
    assert out.getvalue() == '"a,b",1.5,\r\n'
    assert sinks.to_json(spark.range(1)).first()["json"] == '{"id":0}'


def test_entry_imports_without_the_training_data_operators():
    import __spark_entry__

    assert "g23_reaching_roots" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_includes_are_looked_up_once_a_folder(spark):
    asked = spark.createDataFrame([(f"a/{k}.cc", "x.h") for k in range(50)] + [("b/1.cc", "x.h"), (None, "y.h"), ("a/1.cc", None)], "includer string, include string")
    files = spark.createDataFrame([("a/x.h",), ("a/x.h",), ("y.h",)], "file string")
    found = filters.resolve_includes(asked, files, [], "gen/", "s/", "p")
    generate = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate posexplode" in line]
    assert generate and not any("includer#" in line for line in generate)
    got = {(r["includer"], r["include"]): r["resolved"] for r in found.collect()}
    assert len(got) == 53 and all(got[f"a/{k}.cc", "x.h"] == "a/x.h" for k in range(50))
    assert got["b/1.cc", "x.h"] == "x.h" and got[None, "y.h"] == "y.h" and got["a/1.cc", None] is None


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


def small_diffs(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    return text.lines(session.createDataFrame([(1, DIFF), (2, DIFF)], "id long, text string"), "id", "text")


def test_lines_of_diffs_are_dealt_once(spark):
    assert len(exchanges(text.diff_sections(small_diffs(spark)))) == 1


def test_lines_of_patches_are_dealt_once(spark):
    assert len(exchanges(text.patch_for_header(small_diffs(spark), "x.h"))) == 1


def test_lines_of_a_long_diff_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(text, "PART_LINES", 4)
    assert "Join" not in text.diff_sections(small_diffs(spark))._jdf.queryExecution().executedPlan().toString()


def test_only_names_and_includes_are_dealt_for_added_includes(spark):
    found = text.added_includes(small_diffs(spark))
    assert len(exchanges(found)) == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in plan[plan.rindex("Exchange"):]  # below the exchange


def test_frequent_headers_deal_lines_once(spark):
    assert len(exchanges(text.frequent_headers(text.added_includes(small_diffs(spark)), 2))) == 1


@pytest.mark.parametrize("part_lines", [1, 1 << 16])
def test_lines_of_logs_are_not_joined(spark, monkeypatch, part_lines):
    monkeypatch.setattr(text, "PART_LINES", part_lines)
    assert "Join" not in text.compile_errors(small_diffs(spark))._jdf.queryExecution().executedPlan().toString()


def test_edges_are_not_dealt_by_both_ends_for_degrees(spark):
    e = spark.createDataFrame([("r", "a"), ("r", "a"), ("r", "b"), ("a", "b"), ("b", "a"), ("b", "c"), ("a", None)], "src string, dst string")
    both = re.compile(r"hashpartitioning\(src#\d+, dst#\d+")
    counted = metrics.degrees(e.filter("dst is not null"))
    assert not both.search(counted._jdf.queryExecution().executedPlan().toString())
    assert {r["node"]: (r["out"], r["into"]) for r in counted.collect()} == {"r": (2, 0), "a": (1, 2), "b": (2, 2), "c": (0, 1)}
    shown = metrics.centrality(e, 11)
    assert not both.search(shown._jdf.queryExecution().executedPlan().toString())
    got = {(r["src"], r["dst"]): r["centrality"] for r in shown.collect()}
    assert got == {("r", "a"): 0.0, ("r", "b"): 0.0, ("a", "b"): pytest.approx(4000.0), ("a", None): 0.0, ("b", "a"): pytest.approx(4000.0), ("b", "c"): 0.0}
