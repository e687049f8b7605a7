"""Driver-side sources with a stand-in for the network, and a stand-in language server."""

import io
import json
import os
import sys
import urllib.error

import pytest

from tessaline.operators import cuts, filters, language_server
from tessaline.sources import remote

RAW = {"revision": "r", "date": "d", "files": ["a.cc"], "roots": [0], "includes": [[]], "included_by": [[]], "sizes": [1], "tsizes": [1], "asizes": [1], "esizes": [[]], "prevalence": [1]}


class Answer(io.BytesIO):
    headers = {"ETag": "t1"}


class Net:
    def __init__(self, answers):
        self.answers, self.asked = answers, []

    def __call__(self, request):
        self.asked.append((request.full_url, request.get_header("If-none-match")))
        answer = self.answers.pop(0)
        if isinstance(answer, int):
            raise urllib.error.HTTPError(request.full_url, answer, "", {}, None)
        if answer is None:
            raise urllib.error.URLError("unreachable")
        return Answer(answer.encode())


def test_cached_fetch(tmp_path):
    cache = str(tmp_path / "copy")
    net = Net(["one", 304, None, "two"])
    with pytest.raises(urllib.error.URLError):
        remote.fetch_cached("https://h/x", cache, opener=Net([None]))
    assert remote.fetch_cached("https://h/x", cache, opener=net) == "one"
    assert remote.fetch_cached("https://h/x", cache, opener=net) == "one" and len(net.asked) == 1
    os.utime(cache, (1, 1))
    assert remote.fetch_cached("https://h/x", cache, opener=net) == "one" and net.asked[-1][1] == "t1"
    assert os.path.getmtime(cache) > 1  # unchanged: fresh again
    for expected in ("one", "two"):
        os.utime(cache, (1, 1))
        assert remote.fetch_cached("https://h/x", cache, opener=net) == expected


def test_fetch_first():
    assert remote.fetch_first(["https://h/a", "https://h/b"], Net([404, "log"])) == "log"
    with pytest.raises(urllib.error.HTTPError):
        remote.fetch_first(["https://h/a", "https://h/b"], Net([500, "log"]))


def test_load_analysis(spark, tmp_path, monkeypatch):
    text = "data = " + json.dumps(RAW)
    page = f"<script>\n{text}\n</script>"
    assert remote.load_analysis(spark, "https://h/x.html", Net([page])).first()["files"] == ["a.cc"]
    monkeypatch.setattr("sys.stdin", io.StringIO(text))
    assert remote.load_analysis(spark, "-").first()["revision"] == "r"
    (tmp_path / "a.js").write_text(text)
    assert remote.load_analysis(spark, str(tmp_path / "a.js")).first()["prevalence"] == [1]


def test_review_json_cookies_and_commands(spark, tmp_path):
    bodies = [(1, ")]}'\n" + json.dumps({"revisions": {"a": {"_number": 10}, "b": {"_number": 2}}})), (2, "{}"), (3, None)]
    got = remote.patchsets(spark.createDataFrame(bodies, "id int, body string"))
    assert [r["numbers"] for r in got.orderBy("id").collect()] == [[2, 10], [], []]
    (tmp_path / "cookies").write_text("# h.org\nh.org\tF\t/\tT\t0\to\told\n.h.org\tF\t/\tT\t0\to\tnew\nother\tF\t/\tT\t0\to\tno\n")
    assert remote.cookie_for(str(tmp_path / "cookies"), "h.org") == "o=new" and remote.cookie_for(str(tmp_path / "cookies"), "x.org") is None
    write = "import sys; open(sys.argv[1], 'w').write(sys.argv[1] and '[1, 2]')"
    assert remote.command_json([sys.executable, "-c", write]) == [1, 2]
    assert remote.command_json([sys.executable, "-c", "raise SystemExit(2)"]) == [] and remote.command_json([sys.executable, "-c", ""]) == []


SERVER = r'''
import json, sys, time
def read():
    n = 0
    while (line := sys.stdin.buffer.readline()).strip():
        n = int(line.split(b":")[1])
    return json.loads(sys.stdin.buffer.read(n)) if n else sys.exit()
def send(m):
    b = json.dumps(m).encode()
    sys.stdout.buffer.write(b"Content-Length: %d\r\n\r\n" % len(b) + b)
    sys.stdout.buffer.flush()
while True:
    m = read()
    if m["method"] == "initialize":
        send({"id": m["id"], "result": {}})
    if m["method"] == "textDocument/didOpen":
        d = m["params"]["textDocument"]
        if d["text"] == "crash":
            sys.exit(1)
        if d["text"] == "hang":
            time.sleep(60)
        found = [{"code": "unused-includes", "range": {"start": {"line": i}, "end": {"line": i}}} for i, l in enumerate(d["text"].split("\n")) if "unused" in l]
        if "needs" in d["text"]:
            edits = {d["uri"]: [{"newText": "#include <vector>\n", "range": {"start": {"line": 1}}}]}
            found.append({"code": "missing-includes", "range": {"start": {"line": 3}, "end": {"line": 3}}, "codeActions": [{"title": "add", "edit": {"changes": edits}}]})
        send({"method": "textDocument/publishDiagnostics", "params": {"uri": d["uri"], "diagnostics": found}})
'''


def test_language_server(spark, tmp_path):
    (tmp_path / "server.py").write_text(SERVER)
    rows = [("a.cc", '#include "unused.h"\nneeds\n', "cpp"), ("b.cc", "crash", "cpp"), ("c.cc", "hang", "cpp"), ("d.cc", None, "cpp"), ("e.cc", '\n#include "unused.h"', "cpp")]
    sources = spark.createDataFrame(rows, "filename string, text string, language string").coalesce(1)
    diagnosed = language_server.diagnose(sources, [sys.executable, str(tmp_path / "server.py")], "/src", seconds=5, restart_files=2).cache()
    got = {r["filename"]: (r["diagnostics"], r["failure"]) for r in diagnosed.collect()}
    assert got["b.cc"] == (None, "the server ended") and got["c.cc"] == (None, "timeout") and got["d.cc"] == ("[]", None)
    assert json.loads(got["e.cc"][0])[0]["range"]["start"]["line"] == 1
    found = language_server.suggestions(diagnosed, sources)
    assert sorted((r["change_type"], r["line"], r["includer"], r["header"]) for r in found.collect()) == [
        ("add", 1, "a.cc", "<vector>"), ("remove", 0, "a.cc", "unused.h"), ("remove", 1, "e.cc", "unused.h")
    ]


def test_edge_weights(spark):
    changes = [(0, "remove", 1, "d/a.cc", "x.h", []), (1, "add", 2, "d/a.cc", "x.h", []), (2, "remove", 3, "d/a.cc", "gone.h", []), (3, "remove", 4, "d/a.cc", "<vector>", [])]
    changes = spark.createDataFrame(changes, "pos long, change_type string, line int, includer string, header string, extra array<string>")
    files = spark.createDataFrame([("d/x.h",), ("third_party/libc++/src/include/vector",)], "file string")
    weights = spark.createDataFrame([("d/a.cc", "d/x.h", 7), ("d/a.cc", "third_party/libc++/src/include/vector", 9)], "src string, dst string, weight long")
    got = filters.set_edge_weights(changes, weights, files, [], "out/D/gen/", "build/linux/s/", "p")
    assert sorted((r["line"], r["header"], r["weight"]) for r in got.collect()) == [(1, "x.h", 7), (2, "x.h", None), (3, "gone.h", None), (4, "<vector>", 9)]


def test_cut_report(spark):
    edges = spark.createDataFrame([("r1.cc", "a.h", 1), ("r2.cc", "a.h", 1), ("a.h", "t.h", 1), ("r3.cc", "t.h", 1)], "src string, dst string, esize long")
    files = spark.createDataFrame([("a.h", 1, 2, 3, 2), ("r3.cc", 1, 2, 3, 1)], "file string, size long, tsize long, asize long, prevalence long")
    roots = spark.createDataFrame([("r1.cc",), ("r2.cc",), ("r3.cc",)], "node string")
    floor, found = cuts.cut_report(edges, files, roots, "t.h", 3, top=1)
    assert floor.first()["original"] == 3
    assert [(r["section"], r["rank"], r["includer"], r["dominated"]) for r in found.collect() if r["section"] == "direct"] == [("direct", 1, "a.h", 2)]
