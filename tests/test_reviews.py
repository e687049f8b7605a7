"""Changes of a review server, from a server of this machine."""

import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tessaline.operators import text
from tessaline.sources import reviews

PATCH = "diff --git a/{0} b/{0}\n--- a/{0}\n+++ b/{0}\n@@ -1 +1,2 @@\n int a;\n+#include \"{1}.h\"\n"


@pytest.fixture
def server():
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802 (the interface's name)
            asked.append((self.path, self.headers.get("Cookie")))
            path, _, options = self.path.removeprefix("/a/changes/").partition("?")
            change, _, rest = path.partition("/revisions/")
            name = urllib.parse.unquote(change)
            if name == "gone" or rest.startswith("7/"):
                code, body = 404, "not found"
            elif rest:
                assert options == "raw"
                code, body = 200, PATCH.format("x.cc", rest.split("/")[0])
            else:
                assert options == "o=ALL_REVISIONS"
                told = {"project": "p " + name, "branch": "main", "status": "NEW", "more": {"deep": [1]}, "revisions": {f"s{n}": {"_number": n, "kind": "x"} for n in (10, 7, 2)}}
                code, body = 200, ")]}'\n" + json.dumps(told)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_port}", asked
    running.shutdown()


def test_changes_come_with_details_and_patches(spark, server):
    at, asked = server
    names = ["1", "a/b~main~I 1", "é?&*+", None, "1"]
    got = reviews.read_changes(at, spark.createDataFrame([(n,) for n in names], "change string"), "o=secret", 2).collect()
    assert sorted((r["change"], r["project"], r["branch"], r["subject"], r["numbers"]) for r in got) == sorted((n, f"p {n}", "main", None, [2, 7, 10]) for n in set(names) - {None})
    assert all(r["patch"] == PATCH.format("x.cc", "current") for r in got)
    assert len(asked) == 6 and {c for _, c in asked} == {"o=secret"}
    assert {p.split("?")[0].split("/revisions")[0] for p, _ in asked} == {"/a/changes/" + urllib.parse.quote(n, safe="") for n in names if n}


def test_every_patchset_is_read_and_parsed(spark, server):
    at, _ = server
    details = spark.createDataFrame([("1", [2, 7, 10]), ("2", []), ("3", None)], "change string, numbers array<int>")
    patches = reviews.read_patchsets(at, details, connections=3).cache()
    assert sorted((r["number"], r["patch"] is None) for r in patches.collect()) == [(2, False), (7, True), (10, False)]
    diffs = text.lines(patches.filter("patch is not null").withColumn("id", F.col("number")), "id", "patch")
    assert sorted(r["header"] for r in text.added_includes(diffs).collect()) == ["10.h", "2.h"]
    patches.unpersist()


def test_failures_are_errors_and_empty_tables_stay_empty(spark, server):
    at, asked = server
    with pytest.raises(Exception, match="404 not found"):
        reviews.read_changes(at, spark.createDataFrame([("gone",)], "change string")).collect()
    asked.clear()
    assert reviews.read_changes(at, spark.createDataFrame([], "change string")).collect() == [] and not asked


def test_details_of_odd_bodies(spark):
    bodies = [(1, ")]}'\n{\"project\": \"p\", \"revisions\": {}}"), (2, "{}"), (3, None), (4, "oops"), (5, '{"revisions": null, "branch": "b"}')]
    got = reviews.change_details(spark.createDataFrame(bodies, "id int, body string")).orderBy("id").collect()
    assert [(r["project"], r["branch"], r["numbers"]) for r in got] == [("p", None, []), (None, None, []), (None, None, []), (None, None, []), (None, "b", [])]
