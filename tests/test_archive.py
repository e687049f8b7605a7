"""Snapshots behind an index, from a server of this machine."""

import http.server
import json
import threading

import pytest

from tessaline.sources import archive


def page(name):
    data = {"revision": name, "date": "d", "files": ["a.cc"], "roots": [0], "includes": [[]], "included_by": [[]], "sizes": [1], "tsizes": [1], "asizes": [1], "esizes": [[]], "prevalence": [1]}
    return f"<html><script>\ndata = {json.dumps(data)}</script></html>"


@pytest.fixture
def served():
    pages = {f"/x_includes_2024-05-0{d}_030405.html": (f'"t{d}"', page(f"r{d}")) for d in (3, 2, 1)}
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802 (the interface's name)
            if self.path == "/":
                links = "".join(f'<a href="{p.lstrip("/")}">x</a>' for p in pages) + '<a href="notes.html">y</a><a href="x_includes_2024-99-99_000000.html">z</a>'
                tag, body = None, links
            else:
                tag, body = pages[self.path]
                asked.append(self.path)
            same = tag is not None and self.headers.get("If-None-Match") == tag
            self.send_response(304 if same else 200)
            if tag:
                self.send_header("ETag", tag)
            self.end_headers()
            if not same:
                self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", pages, asked
    server.shutdown()


def test_only_what_is_asked_for_is_fetched(spark, served):
    index, pages, asked = served
    everything = archive.read_archive(spark, index)
    assert everything.rdd.getNumPartitions() == 3
    got = archive.analyses_of(everything).collect()
    assert sorted((r["revision"], r["url"][-22:], str(r["stamp"])) for r in got) == [(f"r{d}", f"2024-05-0{d}_030405.html", f"2024-05-0{d} 03:04:05") for d in (1, 2, 3)]
    asked.clear()
    late = archive.read_archive(spark, index, since="2024-05-02 03:04:05").collect()
    assert sorted(r["tag"] for r in late) == ['"t2"', '"t3"'] and sorted(set(asked)) == sorted(p for p in pages if "01_03" not in p)


def test_a_new_day_reads_new_pages_only(spark, served, tmp_path):
    index, pages, asked = served
    folder = str(tmp_path / "landed")
    gone = pages.pop("/x_includes_2024-05-03_030405.html")
    assert archive.update_archive(spark, index, folder).count() == 2
    pages["/x_includes_2024-05-03_030405.html"] = gone
    pages["/x_includes_2024-05-01_030405.html"] = ('"new"', page("again"))
    found = archive.update_archive(spark, index, folder)
    assert sorted(r["revision"] for r in archive.analyses_of(found).collect()) == ["again", "r2", "r3"]
    landed = spark.read.parquet(folder)
    assert landed.count() == 4 and landed.filter("tag = '\"t2\"'").count() == 1
