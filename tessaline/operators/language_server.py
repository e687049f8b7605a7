"""Diagnostics from language-server processes, one per partition.

Every process is started by the task that needs it and stopped at the task's end,
so a lost executor costs only its own files.
"""

from __future__ import annotations

import json
import queue
import subprocess
import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import diagnostics_to_changes

FILE_SECONDS = 180
RESTART_FILES = 350
#: What is read of a diagnostic.
_RANGE = "range: struct<start: struct<line: int>>"
DIAGNOSTICS = f"array<struct<code: string, {_RANGE}, codeActions: array<struct<edit: struct<changes: map<string, array<struct<newText: string, {_RANGE}>>>>>>>>"


class ServerFailure(Exception):
    """The server ended, or gave no diagnostics in time."""


class Server:
    """A language server spoken to over its standard streams."""

    def __init__(self, command: list[str], root: str, seconds: float):
        self.seconds, self.root, self.number = seconds, root, 0
        self.process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL)
        self.inbox: queue.Queue = queue.Queue()
        threading.Thread(target=self._receive, daemon=True).start()
        self._send("initialize", {"processId": None, "rootUri": f"file://{root}", "capabilities": {"textDocument": {"publishDiagnostics": {"codeActionsInline": True}}}}, asks=True)
        self._await(lambda m: m.get("id") == self.number and "method" not in m)
        self._send("initialized", {})

    def _receive(self) -> None:
        stream = self.process.stdout
        while True:
            length = None
            while (line := stream.readline()).strip():
                name, _, value = line.decode("ascii", "replace").partition(":")
                if name.lower() == "content-length":
                    length = int(value)
            if not line and length is None:
                break
            self.inbox.put(json.loads(stream.read(length or 0) or b"{}"))
        self.inbox.put(None)

    def _send(self, method: str, params: dict, asks: bool = False) -> None:
        message = {"jsonrpc": "2.0", "method": method, "params": params}
        if asks:
            self.number += 1
            message["id"] = self.number
        body = json.dumps(message).encode()
        try:
            self.process.stdin.write(b"Content-Length: %d\r\n\r\n" % len(body) + body)
            self.process.stdin.flush()
        except OSError as problem:
            raise ServerFailure("the server ended") from problem

    def _await(self, wanted) -> dict:
        while True:
            try:
                message = self.inbox.get(timeout=self.seconds)
            except queue.Empty:
                raise ServerFailure("timeout") from None
            if message is None:
                raise ServerFailure("the server ended")
            if wanted(message):
                return message

    def diagnostics(self, filename: str, text: str, language: str) -> list:
        uri = f"file://{self.root}/{filename}"
        self._send("textDocument/didOpen", {"textDocument": {"uri": uri, "languageId": language, "version": 1, "text": text}})
        found = self._await(lambda m: m.get("method") == "textDocument/publishDiagnostics" and m["params"]["uri"] == uri)
        self._send("textDocument/didClose", {"textDocument": {"uri": uri}})
        return found["params"]["diagnostics"]

    def stop(self) -> None:
        self.process.kill()
        self.process.wait()
        self.process.stdin.close()


def diagnose(sources: DataFrame, command: list[str], root: str, seconds: float = FILE_SECONDS, restart_files: int = RESTART_FILES) -> DataFrame:
    """``filename, diagnostics, failure`` of every row of ``sources`` (``filename, text, language``).

    ``diagnostics`` is the server's JSON list.  A file that takes too long or ends
    the server has null diagnostics and the reason, and the next one meets a new
    server; so does every ``restart_files``-th.  ``command`` must be installed on
    the executors.  Null texts are empty; no sources, no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        server, served = None, 0
        try:
            for pdf in batches:
                out = []
                for filename, text, language in zip(pdf["filename"], pdf["text"], pdf["language"]):
                    try:
                        if server is not None and served >= restart_files:
                            server.stop()
                            server = None
                        if server is None:
                            server, served = Server(command, root, seconds), 0
                        served += 1
                        out.append((filename, json.dumps(server.diagnostics(filename, text or "", language)), None))
                    except ServerFailure as problem:
                        out.append((filename, None, str(problem)))
                        if server is not None:
                            server.stop()
                        server = None
                yield pd.DataFrame(out, columns=["filename", "diagnostics", "failure"])
        finally:
            if server is not None:
                server.stop()

    return sources.select("filename", "text", "language").mapInPandas(run, "filename string, diagnostics string, failure string")


def suggestions(diagnosed: DataFrame, sources: DataFrame) -> DataFrame:
    """Include changes from rows of :func:`diagnose`, as ``diagnostics_to_changes`` gives them.

    An unused include is read from its source line, a missing one from its first
    edit, whose line counts.
    """
    parsed = diagnosed.select(F.col("filename").alias("file"), F.explode(F.from_json("diagnostics", DIAGNOSTICS)).alias("d"))
    edit = F.get(F.get(F.map_values(F.get("d.codeActions", F.lit(0))["edit"]["changes"]), F.lit(0)), F.lit(0))
    unused = F.col("d.code") == "unused-includes"
    lines = sources.select(F.col("filename").alias("_name"), F.split("text", "\r\n|\r|\n").alias("_lines"))
    rows = parsed.join(lines, F.col("file") == F.col("_name"))
    at = F.when(unused, F.col("d.range.start.line")).otherwise(edit["range"]["start"]["line"])
    text = F.when(unused, F.get("_lines", F.col("d.range.start.line"))).otherwise(edit["newText"])
    return diagnostics_to_changes(rows.select("file", F.col("d.code").alias("code"), at.alias("line"), text.alias("text")))
