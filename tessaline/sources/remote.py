"""Driver-side sources beyond file systems (S1, S6, S19-S22): what they land, Spark reads.

Each takes the function that opens a URL, so that a proxy, a login or a test can
stand in for ``urllib``.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
import sys
import tempfile
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .analysis import html_data, parse_analysis

FRESH_SECONDS = 600
# Fixed value: what review servers put before JSON.
JSON_GUARD = ")]}'"


def fetch_cached(url: str, cache: str, fresh_seconds: float = FRESH_SECONDS, opener: Callable = urllib.request.urlopen) -> str:
    """The text at ``url``, kept in the file ``cache`` beside its entity tag.

    A copy younger than ``fresh_seconds`` isn't asked for again; an older one is
    only fetched if it changed, and serves as well where the server can't be reached.
    """
    tag_file, held = f"{cache}.etag", os.path.exists(cache)
    if held and time.time() - os.path.getmtime(cache) < fresh_seconds:
        return _text(cache)
    request = urllib.request.Request(url)
    if held and os.path.exists(tag_file) and (tag := _text(tag_file)):
        request.add_header("If-None-Match", tag)
    try:
        with opener(request) as answer:
            body, tag = answer.read().decode("utf-8"), answer.headers.get("ETag") or ""
    except urllib.error.URLError as problem:  # HTTP errors are among these
        if not held:
            raise
        if getattr(problem, "code", None) == 304:
            os.utime(cache)
        return _text(cache)
    for path, value in ((cache, body), (tag_file, tag)):  # an old tag beside new text only costs a request
        with open(f"{path}.new", "w", encoding="utf-8", newline="") as f:
            f.write(value)
        os.replace(f"{path}.new", path)
    return body


def _text(path: str) -> str:
    with open(path, encoding="utf-8", newline="") as f:
        return f.read()


def fetch_first(urls: list[str], opener: Callable = urllib.request.urlopen) -> str:
    """The first of ``urls`` that the server knows (S22); other failures are errors."""
    for i, url in enumerate(urls):
        try:
            with opener(urllib.request.Request(url)) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as problem:
            if problem.code != 404 or i == len(urls) - 1:
                raise
    raise ValueError("no URL was given")


def load_analysis(spark: SparkSession, source: str, opener: Callable = urllib.request.urlopen) -> DataFrame:
    """One analysis from a URL of an archive page, ``-`` (standard input) or a path."""
    if source.startswith("https://"):
        page = spark.createDataFrame([(source, fetch_first([source], opener))], "file_path string, value string")
        return parse_analysis(page.withColumn("value", html_data(F.col("value"))))
    if source == "-":
        return parse_analysis(spark.createDataFrame([("-", sys.stdin.read())], "file_path string, value string"))
    return parse_analysis(spark.read.text(source, wholetext=True).select("_metadata.file_path", "value"))


def unguarded(body: Column) -> Column:
    """A review server's JSON without the guard before it."""
    return F.ltrim(F.when(F.startswith(body, F.lit(JSON_GUARD)), F.substring(body, len(JSON_GUARD) + 1, 2**31 - 1)).otherwise(body))


def patchsets(changes: DataFrame, body_col: str = "body") -> DataFrame:
    """``changes`` with ``numbers``, the ascending patchset numbers of a change's JSON."""
    revisions = F.from_json(unguarded(F.col(body_col)), "revisions map<string, struct<_number:int>>")["revisions"]
    numbers = F.array_sort(F.transform(F.map_values(revisions), lambda r: r["_number"]))
    return changes.withColumn("numbers", F.coalesce(numbers, F.array().cast("array<int>")))


def cookie_for(path: str, domain: str) -> str | None:
    """``name=value`` of the last cookie for ``domain`` in a cookie file.

    It's a secret for the driver's requests and never belongs in a DataFrame.
    """
    found = None
    with open(path, encoding="utf-8") as f:
        for line in f:
            fields = re.split("\t", line.rstrip("\r\n"))
            if len(fields) == 7 and domain in line:
                found = f"{fields[5]}={fields[6]}"
    return found


def command_json(command: list[str]) -> list:
    """What a command writes as JSON to the file named by its last argument (S21); a
    command that fails, or writes no JSON, gives an empty list."""
    with tempfile.TemporaryDirectory() as folder:
        out = f"{folder}/out.json"
        done = subprocess.run([*command, out], capture_output=True, check=False)
        if done.returncode:
            return []
        try:
            return json.loads(_text(out))
        except (FileNotFoundError, json.JSONDecodeError):
            return []
