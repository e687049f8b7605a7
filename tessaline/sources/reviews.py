"""Changes of a review server: details, patchsets and patches, fetched by the executors."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .remote import unguarded

#: What is read of a change's details; others stay in their JSON.
DETAILS = "project string, branch string, subject string, status string, revisions map<string, struct<_number:int>>"


def change_details(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """``bodies`` with ``project, branch, subject, status, numbers`` of a change's JSON, guarded or not.

    ``numbers`` are its patchsets, ascending, and empty where it tells none.  What the JSON
    lacks is null; a body that is null or no JSON has nulls and no patchsets.
    """
    told = bodies.withColumn("_told", F.from_json(unguarded(F.col(body_col)), DETAILS))
    numbers = F.array_sort(F.transform(F.map_values("_told.revisions"), lambda r: r["_number"]))
    told = told.select("*", *(F.col(f"_told.{name}").alias(name) for name in ("project", "branch", "subject", "status")), F.coalesce(numbers, F.array().cast("array<int>")).alias("numbers"))
    return told.drop("_told")


def change_url(server: str, change: Column | str) -> Column:
    """The address of a change, whose id may hold any character."""
    change = F.col(change) if isinstance(change, str) else change
    # A form's encoding has plus signs for spaces, and stars and tildes the other way round.
    quoted = F.replace(F.replace(F.replace(F.url_encode(change), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit(server.rstrip("/") + "/a/changes/"), quoted)


def patch_url(server: str, change: Column | str, revision: Column) -> Column:
    """The address of a patchset's raw patch."""
    return F.concat(change_url(server, change), F.lit("/revisions/"), revision, F.lit("/patch?raw"))


def fetched(requests: DataFrame, url_col: str, out_col: str, cookie: str | None = None, connections: int = 8, missing_ok: bool = False) -> DataFrame:
    """``requests`` with ``out_col``, the text at each row's address; a null address has none.

    ``connections`` tasks ask at once, each an address at a time; a task that is lost asks
    again.  A failure is an error, or with ``missing_ok`` a null where the server knows no such
    address.  ``cookie`` goes with the tasks' code and never becomes a column.
    """

    def read(url: str | None) -> str | None:
        if url is None:
            return None
        request = urllib.request.Request(url, headers={"Cookie": cookie} if cookie else {})
        try:
            with urllib.request.urlopen(request) as answer:
                return answer.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as problem:
            if problem.code == 404 and missing_ok:
                return None
            raise RuntimeError(f"{url}: {problem.code} {problem.read().decode('utf-8', 'replace')[:500]}") from None

    def tasks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(len(frame)):  # a row at a time, so that a task holds one answer
                row = frame.iloc[at : at + 1]
                yield row.assign(**{out_col: [read(url) for url in row[url_col]]})

    schema = requests.select("*", F.lit(None).cast("string").alias(out_col)).schema
    return requests.repartition(connections).mapInPandas(tasks, schema)


def read_changes(server: str, changes: DataFrame, cookie: str | None = None, connections: int = 8) -> DataFrame:
    """``change`` ids with their details and ``patch``, that of the current revision, by two requests each.

    Repeated ids are asked for once.
    """
    ids = changes.select("change").filter("change is not null").distinct()
    ids = ids.withColumn("_url", F.concat(change_url(server, "change"), F.lit("?o=ALL_REVISIONS"))).withColumn("_patch", patch_url(server, "change", F.lit("current")))
    told = change_details(fetched(ids, "_url", "_body", cookie, connections), "_body")
    return fetched(told.drop("_body", "_url"), "_patch", "patch", cookie, connections).drop("_patch")


def read_patchsets(server: str, details: DataFrame, cookie: str | None = None, connections: int = 8) -> DataFrame:
    """``change, number, patch`` of every patchset in ``change, numbers``; one that the server dropped has no patch."""
    each = details.select("change", F.explode("numbers").alias("number"))
    each = each.withColumn("_patch", patch_url(server, "change", F.col("number").cast("string")))
    return fetched(each, "_patch", "patch", cookie, connections, missing_ok=True).drop("_patch")
