"""An archive of analyses behind an index page, as a data source of one partition a snapshot.

The index is read once, when a query is planned; dates in the links decide which snapshots
are asked for at all, and tasks fetch those, each telling the entity tag that is known of
its page.  What has been landed isn't fetched again unless the server says that it changed.
"""

from __future__ import annotations

import datetime
import json
import re
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from .analysis import LINKS, html_data, parse_analysis

FORMAT = "snapshot_archive"
SCHEMA = "url string, stamp timestamp, tag string, html string"
# Fixed value: the date in a snapshot's name.
STAMP = re.compile(r"includes_(\d+-\d+-\d+_\d+)")


def stamp_of(url: str) -> datetime.datetime | None:
    found = STAMP.search(url)
    try:
        return datetime.datetime.strptime(found[1], "%Y-%m-%d_%H%M%S").replace(tzinfo=datetime.timezone.utc) if found else None
    except ValueError:
        return None


@dataclass
class Snapshot(InputPartition):
    url: str
    stamp: datetime.datetime
    tag: str | None


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.index, self.known = options["index"], json.loads(options.get("known", "{}"))
        self.since: datetime.datetime | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802 (the interface's name)
        """Lower bounds of the date decide what is fetched; all filters are still applied after."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("stamp",) and isinstance(f.value, datetime.datetime):
                bound = f.value if f.value.tzinfo else f.value.replace(tzinfo=datetime.timezone.utc)
                self.since = max(self.since, bound) if self.since else bound
            yield f

    def partitions(self) -> list[Snapshot]:
        with urllib.request.urlopen(self.index) as answer:
            page = answer.read().decode("utf-8")
        urls = [urllib.parse.urljoin(self.index, link) for link in dict.fromkeys(re.findall(LINKS, page))]
        dated = [(url, stamp_of(url)) for url in urls]
        return [Snapshot(url, stamp, self.known.get(url)) for url, stamp in dated if stamp and (self.since is None or stamp >= self.since)]

    def read(self, partition: Snapshot) -> Iterator[tuple]:
        request = urllib.request.Request(partition.url)
        if partition.tag:
            request.add_header("If-None-Match", partition.tag)
        try:
            with urllib.request.urlopen(request) as answer:
                yield partition.url, partition.stamp, answer.headers.get("ETag"), answer.read().decode("utf-8")
        except urllib.error.HTTPError as problem:
            if problem.code != 304:
                raise


class ArchiveSource(DataSource):
    """Options: ``index``, the index page's address, and ``known``, tags by address as JSON."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archive(spark: SparkSession, index: str, since: str | None = None, known: dict[str, str] | None = None) -> DataFrame:
    """``url, stamp, tag, html`` of the dated snapshots that the page at ``index`` links.

    Only those from ``since`` on (a timestamp, UTC) are fetched, and those whose tag is
    ``known`` come only if they changed.
    """
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format(FORMAT).option("index", index).option("known", json.dumps(known or {})).load()
    return found if since is None else found.filter(F.col("stamp") >= F.lit(since).cast("timestamp"))


def update_archive(spark: SparkSession, index: str, folder: str, since: str | None = None) -> DataFrame:
    """All snapshots landed in ``folder``, after those that are new or have changed were added.

    A snapshot fetched anew stands for the older one.  ``known`` is a row a snapshot.
    """
    try:
        landed = spark.read.schema(SCHEMA + ", landed timestamp").parquet(folder)
        known = {r["url"]: r["tag"] for r in landed.groupBy("url").agg(F.max_by("tag", "landed").alias("tag")).collect() if r["tag"]}
    except AnalysisException:
        known = {}
    read_archive(spark, index, since, known).withColumn("landed", F.current_timestamp()).write.mode("append").parquet(folder)
    landed = spark.read.schema(SCHEMA + ", landed timestamp").parquet(folder)
    newest = landed.groupBy(F.col("url").alias("_url")).agg(F.max("landed").alias("_landed"))
    return landed.join(newest, (F.col("url") == F.col("_url")) & (F.col("landed") == F.col("_landed")), "left_semi").drop("landed")


def analyses_of(snapshots: DataFrame) -> DataFrame:
    """The analyses in the pages of :func:`read_archive` or :func:`update_archive`, with ``stamp``."""
    dates = snapshots.select(F.col("url").alias("_url"), "stamp")
    parsed = parse_analysis(snapshots.select(F.col("url").alias("file_path"), html_data(F.col("html")).alias("value")))
    return parsed.join(dates, F.col("url") == F.col("_url")).drop("_url")
