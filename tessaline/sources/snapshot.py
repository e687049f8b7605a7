"""An analysis too large for one task, read and written as a stream of values.

The text of an analysis is one long line.  Spark's text source cuts it at commas, so byte
ranges of one file go to many tasks.  What a range's text does to the place in the document
(how far lists close and open, how many commas each has, whether a string is open) depends
on the text before it only by whether that ends within a string, so a first pass tells both
cases for every range; those are combined in order, and a second pass, which knows the place
where each range begins, gives the values themselves.  A file of one range needs no first pass.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_folder

SPLIT_BYTES = 32 << 20
ELEMENTS = "url string, key string, i long, j long, value string"
BY_FILE = ("files", "includes", "included_by", "sizes", "tsizes", "asizes", "esizes", "prevalence")
KEYS = ("revision", "date", "roots", *BY_FILE)
START = b"data = {"

_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_MARK = np.zeros(256, bool)
_MARK[list(b"[]{},:")] = True
_COMMA, _COLON, _LIST = ord(","), ord(":"), ord("[")


@dataclass
class Effect:
    """What a text does to the place: ``popped`` levels close, ``count`` commas and a ``key``
    come on the level below those, and ``pushed`` levels ``[commas, key]`` stay open.  ``head``
    is the text after the last mark; without any mark (not ``fresh``) it continues a value."""

    inside: int
    popped: int = 0
    count: int = 0
    key: bytes | None = None
    pushed: list[list] = field(default_factory=list)
    fresh: bool = False
    head: bytes = b""


@dataclass
class Place:
    """Where a text begins: the open levels ``[commas, key]``, and the value begun before it."""

    levels: list[list] = field(default_factory=list)
    inside: int = 0
    head: bytes = b""


def marks(text: bytes) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], int]:
    """The bytes, the places of marks outside strings (if the text begins outside or inside
    of one), and whether quotes are odd.  A text never begins after a backslash."""
    data = np.frombuffer(text, np.uint8)
    quotes = data == ord('"')
    if b"\\" in text:
        quotes[[m.start() + 1 for m in re.finditer(rb"(?s)\\.", text)]] = False
    odd = np.cumsum(quotes, dtype=np.uint8) & 1
    at = np.flatnonzero(_MARK[data])
    within = odd[at]
    return data, (at[within == 0], at[within == 1]), int(odd[-1]) if len(odd) else 0


def effects(text: bytes) -> tuple[Effect, Effect]:
    """The effect of ``text`` if it begins outside of a string, and inside of one."""
    data, outside, odd = marks(text)
    return _effect(text, data, outside[0], odd), _effect(text, data, outside[1], 1 - odd)


def _effect(text: bytes, data: np.ndarray, at: np.ndarray, inside: int) -> Effect:
    if not len(at):
        return Effect(inside, head=text)
    found, step = data[at], _STEP[data[at]].astype(np.int64)
    depth = np.cumsum(step)
    low, end = min(0, int(depth.min())), int(depth[-1])
    levels = []
    for level in range(low, end + 1):
        here = depth == level
        if level > low:
            here[: np.flatnonzero(here & (step == 1))[-1]] = False
        colons = np.flatnonzero(here & (found == _COLON))
        key = text[at[colons[-1] - 1] + 1 if colons[-1] else 0 : at[colons[-1]]].strip() if len(colons) else None
        levels.append([int(np.count_nonzero(here & (found == _COMMA))), key])
    return Effect(inside, -low, levels[0][0], levels[0][1], levels[1:], True, text[at[-1] + 1 :])


def combine(first: tuple[Effect, Effect], then: tuple[Effect, Effect]) -> tuple[Effect, Effect]:
    """The effect of one text after another; it doesn't matter which of several are combined first."""
    return _after(first[0], then), _after(first[1], then)


def _after(a: Effect, then: tuple[Effect, Effect]) -> Effect:
    b = then[a.inside]
    kept = len(a.pushed) - b.popped
    levels = [[a.count, a.key], *map(list, a.pushed[: max(kept, 0)])] if kept >= 0 else [[0, None]]
    levels[-1] = [levels[-1][0] + b.count, levels[-1][1] if b.key is None else b.key]
    levels += map(list, b.pushed)
    return Effect(b.inside, a.popped + max(-kept, 0), levels[0][0], levels[0][1], levels[1:], a.fresh or b.fresh, b.head if b.fresh else a.head + b.head)


def moved(place: Place, by: tuple[Effect, Effect] | dict[int, Effect], url: str) -> Place:
    """``place`` after a text of that effect; more closed than open is an error."""
    e = by[place.inside]
    kept = len(place.levels) - e.popped
    if kept < 0:
        raise ValueError(f"no analysis in {url}: more is closed than open")
    levels = [list(level) for level in place.levels[:kept]]
    if levels:
        levels[-1] = [levels[-1][0] + e.count, levels[-1][1] if e.key is None else e.key]
    return Place(levels + [list(level) for level in e.pushed], e.inside, e.head if e.fresh else place.head + e.head)


def ended(place: Place, url: str) -> None:
    """An analysis that ends in the midst of something is an error."""
    if place.levels or place.inside:
        raise ValueError(f"no analysis in {url}: it ends too early")


def _name(key: bytes | None) -> str | None:
    return json.loads(key) if key and key[:1] == b'"' else None


def _since(place: Place, level: int, found: np.ndarray, step: np.ndarray, after: np.ndarray) -> np.ndarray:
    """At each mark, the commas of the level's list since it opened."""
    comma = (found == _COMMA) & (after == level)
    before = np.cumsum(comma) - comma
    opened = np.maximum.accumulate(np.where((step == 1) & (after == level), np.arange(len(found)), -1))
    held = place.levels[level - 1][0] if len(place.levels) >= level else 0
    return before - np.where(opened >= 0, before[opened], -held)


def values(place: Place, text: bytes, keys: Iterable[str]) -> Iterator[tuple[str, int | None, int | None, bytes | None]]:
    """``key, i, j, value`` of the values under ``keys`` that end in ``text``, and a row
    without ``j`` and value for each list that opens there."""
    data, outside, _ = marks(text)
    at = outside[place.inside]
    if not len(at):
        return
    found, step = data[at], _STEP[data[at]].astype(np.int64)
    after = len(place.levels) + np.cumsum(step)
    depth = after - step
    begin = np.concatenate([[0], at[:-1] + 1])
    colons = (found == _COLON) & (after == 1)
    names = [_name(place.levels[0][1]) if place.levels else None]
    names += [_name((place.head if k == 0 else b"") + text[begin[k] : at[k]].strip()) for k in np.flatnonzero(colons)]
    named = np.cumsum(colons)
    keys = set(keys)
    wanted = np.array([n in keys for n in names])[named]
    i, j = (_since(place, level, found, step, after) for level in (2, 3))
    filled = at > begin
    filled[0] |= bool(place.head)
    lists = (found == _LIST) & (depth <= 2)
    scalars = filled & ((found == _COMMA) | (step == -1))
    for k in np.flatnonzero(wanted & (lists | scalars) & (depth >= 1) & (depth <= 3)).tolist():
        value = None
        if not lists[k]:
            value = ((place.head if k == 0 else b"") + text[begin[k] : at[k]]).strip()
            if not value:
                continue
            value = None if value == b"null" else value if value[:1] != b'"' else json.loads(value).encode() if b"\\" in value else value[1:-1]
        level = int(depth[k])
        yield names[named[k]], int(i[k]) if level > 1 else None, int(j[k]) if level > 2 else None, value


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, bool, bytes]]:
    """``url, start, opens, whole, text``: the text of each batch and range in order; ``opens``
    where a range begins, ``whole`` where its file has no other."""
    last = None
    for batch in batches:
        urls, starts, wholes = (batch.column(c).to_pylist() for c in ("url", "start", "whole"))
        tokens, begin = batch.column("value"), 0
        for k in range(1, len(urls) + 1):
            if k == len(urls) or starts[k] != starts[begin] or urls[k] != urls[begin]:
                here = (urls[begin], starts[begin])
                text = ",".join(tokens.slice(begin, k - begin).to_pylist()).encode()
                # A comma parts this text from the one before it, but for a file's first.
                yield *here, here != last, wholes[begin], text if here != last and not here[1] else b"," + text
                last, begin = here, k


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for url, start, opens, _, text in _texts(batches):
        if opens:
            rows.append((url, start, effects(text)))
        else:
            rows[-1] = (url, start, combine(rows[-1][2], effects(text)))
    columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2][0].inside for r in rows], pa.int64())]
    columns += [pa.array([pickle.dumps(r[2][k]) for r in rows], pa.binary()) for k in (0, 1)]
    yield pa.RecordBatch.from_arrays(columns, names=["url", "start", "odd", "outside", "inside"])


def _reader(places: dict[tuple[str, int], Place], keys: tuple[str, ...]):
    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, open_whole = Place(), None
        for url, start, opens, whole, text in _texts(batches):
            if opens:
                if open_whole:
                    ended(place, open_whole)
                if start == 0 and not text.startswith(START):
                    raise ValueError(f"no analysis in {url}")
                place, open_whole = (Place() if start == 0 else places[url, start]), url if whole else None
            rows = list(values(place, text, keys))
            place = moved(place, effects(text), url)
            if rows:
                key, i, j, value = zip(*rows)
                columns = [pa.array([url] * len(rows), pa.string()), pa.array(key, pa.string()), pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(value, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["url", "key", "i", "j", "value"])
        if open_whole:
            ended(place, open_whole)

    return read


def read_elements(spark: SparkSession, path: str, keys: Iterable[str] = KEYS, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """``url, key, i, j, value``: every value of the analyses under ``path``, by its place.

    A value of a list has its number ``i``, one of a list of lists ``i`` and ``j``; a list's
    own row has no ``j`` and no value, so that empty lists show too.  Only ``keys`` are read
    out.  A file larger than ``split_bytes`` is read by several tasks.  The driver holds the
    places where ranges begin: one for each further range of a file, as many as the scan has
    tasks.  A file that isn't ``data = {...}`` to its end, or is cut off, is an error; null
    values stay null; what follows the closing brace doesn't count; line breaks between values
    are white space.  The values, and what each range does, are written once (``spark.checkpoint.dir``).
    """
    session = spark.newSession()  # with its own ways of cutting files, the same in both passes
    for name, value in {"maxPartitionBytes": split_bytes, "minPartitionNum": 1, "openCostInBytes": min(4 << 20, split_bytes)}.items():
        session.conf.set(f"spark.sql.files.{name}", str(value))
    meta = "_metadata.file_path as url", "_metadata.file_block_start as start", "_metadata.file_block_length = _metadata.file_size as whole"
    tokens = session.read.option("lineSep", ",").text(path).selectExpr(*meta, "value")
    summaries = "url string, start long, odd long, outside binary, inside binary"
    ranges = materialize(tokens.filter("not whole").mapInArrow(_summaries, summaries), "ranges", spark=spark)
    # A range that begins within no string would be all text if it did, so only the effect that it has goes to the driver.
    begins, within = [], {}
    for url, start, odd in sorted(ranges.select("url", "start", "odd").collect()):
        begins.append((url, start, within.get(url, 0)))
        within[url] = within.get(url, 0) ^ odd
    begun = spark.createDataFrame(begins, "_url string, _start long, _inside long")
    told = ranges.join(F.broadcast(begun), (F.col("url") == F.col("_url")) & (F.col("start") == F.col("_start")))
    told = told.select("url", "start", F.when(F.col("_inside") == 1, F.col("inside")).otherwise(F.col("outside")).alias("effect")).collect()
    places: dict[tuple[str, int], Place] = {}
    for url, found in groupby(sorted(told, key=lambda r: (r["url"], r["start"])), key=lambda r: r["url"]):
        place = Place()
        for r in found:
            places[url, r["start"]] = place
            place = moved(place, {place.inside: pickle.loads(r["effect"])}, url)
        ended(place, url)
    return materialize(tokens.mapInArrow(_reader(places, tuple(keys)), ELEMENTS), "elements", spark=spark)


def files_of(elements: DataFrame) -> DataFrame:
    """``url, file_id, file, is_root, size, tsize, asize, prevalence`` (D2), in one shuffle."""
    lists = {"files": "file", "sizes": "size", "tsizes": "tsize", "asizes": "asize", "prevalence": "prevalence"}
    at = F.when(F.col("key") == "roots", F.col("value").cast("long")).otherwise(F.col("i"))
    rows = elements.filter(F.col("key").isin(*lists, "roots") & F.col("i").isNotNull()).select("url", at.alias("file_id"), "key", "value")
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    grouped = rows.groupBy("url", F.col("file_id").cast("int").alias("file_id")).agg(
        of("files").alias("file"), F.max(F.col("key") == "roots").alias("is_root"), *(of(k).cast("long").alias(n) for k, n in lists.items() if k != "files")
    )
    return grouped.filter("file is not null").select("url", "file_id", "file", "is_root", "size", "tsize", "asize", "prevalence")


def edges_of(elements: DataFrame) -> DataFrame:
    """``url, src_id, dst_id, src, dst, pos, esize``: sizes go with includes by position."""
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    rows = elements.filter(F.col("key").isin("includes", "esizes") & F.col("j").isNotNull()).groupBy("url", "i", "j").agg(of("includes").cast("int").alias("dst_id"), of("esizes").cast("long").alias("esize"))
    rows = rows.filter("dst_id is not null").select("url", F.col("i").cast("int").alias("src_id"), "dst_id", F.col("j").cast("int").alias("pos"), "esize")
    names = elements.filter("key = 'files' and i is not null").select(F.col("url").alias("_u"), F.col("i").cast("int").alias("_id"), F.col("value").alias("_name"))
    for end in ("src", "dst"):
        rows = rows.join(names, (F.col("url") == F.col("_u")) & (F.col(f"{end}_id") == F.col("_id"))).withColumnRenamed("_name", end).drop("_u", "_id")
    return rows.select("url", "src_id", "dst_id", "src", "dst", "pos", "esize")


def load_problems(elements: DataFrame) -> DataFrame:
    """``url, problems``: what :func:`analysis.load_problems` says, from values.

    Pairs are compared by their number and two sums of hashes, so that every check but
    those of repeats is one aggregate with partial sums.
    """
    key, number = F.col("key"), F.col("value").cast("long")
    entry, inner = F.col("i").isNotNull() & F.col("j").isNull(), F.col("j").isNotNull()

    def pairs(of: str, a, b, name: str) -> list:
        h = F.when((key == of) & inner, F.xxhash64(a, b))
        return [F.struct(F.count(h), F.coalesce(F.sum(h.bitwiseAND((1 << 31) - 1)), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))).alias(name)]

    names = key.isin("roots") & entry | key.isin("includes", "included_by") & inner
    told = elements.groupBy("url").agg(
        *(F.count_if((key == k) & entry).alias(f"n_{k}") for k in BY_FILE), *(F.count_if((key == k) & F.col("i").isNull()).alias(f"has_{k}") for k in BY_FILE),
        F.max(F.when(names, number)).alias("most"), F.min(F.when(names, number)).alias("least"),
        *pairs("includes", F.col("i"), number, "forward"), *pairs("included_by", number, F.col("i"), "backward"),
        *pairs("includes", F.col("i"), F.col("j"), "places"), *pairs("esizes", F.col("i"), F.col("j"), "size_places"),
    )
    twice = elements.filter(key.isin("files", "roots") & entry).groupBy("url", "key", "value").count().filter("count > 1")
    twice = twice.groupBy(F.col("url").alias("_u")).agg(*(F.max(key == k).alias(f"twice_{k}") for k in ("files", "roots")))
    n = F.col("n_files")
    uneven = F.lit(False)
    for k in BY_FILE:
        uneven = uneven | (F.col(f"n_{k}") != n) | (F.col(f"has_{k}") == 0)
    checks = {
        "file names repeat": F.col("twice_files"), "roots repeat": F.col("twice_roots"), "lists differ in length": uneven,
        "numbers name no file": (F.col("least") < 0) | (F.col("most") >= n), "sizes don't go with includes": F.col("places") != F.col("size_places"),
        "included_by doesn't agree with includes": F.col("forward") != F.col("backward"),
    }
    return told.join(twice, F.col("url") == F.col("_u"), "left").select("url", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))).alias("problems"))


def write_snapshot(files: DataFrame, edges: DataFrame, path: str, revision: str = "", date: str = "") -> None:
    """The analysis of ``file_id, file, is_root, size, tsize, asize, prevalence`` and of
    ``src_id, dst_id, pos, esize`` as one file in the folder ``path`` (D1).

    File numbers and the positions of a file's includes run from 0 without gaps, and a file
    includes another once.  Values are sorted over all tasks; one task streams them into the
    file, holding a value at a time.  The sorted values are a checkpoint.
    """
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    n = files.count()
    sections: list[DataFrame] = []

    def section(key: str, rows: DataFrame, i, j, text) -> None:
        sections.append(rows.select(F.lit(KEYS.index(key)).alias("k"), i.cast("long").alias("i"), j.cast("long").alias("j"), text.alias("text")))

    def framed(key: str, text, first, last):
        text = F.concat(F.when(first, F.lit(f'"{key}":[')).otherwise(F.lit("")), text, F.when(last, F.lit("]")).otherwise(F.lit("")))
        return F.concat(text, F.when(last, F.lit("}")).otherwise(F.lit(""))) if key == KEYS[-1] else text

    spark, none, at = files.sparkSession, F.lit(0), F.col("file_id")
    one = spark.range(1)
    section("revision", one, none, none, F.concat(F.lit('data = {"revision":'), quoted(F.lit(revision))))
    section("date", one, none, none, F.concat(F.lit('"date":'), quoted(F.lit(date))))
    roots = files.filter("is_root")
    ends = roots.agg(F.min("file_id").alias("_first"), F.max("file_id").alias("_last"))  # one row
    section("roots", roots.join(F.broadcast(ends), at.between(F.col("_first"), F.col("_last"))), at, none, framed("roots", at.cast("string"), at == F.col("_first"), at == F.col("_last")))
    section("roots", ends.filter("_first is null"), none, none, F.lit('"roots":[]'))
    for key, name in {"files": "file", "sizes": "size", "tsizes": "tsize", "asizes": "asize", "prevalence": "prevalence"}.items():
        text = quoted(F.col(name)) if name == "file" else F.coalesce(F.col(name).cast("string"), F.lit("null"))
        section(key, files, at, none, framed(key, text, at == 0, at == n - 1))
    for key, (owner, order, value) in {"includes": ("src_id", "pos", "dst_id"), "included_by": ("dst_id", "src_id", "src_id"), "esizes": ("src_id", "pos", "esize")}.items():
        rows = edges.select(F.col(owner).alias("_at"), F.col(order).alias("_order"), F.coalesce(F.col(value).cast("string"), F.lit("null")).alias("_value"))
        within = rows.groupBy(F.col("_at").alias("_of")).agg(F.min("_order").alias("_first"), F.max("_order").alias("_last"))
        rows = files.select("file_id").join(within, at == F.col("_of"), "left").join(rows, at == F.col("_at"), "left")
        first, last = F.coalesce(F.col("_order") == F.col("_first"), F.lit(True)), F.coalesce(F.col("_order") == F.col("_last"), F.lit(True))
        text = F.concat(F.when(first, F.lit("[")).otherwise(F.lit("")), F.coalesce("_value", F.lit("")), F.when(last, F.lit("]")).otherwise(F.lit("")))
        section(key, rows, at, F.coalesce("_order", none), framed(key, text, first & (at == 0), last & (at == n - 1)))
    if n == 0:
        for key in BY_FILE:
            section(key, one, none, none, F.lit(f'"{key}":[]' + ("}" if key == KEYS[-1] else "")))
    out = sections[0]
    for more in sections[1:]:
        out = out.unionByName(more)
    shared_folder(spark)
    ordered = out.orderBy("k", "i", "j").select("text").checkpoint()  # so that the task that writes sorts nothing
    ordered.coalesce(1).write.option("lineSep", ",").text(path)
