"""Diffs, compiler logs, diagnostics and source edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import normalize_error_path

# The line formats that are recognised.
ADDED_INCLUDE = r"""^\+\s*#\s*include\s+([<"])([^>"]+)[>"]"""
INCLUDE = r"""^\s*#\s*include (["<](.*)[">])"""
EDITED_INCLUDE = r"""\s*#include (["<](.*)[">])"""
DIAGNOSTIC = r"^(.+)[(:](\d+)[,:](\d+)\)?:\s+(warning|error):\s+(.*)$"
DIFF_FILE = r"^diff --git a/.+ b/(.+)$"
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$"


def lines(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, pos, line``: every line of every text, in order."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))


def include_of(line: Column) -> Column:
    """What an include line includes, without quotes; null if it is none."""
    return F.when(line.rlike(INCLUDE), F.trim(F.regexp_extract(line, INCLUDE, 1), F.lit('"')))


#: Lines of one text that a task scans together; what passes from one such part to the next is a row a part.
PART_LINES = 1 << 16


def _parts(lines: DataFrame) -> tuple[DataFrame, tuple[str, ...], bool]:
    """``lines`` with ``_part``, by ranges of ``pos``, the key of what is scanned together, and whether any text has more parts than one.

    Texts of one part are dealt by ``id`` alone, so that what is asked of a text after its scan isn't dealt again.
    """
    lines = lines.withColumn("_part", F.greatest(F.floor(F.col("pos") / PART_LINES), F.lit(0)))
    longer = not lines.filter("_part > 0").select("_part").isEmpty()
    return lines, ("id", "_part") if longer else ("id",), longer


def diff_sections(diffs: DataFrame) -> DataFrame:
    """Lines of unified diffs with ``file_no, hunk_no, file``.

    Lines before the first file are file 0, lines before a file's first hunk its
    header (hunk 0).  ``file`` is the new name that the last ``diff --git`` line gives;
    added lines that look like a header don't change it.

    A diff of any length is scanned in parts.  What the parts before one hold is summed over one row a part and goes
    before its lines as a row of its own, so that lines are dealt and sorted once.
    """
    columns = diffs.columns
    diffs, part, longer = _parts(diffs)
    is_file, is_hunk = F.col("line").startswith("diff --git"), F.col("line").startswith("@@")
    named = F.when(F.col("line").rlike(DIFF_FILE), F.regexp_extract("line", DIFF_FILE, 1))
    files, hunks, name = is_file.cast("int"), is_hunk.cast("int"), named
    if longer:
        diffs = diffs.unionByName(_before_parts(diffs, part, is_file, is_hunk, named), allowMissingColumns=True)
        files, hunks, name = F.coalesce("_files_before", files), F.coalesce("_hunks_before", hunks), F.coalesce("_name_before", named)
    order = W.partitionBy(*part).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    own = diffs.withColumn("_files", F.sum(files).over(order)).withColumn("_hunks", F.sum(hunks).over(order)).withColumn("_name", F.last(name, ignorenulls=True).over(order))
    # Hunks before the file that a line is in; those before a part's first file go on.
    own = own.withColumn("_others", F.max(F.when(is_file, F.col("_hunks"))).over(order))
    own = own.filter("_files_before is null") if longer else own
    return own.select(*columns, F.col("_files").alias("file_no"), (F.col("_hunks") - F.coalesce("_others", F.lit(0))).alias("hunk_no"), F.col("_name").alias("file"))


def _before_parts(diffs: DataFrame, part: tuple[str, ...], is_file: Column, is_hunk: Column, named: Column) -> DataFrame:
    """``id, _part, _files_before, _hunks_before, _name_before`` of all parts but a diff's first."""
    # A part's files, its last name, and its hunks since the last of its files began, or in all if none does.
    ended = diffs.filter(is_file | is_hunk | (F.col("_part") > 0)).groupBy(*part).agg(F.count_if(is_file).alias("_n"), F.max_by(named, F.when(named.isNotNull(), F.col("pos"))).alias("_last"), F.max(F.when(is_file, F.col("pos"))).alias("_at"), F.array_sort(F.collect_list(F.when(is_hunk, F.col("pos")))).alias("_all"))
    ended = ended.withColumn("_tail", F.size(F.filter("_all", lambda p: F.col("_at").isNull() | (p > F.col("_at")))))
    before = W.partitionBy("id").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    until = W.partitionBy("id").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)
    ended = ended.withColumn("_since", F.sum((F.col("_n") > 0).cast("int")).over(until))
    ended = ended.withColumn("_open", F.sum("_tail").over(W.partitionBy("id", "_since").orderBy("_part").rowsBetween(W.unboundedPreceding, 0)))
    ended = ended.select(*part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_files_before"), F.last("_last", ignorenulls=True).over(before).alias("_name_before"), F.coalesce(F.last("_open").over(before), F.lit(0)).alias("_hunks_before"))
    return ended.filter("_part > 0")


def _second_next(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_caret``: the line two after each, also where that is in a later part.

    The two lines that follow a part are lent to it.
    """
    lines, part, longer = _parts(lines)
    columns, order = lines.columns, W.partitionBy(*part).orderBy("pos")
    if longer:
        first = lines.select(*part, "pos", "line").withColumn("_k", F.row_number().over(order)).filter("_k <= 2").groupBy(*part).agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("_first"))
        # Two parts that follow, if there are so many, have two lines at least.
        parts = W.partitionBy("id").orderBy("_part")
        none = F.array().cast(first.schema["_first"].dataType)
        follows = F.concat(F.coalesce(F.lead("_first", 1).over(parts), none), F.coalesce(F.lead("_first", 2).over(parts), none))
        lent = first.select(*part, follows.alias("_f")).select(*part, F.explode(F.slice("_f", 1, 2)).alias("_l")).select(*part, "_l.pos", "_l.line", F.lit(True).alias("_lent"))
        lines = lines.unionByName(lent, allowMissingColumns=True)
    out = lines.withColumn("_caret", F.lead("line", 2).over(order))
    out = out.filter("_lent is null") if longer else out
    return out.select(*columns, "_caret").drop("_part")


def added_includes(diffs: DataFrame) -> DataFrame:
    """``id, header, file, first_pos``: files in which a diff adds each header, in order."""
    # Other lines than these don't change what file a line is in.
    told = diffs.filter(F.col("line").rlike(DIFF_FILE) | F.col("line").rlike(ADDED_INCLUDE))
    hits = diff_sections(told).filter(F.col("line").rlike(ADDED_INCLUDE) & F.col("file").isNotNull())
    header = F.regexp_extract("line", ADDED_INCLUDE, 2)
    return hits.groupBy("id", header.alias("header"), "file").agg(F.min("pos").alias("first_pos"))


def frequent_headers(added: DataFrame, at_least: int) -> DataFrame:
    """``id, header, files`` of headers added to that many files of a diff, files in order."""
    grouped = added.groupBy("id", "header").agg(F.array_sort(F.collect_list(F.struct("first_pos", "file"))).alias("f"))
    return grouped.filter(F.size("f") >= at_least).select("id", "header", F.transform("f", lambda x: x["file"]).alias("files"))


def patch_for_header(diffs: DataFrame, header: str) -> DataFrame:
    """``id, patch``: the diff cut down to the lines that add one header.

    Other added lines go, removed lines become context, hunks without a match go,
    and hunk headers count anew; diffs without a match give no row.
    """
    s = diff_sections(diffs)
    body = (F.col("hunk_no") > 0) & ~F.col("line").startswith("@@")
    match = F.col("line").rlike(ADDED_INCLUDE) & (F.regexp_extract("line", ADDED_INCLUDE, 2) == header)
    # Most files go at once; after that, lines are dealt by their file.
    s = s.withColumn("_any", F.max((body & match).cast("int")).over(W.partitionBy("id", "file_no"))).filter("_any = 1").drop("_any")
    # A hunk whose header has no numbers can't be counted anew, and goes.
    told = F.max((F.col("line").startswith("@@") & F.col("line").rlike(HUNK)).cast("int")).over(W.partitionBy("id", "file_no", "hunk_no"))
    s = s.withColumn("_told", told).filter("hunk_no = 0 or _told = 1").drop("_told")
    kept = s.filter(~body | ~F.col("line").startswith("+") | match)
    kept = kept.withColumn("line", F.when(body & F.col("line").startswith("-"), F.concat(F.lit(" "), F.substring("line", 2, 1 << 30))).otherwise(F.col("line")))
    hunk = W.partitionBy("id", "file_no", "hunk_no")
    kept = kept.withColumn("_match", F.max((body & match).cast("int")).over(hunk) == 1)
    kept = kept.withColumn("_file", F.max(F.col("_match").cast("int")).over(W.partitionBy("id", "file_no")) == 1)
    kept = kept.filter(F.col("_file") & (F.col("_match") | (F.col("hunk_no") == 0)))
    full = F.max(F.when(body & (F.col("line") != ""), F.col("pos"))).over(hunk)
    kept = kept.withColumn("_full", full).filter(~body | F.col("_full").isNull() | (F.col("pos") <= F.col("_full")))
    old = F.sum((body & ~F.col("line").startswith("+")).cast("int")).over(hunk)
    new = F.sum(body.cast("int")).over(hunk)
    start = F.regexp_extract("line", HUNK, 1)
    head = F.concat(F.lit("@@ -"), start, F.lit(","), old.cast("string"), F.lit(" +"), start, F.lit(","), new.cast("string"), F.lit(" @@"), F.regexp_extract("line", HUNK, 5))
    kept = kept.withColumn("line", F.when((F.col("hunk_no") > 0) & F.col("line").startswith("@@"), head).otherwise(F.col("line")))
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("patch"))


def caret_range(line: Column) -> tuple[Column, Column]:
    """Start and end, from 0, of the marks in a caret line (C8); null if it isn't one.

    What comes before a bar goes, with one blank after the bar; the rest is one caret,
    its tildes after it, and blanks.
    """
    piped = line.contains("|")
    marks = F.when(piped, F.regexp_replace(F.regexp_replace(line, r"^[^|]*\|", ""), "^ ", "")).otherwise(line)
    ok = marks.rlike(r"^\s*\^~*\s*$")
    start = F.length(F.regexp_extract(marks, r"^(\s*)", 1))
    end = F.length(F.regexp_replace(marks, r"\s+$", ""))
    return F.when(ok, start), F.when(ok, end)


def compile_errors(logs: DataFrame) -> DataFrame:
    """``id, pos, file, line_no, message, range_start, range_end`` of errors.

    A log of any length is read in parts.  Errors of one log that agree in all of that but ``pos`` are told once, at the first.
    """
    start, end = caret_range(F.col("_caret"))
    hits = _second_next(logs).filter(F.regexp_extract("line", DIAGNOSTIC, 4) == "error")
    part = lambda n: F.regexp_extract("line", DIAGNOSTIC, n)
    found = hits.select("id", "pos", normalize_error_path(part(1)).alias("file"), part(2).cast("int").alias("line_no"), part(5).alias("message"), start.alias("range_start"), end.alias("range_end"))
    alike = ("id", "file", "line_no", "message", "range_start", "range_end")
    return found.groupBy(*alike).agg(F.min("pos").alias("pos")).select("id", "pos", *alike[1:])


def first_errors(errors: DataFrame) -> DataFrame:
    """The first of equal errors over builds in order of ``id``."""
    first = W.partitionBy("file", "line_no", "message").orderBy("id", "pos")
    return errors.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def annotations(errors: DataFrame, build_url: str | None = None) -> DataFrame:
    """``file, line_no, message, range_start, range_end``: one note per file.

    It stands at the file's first error line and tells all errors in order of line,
    message and build, those of other lines with their number, each with the address of
    its build where ``build_url`` is given.  The range is the first one known at that line.
    """
    first = W.partitionBy("file")
    at = errors.withColumn("_first", F.min("line_no").over(first))
    quoted = F.concat(F.lit("`"), F.col("message"), F.lit("`"))
    part = F.when(F.col("line_no") == F.col("_first"), quoted).otherwise(F.concat(F.lit("Line "), F.col("line_no").cast("string"), F.lit(": "), quoted))
    if build_url is not None:
        part = F.concat(part, F.lit("\n\n" + build_url), F.col("id").cast("string"))
    has_range = (F.col("line_no") == F.col("_first")) & F.col("range_start").isNotNull()
    key = F.struct("message", "id")
    return at.withColumn("_part", part).groupBy("file").agg(
        F.min("_first").alias("line_no"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "message", "id", "range_start", "_part"))), lambda e: e["_part"]), "\n\n").alias("message"),
        F.min_by("range_start", F.when(has_range, key)).alias("range_start"),
        F.min_by("range_end", F.when(has_range, key)).alias("range_end"),
    )


def failed_builds(results: DataFrame) -> DataFrame:
    """``id`` of failed builds, less parents of failed children.

    ``results``: ``id, status, tags array<struct<key, value>>``.
    """
    failed = results.filter("status = 'FAILURE' and id is not null")
    parent = F.get(F.filter("tags", lambda t: t["key"] == "parent_buildbucket_id"), F.lit(0))["value"]
    parents = failed.select(parent.alias("_parent")).filter("_parent is not null").distinct()
    return failed.select("id").distinct().join(parents, F.col("id") == F.col("_parent"), "left_anti")


def diagnostics_to_changes(diagnostics: DataFrame) -> DataFrame:
    """``change_type, line, includer, header`` from language-server diagnostics.

    ``diagnostics``: ``file, code, line, text`` with the source line of an unused
    include or the new text of a missing one.  Adds are a set, removes a list.
    """
    header = F.trim(F.regexp_extract("text", INCLUDE, 1), F.lit('"'))
    rows = diagnostics.filter(F.col("text").rlike(INCLUDE)).select(F.col("code"), "line", F.col("file").alias("includer"), header.alias("header"))
    removes = rows.filter("code = 'unused-includes'").select(F.lit("remove").alias("change_type"), "line", "includer", "header")
    adds = rows.filter("code = 'missing-includes'").select(F.lit("add").alias("change_type"), "line", "includer", "header").distinct()
    return adds.unionByName(removes)


def language_id(name: Column) -> Column:
    """The language of a file name; an unknown extension is an error."""
    ends = lambda *found: F.regexp_like(name, F.lit(r"\.(" + "|".join(found) + ")$"))
    return (
        F.when(ends("h", "hh", "hpp", "hpp11", "hxx", "cc", "cpp", "cxx"), "cpp").when(ends("c"), "c").when(ends("mm"), "objective-cpp")
        .otherwise(F.raise_error(F.concat(F.lit("unknown language: "), name)))
    )


def first_changes(changes: DataFrame, max_count: int) -> DataFrame:
    """The first ``max_count`` changes of a known type, in order of ``pos`` (L8); 0 is no limit."""
    known = changes.filter(F.col("change_type").isin("add", "remove"))
    return known.orderBy("pos").limit(max_count) if max_count else known


def _source_lines(sources: DataFrame) -> DataFrame:
    """``file, pos, line, ended``: lines as a text file has them, ended by ``\\n``, ``\\r\\n`` or ``\\r`` alone."""
    parts = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n")
    rows = sources.select("file", F.size(parts).alias("_n"), F.posexplode(parts).alias("pos", "line"))
    ended = F.col("pos") < F.col("_n") - 1
    return rows.filter(ended | (F.col("line") != "")).select("file", "pos", "line", ended.alias("ended"))


def apply_changes(sources: DataFrame, changes: DataFrame) -> DataFrame:
    """``file, text``: sources with their changes applied in order of line, then of ``pos``.

    ``sources``: ``file, text``; ``changes``: ``pos, change_type, line, includer,
    header``, where lines are those of the source as it was.  A removal takes its line out
    if that includes just its header; a line beyond the text is an error.  An addition goes
    before its line, or in the place of a line that is gone, unless the same include
    stands anywhere in the text as changed up to then.  Files without changes stay as
    they are; in others lines end in a line feed.

    What an addition finds is a count: how often its line is in the source, less the
    removals before it.  So all decisions are joins and windows over a file's equal lines,
    and one merge of kept and added lines gives the text.
    """
    stripped = F.regexp_replace("line", r"(?U)^\s+|\s+$", "")
    rows = _source_lines(sources).withColumn("_told", stripped)
    edits = changes.filter(F.col("change_type").isin("add", "remove")).select(F.col("includer").alias("_file"), "change_type", F.col("line").alias("_line"), "header", "pos")
    edits = edits.join(sources.select("file").distinct(), F.col("_file") == F.col("file"), "left_semi")
    edits = edits.select("*", F.row_number().over(W.partitionBy("_file").orderBy("_line", "pos")).alias("_turn")).drop("pos")

    at = (F.col("_file") == F.col("file")) & (F.col("_line") == F.col("pos"))
    beyond = F.raise_error(F.concat(F.lit("no line "), F.col("_line").cast("string"), F.lit(" in "), F.col("_file")))
    asked = edits.filter("change_type = 'remove'").join(rows, at, "left").withColumn("_told", F.coalesce("_told", beyond))
    named = F.trim(F.regexp_extract("_told", "^" + EDITED_INCLUDE, 1), F.lit('"'))
    gone = asked.filter(F.col("_told").rlike("^" + EDITED_INCLUDE) & (named == F.col("header")))
    gone = gone.groupBy("_file", "_line").agg(F.min("_turn").alias("_turn"), F.first("_told").alias("_told"))

    include = F.concat(F.lit("#include "), F.when(F.col("header").startswith("<"), F.col("header")).otherwise(F.concat(F.lit('"'), F.col("header"), F.lit('"'))))
    adds = edits.filter("change_type = 'add'").select("_file", "_line", "_turn", include.alias("_told"))
    present = rows.filter(F.col("_told").startswith("#include ")).groupBy(F.col("file").alias("_file"), "_told").agg(F.count("*").alias("_more"))
    events = adds.select("_file", "_told", "_turn", "_line", F.lit(0).cast("long").alias("_more"))
    events = events.unionByName(present.select("_file", "_told", F.lit(0).alias("_turn"), F.lit(None).cast("int").alias("_line"), "_more"))
    events = events.unionByName(gone.select("_file", "_told", "_turn", F.lit(None).cast("int").alias("_line"), F.lit(-1).cast("long").alias("_more")))
    so_far = F.sum("_more").over(W.partitionBy("_file", "_told").orderBy("_turn").rowsBetween(W.unboundedPreceding, 0))
    # The first addition that finds none is made; those after it find it.
    made = events.withColumn("_have", so_far).filter("_line is not null and _have = 0").groupBy("_file", "_told").agg(F.min(F.struct("_turn", "_line")).alias("_a"))
    made = made.select(F.col("_file").alias("file"), F.col("_a._line").alias("pos"), F.lit(0).alias("_kind"), F.col("_a._turn").alias("_turn"), F.concat("_told", F.lit("\n")).alias("_out"))

    kept = rows.join(gone.select(F.col("_file").alias("_f"), F.col("_line").alias("_l")), (F.col("file") == F.col("_f")) & (F.col("pos") == F.col("_l")), "left_anti")
    kept = kept.select("file", "pos", F.lit(1).alias("_kind"), F.lit(0).alias("_turn"), F.when(F.col("ended"), F.concat("line", F.lit("\n"))).otherwise(F.col("line")).alias("_out"))
    merged = kept.unionByName(made).groupBy(F.col("file").alias("_file")).agg(F.sort_array(F.collect_list(F.struct("pos", "_kind", "_turn", "_out"))).alias("_rows"))
    merged = merged.select("_file", F.array_join(F.transform("_rows", lambda r: r["_out"]), "").alias("_text"))
    edited = edits.select(F.col("_file").alias("_changed")).distinct()
    out = sources.select("file", "text").join(edited, F.col("file") == F.col("_changed"), "left").join(merged, F.col("file") == F.col("_file"), "left")
    return out.select("file", F.when(F.col("_changed").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.coalesce("_text", F.lit(""))).alias("text"))
