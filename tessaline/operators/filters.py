"""Rule-based filtering of include changes (F1-F12, F14-F25) and path resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The path classes that results depend on.
GENERATED = r"^out/[\w-]+/gen/.*$"
MOJOM = r"^(.*)\.mojom[^\.]*\.h$"
THIRD_PARTY = r"^(?:third_party\/(?!blink)|v8).*$"
TOOLING = r"^(?:buildtools|build|third_party/llvm-build)/"
SOURCE_FRAGMENTS = (".sigs", ".def", ".gen", ".inc", ".inl", ".s", ".sksl", ".S")
LIBRARY_PARTS = ("third_party/libc++/", "/usr/include/c++/")
OWN_EXCLUDED = ("out/", "buildtools/", "build/", "third_party/", "v8/")
OWN_EXCEPTION = "third_party/blink/"


def at_start(column: Column, pattern: str) -> Column:
    """A user's pattern holds at the start only."""
    return column.rlike(f"^(?:{pattern})")


def keep_filename(name: Column, pattern: str | None = None, generated=False, mojom=False, third_party=False) -> Column:
    """Whether a file is analysed at all (F1)."""
    keep = ~name.rlike(TOOLING)
    for suffix in SOURCE_FRAGMENTS:
        keep = keep & ~name.endswith(suffix)
    for part in LIBRARY_PARTS:
        keep = keep & ~name.contains(part)
    if pattern:
        keep = keep & at_start(name, pattern)
    for wanted, rule in ((generated, GENERATED), (mojom, MOJOM), (third_party, THIRD_PARTY)):
        if wanted:
            keep = keep & ~name.rlike(rule)
    return keep


def own_file(name: Column) -> Column:
    """Files outside the excluded trees (prefix rule of F16, F17)."""
    out = F.lit(False)
    for p in OWN_EXCLUDED:
        out = out | name.startswith(p)
    return ~out | name.startswith(OWN_EXCEPTION)


def prevalent_headers(files: DataFrame, n_roots: int, above: float, up_to: float = 100.0) -> DataFrame:
    """Own headers that more than ``above`` percent of the roots reach, and ``up_to`` at most (F16)."""
    count = F.col("prevalence")
    return files.filter((count > above / 100.0 * n_roots) & (count <= up_to / 100.0 * n_roots) & F.col("file").endswith(".h") & own_file(F.col("file")))


def prevalent_subset(files: DataFrame, n_roots: int, at_least: float) -> DataFrame:
    """``node``: own files of at least that prevalence, headers or not; unknown counts as 0."""
    share = F.lit(100.0) * F.coalesce("prevalence", F.lit(0)) / F.lit(n_roots)
    return files.filter(own_file(F.col("file")) & (share >= at_least)).select(F.col("file").alias("node"))


def in_both(ignores: DataFrame, removes: DataFrame) -> DataFrame:
    """``src, dst`` that are ignored and removed, which loaders warn about (F23, X2); they count as removed."""
    return ignores.select("src", "dst").intersect(removes.select("src", "dst"))


def passes_threshold(extra: Column, threshold: float) -> Column:
    """0 lets all pass; without a trailing field none passes, with one it must reach
    the threshold, with two or more all pass."""
    if not threshold:
        return F.lit(True)
    return F.when(F.size(extra) == 0, False).when(F.size(extra) == 1, F.get(extra, F.lit(0)).cast("double") >= threshold).otherwise(True)


def filter_changes(
    changes: DataFrame,
    *,
    ignores: DataFrame | None = None,
    mappings: DataFrame | None = None,
    threshold: float = 0.0,
    filename_pattern: str | None = None,
    header_pattern: str | None = None,
    generated: bool = False,
    third_party: bool = False,
    mojom: bool = False,
    cleanup_mojom: bool = False,
    change_type: str | None = None,
) -> DataFrame:
    """The changes that remain (F4-F12), as ``change_type, line, includer, header``.

    ``changes``: ``pos`` (input order), ``change_type, line, includer, header, extra``.
    ``ignores``: ``op`` (skip, add, remove), ``kind`` (filename, header, edge),
    ``includer``, ``header``; no rules where None (B1).  ``mappings``: ``src,
    canonical, ord``.  Of changes of one type with equal includer and mapped header
    the first counts (B2).  The type filter comes last, so a change that it drops
    still cancels its counterpart (F12).
    """
    c = changes.filter(passes_threshold(F.col("extra"), threshold)).filter(F.col("change_type").isin("add", "remove"))
    c = c.filter(~F.col("header").startswith("<__"))
    if filename_pattern:
        c = c.filter(at_start(F.col("includer"), filename_pattern))
    if header_pattern:
        c = c.filter(at_start(F.col("header"), header_pattern))
    if generated:
        c = c.filter(~F.col("includer").rlike(GENERATED))
    if third_party:
        c = c.filter(~F.col("includer").rlike(THIRD_PARTY))
    if mojom:
        c = c.filter(~F.col("header").rlike(MOJOM))
    columns = ("pos", "change_type", "line", "includer", "header")
    c = c.select(*columns)
    if ignores is not None:
        c = _ignored_out(c, ignores, headers=True, filenames=True)
    deferred = None
    if mappings is not None:
        c, deferred = _cancel_mapped(c, mappings, ignores)
    if cleanup_mojom:
        prefix = F.regexp_extract("header", MOJOM, 1)
        both = W.partitionBy("includer", F.when(F.col("header").rlike(MOJOM), prefix))
        is_mojom = F.col("header").rlike(MOJOM)
        c = c.withColumn("_pair", is_mojom & F.max(F.col("change_type") == "add").over(both) & F.max(F.col("change_type") == "remove").over(both))
        c = c.filter(~F.col("_pair")).select(*columns)
    if deferred is not None:
        c = c.unionByName(deferred)
    if change_type:
        c = c.filter(F.col("change_type") == change_type)
    return c.select("change_type", "line", "includer", "header")


def _ignored_out(c: DataFrame, ignores: DataFrame, headers: bool, filenames: bool) -> DataFrame:
    """``c`` less what the rules ignore (F9), on headers as written."""
    rules = ignores.select(F.col("op").alias("_o"), F.col("kind").alias("_k"), F.col("includer").alias("_i"), F.col("header").alias("_h")).distinct()
    if filenames:
        whole = rules.filter("_k = 'filename'")
        c = c.join(whole.filter("_o = 'skip'"), F.col("includer") == F.col("_i"), "left_anti")
        c = c.join(whole, (F.col("includer") == F.col("_i")) & (F.col("change_type") == F.col("_o")), "left_anti")
    edges = rules.filter("_k = 'edge'")
    c = c.join(edges, (F.col("includer") == F.col("_i")) & (F.col("header") == F.col("_h")) & (F.col("change_type") == F.col("_o")), "left_anti")
    if headers:
        c = c.join(rules.filter("_k = 'header'"), (F.col("header") == F.col("_h")) & (F.col("change_type") == F.col("_o")), "left_anti")
    return c


def _cancel_mapped(c: DataFrame, mappings: DataFrame, ignores: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Changes without mapped headers, and what is left of the others."""
    columns = ("pos", "change_type", "line", "includer", "header")
    forward = mappings.select(F.col("src").alias("_src"), F.col("canonical").alias("_canonical"))
    # Of several keys of one canonical header the last stands for it.
    inverse = mappings.groupBy(F.col("canonical").alias("_to")).agg(F.max_by("src", "ord").alias("_last"))
    m = c.join(forward, F.col("header") == F.col("_src"), "left").join(inverse, F.col("header") == F.col("_to"), "left")
    mapped = F.col("_src").isNotNull() | F.col("_to").isNotNull()
    plain = m.filter(~mapped).select(*columns)
    first = W.partitionBy("change_type", "includer", "header").orderBy("pos")
    d = m.filter(mapped).withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    pending = lambda kind: d.filter(F.col("change_type") == kind).select(F.col("includer").alias("_pi"), F.col("header").alias("_ph"))
    adds = d.filter("change_type = 'add'").join(pending("remove"), (F.col("includer") == F.col("_pi")) & (F.col("_canonical") == F.col("_ph")), "left_anti")
    adds = adds.withColumn("header", F.coalesce("_canonical", "header")).select(*columns)
    if ignores is not None:
        adds = _ignored_out(adds, ignores, headers=True, filenames=False)
    removes = d.filter("change_type = 'remove'").join(pending("add"), (F.col("includer") == F.col("_pi")) & (F.col("_last") == F.col("_ph")), "left_anti")
    return plain, adds.unionByName(removes.select(*columns))


def resolve_includes(includes: DataFrame, files: DataFrame, include_dirs: list[str], gen_prefix: str, sysroot: str, platform: str) -> DataFrame:
    """``includer, include, resolved``: the first candidate path that is a file.

    Resolved per (includer, include), not once per include (N2).  Unresolved
    includes stay as written, less their angle brackets.

    Candidates depend on the includer's folder only, so each include is looked up once a
    folder, and what is found goes back to the includers.
    """
    angle = F.col("include").startswith("<") & F.col("include").endswith(">")
    bare = F.when(angle, F.expr("substring(include, 2, length(include) - 2)")).otherwise(F.col("include"))
    pairs = includes.select("includer", "include").distinct().withColumn("_folder", F.regexp_replace("includer", "[^/]*$", ""))
    usr = f"{sysroot}usr/include/"
    system = [F.concat(F.lit("third_party/libc++/src/include/"), F.col("bare")), F.concat(F.lit(usr), F.col("bare")), F.concat(F.lit(f"{usr}{platform}/"), F.col("bare"))]
    quoted = [F.concat(F.col("_folder"), F.col("bare")), F.concat(F.lit(gen_prefix), F.col("bare"))]
    for d in include_dirs:
        if d.startswith("{sysroot-platform}/"):
            rest = d.removeprefix("{sysroot-platform}/")
            system += [F.concat(F.lit(f"{base}{platform}/{rest}/"), F.col("bare")) for base in (usr, f"{sysroot}usr/lib/")]
        elif d.startswith("{sysroot}/"):
            system.append(F.concat(F.lit(sysroot + d.removeprefix("{sysroot}/") + "/"), F.col("bare")))
        else:
            expanded = gen_prefix + d.removeprefix("{gen}/") if d.startswith("{gen}/") else d
            system.append(F.concat(F.lit(expanded + "/"), F.col("bare")))
            quoted.append(F.concat(F.lit(expanded + "/"), F.col("bare")))
    asked = pairs.select("_folder", "include").distinct().withColumn("bare", bare)
    candidates = F.when(angle, F.array(F.col("include"), *system)).otherwise(F.array(F.col("include"), *quoted))
    ranked = asked.select("_folder", "include", F.posexplode(candidates).alias("rank", "path"))
    hits = ranked.join(files.select(F.col("file").alias("_f")), F.col("path") == F.col("_f"), "left_semi")
    best = hits.groupBy(F.col("_folder").alias("_bf"), F.col("include").alias("_bi")).agg(F.min_by("path", "rank").alias("_path"))
    found = pairs.join(best, F.col("_folder").eqNullSafe(F.col("_bf")) & (F.col("include") == F.col("_bi")), "left")
    return found.select("includer", "include", F.coalesce("_path", bare).alias("resolved"))


def normalize_error_path(path: Column) -> Column:
    """Without leading ``../``, then what follows the first ``/src/``."""
    bare = F.regexp_replace(path, r"^(\.\./)+", "")
    at = F.instr(bare, F.lit("/src/"))
    return F.when(at > 0, F.substring(bare, at + 5, F.length(bare))).otherwise(bare)


def skips_to_changes(skips: DataFrame) -> DataFrame:
    """every skipped edge as a removal at line 0."""
    return skips.select(F.lit("remove").alias("change_type"), F.lit(0).alias("line"), F.col("src").alias("includer"), F.col("dst").alias("header"))


def clean_commands(db: DataFrame) -> DataFrame:
    """compilation commands without ``-H`` and without the excluded toolchain."""
    return db.filter(~F.col("command").contains("native_client")).withColumn("command", F.replace("command", F.lit(" -H "), F.lit(" ")))


def set_edge_weights(
    changes: DataFrame, weights: DataFrame, files: DataFrame, include_dirs: list[str], gen_prefix: str, sysroot: str, platform: str,
    *, third_party: bool = False, ignores: DataFrame | None = None, mappings: DataFrame | None = None,
) -> DataFrame:
    """``change_type, line, includer, header, weight`` of the changes that remain.

    ``weights``: ``src, dst, weight`` of :func:`metrics.edge_metric`.  Headers are
    resolved for the lookup and stay as written in the output.  Additions and
    removals of unknown edges have no weight.
    """
    c = filter_changes(changes, third_party=third_party, ignores=ignores, mappings=mappings)
    removed = c.filter("change_type = 'remove'").select("includer", F.col("header").alias("include"))
    paths = resolve_includes(removed, files, include_dirs, gen_prefix, sysroot, platform)
    known = weights.groupBy(F.col("src").alias("_s"), F.col("dst").alias("_d")).agg(F.max("weight").alias("weight"))
    known = paths.join(known, (F.col("includer") == F.col("_s")) & (F.col("resolved") == F.col("_d")))
    known = known.select(F.lit("remove").alias("_type"), F.col("includer").alias("_i"), F.col("include").alias("_h"), "weight")
    joined = c.join(known, (F.col("change_type") == F.col("_type")) & (F.col("includer") == F.col("_i")) & (F.col("header") == F.col("_h")), "left")
    return joined.select("change_type", "line", "includer", "header", "weight")
