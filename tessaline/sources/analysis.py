"""Sources: raw analyses, archives, edge lists, changes, configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The raw analysis: parallel arrays indexed by file number.
ANALYSIS = (
    "revision string, date string, files array<string>, roots array<int>, includes array<array<int>>, included_by array<array<int>>, "
    "sizes array<bigint>, tsizes array<bigint>, asizes array<bigint>, esizes array<array<bigint>>, prevalence array<bigint>"
)
# How the data, generated files and the sysroot are recognised.
HTML_DATA = r"(?s)^.*<script>\n?(data = .*?)</script>"
LINKS = r'(?s)<a href="(.*?)">'
GEN_PREFIX = r"^(out/[\w-]+/gen/).*$"
SYSROOT = r"^(build/linux/[\w-]+/)usr/include/([\w-]+)/sys/.*$"


def html_data(html: Column) -> Column:
    """The last data script of a page, else "" (S5, S9)."""
    return F.regexp_replace(F.regexp_extract(html, HTML_DATA, 1), r"^\s+|\s+$", "")


def read_analysis(spark: SparkSession, path: str, html: bool = False) -> DataFrame:
    """One row per analysis file under ``path`` (S1, S2, S8): ``url`` and the fields of
    :data:`ANALYSIS`; a file without parsable data is an error."""
    text = spark.read.text(path, wholetext=True).select("_metadata.file_path", "value")
    return parse_analysis(text.withColumn("value", html_data(F.col("value")) if html else F.col("value")))


def parse_analysis(texts: DataFrame) -> DataFrame:
    """``file_path, value`` to analyses."""
    body = F.regexp_extract("value", r"^data = (\{.*\})", 1)
    parsed = texts.select(F.col("file_path").alias("url"), F.from_json(body, ANALYSIS).alias("a"))
    broken = F.col("a").isNull() | F.col("a.files").isNull()
    return parsed.select("url", F.when(broken, F.raise_error(F.concat(F.lit("no analysis in "), F.col("url")))).otherwise(F.col("a")).alias("a")).select("url", "a.*")


def _pairs_sum(lists: str, forward: bool) -> Column:
    """How many pairs parallel lists hold and two sums of their hashes, in any order: equal for equal pairs."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("bits"))

    def add(at, k, x):
        h = F.xxhash64(*((k, x) if forward else (x, k)))
        return F.struct((at["n"] + 1).alias("n"), (at["sum"] + h.bitwiseAND((1 << 36) - 1)).alias("sum"), at["bits"].bitwiseXOR(h).alias("bits"))

    rows = F.flatten(F.transform(F.col(lists), lambda xs, k: F.transform(F.coalesce(xs, F.array().cast("array<int>")), lambda x: F.struct(k.alias("k"), x.alias("x")))))
    return F.aggregate(rows, start, lambda at, p: add(at, p["k"], p["x"]))


def load_problems(analyses: DataFrame) -> DataFrame:
    """``analyses`` with ``problems``: what doesn't hold in each.

    File names and roots are unique; lists by file number are as long as the files;
    numbers name files; every list of sizes is as long as its list of includes; and
    ``included_by`` says of every pair what ``includes`` says.
    """
    n = F.size("files")
    known = lambda x: (x >= 0) & (x < n)
    by_file = ("includes", "included_by", "sizes", "tsizes", "asizes", "esizes", "prevalence")
    uneven = F.exists(F.arrays_zip("includes", "esizes"), lambda z: F.coalesce(F.size(z["includes"]), F.lit(0)) != F.coalesce(F.size(z["esizes"]), F.lit(0)))
    checks = {
        "file names repeat": F.size(F.array_distinct("files")) < n,
        "roots repeat": F.size(F.array_distinct("roots")) < F.size("roots"),
        "lists differ in length": F.greatest(*(F.coalesce((F.size(c) != n).cast("int"), F.lit(1)) for c in by_file)) == 1,
        "numbers name no file": F.exists("roots", lambda x: ~known(x)) | F.exists(F.flatten("includes"), lambda x: ~known(x)) | F.exists(F.flatten("included_by"), lambda x: ~known(x)),
        "sizes don't go with includes": uneven,
        "included_by doesn't agree with includes": _pairs_sum("includes", True) != _pairs_sum("included_by", False),
    }
    return analyses.withColumn("problems", F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items()))))


def checked(analyses: DataFrame, observation: Observation | None = None) -> DataFrame:
    """``analyses``, of which one with problems is an error that names it and them.

    With an ``observation`` no one is: it counts the analyses and those with problems in
    the pass that reads them, and those go on without the others.
    """
    told = load_problems(analyses)
    broken = F.size("problems") > 0
    if observation is not None:
        told = told.observe(observation, F.count("*").alias("analyses"), F.count_if(broken).alias("broken"))
        return told.filter(~broken).drop("problems")
    error = F.raise_error(F.concat(F.lit("analysis "), F.col("url"), F.lit(": "), F.array_join("problems", ", ")))
    return told.withColumn("url", F.when(broken, error).otherwise(F.col("url"))).drop("problems")


def files_of(analyses: DataFrame) -> DataFrame:
    """``url, file_id, file, is_root, size, tsize, asize, prevalence``."""
    zipped = F.arrays_zip("files", "sizes", "tsizes", "asizes", "prevalence")
    rows = analyses.select("url", F.posexplode(zipped).alias("file_id", "f"))
    roots = analyses.select(F.col("url").alias("_u"), F.explode("roots").alias("_root")).distinct()
    joined = rows.join(roots, (F.col("url") == F.col("_u")) & (F.col("file_id") == F.col("_root")), "left")
    return joined.select(
        "url", "file_id", F.col("f.files").alias("file"), F.col("_root").isNotNull().alias("is_root"),
        F.col("f.sizes").alias("size"), F.col("f.tsizes").alias("tsize"), F.col("f.asizes").alias("asize"), F.col("f.prevalence").alias("prevalence"),
    )


def edges_of(analyses: DataFrame) -> DataFrame:
    """``url, src_id, dst_id, src, dst, pos, esize``: sizes go with includes by position.

    Numbers are exploded alone and get their names by joins, so that no row carries
    the list of files.
    """
    per_file = analyses.select("url", F.posexplode(F.arrays_zip("includes", "esizes")).alias("src_id", "f"))
    rows = per_file.select("url", "src_id", F.posexplode(F.arrays_zip(F.col("f.includes").alias("dst"), F.col("f.esizes").alias("esize"))).alias("pos", "e"))
    rows = rows.select("url", "src_id", F.col("e.dst").alias("dst_id"), "pos", F.col("e.esize").alias("esize"))
    names = analyses.select(F.col("url").alias("_u"), F.posexplode("files").alias("_id", "_name"))
    for end in ("src", "dst"):
        rows = rows.join(names, (F.col("url") == F.col("_u")) & (F.col(f"{end}_id") == F.col("_id"))).withColumnRenamed("_name", end).drop("_u", "_id")
    return rows.select("url", "src_id", "dst_id", "src", "dst", "pos", "esize")


def prefixes_of(files: DataFrame) -> DataFrame:
    """``url, gen_prefix, sysroot, sysroot_platform`` from the first files that show them (S3, S4);
    an analysis without such files is an error."""
    gen, root = F.regexp_extract("file", GEN_PREFIX, 1), F.regexp_extract("file", SYSROOT, 1)
    found = files.groupBy("url").agg(
        F.min_by(gen, F.when(gen != "", F.col("file_id"))).alias("gen_prefix"),
        F.min_by(F.struct(root.alias("r"), F.regexp_extract("file", SYSROOT, 2).alias("p")), F.when(root != "", F.col("file_id"))).alias("s"),
    )
    missing = lambda what: F.raise_error(F.concat(F.lit(f"no {what} in "), F.col("url")))
    return found.select(
        "url", F.coalesce("gen_prefix", missing("generated files")).alias("gen_prefix"),
        F.coalesce("s.r", missing("system headers")).alias("sysroot"), F.col("s.p").alias("sysroot_platform"),
    )


def archive_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pos, link`` of a page's links in order, beside the page's columns."""
    return pages.select("*", F.posexplode(F.regexp_extract_all(html_col, F.lit(LINKS), 1)).alias("pos", "link"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """Headerless change rows of four or more fields (S10, D4); ``pos`` is their order."""
    rows = spark.read.text(path).filter("value <> ''").select(F.monotonically_increasing_id().alias("pos"), F.from_csv("value", "f0 string, f1 string, f2 string, f3 string, f4 string, f5 string", {"escape": '"'}).alias("f"))
    extra = F.filter(F.array("f.f4", "f.f5"), lambda x: x.isNotNull())
    return rows.select("pos", F.col("f.f0").alias("change_type"), F.col("f.f1").cast("int").alias("line"), F.col("f.f2").alias("includer"), F.col("f.f3").alias("header"), extra.alias("extra"))


def read_edge_lists(spark: SparkSession, paths: list[str], comments: bool = True) -> DataFrame:
    """Distinct ``src, dst`` of headerless edge lists (S11, S12); blank rows don't count, and
    ``#`` rows are comments."""
    reader = spark.read.schema("src string, dst string").option("escape", '"')
    reader = reader.option("comment", "#") if comments else reader
    return reader.csv(paths).filter("trim(src) <> ''").distinct()


def listed_paths(spark: SparkSession, path: str) -> list[str]:
    """The paths that a file lists, one a line (S13): a person's list, as short as that."""
    return [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]


def read_sources(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """``file, text`` of the named source files below ``root`` (S17); each is found by its whole path."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") or "/")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    address = lambda n: files.makeQualified(jvm.org.apache.hadoop.fs.Path(folder, n)).toUri().toString()
    asked = spark.createDataFrame([(n, address(n)) for n in dict.fromkeys(names)], "file string, _address string")
    texts = spark.read.text([f"{root.rstrip('/')}/{n}" for n in dict.fromkeys(names)], wholetext=True).select("_metadata.file_path", F.col("value").alias("text"))
    bare = lambda c: F.regexp_replace(c, "^([a-z]+):/+", "$1:/")  # noqa: E731 (file:/x and file:///x are one address)
    return texts.join(F.broadcast(asked), bare(F.col("file_path")) == bare(F.col("_address"))).select("file", "text")


def read_header_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored header reports."""
    return spark.read.schema("header string, remaining_pct double, floor_pct double, dominated int, tsize bigint").csv(path)


def read_compilation_db(spark: SparkSession, path: str) -> DataFrame:
    """A compilation database with all its keys."""
    return spark.read.json(path, multiLine=True)


def is_gist_url(url: Column) -> Column:
    """S18."""
    return url.rlike(r"^https?://gist\.github(?:usercontent)?\.com/")


def gist_to_raw_url(url: Column) -> Column:
    """A gist page's address to its raw text's; other addresses stay."""
    return F.regexp_replace(url, r"^https?://gist\.github\.com/([^/]+)/([a-f0-9]+)(?:/raw)?/?$", r"https://gist.githubusercontent.com/$1/$2/raw")


def gist_id(url: Column) -> Column:
    """The id in a gist's address; null if there is none."""
    return F.nullif(F.regexp_extract(url, r"^https?://gist\.github(?:usercontent)?\.com/[^/]+/([a-f0-9]+)", 1), F.lit(""))


#: A configuration as it is written; a dependency is another one, or the name of its file.
RULES = "struct<filenames: array<string>, headers: array<string>, edges: array<array<string>>>"
CONFIG = f"dependencies map<string, string>, includeDirs array<string>, ignores struct<skip: array<string>, add: {RULES}, remove: {RULES}>, headerMappings map<string, string>"


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """``name, value``: a configuration file and those it names beside it (S14); a missing one is an error."""
    folder = path.rpartition("/")[0]
    text = lambda paths: spark.read.text(paths, wholetext=True)
    main = text([path]).select(F.lit("").alias("name"), "value")
    named = main.select(F.explode(F.map_values(F.from_json("value", CONFIG)["dependencies"])).alias("d")).filter("not startswith(ltrim(d), '{')").distinct()
    for r in named.collect():  # a configuration's dependencies, as few as a person lists
        main = main.unionByName(text([f"{folder}/{r['d']}" if folder else r["d"]]).select(F.lit(r["d"]).alias("name"), "value"))
    return main


def merged_configs(configs: DataFrame) -> DataFrame:
    """``dependency, c``: the configuration of the empty name (dependency null) and its
    dependencies, each with its parsed text; broken JSON is an error (D6)."""
    parsed = F.from_json("value", CONFIG, {"mode": "FAILFAST"})
    own = configs.filter("name = ''").select(F.lit(None).cast("string").alias("dependency"), parsed.alias("c"))
    inner = own.select(F.explode("c.dependencies").alias("dependency", "_told"))
    beside = configs.filter("name <> ''").select(F.col("name").alias("_name"), F.col("value").alias("_value"))
    found = inner.join(beside, F.col("_told") == F.col("_name"), "left")
    text = F.when(F.ltrim("_told").startswith("{"), F.col("_told")).otherwise(F.coalesce("_value", F.raise_error(F.concat(F.lit("no configuration "), F.col("_told")))))
    return own.unionByName(found.select("dependency", F.from_json(text, CONFIG, {"mode": "FAILFAST"}).alias("c")))


def ignore_rules(configs: DataFrame) -> DataFrame:
    """``op, kind, includer, header`` rows of :func:`merged_configs`.

    A dependency's name prefixes its skips, filenames and edge includers; its headers
    count both bare and prefixed.  Its own dependencies don't count.
    """
    below = lambda name: F.when(F.col("dependency").isNull(), name).otherwise(F.concat(F.rtrim("dependency", F.lit("/")), F.lit("/"), name))
    none = F.lit(None).cast("string")

    def rules(op: str, kind: str, values: str, includer, header) -> DataFrame:
        rows = configs.select("dependency", F.explode(f"c.ignores.{values}").alias("x"))
        return rows.select(F.lit(op).alias("op"), F.lit(kind).alias("kind"), includer.alias("includer"), header.alias("header"))

    x = F.col("x")
    out = rules("skip", "filename", "skip", below(x), none)
    for op in ("add", "remove"):
        out = out.unionByName(rules(op, "filename", f"{op}.filenames", below(x), none)).unionByName(rules(op, "header", f"{op}.headers", none, x))
        out = out.unionByName(rules(op, "header", f"{op}.headers", none, below(x)).filter("header is not null"))
        out = out.unionByName(rules(op, "edge", f"{op}.edges", below(F.get(x, F.lit(0))), F.get(x, F.lit(1))))
    return out.distinct()


def include_dirs(configs: DataFrame) -> list[str]:
    """The include folders in order, then the dependencies (F13): as few as a person lists."""
    own = [r["d"] for r in configs.filter("dependency is null").select(F.posexplode("c.includeDirs").alias("pos", "d")).orderBy("pos").collect()]
    named = configs.filter("dependency is null").select(F.posexplode("c.dependencies").alias("pos", "d", "_")).orderBy("pos")
    return own + [r["d"] for r in named.collect()]


def header_mappings(configs: DataFrame) -> DataFrame:
    """``src, canonical, ord`` of the configuration's own header mappings."""
    return configs.filter("dependency is null").select(F.posexplode("c.headerMappings").alias("ord", "src", "canonical")).select("src", "canonical", "ord")
