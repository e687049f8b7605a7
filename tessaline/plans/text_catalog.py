"""Queries of sources, sinks, filters of changes and text operators, with their oracles.

Inputs are diffs, logs, index pages and files made from the driver's tables by SQL
that both engines run; oracles say from those tables what must come out.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import closure, cuts, filters, metrics, text, trends
from ..sources import analysis, reviews, sinks, snapshot
from ..storage import numbered, shared_folder
from . import model
from .model import spark_sql
from .registry import query, with_ctes

N = "cast({} as varchar(20))"
#: Line items numbered within their orders, whatever repeats.
ITEMS = "select l_orderkey as id, l_partkey as p, l_returnflag as f, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as int) as n from {lineitem}"
ID, P, NUM = (N.format(c) for c in ("id", "p", "n"))


def rows(spark, d, sql: str, **ctes: str) -> DataFrame:
    """A select over common table expressions that both engines run."""
    return spark_sql(spark, d, ("with " + ", ".join(f"{n} as ({s})" for n, s in ctes.items()) + " " if ctes else "") + sql)


def items(spark, d) -> str:
    """A select of :data:`ITEMS`, numbered and written once in a session: queries that read it in many branches don't number it in each."""
    name = "items_" + hashlib.sha256(f"{spark.sparkContext.applicationId} {d}".encode()).hexdigest()[:16]
    model.kept(spark, d, "items", lambda: spark_sql(spark, d, ITEMS)).createOrReplaceGlobalTempView(name)
    return f"select * from global_temp.{name}"


def written_to(spark, name: str) -> str:
    return f"{shared_folder(spark)}/tessaline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(spark, lines: DataFrame, name: str) -> str:
    """A folder with the lines as text files, on the shared folder."""
    path = written_to(spark, name)
    lines.write.text(path)
    return path


# Logs: an error, a context line and a caret line for every line item.

_PATH = f"case f when 'R' then '../../src/part/' || {P} || '.cc:' || {NUM} || ':5: error: no type ' || {P} when 'A' then '/w/src/part/' || {P} || '.cc(' || {NUM} || ',2): error: bad' else '../part/' || {P} || '.cc:' || {NUM} || ':1: warning: hm' end"
_CARET = "case n % 4 when 0 then '   ^~~' when 1 then '     |   ^~~' when 2 then '~~~^~~' else '  12 | ^ ^' end"
LOG = f"select id, 3 * n as pos, {_PATH} as line from i union all select id, 3 * n + 1, '  12 |   X y;' from i union all select id, 3 * n + 2, {_CARET} from i"
_ERRORS = (
    f"select id, 3 * n as pos, case f when 'R' then 'src/part/' else 'part/' end || {P} || '.cc' as file, n as line_no, case f when 'R' then 'no type ' || {P} else 'bad' end as message, "
    "case n % 4 when 0 then 3 when 1 then 2 end as range_start, case n % 4 when 0 then 6 when 1 then 5 end as range_end from i where f in ('R', 'A')"
)


def _errors(spark, d) -> DataFrame:
    return text.compile_errors(rows(spark, d, LOG, i=items(spark, d)))


@query("c12_compile_errors", with_ctes("select id, pos, file, line_no, message, range_start, range_end from e", i=ITEMS, e=_ERRORS))
def c12_compile_errors(spark, d):
    return _errors(spark, d)


# All orders' logs, and all their diffs, as one text of many parts.

_ONE = f"select cast(0 as bigint) as id, 100 * id + pos as pos, line from ({LOG}) l"


@query("c12_one_log", with_ctes("select cast(0 as bigint) as id, min(100 * id + pos) as pos, file, line_no, message, range_start, range_end from e group by file, line_no, message, range_start, range_end", i=ITEMS, e=_ERRORS))
def c12_one_log(spark, d):
    return text.compile_errors(rows(spark, d, _ONE, i=items(spark, d)))


@query("c8_caret_ranges", with_ctes("select line, case n % 4 when 0 then 3 when 1 then 2 end as range_start, case n % 4 when 0 then 6 when 1 then 5 end as range_end from c", i=ITEMS, c=f"select n, {_CARET} as line from i"))
def c8_caret_ranges(spark, d):
    start, end = text.caret_range(F.col("line"))
    return rows(spark, d, f"select {_CARET} as line from i", i=ITEMS).select("line", start.alias("range_start"), end.alias("range_end"))


_FIRST = "select id, pos, file, line_no, message, range_start, range_end from (select *, row_number() over (partition by file, line_no, message order by id, pos) as k from e) x where k = 1"


@query("c13_first_errors", with_ctes(_FIRST, i=ITEMS, e=_ERRORS))
def c13_first_errors(spark, d):
    return text.first_errors(_errors(spark, d))


_PART = "case when line_no = first then '`' || message || '`' else 'Line ' || cast(line_no as varchar(20)) || ': `' || message || '`' end || chr(10) || chr(10) || 'https://builds.example/' || cast(id as varchar(20))"


@query(
    "c14_annotations",
    with_ctes(
        f"select file, min(first) as line_no, string_agg({_PART}, chr(10) || chr(10) order by line_no, message, id) as message, "
        "arg_min(range_start, message || chr(1) || lpad(cast(id as varchar(20)), 20, '0')) filter (line_no = first and range_start is not null) as range_start, "
        "arg_min(range_end, message || chr(1) || lpad(cast(id as varchar(20)), 20, '0')) filter (line_no = first and range_start is not null) as range_end "
        "from (select *, min(line_no) over (partition by file) as first from u) y group by file",
        i=ITEMS, e=_ERRORS, u=_FIRST,
    ),
)
def c14_annotations(spark, d):
    return text.annotations(text.first_errors(_errors(spark, d)), "https://builds.example/")


@query("n3_error_paths", with_ctes(f"select distinct raw, case when f = 'A' then 'part/' || {P} || '.cc' when f = 'R' then 'src/part/' || {P} || '.cc' else 'part/' || {P} || '/src/x.cc' end as file from r", i=ITEMS,
    r=f"select f, p, case when f = 'A' then '/w/src/part/' || {P} || '.cc' when f = 'R' then '../../src/part/' || {P} || '.cc' else 'a/src/part/' || {P} || '/src/x.cc' end as raw from i"))
def n3_error_paths(spark, d):
    raw = rows(spark, d, f"select distinct case when f = 'A' then '/w/src/part/' || {P} || '.cc' when f = 'R' then '../../src/part/' || {P} || '.cc' else 'a/src/part/' || {P} || '/src/x.cc' end as raw from i", i=ITEMS)
    return raw.select("raw", filters.normalize_error_path(F.col("raw")).alias("file"))


# Diffs: two hunks of a file for every line item; an added line looks like a header.

_FILE, _HEADER = f"'o/' || {ID} || '_' || {NUM} || '.cc'", f"'h' || {N.format('p % 5')} || '.h'"
_DIFF_LINES = (
    f"'diff --git a/' || {_FILE} || ' b/' || {_FILE}", f"'--- a/' || {_FILE}", f"'+++ b/' || {_FILE}", "'@@ -1,3 +1,5 @@ top'", "' one'", f"'+#include \"' || {_HEADER} || '\"'",
    "'-two'", "'+++ b/fake.h'", "' three'", "'@@ -20,1 +21,2 @@'", "' ten'", "'+other'",
)
DIFF = " union all ".join(f"select id, 20 * n + {k} as pos, {line} as line from i" for k, line in enumerate(_DIFF_LINES))


def _diff(spark, d) -> DataFrame:
    return rows(spark, d, DIFF, i=items(spark, d))


@query("w2_diff_sections", with_ctes(f"select x.id, x.pos, x.line, cast(x.pos div 20 as bigint) as file_no, cast(case when x.pos % 20 < 3 then 0 when x.pos % 20 < 9 then 1 else 2 end as bigint) as hunk_no, {_FILE} as file from x join i on i.id = x.id and i.n = x.pos div 20".replace("x.pos div 20", "x.pos // 20").replace(ID, "cast(x.id as varchar(20))"), i=ITEMS, x=DIFF))
def w2_diff_sections(spark, d):
    return text.diff_sections(_diff(spark, d)).select("id", "pos", "line", F.col("file_no").cast("long"), F.col("hunk_no").cast("long"), "file")


@query(
    "w2_one_diff",
    with_ctes(
        f"select 1000 * id + pos as pos, line, file_no, cast(case when pos % 20 < 3 then 0 when pos % 20 < 9 then 1 else 2 end as bigint) as hunk_no, {_FILE} as file "
        "from (select k.id, k.n, x.pos, x.line, k.file_no from x join k on k.id = x.id and k.n = x.pos // 20) y",
        i=ITEMS, x=DIFF, k="select id, n, row_number() over (order by id, n) as file_no from i",
    ),
)
def w2_one_diff(spark, d):
    one = rows(spark, d, f"select cast(0 as bigint) as id, 1000 * id + pos as pos, line from ({DIFF}) x", i=items(spark, d))
    return text.diff_sections(one).select("pos", "line", F.col("file_no").cast("long"), F.col("hunk_no").cast("long"), "file")


@query("c10_added_includes", with_ctes(f"select id, {_HEADER} as header, {_FILE} as file, 20 * n + 5 as first_pos from i", i=ITEMS))
def c10_added_includes(spark, d):
    return text.added_includes(_diff(spark, d))


@query("f25_frequent_headers", with_ctes(f"select id, {_HEADER} as header, string_agg({_FILE}, ' ' order by n) as files from i group by id, p % 5 having count(*) >= 2", i=ITEMS))
def f25_frequent_headers(spark, d):
    return text.frequent_headers(text.added_includes(_diff(spark, d)), 2).select("id", "header", F.array_join("files", " ").alias("files"))


_KEPT = " || chr(10) || ".join([*_DIFF_LINES[:3], "'@@ -1,3 +1,4 @@ top'", "' one'", "'+#include \"h3.h\"'", "' two'", "' three'"])


@query("c9_patch_for_header", with_ctes(f"select id, string_agg({_KEPT}, chr(10) order by n) as patch from i where p % 5 = 3 group by id", i=ITEMS))
def c9_patch_for_header(spark, d):
    return text.patch_for_header(_diff(spark, d), "h3.h")


# Include lines, diagnostics, languages, edits.

_INCLUDE_LINE = f"case n % 4 when 0 then '#include \"a/' || {P} || '.h\"' when 1 then '  # include <v' || {P} || '>' when 2 then '#include \"b.h\" // ' || {P} else 'int x' || {P} || ';' end"
_INCLUDED = f"case n % 4 when 0 then 'a/' || {P} || '.h' when 1 then '<v' || {P} || '>' when 2 then 'b.h' end"


@query("c5_include_lines", with_ctes(f"select distinct {_INCLUDE_LINE} as line, {_INCLUDED} as included from i", i=ITEMS))
def c5_include_lines(spark, d):
    return rows(spark, d, f"select distinct {_INCLUDE_LINE} as line from i", i=ITEMS).select("line", text.include_of(F.col("line")).alias("included"))


_CODE = "case f when 'R' then 'unused-includes' when 'A' then 'missing-includes' else 'other' end"


@query(
    "c15_diagnostics",
    with_ctes(
        f"select 'remove' as change_type, n as line, {_FILE} as includer, {_INCLUDED} as header from i where f = 'R' and n % 4 < 3 union all select distinct 'add', n, {_FILE}, {_INCLUDED} from i where f = 'A' and n % 4 < 3", i=ITEMS
    ),
)
def c15_diagnostics(spark, d):
    told = rows(spark, d, f"select {_FILE} as file, {_CODE} as code, n as line, {_INCLUDE_LINE} as text from i union all select {_FILE}, {_CODE}, n, {_INCLUDE_LINE} from i where f = 'A'", i=ITEMS)
    return text.diagnostics_to_changes(told)


_ENDINGS = ("h", "hh", "hpp", "hpp11", "hxx", "cc", "cpp", "cxx", "c", "mm")
_NAME = f"'f/' || {P} || '.' || case n % 10 " + " ".join(f"when {i} then '{e}'" for i, e in enumerate(_ENDINGS)) + " end"


@query("c16_languages", with_ctes(f"select distinct {_NAME} as file, case n % 10 when 8 then 'c' when 9 then 'objective-cpp' else 'cpp' end as language from i", i=ITEMS))
def c16_languages(spark, d):
    return rows(spark, d, f"select distinct {_NAME} as file from i", i=ITEMS).select("file", text.language_id(F.col("file")).alias("language"))


# A form feed doesn't end a line.
_SOURCE = "'#include \"a.h\"' || chr(10) || 'int x;' || chr(12) || chr(10) || '#include <v>' || chr(10)"


@query(
    "t1_apply_changes",
    with_ctes(
        f"select 'o/' || {ID} as file, string_agg('#include \"' || h || '\"' || chr(10), '' order by first) || 'int x;' || chr(12) || chr(10) as text from (select id, {_HEADER} as h, min(n) as first from i group by id, p % 5) x group by id",
        i=ITEMS,
    ),
)
def t1_apply_changes(spark, d):
    sources = rows(spark, d, f"select distinct 'o/' || {ID} as file, {_SOURCE} as text from i", i=items(spark, d))
    changes = rows(
        spark, d,
        f"select 10 * n as pos, 'add' as change_type, 1 as line, 'o/' || {ID} as includer, {_HEADER} as header from i union all select 10 * n + 1, 'add', 1, 'o/' || {ID}, '<v>' from i "
        f"union all select distinct 0, 'remove', 0, 'o/' || {ID}, 'a.h' from i union all select distinct 1, 'remove', 1, 'o/' || {ID}, 'int x;' from i union all select distinct 2, 'remove', 2, 'o/' || {ID}, '<v>' from i", i=items(spark, d),
    )
    return text.apply_changes(sources, changes)


@query("l8_first_changes", with_ctes("select pos, change_type, line, includer, header from c where change_type <> 'other' order by pos limit 100", c=model.CHANGES))
def l8_first_changes(spark, d):
    return text.first_changes(model.in_order(spark, d, model.CHANGES, "changes"), 100).select("pos", "change_type", "line", "includer", "header")


_PARENT = "case when o_orderkey % 3 = 0 then cast(o_orderkey + 1 as varchar(20)) end"


@query(
    "c11_failed_builds",
    with_ctes(
        "select id from b where status = 'FAILURE' and id not in (select parent from b where status = 'FAILURE' and parent is not null)",
        b=f"select cast(o_orderkey as varchar(20)) as id, case o_orderstatus when 'F' then 'FAILURE' else 'SUCCESS' end as status, {_PARENT} as parent from {{orders}}",
    ),
)
def c11_failed_builds(spark, d):
    tags = "filter(array(named_struct('key', 'x', 'value', '1'), named_struct('key', 'parent_buildbucket_id', 'value', {p})), t -> t.value is not null)".format(p=_PARENT)
    return text.failed_builds(rows(spark, d, f"select cast(o_orderkey as varchar(20)) as id, case o_orderstatus when 'F' then 'FAILURE' else 'SUCCESS' end as status, {tags} as tags from {{orders}}"))


# Filters of changes.

_KIND = "case l_returnflag when 'R' then 'remove' when 'A' then 'add' else 'other' end"
VARIANTS = (
    f"select {model.ORDERED}{_KIND} as change_type, l_linenumber as line, {model.order('l_orderkey')} as includer, "
    f"case l_linenumber % 4 when 0 then '<__x' || {N.format('l_partkey')} || '>' when 1 then 'm' || {N.format('l_partkey % 3')} || '.mojom.h' when 2 then 'm' || {N.format('l_partkey % 3')} || '.mojom-forward.h' else {model.part('l_partkey')} end as header from {{lineitem}}"
)


def _variants(spark, d) -> DataFrame:
    return model.in_order(spark, d, VARIANTS, "variants").withColumn("extra", F.array().cast("array<string>"))


_KNOWN = "c.change_type <> 'other' and not starts_with(c.header, '<__')"


@query("f6_system_headers", with_ctes(f"select change_type, line, includer, header from c where {_KNOWN}", c=VARIANTS))
def f6_system_headers(spark, d):
    return filters.filter_changes(_variants(spark, d))


@query("f7_patterns", with_ctes(f"select change_type, line, includer, header from c where {_KNOWN} and regexp_matches(includer, '^(?:orders/1|rs/2)') and regexp_matches(header, '^(?:m[01]|v8)')", c=VARIANTS))
def f7_patterns(spark, d):
    return filters.filter_changes(_variants(spark, d), filename_pattern="orders/1|rs/2", header_pattern="m[01]|v8")


_MOJOM = "regexp_matches(c.header, '^(.*)\\.mojom[^\\.]*\\.h$')"
_UNPAIRED = f"{_KNOWN} and not ({_MOJOM} and exists (select 1 from c o where o.includer = c.includer and o.change_type <> 'other' and o.change_type <> c.change_type and regexp_matches(o.header, '^(.*)\\.mojom[^\\.]*\\.h$') and split_part(o.header, '.', 1) = split_part(c.header, '.', 1)))"


@query("f11_mojom_variants", with_ctes(f"select change_type, line, includer, header from c where {_UNPAIRED}", c=VARIANTS))
def f11_mojom_variants(spark, d):
    return filters.filter_changes(_variants(spark, d), cleanup_mojom=True)


@query("f12_one_type", with_ctes(f"select change_type, line, includer, header from c where {_UNPAIRED} and change_type = 'add'", c=VARIANTS))
def f12_one_type(spark, d):
    return filters.filter_changes(_variants(spark, d), cleanup_mojom=True, change_type="add")


def _edges(spark, d) -> DataFrame:
    return model.kept(spark, d, "edges", lambda: spark_sql(spark, d, model.EDGES))


def _files(spark, d) -> DataFrame:
    return model.kept(spark, d, "files", lambda: spark_sql(spark, d, model.FILES))


def _roots(spark, d) -> DataFrame:
    return model.kept(spark, d, "roots", lambda: spark_sql(spark, d, model.ROOTS))


@query("f3_at_start", with_ctes("select file from f where regexp_matches(file, '^(?:part/1|mer/2|v8)')", f=model.FILES))
def f3_at_start(spark, d):
    return _files(spark, d).filter(filters.at_start(F.col("file"), "part/1|mer/2|v8")).select("file")


@query("f14_listed_weights", with_ctes("select distinct e.src, e.dst, e.esize as weight from e where e.dst like 'supplier/%' and e.esize >= 20 union all select distinct src, dst, null from u where dst like 'supplier/%'", e=model.EDGES, u=f"select {model.order('o_orderkey')} as src, 'supplier/' || {N.format('o_custkey')} || '.h' as dst from {{orders}}"))
def f14_listed_weights(spark, d):
    known = _edges(spark, d).filter("dst like 'supplier/%'").select("src", "dst")
    unknown = rows(spark, d, f"select distinct {model.order('o_orderkey')} as src, 'supplier/' || {N.format('o_custkey')} || '.h' as dst from {{orders}}")
    weights = metrics.edge_metric(_edges(spark, d), _files(spark, d), "input_size", 0, 0)
    return metrics.list_weights(known.unionByName(unknown), weights, 20)


@query("f22_unused_edges", with_ctes("select distinct e.dst as key, e.src, e.dst from e join u on u.src = e.src and u.dst = e.dst where e.dst in ('part/5.h', 'part/6.h', 'part/12.h')", e=model.EDGES, u=model.UNUSED))
def f22_unused_edges(spark, d):
    targets = spark.createDataFrame([("part/5.h",), ("part/6.h",), ("part/12.h",)], "node string")
    return closure.includers(_edges(spark, d), targets, unused=spark_sql(spark, d, model.UNUSED))


@query("f23_ignored_and_removed", with_ctes("select distinct src, dst from u intersect select src, dst from e where esize >= 30", e=model.EDGES, u=model.UNUSED))
def f23_ignored_and_removed(spark, d):
    return filters.in_both(spark_sql(spark, d, model.UNUSED), _edges(spark, d).filter("esize >= 30"))


@query("f19_clean_commands", "select 'clang -c ' || c_name || case when c_custkey % 2 = 0 then ' -H' else '' end as command, c_custkey from {customer} where c_custkey % 5 <> 0")
def f19_clean_commands(spark, d):
    db = rows(spark, d, "select 'clang -H -c ' || c_name || case when c_custkey % 2 = 0 then ' -H' else '' end || case when c_custkey % 5 = 0 then ' native_client/x.cc' else '' end as command, c_custkey from {customer}")
    return filters.clean_commands(db)


# A configuration whose dependencies are the regions, one in a file of its own, with rules from the nations.

_R, _NA = "'dep/' || r_name", N.format("n_nationkey")


@query(
    "f13_merged_rules",
    with_ctes(
        "select distinct op, kind, includer, header from r",
        n="select n_nationkey as k, n_name, r_name, r_regionkey from {nation} join {region} on r_regionkey = n_regionkey",
        r=f"select 'skip' as op, 'filename' as kind, 'own/' || c_name as includer, cast(null as varchar) as header from {{customer}} union all select 'skip', 'filename', {_R} || '/' || n_name || '.cc', null from n "
        f"union all select 'add', 'header', null, n_name || '.h' from n union all select 'add', 'header', null, {_R} || '/' || n_name || '.h' from n "
        f"union all select 'remove', 'edge', {_R} || '/' || n_name || '.cc', 'x.h' from n union all select 'remove', 'filename', {_R} || '/r.cc', null from n",
    ),
)
def f13_merged_rules(spark, d):
    nations = spark_sql(spark, d, "select n_nationkey, n_name, r_name from {nation} join {region} on r_regionkey = n_regionkey")
    each = nations.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    ending = lambda e: F.transform("names", lambda n: F.concat(n, F.lit(e)))
    rules = lambda **kinds: F.struct(*(v.alias(k) for k, v in kinds.items()))
    ignores = rules(
        skip=ending(".cc"), add=rules(headers=ending(".h")),
        remove=rules(filenames=F.array(F.lit("r.cc")), edges=F.transform("names", lambda n: F.array(F.concat(n, F.lit(".cc")), F.lit("x.h")))),
    )
    inner = each.select(F.concat(F.lit("dep/"), "r_name").alias("dep"), F.to_json(rules(ignores=ignores)).alias("told"))
    apart = F.col("dep") == "dep/ASIA"
    named = inner.select("dep", F.when(apart, F.lit("asia.json")).otherwise(F.col("told")).alias("told"))
    own = spark_sql(spark, d, "select 'own/' || c_name as name from {customer}").agg(F.collect_list("name").alias("skip"))
    # The dependency of the file is a JSON string, the others are JSON objects.
    entry = F.concat(F.lit('"'), "dep", F.lit('":'), F.when(apart, F.lit('"asia.json"')).otherwise(F.col("told")))
    main = named.agg(F.array_join(F.collect_list(entry), ",").alias("deps")).crossJoin(own)
    value = F.concat(F.lit('{"dependencies":{'), "deps", F.lit('},"ignores":'), F.to_json(F.struct("skip")), F.lit("}"))
    configs = main.select(F.lit("").alias("name"), value.alias("value")).unionByName(inner.filter(apart).select(F.lit("asia.json").alias("name"), F.col("told").alias("value")))
    return analysis.ignore_rules(analysis.merged_configs(configs))


@query(
    "n1_resolve_system_includes",
    with_ctes(
        "select distinct includer, include, case when k % 2 = 0 then 'build/linux/x/usr/include/y/' || b else b end as resolved from i",
        i=f"select 'a/' || {N.format('l_partkey')} || '.cc' as includer, '<s' || {N.format('l_suppkey')} || '.h>' as include, 's' || {N.format('l_suppkey')} || '.h' as b, l_suppkey as k from {{lineitem}}",
    ),
)
def n1_resolve_system_includes(spark, d):
    asked = rows(spark, d, f"select distinct 'a/' || {N.format('l_partkey')} || '.cc' as includer, '<s' || {N.format('l_suppkey')} || '.h>' as include from {{lineitem}}")
    have = rows(spark, d, f"select 'build/linux/x/usr/include/y/s' || {N.format('s_suppkey')} || '.h' as file from {{supplier}} where s_suppkey % 2 = 0 union all select 'a/s' || {N.format('s_suppkey')} || '.h' from {{supplier}}")
    return filters.resolve_includes(asked, have, ["{sysroot}/opt", "{sysroot-platform}/q"], "out/Debug/gen/", "build/linux/x/", "y")


@query(
    "g24_suggested_adds",
    with_ctes(
        "select distinct includer as src, coalesce(f.file, header) as dst from c left join f on f.file = c.header where change_type = 'add' and header <> 'part/5.h'",
        c=model.CHANGES, f=model.FILES,
    ),
)
def g24_suggested_adds(spark, d):
    changes = model.in_order(spark, d, model.CHANGES, "changes").withColumn("extra", F.array(F.col("weight").cast("string"))).drop("weight")
    rules = spark.createDataFrame([("add", "header", None, "part/5.h")], "op string, kind string, includer string, header string")
    return closure.suggested_adds(changes, _files(spark, d), [], "none/", "none/", "none", ignores=rules)


# Sources.

_ANALYSIS_FILES = (
    f"select {model.SUPPLIER('s_suppkey')} as file, 3 as kind, s_nationkey as up, s_suppkey as k from {{supplier}} union all select {model.NATION('n_nationkey')}, 2, n_regionkey, n_nationkey from {{nation}} "
    f"union all select {model.REGION('r_regionkey')}, 1, null, r_regionkey from {{region}} union all select 'out/Debug/gen/a.h', 0, null, 0 union all select 'build/linux/s/usr/include/x86/sys/t.h', 0, null, 1"
)
_NUMBERED = "select file, kind, up, k, cast(row_number() over (order by file) - 1 as int) as id from a"
_INCLUDES = "select x.id as src, y.id as dst, x.file as src_name, y.file as dst_name, cast(10 * x.k + y.k as bigint) as esize from n x join n y on y.kind = x.kind - 1 and y.k = x.up and x.kind > 1"


def _raw(spark, d) -> DataFrame:
    """One ``data = {...}`` line of the suppliers' graph, as ``file_path, value``."""
    n = rows(spark, d, _NUMBERED, a=_ANALYSIS_FILES)
    e = rows(spark, d, _INCLUDES, a=_ANALYSIS_FILES, n=_NUMBERED).groupBy("src").agg(F.sort_array(F.collect_list(F.struct("dst", "esize"))).alias("es"))
    per = n.join(e, F.col("id") == F.col("src"), "left").withColumn("es", F.coalesce("es", F.expr("filter(array(named_struct('dst', 0, 'esize', 0L)), x -> false)")))
    per = per.select("id", "file", "kind", F.transform("es", lambda x: x["dst"]).alias("includes"), F.transform("es", lambda x: x["esize"]).alias("esizes"))
    one = per.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("f"))
    at = lambda name: F.transform("f", lambda x: x[name])
    sizes = F.transform("f", lambda x: x["id"].cast("long"))
    data = F.struct(
        F.lit("r1").alias("revision"), F.lit("2024-05-01 03:04:05 UTC").alias("date"), at("file").alias("files"), F.transform(F.filter("f", lambda x: x["kind"] == 3), lambda x: x["id"]).alias("roots"),
        at("includes").alias("includes"), F.transform("f", lambda x: F.array().cast("array<int>")).alias("included_by"), sizes.alias("sizes"), sizes.alias("tsizes"), sizes.alias("asizes"), at("esizes").alias("esizes"), sizes.alias("prevalence"),
    )
    return one.select(F.lit("mem").alias("file_path"), F.concat(F.lit("data = "), F.to_json(data)).alias("value"))


@query("s2_analysis_edges", with_ctes("select src as src_id, dst as dst_id, src_name as src, dst_name as dst, esize from x", a=_ANALYSIS_FILES, n=_NUMBERED, x=_INCLUDES))
def s2_analysis_edges(spark, d):
    return analysis.edges_of(analysis.parse_analysis(_raw(spark, d))).select("src_id", "dst_id", "src", "dst", "esize")


@query("s2_analysis_files", with_ctes("select id as file_id, file, kind = 3 as is_root, id::bigint as size, id::bigint as prevalence from n", a=_ANALYSIS_FILES, n=_NUMBERED))
def s2_analysis_files(spark, d):
    return analysis.files_of(analysis.parse_analysis(_raw(spark, d))).select("file_id", "file", "is_root", "size", "prevalence")


# The whole graph as one snapshot, which many tasks read.

_PLACED = "select cast(row_number() over (order by file) - 1 as int) as id, f.*, file like 'orders/%' as is_root from f"
_PLACED_EDGES = "select x.id as src_id, y.id as dst_id, x.file as src, y.file as dst, cast(row_number() over (partition by x.id order by y.id) - 1 as int) as pos, esize from e join n x on x.file = e.src join n y on y.file = e.dst"


def _elements(spark, d) -> DataFrame:
    """The values of a snapshot of all files and edges, written to one file and read in ranges of a megabyte."""

    def make() -> DataFrame:
        files = numbered(spark_sql(spark, d, model.FILES), ["file"], "_n").withColumn("file_id", F.col("_n") - 1).withColumn("is_root", F.startswith(F.col("file"), F.lit("orders/")))
        ids = [files.select(F.col("file").alias(end), F.col("file_id").alias(f"{end}_id")) for end in ("src", "dst")]
        edges = spark_sql(spark, d, model.EDGES).join(ids[0], "src").join(ids[1], "dst")
        edges = edges.withColumn("pos", F.row_number().over(Window.partitionBy("src_id").orderBy("dst_id")) - 1)
        path = written_to(spark, "snapshot")
        snapshot.write_snapshot(files, edges, path, "r1", "2024-05-01 03:04:05 UTC")
        return snapshot.read_elements(spark, path, split_bytes=1 << 20)

    return model.kept(spark, d, "elements", make)


@query("s2_split_files", with_ctes("select id as file_id, file, is_root, size, tsize, asize, prevalence from n", f=model.FILES, n=_PLACED))
def s2_split_files(spark, d):
    return snapshot.files_of(_elements(spark, d)).drop("url")


@query("s2_split_edges", with_ctes(_PLACED_EDGES, f=model.FILES, e=model.EDGES, n=_PLACED))
def s2_split_edges(spark, d):
    return snapshot.edges_of(_elements(spark, d)).drop("url")


@query(
    "s2_split_lists",
    with_ctes(
        "select k as key, case k when 'roots' then (select count(*) from {orders}) when 'revision' then 0 when 'date' then 0 else (select count(*) from f) end as entries, "
        "case when k in ('includes', 'included_by', 'esizes') then (select count(*) from e) else 0 end as inner_values, '' as problems "
        f"from (values {', '.join(f'({k!r})' for k in snapshot.KEYS)}) t(k)",
        f=model.FILES, e=model.EDGES,
    ),
)
def s2_split_lists(spark, d):
    elements = _elements(spark, d)
    counts = elements.groupBy("url", "key").agg(F.count_if(F.col("i").isNotNull() & F.col("j").isNull()).alias("entries"), F.count("j").alias("inner_values"))
    return counts.join(snapshot.load_problems(elements), "url").select("key", "entries", "inner_values", F.array_join("problems", ", ").alias("problems"))


# A snapshot for every nation, whose customers include the next; three of four are broken in some way.

_BROKEN = "case k % 6 when 1 then 'file names repeat' when 2 then 'roots repeat' when 3 then 'included_by doesn''t agree with includes' when 4 then 'sizes don''t go with includes' when 5 then 'numbers name no file, included_by doesn''t agree with includes' else '' end"
_OF_NATION = "select c_nationkey as k, count(*) as n from {customer} group by c_nationkey having count(*) >= 2"


@query("s2_load_checks", with_ctes(f"select 'nation ' || cast(k as varchar(20)) as url, {_BROKEN} as problems from c", c=_OF_NATION))
def s2_load_checks(spark, d):
    one = "filter(array({x}), v -> v is not null)"
    snapshots = rows(
        spark, d,
        "select 'nation ' || cast(k as varchar(20)) as url, 'r' as revision, '2024-05-01' as date, "
        "transform(at, i -> 'f' || cast(case when k % 6 = 1 and i = 1 then 0 else i end as varchar(20))) as files, case when k % 6 = 2 then array(0, 0) else array(0) end as roots, "
        f"transform(at, i -> {one.format(x='case when i + 1 < n then cast(i + 1 as int) when k % 6 = 5 then 9999999 end')}) as includes, "
        f"transform(at, i -> {one.format(x='case when i > 0 and k % 6 <> 3 then cast(i - 1 as int) end')}) as included_by, "
        "transform(at, i -> 1L) as sizes, transform(at, i -> 1L) as tsizes, transform(at, i -> 1L) as asizes, "
        f"transform(at, i -> {one.format(x='case when i + 1 < n and (k % 6 <> 4 or i > 0) or (i + 1 = n and k % 6 = 5) then 5L end')}) as esizes, transform(at, i -> 1L) as prevalence "
        f"from (select k, cast(n as int) as n, sequence(0, cast(n as int) - 1) as at from ({_OF_NATION}) c) x",
    )
    return analysis.load_problems(snapshots).select("url", F.array_join("problems", ", ").alias("problems"))


# A change for every order, whose patchsets are its lines, told as a review server tells them.

_REVISIONS = "select o_orderkey as id, o_orderstatus as f, cast(l_linenumber as int) as n from {orders} left join (select distinct l_orderkey, l_linenumber from {lineitem}) l on l_orderkey = o_orderkey"
_BODY = f"""')]}}}}' || chr(39) || chr(10) || '{{{{"project": "p' || {N.format('id')} || '", "branch": "' || f || '", "owner": {{{{"id": [1]}}}}, "revisions": {{{{' """


@query(
    "s19_change_details",
    with_ctes("select id, 'p' || cast(id as varchar(20)) as project, f as branch, coalesce(string_agg(cast(n as varchar(20)), ',' order by n), '') as numbers from r group by id, f", r=_REVISIONS),
)
def s19_change_details(spark, d):
    entry = f"""'"s' || {N.format('n')} || '": {{{{"_number": ' || {N.format('n')} || '}}}}'"""
    bodies = rows(spark, d, f"select id, {_BODY} || array_join(sort_array(collect_list({entry}), false), ', ') || '}}}}}}}}' as body from r group by id, f", r=_REVISIONS)
    return reviews.change_details(bodies).select("id", "project", "branch", F.array_join("numbers", ",").alias("numbers"))


@query("s3_prefixes", "select 'out/Debug/gen/' as gen_prefix, 'build/linux/s/' as sysroot, 'x86' as sysroot_platform")
def s3_prefixes(spark, d):
    return analysis.prefixes_of(analysis.files_of(analysis.parse_analysis(_raw(spark, d)))).drop("url")


_PAGE = "'<html><script>' || chr(10) || 'var a;</script><script>' || chr(10) || 'data = {{\"id\": ' || {k} || '}}' || chr(10) || '</script>' || case when {k0} % 2 = 0 then '<script>x</script>' else '' end"


@query("s5_html_data", "select doc_id, 'data = {{\"id\": ' || cast(doc_id as varchar(20)) || '}}' as data from {documents}")
def s5_html_data(spark, d):
    page = _PAGE.replace("{k}", "cast(doc_id as varchar(20))").replace("{k0}", "doc_id")
    return spark_sql(spark, d, f"select doc_id, {page} as html from {{documents}}").select("doc_id", analysis.html_data(F.col("html")).alias("data"))


@query("s10_changes_csv", f"select {_KIND} as change_type, l_linenumber as line, 'a \"q\", ' || {N.format('l_orderkey')} as includer, {N.format('l_partkey')} as header, cast(l_suppkey as varchar(20)) as weight from {{lineitem}}")
def s10_changes_csv(spark, d):
    quoted = f"'\"a \"\"q\"\", ' || {N.format('l_orderkey')} || '\"'"
    lines = spark_sql(spark, d, f"select {_KIND} || ',' || {N.format('l_linenumber')} || ',' || {quoted} || ',' || {N.format('l_partkey')} || ',' || {N.format('l_suppkey')} as value from {{lineitem}}")
    return analysis.read_changes(spark, written(spark, lines, "changes")).select("change_type", "line", "includer", "header", F.col("extra")[0].alias("weight"))


@query("s11_edge_lists", f"select distinct {N.format('l_orderkey')} as src, 'b \"x\"' || {N.format('l_partkey')} as dst from {{lineitem}} where l_returnflag <> 'N'")
def s11_edge_lists(spark, d):
    line = f"case l_returnflag when 'N' then '# ' else '' end || {N.format('l_orderkey')} || ',\"b \"\"x\"\"' || {N.format('l_partkey')} || '\"'"
    lists = [written(spark, spark_sql(spark, d, f"select {line} as value from {{lineitem}} where l_linenumber % 2 = {i} union all select ''"), "edges") for i in (0, 1)]
    paths = written(spark, spark.createDataFrame([(p,) for p in (*lists, " ")], "value string"), "paths")
    return analysis.read_edge_lists(spark, analysis.listed_paths(spark, paths))


@query("s12_plain_edge_lists", f"select distinct case l_returnflag when 'N' then '# ' else '' end || {N.format('l_orderkey')} as src, {N.format('l_partkey')} as dst from {{lineitem}}")
def s12_plain_edge_lists(spark, d):
    """Without comments: a row that starts with ``#`` is an edge."""
    line = f"case l_returnflag when 'N' then '# ' else '' end || {N.format('l_orderkey')} || ',' || {N.format('l_partkey')}"
    lists = written(spark, spark_sql(spark, d, f"select {line} as value from {{lineitem}} union all select ''"), "edges")
    return analysis.read_edge_lists(spark, [lists], comments=False)


@query("s16_header_results", "select c_name as header, c_custkey / 4.0::double as remaining_pct, 0.5::double as floor_pct, c_nationkey as dominated, c_custkey as tsize from {customer}")
def s16_header_results(spark, d):
    lines = spark_sql(spark, d, "select c_name || ',' || cast(c_custkey / 4.0 as double) || ',0.5,' || c_nationkey || ',' || c_custkey as value from {customer}")
    return analysis.read_header_results(spark, written(spark, lines, "results"))


_GIST = "case n_nationkey % 4 when 0 then 'http://gist.github.com/u/ab' || {k} || '/raw' when 1 then 'https://gist.github.com/u/ab' || {k} || '/' when 2 then 'https://gist.githubusercontent.com/u/ab' || {k} || '/raw' else 'https://example.com/u/' || {k} end".replace("{k}", "cast(n_nationkey as varchar(20))")


@query(
    "s18_gists",
    f"select url, n_nationkey % 4 <> 3 as is_gist, case when n_nationkey % 4 = 3 then url else 'https://gist.githubusercontent.com/u/ab' || cast(n_nationkey as varchar(20)) || '/raw' end as raw, "
    f"case when n_nationkey % 4 <> 3 then 'ab' || cast(n_nationkey as varchar(20)) end as gist from (select n_nationkey, {_GIST} as url from {{nation}}) x",
)
def s18_gists(spark, d):
    url = F.col("url")
    return spark_sql(spark, d, f"select {_GIST} as url from {{nation}}").select("url", analysis.is_gist_url(url).alias("is_gist"), analysis.gist_to_raw_url(url).alias("raw"), analysis.gist_id(url).alias("gist"))


# Sinks.

_TRICKY = "case c_custkey % 3 when 0 then 'a,' || c_name when 1 then 'say \"' || c_name || '\"' end"


@query("k1_csv_lines", f"select c_custkey, case when c_custkey % 3 = 0 then '\"a,' || c_name || '\"' when c_custkey % 3 = 1 then '\"say \"\"' || c_name || '\"\"\"' else '' end || ',' || cast(c_custkey as varchar(20)) || ',' || c_mktsegment as line from {{customer}}")
def k1_csv_lines(spark, d):
    return spark_sql(spark, d, f"select c_custkey, {_TRICKY} as t, c_mktsegment from {{customer}}").select("c_custkey", sinks.csv_line(F.col("t"), F.col("c_custkey"), F.col("c_mktsegment")).alias("line"))


@query("k2_percentages", "select c_custkey, printf('%.2f', c_custkey / 8.0::double) as pct, printf('%.2f', c_acctbal / 7.0::double) as share, printf('%.2f', (c_custkey * 5 - 0.0::double) / 1000.0::double) as small from {customer}")
def k2_percentages(spark, d):
    found = spark_sql(spark, d, "select c_custkey, c_custkey / 8.0d as x, c_acctbal / 7.0d as y, c_custkey * 5 / 1000.0d as z from {customer}")
    return found.select("c_custkey", *(sinks.percent(F.col(c)).alias(name) for c, name in (("x", "pct"), ("y", "share"), ("z", "small"))))


@query("k3_thousands", "select o_orderkey, format('{{:,}}', o_orderkey * 1000) as shown from {orders}")
def k3_thousands(spark, d):
    return spark_sql(spark, d, "select o_orderkey from {orders}").select("o_orderkey", sinks.thousands(F.col("o_orderkey") * 1000).alias("shown"))


@query("k4_json", "select '{{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"none\":null}}' as json from {nation}")
def k4_json(spark, d):
    return sinks.to_json(spark_sql(spark, d, "select n_nationkey, n_name, cast(null as string) as none from {nation}"))


@query("k6_prepended_edges", "select cast(row_number() over (order by prio, k) as int) as pos, line from (select 1 as prio, c_custkey as k, 'c' || cast(c_custkey as varchar(20)) || ',\"n,' || cast(c_nationkey as varchar(20)) || '\"' as line from {customer} union all select 0, s_suppkey, 's' || cast(s_suppkey as varchar(20)) || ',n' from {supplier}) x")
def k6_prepended_edges(spark, d):
    old = spark_sql(spark, d, "select c_custkey as pos, 'c' || cast(c_custkey as varchar(20)) as src, 'n,' || cast(c_nationkey as varchar(20)) as dst from {customer}")
    new = spark_sql(spark, d, "select s_suppkey as pos, 's' || cast(s_suppkey as varchar(20)) as src, 'n' as dst from {supplier}")
    lines = sinks.prepend_edges(new, old)
    path = written_to(spark, "prepended")
    sinks.write_lines(lines, path)
    return sinks.read_lines(spark, path).select(F.col("pos").cast("int").alias("pos"), "line")


# Dates, snapshots, lists.


@query("c1_dates", "select o_orderkey, o_orderdate as parsed from {orders}")
def c1_dates(spark, d):
    return spark_sql(spark, d, "select o_orderkey, cast(o_orderdate as varchar(40)) || case when o_orderkey % 2 = 0 then ' UTC' else '' end as raw from {orders}").select("o_orderkey", trends.parse_date(F.col("raw")).alias("parsed"))


_SNAPSHOTS = "select distinct o_orderdate as t from {orders}"


def _index(spark, d) -> DataFrame:
    """Names of snapshots, newest first, seven minutes after the orders' dates."""
    stamped = spark_sql(spark, d, f"select row_number() over (order by t desc) as pos, t + interval '7' minute as t from ({_SNAPSHOTS}) s")
    return stamped.select("pos", F.concat(F.lit("https://x.example/a_includes_"), F.date_format("t", "yyyy-MM-dd_HHmmss"), F.lit(".html")).alias("url"))


@query("c2_file_dates", f"select row_number() over (order by t desc) as pos, t + interval 7 minute as stamped from ({_SNAPSHOTS}) s")
def c2_file_dates(spark, d):
    return _index(spark, d).select("pos", trends.file_date(F.col("url")).alias("stamped"))


@query("j10_located_snapshot", f"select pos from (select row_number() over (order by t desc) as pos, t + interval 7 minute as t from ({_SNAPSHOTS}) s) i where date_trunc('hour', t) between (select date_trunc('hour', min(t)) from ({_SNAPSHOTS}) q) and (select date_trunc('hour', min(t)) + interval 1 hour from ({_SNAPSHOTS}) q) order by pos limit 1")
def j10_located_snapshot(spark, d):
    oldest = spark_sql(spark, d, f"select min(t) as t from ({_SNAPSHOTS}) s").first()["t"]
    return trends.locate(_index(spark, d), F.lit(oldest)).select("pos")


@query(
    "j9_nearest_older",
    "select days, t as snapshot, cast(age as int) as age from (select *, row_number() over (partition by age order by days) as k from (select days, max(t) as t, min(age) as age from "
    f"(select t, cast(floor(date_diff('microsecond', t, timestamp '1999-01-01 00:00:00') / 86400000000) as bigint) as age from ({_SNAPSHOTS}) s where t <= timestamp '1999-01-01 00:00:00') a "
    "join (values (0), (3), (7), (14), (30), (45)) v(days) on age >= days group by days) x) y where k = 1",
)
def j9_nearest_older(spark, d):
    return trends.nearest_older(spark_sql(spark, d, _SNAPSHOTS).withColumnRenamed("t", "snapshot"), "1999-01-01 00:00:00", [0, 3, 7, 14, 30, 45])


@query("c4_bucket_labels", "select n_nationkey, case when n_nationkey % 2 = 0 then cast(n_nationkey // 2 as varchar(20)) else cast(n_nationkey // 2 as varchar(20)) || '.5' end || '%' as label from {nation}")
def c4_bucket_labels(spark, d):
    return spark_sql(spark, d, "select n_nationkey from {nation}").select("n_nationkey", trends.bucket_label(F.col("n_nationkey") / 2).alias("label"))


_EDGE_DAY = "select {s} as src, {t} as dst, cast(sum(l_quantity) as bigint) as v from {{lineitem}} where l_shipdate < timestamp '{day}' group by 1, 2"
_EDGE_DAYS = [_EDGE_DAY.format(s=model.part("l_partkey").replace("{", "{{").replace("}", "}}"), t=model.SUPPLIER("l_suppkey"), day=day) for day in ("1999-01-01 00:00:00", "1998-06-01 00:00:00", "1997-06-01 00:00:00")]
_EDGE_FLAG = "case when prev = 0 then cur - prev >= 30 when cur > prev then (cur - prev) / prev::double >= 0.1 else abs(cur - prev) / prev::double >= 0.5 end"


@query(
    "f24_edge_diff",
    with_ctes(
        f"select src, dst, revision, cur - prev as difference, cur as current from (select *, row_number() over (partition by src, dst order by ord) as rn from j where (cur >= 40 or prev >= 40) and {_EDGE_FLAG}) x where rn = 1",
        n=_EDGE_DAYS[0], p1=_EDGE_DAYS[1], p2=_EDGE_DAYS[2],
        j="select n.src, n.dst, n.v as cur, coalesce(p1.v, 0) as prev, 1 as ord, 'r1' as revision from n left join p1 on p1.src = n.src and p1.dst = n.dst union all select n.src, n.dst, n.v, coalesce(p2.v, 0), 2, 'r2' from n left join p2 on p2.src = n.src and p2.dst = n.dst",
    ),
)
def f24_edge_diff(spark, d):
    now, one, two = (spark_sql(spark, d, day) for day in _EDGE_DAYS)
    before = one.select(F.lit(1).alias("ord"), F.lit("r1").alias("revision"), "src", "dst", "v").unionByName(two.select(F.lit(2).alias("ord"), F.lit("r2").alias("revision"), "src", "dst", "v"))
    return trends.diff(now, before, ["src", "dst"], "v", minimum=40, zero=30, increase=10, decrease=50, strict=False)


@query("l3_most_included", with_ctes("select dst as file, count(*) as n_roots, 100.0::double * count(*) / (select count(*) from r) as prevalence_pct, count(*) filter (src not like 'out/%') as n_own_roots from e where src in (select node from r) group by dst order by n_roots desc, file limit 25", e=model.EDGES, r=model.ROOTS))
def l3_most_included(spark, d):
    return metrics.most_included(_edges(spark, d), _roots(spark, d), 25, _roots(spark, d).count())


@query("l6_sorted_headers", "select c_name as header, c_acctbal as remaining_pct from {customer} order by coalesce(case when c_custkey % 3 > 0 then c_custkey % 100 end, 0) desc, c_name limit 40")
def l6_sorted_headers(spark, d):
    results = spark_sql(spark, d, "select c_name as header, c_acctbal as remaining_pct, case when c_custkey % 3 > 0 then c_custkey % 100 end as dominated from {customer}")
    return cuts.top_headers(results, "dominated", 40).select("header", "remaining_pct")


@query("x1_union_of_lists", with_ctes("select src, dst from u union select src, dst from e where esize >= 30", e=model.EDGES, u=model.UNUSED))
def x1_union_of_lists(spark, d):
    return closure.simple_graph(spark_sql(spark, d, model.UNUSED).unionByName(_edges(spark, d).filter("esize >= 30").select("src", "dst")))


@query("x3_unknown_skips", with_ctes("select src, dst from s except select src, dst from e", e=model.EDGES, s=f"select {model.order('l_orderkey')} as src, {model.part('l_suppkey')} as dst from {{lineitem}}"))
def x3_unknown_skips(spark, d):
    skips = spark_sql(spark, d, f"select {model.order('l_orderkey')} as src, {model.part('l_suppkey')} as dst from {{lineitem}}")
    return closure.unknown_skips(_edges(spark, d), skips)


@query("a14_degrees", with_ctes("select file as node, coalesce(o.n, 0)::bigint as out, coalesce(i.n, 0)::bigint as into_ from f left join (select src, count(*) as n from s group by src) o on o.src = f.file left join (select dst, count(*) as n from s group by dst) i on i.dst = f.file where o.n is not null or i.n is not null", f=model.FILES, s=f"select distinct src, dst from ({model.EDGES}) x"))
def a14_degrees(spark, d):
    return metrics.degrees(_edges(spark, d)).select("node", F.col("out").cast("long"), F.col("into").cast("long").alias("into_"))
