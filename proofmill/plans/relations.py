"""Queries over imports, relations, fixtures and line intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.operators import adapters as ad
from proofmill.operators import intervals as iv
from proofmill.operators import relations as rl
from proofmill.plans import duck as d
from proofmill.plans.registry import oracle_view, query
from proofmill.plans.views import VIEWS

JS = f"{d.rx('path', fv.SCRIPT_SOURCE)}"


@query("scan_imports_js", f"""
select full_name, path, specifier, count(*) as n from (
  select full_name, path, unnest(list_concat(list_concat(regexp_extract_all(content, {d.lit(fv.IMPORT_FROM)}, 1), regexp_extract_all(content, {d.lit(chr(92) + 'b' + fv.REQUIRE_CALL)}, 1)),
    regexp_extract_all(content, {d.lit(chr(92) + 'b' + fv.DYNAMIC_IMPORT)}, 1))) as specifier from v_blobs where {JS}) group by all""")
def _(v):
    return rl.scan_imports_js(v("v_blobs")).groupBy("full_name", "path", "specifier").agg(F.count("*").alias("n"))


# The generated files import by document number, so the right target is known.
oracle_view("o_js_edges", """
select a.full_name, a.path, a.doc_id, b.path as target, case when b.doc_id = a.doc_id + 180 then '../../src/core/m' || b.doc_id || '.js'
    when a.k = 4 then '../../src/core/m' || b.doc_id else './m' || b.doc_id end as specifier
from v_files a join v_files b on a.full_name = b.full_name and b.k = 3 and ((a.k = 3 and b.doc_id = a.doc_id + 200) or (a.k = 4 and b.doc_id in (a.doc_id - 20, a.doc_id + 180)))""")


@query("resolve_relative_imports", "select full_name, path, specifier, target from o_js_edges")
def _(v):
    return rl.resolve_relative_imports(rl.scan_imports_js(v("v_blobs")), v("v_tree"))


@query("build_relations", "select full_name, path as src, target as dst, case when path like 'test/%' then 'tests' else 'imports' end as kind from o_js_edges")
def _(v):
    return rl.build_relations(rl.scan_imports_js(v("v_blobs")), v("v_tree"))


VIEWS["v_declared_roots"] = "select full_name, 'pyproject.toml' as path, case when full_name like '%/r1' then 'test' when full_name like 'src3/%' then '../up' else 'src' end as root from v_extra where k = 11"


@query("python_import_roots", """
select distinct full_name, unnest(['.', 'src']) as root from v_files union select full_name, root from v_declared_roots where root <> '../up'""")
def _(v):
    return rl.python_import_roots(v("v_tree"), v("v_declared_roots"))


VIEWS["v_py_imports"] = """
select full_name, path, @i(1) as line, @i(1) as level, 'm' || @s(doc_id + 200) as module, @arr('run') as names from v_files where k = 2
union all select full_name, path, 2, 0, 'json', @noarr from v_files where k = 2
union all select full_name, path, 3, 0, 'core.util', @noarr from v_files where k = 2
union all select full_name, path, 1, 0, 'pytest', @noarr from v_files where k = 5
union all select full_name, path, 2, 0, 'app.m' || @s(doc_id - 60), @arr('run') from v_files where k = 5
union all select full_name, path, 3, 0, 'app', @arr('m' || @s(doc_id - 60), 'gone') from v_files where k = 5
union all select full_name, path, 4, 3, '', @arr('x') from v_files where k = 5
union all select full_name, path, 5, 0, 'not-a-name', @noarr from v_files where k = 5"""
oracle_view("o_py_edges", """
select a.full_name, a.path, i.line, i.level, i.module, b.path as dst from v_files a join v_py_imports i on a.full_name = i.full_name and a.path = i.path
join v_files b on b.full_name = a.full_name and b.k = 2 and ((a.k = 2 and i.line = 1 and b.doc_id = a.doc_id + 200) or (a.k = 5 and i.line in (2, 3) and b.doc_id = a.doc_id - 60))""")
oracle_view("o_py_unresolved", """
select i.full_name, i.path, i.line, i.level, i.module, case when i.module = 'core.util' and r.root = 'test' and s.n = 2 then 'ambiguous-package-prefix' else 'external-missing-or-unsupported-target' end as reason
from v_py_imports i left join v_declared_roots r on i.full_name = r.full_name
left join (select full_name, count(distinct k) as n from v_files where k in (3, 4) group by 1) s on s.full_name = i.full_name
where (i.full_name, i.path, i.line) not in (select full_name, path, line from o_py_edges)""")


def py(v):
    return rl.resolve_python_imports(v("v_py_imports"), rl.python_import_roots(v("v_tree"), v("v_declared_roots")), v("v_tree"))


@query("resolve_python_imports", "select full_name, path, line, level, module, dst, null as reason from o_py_edges union all select full_name, path, line, level, module, null, reason from o_py_unresolved")
def _(v):
    edges, un = py(v)
    return edges.withColumn("reason", F.lit(None).cast("string")).unionByName(un, allowMissingColumns=True)


VIEWS["v_rs_imports"] = """
select full_name, path, @i(1) as line, 'crate::rs::m' || @s(doc_id + 200) || '::Thing' as module, 'use' as kind, 'module' as scope, @noarr as context from v_files where k = 8
union all select full_name, path, 2, 'super::m' || @s(doc_id + 20) || '::go', 'use', 'module', @noarr from v_files where k = 8
union all select full_name, path, 3, 'std::fmt', 'use', 'module', @noarr from v_files where k = 8
union all select full_name, path, 4, 'inner', 'module', 'module', @noarr from v_files where k = 8
union all select full_name, path, 5, 'super::super::super::x', 'use', 'module', @noarr from v_files where k = 8
union all select full_name, path, 6, 'odd', 'module', 'module', @arr('path = elsewhere') from v_files where k = 8
union all select full_name, path, 1, 'super::m' || @s(doc_id - 20) || '::Thing', 'use', 'module', @noarr from v_files where k = 9
union all select full_name, path, 2, 'self::deep::x', 'use', 'module', @noarr from v_files where k = 9
union all select full_name, path, 3, 'crate', 'use', 'module', @noarr from v_files where k = 9
union all select full_name, path, 4, 'super::super::m' || @s(doc_id - 20), 'use', 'checks', @arr('cfg(test)') from v_files where k = 9"""
oracle_view("o_rs_edges", """
select a.full_name, a.path, i.line, i.module, b.path as dst from v_files a join v_rs_imports i on a.full_name = i.full_name and a.path = i.path join v_files b on b.full_name = a.full_name and (
  (a.k = 8 and i.line = 1 and b.k = 8 and b.doc_id = a.doc_id + 200) or (a.k = 8 and i.line = 2 and b.k = 9 and b.doc_id = a.doc_id + 20) or (a.k = 9 and i.line in (1, 4) and b.k = 8 and b.doc_id = a.doc_id - 20))""")
oracle_view("o_rs_unresolved", """
select full_name, path, line, module, case when module = 'inner' then 'inline-generated-or-missing-module' when module = 'odd' then 'explicit-path-module-unsupported' when module = 'std::fmt' then 'extern-prelude-or-ambiguous-bare-use'
  when module = 'super::super::super::x' then 'use-escapes-crate-root' when module = 'crate' then 'ambiguous-or-missing-crate-entry' else 'external-missing-generated-or-inline-module' end as reason
from v_rs_imports where (full_name, path, line) not in (select full_name, path, line from o_rs_edges)""")


def rs(v):
    return rl.resolve_rust_imports(v("v_rs_imports"), v("v_tree"))


@query("resolve_rust_imports", "select full_name, path, line, module, dst, null as reason from o_rs_edges union all select full_name, path, line, module, null, reason from o_rs_unresolved")
def _(v):
    edges, un = rs(v)
    return edges.withColumn("reason", F.lit(None).cast("string")).unionByName(un, allowMissingColumns=True)


@query("unresolved_imports", """
select * from (select full_name, path, line, module, reason from o_py_unresolved union all select full_name, path, line, module, reason from o_rs_unresolved)""")
def _(v):
    return rl.unresolved_imports([py(v)[1], rs(v)[1]])


# Parsed imports of every other script file, with their lines; the rest is read from text.
VIEWS["v_js_parsed"] = """
select full_name, path, @i(1) as line, './m' || @s(doc_id + 200) as module, cast(null as string) as scope, @noarr as context, @arr('run') as aliases from v_files where k = 3 and doc_id % 2 = 0
union all select full_name, path, 1, '../../src/core/m' || @s(doc_id - 20), 'module', @noarr, @arr('run') from v_files where k = 4 and doc_id % 2 = 0
union all select full_name, path, 2, '../../src/core/m' || @s(doc_id + 180) || '.js', 'later', @arr('dynamic'), @noarr from v_files where k = 4 and doc_id % 2 = 0
union all select full_name, path, 7, '../../src/core/m' || @s(doc_id - 20), 'module', @noarr, @arr('again') from v_files where k = 4 and doc_id % 2 = 0
union all select full_name, path, 3, 'react', 'module', @noarr, @arr('x') from v_files where k = 4 and doc_id % 2 = 0"""
oracle_view("o_typed", """
select e.full_name, e.path as src, e.target as dst, case when e.path like 'test/%' then 'tests' else 'imports' end as kind, 'script' as language, case when e.doc_id % 2 = 0 then case when e.specifier like '%.js' then 2 else 1 end end as line,
  case when e.doc_id % 2 = 0 then 'static-candidate' end as resolution, case when e.doc_id % 2 = 0 then case when e.specifier like '%.js' then 'later' else 'module' end end as scope,
  case when e.doc_id % 2 = 0 and e.specifier like '%.js' then 'dynamic' else '' end as context, case when e.doc_id % 2 = 0 and e.specifier not like '%.js' then 'run' else '' end as aliases from o_js_edges e
union all select distinct full_name, path, dst, case when path like 'tests/%' then 'tests' else 'imports' end, 'python', line, 'static-candidate', 'module', '', '' from o_py_edges
union all select distinct e.full_name, e.path, e.dst, case when array_to_string(i.context, '|') like '%cfg(test)%' or e.path like 'tests/%' then 'tests' else 'imports' end, 'rust', e.line, 'rust-module-candidate', i.scope, array_to_string(i.context, '|'), ''
  from o_rs_edges e join v_rs_imports i on i.full_name = e.full_name and i.path = e.path and i.line = e.line and i.module = e.module""")


@query("typed_relations", "select full_name, src, dst, kind, language, cast(line as bigint) as line, resolution, scope, context, aliases from o_typed")
def _(v):
    out = rl.typed_relations(v("v_tree"), v("v_blobs"), v("v_js_parsed"), v("v_py_imports"), py(v)[0], v("v_rs_imports"), rs(v)[0])
    return out.select(*rl.TYPED, "scope", *[F.array_join(c, "|").alias(c) for c in ("context", "aliases")])


oracle_view("o_links", """
select f.full_name, f.path as test_path, 'test_run_' || f.doc_id as test_symbol, r.request, case when r.request = 'missing_res' then 'unresolved' else 'candidate' end as status,
  case r.request when 'local_res' then f.path when 'shared' then 'tests/conftest.py' end as fixture_path, case when r.request <> 'missing_res' then r.request end as fixture_symbol,
  case when r.request = 'missing_res' then 'fixture-not-inspected-or-external-plugin' else 'lexically-visible-fixture' end as reason
from v_files f cross join (select unnest(['local_res', 'missing_res', 'shared']) as request) r where f.k = 5""")


def parsed_symbols(v):
    return ad.analysis_symbols(ad.python_symbols(v("v_blobs").filter("path like '%.py'")))


@query("link_fixtures", "select * from o_links")
def _(v):
    return rl.link_fixtures(parsed_symbols(v))


@query("fixture_scope_completeness", """
select full_name, test_path, test_symbol, request, case when full_name like '%/r1' then 'unresolved' else status end as status, case when full_name not like '%/r1' then fixture_path end as fixture_path,
  case when full_name not like '%/r1' then fixture_symbol end as fixture_symbol, case when full_name like '%/r1' then 'fixture-scope-not-completely-inspected' else reason end as reason from o_links""")
def _(v):
    symbols = parsed_symbols(v)
    parsed = symbols.filter("not (full_name like '%/r1' and path = 'tests/conftest.py')").select("full_name", "path").distinct()
    return rl.fixture_scope_completeness(rl.link_fixtures(symbols), v("v_tree"), parsed)


# -- intervals ------------------------------------------------------------------------
oracle_view("o_pinned", "select * from v_slices where revision = 'r1'")
oracle_view("o_covered_lines", "select full_name, path, unnest(range(start_line, end_line + 1)) as line from o_pinned")
oracle_view("o_symbol_cover", """
select s.full_name, s.path, s.name, count(distinct c.line) = any_value(s.end_line - s.start_line + 1) as covered from v_symbols s left join o_covered_lines c
  on s.full_name = c.full_name and s.path = c.path and c.line between s.start_line and s.end_line where s.end_line >= s.start_line group by 1, 2, 3""")


def pinned(v):
    return iv.same_revision(v("v_slices"), v("v_tree").select("full_name", "revision"))[0]


def symbol_cover(v):
    return iv.interval_cover(v("v_symbols"), pinned(v), ["full_name", "path", "name"])


@query("interval_cover", "select full_name, path, name from o_symbol_cover where covered")
def _(v):
    return symbol_cover(v).select("full_name", "path", "name")


oracle_view("o_sym_first", """
select y.full_name, y.path, y.name, y.end_line, arg_min(p.slice_id, row(-p.end_line, p.start_line, p.slice_id)) as slice_id, max(p.end_line) as far from v_symbols y
join o_pinned p on p.full_name = y.full_name and p.path = y.path and p.start_line <= y.start_line and p.end_line >= y.start_line where y.end_line >= y.start_line group by 1, 2, 3, 4""")
oracle_view("o_sym_second", """
select f.full_name, f.path, f.name, arg_min(p.slice_id, row(-p.end_line, p.start_line, p.slice_id)) as slice_id, max(p.end_line) as far from o_sym_first f
join o_pinned p on p.full_name = f.full_name and p.path = f.path and p.start_line <= f.far + 1 and p.end_line >= f.far + 1 where f.far < f.end_line group by 1, 2, 3""")


# Ten-line windows at stride five: one or two of them always decide a five-line range.
@query("interval_witnesses", """
select f.full_name, f.path, f.name, concat_ws('|', f.slice_id, s.slice_id) as witnesses from o_sym_first f
left join o_sym_second s on s.full_name = f.full_name and s.path = f.path and s.name = f.name where f.far >= f.end_line or s.far >= f.end_line""")
def _(v):
    return symbol_cover(v).withColumn("witnesses", F.array_join("witnesses", "|"))


@query("same_revision", "select slice_id, revision = 'r1' as kept from v_slices")
def _(v):
    kept, out = iv.same_revision(v("v_slices"), v("v_tree").select("full_name", "revision"))
    return kept.select("slice_id", F.lit(True).alias("kept")).unionByName(out.select("slice_id", F.lit(False).alias("kept")))


ANCHOR = r"'#L(\d+)(?:-L?(\d+))?$'"
oracle_view("o_support", f"""
with e as (select r.*, try_cast(nullif(regexp_extract(source_url, {ANCHOR}, 1), '') as bigint) as s, try_cast(coalesce(nullif(regexp_extract(source_url, {ANCHOR}, 2), ''), nullif(regexp_extract(source_url, {ANCHOR}, 1), '')) as bigint) as t from v_relations r),
c as (select e.full_name, e.src, e.dst, e.kind, e.source_url, count(distinct line) as n from e join o_covered_lines l on l.full_name = e.full_name and l.path = e.src and l.line between s and t group by 1, 2, 3, 4, 5),
g as (select full_name, path, arg_min(slice_id, (strategy = 'line-window', -relevance, start_line, slice_id)) as target from o_pinned group by 1, 2)
select e.full_name, e.src, e.dst, e.kind, e.source_url, e.s, e.t, e.evidence_path = e.src and e.s is not null as located, coalesce(c.n = e.t - e.s + 1, false) as covered, g.target from e
left join c on c.full_name = e.full_name and c.src = e.src and c.dst = e.dst and c.kind = e.kind and c.source_url = e.source_url left join g on g.full_name = e.full_name and g.path = e.dst""".replace("(strategy = 'line-window', -relevance, start_line, slice_id)", "row(strategy = 'line-window', -relevance, start_line, slice_id)"))


def support(v):
    return iv.relation_support(v("v_relations"), pinned(v))


@query("relation_support", """
select full_name, src, dst, kind, source_url, located and covered and target is not null as supported,
  concat_ws('|', case when not located then 'no-source-line' when not covered then 'source-lines-not-covered' end, case when target is null then 'no-target-evidence' end) as limitations,
  target from o_support""")
def _(v):
    out = support(v)
    best = pinned(v).groupBy("full_name", F.col("path").alias("dst")).agg(F.min(F.struct(
        (F.col("strategy") == "line-window").alias("p"), (-F.col("relevance")).alias("r"), "start_line", "slice_id")).alias("b"))
    out = out.join(best.select("full_name", "dst", F.col("b.slice_id").alias("target")), ["full_name", "dst"], "left")
    return out.select("full_name", "src", "dst", "kind", "source_url", "supported", F.array_join("limitations", "|").alias("limitations"),
                      F.when(F.array_contains("slice_ids", F.col("target")), F.col("target")).alias("target"))


@query("fixture_support", """
with spans as (select full_name, path as test_path, 8 as s, 9 as t, 4 as fs, 6 as ft from v_files where k = 5),
asked as (select x.full_name, x.test_path, count(distinct case when line between s and t then line end) = 2 as ask, count(distinct case when line between fs and ft then line end) = 3 as own
  from spans x left join o_covered_lines c on c.full_name = x.full_name and c.path = x.test_path group by 1, 2)
select l.full_name, l.test_path, l.test_symbol, l.request, l.request = 'local_res' and ask and own as supported,
  concat_ws('|', case when status <> 'candidate' then 'unresolved' end, case when not ask then 'requester-not-covered' end, case when not (l.request = 'local_res' and own) then 'provider-not-covered' end) as limitations
from o_links l join asked a on l.full_name = a.full_name and l.test_path = a.test_path""")
def _(v):
    symbols = parsed_symbols(v)
    out = iv.fixture_support(rl.link_fixtures(symbols), symbols, pinned(v))
    return out.select("full_name", "test_path", "test_symbol", "request", "supported", F.array_join("limitations", "|").alias("limitations"))
