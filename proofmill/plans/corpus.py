"""Queries over landed corpora: readers, row checks, manifests, parsers and text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import text as tx
from proofmill.operators import adapters as ad
from proofmill.operators import structure as st
from proofmill.plans import duck as d
from proofmill.plans.registry import oracle_view, query
from proofmill.plans.views import VIEWS
from proofmill.sources import manifests as mf
from proofmill.sources import scans
from proofmill.sources import sinks

# Catalogue rows in the raw shape of a code host, some of them broken.
VIEWS["v_raw_repos"] = """
select case p_partkey % 41 when 40 then 'no owner' when 39 then '' else full_name end as full_name,
  case p_partkey % 37 when 36 then 'ftp://host.example/x' when 35 then 'https://u:p@host.example/' || full_name when 34 then 'not a url' else 'https://host.example/' || full_name end as html_url,
  case when p_partkey % 3 = 0 then null else description end as description,
  cast(case when p_partkey % 43 = 42 then -1 else stars end as double) as stargazers_count, cast(forks as double) as forks_count,
  cast(case when p_partkey % 47 = 46 then null else open_issues end as double) as open_issues_count, cast(size_kb as double) as size,
  case when p_partkey % 53 = 52 then null else archived end as archived, fork, 'main' as default_branch,
  case p_partkey % 31 when 30 then 'yesterday' when 29 then '' else '2001-02-0' || @s(1 + p_partkey % 9) || 'T10:20:30Z' end as pushed_at,
  '1999-05-06T00:00:00Z' as created_at, case p_partkey % 4 when 0 then 'NOASSERTION' when 1 then '' when 2 then license end as spdx_id, language,
  case when p_partkey % 2 = 0 then topics end as topics
from v_catalog"""
NUMS = ["stargazers_count", "forks_count", "open_issues_count", "size"]


def raw(v):
    return v("v_raw_repos").withColumn("license", F.when(F.col("spdx_id").isNotNull(), F.struct("spdx_id")))


@query("scan_repositories", """
select full_name, html_url, coalesce(description, '') as description, cast(stargazers_count as bigint) as stars, cast(forks_count as bigint) as forks, cast(size as bigint) as size_kb,
  archived, fork, try_cast(nullif(pushed_at, '') as timestamp) is not null as pushed_ok, case when spdx_id not in ('', 'NOASSERTION') then spdx_id end as license,
  coalesce(array_to_string(topics, '|'), '') as topics from v_raw_repos""")
def _(v):
    # Each row as one JSON document, read back with the declared schema.
    text = raw(v).drop("spdx_id").select(F.to_json(F.struct("*")).alias("doc"))
    rows = text.select(F.from_json("doc", scans.RAW_REPOSITORY).alias("r")).select("r.*")
    out = scans.shape_repositories(rows)
    return out.select("full_name", "html_url", "description", "stars", "forks", "size_kb", "archived", "fork",
                      F.col("pushed_at").isNotNull().alias("pushed_ok"), "license", F.array_join("topics", "|").alias("topics"))


@query("validate_repositories", f"""
select full_name, html_url, {d.reasons(
    ("coalesce(full_name, '') = ''", "'empty:full_name'"), ("coalesce(html_url, '') = ''", "'empty:html_url'"), ("coalesce(pushed_at, '') = ''", "'empty:pushed_at'"),
    ("not regexp_matches(full_name, '(?i)^[a-z0-9_.-]+/[a-z0-9_.-]+$')", "'name-shape'"), ("not regexp_matches(html_url, '(?i)^https?://[^/?#@\\s]+([/?#].*)?$')", "'url-shape'"),
    ("try_cast(pushed_at as timestamp) is null", "'date:pushed_at'"), *[(f"coalesce({c} < 0, true)", f"'count:{c}'") for c in NUMS], ("archived is null", "'flag:archived'"))} as reasons
from v_raw_repos""")
def _(v):
    good, bad = scans.validate_repositories(raw(v))
    rows = good.withColumn("reasons", F.array().cast("array<string>")).unionByName(bad)
    return rows.select("full_name", "html_url", F.array_join("reasons", "|").alias("reasons"))


VIEWS["v_raw_trees"] = {
    "spark": "select full_name, revision, truncated, collect_list(named_struct('path', path, 'type', type, 'sha', sha, 'size', size)) as tree from v_raw_entries group by 1, 2, 3",
    "duck": "select full_name, revision, truncated, list({'path': path, 'type': type, 'sha': sha, 'size': size}) as tree from v_raw_entries group by 1, 2, 3"}
VIEWS["v_raw_entries"] = """
select full_name, revision, path, case when path like '%.yml' then 'commit' else 'blob' end as type, 's' || path as sha,
  cast(case when full_name like 'src7/%' and path like 'docs/%' then -1 else size end as double) as size, full_name like 'src5/%' as truncated from v_tree"""


@query("scan_trees", """
select full_name, path, type, cast(size as bigint) as size, null as reason from v_raw_entries where type in ('blob', 'tree') and full_name not like 'src5/%' and full_name not in (select full_name from v_raw_entries where size < 0)
union all select distinct full_name, null, null, cast(null as bigint), case when truncated then 'tree-truncated' else 'tree-malformed' end from v_raw_entries where truncated or size < 0""")
def _(v):
    good, bad = scans.scan_trees(v("v_raw_trees"))
    return good.select("full_name", "path", "type", "size", F.lit(None).cast("string").alias("reason")).unionByName(
        bad.select("full_name", "reason"), allowMissingColumns=True)


VIEWS["v_encoded"] = {
    "spark": "select full_name, path, concat(case when doc_id % 5 = 1 then '*' else '' end, substring(b, 1, length(b) - case when doc_id % 7 = 2 then 1 else 0 end), case when doc_id % 3 = 0 then chr(10) else '' end) as encoded from (select doc_id, full_name, path, base64(encode(content, 'UTF-8')) as b from v_files) x",
    "duck": "select full_name, path, case when doc_id % 5 = 1 then '*' else '' end || substring(b, 1, length(b) - case when doc_id % 7 = 2 then 1 else 0 end) || case when doc_id % 3 = 0 then chr(10) else '' end as encoded from (select doc_id, full_name, path, base64(encode(content)) as b from v_files) x"}


@query("decode_blobs", """
select full_name, path, case when ok then sha256(decode(from_base64(e))) end as content_hash, case when not ok then 'invalid-base64' end as reason from (
  select full_name, path, regexp_replace(encoded, '\\s+', '', 'g') as e, length(regexp_replace(encoded, '\\s+', '', 'g')) % 4 = 0 and regexp_matches(regexp_replace(encoded, '\\s+', '', 'g'), '^[A-Za-z0-9+/]*={0,2}$') as ok from v_encoded)""")
def _(v):
    return scans.judged_blobs(v("v_encoded")).select("full_name", "path", F.sha2("content", 256).alias("content_hash"), "reason")


VIEWS["v_odd_paths"] = """
select full_name, case size % 8 when 0 then '/' || path when 1 then 'a//' || path when 2 then './' || path when 3 then path || '/..' when 4 then replace(path, '/', chr(92)) when 5 then path || chr(10) else path end as path from v_tree"""
SAFE = "path <> '' and path not like '/%' and not contains(path, chr(92)) and not list_has_any(split(path, '/'), ['', '.', '..']) and not contains(path, chr(10)) and not contains(path, chr(13)) and not contains(path, chr(0))"


@query("filter_safe_paths", f"select full_name, path, case when not ({SAFE}) then 'unsafe-path' end as reason from v_odd_paths")
def _(v):
    good, bad = st.filter_safe_paths(v("v_odd_paths"))
    return good.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


VIEWS["v_odd_blobs"] = """
select full_name, revision, path, case when coalesce(doc_id, 0) % 10 = 6 then null when doc_id % 9 = 4 then '  ' || chr(10) when doc_id % 9 = 5 then content || chr(0) else content end as content from v_blobs"""


@query("filter_text_blobs", """
select t.full_name, t.path, case when b.content is null then 'missing-content' when contains(b.content, chr(0)) then 'binary-content'
  when not regexp_matches(b.content, '[^\\s]') then 'empty-content' end as reason, case when not contains(b.content, chr(0)) and regexp_matches(b.content, '[^\\s]') then length(b.content) end as chars
from v_tree t left join v_odd_blobs b on t.full_name = b.full_name and t.path = b.path""")
def _(v):
    ok, bad = st.filter_text_blobs(v("v_tree"), v("v_odd_blobs"))
    return ok.select("full_name", "path", F.lit(None).cast("string").alias("reason"), F.length("content").cast("long").alias("chars")).unionByName(
        bad.select("full_name", "path", "reason"), allowMissingColumns=True)


@query("line_split", "select full_name, path, generate_subscripts(split(content, chr(10)), 1) as line, unnest(split(content, chr(10))) as text from v_blobs")
def _(v):
    return st.line_split(v("v_blobs")).drop("revision")


oracle_view("o_lines", "select full_name, path, generate_subscripts(split(content, chr(10)), 1) as line, unnest(split(content, chr(10))) as text from v_blobs")
LANG = "case " + " ".join(f"when regexp_matches(path, '\\.{e}$') then '{n}'" for e, n in st.LANGUAGE_BY_EXTENSION.items()) + " end"


@query("declaration_scan", f"select full_name, path, line, 'textual' as strength from o_lines where case {LANG} " + " ".join(
    f"when '{n}' then regexp_matches(text, {d.lit(rx)})" for n, rx in fv.DECLARATION_LINES.items()) + " else false end")
def _(v):
    return st.declaration_scan(st.line_split(v("v_blobs")), st.path_language(F.col("path"))).select("full_name", "path", "line", "strength")


@query("source_url", """
select full_name, path, start_line, 'https://host.example/' || full_name || '/blob/' || revision || '/' || array_to_string(list_transform(split(path, '/'), lambda s: url_encode(s)), '/') || '#L' || start_line || '-L' || end_line as url
from (select full_name, revision, replace(path, 'm', 'm é (') as path, start_line, end_line from v_slices)""".replace("url_encode(s)", "replace(replace(url_encode(s), '%28', '('), '%29', ')')"))
def _(v):
    s = v("v_slices").withColumn("path", F.replace("path", F.lit("m"), F.lit("m é (")))
    base = F.concat(F.lit("https://host.example/"), "full_name")
    return s.select("full_name", "path", "start_line", tx.source_url(base, F.col("revision"), F.col("path"), F.col("start_line"), F.col("end_line")).alias("url"))


@query("parse_line_anchor", r"""
select full_name, src, dst, cast(nullif(regexp_extract(source_url, '#L(\d+)(?:-L?(\d+))?$', 1), '') as bigint) as start_line,
  cast(coalesce(nullif(regexp_extract(source_url, '#L(\d+)(?:-L?(\d+))?$', 2), ''), nullif(regexp_extract(source_url, '#L(\d+)(?:-L?(\d+))?$', 1), '')) as bigint) as end_line from v_relations""")
def _(v):
    return v("v_relations").select("full_name", "src", "dst", tx.line_anchor(F.col("source_url")).alias("a")).select("full_name", "src", "dst", "a.*")


@query("stable_id", f"select slice_id, {d.stable_id('full_name', 'revision', 'path', 'cast(start_line as varchar)', 'cast(end_line as varchar)')} as again, 'bp_failure_semantics_' || {d.stable_id('full_name', 'revision', chr(39) + 'failureSemantics' + chr(39), 'path')} as section_id from v_slices")
def _(v):
    s = v("v_slices")
    return s.select("slice_id", tx.stable_id(*[F.col(c) for c in ("full_name", "revision", "path", "start_line", "end_line")]).alias("again"),
                    tx.section_id(F.lit("failureSemantics"), F.col("full_name"), F.col("revision"), F.lit("failureSemantics"), F.col("path")).alias("section_id"))


@query("bounded_summary", f"""
select slice_id, case when length(s) <= 320 then s else substring(s, 1, 319) || '…' end as s320, case when length(s) <= 120 then s else rtrim(substring(s, 1, 119)) || '…' end as s120
from (select slice_id, {d.collapsed('content')} as s from v_slices)""")
def _(v):
    c = F.col("content")
    return v("v_slices").select("slice_id", tx.bounded_summary(c).alias("s320"), tx.bounded_summary(c, 120, True).alias("s120"))


@query("write_pack", "select full_name as pack_id, count(*) as slices, cast(sum(length(content)) as bigint) as chars from v_slices group by 1")
def _(v):
    folder = sinks.work_folder(v.spark)
    slices = v("v_slices").withColumnRenamed("full_name", "pack_id")
    bundles = v("v_bundles").withColumnRenamed("full_name", "pack_id")
    sinks.write_pack({"slices": slices, "bundles": bundles}, folder)
    back = sinks.read_pack(v.spark, folder, "slices")
    return back.groupBy("pack_id").agg(F.count("*").alias("slices"), F.sum(F.length("content")).alias("chars"))


J = lambda path: f"json_extract_string(content, '{path}')"


@query("package_manifest_facts", f"""
select full_name, path, case when ok then {J('$.name')} end as package_name, case when ok then array_to_string(list_sort(list_concat(json_keys(content, '$.dependencies'), json_keys(content, '$.peerDependencies'))), '|') else '' end as dependencies,
  case when ok then array_to_string(json_keys(content, '$.devDependencies'), '|') else '' end as dev_dependencies, case when ok then array_to_string(json_keys(content, '$.scripts'), '|') else '' end as scripts,
  case when ok then {J('$.workspaces[0]')} else '' end as workspaces,
  case when ok then regexp_replace({J('$.main')}, '^\\./', '') || '|' || regexp_replace({J('$.exports."."."import"')}, '^\\./', '') else '' end as entry_targets, case when ok then 'parsed' else 'invalid' end as status
from (select full_name, path, case when json_valid(content) then content else 'null' end as content, json_valid(content) as ok from v_blobs where path like '%package.json')""")
def _(v):
    out = mf.package_manifest_facts(v("v_blobs"))
    return out.select("full_name", "path", "package_name", *[F.array_join(c, "|").alias(c) for c in (
        "dependencies", "dev_dependencies", "scripts", "workspaces", "entry_targets")], "status")


@query("cargo_manifest_facts", """
select full_name, path, replace(full_name, '/', '_') as package_name, '2021' as edition, 'dep' || files % 7 || '|serde' as dependencies, 'proptest' as dev_dependencies, 'fast' as features,
  'crates/a|crates/b' as workspaces, 'src/rs/m' || (first_doc + 160) || '.rs' as entry_targets, 'partial' as status
from v_extra join (select full_name, count(*) as files, min(doc_id) as first_doc from v_docs group by 1) using (full_name) where k = 12""")
def _(v):
    out = mf.cargo_manifest_facts(v("v_blobs"))
    return out.select("full_name", "path", "package_name", "edition", *[F.array_join(c, "|").alias(c) for c in (
        "dependencies", "dev_dependencies", "features", "workspaces", "entry_targets")], "status")


@query("python_manifest_facts", """
select full_name, path, replace(full_name, '/', '-') as package_name, 'dep' || files % 7 || '>=1|numpy|requests' as dependencies, 'pytest' as dev_dependencies, 'run-it' as scripts,
  'app.m' || (first_doc + 40) || ':run' as entry_targets, 'src' as import_roots, 'pep621' as format, 'complete' as completeness, 'parsed' as status
from v_extra join (select full_name, count(*) as files, min(doc_id) as first_doc from v_docs group by 1) using (full_name) where k = 11""")
def _(v):
    out = mf.python_manifest_facts(v("v_blobs"))
    return out.select("full_name", "path", "package_name", *[F.array_join(c, "|").alias(c) for c in (
        "dependencies", "dev_dependencies", "scripts", "entry_targets", "import_roots")], "format", "completeness", "status")


@query("python_symbols", """
select full_name, path, 'parsed' as status, unnest(case k when 2 then ['Store' || doc_id || ':class:4:10', 'Store' || doc_id || '.check:function:6:10', 'run:function:12:16']
    when 5 then ['local_res:function:4:6', 'test_run_' || doc_id || ':function:8:9'] else ['shared:function:3:5'] end) as symbol
from v_blobs where path like '%.py' and not (k = 2 and n % 30 = 12)
union all select full_name, path, 'invalid', null from v_blobs where k = 2 and n % 30 = 12""")
def _(v):
    out = ad.python_symbols(v("v_blobs"))
    named = F.transform("symbols", lambda s: F.concat_ws(":", s["name"], s["kind"], s["start_line"], s["end_line"]))
    return out.select("full_name", "path", "status", F.explode_outer(named).alias("symbol"))


@query("python_imports", """
select full_name, path, unnest(case k when 2 then ['1|m' || (doc_id + 200) || '|run|1', '0|json||2'] when 5 then ['0|pytest||1', '0|app.m' || (doc_id - 60) || '|run|2'] else ['0|pytest||1'] end) as import
from v_blobs where path like '%.py' and not (k = 2 and n % 30 = 12)""")
def _(v):
    i = ad.analysis_imports(ad.python_symbols(v("v_blobs")))
    return i.select("full_name", "path", F.concat_ws("|", "level", "module", F.array_join("names", ","), "line").alias("import"))


ADAPTERS = "select 'python' as adapter, '(?i)[.]py$' as pattern union all select 'rust', '(?i)[.]rs$|(^|/)Cargo[.]toml$' union all select 'script', '(?i)[.][cm]?[jt]sx?$' union all select 'tests', '^tests?/'"
oracle_view("o_routes", f"""
select full_name, path, case when n = 1 then a[1] else 'structural-fallback' end as analyzer, case when n > 1 then 'ambiguous' when n = 1 then 'enhanced' else 'structural-fallback' end as selection,
  case when n > 1 then 'ambiguous-language-adapters:' || array_to_string(a, ',') when n = 1 then 'adapter:' || a[1] else 'no-matching-language-adapter' end as reason
from (select full_name, path, list_filter(list(adapter order by adapter), lambda x: x is not null) as a, count(adapter) as n from v_tree left join ({ADAPTERS}) on regexp_matches(path, pattern) group by 1, 2)""")


def routes(v):
    return ad.route_sources(v("v_tree"), v.sql(ADAPTERS))


@query("route_sources", "select * from o_routes")
def _(v):
    return routes(v)


def count_imports(path: str, content: str) -> dict:
    """A small user adapter: one import row per script line that holds `import`."""
    found = [dict(module=t.strip(), names=[], level=0, line=i, scope="module", context=[])
             for i, t in enumerate(content.split("\n"), 1) if t.startswith("import ")]
    return {"imports": found}


@query("adapter_extract", """
select r.full_name, r.path, r.analyzer, case when r.analyzer = 'rust' then 'not-produced' when r.analyzer = 'python' and k = 2 and n % 30 = 12 then 'invalid' else 'parsed' end as status,
  case when r.analyzer = 'script' then len(list_filter(split(content, chr(10)), lambda t: starts_with(t, 'import '))) when r.analyzer = 'python' and not (k = 2 and n % 30 = 12) then 2 end as imports
from o_routes r join v_blobs b on r.full_name = b.full_name and r.path = b.path where selection = 'enhanced'""")
def _(v):
    out = ad.adapter_extract(v("v_blobs"), routes(v), {"python": ad.parse_python, "script": count_imports})
    n = F.when(F.col("status") == "parsed", F.size("imports").cast("long"))
    return out.select("full_name", "path", "analyzer", "status", n.alias("imports"))
