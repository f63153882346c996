"""Queries over repository scores, acceptance and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.operators import scoring as sc
from proofmill.operators import structure as st
from proofmill.functions import paths as pt
from proofmill.plans import discovery as disc
from proofmill.plans import duck as d
from proofmill.plans.registry import oracle_view, query

def now():
    """The fixed reference time of the queries."""
    return F.lit("2002-01-01 00:00:00")

FLAG_SQL = ", ".join([
    f"bool_or({d.is_test('path')} and {d.is_code('path')}) as has_tests",
    *[f"bool_or({d.rx('path', rx)}) as {name}" for name, rx in [
        ("has_ci", fv.CI_WORKFLOW), ("has_workflows", fv.WORKFLOW_DIR), ("has_governance", fv.GOVERNANCE_DOC),
        ("has_examples", fv.EXAMPLE_TREE), ("has_packages", fv.TRANSFER_TREE), ("has_source_tree", fv.IMPLEMENTATION_TREE),
        ("has_readme", fv.ROOT_README), ("has_docs", fv.DOCS_TREE), ("has_manifest", fv.SCORE_MANIFEST),
        ("has_decisions", fv.DECISION_TREE), ("has_checks", fv.STATIC_CHECKS)]]])
oracle_view("o_flags", f"select full_name, count(*) as files, {FLAG_SQL} from v_tree group by full_name")
oracle_view("o_flagged", "select c.*, coalesce(files, 0) as files, " + ", ".join(
    f"coalesce({f}, false) as {f}" for f in sc.FLAGS) + ", greatest(0, (epoch_us(timestamp '2002-01-01') - epoch_us(pushed_at)) / 86400000000.0) as days "
    "from v_catalog c left join o_flags f on c.tree_name = f.full_name")


def pts(*pairs):
    return " + ".join(f"case when {c} then {n} else 0 end" for c, n in pairs)


def clamp(x):
    return f"cast(greatest(0, least(100, round({x}))) as bigint)"


SCORE_SQL = {
    "maturity": clamp("least(38, log10(stars + 1) * 11) + least(12, log10(forks + 1) * 5) + "
                      + pts(("has_tests", 18), ("has_ci", 12), ("has_governance", 8), ("days < 180", 8))),
    "transferability": clamp("65 + " + pts(("has_examples", 15), ("has_packages", 10), ("size_kb < 150000", 10))),
    "clarity": clamp("20 + " + pts(("has_readme", 18), ("has_docs", 22), ("has_examples", 18), ("has_manifest", 12), ("files > 30000", -15))),
    "design": clamp("25 + " + pts(("has_source_tree", 15), ("has_tests", 20), ("has_decisions", 15), ("has_checks", 10), ("has_workflows", 10))),
    "risk": clamp("5 + " + pts(("archived", 30), ("fork", 10), ("days > 730", 18), ("size_kb > 300000", 8))),
}
REASON_SQL = {
    "maturity": d.reasons(("has_tests", "'Behavioral test files'"), ("has_ci", "'Automated CI workflow'"),
                          ("has_governance", "'Project governance documentation'"), ("days < 180", "'Recently maintained'"),
                          ("days > 730", "'Maintenance appears stale'")),
    "transferability": d.reasons(("true", "'license-independent-transfer-baseline: 65; structural heuristic only'"),
                                 ("has_examples", "'Contains examples'"), ("has_packages", "'Implementation boundaries are visible'"),
                                 ("size_kb < 150000", "'Repository size is inspectable'")),
    "clarity": d.reasons(("has_readme", "'Root README'"), ("has_docs", "'Architecture or documentation tree'"),
                         ("has_examples", "'Executable usage examples'"), ("has_manifest", "'Machine-readable project manifest'"),
                         ("files > 30000", "'Very large tree may obscure patterns'")),
    "design": d.reasons(("has_source_tree", "'Separated implementation tree'"), ("has_tests", "'Design is exercised by tests'"),
                        ("has_decisions", "'Design decisions are documented'"),
                        ("has_checks", "'Static engineering checks are configured'"), ("has_workflows", "'Continuous verification exists'")),
    "risk": "coalesce(nullif(" + d.reasons(("archived", "'Repository is archived'"), ("fork", "'Repository is a fork'"),
                                           ("days > 730", "'No recent maintenance signal'"),
                                           ("size_kb > 300000", "'Large attack and review surface'")) + ", ''), 'No elevated metadata risk detected')",
}
oracle_view("o_scores", "select *, " + ", ".join(f"{x} as {n}" for n, x in SCORE_SQL.items()) + " from o_flagged")
oracle_view("o_assessed", f"""
select a.*, {d.reasons(("domain = 0", "'domain-metadata-missing: same-domain reference required'"), ("overall < 60", "'Overall ' || overall || ' < 60'"),
    ("domain < 50", "'Domain match ' || domain || ' < 50'"), ("risk > 45", "'Risk ' || risk || ' > 45'"))} as rejections from (
  select r.task_id, r.candidate_rank, s.*, coalesce(m.domain, 0) as domain,
    {clamp("coalesce(m.domain, 0) * 0.30e0 + maturity * 0.18e0 + transferability * 0.17e0 + clarity * 0.14e0 + design * 0.16e0 + (100 - risk) * 0.05e0")} as overall
  from o_ranked r join o_scores s on r.full_name = s.full_name left join o_domain m on m.task_id = r.task_id and m.full_name = r.full_name) a""")


@query("tree_flags", "select * from o_flags")
def _(v):
    return sc.tree_flags(v("v_tree"))


def flagged(v):
    return sc.with_flags(v("v_catalog"), sc.tree_flags(v("v_tree")), "tree_name")


def assessed(v, requested=None):
    cand = disc.ranked(v).select("task_id", "full_name", "candidate_rank")
    return sc.assess_repositories(cand, disc.found_catalog(v), sc.tree_flags(v("v_tree")), disc.found_domain(v), now(), tree_key="tree_name")


def _register_score(name, fn):
    sql = f"select full_name, {SCORE_SQL[name]} as score, {REASON_SQL[name]} as reasons from o_flagged"

    @query(f"score_{name}", sql)
    def _(v):
        return fn(flagged(v)).select("full_name", F.col(name).alias("score"), F.array_join(f"{name}_reasons", "|").alias("reasons"))


_register_score("maturity", lambda df: sc.maturity(df, now()))
_register_score("transferability", sc.transferability)
_register_score("clarity", sc.clarity)
_register_score("design", sc.design)
_register_score("risk", lambda df: sc.risk(df, now()))


@query("score_overall", "select task_id, full_name, overall from o_assessed")
def _(v):
    return assessed(v).select("task_id", "full_name", "overall")


@query("assess_repositories", """
select task_id, full_name, candidate_rank, domain, maturity, transferability, clarity, design, risk, overall, rejections, rejections = '' as accepted from o_assessed""")
def _(v):
    return assessed(v).select("task_id", "full_name", "candidate_rank", "domain", "maturity", "transferability", "clarity", "design",
                              "risk", "overall", F.array_join("rejection_reasons", "|").alias("rejections"), "accepted")


@query("acceptance_reasons", "select task_id, full_name, unnest(split(rejections, '|')) as reason from o_assessed where rejections <> ''")
def _(v):
    return assessed(v).select("task_id", "full_name", F.explode("rejection_reasons").alias("reason"))


LEARN = ("learning-only: reference selection does not authorize copying, redistribution, or dependency installation; "
         "preserve attribution and verify applicable terms before reuse")


@query("license_policy", f"""
select full_name, {d.reasons(("license is not null", "'license-metadata: ' || license"),
    ("license is null", "'license-unknown: no reliable license metadata; terms require inspection'"),
    (f"license not in ({d.words(fv.ALLOWED_LICENSES)})", "'license-not-allowlisted: inspect the applicable terms before reuse'"), ("true", d.lit(LEARN)))} as warnings,
  case when coalesce(license in ({d.words(fv.ALLOWED_LICENSES)}), false) then '' else 'license-policy: license is not allowlisted' end as rejections from v_catalog""")
def _(v):
    from dataclasses import replace

    from proofmill.params import DEFAULT
    out = sc.license_policy(v("v_catalog"), replace(DEFAULT, license_policy="allowlist"))
    return out.select("full_name", F.array_join("license_warnings", "|").alias("warnings"), F.array_join("license_rejections", "|").alias("rejections"))


@query("rank_assessments", """
select task_id, full_name, row_number() over (partition by task_id order by rejections = '' desc, overall desc, full_name) as assessment_rank from o_assessed""")
def _(v):
    return sc.rank_assessments(assessed(v)).select("task_id", "full_name", "assessment_rank")


# Requested names are every catalogue entry whose name equals the task's two words.
oracle_view("o_requested_assessed", f"""
select q.task_id, q.full_name, s.maturity, s.transferability, s.clarity, s.design, s.risk, coalesce(m.domain, 0) as domain,
  {clamp("coalesce(m.domain, 0) * 0.30e0 + maturity * 0.18e0 + transferability * 0.17e0 + clarity * 0.14e0 + design * 0.16e0 + (100 - risk) * 0.05e0")} as overall
from (select 't_' || replace(p_name, ' ', '_') as task_id, c.full_name from part p join v_catalog c on p.p_partkey = c.p_partkey) q
join o_scores s on q.full_name = s.full_name left join o_domain m on m.task_id = q.task_id and m.full_name = q.full_name""")
oracle_view("o_merged", """
select task_id, full_name, 0 as origin_priority, 0 as candidate_rank, overall, domain, risk from o_requested_assessed
union all select task_id, full_name, 1, candidate_rank, overall, domain, risk from o_assessed
where (task_id, full_name) not in (select task_id, full_name from o_requested_assessed)""")


def merged(v):
    names = v.sql("select 't_' || replace(p_name, ' ', '_') as task_id, p_partkey from part")
    asked = names.join(v("v_catalog").select("p_partkey", "full_name"), "p_partkey").select(
        "task_id", "full_name", F.lit(0).cast("long").alias("candidate_rank"))
    flags, dom = sc.tree_flags(v("v_tree")), disc.domain(v)
    requested = sc.assess_repositories(asked, v("v_catalog"), flags, dom, now(), tree_key="tree_name")
    return sc.merge_assessments(requested, assessed(v))


@query("merge_assessments", "select task_id, full_name, cast(origin_priority as bigint) as origin_priority, overall from o_merged")
def _(v):
    return merged(v).select("task_id", "full_name", "origin_priority", "overall")


@query("select_learning_set", """
select task_id, full_name, selection_rank, cast(origin_priority as bigint) as origin_priority from (
  select *, row_number() over (partition by task_id order by origin_priority, candidate_rank, full_name) as selection_rank from o_merged
  where domain > 0 and domain >= 50 and overall >= 60 and risk <= 45) where selection_rank <= 2""")
def _(v):
    return sc.select_learning_set(merged(v))


@query("score_matrix", "select task_id, full_name, domain, maturity, transferability, clarity, design, risk, overall from o_assessed")
def _(v):
    dims = ["domain", "maturity", "transferability", "clarity", "design", "risk", "overall"]
    long = assessed(v).select("task_id", "full_name", F.explode(F.create_map(*[x for n in dims for x in (F.lit(n), F.col(n))])).alias("dimension", "score"))
    return sc.score_matrix(long)


# -- structure --------------------------------------------------------------------
@query("classify_paths", f"""
select full_name, path, {d.is_code('path')} as is_code, {d.is_test('path')} as is_test, {d.is_support('path')} as is_test_support,
  {d.rx('path', fv.PACKAGE_MARKER)} as is_marker, {d.rx('path', fv.BUILD_SUPPORT)} as is_build_support,
  {d.is_behavior('path')} as is_behavior_code, {d.is_impl('path')} as is_implementation from v_tree""")
def _(v):
    return st.classify_paths(v("v_tree")).drop("revision", "type", "size")


@query("classify_atlas_category", f"""
select full_name, path, {d.rx('path', fv.OVERVIEW_FILE)} as is_overview, {d.rx('path', fv.DESIGN_FILE)} as is_design, {d.rx('path', fv.SECURITY_FILE)} as is_security,
  {d.rx('path', fv.MANIFEST_FILE)} as is_manifest, {d.rx('path', fv.AUTOMATION_FILE)} as is_automation, {d.rx('path', fv.ENTRY_FILE)} as is_entry,
  case when {d.rx('path', fv.MANIFEST_FILE)} then case when path like '%package.json' then 'node' when path like '%pyproject.toml' then 'python'
    when path like '%Cargo.toml' then 'rust' else 'unknown' end end as ecosystem from v_tree""")
def _(v):
    return st.classify_atlas_category(v("v_tree")).drop("revision", "type", "size")


ARCH = f"({d.rx('path', fv.OVERVIEW_FILE)} or {d.rx('path', fv.DESIGN_FILE)} or {d.rx('path', fv.SECURITY_FILE)})"


@query("doc_kind", f"""
select full_name, path, case when {d.rx('path', fv.SECURITY_FILE)} then 'security' when {d.rx('path', fv.DESIGN_FILE)} then
  case when regexp_matches(path, '(?i)ADR|RFC') then 'decision' else 'architecture' end else 'overview' end as kind from v_tree where {ARCH}""")
def _(v):
    return st.architecture_documents(v("v_tree"))


MODALITY = f"""case when {d.is_support('path')} then 'test-support' when {d.is_test('path')} then 'test' when {d.rx('path', fv.MANIFEST_FILE)} then 'manifest'
  when {d.rx('path', fv.SLICE_DESIGN)} or {d.rx('path', fv.OVERVIEW_FILE)} then 'documentation' else 'implementation' end"""


@query("path_modality", f"select full_name, path, {MODALITY} as modality from v_tree")
def _(v):
    return v("v_tree").select("full_name", "path", pt.modality(F.col("path")).alias("modality"))


ELIGIBLE = f"""type = 'blob' and ({d.rx('path', fv.SLICE_TEXT_FILE)} or {d.is_code('path')}) and not {d.rx('path', fv.SLICE_EXCLUDED)}
  and not {d.rx('path', fv.BUILD_SUPPORT)} and coalesce(size, 0) < 120000"""


@query("eligible_text_paths", f"select full_name, path, size from v_tree where {ELIGIBLE}")
def _(v):
    return st.eligible_text_paths(v("v_tree")).select("full_name", "path", "size")


HINTS = d.reasons(*[(d.rx("path", rx), d.lit(role)) for role, rx in fv.ROLE_PATH_HINTS.items()])


@query("role_path_hints", f"select full_name, path, {HINTS} as hints from v_tree where {HINTS} <> ''")
def _(v):
    h = st.role_path_hints(F.col("path"))
    return v("v_tree").filter(F.size(h) > 0).select("full_name", "path", F.array_join(h, "|").alias("hints"))


oracle_view("o_readable", "select full_name, revision, path, content from v_blobs where not contains(content, chr(0)) and regexp_matches(content, '[^\\s]')")
oracle_view("o_parsed", """
select full_name, path, language, bool_or(role = 'implementation') as any_implementation, bool_or(role = 'implementation' and kind <> 'module') as any_declaration,
  bool_or(role = 'test' and coalesce(has_body, true)) as any_test, bool_or(role = 'test' and kind <> 'class' and coalesce(has_body, true)) as any_test_function
from v_symbols group by 1, 2, 3""")
oracle_view("o_evidence", f"""
select r.full_name, r.path,
  case when {d.rx('r.path', fv.RUST_FILE)} then case when language = 'rust' then any_declaration else {d.rx('content', fv.RUST_DECLARATION)} end
    when not {d.rx('r.path', fv.PYTHON_FILE)} then true when language = 'python' then any_implementation
    else not {d.rx('r.path', fv.PACKAGE_MARKER)} and {d.rx('content', fv.PYTHON_DECLARATION)} end as source_evidence,
  case when {d.is_support('r.path')} then false
    when {d.rx('r.path', fv.RUST_FILE)} then case when language = 'rust' then any_test else {d.rx('content', fv.RUST_TEST_FUNCTION)} and {d.rx('content', fv.RUST_ASSERTION)} end
    when not {d.rx('r.path', fv.PYTHON_FILE)} then true
    when language = 'python' then any_test_function else {d.rx('content', fv.PYTHON_TEST_FUNCTION)} and {d.rx('content', fv.PYTHON_ASSERTION)} end as test_evidence
from o_readable r left join o_parsed p on r.full_name = p.full_name and r.path = p.path""")
oracle_view("o_categories", f"""
select full_name, path, unnest(split(cats, '|')) as category from (select full_name, path, {d.reasons(
    (d.is_impl('path'), "'source'"), (f"({d.is_test('path')} and {d.is_code('path')}) or ({d.is_impl('path')} and {d.rx('path', fv.RUST_FILE)})", "'test'"),
    (d.rx('path', fv.MANIFEST_FILE), "'manifest'"), (d.rx('path', fv.OVERVIEW_FILE), "'overview'"),
    (f"{d.rx('path', fv.DESIGN_FILE)} or {d.rx('path', fv.SECURITY_FILE)}", "'design'"), (d.rx('path', fv.AUTOMATION_FILE), "'automation'"))} as cats
  from o_readable) where cats <> ''""")
oracle_view("o_qualified", """
select c.full_name, c.path, c.category from o_categories c join o_evidence e on c.full_name = e.full_name and c.path = e.path
where case c.category when 'source' then source_evidence when 'test' then test_evidence else true end
union all select distinct full_name, evidence_path, 'relationships' from v_relations""")
POINTS = "case category " + " ".join(f"when '{k}' then {n}" for k, n in fv.CATEGORY_POINTS.items()) + " end"
oracle_view("o_coverage", f"""
select full_name, score, present, missing, score >= 50 and missing = '' as sufficient from (
  select full_name, cast(sum({POINTS}) as bigint) as score, string_agg(category, '|' order by category) as present,
    concat_ws('|', case when not bool_or(category = 'source') then 'source' end, case when not bool_or(category = 'test') then 'test' end) as missing
  from (select distinct full_name, category from o_qualified) group by full_name)""")


def readable(v):
    return st.filter_text_blobs(v("v_tree"), v("v_blobs"))


def qualified(v):
    return st.qualified_files(readable(v)[0], v("v_symbols"), v("v_relations"))


@query("source_text_evidence", "select full_name, path, source_evidence from o_evidence")
def _(v):
    return st.text_evidence(readable(v)[0], v("v_symbols")).drop("test_evidence")


@query("source_text_evidence_unparsed", f"""
select full_name, path, case when {d.rx('path', fv.RUST_FILE)} then {d.rx('content', fv.RUST_DECLARATION)} when not {d.rx('path', fv.PYTHON_FILE)} then true
  else not {d.rx('path', fv.PACKAGE_MARKER)} and {d.rx('content', fv.PYTHON_DECLARATION)} end as source_evidence,
  case when {d.is_support('path')} then false when {d.rx('path', fv.RUST_FILE)} then {d.rx('content', fv.RUST_TEST_FUNCTION)} and {d.rx('content', fv.RUST_ASSERTION)}
    when not {d.rx('path', fv.PYTHON_FILE)} then true else {d.rx('content', fv.PYTHON_TEST_FUNCTION)} and {d.rx('content', fv.PYTHON_ASSERTION)} end as test_evidence
from o_readable""")
def _(v):
    return st.text_evidence(readable(v)[0], v("v_symbols").limit(0))


@query("test_text_evidence", "select full_name, path, test_evidence from o_evidence")
def _(v):
    return st.text_evidence(readable(v)[0], v("v_symbols")).drop("source_evidence")


@query("coverage_score", "select * from o_coverage")
def _(v):
    return sc.coverage_score(qualified(v)).select("full_name", "score", F.array_join("present", "|").alias("present"),
                                                  F.array_join("missing_required", "|").alias("missing"), "sufficient")


@query("coverage_samples", """
select full_name, category, path, row_number() over (partition by full_name, category order by path) as sample from (select distinct * from o_qualified)""")
def _(v):
    return sc.coverage_samples(qualified(v))


@query("coverage_gate", """
select a.task_id, a.full_name, concat_ws('|', nullif(rejections, ''),
  case when coalesce(score, 0) < 60 then 'Architecture evidence coverage ' || coalesce(score, 0) || ' < 60' end,
  case when missing <> '' then 'Missing required architecture evidence: ' || replace(missing, '|', ', ') end) as rejections
from o_assessed a left join (select full_name, score, array_to_string(list_filter(['automation', 'overview', 'test'], lambda c: not list_contains(split(present, '|'), c)), '|') as missing from o_coverage) c
  on a.tree_name = c.full_name""")
def _(v):
    from dataclasses import replace

    from proofmill.params import DEFAULT
    params = replace(DEFAULT, min_coverage=60, required_categories=("automation", "overview", "test"))
    cov = sc.coverage_score(qualified(v), params).withColumnRenamed("full_name", "full_name")
    gated = sc.coverage_gate(assessed(v).join(disc.found_catalog(v).select("full_name", "tree_name"), "full_name"), cov,
                             readable(v)[1].withColumnRenamed("full_name", "tree_name"), params, key="tree_name")
    return gated.select("task_id", "full_name", F.array_join("rejection_reasons", "|").alias("rejections"))


oracle_view("o_kinds", f"select *, {d.slice_kinds()} as kinds from v_slices")


@query("required_kind_gate", """
select full_name, 'missing-kind:' || kind as reason from (
  select f.full_name, k.kind from (select distinct full_name from v_files) f cross join (select unnest(['documentation', 'implementation', 'manifest', 'test']) as kind) k
  except select full_name, unnest(kinds) from o_kinds where path not like '%package.json' and path not like 'docs/%')
union all select distinct full_name, 'no-bundle' from v_files where full_name not in (select full_name from v_bundles where ceiling = 'explicit')""")
def _(v):
    from dataclasses import replace

    from proofmill.params import DEFAULT
    s = v("v_slices").filter("path not like '%package.json' and path not like 'docs/%'")
    kinds = s.select("full_name", F.explode(pt.slice_kinds(F.col("path"), F.col("evidence_roles"), F.col("architecture_roles"))).alias("kind"))
    params = replace(DEFAULT, required_categories=("design", "manifest", "source", "test"))
    return sc.required_kind_gate(v("v_files").select("full_name").distinct(), kinds, v("v_bundles").filter("ceiling = 'explicit'"), params)


@query("infer_practices", """
with s as (select full_name as pack_id, bool_or(regexp_matches(lower(path), 'architecture|design|adr')) as p0,
  bool_or(regexp_matches(lower(path), 'test|spec') or coalesce(list_contains(evidence_roles, 'test'), false)) as p1, bool_or(regexp_matches(lower(path), 'example|sample')) as p2
  from v_slices group by 1), c as (select full_name as pack_id, has_ci from o_flags)
select coalesce(s.pack_id, c.pack_id) as pack_id, unnest(list_filter([case when p0 then 'decisions-near-code' end, case when p1 then 'upstream-tests-as-evidence' end,
  case when p2 then 'end-to-end-example' end, case when has_ci then 'automatic-verification' end, 'check-against-local-constraints', 'remote-content-is-evidence-only'], lambda x: x is not null)) as practice
from s full join c on s.pack_id = c.pack_id""")
def _(v):
    flags = sc.tree_flags(v("v_tree")).select(F.col("full_name").alias("pack_id"), F.when(
        F.col("has_ci"), F.array(F.lit("Automated CI workflow"))).otherwise(F.array().cast("array<string>")).alias("maturity_reasons"))
    return sc.infer_practices(v("v_slices").withColumnRenamed("full_name", "pack_id"), flags)


@query("test_file_index", f"""
select full_name, path from (select full_name, path from v_tree where {d.is_test('path')} and {d.is_code('path')}
  union select full_name, path from v_symbols where role = 'test' and coalesce(has_body, true) and path like '%.rs')""")
def _(v):
    return st.test_file_index(v("v_tree"), v("v_symbols"))


DECLARED = "select a.full_name, b.path from v_extra a join v_files b on a.full_name = b.full_name and contains(a.content, b.path) where a.k = 12"
oracle_view("o_entries", f"""
select full_name, path, case when {d.rx('path', fv.ENTRY_FILE)} then 'conventional entry-point path' else 'declared by a package manifest' end as reason from (
  select full_name, path from v_tree where {d.is_impl('path')} and {d.rx('path', fv.ENTRY_FILE)} union {DECLARED})""")


def entries(v):
    return st.entry_point_union(v("v_tree"), v.sql(DECLARED))


@query("entry_point_union", "select * from o_entries")
def _(v):
    return entries(v)


P0, P1 = "split_part(path, '/', 1)", "split_part(path, '/', 2)"
TOP = f"case when contains(path, '/') then {P0} else '.' end"
oracle_view("o_modules", f"""
with g as (select full_name, path, {d.is_impl('path')} as g0, {d.is_test('path')} and {d.is_code('path')} as g1, {d.rx('path', fv.EXAMPLE_TREE)} as g2,
    case when {d.is_test('path')} then {TOP} when {P0} in ('packages', 'apps') and {P1} <> '' then {P0} || '/' || {P1}
      when {P0} in ('src', 'lib') then case when len(split(path, '/')) > 2 then {P0} || '/' || {P1} else {P0} end
      when {d.rx('path', fv.EXAMPLE_TREE)} or {d.rx('path', fv.PYTHON_FILE)} or {d.rx('path', fv.RUST_FILE)} then {TOP} end as root,
    case when {d.is_test('path')} then 'test' when {P0} = 'apps' and {P1} <> '' then 'application' when {P0} = 'packages' and {P1} <> '' then 'package'
      when {P0} in ('src', 'lib') then 'library' when {d.rx('path', fv.EXAMPLE_TREE)} then 'example' else 'library' end as kind from v_tree),
m as (select full_name, path, root, kind, unnest(list_filter([case when g0 then 0 end, case when g1 then 1 end, case when g2 then 2 end], lambda x: x is not null)) as grp from g where root is not null)
select m.full_name, m.root, arg_min(kind, grp || ' ' || path) as kind, count(*) as files,
  any_value((select count(*) from o_entries e where e.full_name = m.full_name and (e.path = m.root or starts_with(e.path, m.root || '/')))) as entries
from m group by m.full_name, m.root""")


def modules(v):
    return st.module_summary(v("v_tree"), entries(v))


@query("module_summary", "select * from o_modules")
def _(v):
    return modules(v)


@query("cap_per_group", "select full_name, path, start_line from v_slices qualify row_number() over (partition by full_name order by relevance desc, path, start_line) <= 20")
def _(v):
    return st.cap_per_group(v("v_slices").select("full_name", "path", "start_line", "relevance"), ["full_name"],
                            [F.desc("relevance"), "path", "start_line"], 20).drop("relevance")


@query("preferred_paths", f"""
select full_name, path from o_entries union select full_name, path from v_tree where {d.rx('path', fv.MANIFEST_FILE)} or {ARCH}
union select full_name, path from o_qualified where category in ('source', 'test')""")
def _(v):
    tree = v("v_tree")
    named = tree.filter(F.col("path").rlike(fv.MANIFEST_FILE) | pt.is_arch_doc(F.col("path")))
    return st.preferred_paths([entries(v), named, qualified(v).filter("category in ('source', 'test')")])


@query("union_distinct_paths", f"select full_name, path from v_tree where {d.is_test('path')} union select full_name, path from v_tree where {d.is_code('path')} union select full_name, src from v_relations")
def _(v):
    tree, p = v("v_tree"), F.col("path")
    return st.preferred_paths([tree.filter(pt.is_test(p)), tree.filter(pt.is_code(p)), v("v_relations").withColumnRenamed("src", "path")])


@query("missing_required", """
select distinct full_name, category from v_tree cross join (select unnest(['automation', 'design', 'manifest', 'overview', 'source', 'test']) as category)
except select full_name, category from o_qualified""")
def _(v):
    need = v("v_tree").select("full_name").distinct().withColumn("category", F.explode(F.array(*[F.lit(c) for c in (
        "automation", "design", "manifest", "overview", "source", "test")])))
    return st.missing_required(need, qualified(v), ["full_name", "category"])
