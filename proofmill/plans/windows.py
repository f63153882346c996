"""Queries over reading order, windows and slice refinement."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofmill import fixed_values as fv
from proofmill.functions import paths as pt
from proofmill.operators import structure as st
from proofmill.operators import windows as wn
from proofmill.plans import duck as d
from proofmill.plans.assessment import ELIGIBLE, MODALITY
from proofmill.plans.registry import oracle_view, query
from proofmill.plans.views import VIEWS

VIEWS["v_terms"] = "select distinct full_name, lang as term from v_files union select distinct full_name, 'core' from v_files union select distinct full_name, 'run' from v_files union select full_name, case when count(*) > 15 then 'Store' else 'value' end from v_files group by full_name"
oracle_view("o_term_list", "select full_name, list_sort(list(distinct lower(term))) as terms from v_terms group by 1")

PUBLIC = "(not starts_with(name, '_') and (language <> 'rust' or starts_with(coalesce(visibility, ''), 'pub')))"
FAILS = "(len(raises) > 0 or len(catches) > 0 or unsafe_count > 0)"
SEMANTIC = d.reasons((f"role = 'implementation' and kind <> 'module' and {PUBLIC}", "'contract'"), ("assertion_count > 0", "'invariant'"), (FAILS, "'failure'"), ("role = 'test' and coalesce(has_body, true)", "'test'"))
ARCHITECTURE = d.reasons(("kind in ('class', 'struct', 'union', 'enum', 'trait', 'impl', 'type')", "'contract'"), ("len(fields) > 0", "'data-model'"), (FAILS, "'failure'"),
                         ("kind in ('trait', 'impl') or len(list_filter(bases, lambda b: regexp_matches(b, '(?i)protocol|abstract|abc'))) > 0", "'extension-point'"), ("role in ('test', 'fixture')", "'test'"))


@query("semantic_roles", f"select full_name, path, name, {SEMANTIC} as roles from v_symbols")
def _(v):
    s = v("v_symbols")
    return s.select("full_name", "path", "name", F.array_join(wn.semantic_roles(s), "|").alias("roles"))


@query("architecture_roles", f"select full_name, path, name, {ARCHITECTURE} as roles from v_symbols")
def _(v):
    s = v("v_symbols")
    return s.select("full_name", "path", "name", F.array_join(wn.architecture_roles(s), "|").alias("roles"))


@query("slice_kinds", f"select slice_id, {d.joined(d.slice_kinds())} as kinds, {d.primary_kind()} as kind from v_slices")
def _(v):
    args = [F.col(c) for c in ("path", "evidence_roles", "architecture_roles")]
    return v("v_slices").select("slice_id", F.array_join(pt.slice_kinds(*args), "|").alias("kinds"), pt.primary_kind(*args).alias("kind"))


@query("quality_modalities", f"select slice_id, {d.joined(d.quality_modalities())} as modalities from v_slices")
def _(v):
    args = [F.col(c) for c in ("path", "evidence_roles", "architecture_roles")]
    return v("v_slices").select("slice_id", F.array_join(pt.quality_modalities(*args), "|").alias("modalities"))


HITS = "len(list_filter(terms, lambda t: contains(lower(path), t)))"
oracle_view("o_structural", f"""
select *, row_number() over (partition by full_name order by score desc, path) as read_rank from (
  select f.full_name, path, size, cast(case when {d.rx('path', fv.MANIFEST_FILE)} then 100 else 0 end + case when {d.rx('path', fv.ENTRY_FILE)} and not {d.rx('path', fv.PACKAGE_MARKER)} then 60 else 0 end
    + case when {HITS} > 0 then 30 else 0 end + case when {d.is_test('path')} then 10 else 0 end - len(split(path, '/')) as bigint) as score
  from v_tree f join o_term_list t on f.full_name = t.full_name where {d.rx('path', fv.MANIFEST_FILE)} or {d.is_impl('path')} or ({d.is_test('path')} and {d.is_code('path')}) or {d.is_support('path')}
    or {d.rx('path', fv.OVERVIEW_FILE)} or {d.rx('path', fv.DESIGN_FILE)} or {d.rx('path', fv.SECURITY_FILE)} or {d.rx('path', fv.AUTOMATION_FILE)})""")


def structural(v):
    return wn.rank_structural_files(v("v_tree"), v("v_terms"))


@query("rank_structural_files", "select * from o_structural")
def _(v):
    return structural(v)


PREFERRED = "select full_name, path from v_tree where size % 3 = 0"
FACTS = [("p.path is not null", 16, "'design-atlas structural evidence'"), (f"{HITS.replace('path', 'f.path')} > 0", 0, "'path matches ' || array_to_string(list_filter(terms, lambda t: contains(lower(f.path), t)), ', ')"),
         (d.rx("lower(f.path)", fv.SLICE_DESIGN), 35, "'design documentation'"), (d.rx("lower(f.path)", fv.OVERVIEW_FILE), 28, "'project overview'"), (d.rx("f.path", fv.EXAMPLE_TREE), 18, "'usage example'"),
         (d.is_test("f.path"), 12, "'behavioral evidence'"), (d.is_support("f.path"), 6, "'test-support evidence, not a test case'"), (d.is_impl("f.path"), 8, "'implementation source'")]
oracle_view("o_slice_paths", f"""
select full_name, path, score, case when reason = '' then 'representative source' else replace(reason, '|', '; ') end as reason, {d.rx('path', fv.PACKAGE_MARKER)} as marker, {MODALITY} as modality from (
  select f.full_name, f.path, {HITS.replace('path', 'f.path')} * 20.0e0 - len(split(f.path, '/')) * 0.5e0 + {' + '.join(f"case when {c} then {n}e0 else 0e0 end" for c, n, _m in FACTS)} as score,
    {d.reasons(*[(c, m) for c, _n, m in FACTS])} as reason
  from (select * from v_tree where {ELIGIBLE}) f join o_term_list t on t.full_name = f.full_name left join ({PREFERRED}) p on p.full_name = f.full_name and p.path = f.path) where score >= 5""")


def slice_paths(v):
    return wn.rank_slice_paths(st.eligible_text_paths(v("v_tree")), v("v_terms"), v.sql(PREFERRED))


@query("rank_slice_paths", "select * from o_slice_paths")
def _(v):
    return slice_paths(v)


@query("slice_read_candidates", "select *, row_number() over (partition by full_name, modality order by marker, score desc, path) as modality_rank from o_slice_paths")
def _(v):
    return wn.slice_read_candidates(slice_paths(v))


oracle_view("o_categories_all", f"""
select full_name, path, unnest(split(cats, '|')) as category from (select full_name, path, {d.reasons(
    (d.is_impl('path'), "'source'"), (f"({d.is_test('path')} and {d.is_code('path')}) or ({d.is_impl('path')} and {d.rx('path', fv.RUST_FILE)})", "'test'"),
    (d.rx('path', fv.MANIFEST_FILE), "'manifest'"), (d.rx('path', fv.OVERVIEW_FILE), "'overview'"),
    (f"{d.rx('path', fv.DESIGN_FILE)} or {d.rx('path', fv.SECURITY_FILE)}", "'design'"), (d.rx('path', fv.AUTOMATION_FILE), "'automation'"))} as cats from v_tree) where cats <> ''""")

TURN = "case category " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(wn.READ_ORDER)) + " end"


@query("top_files_per_category", f"""
with c as (select s.full_name, s.path, s.size, category, row_number() over (partition by s.full_name, category order by read_rank) as nth from o_structural s join o_categories_all c on c.full_name = s.full_name and c.path = s.path),
r as (select full_name, path, size, row_number() over (partition by full_name order by min(nth * 10 + {TURN}), path) as read_order from c group by 1, 2, 3)
select full_name, path, read_order, size as chars, false as truncated from r""")
def _(v):
    return wn.top_files_per_category(structural(v))


STRUCT_RX = d.lit(r"\b(" + fv.STRUCTURE_WORDS + r")\b")


@query("best_line_window", f"""
with l as (select b.full_name, b.revision, b.path, split(content, chr(10)) as ls, terms from v_blobs b join o_term_list t on t.full_name = b.full_name),
w as (select *, len(ls) as n, case when len(ls) > 20 then list_transform(range(0, len(ls), 10), lambda s: [4 * len(list_filter(terms, lambda t: contains(lower(array_to_string(list_slice(ls, s + 1, s + 20), chr(10))), t)))
    + least(12, len(regexp_extract_all(lower(array_to_string(list_slice(ls, s + 1, s + 20), chr(10))), {STRUCT_RX}))), -s]) else [] end as sc from l)
select full_name, revision, path, coalesce(-list_max(sc)[2], 0) + 1 as start_line, least(coalesce(-list_max(sc)[2], 0) + 20, n) as end_line, coalesce(list_max(sc)[1], 1) as relevance from w""")
def _(v):
    return wn.best_line_window(v("v_blobs"), v("v_terms"), 20)


SYM_TEXT = "array_to_string(list_slice(split(b.content, chr(10)), s.start_line, s.end_line), chr(10))"
PH = "len(list_filter(terms, lambda t: " + d.contains_norm("@@", "t") + "))"
oracle_view("o_symbol_scores", f"""
select *, case language when 'typescript' then script - (end_line - start_line + 1) * 0.01e0 when 'rust' then base + rs else base end as score,
  case language when 'typescript' then script + 2 when 'rust' then base + rs else base end as relevance from (
  select *, {PH.replace('@@', 'name_norm')} * 8 + {PH.replace('@@', 'body_norm')} * 5 as base, case when kind in ('trait', 'struct', 'enum', 'impl') then 4 else 0 end + case when visibility = 'pub' then 3 else 0 end as rs,
    len(list_filter(terms, lambda t: contains(lower(text), t))) * 5 + len(list_filter(terms, lambda t: contains(lower(name), t))) * 8 + case when kind in ('interface', 'type') then 4 else 0 end + case when role = 'test' then 3 else 0 end as script from (
    select s.*, terms, {SYM_TEXT} as text, {d.norm('s.name')} as name_norm, {d.norm(SYM_TEXT)} as body_norm from v_symbols s join v_blobs b on b.full_name = s.full_name and b.path = s.path join o_term_list t on t.full_name = s.full_name
    where (s.language = 'python' and (not {d.is_test('s.path')} or (s.role = 'test' and s.kind <> 'class' and s.has_body))) or (s.language = 'rust' and s.kind <> 'module' and (s.role <> 'test' or s.has_body)) or (s.language = 'typescript' and s.end_line - s.start_line >= 1)))""")


@query("best_symbol_window", """
select full_name, path, name, start_line, end_line, cast(relevance as bigint) as relevance from o_symbol_scores qualify row_number() over (partition by full_name, path order by score desc, start_line, name) = 1""")
def _(v):
    return wn.best_symbol_window(v("v_symbols"), v("v_blobs"), v("v_terms")).select("full_name", "path", "name", "start_line", "end_line", "relevance")


@query("supplement_windows")
def _(v):
    primary = wn.best_symbol_window(v("v_symbols"), v("v_blobs"), v("v_terms"))
    return wn.supplement_windows(v("v_symbols"), primary)


def candidates(v):
    imports = v("v_py_imports").select("full_name", "path", "line")
    return wn.candidate_windows(slice_paths(v), v("v_blobs"), v("v_symbols"), imports, v("v_relations"), v("v_terms"))


@query("candidate_windows")
def _(v):
    out = candidates(v)
    return out.select("slice_id", "full_name", "path", "start_line", "end_line", "relevance", "strategy", F.array_join("evidence_roles", "|").alias("evidence_roles"),
                      F.array_join("architecture_roles", "|").alias("architecture_roles"))


oracle_view("o_dedupe", f"""
with e as (select full_name, src as path from v_relations union select full_name, dst from v_relations),
r as (select s.slice_id, s.full_name, s.path, s.start_line, relevance, array_to_string(list_sort({d.slice_kinds('s.path')}), ',') as kinds, coalesce(e.path, '') as endpoint, {d.trimmed('content')} as body
  from v_slices s left join e on e.full_name = s.full_name and e.path = s.path)
select slice_id, case when body = '' then 'low-value' when row_number() over (partition by full_name, kinds, endpoint, body order by relevance desc, path, start_line, slice_id) = 1 then 'kept' else 'duplicate' end as status from r""")


@query("dedupe_slices", "select * from o_dedupe")
def _(v):
    return wn.dedupe_slices(v("v_slices"), v("v_relations"))


@query("diverse_slices", f"""
with k as (select *, {d.primary_kind()} as kind from v_slices), n as (select *, row_number() over (partition by full_name, kind order by relevance desc, path, start_line, slice_id) as nth from k)
select full_name, slice_id, kind, row_number() over (partition by full_name order by case when nth = 1 then case kind when 'documentation' then 1 when 'manifest' then 2 when 'implementation' then 3 when 'test' then 4 else 5 end else 5 end,
  relevance desc, path, start_line, slice_id) as place from n""")
def _(v):
    return wn.diverse_slices(v("v_slices"), ["full_name"]).select("full_name", "slice_id", "kind", "place")
